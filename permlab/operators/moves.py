"""Look-ahead over several moves: rows of an array are replaced one after another so that conflicts end that no single move ends.

A move gives a row other symbols: any other order of those of one group, or its symbols turned by some places. A plan is a few moves of different rows. Plans grow by a
move a level, all of them at once: a move is rated by the conflicts that it ends and makes in the array as the plan has changed it. Moves that
make more than they end are left, plans whose moves end nothing at the last level too; `width` keeps the best plans of a level, None all.

Each level joins the moves of rows in conflict, after the plan, with the array by balls or templates, so it grows with the conflicts and not with the square of the rows.
Ties: more gain first, then the plan's text.

Cases: repeated rows conflict with one another and are moved like others; an array without conflicts has no plans; with `width` the best plan may be missed.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlab.functions import columns as C
from permlab.operators.lazy import between
from permlab.operators.relations import ball_of, meeting
from permlab.sources.storage import staged


def moves(rows: DataFrame, d: int, turns: bool = False) -> DataFrame:
    """rows: row_id, u and others. With `new`: u with the symbols of one group in another order (or, with turns, turned by some places), each once."""
    groups = F.sequence(F.lit(0), F.floor((F.size("u") - 1) / d).cast("int"))
    orders = F.array(*[C.ints(*p) for p in permutations(range(d)) if list(p) != list(range(d))]) if d > 1 else F.array().cast("array<array<int>>")
    one = rows.withColumn("group", F.explode(groups)).withColumn("order", F.explode(orders))

    def other(x):
        held = F.filter("u", lambda y: F.floor(y / d) == F.col("group"))  # the group's symbols in their order
        return F.when(F.floor(x / d) == F.col("group"), F.get(held, F.get(F.col("order"), F.array_position(held, x).cast("int") - 1))).otherwise(x)

    ordered = one.where(F.forall(F.slice("order", F.size(F.filter("u", lambda y: F.floor(y / d) == F.col("group"))) + 1, d), lambda p: p >= F.size(F.filter("u", lambda y: F.floor(y / d) == F.col("group")))))
    new = ordered.withColumn("new", F.transform("u", other)).drop("group", "order")
    if turns:
        by = rows.withColumn("by", F.explode(F.sequence(F.lit(1), F.size("u") - 1)))
        new = new.unionByName(by.withColumn("new", F.concat(F.expr("slice(u, by + 1, size(u))"), F.expr("slice(u, 1, by)"))).drop("by"))
    return new.where(F.forall("new", lambda x: x.isNotNull()) & (F.col("new") != F.col("u"))).distinct()


def look_ahead(array: DataFrame, d: int, depth: int = 3, width: int | None = 64, turns: bool = False) -> DataFrame:
    """plan (row_id and new row of each move, in order), gains (of each move), gain: plans of up to `depth` moves that end more conflicts than they make."""
    spark = array.sparkSession
    array = staged(array.select(F.col("row_id").cast("long").alias("row_id"), "u"), "array")
    edges = staged(between(array, array, d), "conflicts")  # both ways
    schema = "plan array<struct<row_id: long, u: array<int>>>, gains array<long>"
    plans, out = spark.createDataFrame([([], [])], schema), None
    for level in range(depth):
        grown = staged(_grown(plans, array, edges, d, turns), "plans")
        good = grown.where(F.aggregate("gains", F.lit(0).cast("long"), lambda a, x: a + x) > 0)
        out = good if out is None else out.unionByName(good)
        if level + 1 < depth:
            order = [F.aggregate("gains", F.lit(0).cast("long"), lambda a, x: a + x).desc(), F.to_json("plan").asc()]
            plans = grown if width is None else staged(grown.orderBy(*order).limit(width), "best-plans")
    return out.select("plan", "gains", F.aggregate("gains", F.lit(0).cast("long"), lambda a, x: a + x).alias("gain"))


def _grown(plans: DataFrame, array: DataFrame, edges: DataFrame, d: int, turns: bool) -> DataFrame:
    """Plans with another move, of a row in conflict that the plan hasn't moved."""
    plans = staged(plans.withColumn("id", F.xxhash64("plan")), "numbered-plans")
    moved = plans.select("id", F.explode("plan").alias("m")).select("id", F.col("m.row_id").alias("row_id"), F.col("m.u").alias("u"))
    # the conflicts of each plan's array: those of unmoved rows, and those of moved rows found anew
    gone = moved.select(F.col("id").alias("i"), F.col("row_id").alias("r"))
    base = edges.crossJoin(F.broadcast(plans.select("id")))  # `width` plans
    base = base.join(gone, (F.col("id") == F.col("i")) & (F.col("a") == F.col("r")), "left_anti").join(gone, (F.col("id") == F.col("i")) & (F.col("b") == F.col("r")), "left_anti")
    own = _against(moved, moved, array, d, "id")
    now = base.select("id", "a", "b").unionByName(own).unionByName(own.select("id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    bad = now.groupBy("id", "a").agg(F.count("*").alias("had")).join(gone, (F.col("id") == F.col("i")) & (F.col("a") == F.col("r")), "left_anti")
    tries = moves(bad.join(array, F.col("a") == F.col("row_id")).select("id", "row_id", "u", "had"), d, turns)
    tries = staged(tries.withColumn("try", F.xxhash64("id", "row_id", "new")), "moves")
    makes = _against(tries.select("id", "try", "row_id", F.col("new").alias("u")), moved, array, d, "try").groupBy(F.col("try").alias("t")).agg(F.count("*").alias("makes"))
    rated = tries.join(makes, F.col("try") == F.col("t"), "left").withColumn("gain", (F.col("had") - F.coalesce("makes", F.lit(0))).cast("long")).where("gain >= 0")
    rated = rated.select(F.col("id").alias("i"), F.struct("row_id", F.col("new").alias("u")).alias("move"), "gain")
    return plans.join(rated, F.col("id") == F.col("i")).select(F.concat("plan", F.array("move")).alias("plan"), F.concat("gains", F.array("gain")).alias("gains"))


def _against(rows: DataFrame, moved: DataFrame, array: DataFrame, d: int, name: str) -> DataFrame:
    """rows: id, row_id, u and `name`. name, a, b: conflicts of a row with the array as the plan `id` has it."""
    t = lambda u: C.groups(u, d)
    own = rows.select(F.col("id").alias("i"), F.col(name).alias("n"), F.col("row_id").alias("a"), F.col("u").alias("x"), t("u").alias("t"))
    far = lambda some: some.where((F.col("a") != F.col("b")) & ~C.separated("x", "y", d))
    # unmoved rows by balls or templates; rows that the plan moved, which are few, by the plan
    renamings, many = ball_of(array, d)  # moves leave permutations permutations
    if renamings is not None:
        still = meeting(own.select(F.col("x").alias("u"), "i", "n", "a"), array, renamings, many, ("i", "n", "a")).where(F.col("a") != F.col("b"))
    else:
        plain = array.select(F.col("row_id").alias("b"), F.col("u").alias("y"), t("u").alias("s"))
        near = own.select("t").distinct().join(plain.select("s").distinct(), C.foes("t", "s")).select(F.col("t").alias("t1"), F.col("s").alias("s1"))
        still = far(own.join(near, F.col("t") == F.col("t1")).join(plain, F.col("s1") == F.col("s")))
    gone = moved.select(F.col("id").alias("mi"), F.col("row_id").alias("mr"), F.col("u").alias("y"))
    still = still.join(gone.drop("y"), (F.col("i") == F.col("mi")) & (F.col("b") == F.col("mr")), "left_anti")
    other = far(own.join(gone, F.col("i") == F.col("mi")).withColumn("b", F.col("mr")))
    return still.select(F.col("n").alias(name), "a", "b").unionByName(other.select(F.col("n").alias(name), "a", "b"))
