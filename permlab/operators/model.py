"""The integer model of an array as relations, and a checker of assignments. Solving it is left to solvers.

A variable says that a cell holds a symbol. constraint: (model, id, kind, one, other, sense, bound); term: (model, id, coefficient, and the variable row, col,
sym; in products also row2, col2, sym2). Kinds:

* `cell`: each cell (one: row, other: column) holds one symbol;
* `symbol`: each row (one) has each symbol (other) once;
* `group`: each cell holds one symbol of its group;
* `apart`: rows one < other have symbols d apart in some column: a sum of products is at least 1.

Cases: rows of a model may differ in length, then only the columns that both have count; an empty grid has no constraints; an assignment without some
of the cells breaks their constraints, and cells beyond the grid take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VARIABLE = ["row", "col", "sym"]


def _cells(grid: DataFrame) -> DataFrame:
    return grid.select("model", "row", F.size("t").alias("n"), F.posexplode("t").alias("col", "g"))


def terms(grid: DataFrame, d: int) -> DataFrame:
    """grid: model, row, t (the group of each cell). All terms of all constraints."""
    cells = _cells(grid)
    every = cells.withColumn("sym", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def linear(kind: str, other: str, rows: DataFrame) -> DataFrame:
        none = [F.lit(None).cast("int").alias(f"{c}2") for c in _VARIABLE]
        return rows.select("model", F.lit(kind).alias("kind"), F.col("row").alias("one"), F.col(other).alias("other"), F.lit(1).alias("coefficient"), *_VARIABLE, *none)

    own = every.where(F.floor(F.col("sym") / d) == F.col("g"))
    out = linear("cell", "col", every).unionByName(linear("symbol", "sym", every)).unionByName(linear("group", "col", own))
    # products of the variables of two rows: the pairs of rows of a model are what is asked for
    u = every.select("model", "col", "row", "sym")
    v = every.select(F.col("model").alias("m2"), F.col("col").alias("col2"), F.col("row").alias("row2"), F.col("sym").alias("sym2"))
    both = u.join(v, (F.col("model") == F.col("m2")) & (F.col("col") == F.col("col2")) & (F.col("row") < F.col("row2")) & (F.abs(F.col("sym") - F.col("sym2")) >= d))
    pairs = both.select("model", F.lit("apart").alias("kind"), F.col("row").alias("one"), F.col("row2").alias("other"), F.lit(1).alias("coefficient"), *_VARIABLE, *[f"{c}2" for c in _VARIABLE])
    return out.unionByName(pairs).withColumn("id", F.concat_ws(":", "kind", "one", "other"))


def constraints(grid: DataFrame) -> DataFrame:
    """model, id, kind, one, other, sense, bound."""
    cells = _cells(grid)
    cell = cells.select("model", F.explode(F.array(F.lit("cell"), F.lit("group"))).alias("kind"), F.col("row").alias("one"), F.col("col").alias("other"))
    symbol = cells.select("model", F.lit("symbol").alias("kind"), F.col("row").alias("one"), F.col("col").alias("other"))  # as many symbols as columns
    rows = grid.select("model", "row")
    pairs = rows.join(rows.select(F.col("model").alias("m2"), F.col("row").alias("row2")), (F.col("model") == F.col("m2")) & (F.col("row") < F.col("row2")))
    pairs = pairs.select("model", F.lit("apart").alias("kind"), F.col("row").alias("one"), F.col("row2").alias("other"))
    every = cell.unionByName(symbol).unionByName(pairs)
    sense = F.when(F.col("kind") == "apart", ">=").otherwise("=")
    return every.select("model", F.concat_ws(":", "kind", "one", "other").alias("id"), "kind", "one", "other", sense.alias("sense"), F.lit(1).alias("bound"))


def broken(model_terms: DataFrame, model_constraints: DataFrame, assignment: DataFrame) -> DataFrame:
    """assignment: model, row, u. model, kind, one, other, value of every constraint that doesn't hold."""
    true = assignment.select("model", "row", F.posexplode("u").alias("col", "sym")).distinct()
    one = true.select(*[F.col(c).alias(f"{c}_x") for c in ("model", *_VARIABLE)])
    two = true.select(*[F.col(c).alias(f"{c}_y") for c in ("model", *_VARIABLE)])
    held = model_terms.join(one, (F.col("model") == F.col("model_x")) & (F.col("row") == F.col("row_x")) & (F.col("col") == F.col("col_x")) & (F.col("sym") == F.col("sym_x")))
    linear = held.where("row2 IS NULL").select("model", "id", "coefficient")
    product = held.where("row2 IS NOT NULL").join(two, (F.col("model") == F.col("model_y")) & (F.col("row2") == F.col("row_y")) & (F.col("col2") == F.col("col_y")) & (F.col("sym2") == F.col("sym_y"))).select("model", "id", "coefficient")
    values = linear.unionByName(product).groupBy(F.col("model").alias("m"), F.col("id").alias("i")).agg(F.sum("coefficient").alias("sum"))
    found = model_constraints.join(values, (F.col("model") == F.col("m")) & (F.col("id") == F.col("i")), "left").withColumn("value", F.coalesce("sum", F.lit(0)).cast("long"))
    holds = F.when(F.col("sense") == ">=", F.col("value") >= F.col("bound")).when(F.col("sense") == "<=", F.col("value") <= F.col("bound")).otherwise(F.col("value") == F.col("bound"))
    return found.where(~holds).select("model", "kind", "one", "other", "value")
