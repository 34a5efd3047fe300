"""Tables of combinations, permutations, templates and arrays. Sizes depend on n and d alone, never on data.

Generators grow by one choice a step, so that tests prune as early as they can. What a step joins with is a
constant of at most n rows.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permlab.functions import columns as C
from permlab.operators import numbering


def combinations(spark: SparkSession, n: int, k: int) -> DataFrame:
    """id, ps: all k-subsets of 0 .. n - 1 in lexicographic order of their positions."""
    bits = F.expr(f"filter(sequence(0, {n - 1}), i -> (shiftright(mask, i) & 1) = 1)") if n else F.array().cast("array<int>")
    rows = spark.range(1 << n).withColumnRenamed("id", "mask").where(F.bit_count("mask") == k).select(bits.alias("ps"))
    return numbered(rows, "ps", "id")


def combinations_by_mask(spark: SparkSession, n: int, k: int) -> DataFrame:
    """id, ps in colexicographic order."""
    bits = F.expr(f"filter(sequence(0, {n - 1}), i -> (shiftright(mask, i) & 1) = 1)")
    rows = spark.range(1 << n).withColumnRenamed("id", "mask").where(F.bit_count("mask") == k).select("mask", bits.alias("ps"))
    return numbered(rows, "mask", "id").select("id", "ps")


def combination_at(number, n: int, k: int, order: str = "revolving") -> Column:
    """The k-subset of 0 .. n - 1 with this number, by the combinatorial number system.

    In `revolving` order neighbours (the last and the first too) differ by one exchange; `mask` is colexicographic. For every element, from the largest, the
    most subsets of smaller ones that fit into the number tell which it is.
    """
    if k == 0:
        return F.array().cast("array<int>")
    below = F.array(*[F.array(*[F.lit(comb(x, i)).cast("long") for x in range(n + 1)]) for i in range(k + 1)])

    def step(held, i):
        row = F.get(below, i)
        x = C.count(row, lambda c: c <= held["left"]) - 1
        rest = F.get(row, x + 1) - held["left"] - 1 if order == "revolving" else held["left"] - F.get(row, x)
        return F.struct(rest.alias("left"), F.concat(F.array(x.cast("int")), held["out"]).alias("out"))

    start = F.struct(number.cast("long").alias("left"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(F.sequence(F.lit(k), F.lit(1), F.lit(-1)), start, step, lambda held: held["out"])


def combinations_in(spark: SparkSession, n: int, k: int, order: str = "revolving", first: int = 0, many: int | None = None) -> DataFrame:
    """id, ps: any slice of the k-subsets in the order, each from its number alone: nothing grows and nothing is sorted."""
    total = comb(n, k)
    end = total if many is None else min(total, first + many)
    return spark.range(min(first, end), end).select("id", combination_at(F.col("id"), n, k, order).alias("ps"))


def numbered(rows: DataFrame, order: str, name: str = "row_id") -> DataFrame:
    """With dense numbers in an order, first."""
    return numbering.numbered(rows, [F.col(order).asc()], name).select(name, *rows.columns)


def complementary_pairs(spark: SparkSession, n: int) -> DataFrame:
    """ps, other: one of each pair of complementary n/2-subsets, that which holds 0."""
    rows = combinations(spark, n, n // 2).where(F.array_contains("ps", 0))
    return rows.select("ps", F.array_except(C.indices(n), "ps").alias("other"))


def weave_complementary(array: DataFrame, n: int, d: int) -> DataFrame:
    """Rows woven with the d highest symbols at one of each pair of complementary position sets, in the first order in which the row is d
    apart from its own complement; where no order is, there is no row. n is twice d."""
    spark = array.sparkSession
    orders = permutations(spark, d).select(F.transform("u", lambda x: x + n - d).alias("highs"))
    rows = array.select(F.col("row_id").alias("old"), "u").crossJoin(F.broadcast(complementary_pairs(spark, n).select("ps"))).crossJoin(F.broadcast(orders))  # constants of n and d
    rows = rows.select("ps", "old", "highs", C.infill("u", F.col("highs"), "ps").alias("u")).where(C.separated("u", C.complement("u", n), d))
    rows = rows.groupBy("ps", "old").agg(F.min_by("u", "highs").alias("u"))
    return numbered(rows.select(F.struct("ps", "old").alias("at"), "u"), "at").select("row_id", "u")


def permutations(spark: SparkSession, n: int, m: int | None = None, keep=None) -> DataFrame:
    """u: all sequences of n of m symbols without repeats; `keep(u, length)` prunes prefixes."""
    m = n if m is None else m
    rows = spark.range(1).select(F.array().cast("array<int>").alias("u"))
    for length in range(1, n + 1):
        rows = rows.select(F.explode(F.transform(F.array_except(C.indices(m), "u"), lambda x: F.concat(F.col("u"), F.array(x)))).alias("u"))
        if keep is not None:
            rows = rows.where(keep(F.col("u"), length))
        if length == 3:
            rows = rows.repartition("u")  # the steps after it run in parallel
    return rows


def product(spark: SparkSession, choices: list[list]) -> DataFrame:
    """u: one of each list of choices, in all ways."""
    rows = spark.range(1).select(F.array().cast("array<string>").alias("u"))
    for options in choices:
        rows = rows.select(F.explode(F.array(*[F.concat("u", F.array(F.lit(str(x)))) for x in options])).alias("u"))
    return rows


def weave_high(array: DataFrame, n: int, d: int, order=None) -> DataFrame:
    """row_id, u: every row with the symbols n - d .. n - 1 put at every d positions; combinations outermost."""
    highs = F.transform(C.indices(d), lambda i: (i + n - d).cast("int")) if order is None else order
    ps = combinations(array.sparkSession, n, d)
    rows = array.withColumnRenamed("row_id", "old").crossJoin(F.broadcast(ps))  # C(n, d) rows, a constant
    return numbered(rows.select(F.struct("id", "old").alias("at"), C.infill("u", highs, "ps").alias("u")), "at").select("row_id", "u")


def weave_low(array: DataFrame, n: int, d: int) -> DataFrame:
    """row_id, u: symbols 0 .. d - 1 put at every d positions, the old ones raised by d."""
    ps = combinations(array.sparkSession, n, d)
    raised = F.transform("u", lambda x: (x + d).cast("int"))
    rows = array.withColumnRenamed("row_id", "old").crossJoin(F.broadcast(ps))
    return numbered(rows.select(F.struct("id", "old").alias("at"), C.infill(raised, C.indices(d), "ps").alias("u")), "at").select("row_id", "u")


def weave_ends(array: DataFrame, n: int) -> DataFrame:
    """row_id, u: 0 and n - 1 put at every two positions i < j, in both roles' order 0 first, old symbols raised by one."""
    ps = combinations(array.sparkSession, n, 2)
    raised = F.transform("u", lambda x: (x + 1).cast("int"))
    rows = array.withColumnRenamed("row_id", "old").crossJoin(F.broadcast(ps))
    return numbered(rows.select(F.struct("id", "old").alias("at"), C.infill(raised, C.ints(0, n - 1), "ps").alias("u")), "at").select("row_id", "u")


def weave_once(array: DataFrame, n: int, d: int, image) -> DataFrame:
    """weave_high() with one row for each class of templates that the image maps onto each other."""
    rows = weave_high(array, n, d)
    key = F.least(C.text(C.groups("u", d)), C.text(C.groups(image(F.col("u")), d)))
    first = W.partitionBy("key").orderBy("row_id")
    return rows.withColumn("key", key).withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row_id", "u")


def weave_orbits(array: DataFrame, n: int, d: int, k: int = 3) -> DataFrame:
    """weave_high() over one of each orbit of position sets under rotation by k, each with its orbit's least set."""
    ps = combinations(array.sparkSession, n, d)
    turned, p = [], F.col("ps")
    for _ in range(n):
        turned.append(p)
        p = C.rotate_positions(p, n, k)
    reps = ps.where(F.col("ps") == F.least(*turned))
    highs = F.transform(C.indices(d), lambda i: (i + n - d).cast("int"))
    rows = array.withColumnRenamed("row_id", "old").crossJoin(F.broadcast(reps))
    return numbered(rows.select(F.struct("id", "old").alias("at"), C.infill("u", highs, "ps").alias("u")), "at").select("row_id", "u")


def ascending_array(spark: SparkSession, n: int, d: int) -> DataFrame:
    """row_id, u: for each d positions the high symbols in ascending order there and the low ones elsewhere."""
    base = spark.range(1).select(F.col("id").alias("row_id"), C.indices(n - d).alias("u"))
    return weave_high(base, n, d)


def lexicographic_array(spark: SparkSession, n: int) -> DataFrame:
    """row_id, u: lows 0 .. n/2 - 1 in order at every n/2 positions, highs in order elsewhere."""
    d = n // 2
    rows = combinations(spark, n, d).select(F.col("id").alias("row_id"), "ps")
    return rows.select("row_id", C.infill(F.transform(C.indices(n - d), lambda x: (x + d).cast("int")), C.indices(d), "ps").alias("u"))


def templates(spark: SparkSession, n: int, d: int) -> DataFrame:
    """row_id, t: all arrangements of the groups of 0 .. n - 1, in lexicographic order."""
    rows = spark.range(1).select(F.array().cast("array<int>").alias("t"))
    sizes = [min(d, n - g * d) for g in range(-(-n // d))]
    for _ in range(n):
        fits = [F.when(C.count(F.col("t"), _equals(g)) < size, F.concat("t", C.ints(g))) for g, size in enumerate(sizes)]
        rows = rows.select(F.explode(F.array_compact(F.array(*fits))).alias("t"))
    return numbered(rows, "t")


def _equals(g: int):
    return lambda x: x == g


def infills(spark: SparkSession, t: list[int], d: int) -> DataFrame:
    """u: all permutations with the template t."""
    rows = spark.range(1).select(F.array().cast("array<int>").alias("u"))
    n = len(t)
    for g in t:
        own = F.array(*[F.lit(x) for x in range(g * d, min((g + 1) * d, n))])
        rows = rows.select(F.explode(F.transform(F.array_except(own, "u"), lambda x: F.concat(F.col("u"), F.array(x)))).alias("u"))
    return rows


def fill_pattern(spark: SparkSession, pattern: list[int], t: list[int], d: int) -> DataFrame:
    """u: the pattern with every -1 replaced by each symbol of the position's group; repeats are allowed."""
    rows = spark.range(1).select(F.array().cast("array<int>").alias("u"))
    for x, g in zip(pattern, t, strict=True):
        options = [x] if x >= 0 else list(range(g * d, (g + 1) * d))
        rows = rows.select(F.explode(F.array(*[F.concat("u", C.ints(o)) for o in options])).alias("u"))
    return rows


def other_fillings(spark: SparkSession, u: list[int], d: int) -> DataFrame:
    """u: all rearrangements of a row within its groups, but for itself."""
    return infills(spark, [x // d for x in u], d).where(F.col("u") != C.ints(*u))


def same_low_order(spark: SparkSession, n: int, base: list[int]) -> DataFrame:
    """row_id, u: at every choice of len(base) positions these symbols in the same order, other positions unbound (-1)."""
    rows = combinations(spark, n, len(base)).select(F.col("id").alias("row_id"), "ps")
    return rows.select("row_id", C.overwrite(F.array_repeat(F.lit(-1), n), "ps", C.ints(*base)).alias("u"))


def random_array(spark: SparkSession, n: int, size: int, seed: int) -> DataFrame:
    """row_id, u: pseudo-random permutations, the same for a seed."""
    key = lambda i: F.xxhash64(F.lit(seed), F.col("id"), i)
    return spark.range(size).select(F.col("id").alias("row_id"), F.transform(F.array_sort(F.transform(C.indices(n), lambda i: F.struct(key(i).alias("k"), i.alias("i")))), lambda s: s["i"]).alias("u"))


def missing_templates(array: DataFrame, n: int, d: int) -> DataFrame:
    """t, u: templates that no row has, filled in ascending order."""
    have = array.select(C.groups("u", d).alias("t")).distinct()
    return templates(array.sparkSession, n, d).join(have, "t", "left_anti").select("t", C.quick_fill("t", d).alias("u"))


def complete_templates(array: DataFrame, n: int, d: int) -> DataFrame:
    """row_id, u: for every template the row that has it (the first), or its ascending filling."""
    have = array.groupBy(C.groups("u", d).alias("t")).agg(F.min_by("u", "row_id").alias("own"))
    return templates(array.sparkSession, n, d).join(have, "t", "left").select("row_id", F.coalesce("own", C.quick_fill("t", d)).alias("u"))


def near_identity(spark: SparkSession, n: int, d: int | None = None) -> DataFrame:
    """u: permutations within d - 1 of the identity in every column but not with its template; pruned prefix by prefix."""
    d = n // 2 if d is None else d
    close = lambda u, length: F.abs(F.element_at(u, -1) - (length - 1)) < d
    return permutations(spark, n, keep=close).where(~C.in_identity_block("u", d))


def admissible_ends(spark: SparkSession, pre: int, suf: int, symbols: int) -> DataFrame:
    """pre, suf: all choices of distinct symbols for a prefix and a suffix."""
    rows = permutations(spark, pre + suf, symbols)
    return rows.select(F.slice("u", 1, pre).alias("pre"), F.slice("u", pre + 1, suf).alias("suf"))


def constructible(array: DataFrame, d: int) -> DataFrame:
    """mid: relabellings of an array's symbols, as permutations, that leave all its rows d apart."""
    n = len(array.select("u").first()["u"])
    spark = array.sparkSession
    pairs = array.alias("a").join(array.alias("b"), F.col("a.row_id") < F.col("b.row_id")).select(F.col("a.u").alias("x"), F.col("b.u").alias("y"))
    mids = permutations(spark, n).withColumnRenamed("u", "mid")
    bad = mids.join(F.broadcast(pairs), ~C.separated(C.rename("x", "mid"), C.rename("y", "mid"), d), "left_anti")  # pairs of one small array
    return bad


def expected_templates(n: int, d: int) -> int:
    out, rest = 1, n
    for g in range(-(-n // d)):
        size = min(d, n - g * d)
        out *= comb(rest, size)
        rest -= size
    return out


def assemble(array: DataFrame, prefix: list[int], suffix: list[int], shift: int) -> DataFrame:
    """Rows of a smaller array, raised by shift, between a fixed prefix and suffix."""
    return array.select("row_id", F.concat(C.ints(*prefix) if prefix else F.array().cast("array<int>"), F.transform("u", lambda x: (x + shift).cast("int")), C.ints(*suffix) if suffix else F.array().cast("array<int>")).alias("u"))


def column_arrangements(blocks: DataFrame, order: Column) -> DataFrame:
    """Blocks (block_id, row_id, u) with their columns in another order."""
    return blocks.withColumn("u", F.transform(order, lambda i: F.get(F.col("u"), i)))


def block_arrangements(blocks: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """block_id, ps: blocks and column orders under which a block has all wanted rows (u)."""
    orders = permutations(blocks.sparkSession, width).withColumnRenamed("u", "ps")
    need = wanted.select("u").distinct()
    rows = blocks.crossJoin(F.broadcast(orders)).withColumn("v", F.transform("ps", lambda i: F.get(F.col("u"), i)))  # width! orders, a constant
    hits = rows.join(need.withColumnRenamed("u", "v"), "v", "left_semi").groupBy("block_id", "ps").agg(F.countDistinct("v").alias("n"))
    return hits.where(F.col("n") == need.count()).select("block_id", "ps")
