"""One option for each slot of many puzzles at once: branch and bound by levels, spread over all tasks.

slots: puzzle, slot, option, u. A state is the options taken so far in the order of slots (path), their rows and what they are worth. Each level joins the states of
a puzzle with the options of its next slot; rows must be d apart from those taken. A state's bound is its worth, plus for each slot to come the most
that one of its options adds with the rows taken, plus the most that slots to come add among themselves. Before the levels, a dive keeps the
best bound of each puzzle alone; what it reaches is the first incumbent, known to all tasks, and states below it are cut. Each level ends with
another dive from its best states that raises the incumbents.

Options of equal worth: the first path in order wins; with `skip`, a slot may stay empty (option SKIPPED, after all others), and a filled one is worth 1 more.

Cases: a puzzle whose slots can't be filled has no result; slots need not be numbered densely; equal options are options of their own; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permlab.functions import columns as C
from permlab.sources.storage import staged

SKIPPED = 1 << 30


def _start(slots: DataFrame) -> DataFrame:
    return slots.select("puzzle").distinct().select("puzzle", F.array().cast("array<int>").alias("path"), F.array().cast("array<array<int>>").alias("rows"), F.lit(0).cast("long").alias("worth"))


def _with(rows, u, value: Callable[[Column, Column], Column] | None) -> Column:
    """What a row adds with those taken; skipped ones are null."""
    if value is None:
        return F.lit(0).cast("long")
    return F.aggregate(F.filter(rows, lambda r: r.isNotNull()), F.lit(0).cast("long"), lambda acc, r: acc + value(r, u).cast("long"))


def _grown(states: DataFrame, slots: DataFrame, k: int, d: int, value, skip: bool) -> DataFrame:
    """The states of the puzzles that have a slot k, one slot further."""
    here = slots.where(F.col("nth") == k).select(F.col("puzzle").alias("of"), "option", "u")
    more = states.join(here, F.col("puzzle") == F.col("of"))
    more = more.where(F.forall(F.filter("rows", lambda r: r.isNotNull()), lambda r: C.separated(r, F.col("u"), d)))
    out = more.select("puzzle", F.concat("path", F.array(F.col("option").cast("int"))).alias("path"), F.concat("rows", F.array("u")).alias("rows"), (F.col("worth") + _with("rows", F.col("u"), value) + int(skip)).alias("worth"))
    if skip:
        empty = states.join(here.select("of").distinct(), F.col("puzzle") == F.col("of"), "left_semi")
        out = out.unionByName(empty.select("puzzle", F.concat("path", F.array(F.lit(SKIPPED))).alias("path"), F.concat("rows", F.array(F.lit(None).cast("array<int>"))).alias("rows"), "worth"))
    return out


def _bounded(states: DataFrame, slots: DataFrame, among: DataFrame, k: int, value, skip: bool) -> DataFrame:
    """With `bound`: no way to go on is worth more. k: slots taken."""
    if value is None:
        rest = among.where(F.col("after") == k).select(F.col("puzzle").alias("of"), (F.col("slots") * int(skip)).alias("rest"))
        return states.join(rest, F.col("puzzle") == F.col("of")).select("puzzle", "path", "rows", "worth", (F.col("worth") + F.col("rest")).alias("bound"))
    left = slots.where(F.col("nth") >= k).select(F.col("puzzle").alias("of"), "nth", "u")
    adds = states.join(left, F.col("puzzle") == F.col("of")).groupBy("puzzle", "path", "nth").agg(F.max(_with("rows", F.col("u"), value)).alias("adds"))
    adds = adds.groupBy(F.col("puzzle").alias("p"), F.col("path").alias("way")).agg(F.sum(F.greatest("adds", F.lit(0)) if skip else F.col("adds")).alias("adds"))
    rest = among.where(F.col("after") == k).select(F.col("puzzle").alias("of"), (F.col("most") + F.col("slots") * int(skip)).alias("rest"))
    found = states.join(adds, (F.col("puzzle") == F.col("p")) & (F.col("path") == F.col("way")), "left").join(rest, F.col("puzzle") == F.col("of"))
    return found.select("puzzle", "path", "rows", "worth", (F.col("worth") + F.coalesce("adds", F.lit(0)) + F.col("rest")).alias("bound"))


def _among(slots: DataFrame, value, skip: bool) -> DataFrame:
    """puzzle, after, slots, most: for the slots from number `after` on how many they are, and the most that they add among themselves."""
    sizes = slots.groupBy("puzzle").agg((F.max("nth") + 1).alias("k"))
    marks = sizes.select("puzzle", "k", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("after"))
    if value is None:
        return marks.select("puzzle", "after", (F.col("k") - F.col("after")).alias("slots"), F.lit(0).cast("long").alias("most"))
    one, other = slots.select("puzzle", "nth", "u"), slots.select(F.col("puzzle").alias("p"), F.col("nth").alias("m"), F.col("u").alias("v"))
    pairs = one.join(other, (F.col("puzzle") == F.col("p")) & (F.col("nth") < F.col("m"))).groupBy("puzzle", "nth", "m").agg(F.max(value(F.col("u"), F.col("v"))).cast("long").alias("most"))
    pairs = pairs.select(F.col("puzzle").alias("p"), "nth", (F.greatest("most", F.lit(0)) if skip else F.col("most")).alias("most"))
    held = marks.join(pairs, (F.col("puzzle") == F.col("p")) & (F.col("nth") >= F.col("after")), "left").groupBy("puzzle", "after", "k").agg(F.coalesce(F.sum("most"), F.lit(0)).alias("most"))
    return held.select("puzzle", "after", (F.col("k") - F.col("after")).alias("slots"), "most")


def best_choices(slots: DataFrame, d: int, value: Callable[[Column, Column], Column] | None = None, skip: bool = False) -> tuple[DataFrame, DataFrame]:
    """The best state of each puzzle (puzzle, path, rows, worth), and how many states were opened at each level (level, opened, cut).

    value(u, v): what two rows are worth together, a whole number; without one all are worth nothing, and the first way in order is found.
    """
    spark = slots.sparkSession
    turn = F.dense_rank().over(W.partitionBy("puzzle").orderBy("slot")) - 1  # the slots of one puzzle
    slots = staged(slots.select("puzzle", "option", "u", turn.alias("nth")), "slots")
    levels = (slots.agg(F.max("nth")).first()[0] or 0) + 1
    among = staged(_among(slots, value, skip), "among")
    whole = among.where("after = 0").select(F.col("puzzle").alias("of"), F.col("slots").alias("k"))

    def dive(states: DataFrame, k: int) -> DataFrame:
        """of, least: what the best bound of each puzzle leads to, from level k on."""
        for j in range(k, levels):
            ended = states.join(whole, F.col("puzzle") == F.col("of")).where(F.col("k") <= j).select("puzzle", "path", "rows", "worth")
            best = _bounded(_grown(states, slots, j, d, value, skip), slots, among, j + 1, value, skip).groupBy("puzzle").agg(F.max_by(F.struct("path", "rows", "worth"), F.struct("bound", "worth")).alias("s"))
            states = staged(ended.unionByName(best.select("puzzle", "s.*")), "dive")
        return states.groupBy(F.col("puzzle").alias("of")).agg(F.max("worth").alias("least"))

    states, log = _start(slots), []
    least = staged(dive(states, 0), "incumbents")
    out = None
    for k in range(levels):
        ended = states.join(whole, F.col("puzzle") == F.col("of")).where(F.col("k") <= k).select("puzzle", "path", "rows", "worth")
        out = ended if out is None else out.unionByName(ended)
        grown = staged(_bounded(_grown(states, slots, k, d, value, skip), slots, among, k + 1, value, skip), "states")
        kept = staged(grown.join(least, F.col("puzzle") == F.col("of"), "left").where("least IS NULL OR bound >= least").select("puzzle", "path", "rows", "worth", "bound"), "kept")
        opened, left = grown.count(), kept.count()
        log.append((k, opened, opened - left))
        states = kept.select("puzzle", "path", "rows", "worth")
        if k + 1 < levels and k % 2:
            best = kept.groupBy("puzzle").agg(F.max_by(F.struct("path", "rows", "worth"), F.struct("bound", "worth")).alias("s")).select("puzzle", "s.*")
            least = staged(least.unionByName(dive(best, k + 1)).groupBy("of").agg(F.max("least").alias("least")), "incumbents")
    out = states if out is None else out.unionByName(states)
    chosen = out.groupBy("puzzle").agg(F.max("worth").alias("w"))
    first = out.join(chosen.withColumnRenamed("puzzle", "of"), (F.col("puzzle") == F.col("of")) & (F.col("worth") == F.col("w"))).groupBy("puzzle").agg(F.min_by(F.struct("path", "rows", "worth"), "path").alias("s"))
    return first.select("puzzle", "s.*"), spark.createDataFrame(log, "level int, opened long, cut long")
