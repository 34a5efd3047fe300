"""Greedy searches of a graph as rounds of joins, with the result of the sequential search.

Sequentially, the best node or edge is taken, then the next best of what is left. What is better than all that it could affect will be taken whatever
happens elsewhere, as nothing gets better by what others take: so each round takes all local best ones at once. No component is ever held
in one task. Rounds end when nothing is left; each is written to shared storage. Their number is that of the longest chain of choices that depend
on one another, small in graphs of conflicts, but as long as half the path in one whose edges are sorted along it. `small` edges or fewer
(counted) may therefore be ended in one task, with the same result; 0 never does.

Cases: edges (a, b) in either order and repeated are one, loops none; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlab.operators import graph
from permlab.operators.numbering import numbered
from permlab.sources.storage import shared_dir, staged


def plain_edges(edges: DataFrame) -> DataFrame:
    """a < b, distinct."""
    return staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")


def both_ends(edges: DataFrame) -> DataFrame:
    """u, v: every edge both ways."""
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


class _Taken:
    """Nodes taken so far, in shared storage."""

    def __init__(self, spark):
        self.spark, self.path, self.any = spark, shared_dir(spark, "taken"), False

    def add(self, nodes: DataFrame) -> None:
        nodes.select(F.col("node").cast("long").alias("node")).write.mode("append").parquet(self.path)
        self.any = True

    def all(self) -> DataFrame:
        return self.spark.read.schema("node long").parquet(self.path) if self.any else self.spark.createDataFrame([], "node long")


def _ended(rows: DataFrame, solve) -> DataFrame:
    """node: what solve(list of rows) returns, in one task."""

    def run(frames):
        import pandas as pd

        held = [tuple(r) for frame in frames for r in frame.itertuples(index=False, name=None)]
        yield pd.DataFrame({"node": pd.Series(solve(held), dtype="int64")})

    return rows.coalesce(1).mapInPandas(run, "node long")


def matching_cover(edges: DataFrame, small: int = 0) -> DataFrame:
    """node: both ends of the matching that takes edges by (a, b), each if its ends are free."""
    left, taken = plain_edges(edges), _Taken(edges.sparkSession)
    while n := left.count():
        if n <= small:
            taken.add(_ended(left.select("a", "b"), graph.matching_cover))
            break
        first = both_ends(left).groupBy("u").agg(F.min(F.struct(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).alias("e"))
        at = lambda side, first=first: first.select(F.col("u").alias(f"of_{side}"), F.col("e").alias(f"e_{side}"))
        here = left.join(at("a"), F.col("a") == F.col("of_a")).join(at("b"), F.col("b") == F.col("of_b"))
        nodes = here.where((F.col("e_a") == F.struct("a", "b")) & (F.col("e_b") == F.struct("a", "b"))).select(F.explode(F.array("a", "b")).alias("node"))
        nodes = staged(nodes, "matched")
        taken.add(nodes)
        left = staged(_without(left, nodes), "left")
    return taken.all()


def _without(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes, F.col("a") == F.col("node"), "left_anti").join(nodes, F.col("b") == F.col("node"), "left_anti")


def greedy_removal(edges: DataFrame, small: int = 0) -> DataFrame:
    """node: nodes removed until no edge is left, most edges first, ties to the node that sorted edges name first."""
    left, taken = plain_edges(edges), _Taken(edges.sparkSession)
    named = both_ends(left).groupBy("u").agg(F.min(F.struct(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), (F.col("u") > F.col("v")).alias("second"))).alias("seen"))
    turn = staged(numbered(named, [F.col("seen").asc()], "turn").select(F.col("u").alias("of"), "turn"), "turns")
    while n := left.count():
        if n <= small:
            ends = left.join(turn.withColumnRenamed("turn", "ta"), F.col("a") == F.col("of")).drop("of").join(turn.withColumnRenamed("turn", "tb"), F.col("b") == F.col("of"))
            taken.add(_ended(ends.select("a", "b", "ta", "tb"), lambda rows: graph.greedy_removal([r[:2] for r in rows], {x: t for a, b, ta, tb in rows for x, t in ((a, ta), (b, tb))})))
            break
        ends = both_ends(left)
        rank = ends.groupBy(F.col("u").alias("x")).agg(F.count("*").alias("n")).join(turn, F.col("x") == F.col("of")).select("x", F.struct((-F.col("n")).alias("n"), "turn").alias("rank"))
        rank = staged(rank, "ranks")
        best = ends.join(rank, F.col("v") == F.col("x")).groupBy("u").agg(F.min("rank").alias("best"))
        nodes = staged(best.join(rank, F.col("u") == F.col("x")).where(F.col("rank") < F.col("best")).select(F.col("u").alias("node")), "removed")
        taken.add(nodes)
        left = staged(_without(left, nodes), "left")
    return taken.all()


def dominating(edges: DataFrame, least: int = 1) -> DataFrame:
    """node: nodes taken by how many new ones they and their neighbours bring, while that is `least` or more; ties to the smallest."""
    plain, taken = plain_edges(edges), _Taken(edges.sparkSession)
    nodes = both_ends(plain).select(F.col("u").alias("x")).distinct()
    # brings: node, x: what is still new of a node and its neighbours
    brings = staged(both_ends(plain).select(F.col("u").alias("node"), F.col("v").alias("x")).unionByName(nodes.select(F.col("x").alias("node"), "x")), "brings")
    while True:
        gain = brings.groupBy(F.col("node").alias("of")).agg(F.count("*").alias("gain")).where(F.col("gain") >= least)
        rated = staged(brings.join(gain, F.col("node") == F.col("of")).select("node", "x", F.struct("gain", (-F.col("node")).alias("last")).alias("rank")), "rated")
        chosen = staged(_best_everywhere(rated), "chosen")
        if chosen.isEmpty():
            return taken.all()
        taken.add(chosen)
        seen = brings.join(chosen.select(F.col("node").alias("of")), F.col("node") == F.col("of")).select(F.col("x").alias("gone")).distinct()
        brings = staged(brings.join(seen, F.col("x") == F.col("gone"), "left_anti"), "brings")


def _best_everywhere(rated: DataFrame) -> DataFrame:
    """rated: node, x, rank. The nodes that have the highest rank at each of their x."""
    best = rated.groupBy(F.col("x").alias("at")).agg(F.max("rank").alias("best"))
    held = rated.join(best, F.col("x") == F.col("at")).groupBy("node").agg(F.min((F.col("rank") == F.col("best")).cast("int")).alias("all_best"))
    return held.where("all_best = 1").select("node")


def kings(edges: DataFrame) -> DataFrame:
    """node: nodes by their number, each if none of its neighbours is a king or next to one."""
    plain, taken = plain_edges(edges), _Taken(edges.sparkSession)
    ends = both_ends(plain)
    around = staged(ends.select(F.col("u").alias("node"), F.col("v").alias("x")).unionByName(ends.select(F.col("u").alias("node"), F.col("u").alias("x")).distinct()), "around")
    while True:
        chosen = staged(_best_everywhere(around.select("node", "x", (-F.col("node")).alias("rank"))), "kings")
        if chosen.isEmpty():
            return taken.all()
        taken.add(chosen)
        covered = around.join(chosen.select(F.col("node").alias("of")), F.col("node") == F.col("of")).select(F.col("x").alias("at")).distinct()
        out = around.join(covered, F.col("x") == F.col("at")).select(F.col("node").alias("of")).distinct()
        around = staged(around.join(out, F.col("node") == F.col("of"), "left_anti"), "around")


def cleaned(array: DataFrame, edges: DataFrame, small: int = graph.SMALL) -> DataFrame:
    """The rows that greedy removal leaves."""
    return array.join(greedy_removal(edges, small), F.col("row_id") == F.col("node"), "left_anti")
