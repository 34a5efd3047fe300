"""Fillings that are apart from as many rows as can be, through an index of what each symbol covers.

A filling of a row keeps the group of each symbol. Put at a column, a symbol covers the rows that it is d apart from there. Rows that are covered by the same
(column, symbol) pairs are one class with a weight: a combined aggregate, so a row to be filled has few classes however many rows it
conflicts with. Each row to be filled is a search of its own in one task, over its classes: columns are set one after another, those that
cover most first, and a branch ends when its cover and all that later columns could cover weigh less than the best so far. Where later columns add
nothing, all their fillings count at once: nothing is enumerated.

Cases: rows against which nothing stands are covered by every filling; fillings need not be permutations, and the last group is taken as whole; rows of other lengths
are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classes(rows: DataFrame, against: DataFrame, d: int) -> DataFrame:
    """rows: row_id, u; against: row_id, v. row_id, u, covers (for each column, and each symbol of its group, 1 if it is d apart from v), weight."""
    own = rows.select(F.col("row_id").alias("of"), "u")
    both = own.join(against, F.col("of") == F.col("row_id")).where(F.size("u") == F.size("v"))
    cell = lambda x, y: F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: (F.abs(F.floor(x / d) * d + i - y) >= d).cast("int"))
    covers = F.flatten(F.zip_with("u", "v", cell))
    return both.select("row_id", "u", F.array_join(covers, "").alias("covers")).groupBy("row_id", "u", "covers").agg(F.count("*").alias("weight"))


def best_cover(u: list[int], held: list[tuple[str, int]], d: int) -> tuple[int, int, list[int]]:
    """The most weight that a filling covers, how many fillings do, and the least of them. held: covers and weight of each class."""
    n = len(u)
    weights = [w for _, w in held]
    mask = [[sum(1 << k for k, (c, _) in enumerate(held) if c[col * d + x] == "1") for x in range(d)] for col in range(n)]
    weight = lambda m: sum(w for k, w in enumerate(weights) if m >> k & 1)
    union = lambda ms: reduce(int.__or__, ms, 0)
    order = sorted(range(n), key=lambda c: (-weight(union(mask[c])), c))
    rest = [union(m for c in order[i:] for m in mask[c]) for i in range(n + 1)]
    best, many, least = -1, 0, None

    def search(i: int, covered: int, chosen: dict[int, int]):
        nonlocal best, many, least
        bound = weight(covered | rest[i])
        if bound < best:
            return
        if not rest[i] & ~covered:  # what is left changes nothing
            way = [u[c] // d * d + chosen.get(c, 0) for c in range(n)]
            if bound > best:
                best, many, least = bound, 0, None
            many += d ** (n - i)
            least = way if least is None else min(least, way)
            return
        c = order[i]
        for x in sorted(range(d), key=lambda x: (-weight(mask[c][x] & ~covered), x)):
            search(i + 1, covered | mask[c][x], chosen | {c: x})

    search(0, 0, {})
    return best, many, least


def fullest(rows: DataFrame, against: DataFrame, d: int) -> DataFrame:
    """row_id, covered (rows of `against` that the best fillings are apart from), n_fillings, first (the least of these fillings); rows that nothing stands against are left out."""

    def solve(frame):
        import pandas as pd

        found = best_cover([int(x) for x in frame["u"].iloc[0]], list(zip(frame["covers"], frame["weight"].tolist(), strict=True)), d)
        return pd.DataFrame({"row_id": [frame["row_id"].iloc[0]], "covered": [found[0]], "n_fillings": [found[1]], "first": [found[2]]})

    return classes(rows, against, d).groupBy("row_id").applyInPandas(solve, "row_id long, covered long, n_fillings long, first array<int>")
