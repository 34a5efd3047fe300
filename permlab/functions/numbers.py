"""Figures that need more digits than DECIMAL(38) has; exact integers and decimals in Python."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

from pyspark.sql import DataFrame, SparkSession


def lower_bound(n: int, k: int, digits: int = 1000) -> Decimal:
    """A bound of P(n, n - 2k + 1): (c - 1) / 2e, to four places.

    c is the number of ways to place k low and k high symbols over that of the ways that meet a fixed placement
    in i of its low and t of its high places, summed over all i and t; the others come from the n - 2k free places.
    """
    with localcontext() as c:
        c.prec = digits
        free = n - 2 * k
        ways = math.comb(n, k) * math.comb(n - k, k)
        meeting = sum(math.comb(k, i) * math.comb(k, t) * math.comb(free, k - i) * math.comb(free - (k - i), k - t) for i in range(k + 1) for t in range(k + 1) if free >= k - i)
        e, term, i = Decimal(0), Decimal(1), 0
        while term > Decimal(10) ** -digits:
            e += term
            i += 1
            term /= i
        return ((Decimal(ways) / meeting - 1) / (2 * e)).quantize(Decimal("0.0001"), ROUND_HALF_EVEN)


def bound_table(spark: SparkSession, grid: list[tuple[int, int]] | None = None) -> DataFrame:
    """k, n, d, bound (double) over a grid of (n, k), one small task for each pair."""
    grid = grid or [(n, n // 4) for n in range(20, 501, 10)]

    def rows(frames):
        for frame in frames:
            frame["d"] = frame["n"] - 2 * frame["k"] + 1
            frame["bound"] = [float(lower_bound(int(n), int(k))) for n, k in zip(frame["n"], frame["k"], strict=True)]
            yield frame[["k", "n", "d", "bound"]]

    return spark.createDataFrame(grid, "n int, k int").repartition(len(grid)).mapInPandas(rows, "k int, n int, d int, bound double")


def coverage_score(degrees: list[int]) -> int:
    """Sum of degrees less 2 ** (rows without conflict); whole, however large."""
    return coverage_of(sum(degrees), sum(x == 0 for x in degrees))


def coverage_of(total: int, clean: int) -> int:
    """The same from the sum and the number of rows without conflict."""
    return total - (1 << clean)
