"""Searches of many small arrays of one table, a block each: blocks are dealt over tasks, and no array meets another.

rows: block, row_id, u. What a task holds is one block; its size is the caller's choice and not that of the table. Results depend on the block and the
seed alone. Each function returns block, row_id, u and perhaps more.

Cases: a block of one row is returned as it is; repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlab.functions import columns as C
from permlab.operators import search

_FOUND = "block long, row_id long, u array<int>, score long"


def each_block(rows: DataFrame, solve, schema: str = _FOUND) -> DataFrame:
    """solve(ids, rows as a matrix) gives columns of the result, without the block."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("row_id", kind="stable")
        found = solve(frame["row_id"].tolist(), np.array([list(u) for u in frame["u"]], np.int64))
        return pd.DataFrame({"block": frame["block"].iloc[0], **found})[names] if len(next(iter(found.values()))) else pd.DataFrame(columns=names)

    return rows.select("block", "row_id", "u").groupBy("block").applyInPandas(run, schema)


def _scored(ids: list[int], rows, d: int, **options) -> dict:
    rows = np.array(rows, np.int64)
    return {"row_id": ids, "u": rows.tolist(), "score": int(search.conflict_matrix(rows, d, **options).sum())}


def climbed(rows: DataFrame, d: int, seed: int = 1, **options) -> DataFrame:
    """By search.climb(), or with kind="disturb" by disturb()."""
    go = {"climb": search.climb, "disturb": search.disturb}[options.pop("kind", "climb")]
    same = {"image": search.IMAGES[options.get("image")], "masked": options.get("masked", False)}
    return each_block(rows, lambda ids, m: _scored(ids, go(m, d, seed, **options)[0], d, **same))


def tournaments(rows: DataFrame, d: int, seed: int = 1, **options) -> DataFrame:
    return each_block(rows, lambda ids, m: _scored(ids, search.tournament(m, d, seed, **options), d))


def kept_greedily(rows: DataFrame, d: int, complementing: bool = False) -> DataFrame:
    """Each row, in order, that is d apart from all kept ones. With complementing, a row that doesn't fit is tried once more against the complements
    of all that is kept, which then replace them; score is the number of times that this was done."""

    def solve(ids, m):
        kept, names, turned = np.zeros((0, m.shape[1]), np.int64), [], 0
        for i, u in zip(ids, m, strict=True):
            for turn in (False, True) if complementing and len(kept) else (False,):
                held = m.shape[1] - 1 - kept if turn else kept
                if not len(held) or (np.abs(held - u).max(1) >= d).all():
                    kept, turned = np.vstack([held, u]), turned + turn
                    names.append(i)
                    break
        return {"row_id": names, "u": kept.tolist(), "score": turned}

    return each_block(rows, solve)


def incremented(rows: DataFrame, d: int, seed: int = 1, steps: int = 100) -> DataFrame:
    """What is kept greedily, then the other rows one by one, each followed by a repair and left out if it can't be repaired. Rows are numbered anew."""

    def solve(ids, m):
        kept = np.array(search.greedy_keep(m.tolist(), d), np.int64).reshape(-1, m.shape[1])
        held = {tuple(u) for u in kept.tolist()}
        found = search.increment(kept, d, [u for u in m.tolist() if tuple(u) not in held], seed, steps)
        return _scored(list(range(len(found))), found, d)

    return each_block(rows, solve)


def largest(rows: DataFrame, d: int, budget: int = 200_000) -> DataFrame:
    """A largest set of rows that are d apart; more than `budget` nodes in a block are an error."""

    def solve(ids, m):
        far = lambda u, v: max(abs(x - y) for x, y in zip(u[1], v[1], strict=True)) >= d
        found = search.largest([(i, u) for i, u in zip(ids, m.tolist(), strict=True)], far, budget)
        return {"row_id": [i for i, _ in found], "u": [u for _, u in found], "score": 0}

    return each_block(rows, solve)


def checked(found: DataFrame, d: int, image=None) -> DataFrame:
    """block, valid (all rows are permutations), scored (score is twice the block's conflicts), by joins within blocks."""
    n = F.size("u")
    bad = found.groupBy("block").agg(F.max(C.violation("u", n).isNotNull().cast("int")).alias("bad"), F.max("score").alias("told"))
    a, b = found.select("block", F.col("row_id").alias("i"), F.col("u").alias("x")), found.select(F.col("block").alias("of"), F.col("row_id").alias("j"), F.col("u").alias("y"))
    apart = C.separated("x", "y", d) if image is None else C.symmetric_separated("x", "y", d, image)
    pairs = a.join(b, (F.col("block") == F.col("of")) & (F.col("i") < F.col("j")) & ~apart).groupBy(F.col("block").alias("of")).agg(F.count("*").alias("pairs"))  # pairs of a block
    both = bad.join(pairs, F.col("block") == F.col("of"), "left")
    return both.select("block", (F.col("bad") == 0).alias("valid"), (F.col("told") == 2 * F.coalesce("pairs", F.lit(0))).alias("scored"))
