"""Seeded searches for large arrays: chains run in parallel, one task each, and what they return is checked by Spark.

A chain's state (a few thousand rows of n small numbers at most) is local to its task; chains differ by their seed alone,
so a lost task is run again with the same result. Nothing here grows with data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def conflict_matrix(rows: np.ndarray, d: int, image=None, masked: bool = False) -> np.ndarray:
    """Whether rows conflict; with an image, also through their images; masked: only columns bound in both count."""
    out = np.zeros((len(rows), len(rows)), bool)
    for i in range(len(rows)):
        out[i] = _against(rows, rows[i], d, image, masked)
    np.fill_diagonal(out, False)
    return out


def _against(rows: np.ndarray, row: np.ndarray, d: int, image=None, masked: bool = False) -> np.ndarray:
    gap = np.abs(rows - row)
    if masked:
        gap = np.where((rows >= 0) & (row >= 0), gap, 0)
    near = gap.max(1) < d
    if image is not None:  # an involution that keeps distances: two of the four tests are enough
        near |= np.abs(rows - image(row)).max(1) < d
    return near


def complement_of(row: np.ndarray) -> np.ndarray:
    return len(row) - 1 - row


def bump_half_of(row: np.ndarray) -> np.ndarray:
    return (row + len(row) // 2) % len(row)


IMAGES = {None: None, "complement": complement_of, "bump_half": bump_half_of}


def climb(rows: np.ndarray, d: int, seed: int, steps: int = 2000, pick: str = "uniform", move: str = "group", objective: str = "score", image: str | None = None, masked: bool = False, stale: int = 200, candidates: int = 1):
    """Local search. Returns the best rows, their score, and a log of (step, score).

    pick: `uniform` rows or `degree`, by (degree + 1) squared. move: shuffle the symbols of one `group` of d in
    the row, so that templates stay, or of a random `subset`. Of `candidates` moves the best is tried. A move is taken
    if it ends more conflicts than it makes; one that ends as many, after 100 tries without; after `stale` tries any.
    objective: `score`, or `coverage` (rows without conflict count exponentially).
    """
    best, _, _, log = _climbed(rows, rows, 0, np.random.default_rng(seed), d, steps, pick, move, objective, image, masked, stale, candidates)
    return best, int(conflict_matrix(best, d, IMAGES[image], masked).sum()), log


def _climbed(rows, held, waited, r, d, steps, pick="uniform", move="group", objective="score", image=None, masked=False, stale=200, candidates=1):
    """Goes on from rows, with the best rows so far and the tries without gain. Returns the best rows, the rows, the tries and a log."""
    f, rows = IMAGES[image], rows.copy()
    matrix = conflict_matrix(rows, d, f, masked)
    n, log = rows.shape[1], []
    deg = matrix.sum(1)  # kept with the matrix, the table of foes that meet

    def value(deg):
        return (int(deg.sum()), 0) if objective == "score" else (-int((deg == 0).sum()), int(deg.sum()))

    now = value(deg)
    best = value(conflict_matrix(held, d, f, masked).sum(1)), held.copy()
    log.append((0, int(matrix.sum())))
    for step in range(1, steps + 1):
        bad = np.flatnonzero(deg)
        if not len(bad):
            break
        if pick == "degree":
            weight = (deg[bad] + 1.0) ** 2
            i = int(r.choice(bad, p=weight / weight.sum()))
        else:
            i = int(r.choice(bad))
        options = []
        for _ in range(candidates):
            row = rows[i].copy()
            if move == "group":
                groups = row // d
                where = np.flatnonzero((groups == groups[r.integers(n)]) & (row >= 0))
            else:
                where = np.flatnonzero(row >= 0)
                where = r.choice(where, min(len(where), int(r.integers(2, max(3, len(where))))), replace=False)
            row[where] = row[r.permutation(where)]
            near = _against(rows, row, d, f, masked)
            near[i] = False
            options.append((int(near.sum()) - int(deg[i]), row, near))
        change, row, near = min(options, key=lambda o: o[0])
        if change < 0 or (change == 0 and waited > 100) or waited > stale:
            _replace(rows, matrix, deg, i, row, near)
            new = value(deg)
            waited = 0 if new < now else waited + 1
            now = new
            if now < best[0]:
                best = now, rows.copy()
                log.append((step, int(matrix.sum())))
        else:
            waited += 1
    return best[1], rows, waited, log


def _replace(rows: np.ndarray, matrix: np.ndarray, deg: np.ndarray, i: int, row: np.ndarray, near: np.ndarray) -> None:
    """A row and what follows of it for the conflicts and their numbers."""
    deg += near.astype(deg.dtype) - matrix[i]
    deg[i] = near.sum()
    rows[i], matrix[i], matrix[:, i] = row, near, near


def disturb(rows: np.ndarray, d: int, seed: int, steps: int = 2000, gentle: int = 1000, great: int = 100_000):
    """Search by two kinds of disturbance. Returns the best rows, their score, and a log of (step, score).

    A gentle one shuffles the high symbols (the last d) or the low ones of any row over their positions, and stays unless it makes
    more conflicts than it ends. Without a gain for `gentle` steps at the best score, or for `great` steps above it (then from the
    best rows again), a great one shuffles both of the row that is apart from most others, of equal ones the last, and stays.
    """
    r, n = np.random.default_rng(seed), rows.shape[1]
    rows = rows.copy()
    matrix = conflict_matrix(rows, d)
    deg = matrix.sum(1)
    best, kept, log, gained = int(deg.sum()), rows.copy(), [(0, int(deg.sum()))], 0
    for step in range(1, steps + 1):
        if not deg.any():
            break
        now = int(deg.sum())
        if step - gained > (gentle if now == best else great):
            if now > best:
                rows = kept.copy()
                matrix = conflict_matrix(rows, d)
                deg = matrix.sum(1)
            i = len(deg) - 1 - int(np.argmin(deg[::-1]))
            parts, gained, forced = (rows[i] >= n - d, rows[i] < n - d), step, True
        else:
            i, forced = int(r.integers(len(rows))), False
            parts = ((rows[i] >= n - d) if r.integers(2) else (rows[i] < n - d),)
        row = rows[i].copy()
        for part in parts:
            where = np.flatnonzero(part)
            row[where] = row[r.permutation(where)]
        near = _against(rows, row, d)
        near[i] = False
        change = int(near.sum()) - int(deg[i])
        if forced or change <= 0:
            _replace(rows, matrix, deg, i, row, near)
            gained = step if change < 0 else gained
            if int(deg.sum()) < best:
                best, kept = int(deg.sum()), rows.copy()
                log.append((step, best))
    return kept, best, log


def chains(array: DataFrame, d: int, seeds: list[int], **options) -> DataFrame:
    """seed, score, row_id, u: what a chain from the array reaches for every seed, by climb() or, with kind="disturb", by disturb()."""
    go = {"climb": climb, "disturb": disturb}[options.pop("kind", "climb")]
    start = [(r["row_id"], list(r["u"])) for r in array.orderBy("row_id").collect()]  # one array, small by its nature
    rows, ids = np.array([u for _, u in start], np.int64), [i for i, _ in start]

    def run(frame):
        import pandas as pd

        found, score, _ = go(rows, d, int(frame["seed"].iloc[0]), **options)
        return pd.DataFrame({"seed": frame["seed"].iloc[0], "score": score, "row_id": ids, "u": found.tolist()})

    spark = array.sparkSession
    return spark.createDataFrame([(s,) for s in seeds], "seed long").groupBy("seed").applyInPandas(run, "seed long, score long, row_id long, u array<int>")


_SEGMENT = "seed long, block long, segment long, score long, waited long, ids array<long>, rows array<array<int>>, best array<array<int>>"


def chains_until(array: DataFrame, d: int, seeds: list[int], folder: str, seconds: float | None = None, segments: int | None = None, steps: int = 500, **options) -> DataFrame:
    """seed, block, segment, score, row_id, u: the best rows of climb() chains that go on in segments of so many steps, one for each seed and block.

    array: row_id, u, perhaps block: an array for each block, all in one if there is none. Stops between segments: when the seconds are over, after so many segments, when no chain has a conflict left, at an interrupt, or if a file named `stop` is
    in the folder. Each segment of all chains is written there before the next, and a later call with the folder goes on from the last
    one. A segment's random numbers come from the seed, the block and its number, so a chain that was stopped reaches what an unbroken one does.
    """
    import time

    from pyspark.sql import functions as F

    spark, folder, began = array.sparkSession, folder.rstrip("/"), time.monotonic()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    is_there = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
    read = lambda k: spark.read.schema(_SEGMENT).parquet(f"{folder}/{k}")

    def run(frame):
        import pandas as pd

        seed, block, segment = int(frame["seed"].iloc[0]), int(frame["block"].iloc[0]), int(frame["segment"].iloc[0]) + 1
        rows, best = (np.array([list(u) for u in frame[c].iloc[0]], np.int64) for c in ("rows", "best"))
        best, rows, waited, _ = _climbed(rows, best, int(frame["waited"].iloc[0]), np.random.default_rng([seed, block, segment]), d, steps, **options)
        score = int(conflict_matrix(best, d, IMAGES[options.get("image")], options.get("masked", False)).sum())
        return pd.DataFrame({"seed": [seed], "block": [block], "segment": [segment], "score": [score], "waited": [waited], "ids": [frame["ids"].iloc[0]], "rows": [rows.tolist()], "best": [best.tolist()]})

    k = 0
    while is_there(f"{k + 1}/_SUCCESS"):
        k += 1
    if k == 0 and not is_there("0/_SUCCESS"):
        own = array if "block" in array.columns else array.withColumn("block", F.lit(0))
        whole = own.groupBy(F.col("block").cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("row_id", "u"))).alias("r"))  # one array each, small by its nature
        zero = F.lit(0).cast("long")
        start = whole.select(F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])).alias("seed"), "block", zero.alias("segment"), F.lit(-1).cast("long").alias("score"), zero.alias("waited"), F.transform("r", lambda r: r["row_id"].cast("long")).alias("ids"), *[F.transform("r", lambda r: r["u"]).alias(c) for c in ("rows", "best")])
        start.write.mode("overwrite").parquet(f"{folder}/0")
    last = k
    try:
        while (segments is None or k < segments) and (seconds is None or k == last or time.monotonic() - began < seconds) and not is_there("stop"):
            now = read(k)
            if not now.where("score <> 0").limit(1).count():
                break
            done = now.where("score = 0")
            done.unionByName(now.where("score <> 0").groupBy("seed", "block").applyInPandas(run, _SEGMENT)).write.mode("overwrite").parquet(f"{folder}/{k + 1}")
            k += 1
    except KeyboardInterrupt:
        pass
    return read(k).select("seed", "block", "segment", "score", F.explode(F.arrays_zip("ids", "best")).alias("r")).select("seed", "block", "segment", "score", F.col("r.ids").alias("row_id"), F.col("r.best").alias("u"))


def best_chain(found: DataFrame) -> DataFrame:
    """row_id, u of the chain with the lowest score, ties to the least seed."""
    from pyspark.sql import functions as F

    best = found.agg(F.min(F.struct("score", "seed")).alias("b")).select("b.seed")
    return found.join(F.broadcast(best), "seed").select("row_id", "u")  # one number


def increment(rows: np.ndarray, d: int, missing: list[list[int]], seed: int, steps: int = 500) -> np.ndarray:
    """Adds missing rows one by one, each followed by a repair; one that can't be repaired is left out."""
    for k, u in enumerate(missing):
        more = np.vstack([rows, u])
        found, score, _ = climb(more, d, seed + k, steps, pick="degree")
        if score == 0:
            rows = found
    return rows


def tournament(rows: np.ndarray, d: int, seed: int, rounds: int = 20, steps: int = 200, neighbours=None) -> np.ndarray:
    """Repairs the neighbourhood of a random row by itself, and puts it back if the whole array gets no worse."""
    r = np.random.default_rng(seed)
    for k in range(rounds):
        matrix = conflict_matrix(rows, d)
        if not matrix.any():
            break
        i = int(r.choice(np.flatnonzero(matrix.any(1))))
        some = np.flatnonzero(matrix[i] | (np.abs(rows // d - rows[i] // d).max(1) <= 1 if neighbours is None else neighbours(rows, i)))
        found, _, _ = climb(rows[some], d, seed * 1000 + k, steps, pick="degree")
        new = rows.copy()
        new[some] = found
        if conflict_matrix(new, d).sum() <= matrix.sum():
            rows = new
    return rows


def lexicode(n: int, m: int, d: int, ident: list[int] | None = None, probes: int = 0, seed: int = 0, most: int | None = None) -> list[list[int]]:
    """Sequences of n of m symbols in lexicographic order, each kept if its image under ident is d from all kept ones; after random probes."""
    from itertools import permutations

    ident = np.array(ident if ident is not None else range(m))
    kept: list[list[int]] = []
    images = np.zeros((0, n), np.int64)

    def offer(u):
        nonlocal images
        v = ident[list(u)]
        if not len(images) or (np.abs(images - v).max(1) >= d).all():
            kept.append(list(u))
            images = np.vstack([images, v])

    r = np.random.default_rng(seed)
    for _ in range(probes):
        offer(r.permutation(m)[:n].tolist())
    for u in permutations(range(m), n):
        if most is not None and len(kept) >= most:
            break
        offer(u)
    return kept


def greedy_keep(rows, d: int, image: str | None = None, orders=None) -> list[list[int]]:
    """Rows in order, each kept if it is d from all kept ones; with an image, from their images too. orders(row): what to offer for a row, the first that fits is kept."""
    kept = np.zeros((0, len(rows[0]) if len(rows) else 0), np.int64)
    for row in rows:
        for u in orders(row) if orders else (row,):
            u = np.array(u, np.int64)
            if not len(kept) or not _against(kept, u, d, IMAGES[image]).any():
                kept = np.vstack([kept, u])
                break
    return kept.tolist()


def high_orders(n: int, d: int):
    """For a row, the row with its d highest symbols in every order at their positions."""
    from itertools import permutations

    def orders(row):
        where = [k for k, x in enumerate(row) if x >= n - d]
        for highs in permutations(range(n - d, n)):
            u = list(row)
            for k, x in zip(where, highs, strict=True):
                u[k] = x
            yield u

    return orders


def lexicodes(spark: SparkSession, n: int, m: int, d: int, seeds: list[int], probes: int = 0) -> DataFrame:
    """seed, row_id, u: an array for every seed."""

    def run(frame):
        import pandas as pd

        s = int(frame["seed"].iloc[0])
        kept = lexicode(n, m, d, probes=probes, seed=s)
        return pd.DataFrame({"seed": s, "row_id": range(len(kept)), "u": kept})

    return spark.createDataFrame([(s,) for s in seeds], "seed long").groupBy("seed").applyInPandas(run, "seed long, row_id long, u array<int>")


# -- exact search


class SearchEnded(RuntimeError):
    """The number of nodes that a search may look at was reached before it had its result."""


def choose(slots: list[list[list[int]]], d: int, skip: bool = False, value=None, budget: int = 1_000_000) -> list[tuple[int, int]] | None:
    """One option (row) of each slot so that all are d apart, as (slot, option); the first in order.

    With skip, slots may stay empty and as many as possible are filled (branches that can't fill more end); with value(rows), all
    ways are tried and the best total wins. More than `budget` nodes are an error, never a worse result.
    """
    best: list[tuple[int, int]] | None = None
    best_value = None
    left = budget

    def walk(k, taken, rows):
        nonlocal best, best_value, left
        if not skip and value is None and best is not None:
            return
        if left <= 0:
            raise SearchEnded(f"more than {budget} nodes")
        left -= 1
        if k == len(slots):
            now = value([slots[i][j] for i, j in taken]) if value else len(taken)
            if best is None or now > best_value:
                best, best_value = list(taken), now
            return
        if skip and value is None and best is not None and len(taken) + len(slots) - k <= best_value:
            return
        for j, u in enumerate(slots[k]):
            if all(max(abs(x - y) for x, y in zip(u, v, strict=True)) >= d for v in rows):
                walk(k + 1, [*taken, (k, j)], [*rows, u])
        if skip:
            walk(k + 1, taken, rows)

    walk(0, [], [])
    return best


def frontier(slots: DataFrame, d: int, first: str | None = None) -> DataFrame:
    """rows: all ways to take one option (slot, u) of each slot, all d apart; the partial ways grow by a join for each slot."""
    from pyspark.sql import functions as F

    from permlab.functions import columns as C
    from permlab.sources.storage import staged

    ks = [r["slot"] for r in slots.select("slot").distinct().orderBy("slot").collect()]
    grown = None
    for k in ks:
        here = slots.where(F.col("slot") == k).select("u")
        if grown is None:
            grown = here.select(F.array("u").alias("rows")) if first is None else here.where(C.text("u") == first).select(F.array("u").alias("rows"))
            continue
        fits = F.forall("rows", lambda r: C.separated(r, F.col("u"), d))
        grown = staged(grown.join(F.broadcast(here), fits).select(F.concat("rows", F.array("u")).alias("rows")), "frontier")  # one slot's options
    return grown


def largest(candidates: list[list[int]], far, budget: int = 200_000) -> list[list[int]]:
    """A largest set of candidates that are pairwise far, by taking or leaving each; more than `budget` nodes are an error."""
    best: list[list[int]] = []
    left = budget

    def walk(k, taken):
        nonlocal best, left
        left -= 1
        if len(taken) > len(best):
            best = list(taken)
        if k == len(candidates) or len(taken) + len(candidates) - k <= len(best):
            return
        if left <= 0:
            raise SearchEnded(f"more than {budget} nodes")
        if all(far(candidates[k], u) for u in taken):
            walk(k + 1, [*taken, candidates[k]])
        walk(k + 1, taken)

    walk(0, [])
    return best


def construct(spark: SparkSession, n: int, d: int, seed: int = 0, steps: int = 500) -> DataFrame:
    """An array for (n, d), built over that for (n - d, d) by weaving and climbing, down to a single row."""
    from pyspark.sql import functions as F

    from permlab.functions import columns as C
    from permlab.operators import generate

    if n - d < d:
        return spark.range(1).select(F.col("id").alias("row_id"), C.indices(n).alias("u")) if n <= d else generate.ascending_array(spark, n, d)
    woven = generate.weave_high(construct(spark, n - d, d, seed, steps), n, d)
    return best_chain(chains(woven, d, [seed, seed + 1], steps=steps, pick="degree"))


def resume(spark: SparkSession, folder: str, n: int, d: int, verified: bool = False, patterns: list[tuple[str, int]] | None = None, seed: int = 0, steps: int = 500) -> tuple[DataFrame, str | None]:
    """An array to go on from, and the file it came from: by the order of sources.text.resolve(), or of patterns (a name with {n} and
    {d}, and by how many times d the n of its array is less). A smaller array is woven; without a file an ascending array, or one that is
    built over smaller ones. With `verified`, a file whose rows aren't all d apart is an error."""
    from permlab.operators import generate, relations
    from permlab.sources import text

    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in fs.listStatus(hadoop)] if fs.exists(hadoop) else []  # names of one folder
    offered = [(p.format(n=n - less * d, d=d), less) for p, less in patterns] if patterns else [(x, int(f"pa_{n}_" not in x)) for x in [text.resolve(found, n, d)] if x]
    for name, less in offered:
        if name in found:
            array = text.load(spark, f"{folder.rstrip('/')}/{name}", "lenient").select("row_id", "u")
            if verified and not relations.score(array, d).first()["verified"]:
                raise ValueError(f"{name} isn't verified")
            for k in range(less - 1, -1, -1):
                array = generate.weave_high(array, n - k * d, d)
            return array, name
    return (generate.ascending_array(spark, n, d) if n - d <= d else construct(spark, n, d, seed, steps)), None


def seeds(spark: SparkSession, n: int, d: int) -> DataFrame:
    """rows: all arrays of a row for every set of d positions for the high symbols, all rows d apart, the first row ascending."""
    from pyspark.sql import functions as F

    from permlab.functions import columns as C
    from permlab.operators import generate

    lows = generate.permutations(spark, n - d).withColumnRenamed("u", "low")
    highs = generate.permutations(spark, d).select(F.transform("u", lambda x: x + n - d).alias("high"))
    slots = generate.combinations(spark, n, d).crossJoin(lows).crossJoin(highs).select(F.col("id").alias("slot"), C.infill("low", F.col("high"), "ps").alias("u"))  # constants of n and d
    ascending = (F.col("slot") > 0) | (C.text("u") == ",".join(map(str, [*range(n - d, n), *range(n - d)])))
    return frontier(slots.where(ascending), d)


def cover_designs(spark: SparkSession, k: int) -> DataFrame:
    """sets: all ways to give each of 2k rows r a set of k numbers below 2k without r, the first that of 1 to k, so that of any two rows
    q < r the set of q holds r or that of r holds q."""
    from pyspark.sql import functions as F

    from permlab.operators import generate
    from permlab.sources.storage import staged

    every = generate.combinations(spark, 2 * k, k).select("ps")
    rows = spark.range(1).select(F.array(F.array(*[F.lit(x) for x in range(1, k + 1)])).alias("sets"))
    for r in range(1, 2 * k):
        here = every.where(~F.array_contains("ps", r))
        fits = F.forall(F.sequence(F.lit(0), F.lit(r - 1)), lambda q: F.array_contains("ps", q) | F.array_contains(F.get("sets", q), F.lit(r)))
        rows = staged(rows.join(F.broadcast(here), fits).select(F.concat("sets", F.array("ps")).alias("sets")), "designs")  # subsets of 2k
    return rows


def best_fillings(spark: SparkSession, n: int, d: int, template: list[int], array: DataFrame) -> DataFrame:
    """u: rows with each symbol in the group that the template's symbol is of, which are d apart from as many rows of the array as can be."""
    from pyspark.sql import functions as F

    groups = [[g * d + x for x in range(d)] for g in (t // d for t in template)]
    rows = spark.range(1).select(F.array().cast("array<int>").alias("u"))
    for options in groups:
        rows = rows.select(F.explode(F.array(*[F.concat("u", F.array(F.lit(x))) for x in options])).alias("u"))
    from permlab.functions import columns as C

    own = array.select(F.col("u").alias("v")).groupBy("v").agg(F.count("*").alias("copies"))
    apart = rows.join(own, C.separated("u", "v", d), "left").groupBy("u").agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n"))  # d ** n rows
    best = apart.agg(F.max("n").alias("most"))
    return apart.join(F.broadcast(best), F.col("n") == F.col("most")).select("u")  # one number
