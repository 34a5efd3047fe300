"""Exact top-k inner product search by ball trees, one per shard of the vectors.

Components become floor(256 * x), so scores are whole numbers, exact also beyond 2^53. Rows get a number, are dealt over shards by
it, and a task builds the ball tree of its shard and writes it: trees are built once. A search takes a batch of queries through
a tree: a node's upper bound is q.c + |q| r for the ball's centre and radius, or |q| times its longest vector if that is
less. Below a node whose bound is under the query's current k-th score nothing is opened; the leaves that remain are taken by
each query in the order of their bounds, until none reaches its k-th score. Queries that take the same leaf are scored by one product.

All queries first search the first shard, in parallel. The k-th scores found there go with the queries, in blocks of at most BLOCK,
to the other shards; a task that searches several shards one after another keeps the k-th scores current. Each task gives up to k
rows a query, which are merged with those of the first shard.

Every query meets every shard, in blocks, as a stated query set against all rows; nothing is sampled or capped.

Cases: null vectors, empty ones and those with a null or non-finite component take no part; vectors of
different lengths don't meet; a query's own row is left out, other rows with its vec_id are not; ties go to the smaller
vec_id, null last; fewer than k candidates give fewer rows; an empty table gives none; other columns are ignored. A component
beyond 2^53 or a score beyond 64 bits is an error that says so.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permlab.llm.common import RAW, pick, staged

#: Rows of a shard, at most and (where there are few) at least; queries of a block; rows of a leaf; queries that are searched at once.
SHARD, SMALL, BLOCK, LEAF, BATCH = 8192, 512, 32768, 64, 2048
_LAST, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class Best:
    """The k best rows of some queries so far: by score, then the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(queries, _LEAST) if floor is None else floor.copy()  # what a row must reach

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        query, score, row = np.append(self.query, query), np.append(self.score, score), np.append(self.id, row)
        order = np.lexsort((row, -score, query))
        query, score, row = query[order], score[order], row[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        full = rank == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full])
        kept = rank < self.k
        self.query, self.score, self.id = query[kept], score[kept], row[kept]


class BallTree:
    """Over the rows of an integer matrix. Halves are equal, so the depth is that of their number."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        order, nodes = np.arange(len(points)), []
        fine = points.astype(float)

        def node(a: int, b: int) -> int:
            x = fine[order[a:b]]
            centre = x.mean(0)
            away = np.sqrt(((x - centre) ** 2).sum(1))
            k = len(nodes)
            nodes.append([centre, float(away.max()), float(np.sqrt((x * x).sum(1)).max()), a, b, -1])
            if b - a > leaf:
                one = x[away.argmax()]
                other = x[((x - one) ** 2).sum(1).argmax()]
                order[a:b] = order[a:b][np.argsort(x @ (other - one), kind="stable")]
                nodes[k][5] = parent[node(a, (a + b) // 2)] = parent[node((a + b) // 2, b)] = k
            return k

        parent = {}
        if len(points):
            node(0, len(points))
        self.centre = np.array([x[0] for x in nodes]).reshape(len(nodes), points.shape[1])
        self.radius, self.longest = (np.array([x[k] for x in nodes], float) for k in (1, 2))
        self.begin, self.end = (np.array([x[k] for x in nodes], np.int64) for k in (3, 4))
        self.leaf = np.array([x[5] < 0 for x in nodes], bool)
        self.parent = np.array([parent.get(k, -1) for k in range(len(nodes))], np.int64)  # before its children
        self.points, self.ids, self.rows = points[order], ids[order], rows[order]

    def search(self, asks: np.ndarray, own: np.ndarray, best: Best) -> int:
        """Adds what is among the best of all rows but each query's own. Returns how many leaves were opened."""
        opened = 0
        for a in range(0, len(asks) if len(self.points) else 0, BATCH):
            opened += self._search(np.arange(a, min(a + BATCH, len(asks))), asks, own, best)
        return opened

    def _search(self, some: np.ndarray, asks: np.ndarray, own: np.ndarray, best: Best) -> int:
        q = asks[some].astype(float)
        norm = np.sqrt((q * q).sum(1))[:, None]
        up = np.minimum(q @ self.centre.T + norm * self.radius, norm * self.longest)
        up += 1e-9 * norm * self.longest + 1e-3  # what rounding may take away; scores are whole
        open_ = up >= best.floor[some][:, None]
        for k in range(1, len(self.parent)):
            open_[:, k] &= open_[:, self.parent[k]]
        query, node = np.nonzero(open_ & self.leaf)
        order = np.lexsort((-up[query, node], query))
        query, node = query[order], node[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        turn = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        opened = 0
        for t in range(int(turn.max()) + 1 if len(turn) else 0):
            now = np.flatnonzero(turn == t)
            now = now[up[query[now], node[now]] >= best.floor[some[query[now]]]]
            now = now[np.argsort(node[now], kind="stable")]
            opened += len(now)
            found = []
            for group in np.split(now, np.flatnonzero(np.diff(node[now])) + 1) if len(now) else []:
                a, b = self.begin[node[group[0]]], self.end[node[group[0]]]
                of = some[query[group]]
                score = scores(asks[of], self.points[a:b])
                i, j = np.nonzero((score >= best.floor[of][:, None]) & (self.rows[a:b] != own[of][:, None]))
                found.append((of[i], score[i, j], self.ids[a:b][j]))
            if found:
                best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return opened


def scores(asks: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exactly."""
    one, other = asks.astype(float), points.astype(float)
    if np.sqrt((one * one).sum(1)).max(initial=0) * np.sqrt((other * other).sum(1)).max(initial=0) < 1 << 52:
        return (one @ other.T).astype(np.int64)
    exact = asks.astype(object) @ points.astype(object).T
    if exact.size and (exact.max() > _LAST or exact.min() < _LEAST):
        raise OverflowError("an inner product is beyond 64 bits")
    return exact.astype(np.int64)


def integral(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<long>) of the vectors that take part."""
    own = pick(vectors, vec_id="long", embedding="array<double>")
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    most = F.lit(float(1 << 53))
    whole = lambda x: F.when(F.abs(x * 256) < most, F.floor(x * 256)).otherwise(F.raise_error(F.lit("a component of a vector is beyond 2^53")).cast("long"))
    return own.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine).select("vec_id", F.transform("embedding", whole).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False)


_TREE = "n int, home long, tree binary"
_FOUND = "query long, query_id long, vec_id long, score long"


def trees(points: DataFrame, shards: dict[int, int]) -> DataFrame:
    """n, home, tree: the ball tree of every shard, pickled by this module for itself."""

    def built(batches):
        held: list[pa.RecordBatch] = []

        def solve():
            table = pa.Table.from_batches(held).combine_chunks()
            n, home = table.column("n")[0].as_py(), table.column("home")[0].as_py()
            tree = BallTree(_matrix(table.column("v")), _ids(table.column("vec_id").combine_chunks()), table.column("row").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([home], pa.int64()), pa.array([pickle.dumps(tree, protocol=5)], pa.binary())], names=["n", "home", "tree"])

        for batch in batches:
            key = np.stack([batch.column("n").to_numpy(zero_copy_only=False), batch.column("home").to_numpy(zero_copy_only=False)], 1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if held and (held[-1].column("n")[0].as_py(), held[-1].column("home")[0].as_py()) != tuple(key[a].tolist()):
                    yield solve()
                    held.clear()
                held.append(batch.slice(a, b - a))
        if held:
            yield solve()

    rows = points.select("n", "home", "vec_id", "row", "v").repartition(sum(shards.values()), "n", "home").sortWithinPartitions("n", "home", "row")
    return rows.mapInArrow(built, _TREE)


def _found(asked: dict, best: dict[int, Best]):
    """The best rows of all queries as a batch."""
    out = [(asked[n][0][b.query], asked[n][1][b.query], b.id, b.score) for n, b in best.items()]
    query, vec, row, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out, strict=True) if out else [()] * 4))
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(row, mask=row == _LAST), pa.array(score)], names=["query", "query_id", "vec_id", "score"])


def _asked(table) -> dict[int, tuple]:
    """By length: query numbers, vec_ids, own rows, floors and vectors."""
    out = {}
    sizes = table.column("n").to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column("n").to_numpy()
    for n in np.unique(sizes).tolist():
        some = pa.Table.from_batches([table] if isinstance(table, pa.RecordBatch) else table.to_batches()).filter(pa.array(sizes == n)).combine_chunks()
        floor = some.column("floor").fill_null(_LEAST).to_numpy() if "floor" in some.column_names else None
        out[n] = some.column("row").to_numpy(), some.column("vec_id").to_numpy(), some.column("row").to_numpy(), floor, _matrix(some.column("v"))
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` its k best among all other rows."""
    spark = vectors.sparkSession
    points = staged(integral(vectors).select("vec_id", "v", F.size("v").alias("n"), F.monotonically_increasing_id().alias("row")), "vectors")
    counts = {r["n"]: r["rows"] for r in points.groupBy("n").agg(F.count("*").alias("rows")).collect()}  # a row for each length
    # shards of up to `shard` rows; smaller ones as long as tasks are fewer than cores
    small = min(shard, max(SMALL, sum(counts.values()) // (2 * spark.sparkContext.defaultParallelism)))
    shards = {n: max(1, -(-rows // small)) for n, rows in counts.items()}
    of = F.lit(1)
    for n, many in shards.items():
        of = F.when(F.col("n") == n, many).otherwise(of)
    points = points.withColumn("home", F.pmod(F.xxhash64("row"), of.cast("long")))
    asking = points.where(F.col("vec_id") % every == 0).select("row", "vec_id", "v", "n")
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    forest = staged(trees(points, shards), "trees", RAW)

    # all queries in the first shard of their length
    found = None
    for n in sorted(shards):
        first = forest.where((F.col("n") == n) & (F.col("home") == 0)).select("tree").first()
        sent = spark.sparkContext.broadcast(first["tree"] if first else None)  # a shard

        def pilot(batches, sent=sent):
            tree = pickle.loads(sent.value) if sent.value else None
            for batch in batches:
                asked = _asked(batch)
                best = {m: Best(len(x[0]), k) for m, x in asked.items()}
                for m, x in asked.items():
                    if tree:
                        tree.search(x[4], x[2], best[m])
                yield _found(asked, best)

        part = asking.where(F.col("n") == n).mapInArrow(pilot, _FOUND)
        found = part if found is None else found.unionByName(part)
    found = staged(found, "pilot")
    floors = found.groupBy("query").agg(F.count("*").alias("rows"), F.min("score").alias("floor")).where(F.col("rows") == k).select("query", "floor")
    asking = asking.join(floors, F.col("row") == F.col("query"), "left").select("row", "vec_id", "v", "n", "floor")
    parts = max(1, -(-asking.count() // block))
    asking = staged(asking.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts))), "queries")

    def search(asked: pa.Table) -> DataFrame:
        sent = spark.sparkContext.broadcast(asked)  # about `block` queries

        def rows(batches):
            asked = _asked(sent.value)
            best = {n: Best(len(x[0]), k, x[3]) for n, x in asked.items()}
            for batch in batches:
                for n, tree in zip(batch.column("n").to_pylist(), batch.column("tree"), strict=True):
                    if n in asked:
                        pickle.loads(tree.as_buffer()).search(asked[n][4], asked[n][2], best[n])
            yield _found(asked, best)

        return forest.where("home > 0").repartition(max(1, min(sum(shards.values()), 4 * spark.sparkContext.defaultParallelism)), "n", "home").mapInArrow(rows, _FOUND)

    if max(shards.values()) > 1:
        for b in range(parts):
            asked = asking.where(F.col("block") == b).select("row", "vec_id", "v", "n", "floor").toArrow()
            if asked.num_rows:
                found = found.unionByName(search(asked))
    best = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
