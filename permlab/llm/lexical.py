"""Exact ranked lexical search over dual-sorted wavelet trees, one for each shard of documents.

A shard is some consecutive documents of a partition, numbered by ascending doc_id. Its postings stand term after term, those of a term by
falling impact. The wavelet tree over the document numbers in that order splits them bit by bit, highest bit first, and keeps the
order within each half: so a node of the tree is a range of documents, and in it the postings of a term are a run, still by falling
impact, whose first one bounds all others. Trees hold the bits of each level, the impacts in the order of the postings, and a dictionary.

A search keeps, for each query, nodes with the runs of its terms and the sum of their first impacts, weighted: no document of the node scores more.
The best nodes are split first, all queries at once; a term with an empty run leaves the node; at a node of one document the bound is its score.
Nodes below the query's current k-th score are dropped. The trees are searched in two parts: the k-th scores found in the first go with the second,
and a task keeps them current over its trees.

Score of a document: the sum over the query's terms, repeats included, of weight times impact, whole numbers both. With N documents that have a term, L
terms in all, n in the document, df documents that hold the term and tf its occurrences: weight floor(1000 ln((2N + 2) / (2 df + 1))),
impact 10^9 tf div (1000 tf + 12 m), m = 75 + 25 n N div L.

Cases: a null text has no terms and is never found, nor is one that shares no term of positive weight; queries without terms get no rows; a null item_id
is a query like others; repeated rows are documents (or queries) of their own; equal scores go by doc_id, null last; empty tables give no
rows; other columns are ignored. Terms are looked up by a 64-bit hash and compared byte by byte.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permlab.llm.common import RAW, pick, shared_dir, spans_of, staged, text_bytes
from permlab.llm.shingling import mixed

#: Documents and bytes of text of a shard, at most (a longer text is alone); bytes whose terms are hashed at a time.
SHARD_ROWS, SHARD_BYTES, STEP = 4096, 1 << 23, 1 << 20
#: Queries and their terms in a block, at most (a longer query is alone).
BLOCK_ROWS, BLOCK_TERMS = 4096, 1 << 18
#: One tree in so many is searched before the others.
FIRST = 16
_IN_TERM = np.zeros(256, bool)
_IN_TERM[48:58] = _IN_TERM[65:91] = _IN_TERM[97:123] = _IN_TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWER = np.random.default_rng(12).integers(0, 1 << 63, 65, np.uint64) * np.uint64(2) + np.uint64(1)
_LAST = np.iinfo(np.int64).max


# -- terms


def bounds_of_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where terms start and end, and the terms before each text and after the last."""
    data, offsets = text_bytes(texts)
    inside = _IN_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~np.append(False, inside[:-1]) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (~np.append(inside[1:], False) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    return data, starts, ends, np.searchsorted(starts, offsets)


def _joined(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the given places one after another, and the place of each byte within its own."""
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return _LOWER[data[np.repeat(starts, sizes) + place]], place


def term_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    out = [np.zeros(0, np.uint64)]
    for a, b in spans_of(sizes, STEP):
        body, place = _joined(data, starts[a:b], sizes[a:b])
        h = np.add.reduceat((body.astype(np.uint64) + np.uint64(1)) * _POWER[place % 64], np.cumsum(sizes[a:b]) - sizes[a:b])
        out.append(mixed(h + sizes[a:b].astype(np.uint64) * _POWER[64]))
    return np.concatenate(out)


def numbered_terms(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of the distinct terms in ascending order (equal ones if terms collide), the number of each term, and the distinct terms."""
    keys, first, number = np.unique(term_hashes(data, starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    alike = size == size[first][number]
    for a, b in spans_of(size, STEP):
        some = np.flatnonzero(alike[a:b]) + a
        if len(some):
            one, _ = _joined(data, starts[some], size[some])
            other, _ = _joined(data, starts[first[number[some]]], size[some])
            alike[some] = np.logical_and.reduceat(one == other, np.cumsum(size[some]) - size[some])
    if not alike.all():  # two terms with one hash: by their bytes
        own = np.array([_LOWER[data[a:b]].tobytes() for a, b in zip(starts, ends, strict=True)], object)
        names, first, number = np.unique(own, return_index=True, return_inverse=True)
        keys = term_hashes(data, starts[first], ends[first])
        order = np.argsort(keys, kind="stable")
        keys, first, number = keys[order], first[order], np.argsort(order)[number]
    return keys, number, [_LOWER[data[a:b]].tobytes() for a, b in zip(starts[first], ends[first], strict=True)]


# -- trees


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Of postings with so many occurrences in documents of so many terms."""
    exact = 25 * int(n.max(initial=0)) * documents < 1 << 63
    m = 75 + (25 * n * documents // terms if exact else np.array([25 * x * documents // terms for x in n.tolist()], np.int64))
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class WaveletTree:
    """Of one shard: columns as they are stored, and what a search derives from them."""

    NAMES = ("doc_ids", "hashes", "begin", "words", "word_at", "impact", "bits")

    def __init__(self, doc_ids, hashes, begin, words, word_at, impact, bits):
        self.doc_ids, self.hashes, self.begin, self.words, self.word_at, self.impact, self.bits = doc_ids, hashes, begin, words, word_at, impact, bits
        n, self.levels = len(impact), depth(len(doc_ids))
        stride = (n + 7) // 8
        self.ones = np.zeros((self.levels, n + 1), np.int32)  # set bits before a place
        self.best = np.zeros((self.levels + 1, n), np.int32)  # impacts in the order of a level
        self.best[0] = impact
        for k in range(self.levels):
            bit = np.unpackbits(bits[k * stride : (k + 1) * stride], count=n, bitorder="little").astype(bool)
            np.cumsum(bit, out=self.ones[k, 1:])
            self.best[k + 1] = np.concatenate([self.best[k][~bit], self.best[k][bit]])
        self.zeros = n - self.ones[:, -1]

    @classmethod
    def build(cls, doc_ids: np.ndarray, texts: pa.Array, documents: int, terms: int) -> WaveletTree | None:
        """None if no text has a term."""
        order = np.argsort(doc_ids, kind="stable")
        rank = np.argsort(order, kind="stable")
        data, starts, ends, at = bounds_of_terms(texts)
        if not len(starts):
            return None
        keys, number, names = numbered_terms(data, starts, ends)
        n = np.diff(at)
        doc = np.repeat(rank, n)
        pair, tf = np.unique(number * len(doc_ids) + doc, return_counts=True)
        term, doc = pair // len(doc_ids), pair % len(doc_ids)
        size = np.zeros(len(doc_ids), np.int64)
        size[rank] = n
        impact = impacts(tf, size[doc], documents, terms)
        falling = np.lexsort((doc, -impact, term))
        term, doc, impact = term[falling], doc[falling], impact[falling]
        begin = np.searchsorted(term, np.arange(len(keys) + 1))
        levels, bits = depth(len(doc_ids)), []
        for k in reversed(range(levels)):
            bit = (doc >> k & 1).astype(bool)
            bits.append(np.packbits(bit, bitorder="little"))
            doc = np.concatenate([doc[~bit], doc[bit]])
        word_at = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        return cls(doc_ids[order], keys, begin.astype(np.int32), b"".join(names), word_at.astype(np.int32), impact.astype(np.int32), np.concatenate([np.zeros(0, np.uint8), *bits]))

    def row(self) -> list:
        return [x if isinstance(x, bytes) else x.tobytes() for x in (getattr(self, n) for n in self.NAMES)]

    @classmethod
    def read(cls, row: dict) -> WaveletTree:
        kinds = {"doc_ids": np.int64, "hashes": np.uint64, "begin": np.int32, "word_at": np.int32, "impact": np.int32, "bits": np.uint8}
        return cls(**{n: np.frombuffer(row[n], kinds[n]) if n in kinds else bytes(row[n]) for n in cls.NAMES})


def depth(documents: int) -> int:
    return max(0, documents - 1).bit_length()


def terms_at(hashes: np.ndarray, words: bytes, word_at: np.ndarray, wanted: np.ndarray, names: list[bytes]) -> np.ndarray:
    """Where a dictionary has the wanted terms; -1 for those that it hasn't."""
    at = np.searchsorted(hashes, wanted)
    out = np.full(len(wanted), -1)
    for i in np.flatnonzero((at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == wanted)) if len(hashes) else ():
        k = at[i]
        while k < len(hashes) and hashes[k] == wanted[i]:
            if words[word_at[k] : word_at[k + 1]] == names[i]:
                out[i] = k
                break
            k += 1
    return out


# -- search


class Found:
    """The k best documents of each query so far: by score, then the smaller doc_id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()  # what a document must reach
        self.query, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        query, score, doc = np.append(self.query, query), np.append(self.score, score), np.append(self.doc, doc)
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        full = rank == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full])
        kept = rank < self.k
        self.query, self.score, self.doc = query[kept], score[kept], doc[kept]


def search(tree: WaveletTree, query: np.ndarray, term: np.ndarray, weight: np.ndarray, found: Found, at_once: int = 8) -> int:
    """query, term, weight: what each query asks of this tree's terms. Adds to found; returns how many nodes were split.

    Splits the `at_once` best nodes of each query in each round, and once the tree's depth is reached more and more: the best bounds come first.
    """
    n_queries, split, wide, rounds = len(found.floor), 0, float(at_once), 0
    order = np.argsort(query, kind="stable")
    q, node_of, w = query[order], query[order], weight[order]
    s, e = tree.begin[term[order]].astype(np.int64), tree.begin[term[order] + 1].astype(np.int64)
    # nodes: query, level, first document; runs: node, weight, begin, end, sorted by node
    nodes_q = np.unique(q)
    run_node = np.searchsorted(nodes_q, node_of)
    level, doc = np.zeros(len(nodes_q), np.int64), np.zeros(len(nodes_q), np.int64)
    bound = _sums(run_node, w * tree.best[0, s], len(nodes_q))
    while True:
        done = level == tree.levels
        if done.any():
            found.add(nodes_q[done], bound[done], tree.doc_ids[doc[done]])
        stay = ~done & (bound >= found.floor[nodes_q])
        nodes_q, level, doc, bound, run_node, w, s, e = _chosen(stay, nodes_q, level, doc, bound, run_node, w, s, e)
        if not len(nodes_q):
            return split
        rank = _ranks(nodes_q, bound, n_queries)
        now = rank < wide
        rounds += 1
        wide *= 1.3 if rounds > tree.levels else 1
        split += int(now.sum())
        rest = _chosen(~now, nodes_q, level, doc, bound, run_node, w, s, e)
        nq, lv, dc, _, rn, ww, ss, ee = _chosen(now, nodes_q, level, doc, bound, run_node, w, s, e)
        at = lv[rn]
        one_s, one_e = tree.ones[at, ss].astype(np.int64), tree.ones[at, ee].astype(np.int64)
        z = tree.zeros[at]
        # the halves: documents whose bit is 0, then those with 1
        half_node = np.concatenate([2 * rn, 2 * rn + 1])
        half_s, half_e, half_w = np.concatenate([ss - one_s, z + one_s]), np.concatenate([ee - one_e, z + one_e]), np.append(ww, ww)
        kept = half_s < half_e
        half_node, half_s, half_e, half_w = half_node[kept], half_s[kept], half_e[kept], half_w[kept]
        order = np.argsort(half_node, kind="stable")
        half_node, half_s, half_e, half_w = half_node[order], half_s[order], half_e[order], half_w[order]
        there, new_node = np.unique(half_node, return_inverse=True)
        parent = there // 2
        new_level = lv[parent] + 1
        new_doc = dc[parent] + (there % 2 << (tree.levels - new_level))
        new_bound = _sums(new_node, half_w * tree.best[new_level[new_node], half_s], len(there))
        shift = len(rest[0])
        nodes_q, level, doc, bound = np.append(rest[0], nq[parent]), np.append(rest[1], new_level), np.append(rest[2], new_doc), np.append(rest[3], new_bound)
        run_node, w, s, e = np.append(rest[4], new_node + shift), np.append(rest[5], half_w), np.append(rest[6], half_s), np.append(rest[7], half_e)


def _sums(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of consecutive groups, none of them empty."""
    return np.add.reduceat(value, np.searchsorted(group, np.arange(n))) if n else np.zeros(0, np.int64)


def _chosen(mask, nodes_q, level, doc, bound, run_node, w, s, e):
    """Some nodes, and their runs with the nodes' new numbers."""
    runs = mask[run_node]
    return nodes_q[mask], level[mask], doc[mask], bound[mask], (np.cumsum(mask) - 1)[run_node[runs]], w[runs], s[runs], e[runs]


def _ranks(group: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The place of each value within its group, the largest first."""
    order = np.lexsort((-value, group))
    g = group[order]
    first = np.searchsorted(g, np.arange(n))
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - first[g]
    return out


# -- tables

_TREE = ", ".join(f"{n} binary" for n in WaveletTree.NAMES) + ", shard long"


def totals(docs: DataFrame) -> tuple[int, int]:
    """The number of documents with a term, and of all terms."""

    def counted(batches):
        for batch in batches:
            n = np.diff(bounds_of_terms(batch.column("text"))[3])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["documents", "terms"])

    r = pick(docs, text="string").mapInArrow(counted, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


def trees(docs: DataFrame, documents: int, terms: int) -> DataFrame:
    """A row for each shard of the documents, built where they are read."""

    def built(batches):
        from pyspark import TaskContext

        shard, held, rows, size = TaskContext.get().partitionId() << 32, [], 0, 0

        def solve():
            nonlocal shard, held, rows, size
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy()
            tree = WaveletTree.build(ids, table.column("text"), documents, terms)
            shard, held, rows, size = shard + 1, [], 0, 0
            if tree:
                yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in tree.row()), pa.array([shard])], names=[*WaveletTree.NAMES, "shard"])

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + SHARD_BYTES // SHARD_ROWS // 8
            for a, b in spans_of(sizes, SHARD_BYTES // 4):
                if held and (size + sizes[a:b].sum() > SHARD_BYTES or rows + b - a > SHARD_ROWS):
                    yield from solve()
                held.append(batch.slice(a, b - a))
                rows, size = rows + b - a, size + int(sizes[a:b].sum())
        if held:
            yield from solve()

    return pick(docs, doc_id="long", text="string").mapInArrow(built, _TREE)


def query_terms(queries: DataFrame) -> DataFrame:
    """query (a number of its own), item_id, hashes and terms of each query, in the order of the text."""

    def rows(batches):
        for batch in batches:
            data, starts, ends, at = bounds_of_terms(batch.column("text"))
            h = term_hashes(data, starts, ends).view(np.int64)
            names = pa.array([_LOWER[data[a:b]].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
            ends_ = pa.array(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("item_id"), pa.ListArray.from_arrays(ends_, pa.array(h)), pa.ListArray.from_arrays(ends_, names)], names=["query", "item_id", "hashes", "terms"])

    own = pick(queries, item_id="long", text="string").withColumn("query", F.monotonically_increasing_id())
    return own.mapInArrow(rows, "query long, item_id long, hashes array<long>, terms array<binary>")


class Block:
    """Some queries: their distinct terms, and which terms each asks how often."""

    def __init__(self, table: pa.Table):
        self.number = table.column("query").to_numpy()
        many = pc.list_value_length(table.column("hashes")).to_numpy().astype(np.int64)
        flat = table.column("hashes").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        names = table.column("terms").combine_chunks().flatten().to_pylist()
        known: dict[bytes, int] = {}
        number = np.array([known.setdefault(x, len(known)) for x in names], np.int64)
        self.names, self.hashes = list(known), np.zeros(len(known), np.uint64)
        self.hashes[number] = flat
        pair, self.times = np.unique(np.repeat(np.arange(len(many)), many) * max(1, len(known)) + number, return_counts=True)
        self.query, self.term = pair // max(1, len(known)), pair % max(1, len(known))


def ranked(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest positive score for each query."""
    spark = docs.sparkSession
    documents, terms = totals(docs)
    asked = staged(query_terms(queries).where(F.size("hashes") > 0), "queries")
    # blocks of queries by the running number of their terms, over ranges of queries; the driver holds one block at a time
    weight = F.greatest(F.size("hashes"), F.lit(BLOCK_TERMS // BLOCK_ROWS)).cast("long").alias("weight")
    dealt = staged(asked.select("query", weight).repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "query").withColumn("part", F.spark_partition_id()), "blocks")
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = dealt.groupBy("part").agg(F.sum("weight").alias("n")).select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))  # a row for each range
    inner = F.coalesce(F.sum("weight").over(W.partitionBy("part").orderBy("query").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.withColumn("inner", inner).join(F.broadcast(bases), F.col("part") == F.col("p")).select(F.col("query").alias("of"), F.floor((F.col("base") + F.col("inner")) / BLOCK_TERMS).alias("block"))
    asked = staged(asked.join(dealt, F.col("query") == F.col("of")).select("query", "item_id", "hashes", "terms", "block"), "queries")
    blocks = (asked.agg(F.max("block")).first()[0] if terms else None) or 0
    forest = staged(trees(docs, documents, terms), "trees", RAW)
    path, found = shared_dir(spark, "found"), 0
    for k_block in range(blocks + 1 if terms else 0):
        table = asked.where(F.col("block") == k_block).select("query", "hashes", "terms").toArrow()
        if table.num_rows:
            searched(forest, Block(table), documents, k).write.mode("append").parquet(path)
            found += 1
    schema = "query long, doc_id long, score long"
    best = spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(asked.select(F.col("query").alias("of"), "item_id"), F.col("query") == F.col("of")).select("item_id", "rank", "doc_id", "score")


def searched(forest: DataFrame, block: Block, documents: int, k: int) -> DataFrame:
    """query, doc_id, score: up to k rows a query and task, the best ones among them."""
    spark = forest.sparkSession
    sent = spark.sparkContext.broadcast(block)  # BLOCK_TERMS terms

    def frequencies(batches):
        block, df = sent.value, np.zeros(len(sent.value.names), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                hashes, begin, word_at = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["begin"], np.int32), np.frombuffer(row["word_at"], np.int32)
                at = terms_at(hashes, row["words"], word_at, block.hashes, block.names)
                df += np.where(at >= 0, begin[at + 1] - begin[at], 0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    rows = forest.select("hashes", "begin", "words", "word_at").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row for each term of the block
    weights = np.zeros(len(block.names), np.int64)
    for term, df in rows:
        weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))

    def passed(first: bool, floors: np.ndarray) -> DataFrame:
        told = spark.sparkContext.broadcast((weights, floors))  # a number for each term and query

        def rows(batches):
            block, (weights, floors) = sent.value, told.value
            found = Found(len(block.number), k, floors)
            for batch in batches:
                for row in batch.to_pylist():
                    tree = WaveletTree.read(row)
                    at = terms_at(tree.hashes, tree.words, tree.word_at, block.hashes, block.names)
                    use = (at[block.term] >= 0) & (weights[block.term] > 0)
                    if use.any():
                        search(tree, block.query[use], at[block.term[use]], (weights[block.term] * block.times)[use], found)
            docs = pa.array(found.doc, mask=found.doc == _LAST)
            yield pa.RecordBatch.from_arrays([pa.array(block.number[found.query]), docs, pa.array(found.score)], names=["query", "doc_id", "score"])

        some = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0
        return forest.where(some if first else ~some).select(*WaveletTree.NAMES).mapInArrow(rows, "query long, doc_id long, score long")

    one = staged(passed(True, np.ones(len(block.number), np.int64)), "first")
    order = W.partitionBy("query").orderBy(F.col("score").desc())
    reached = one.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select("query", "score").collect()  # a row for each query of the block
    floors, at = np.ones(len(block.number), np.int64), {q: i for i, q in enumerate(block.number.tolist())}
    for q, score in reached:
        floors[at[q]] = score
    return one.unionByName(passed(False, floors))
