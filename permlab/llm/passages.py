"""Near-duplicate passages across documents, by compact windows of min-hashes.

A text is the sequence of its shingles of WIDTH words. Under one hash function every passage has the position of its least
shingle; all passages of LEAST shingles or more with the same position c form a compact window (l, c, r): those that start
in [l, c] and end in [c, r]. Cutting a text at its least shingle, and the parts again (a Cartesian tree), gives all windows.

1. The windows of one function part the starts of all passages of LEAST shingles into intervals. An interval join of two
   functions' windows gives runs of starts with the same two least shingles: their signature, about 4 / LEAST of the number of
   shingles. There are three such pairs of functions. Longer passages contain these; step 3 finds how far they go.
2. Runs with the same signature meet by a shuffle; each is linked with that of the smallest doc_id. Keys that a thousandth of
   all documents hold, judged by a sixty-fourth of them, are dealt over SALTS groups with heads of their own, which are
   linked with the smallest head. Links of two documents near one diagonal whose runs follow each other are a candidate.
3. The candidate's shingles are cut out of both texts and compared: the longest stretch whose shingle sets have a
   Jaccard similarity of SIMILARITY or more is returned, if it has LEAST shingles on both sides.
4. A head may hold the two least shingles and not the passage. So the members of a key with a link whose candidate fails meet again:
   each whole passage of LEAST shingles in the runs of those that failed, by a digest, with all members that hold it. Here
   any head holds it for certain.
5. Near passages, too: runs whose candidate with their head has a verified stretch are a class with it, each other run is one of its own.
   All runs of a key that are of different classes are compared with each other, but for those with too few shingles in common; what
   is alike joins their classes.

Two documents that share an exact passage of LEAST shingles have all keys of its start in common; they are linked with one head
(or by two heads with a third) by verified stretches, or meet in step 4: they are always connected. Near passages have three chances
at each of their starts: (1 - (1 - j * j) ** 3), 0.95 at a similarity j of 0.8; those that share a key are linked with one head or meet in step 5.
Nothing here depends on the order or partitions of the table.

Result: doc_id, first word, words; of_id, its first word and words; similarity. doc_id > of_id. Links are stars, not all
pairs: documents that share a passage are connected through the head of a key.

Words are as in WORD, ASCII letters in lower case. Cases: null and short texts have no passages; a null doc_id takes no part;
rows with one doc_id count as one document and aren't compared with each other; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permlab.llm.common import RAW, pick, pieces, spans_of, staged
from permlab.llm.shingling import mixed, shingles
from permlab.llm.simhash import _Cell

WIDTH, LEAST, SIMILARITY = 5, 46, 0.8
#: Pairs of hash functions whose least shingles are a signature.
PAIRS = ((0, 1), (2, 3), (4, 5))
#: Links of diagonals up to so far apart are one candidate.
DRIFT = 16
#: A key is hot if this share of the documents hold it, and at least so many of those looked at, one of LOOK.
HOT, HOT_LEAST, LOOK, SALTS = 0.001, 78, 64, 64
#: Regions of heads are widened to multiples of so many shingles, so that members share them.
GRID = 64
#: Bits of the number of starts of a run; longer ones are several.
RUN_BITS = 18
#: Bytes of slices in a batch.
STEP = 1 << 20
#: Runs of a key that others meet in a task, others that meet them at a time, and shingles that a run is widened by on both sides.
CELL, STRAYS, BESIDE = 2048, 256, 12
#: Shingles of a run, at most, that is judged before it is compared.
LONG = 512
_rng = np.random.default_rng(31)
_SEED = _rng.integers(0, 1 << 63, 2 * len(PAIRS), np.uint64)
_BASE = _rng.integers(0, 1 << 63, 1, np.uint64)[0] * np.uint64(2) + np.uint64(1)


def windows(values: np.ndarray, at: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), r exclusive, of all compact windows of all texts; of equal least values the first is c.

    All parts of one level of all trees are cut at once, each at all places of its least value: a repeated line adds no levels.
    """
    lo, hi = at[:-1], at[1:]
    out = []
    while True:
        wide = hi - lo >= least
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            break
        size = hi - lo
        base = np.cumsum(size) - size
        row = np.repeat(lo - base, size) + np.arange(size.sum())
        part = values[row]
        hit = np.flatnonzero(part == np.repeat(np.minimum.reduceat(part, base), size))
        owner = np.searchsorted(base, hit, "right") - 1
        c, first = row[hit], np.append(True, owner[1:] != owner[:-1])
        start = np.where(first, lo[owner], np.append(0, c[:-1]) + 1)
        end = hi[owner]
        whole = end - start >= least
        out.append((start[whole], c[whole], end[whole]))
        lo, hi = np.concatenate([start, c[np.append(first[1:], True)] + 1]), np.concatenate([c, hi])
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out, strict=True) if out else ((), (), ())))  # type: ignore[return-value]


def runs(values: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Interval join of the windows of several functions: first and last start of all runs of starts whose passages of LEAST
    shingles have the same least shingles, and the places of these under every function."""
    firsts, lasts, least = [], [], []
    for v in values:
        lo, c, hi = windows(v, at)
        first, last = np.maximum(lo, c - LEAST + 1), np.minimum(c, hi - LEAST)
        order = np.argsort(first)
        firsts.append(first[order]), lasts.append(last[order]), least.append(c[order])
    start = np.unique(np.concatenate(firsts))
    own = [np.searchsorted(f, start, "right") - 1 for f in firsts]
    end = np.minimum.reduce([last[o] for last, o in zip(lasts, own, strict=True)]) if len(start) else start
    if len(start) > 1:
        end[:-1] = np.minimum(end[:-1], start[1:] - 1)
    return start, end, [c[o] for c, o in zip(least, own, strict=True)]


def _keyed(doc_ids: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, doc and place (first start, number of further ones, distance of the least shingle) of all runs.

    Runs that follow each other with one key, as in a repeated line, are one run.
    """
    s, at = shingles(texts)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keys, docs, places = [], [], []
    for n, pair in enumerate(PAIRS):
        v = [mixed(s ^ _SEED[k]) for k in pair]
        start, end, (c, other) = runs(v, at)
        key = mixed(mixed(v[0][c] + np.uint64(n)) + v[1][other]).view(np.int64)
        new = np.append(True, (key[1:] != key[:-1]) | (start[1:] != end[:-1] + 1) | (owner[start[1:]] != owner[start[:-1]]))[: len(key)]
        far = start - start[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] >> RUN_BITS - 1
        first = np.flatnonzero(new | np.append(False, far[1:] != far[:-1])[: len(key)])
        last = end[np.append(first[1:], len(key)) - 1] if len(key) else end
        key, start, c = key[first], start[first], c[first]
        keys.append(key)
        docs.append(doc_ids[owner[start]])
        places.append(((start - at[owner[start]]) << RUN_BITS + 6) | ((last - start) << 6) | (c - start))
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(places)


_ROW, _LINK = "key long, salt int, doc long, place long", "key long, doc long, place long, of long, of_place long"


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in schema.split(", ")])


def _stars(batches):
    """Links of the first row of every key and salt with its others, from sorted rows; the first rows of salted keys have no `of`.

    Other rows of the first row's document are linked with it too.
    """
    held = None  # the first row of the key that goes on
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.append(h, c) for h, c in zip(held, columns, strict=True)]
        key, salt, doc, place = columns
        new = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        rest = np.flatnonzero(~new)
        alone = np.flatnonzero(new & (salt > 0))
        alone = alone[alone > 0] if held is not None else alone
        at = np.concatenate([rest, alone])
        none = np.arange(len(at)) >= len(rest)
        of, of_place = (pa.array(c[head[at]], mask=none) for c in (doc, place))
        yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(doc[at]), pa.array(place[at]), of, of_place], names=["key", "doc", "place", "of", "of_place"])
        held = [c[head[-1:]] for c in columns]


def stars(rows: DataFrame, name: str) -> DataFrame:
    """rows: key, salt, doc, place. key, doc, place, of, of_place: each row of a key linked with that of the smallest doc, salted ones through the smallest of their salt."""

    def linked(part: DataFrame) -> DataFrame:
        return part.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc", "place").mapInArrow(_stars, _LINK)

    first = staged(linked(rows), name)
    heads = first.where("of IS NULL").select("key", F.lit(0).alias("salt"), "doc", "place")
    return staged(first.where("of IS NOT NULL").unionByName(linked(heads)), f"{name}-all")


def _salted(doc: np.ndarray) -> np.ndarray:
    return (mixed(doc.view(np.uint64)) % np.uint64(SALTS)).astype(np.int32) + 1


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, doc_id="long", text="string").where("doc_id IS NOT NULL")


def hot_keys(docs: DataFrame) -> np.ndarray:
    """Keys held by a share of HOT of the documents, judged by those with hash 0 modulo LOOK: at most 1 / HOT times the keys of a document."""

    def keys(batches):
        for batch in pieces(batches):
            key, doc, _ = _keyed(batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text"))
            yield _batch("key", np.unique(np.stack([key, doc]), axis=1)[0])

    some = _texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(LOOK)) == 0)
    least = max(HOT_LEAST, int(HOT * some.count()))
    found = some.mapInArrow(keys, "key long").groupBy("key").count().where(F.col("count") >= least)
    return np.sort(found.select("key").toArrow().column("key").to_numpy())


def links(docs: DataFrame) -> DataFrame:
    """key, doc, place, of, of_place: runs with the same signature, each with that of the smallest doc; the further ones of that doc too, where doc is `of`."""
    hot = docs.sparkSession.sparkContext.broadcast(hot_keys(docs))

    def keyed(batches):
        for batch in pieces(batches):
            key, doc, place = _keyed(batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text"))
            yield _batch(_ROW, key, np.where(np.isin(key, hot.value), _salted(doc), np.int32(0)), doc, place)

    return stars(_texts(docs).mapInArrow(keyed, _ROW), "links")


def _ends(prefix: str = "") -> tuple:
    """First start, last start and least shingle of a place column."""
    place = F.col(f"{prefix}place")
    start = F.shiftright(place, RUN_BITS + 6)
    return start, start + F.shiftright(place, 6).bitwiseAND((1 << RUN_BITS) - 1), start + place.bitwiseAND(63)


def candidates(links: DataFrame) -> DataFrame:
    """pair, doc, of, a, b, c, d: shingles [a, b) of doc may be near those of [c, d) of `of`."""
    (first, last, x), (of_first, of_last, y) = _ends(), _ends("of_")
    rows = links.where("doc <> of").select(
        "doc", "of", (x - y).alias("diagonal"), (first - LEAST).alias("a"), (last + 2 * LEAST).alias("b"),
        (F.floor((of_first - LEAST) / GRID) * GRID).alias("c"), (F.ceil((of_last + 2 * LEAST) / GRID) * GRID).alias("d"),
    )
    beside = W.partitionBy("doc", "of").orderBy("diagonal", "a")
    rows = rows.withColumn("apart", (F.col("diagonal") - F.lag("diagonal").over(beside) > DRIFT).cast("long"))
    rows = rows.withColumn("band", F.sum(F.coalesce("apart", F.lit(0))).over(beside.rowsBetween(W.unboundedPreceding, 0)))
    # stretches: links of a band in the order of their starts, until one starts after all before it have ended
    along = W.partitionBy("doc", "of", "band").orderBy("a", "b")
    rows = rows.withColumn("gap", (F.col("a") > F.coalesce(F.max("b").over(along.rowsBetween(W.unboundedPreceding, -1)), F.col("a"))).cast("long"))
    rows = rows.withColumn("stretch", F.sum("gap").over(along.rowsBetween(W.unboundedPreceding, 0)))
    found = rows.groupBy("doc", "of", "band", "stretch").agg(F.greatest(F.min("a"), F.lit(0)).alias("a"), F.max("b").alias("b"), F.greatest(F.min("c"), F.lit(0)).alias("c"), F.max("d").alias("d"))
    return found.select("doc", "of", "a", "b", "c", "d").distinct()


def _digests(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Digests of the LEAST shingles from each of the starts on."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(LEAST):
        out = out * _BASE + s[starts + k]
    return mixed(out)


def _covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """The numbers below n in any of the intervals [first, last]."""
    n = max(n, 0)
    inside = first < n
    first, last = first[inside], np.minimum(last[inside], n - 1)
    return np.flatnonzero(np.cumsum(np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(last + 1, minlength=n + 1)[: n + 1])[:n] > 0)


def _regions(first: np.ndarray, last: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """From and to of the shingles, of n, that runs and what lies beside them cover."""
    order = np.argsort(first, kind="stable")
    a, b = np.maximum(first[order] - LEAST, 0), np.minimum(np.maximum.accumulate(last[order] + 2 * LEAST), n)
    a, b = a[a < n], b[a < n]
    new = np.append(True, a[1:] > b[:-1])[: len(a)]
    return a[new], b[np.append(new[1:], True)[: len(b)]]


_CUT = "doc long, froms array<long>, ends array<long>, slices binary"


def _read_again(docs: DataFrame, links: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links: with a column `failed`; runs: doc, place. Digests of all passages in the runs of the links (key, salt, doc, place, failed), and the shingles of the regions of
    each document in which the runs lie (doc, froms, ends, slices: low halves, one region after another). Texts are read once for both."""
    side = lambda doc, prefix, failed: links.select(F.col(doc).alias("of_doc"), F.struct(_ends(prefix)[0].alias("first"), _ends(prefix)[1].alias("last"), failed.alias("failed")).alias("run"), F.lit(None).cast("struct<first:long,last:long>").alias("near"))
    near = runs.select(F.col("doc").alias("of_doc"), F.lit(None).cast("struct<first:long,last:long,failed:boolean>").alias("run"), F.struct(_ends()[0].alias("first"), _ends()[1].alias("last")).alias("near"))
    need = side("doc", "", F.col("failed")).unionByName(side("of", "of_", F.lit(False))).unionByName(near)
    need = need.groupBy("of_doc").agg(F.collect_set("run").alias("runs"), F.collect_set("near").alias("near"))  # runs of one document

    def read(batches):
        for batch in pieces(batches):
            s, at = shingles(batch.column("text"))
            names = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for t in range(batch.num_rows):
                own = s[at[t] : at[t + 1]]
                here, near = batch.column("runs")[t].values, batch.column("near")[t].values
                first, last, failed = (here.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                starts, bad = (_covered(first[x], last[x], len(own) - LEAST + 1) for x in (failed | True, failed))
                froms, ends = _regions(*(near.field(k).to_numpy(zero_copy_only=False) for k in range(2)), len(own))
                cut = np.concatenate([np.zeros(0, np.uint64), *(own[a:b] for a, b in zip(froms, ends, strict=True))]).astype(np.uint32).tobytes()
                n, m = len(starts), int(len(froms) > 0)
                none = lambda x, kind: pa.array([None] * n + [x] * m, kind)
                doc = np.full(n, names[t])
                digests = [pa.array(np.append(x, np.zeros(m, x.dtype))) for x in (_digests(own, starts).view(np.int64), _salted(doc), starts, np.isin(starts, bad))]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([*digests[:2], pa.array(np.full(n + m, names[t])), *digests[2:], none(froms, longs), none(ends, longs), none(cut, pa.binary())], names=["key", "salt", "doc", "place", "failed", "froms", "ends", "slices"])

    rows = _texts(docs).join(need, F.col("doc_id") == F.col("of_doc")).select("doc_id", "text", "runs", "near").mapInArrow(read, f"{_ROW}, failed boolean, {_CUT.split(', ', 1)[1]}")
    rows = staged(rows, "again")
    return rows.where("froms IS NULL").select("key", "salt", "doc", "place", "failed"), rows.where("froms IS NOT NULL").select("doc", "froms", "ends", "slices")


def exact(rows: DataFrame) -> DataFrame:
    """rows: key, salt, doc, place, failed of digests. doc_id, word, words, of_id, of_word, of_words, similarity (1.0) of passages in the runs of
    failed links that a document of smaller doc_id in any of the links holds exactly. The head of a key may hold it in any of its runs."""
    wanted = rows.where("failed").select(F.col("key").alias("f_key")).distinct()
    rows = rows.join(wanted, F.col("key") == F.col("f_key"), "left_semi").drop("failed")
    found = stars(rows, "exact").where("doc <> of").withColumn("diagonal", F.col("place") - F.col("of_place"))
    along = W.partitionBy("doc", "of", "diagonal").orderBy("place")
    found = found.withColumn("gap", (F.col("place") - F.lag("place").over(along) > LEAST).cast("long"))
    found = found.withColumn("stretch", F.sum(F.coalesce("gap", F.lit(0))).over(along.rowsBetween(W.unboundedPreceding, 0)))
    found = found.groupBy("doc", "of", "diagonal", "stretch").agg(F.min("place").alias("word"), (F.max("place") + LEAST + WIDTH - 1).alias("end"))
    words = (F.col("end") - F.col("word")).alias("words")
    return found.select(F.col("doc").alias("doc_id"), "word", words, F.col("of").alias("of_id"), (F.col("word") - F.col("diagonal")).alias("of_word"), words.alias("of_words"), F.lit(1.0).alias("similarity"))


def unsettled(links: DataFrame, failed: DataFrame) -> DataFrame:
    """key, doc, place, root, stray, parts: all runs of the keys of failed links, if three or more and not all of one class. A class (root) is a head with the runs whose links
    didn't fail, of a salted head with those of the head that it is linked with; stray: not of the class that most runs of the key are in."""
    names = ["key", "doc", "place", "of", "of_place"]
    node, head = F.xxhash64("doc", "place"), F.xxhash64("of", "of_place")
    keys = failed.select(F.col("key").alias("f_key")).distinct()
    alone = failed.select(*names, F.lit(True).alias("alone"))
    told = links.join(keys, F.col("key") == F.col("f_key"), "left_semi").join(alone, names, "left")
    told = staged(told.select(*names, F.when(F.col("alone") | (F.col("doc") == F.col("of")), node).otherwise(head).alias("root")), "told")  # a head's further runs are linked with none
    own = told.select("key", "doc", "place", "root")
    heads = told.select("key", F.col("of").alias("doc"), F.col("of_place").alias("place")).distinct().join(own, ["key", "doc", "place"], "left_anti").withColumn("root", node)
    runs = own.unionByName(heads)
    up = own.select(F.col("key").alias("u_key"), node.alias("node"), F.col("root").alias("up"))  # salted heads are linked themselves
    runs = staged(runs.join(up, (F.col("key") == F.col("u_key")) & (F.col("root") == F.col("node")), "left").select("key", "doc", "place", F.coalesce("up", "root").alias("root")), "classed")
    most = runs.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy(F.col("key").alias("m_key")).agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("classes"), F.sum("n").alias("runs"))
    most = most.where("classes > 1 AND runs > 2")
    return staged(runs.join(most, F.col("key") == F.col("m_key")).select("key", "doc", "place", "root", (F.col("root") != F.col("most.root")).alias("stray"), F.ceil(F.col("runs") / CELL).cast("int").alias("parts")), "runs")


def _least_distinct(core: np.ndarray, distinct: int) -> int:
    """The least number of distinct shingles among LEAST in a row. distinct: in all."""
    if distinct == len(core):
        return min(LEAST, len(core))
    order = np.argsort(core, kind="stable")
    before = np.full(len(core), -1)
    same = core[order[1:]] == core[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    # a shingle counts in the windows that start after its last occurrence
    starts = max(len(core) - LEAST + 1, 1)
    lo, hi = np.maximum(before + 1, np.arange(len(core)) - LEAST + 1), np.minimum(np.arange(len(core)), starts - 1) + 1
    lo, hi = lo[lo < hi], hi[lo < hi]
    return int(np.cumsum(np.bincount(lo, minlength=starts + 1) - np.bincount(hi, minlength=starts + 1))[:starts].min())


def between(runs: DataFrame, cuts: DataFrame, least: int, similarity: float) -> DataFrame:
    """Verified stretches (as in the result) that join classes: all runs of a key that are of different classes are compared with each other.

    Runs of a key are dealt over parts; strays go to each part, after the runs that are held there.
    """
    asked = runs.groupBy("doc").agg(F.collect_list(F.struct("key", "place", "root", "stray", "parts")).alias("runs")).withColumnRenamed("doc", "r_doc")  # runs of one document
    both = cuts.join(asked, F.col("doc") == F.col("r_doc")).select("doc", "froms", "ends", "slices", "runs")
    schema = "key long, part int, later boolean, stray boolean, root long, doc long, region long, at long, core binary"

    def cores(batches):
        for batch in batches:
            for t in range(batch.num_rows):
                doc, froms, ends = batch.column("doc")[t].as_py(), *(batch.column(c)[t].values.to_numpy(zero_copy_only=False) for c in ("froms", "ends"))
                own, base = np.frombuffer(batch.column("slices")[t].as_buffer(), np.uint32), np.cumsum(ends - froms) - (ends - froms)
                here = batch.column("runs")[t].values
                key, place, root, stray, parts = (here.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                first = place >> (RUN_BITS + 6)
                last = first + (place >> 6 & (1 << RUN_BITS) - 1)
                k = np.searchsorted(froms, first, "right") - 1
                some = (k >= 0) & (first + LEAST <= ends[k]) if len(froms) else np.zeros(len(key), bool)  # a run may be another text's of this doc_id
                key, place, root, stray, parts, first, last, k = (x[some] for x in (key, place, root, stray, parts, first, last, k))
                a, b = np.maximum(first - BESIDE, froms[k]), np.minimum(last + LEAST + BESIDE, ends[k])
                core = np.array([own[x:y].tobytes() for x, y in zip(base[k] + a - froms[k], base[k] + b - froms[k], strict=True)], object)
                part = mixed(np.full(len(key), doc).view(np.uint64) + place.view(np.uint64)) % parts.astype(np.uint64)
                # held once, and strays asked for in every part
                row = np.concatenate([np.arange(len(key)), np.repeat(np.flatnonzero(stray), parts[stray])])
                later = np.arange(len(row)) >= len(key)
                each = np.concatenate([part.astype(np.int32), *(np.arange(n, dtype=np.int32) for n in parts[stray])])
                columns = [key[row], each, later, stray[row], root[row], np.full(len(row), doc), froms[k[row]], a[row]]
                for x, y in spans(row, core):
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[x:y]) for c in columns), pa.array(core[row[x:y]], pa.binary())], names=[c.split()[0] for c in schema.split(", ")])

    def spans(row, core):
        return spans_of(np.array([len(core[r]) for r in row], np.int64), STEP)

    where = ["key", "part"]
    dealt = both.mapInArrow(cores, schema).repartition(*where).sortWithinPartitions(*where, "later", "doc", "at")
    found = staged(dealt.mapInArrow(lambda batches: _meet(batches, least, similarity), _MET), "met")
    # how far they go, in the regions
    pairs = found.select("doc_id", "region", "of_id", "of_region").distinct()
    one, other = (cuts.select(*[F.col(c).alias(f"{c}{k}") for c in ("doc", "froms", "ends", "slices")]) for k in (0, 1))
    far = pairs.join(one, F.col("doc_id") == F.col("doc0")).join(other, F.col("of_id") == F.col("doc1"))

    def widen(batches):
        def region(batch, k: int, t: int, start: int):
            froms, ends = (batch.column(f"{c}{k}")[t].values.to_numpy(zero_copy_only=False) for c in ("froms", "ends"))
            own, size = np.frombuffer(batch.column(f"slices{k}")[t].as_buffer(), np.uint32), ends - froms
            i = int(np.searchsorted(froms, start))
            base = int(size[:i].sum())
            return own[base : base + int(size[i])] if i < len(froms) and froms[i] == start else own[:0]

        for batch in batches:
            out = []
            for t in range(batch.num_rows):
                doc, p, of, q = (batch.column(c)[t].as_py() for c in ("doc_id", "region", "of_id", "of_region"))
                for a, b, c, d, j in compare(region(batch, 0, t, p), region(batch, 1, t, q), least, similarity):
                    out.append((doc, p + a, b - a + WIDTH - 1, of, q + c, d - c + WIDTH - 1, j))
            yield _listed(out, RESULT)

    wide = staged(far.mapInArrow(widen, "doc_id long, word long, words long, of_id long, of_word long, of_words long, similarity double"), "widened")
    return wide.unionByName(found.select(*RESULT).join(*_within(wide))).distinct()


def _within(held: DataFrame) -> tuple[DataFrame, object, str]:
    """What to join with, and how, to leave out stretches that lie in those of `held`."""
    held = held.select(F.col("doc_id").alias("v_doc"), F.col("of_id").alias("v_of"), F.col("word").alias("va"), F.col("words").alias("vn"), F.col("of_word").alias("vc"), F.col("of_words").alias("vm"))
    inside = (F.col("doc_id") == F.col("v_doc")) & (F.col("of_id") == F.col("v_of")) & F.expr("word >= va AND word + words <= va + vn AND of_word >= vc AND of_word + of_words <= vc + vm")
    return held, inside, "left_anti"


def _listed(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == "similarity" else pa.int64()) for k, c in zip(names, columns, strict=True)], names=names)


class _Places:
    """The shingles of many runs by their place, to tell at once which of them compare() needn't see: those without a dense run of hits on both sides. Long ones are not judged."""

    def __init__(self, words: np.ndarray, cores: list[np.ndarray]):
        sizes = np.array([len(x) for x in cores], np.int64)
        self.words, self.long = words, sizes > LONG
        self.number = np.zeros((len(cores), int(sizes[~self.long].max(initial=0))), np.int32)
        for k in np.flatnonzero(~self.long):
            self.number[k, : sizes[k]] = np.searchsorted(words, cores[k]) + 1
        self.own = np.zeros(len(words) + 1, np.int32)

    def dense(self, core: np.ndarray, among: np.ndarray, least: int, similarity: float) -> np.ndarray:
        if len(core) > LONG or not len(self.words):
            return np.ones(len(among), bool)
        at = np.minimum(np.searchsorted(self.words, core), len(self.words) - 1)
        mine = np.where(self.words[at] == core, at + 1, 0)
        some = np.unique(mine[mine > 0])
        self.own[some] = np.arange(1, len(some) + 1)
        good = self.long[among].copy()
        judged = np.flatnonzero(~good)
        share = 2 * similarity / (1 + similarity)
        for a in range(0, len(judged), STRAYS):
            part = judged[a : a + STRAYS]
            there = self.own[self.number[among[part]]]
            held = np.zeros((len(part), len(some) + 1), bool)
            held[np.arange(len(part))[:, None], there] = True
            held[:, 0] = False
            good[part] = _dense_anywhere(there > 0, share, least) & _dense_anywhere(held[:, self.own[mine]], share, least)
        self.own[some] = 0
        return good


def _dense_anywhere(hits: np.ndarray, share: float, least: int) -> np.ndarray:
    """Whether a line has a run of so many places or more with that share of hits."""
    if hits.shape[1] < least:
        return np.zeros(len(hits), bool)
    total = np.zeros((len(hits), hits.shape[1] + 1))
    np.cumsum(hits - share, axis=1, out=total[:, 1:])
    return (total[:, least:] >= np.minimum.accumulate(total, axis=1)[:, : hits.shape[1] + 1 - least] - 1e-9).any(axis=1)


def _meet(batches, least: int, similarity: float):
    """Stretches of the runs of each key and part, held ones first, that are alike and of different classes; of each two classes one pair, that with most in common first."""
    now, held, asked, cell, places, root = None, [], [], None, None, {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def sides(runs):
        own = [np.frombuffer(r[-1], np.uint32) for r in runs]
        sets = [np.unique(x) for x in own]
        few = np.array([_least_distinct(x, len(y)) for x, y in zip(own, sets, strict=True)], np.int64)
        return sets, few, *(np.array([r[k] for r in runs], kind) for k, kind in enumerate((bool, np.int64, np.int64)))

    def flush():
        nonlocal cell, places
        if cell is None:
            cell = sides(held)
            cell = (_Cell(cell[0], cell[3].tolist()), *cell[1:])
            places = _Places(cell[0].words, [np.frombuffer(r[-1], np.uint32) for r in held])
        sets, few, _, roots, docs = sides(asked)
        common = cell[0].common(sets)
        # stretches of so many distinct shingles have this many in common
        need = np.ceil(similarity / (1 + similarity) * (few[:, None] + cell[1]) - 1e-9)
        good = (common >= need) & (common > 0) & (docs[:, None] != cell[4]) & (roots[:, None] != cell[3]) & (~cell[2] | (docs[:, None] > cell[4]))
        out = []
        for i in np.flatnonzero(good.any(axis=1)):
            j = np.flatnonzero(good[i])
            good[i, j] = places.dense(np.frombuffer(asked[i][-1], np.uint32), j, least, similarity)
        i, j = np.nonzero(good)
        for k in np.lexsort((j, -common[i, j], i)):
            x, y = asked[i[k]], held[j[k]]
            if find(x[1]) == find(y[1]):
                continue
            one, other = (x, y) if x[2] > y[2] else (y, x)
            alike = compare(np.frombuffer(one[-1], np.uint32), np.frombuffer(other[-1], np.uint32), least, similarity)
            if alike:
                root[find(x[1])] = find(y[1])
            for a, b, c, d, s in alike:
                out.append((one[2], one[4] + a, b - a + WIDTH - 1, other[2], other[4] + c, d - c + WIDTH - 1, s, one[3], other[3]))
        asked.clear()
        return _listed(out, [c.split()[0] for c in _MET.split(", ")])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "part", "later", "stray", "root", "doc", "region", "at", "core")]
        for key, part, later, *run in zip(*columns, strict=True):
            if (key, part) != now:
                if asked:
                    yield flush()
                now, held, cell, root = (key, part), [], None, {}
            (asked if later else held).append(run)
            if len(asked) == STRAYS:
                yield flush()
    if asked:
        yield flush()


_MET = "doc_id long, word long, words long, of_id long, of_word long, of_words long, similarity double, region long, of_region long"


def compare(one: np.ndarray, other: np.ndarray, least: int = LEAST, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """(a, b, c, d, similarity) of the verified stretches one[a:b] and other[c:d]; what lies beside a stretch is searched again."""
    out, todo = [], [(0, len(one))]
    share = 2 * similarity / (1 + similarity)  # of the shingles of either side, if both have as many
    names, number = np.unique(np.concatenate([one, other]), return_inverse=True)
    one, other = number[: len(one)], number[len(one) :]

    def seen(part: np.ndarray) -> np.ndarray:
        marks = np.zeros(len(names), bool)
        marks[part] = True
        return marks

    there = seen(other)
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        mine = one[lo:hi]
        hits, last = there[mine], None
        for dense in (share, (1 + share) / 2, 1.0):  # a stretch that fails may hold a denser one that doesn't
            run = _dense(hits, dense)
            if run is None or run[1] - run[0] < least:
                break
            # the other side: where its shingles are those of the stretch, as densely; then this side by that
            c, d = _dense(seen(mine[run[0] : run[1]])[other], dense)
            run = _dense(seen(other[c:d])[mine], dense)
            a, b = last = lo + run[0], lo + run[1]
            x, y = seen(one[a:b]), seen(other[c:d])
            j = int((x & y).sum()) / int((x | y).sum())
            if j >= similarity and min(b - a, d - c) >= least:
                out.append((a, b, c, d, j))
                break
        if last is not None:
            todo += [(lo, last[0]), (last[1], hi)]
    return sorted(out)


def _dense(hits: np.ndarray, share: float) -> tuple[int, int] | None:
    """The longest run, from hit to hit, with that share of hits; the first of several. By records of the excess, low ones as starts."""
    if not hits.any():
        return None
    total = np.concatenate([[0.0], np.cumsum(hits - share)])
    high = np.maximum.accumulate(np.where(hits, total[1:], -np.inf)[::-1])  # from the end: the highest excess of an end so far
    at = np.flatnonzero(hits)
    low = total[at]
    at = at[low < np.append(np.inf, np.minimum.accumulate(low)[:-1])]  # any other start has one before it that goes as far
    last = len(hits) - 1 - np.searchsorted(high, total[at] - 1e-9)
    k = int(np.argmax(last - at))
    return int(at[k]), int(last[k]) + 1


RESULT = ["doc_id", "word", "words", "of_id", "of_word", "of_words", "similarity"]


def near_duplicate_passages(docs: DataFrame, least: int = LEAST, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, word, words, of_id, of_word, of_words, similarity of all verified links. least: LEAST or more; similarity: SIMILARITY or more."""
    linked = links(docs)
    found = staged(candidates(linked).withColumn("pair", F.xxhash64("doc", "of", "a", "b", "c", "d")), "candidates")
    first = staged(_verified(docs, found, least, similarity), "verified")
    # keys with a link whose candidate failed
    failed = found.join(first.select("pair").distinct(), "pair", "left_anti").select(F.col("doc").alias("f_doc"), F.col("of").alias("f_of"), F.col("a").alias("fa"), F.col("b").alias("fb"))
    start = _ends()[0]
    within = (F.col("doc") == F.col("f_doc")) & (F.col("of") == F.col("f_of")) & (start >= F.col("fa")) & (start < F.col("fb"))
    bad = staged(linked.join(failed, within, "left_semi"), "failed")
    keys = bad.select(F.col("key").alias("f_key")).distinct()
    left = unsettled(linked, bad)
    digests, cuts = _read_again(docs, linked.join(keys, F.col("key") == F.col("f_key"), "left_semi").withColumn("failed", F.lit(False)).unionByName(bad.withColumn("failed", F.lit(True))), left)
    held = staged(first.select(*RESULT).unionByName(exact(digests).join(*_within(first))), "held")
    return held.unionByName(between(left, cuts, least, similarity).join(*_within(held))).distinct()


def _verified(docs: DataFrame, found: DataFrame, least: int, similarity: float) -> DataFrame:
    """pair and the verified stretches of candidates."""
    place = F.xxhash64("of_doc", "from", "to").alias("cut")
    side = lambda doc, a, b: found.select(F.col(doc).alias("of_doc"), F.col(a).alias("from"), F.col(b).alias("to"))
    need = side("doc", "a", "b").unionByName(side("of", "c", "d")).distinct().select("of_doc", "from", "to", place)
    need = need.groupBy("of_doc").agg(F.collect_list(F.struct("cut", "from", "to")).alias("cuts"))  # places of one document, on a grid

    def cut(batches):
        for batch in pieces(batches):
            s, at = shingles(batch.column("text"))
            cuts, froms, slices, size = [], [], [], 0
            for k, places in enumerate(batch.column("cuts").to_pylist()):
                own = s[at[k] : at[k + 1]].astype(np.uint32)  # low halves: two unlike shingles are taken for one in 4e9 comparisons
                for x in places:
                    cuts.append(x["cut"]), froms.append(x["from"]), slices.append(own[x["from"] : x["to"]].tobytes())
                    size += len(slices[-1])
                    if size > STEP:
                        yield _slices(cuts, froms, slices)
                        cuts, froms, slices, size = [], [], [], 0
            yield _slices(cuts, froms, slices)

    slices = _texts(docs).join(need, F.col("doc_id") == F.col("of_doc")).select("text", "cuts").mapInArrow(cut, "cut long, from long, slice binary")
    slices = staged(slices, "slices", RAW)
    part = lambda k: slices.select(F.col("cut").alias(f"cut{k}"), F.col("from").alias(f"from{k}"), F.col("slice").alias(f"slice{k}"))
    both = found.join(part(0), F.xxhash64("doc", "a", "b") == F.col("cut0")).join(part(1), F.xxhash64("of", "c", "d") == F.col("cut1"))

    def verify(batches):
        for batch in batches:
            out = []
            for pair, doc, of, p, one, q, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b, c, d, j in compare(np.frombuffer(one, np.uint32), np.frombuffer(other, np.uint32), least, similarity):
                    out.append((pair, doc, p + a, b - a + WIDTH - 1, of, q + c, d - c + WIDTH - 1, j))
            yield _listed(out, ["pair", *RESULT])

    both = both.select("pair", "doc", "of", "from0", "slice0", "from1", "slice1")
    return both.mapInArrow(verify, "pair long, doc_id long, word long, words long, of_id long, of_word long, of_words long, similarity double")


def _slices(cuts: list, froms: list, slices: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cuts, pa.int64()), pa.array(froms, pa.int64()), pa.array(slices, pa.binary())], names=["cut", "from", "slice"])
