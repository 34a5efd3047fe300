"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small Hamming distance.

Candidates: of `BLOCKS` blocks of bits, at least BLOCKS - radius are equal in two fingerprints within the radius,
so fingerprints meet in a table for each choice of so many blocks. Only distinct fingerprints go there. A
bucket with more than `CELL` of them is dealt over cells, one for each pair of its parts, so every pair still
meets. Within a cell distances are counted bit-sliced: bit planes hold 64 fingerprints a word, carry-save counters
add one plane at a time for all of them, and a word is abandoned when its 64 distances all exceed the radius.
A cell gives the edges of a spanning forest, not its pairs. Components are found over these edges.

keep_one() also finds near copies whose fingerprints are farther apart: texts with an equal key of a few min-hashes of their shingles
are compared by the shingles, but for those that are of one class already. A longer text that only holds another one seldom shares a key with it.

Cases: a null or empty text has no words and fingerprint zero, linked like any other; fewer words than a shingle are
one shingle; a component's id is its smallest doc_id that isn't null; repeated rows are separate documents
of one component; an empty table gives an empty result; other columns are ignored or kept by keep_one().
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlab.llm.common import RAW, modest_batches, pick, pieces, row_key, rows_of, spans_of, staged, text_bytes
from permlab.llm.shingling import BLANK, LOWER, mixed, shingles
from permlab.operators.graph import components

BLOCKS = 4
CELL = 512
#: Bytes of text and shingles taken at a time.
STEP, SHINGLES = 1 << 21, 1 << 15

#: Keys of a text, and min-hashes in each: near copies of 0.8 share a key with probability 0.998, texts of 0.3 with 0.09.
BANDS, ROWS = 12, 4
#: Pairs that a set of shingles is sent for at once.
PARTNERS = 1024
_SEEDS = np.random.default_rng(2).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
#: Share of shingles that near copies have in common.
SIMILARITY = 0.8
#: Texts of a key, and bytes of their shingles, that a task holds at once; texts of other classes that it compares with them at once; shingles that
#: more than FEW of the held texts have are taken by COLUMNS.
CROSS, CROSS_BYTES, STRAYS, COLUMNS, FEW = 2048, 1 << 24, 256, 1024, 16


def fingerprints(texts: pa.Array, width: int = 3) -> np.ndarray:
    """Unsigned fingerprints of all texts."""
    data, offsets = text_bytes(texts)
    return np.concatenate([np.zeros(0, np.uint64), *(_fingerprints(data, offsets[a : b + 1], width) for a, b in spans_of(np.diff(offsets), STEP))])


def _fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    body, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(offsets) - 1
    solid = ~BLANK[body]
    if not solid.any():
        return np.zeros(n, np.uint64)
    edge = np.zeros(len(body), bool)  # where a text starts
    edge[offsets[:-1][offsets[:-1] < len(body)]] = True
    after = np.append(False, solid[:-1]) & ~edge  # the byte before is of a word of this text
    # a word and one blank after it are kept, so words stand one space apart; a word that ends its text has none
    kept = solid | after
    line = LOWER[body[kept]]
    at = np.cumsum(kept) - 1
    starts = at[solid & ~after]
    last = solid & ~np.append(solid[1:] & ~edge[1:], False)
    ends = at[last] + 1
    doc = np.searchsorted(offsets, np.flatnonzero(last), "right") - 1
    words = np.bincount(doc, minlength=n)
    begin = np.cumsum(words) - words
    # a shingle: from the start of a word to the end of the width-th word, or of the text's last word if it has fewer
    first = np.repeat(begin, np.maximum(words - width + 1, np.minimum(words, 1)))
    many = np.maximum(words - width + 1, np.minimum(words, 1))
    shift = np.cumsum(many) - many
    first = first + np.arange(len(first)) - np.repeat(shift, many)
    final = np.minimum(first + width, np.repeat(begin + words, many)) - 1
    lo, hi = starts[first], ends[final]
    view, digest = memoryview(line.tobytes()), xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[i:j], 42) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)), "<u8", len(lo))
    ones = np.zeros((n, 64), np.int64)
    of = np.repeat(np.arange(n), many)
    for a in range(0, len(h), SHINGLES):
        bits = np.unpackbits(h[a : a + SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = of[a : a + SHINGLES]
        edges = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        ones[own[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    return _signs(ones, many)


def _signs(ones: np.ndarray, many: np.ndarray) -> np.ndarray:
    """A bit is 1 if set in over half."""
    return np.packbits((2 * ones > many[:, None]).astype(np.uint8), axis=1, bitorder="little").reshape(-1).view("<u8").astype(np.uint64)


def close_pairs(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices i < j of all values within the radius, by bit-sliced counting."""
    n = len(values)
    words = -(-n // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")  # (64, words)
    flip = np.where(bits[:n].T.astype(bool), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))  # (64, n)
    query, word = np.nonzero(np.arange(words)[None, :] >= (np.arange(n) // 64)[:, None])
    counter = [np.zeros(len(query), np.uint64) for _ in range(int(radius).bit_length())]
    over = np.zeros(len(query), np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for p in range(64):
        carry = planes[p][word] ^ flip[p][query]
        for k, c in enumerate(counter):  # carry-save: every word adds its 64 bits to 64 counters
            counter[k], carry = c ^ carry, c & carry
        over |= carry
        exceeds = _exceeds(counter, radius)
        over |= exceeds
        if p % 8 == 7:
            stay = over != full
            if not stay.all():
                query, word, over = query[stay], word[stay], over[stay]
                counter = [c[stay] for c in counter]
    close = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    k, bit = np.nonzero(close)
    i, j = query[k], word[k] * 64 + bit
    good = (i < j) & (j < n)
    return i[good], j[good]


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """A bit for every counter that is above the radius."""
    above, equal = np.zeros_like(counter[0]) if counter else np.uint64(0), np.uint64(0xFFFFFFFFFFFFFFFF)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            above = above | (equal & counter[k])
            equal = equal & ~counter[k]
    return above


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For every one of n items the least item that it is connected with."""
    root = np.arange(n)
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    cut = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    while len(a):
        new = root.copy()
        new[a[cut]] = np.minimum(root[a[cut]], np.minimum.reduceat(root[b], cut))
        new = np.minimum(new, new[new])
        if np.array_equal(new, root):
            break
        root = new
    return root


def links(values: DataFrame, radius: int = 2, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """values: fp (long, distinct). Edges a, b that connect all that are within the radius."""
    if radius >= blocks:
        raise ValueError("more blocks than the radius are needed")
    bounds = [64 * k // blocks for k in range(blocks + 1)]

    def key(chosen: tuple[int, ...]):
        mask = 0
        for k in chosen:
            mask |= ((1 << (bounds[k + 1] - bounds[k])) - 1) << bounds[k]
        return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    tables = list(combinations(range(blocks), blocks - radius))
    rows = values.select("fp", F.posexplode(F.array(*map(key, tables))).alias("t", "key"))
    large = rows.groupBy("t", "key").count().where(F.col("count") > cell).select(F.col("t").alias("lt"), F.col("key").alias("lkey"), F.ceil(F.col("count") / cell).cast("int").alias("parts"))
    rows = rows.join(large, (F.col("t") == F.col("lt")) & (F.col("key") == F.col("lkey")), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("t", "key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "fp")
    where = ["t", "key", "x", "y"]

    def compare(batches):
        held: list[np.ndarray] = []
        last: tuple | None = None

        def solve(table: np.ndarray):
            fps = np.unique(table[:, 4])
            i, j = close_pairs(fps.view(np.uint64), radius)
            root = forest(len(fps), i, j)
            away = np.flatnonzero(root != np.arange(len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(fps[away]), pa.array(fps[root[away]])], names=["a", "b"])

        def runs(table: np.ndarray, final: bool):
            """Whole cells with company; what may go on is held."""
            new = np.append(True, (table[1:, :4] != table[:-1, :4]).any(axis=1))
            cut = np.append(np.flatnonzero(new), len(table))
            upto = len(table) if final else cut[-2]
            held[:] = [table[upto:]] if upto < len(table) else []
            sizes = np.diff(cut[cut <= upto])
            paired = np.repeat(sizes > 1, sizes)
            table, sizes = table[:upto][paired], sizes[sizes > 1]
            at = 0
            for a, b in spans_of(sizes, 192):
                n = int(sizes[a:b].sum())
                yield solve(table[at : at + n])
                at += n

        for batch in batches:
            table = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*where, "fp")], axis=1)
            if len(table):
                yield from runs(np.concatenate([*held, table]), False)
        if held:
            yield from runs(np.concatenate(held), True)

    return rows.repartition(*where).sortWithinPartitions(*where).mapInArrow(compare, "a long, b long")


def fingerprint_rows(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (long) of every document."""

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text"), width).view(np.int64))], names=["doc_id", "fp"])

    return pick(docs, doc_id="long", text="string").mapInArrow(rows, "doc_id long, fp long")


def classes(rows: DataFrame, radius: int = 2) -> DataFrame:
    """rows: doc_id, fp. Returns fp, root (the component's least fingerprint, or its own), component_id for every distinct fingerprint."""
    groups = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-groups")
    found = components(links(groups.select("fp"), radius))
    member = groups.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return staged(member.join(ids, "root").select("fp", "root", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    rows = staged(fingerprint_rows(docs, width), "simhash")
    found = classes(rows, radius).withColumnRenamed("fp", "of")
    return rows.join(found, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def band_keys(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all texts, BANDS each, and the number of each text: none if it has fewer words than a shingle.

    A key is made of ROWS min-hashes of the shingles, so two texts share one with the share of common shingles to the power of ROWS.
    """
    h, at = shingles(texts, width)
    many = np.diff(at)
    some = np.flatnonzero(many)
    least = np.zeros((len(some), BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS if len(some) else 0):
        least[:, k] = np.minimum.reduceat((h ^ _SEEDS[0, k]) * _SEEDS[1, k], at[:-1][some])
    keys = (mixed(least).reshape(len(some), BANDS, ROWS) * _SEEDS[1, :ROWS]).sum(axis=2) + np.arange(BANDS, dtype=np.uint64)
    return mixed(keys).reshape(-1), np.where(many > 0, BANDS, 0)


def _shingle_sets(rows: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """rows: text_id, row_key. text_id, own: the 32-bit hashes of the shingles of each of these texts, sorted."""

    def sets(batches):
        for batch in pieces(batches):
            s, at = shingles(batch.column("text"), width)
            own = [np.unique((s[a:b] >> np.uint64(32)).astype("<u4")).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("text_id"), pa.array(own, pa.binary())], names=["text_id", "own"])

    own = docs.select(row_key(docs).alias("of_row"), docs["text"].cast("string").alias("text"))
    own = own.join(rows.select("text_id", "row_key"), F.col("row_key") == F.col("of_row")).select("text_id", "text")
    # rows of docs that are copies of one another give equal sets
    return staged(own.mapInArrow(sets, "text_id long, own binary"), "simhash-sets", RAW).dropDuplicates(["text_id"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs: a, b (distinct). Those whose sets have that share in common.

    A set goes to each PARTNERS of its pairs as b once: they follow it in the order in which a task reads.
    """
    many = pairs.groupBy(F.col("b").alias("of")).agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    dealt = pairs.join(many, F.col("b") == F.col("of")).select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    dealt = staged(dealt, "simhash-dealt")
    of = sets.withColumnRenamed("fp", "of")
    heads = dealt.select("b", "part").distinct().join(of, F.col("b") == F.col("of")).select("b", "part", F.lit(None).cast("long").alias("a"), "own")
    others = dealt.join(of, F.col("a") == F.col("of")).select("b", "part", "a", "own")

    def compare(batches):
        head = np.zeros(0, "<u4")
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (a, own) in enumerate(zip(batch.column("a").to_pylist(), batch.column("own"), strict=True)):
                own = np.frombuffer(own.as_buffer(), "<u4")
                if a is None:
                    head = own.copy()
                else:
                    common = len(np.intersect1d(head, own, assume_unique=True))
                    good[k] = common > 0 and common >= similarity * (len(head) + len(own) - common)
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    where = ["b", "part"]
    return heads.unionByName(others).repartition(*where).sortWithinPartitions(*where, F.col("a").asc_nulls_first()).mapInArrow(compare, "a long, b long")


class _Cell:
    """Texts of one key, against which texts of other classes are held by an inverted index."""

    def __init__(self, owns: list[np.ndarray], roots: list[int]):
        self.roots, self.sizes = np.array(roots, np.int64), np.array([len(x) for x in owns], np.int64)
        line, owner = np.concatenate([np.zeros(0, "<u4"), *owns]), np.repeat(np.arange(len(owns)), self.sizes)
        order = np.argsort(line, kind="stable")
        line, self.owner = line[order], owner[order]
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, np.int64)
        self.words, self.bounds = line[first], np.append(first, len(line))

    def common(self, owns: list[np.ndarray]) -> np.ndarray:
        """Shingles that each text has in common with each of the cell: those that many of these hold by products, COLUMNS at a time, the others one by one."""
        line, owner = np.concatenate(owns), np.repeat(np.arange(len(owns)), [len(x) for x in owns])
        at = np.minimum(np.searchsorted(self.words, line), max(len(self.words) - 1, 0))
        held = self.words[at] == line if len(self.words) else np.zeros(len(line), bool)
        at, owner, n = at[held], owner[held], len(self.sizes)
        df = np.diff(self.bounds)
        few = df[at] <= FEW
        one, two = self._entries(at[few], df)
        out = np.bincount(owner[few][one] * n + two, minlength=len(owns) * n).reshape(len(owns), n).astype(np.float32)
        columns, at = np.unique(at[~few], return_inverse=True)
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[~few][order]
        for c in range(0, len(columns), COLUMNS):
            part = columns[c : c + COLUMNS]
            mine, other = np.zeros((n, len(part)), np.float32), np.zeros((len(owns), len(part)), np.float32)
            column, row = self._entries(part, df)
            mine[row, column] = 1
            a, b = np.searchsorted(at, [c, c + len(part)])
            other[owner[a:b], at[a:b] - c] = 1
            out += other @ mine.T
        return out

    def _entries(self, words: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of these words (by place) the texts of the cell that hold it."""
        counts = df[words]
        entry = np.repeat(self.bounds[words] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return np.repeat(np.arange(len(words)), counts), self.owner[entry]

    def links(self, owns: list[np.ndarray], roots: list[int], similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of roots that connect what is alike."""
        common, sizes, roots = self.common(owns), np.array([len(x) for x in owns], np.int64), np.array(roots, np.int64)
        alike = (common > 0) & (common >= similarity * (sizes[:, None] + self.sizes[None, :] - common.astype(np.float64))) & (roots[:, None] != self.roots[None, :])
        i, j = np.nonzero(alike)
        values, at = np.unique(np.concatenate([roots[i], self.roots[j]]), return_inverse=True)
        root = forest(len(values), at[: len(i)], at[len(i) :])
        away = np.flatnonzero(root != np.arange(len(values)))
        return values[away], values[root[away]]


def _between_classes(left: DataFrame, sets: DataFrame, similarity: float, cell: int = CROSS, most: int = CROSS_BYTES) -> DataFrame:
    """left: key, text_id, root. Edges a, b of roots: all texts of a key that are of different classes are compared, and those that are alike link their classes.

    Texts of a key are dealt over parts. Those that aren't of its most frequent class go to each of its parts, after the texts that are held there.
    """
    counted = left.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = counted.groupBy(F.col("key").alias("of")).agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("classes")).where("classes > 1")
    mixed_keys = staged(left.join(main, F.col("key") == F.col("of")).select("key", "text_id", "root", (F.col("root") != F.col("main.root")).alias("stray")), "simhash-mixed")
    need = mixed_keys.select(F.col("text_id").alias("t")).distinct()
    own = staged(sets.join(need, F.col("text_id") == F.col("t"), "left_semi").select(F.col("text_id").alias("t"), "own"), "simhash-held", RAW)
    sized = mixed_keys.join(own.select("t", F.octet_length("own").alias("bytes")), F.col("text_id") == F.col("t"))
    parts = F.greatest(F.ceil(F.count("*") / cell), F.ceil(F.sum("bytes") / most), F.lit(1)).cast("int")
    dealt = mixed_keys.join(sized.groupBy(F.col("key").alias("of")).agg(parts.alias("parts")), F.col("key") == F.col("of"))
    held = dealt.select("key", F.pmod(F.xxhash64("text_id"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("later"), "root", "text_id")
    asked = dealt.where("stray").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("later"), "root", "text_id")
    both = held.unionByName(asked).join(own, F.col("text_id") == F.col("t")).select("key", "part", "later", "root", "own")

    def compare(batches):
        now, bases, later, here = None, ([], []), ([], []), None

        def flush():
            nonlocal here
            here = here or _Cell(*bases)
            a, b = here.links(*later, similarity)
            later[0].clear(), later[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "part", "later", "root")]
            for key, part, after, root, own in zip(*columns, batch.column("own"), strict=True):
                if (key, part) != now:
                    if later[0]:
                        yield flush()
                    now, bases, here = (key, part), ([], []), None
                into = later if after else bases
                into[0].append(np.frombuffer(own.as_buffer(), "<u4").copy())
                into[1].append(root)
                if len(later[0]) == STRAYS:
                    yield flush()
        if later[0]:
            yield flush()

    where = ["key", "part"]
    return both.repartition(*where).sortWithinPartitions(*where, "later").mapInArrow(compare, "a long, b long")


def _near_links(rows: DataFrame, docs: DataFrame, near: DataFrame, width: int, similarity: float) -> DataFrame:
    """rows: row_key, text_id, fp, keys; near: edges a, b of fingerprints. These edges, and such that connect all texts with an equal key and that share of their shingles in common.

    All texts of a key are first compared with one of them, that which meets most others: of an original and its copies the original. That makes
    classes; then texts of a key that aren't of one class are compared with each other, so no link that would join two classes is left out. A text stands
    for its equals only, not for its fingerprint.
    """
    texts = rows.groupBy("text_id").agg(F.min(F.struct("row_key", "fp", "keys")).alias("r")).select("text_id", "r.*")
    parts = staged(texts.select("text_id", "fp", F.explode("keys").alias("key")), "simhash-keys")
    shared = parts.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("key", "of")
    left = parts.join(shared, F.col("key") == F.col("of")).select("key", "text_id", "fp", "size")
    meets = left.groupBy(F.col("text_id").alias("t")).agg(F.sum("size").alias("meets"))
    left = staged(left.join(meets, F.col("text_id") == F.col("t")).select("key", "text_id", "fp", "meets"), "simhash-shared")
    need = left.select(F.col("text_id").alias("t")).distinct()
    sets = staged(_shingle_sets(texts.join(need, F.col("text_id") == F.col("t"), "left_semi"), docs, width), "simhash-own", RAW)
    heads = left.groupBy(F.col("key").alias("of")).agg(F.max(F.struct("meets", "text_id", "fp")).alias("head"))
    tried = left.join(heads, F.col("key") == F.col("of")).where((F.col("text_id") != F.col("head.text_id")) & (F.col("fp") != F.col("head.fp")))
    tried = staged(tried.select(F.col("text_id").alias("a"), F.col("head.text_id").alias("b"), F.col("fp").alias("fp_a"), F.col("head.fp").alias("fp_b")).distinct(), "simhash-tried")
    found = verified(tried.select("a", "b"), sets.withColumnRenamed("text_id", "fp"), similarity).select(F.col("a").alias("x"), F.col("b").alias("y"))
    alike = tried.join(found, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    near = staged(near.unionByName(alike), "simhash-near")
    classed = left.join(components(near), F.col("fp") == F.col("node"), "left").select("key", "text_id", F.coalesce("root", "fp").alias("root"))
    return near.unionByName(_between_classes(staged(classed, "simhash-classed"), sets, similarity))


def keep_one(docs: DataFrame, width: int = 5, radius: int = 2, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with all columns of docs.

    Groups: texts whose fingerprints are within the radius, or that meet by a key of min-hashes and have at least that
    share of their shingles in common, and what is connected by these. Null doc_ids come after all others; of several
    texts with the smallest doc_id the one with the least digest stays, of rows with equal doc_id and text one.
    """

    def signed(batches):
        for batch in pieces(batches):
            fp, (keys, counts) = fingerprints(batch.column("text"), width), band_keys(batch.column("text"), width)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            own = pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), batch.column("text_id"), pa.array(fp.view(np.int64)), own], names=["doc_id", "row_key", "text_id", "fp", "keys"])

    modest_batches(docs.sparkSession)
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("row_key"), F.xxhash64(docs["text"].cast("string")).alias("text_id"), docs["text"].cast("string").alias("text"))
    rows = staged(own.mapInArrow(signed, "doc_id long, row_key string, text_id long, fp long, keys array<long>"), "simhash")
    values = rows.select("fp").distinct()
    found = components(_near_links(rows, docs, links(values, radius), width, similarity))
    member = rows.select("doc_id", "row_key", "fp").join(found, F.col("fp") == F.col("node"), "left").select("doc_id", "row_key", F.coalesce("root", "fp").alias("root"))
    # the smallest doc_id, nulls last, then the least digest; where more than one row has both, one of them
    chosen = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("r")).select(F.col("r.row_key").alias("row_key"))
    again = member.groupBy("row_key").count().where("count > 1").select("row_key")
    return rows_of(docs, staged(chosen.join(again.withColumn("again", F.lit(True)), "row_key", "left").select("row_key", F.coalesce("again", F.lit(False)).alias("again")), "simhash-chosen"))
