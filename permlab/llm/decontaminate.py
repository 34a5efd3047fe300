"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over SPAN consecutive words; the hash of a window under it takes the marked words only, so a
replaced word at a free position doesn't matter. Windows of the benchmark are hashed under every mask. Every window of
every document is hashed likewise and joined with them: a bitmap of the hashes passes the few that can match, a
search in the sorted hashes finds the items and offsets. A hit fixes how the item lies along the document. Diagonals with
too few agreeing words in all for any overlap are dropped at once; along the others the longest stretch of the item that agrees in at least MATCH of its words, and has at least
`least` words or all of the item's, is verified word by word (by 64-bit hashes of the words). Deleted or added words
split an overlap in two diagonals, each verified by itself.

Words are runs of letters and digits in lower case, so punctuation and spacing don't matter. Items of fewer than
SPAN words are padded windows: they are found where all their words stand in a row.

Scale: documents are read once per benchmark block and not shuffled. A block of at most BLOCK_WORDS words goes to the
executors; a larger benchmark is taken in several blocks. Only hits of a document are grouped.

Cases: null or empty texts have no words and no hits; items without words match nothing; repeated rows are separate
documents with equal results; other columns are ignored or kept by keep_clean().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlab.llm.common import pick, pieces, spans_of, text_bytes
from permlab.llm.passages import _dense

#: Marked positions over a span of 12 words. Every overlap of SPAN words or more that agrees in 0.8 of them, wherever the others lie,
#: has a window that one of these masks lets through (tests/llm/test_decontaminate.py goes through all).
MASKS = ("110101000011", "001000101111", "110011010001", "101100110001", "100111001100", "110100011100")
SPAN = 12
#: Share of words that agree in a verified overlap, and its least words.
MATCH, LEAST = 0.8, 13
#: Words that an item must have for keep_clean() to drop documents with it.
SHORTEST = 5
#: Words of the benchmark that go to the executors at once.
BLOCK_WORDS = 1 << 20
#: Bytes of text taken at a time; longest word that is hashed apart (longer ones by their first and last bytes and length).
STEP, LONGEST = 1 << 20, 64
#: Words of diagonals that are compared at a time.
COMPARED = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(11)
_POWER = _rng.integers(0, 1 << 63, 2 * LONGEST + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 1 << 63, (len(MASKS), SPAN), np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def lower_case(texts: pa.Array) -> pa.Array:
    """Lower case beyond ASCII too; only texts with other bytes take the slower way."""
    import pyarrow.compute as pc

    return pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the n + 1 word offsets of the texts, and where words start and end in their text's bytes."""
    data, offsets = text_bytes(lower_case(texts))
    hashes, counts, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in spans_of(np.diff(offsets), STEP):
        h, n, s, e = _hash(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hashes.append(h), counts.append(n), starts.append(s), ends.append(e)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(starts), np.concatenate(ends)


def _hash(body: np.ndarray, offsets: np.ndarray):
    n = len(offsets) - 1
    solid = _WORD[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid & (~np.append(False, solid[:-1]) | edge[:-1])) if len(body) else np.zeros(0, np.int64)
    end = np.flatnonzero(solid & (~np.append(solid[1:], False) | edge[1:])) + 1 if len(body) else start
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64), start, start
    size = end - start
    word = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    byte = body[np.repeat(start, size) + place]
    # beyond LONGEST, places repeat; the length is part of the hash
    h = np.add.reduceat((byte.astype(np.uint64) + np.uint64(1)) * _POWER[place % LONGEST], np.cumsum(size) - size)
    h = _mixed(h + size.astype(np.uint64) * _POWER[2 * LONGEST])
    doc = np.searchsorted(offsets, start, "right") - 1
    return h, np.bincount(doc, minlength=n), start - offsets[doc], end - offsets[doc]


def seed_hashes(words: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the window at every word that has SPAN words after it."""
    n = len(words) - SPAN + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k, on in enumerate(MASKS[mask]):
            if on == "1":
                out += words[k : k + n] * _PLACE[mask, k]
    return _mixed(out)


class Benchmark:
    """A block of items in hashed form, those of fewer words than `shortest` left out."""

    def __init__(self, items: list[tuple[int, str]], shortest: int = 1):
        ids = [i for i, _ in items]
        words, at, *_ = word_hashes(pa.array([x for _, x in items], pa.string()))
        self.items = [(i, words[a:b]) for i, a, b in zip(ids, at[:-1], at[1:], strict=True) if b - a >= max(1, shortest)]
        sizes = np.array([len(w) for _, w in self.items], np.int64)
        self.flat, self.sizes, self.begin = np.concatenate([words[:0], *(w for _, w in self.items)]), sizes, np.cumsum(sizes) - sizes
        keys, where = [], []
        self.short = {}
        for k, (_, w) in enumerate(self.items):
            if len(w) < SPAN:
                self.short.setdefault(len(w), []).append(k)
            for m in range(len(MASKS)):
                h = seed_hashes(w, m)
                keys.append(h)
                where.append(np.stack([np.full(len(h), k), np.arange(len(h))], 1))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.where = (np.concatenate(where) if where else np.zeros((0, 2), np.int64))[order]
        self.bits = max(16, min(26, int(len(self.keys)).bit_length() + 6))
        self.map = np.zeros(1 << self.bits, bool)
        self.map[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, least: int = LEAST, match: float = MATCH) -> np.ndarray:
        """Distinct (item, word of the texts at which the item's word 0 lies) with words enough that agree."""
        found = [np.zeros((0, 2), np.int64)]
        for m in range(len(MASKS)):
            h = seed_hashes(words, m)
            at = np.flatnonzero(self.map[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            h = h[at]
            lo, hi = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
            for a, b in spans_of(hi - lo, COMPARED):
                n = hi[a:b] - lo[a:b]
                row = np.repeat(lo[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(self.likely(words, self.where[row, 0], np.repeat(at[a:b], n) - self.where[row, 1], least, match))
        for size, ks in self.short.items():
            first = {}
            for k in ks:
                first.setdefault(int(self.items[k][1][0]), []).append(k)
            at = np.flatnonzero(np.isin(words, np.array(list(first), np.uint64)))
            found += [np.array([[k, p]]) for p in at.tolist() for k in first[int(words[p])] if np.array_equal(words[p : p + size], self.items[k][1])]
        return np.unique(np.concatenate(found), axis=0)

    def likely(self, words: np.ndarray, item: np.ndarray, p: np.ndarray, least: int, match: float) -> np.ndarray:
        """The distinct diagonals with as many agreeing words as the shortest overlap has."""
        item, p = np.divmod(np.unique((item << 40) + (p + (1 << 39))), 1 << 40)
        p -= 1 << 39
        lo, hi = np.maximum(p, 0), np.minimum(p + self.sizes[item], len(words))
        need = np.ceil(match * np.minimum(least, self.sizes[item]) - 1e-9)
        good = np.zeros(len(item), bool)
        for a, b in spans_of(hi - lo, COMPARED):
            n = hi[a:b] - lo[a:b]
            place = np.repeat(lo[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            agree = words[place] == self.flat[place + np.repeat(self.begin[item[a:b]] - p[a:b], n)]
            total = np.concatenate([[0], np.cumsum(agree)])
            ends = np.cumsum(n)
            good[a:b] = total[ends] - total[ends - n] >= need[a:b]
        return np.stack([item[good], p[good]], 1)


def stretch(agree: np.ndarray, least: int, match: float) -> tuple[int, int] | None:
    """The longest run [a, b) whose ends agree and that agrees in at least `match` of its words, if it has `least` words; the first of several."""
    run = _dense(agree.astype(bool), match)
    return run if run and run[1] - run[0] >= least else None


def overlaps(texts: pa.Array, bench: Benchmark, least: int = LEAST, match: float = MATCH) -> list[tuple[int, int, int, int, int, int, int]]:
    """(text, item_id, first word, words, agreeing words, first byte, end byte) of all verified overlaps."""
    words, at, starts, ends = word_hashes(texts)
    out = []
    found = bench.hits(words, least, match)
    if not len(found):
        return out
    for k, p in found.tolist():
        item_id, item = bench.items[k]
        # the diagonal may touch two texts; each text that it meets is verified by itself
        lo, hi = max(p, 0), min(p + len(item), len(words))
        for t in range(int(np.searchsorted(at, lo, "right")) - 1, int(np.searchsorted(at, hi - 1, "right"))):
            a, b = max(lo, int(at[t])), min(hi, int(at[t + 1]))
            if a >= b:
                continue
            agree = (words[a:b] == item[a - p : b - p]).astype(float)
            run = stretch(agree, min(least, len(item)), match)
            if run:
                x, y = a + run[0], a + run[1]
                out.append((t, item_id, x - int(at[t]), y - x, int(agree[run[0] : run[1]].sum()), int(starts[x]), int(ends[y - 1])))
    return sorted(set(out), key=lambda r: (r[0], str(r[1]), *r[2:]))


def blocks(benchmark: DataFrame, most: int = BLOCK_WORDS):
    """The benchmark's items in blocks of at most `most` words (or one item), streamed in the order of their ids."""
    held, size = [], 0
    for row in pick(benchmark, item_id="long", text="string").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        n = len(row.text.split())
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += n
    yield held


_FOUND = "doc_id long, item_id long, word long, words long, agree long, begin long, end long"


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, match: float = MATCH, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, word, words, agree, begin, end: a row for each verified overlap of a document with an item.

    begin and end are bytes of the lower-case text. Documents without an overlap have no row.
    """
    own = pick(docs, doc_id="long", text="string")
    found = None
    for items in blocks(benchmark, block_words):
        bench = docs.sparkSession.sparkContext.broadcast(Benchmark(items))

        def rows(batches, bench=bench):
            for batch in pieces(batches):
                names, texts = batch.column("doc_id"), batch.column("text")
                got = overlaps(texts, bench.value, least, match)
                columns = [[names[t].as_py() for t, *_ in got], *([r[k] for r in got] for k in range(1, 7))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "word", "words", "agree", "begin", "end"])

        part = own.mapInArrow(rows, _FOUND)
        found = part if found is None else found.unionByName(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, match: float = MATCH, block_words: int = BLOCK_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """The documents without a verified overlap, with all their columns. Items of fewer words than `shortest` condemn none: a word or two are everywhere."""
    for items in blocks(benchmark, block_words):
        bench = docs.sparkSession.sparkContext.broadcast(Benchmark(items, shortest))

        def rows(batches, bench=bench):
            for batch in pieces(batches):
                kept = np.ones(batch.num_rows, bool)
                kept[[t for t, *_ in overlaps(batch.column("text").cast(pa.string()), bench.value, least, match)]] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs
