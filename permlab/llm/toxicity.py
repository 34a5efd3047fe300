"""Toxicity by noisy-channel deobfuscation and a classifier of the restored text.

1. A character trigram model is counted over the letters of all documents, into hashed tables of a fixed size.
2. A text's spans that may be disguised (letters next to signs that stand for letters, letters spelled out with
   separators, letters repeated three times or more) become lattices: each sign is itself or a letter that
   it resembles, a separator is kept or dropped, a repeated letter is kept or dropped, each at a cost. Viterbi decoding
   under the model finds the likeliest reading, which takes the span's place. Elsewhere a lattice has one path.
3. The restored text is scored by a logistic model over the presence of word beginnings, which a long text
   doesn't dilute. They are learned from a bounded sample of labelled rows (FIT_ROWS of each label).

Cases: a null text is empty; an empty text gets the score of no evidence; without labels of both kinds every score
is 0; repeated rows get equal scores; other columns are ignored or kept by keep_clean().
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permlab.llm.common import fresh, pick, pieces, spans_of, with_fields
from permlab.llm.labelled import held_out, sample

#: Labelled documents of each label that the classifier is fitted on, at most.
FIT_ROWS = 2500
#: Bins of each count table of the character model.
BINS = 1 << 18
#: Tasks that add up the tables of all others.
MERGERS = 8
#: Characters taken at a time.
STEP = 1 << 19
#: Word beginnings the classifier knows, at most, and their lengths.
FEATURES, LENGTHS = 1500, (3, 4, 5, 6, 8, 10)

# The signs that stand for letters, and the letters.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Signs that are punctuation where no letter or digit follows.
WEAK = "!|(¡"
SEPARATORS = " .-_*~,/\\"
#: Costs in nats: reading a sign as a letter or as itself, dropping or keeping a separator or a repeated letter.
AS_LETTER, AS_SIGN, DROP_SEPARATOR, KEEP_SEPARATOR, DROP_REPEAT, KEEP_REPEAT = 0.7, 9.0, 0.5, 2.0, 0.4, 3.0

_LETTER = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)
_SIGN = np.zeros(1 << 16, bool)
_SIGN[[ord(c) for c in SIGNS]] = True
_STRONG = _SIGN.copy()
_STRONG[[ord(c) for c in WEAK]] = False
_DIGIT = np.zeros(1 << 16, bool)
_DIGIT[48:58] = True
_SEPARATOR = np.zeros(1 << 16, bool)
_SEPARATOR[[ord(c) for c in SEPARATORS]] = True
_M1, _M2, _M3 = 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35


def points(text: str) -> np.ndarray:
    """Code points; those beyond the first plane become one that is no letter."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(x < 1 << 16, x, 0)


def lowered(texts: list[str | None]) -> list[str]:
    return [(x or "").lower() for x in texts]


# -- the character model


def _bin(a, b, c):
    return ((a * _M1) ^ (b * _M2) ^ (c * _M3)) * 2654435769 >> 13 & (BINS - 1)


def count_letters(texts: list[str], pairs: np.ndarray, triples: np.ndarray) -> None:
    """Adds the letters, pairs and triples of lower-case texts; all but letters is a blank."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for a, b in spans_of(sizes, STEP):
        x = points("  ".join(["", *texts[a:b], ""]))
        x = np.where(_LETTER[x], x, 32).astype(np.int64)
        x = x[np.append(True, (x[1:] != 32) | (x[:-1] != 32))]  # blanks in a row are one
        pairs += np.bincount(_bin(0, x[:-1], x[1:]), minlength=BINS)
        pairs += np.bincount(_bin(1, 0, x), minlength=BINS)
        triples += np.bincount(_bin(x[:-2], x[1:-1], x[2:]), minlength=BINS)


class Letters:
    """log P(c | a, b) of an interpolated trigram model over hashed counts."""

    def __init__(self, pairs: np.ndarray, triples: np.ndarray):
        self.pairs, self.triples = pairs, triples
        self.total = float(pairs.sum()) / 2 or 1.0
        self.known: dict[tuple[int, int, int], float] = {}

    def __call__(self, a: str, b: str, c: str) -> float:
        key = (ord(a), ord(b), ord(c))
        if key not in self.known:
            if len(self.known) > 1 << 18:
                self.known.clear()
            x, y, z = (k if k < 1 << 16 else 0 for k in key)
            three, two = float(self.triples[_bin(x, y, z)]), float(self.pairs[_bin(0, y, z)])
            context = float(self.pairs[_bin(0, x, y)])
            one, before = float(self.pairs[_bin(1, 0, z)]), float(self.pairs[_bin(1, 0, y)])
            share = context / (context + 20.0)
            p = share * (three / max(context, three, 1.0)) + (1 - share) * (0.9 * two / max(before, two, 1.0) + 0.1 * one / self.total) + 1e-7
            self.known[key] = math.log(p)
        return self.known[key]


# -- the lattice


def readings(span: str) -> list[list[tuple[str, float]]]:
    """For each character of a span what may stand for it, with costs."""
    out = []
    last = max((i for i, c in enumerate(span) if c.isalnum()), default=-1)
    for i, c in enumerate(span):
        if c in SIGNS and (i < last or c not in WEAK):
            out.append([(x, AS_LETTER) for x in SIGNS[c]] + [(" ", AS_SIGN)])
        elif c.isalpha():
            run = i > 0 and span[i - 1] == c and ((i > 1 and span[i - 2] == c) or (i + 1 < len(span) and span[i + 1] == c))
            out.append([(c, KEEP_REPEAT), ("", DROP_REPEAT)] if run else [(c, 0.0)])
        elif c in SEPARATORS and 0 < i < len(span) - 1:
            out.append([("", DROP_SEPARATOR), (" ", KEEP_SEPARATOR)])
        else:
            out.append([(" ", 0.0)])
    return out


def decode(span: str, model: Letters) -> str:
    """The likeliest reading of a span, by Viterbi over states of the last two characters."""
    states: dict[tuple[str, str], tuple[float, str]] = {(" ", " "): (0.0, "")}
    for options in [*readings(span), [(" ", 0.0)]]:
        after: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (cost, text) in states.items():
            for c, price in options:
                if not c or (c == " " and b == " "):
                    state, total, longer = (a, b), cost + price, text
                else:
                    state, total, longer = (b, c), cost + price - model(a, b, c), text + c
                if state not in after or (total, longer) < after[state]:
                    after[state] = (total, longer)
        states = after
    return min(states.values())[1].strip()


def suspects(x: np.ndarray) -> list[tuple[int, int]]:
    """Spans (a, b) of code points whose lattice has more than one path. Spans have no line feed in them."""
    n = len(x)
    if n < 3:
        return []
    letter, sign, blank = _LETTER[x], _SIGN[x], (x == 32) | ((x >= 9) & (x <= 13))
    mark = np.zeros(n, bool)
    # a sign between letters; one at the start of a word; a digit or one of some signs at its end
    mark[1:-1] = sign[1:-1] & (letter[2:] & (letter[:-2] | blank[:-2] | sign[:-2]) | letter[:-2] & _STRONG[x[1:-1]] & sign[2:])
    mark[0] = sign[0] & letter[1]
    tail = _DIGIT[x] | (x == 64) | (x == 36) | (x == 43)
    mark[1:] |= tail[1:] & letter[:-1]
    # a letter three times
    mark[2:] |= letter[2:] & (x[2:] == x[1:-1]) & (x[1:-1] == x[:-2])
    near = np.flatnonzero(mark)
    spans: list[tuple[int, int]] = []
    if len(near):
        stop = np.concatenate([[-1], np.flatnonzero(blank), [n]])
        k = np.unique(np.searchsorted(stop, near, "left"))
        spans += zip((stop[k - 1] + 1).tolist(), stop[k].tolist(), strict=True)
    # letters or signs that stand alone, four or more with one separator between each two
    single = letter | sign
    sep = np.append(True, ~single[:-1]) & single & np.append(~single[1:], True)
    alone = np.flatnonzero(sep)
    if len(alone) > 3:
        joined = (np.diff(alone) == 2) & _SEPARATOR[x[np.minimum(alone[:-1] + 1, n - 1)]]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= 3:
                spans.append((int(alone[a]), int(alone[b]) + 1))
    spans.sort()
    merged: list[tuple[int, int]] = []
    for a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


class Restorer:
    """Restores lower-case texts; all but letters becomes a blank."""

    def __init__(self, model: Letters):
        self.model, self.known = model, {}

    def span(self, text: str) -> str:
        if len(text) > 64:
            return decode(text, self.model)
        if text not in self.known:
            if len(self.known) > 1 << 16:
                self.known.clear()
            self.known[text] = decode(text, self.model)
        return self.known[text]

    def __call__(self, texts: list[str]) -> list[str]:
        out: list[str] = []
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for a, b in spans_of(sizes, STEP):
            line = "\n".join(texts[a:b])
            x = points(line)
            ends = np.cumsum(sizes[a:b] + 1) - 1
            spans = suspects(x)
            plain = np.where(_LETTER[x] | (x == 10), x, 32).astype("<u4")
            plain[ends[:-1]] = 1  # between texts, where a line feed of a text can't be
            plain = plain.tobytes().decode("utf-32-le", "surrogatepass").replace("\n", " ").replace("\x01", "\n")
            parts, at = [], 0
            for p, q in spans:
                parts += [plain[at:p], self.span(line[p:q])]
                at = q
            out += "".join([*parts, plain[at:]]).split("\n")
        return out


# -- the classifier


def beginnings(restored: str) -> set[str]:
    found = set()
    for word in set(restored.split()):
        found.update(" " + word[:k] for k in LENGTHS if len(word) >= k)
        found.add(f" {word} ")
    return found


def fit(texts: list[str], labels: list[int]) -> tuple[list[str], np.ndarray] | None:
    """Word beginnings and their weights, the bias last; None unless both labels are there."""
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return None
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for text, label in zip(texts, labels, strict=True):
        if label:
            counts[1].update(beginnings(text))
    often = {f for f, c in counts[1].items() if c >= 3}
    for text, label in zip(texts, labels, strict=True):
        if not label:
            counts[0].update(beginnings(text) & often)
    n = [float((y == 0).sum()), float((y == 1).sum())]
    odds = {f: math.log((counts[1][f] + 0.1) / (n[1] + 0.2)) - math.log((counts[0][f] + 0.1) / (n[0] + 0.2)) for f in often}
    best = sorted((f for f, s in odds.items() if s > 1.0), key=lambda f: (-odds[f] * math.sqrt(counts[1][f]), f))[:FEATURES]
    index = {f: k for k, f in enumerate(best)}
    x = np.zeros((len(texts), len(best) + 1), np.float32)
    x[:, -1] = 1
    for i, text in enumerate(texts):
        x[i, [index[f] for f in beginnings(text) if f in index]] = 1
    y = y.astype(np.float32)
    balance = np.where(y == 1, len(y) / 2 / n[1], len(y) / 2 / n[0]).astype(np.float32)
    w, m, v = np.zeros(x.shape[1], np.float32), np.float32(0), np.float32(0)
    for step in range(1, 201):  # Adam on the regularised logistic loss
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (balance * (p - y)) / len(y) + np.float32(1e-4) * w * (np.arange(len(w)) < len(w) - 1)
        g = g.astype(np.float32)
        m, v = np.float32(0.9) * m + np.float32(0.1) * g, np.float32(0.999) * v + np.float32(0.001) * g * g
        w -= np.float32(0.1) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return best, w.astype(float)


class Scorer:
    def __init__(self, features: list[str], weights: np.ndarray):
        import ahocorasick

        self.weights = weights
        self.find = ahocorasick.Automaton()
        for k, f in enumerate(features):
            self.find.add_word(f, k)
        self.find.make_automaton()

    def __call__(self, restored: str) -> float:
        total = float(self.weights[-1])
        if len(self.weights) > 1:
            total += sum(float(self.weights[k]) for k in {k for _, k in self.find.iter(f" {restored} ")})
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


class Toxicity:
    """The parts that executors get: two tables of BINS counts and FEATURES weights, bounded whatever the corpus."""

    def __init__(self, pairs: np.ndarray, triples: np.ndarray, fitted: tuple[list[str], np.ndarray] | None):
        self.tables, self.fitted, self.ready = (pairs, triples), fitted, None

    def __getstate__(self):
        return {"tables": self.tables, "fitted": self.fitted, "ready": None}

    def restore(self, texts: list[str | None]) -> list[str]:
        if self.ready is None:
            self.ready = Restorer(Letters(*self.tables)), Scorer(*self.fitted) if self.fitted else None
        return self.ready[0](lowered(texts))

    def __call__(self, texts: list[str | None]) -> list[float]:
        if not self.fitted:
            return [0.0] * len(texts)
        return [self.ready[1](x) for x in self.restore(texts)]


def letter_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all documents. A task sends its filled bins in one value; MERGERS tasks add these up, then the driver their tables."""

    def packed(table: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(table)
        return pa.RecordBatch.from_arrays([pa.array([some.astype("<u4").tobytes() + table[some].astype("<i8").tobytes()], pa.binary())], names=["bins"])

    def count(batches):
        table = np.zeros(2 * BINS, np.int64)
        for batch in pieces(batches):
            count_letters(lowered(batch.column("text").to_pylist()), table[:BINS], table[BINS:])
        yield packed(table)

    def added(values, table: np.ndarray) -> np.ndarray:
        for x in values:
            n = len(x) // 12
            table[np.frombuffer(x, "<u4", n)] += np.frombuffer(x, "<i8", n, 4 * n)
        return table

    def merge(batches):
        table = np.zeros(2 * BINS, np.int64)
        for batch in batches:
            added((x.as_py() for x in batch.column("bins")), table)
        if table.any():
            yield packed(table)

    rows = pick(docs, text="string").mapInArrow(count, "bins binary").repartition(MERGERS).mapInArrow(merge, "bins binary")
    both = added(rows.toArrow().column("bins").to_pylist(), np.zeros(2 * BINS, np.int64))  # MERGERS tables at most
    return both[:BINS], both[BINS:]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FIT_ROWS) -> Toxicity:
    pairs, triples = letter_counts(docs)
    rows = sample(docs, labels, label, most)
    restored = Toxicity(pairs, triples, None).restore([x for x, _ in rows])
    return Toxicity(pairs, triples, fit(restored, [y for _, y in rows]))


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))

    def rows(batches):
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    found = pick(docs, doc_id="long", text="string").mapInArrow(rows, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))
    column = fresh(docs, "toxicity")

    def rows(batches):
        for batch in pieces(batches):
            score = np.array(model.value(batch.column("text").cast(pa.string()).to_pylist()), float)
            kept = pa.array(score < threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, column]).filter(kept)

    return docs.mapInArrow(rows, with_fields(docs, (column, T.DoubleType()))).select(*docs.columns)
