"""Quality of texts by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Every passage is encoded by FEATURES figures of its characters and words,
then by a layer of tanh units. Gated attention (a tanh branch times a sigmoid branch) weighs the passages of a
bag, in a softmax; a logistic unit scores the weighted mean of the encodings and nothing else, so what a score sees of
a text is what attention lets through. All weights are learned together, from labels of whole texts, on a bounded sample of labelled rows (FIT_ROWS of each label).

Passages of whole texts are encoded, however many; a text's softmax is summed up over steps, so memory doesn't
grow with its length beyond the text itself.

Cases: a null text is empty; an empty text is one passage without characters; without labels of both kinds every
score is 0.5; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permlab.llm.common import pick, pieces, spans_of, text_bytes
from permlab.llm.labelled import held_out, sample

#: Labelled documents of each label that the model is fitted on, at most.
FIT_ROWS = 3000
PASSAGE, UNITS, STEP = 64, 16, 1 << 20

#: Classes of bytes whose shares of a passage are features.
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!", "|", "#%&*$@~^=+<>\\_", ".", ",;:", "?\"'()[]{}/-", "\n", " \t\r\x0b\x0c"]
_KIND = np.full(256, len(CLASSES), np.uint8)  # the last class: all other bytes
for _k, _chars in enumerate(CLASSES):
    _KIND[[ord(c) for c in _chars]] = _k
_KIND[:32][_KIND[:32] == len(CLASSES)] = 5
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_POWER = np.random.default_rng(23).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
FEATURES = len(CLASSES) + 1 + 9


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the n + 1 offsets of the texts; every text has a passage."""
    data, offsets = text_bytes(texts)
    parts, counts = [np.zeros((0, FEATURES), np.float32)], [np.zeros(0, np.int64)]
    for a, b in spans_of(np.diff(offsets), STEP):
        x, n = _passages(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append(x)
        counts.append(n)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _passages(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    texts = len(offsets) - 1
    solid = ~_BLANK[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(solid & (~np.append(False, solid[:-1]) | edge[:-1])) if len(body) else np.zeros(0, np.int64)
    end = np.flatnonzero(solid & (~np.append(solid[1:], False) | edge[1:])) + 1 if len(body) else start
    doc = np.searchsorted(offsets, start, "right") - 1
    words = np.bincount(doc, minlength=texts)
    counts = np.maximum(1, (words + PASSAGE // 2) // PASSAGE)  # the rest joins the last passage if it is short
    first = np.cumsum(words) - words
    base = np.cumsum(counts) - counts
    n = int(counts.sum())
    # words and bytes by passage; blanks go with the word before them
    of = base[doc] + np.minimum((np.arange(len(start)) - first[doc]) // PASSAGE, counts[doc] - 1)
    begin = np.repeat(offsets[:-1], counts)
    heads = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    inner = of[heads] != base[doc[heads]]
    begin[of[heads][inner]] = start[heads][inner]
    sizes = np.diff(np.append(begin, len(body)))
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * (len(CLASSES) + 1) + _KIND[body], minlength=n * (len(CLASSES) + 1)).reshape(n, -1)
    length = np.maximum(sizes, 1)[:, None]
    out = np.zeros((n, FEATURES), np.float32)
    out[:, : len(CLASSES) + 1] = kinds / length
    k = len(CLASSES) + 1
    many = np.bincount(of, minlength=n)
    per = np.maximum(many, 1)
    if len(start):
        size = end - start
        word = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        letters = body[np.repeat(start, size) + place]
        h = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * _POWER[place % 64], np.cumsum(size) - size)
        h ^= h >> np.uint64(29)
        same = np.append(False, h[1:] == h[:-1]) & np.append(False, of[1:] == of[:-1])
        out[:, k] = np.bincount(of, same, n) / per  # a word again
        key = (of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))
        distinct = np.unique(key)
        out[:, k + 1] = (many - np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=n)) / per  # words that came before
        out[:, k + 2] = np.bincount(of, np.minimum(size, 40), n) / per / 10
        out[:, k + 3] = np.bincount(of, size > 20, n) / per
        out[:, k + 4] = np.bincount(of, size <= 2, n) / per
        lone = _KIND[body[start]]
        out[:, k + 5] = np.bincount(of, (size == 1) & (lone >= 3) & (lone < len(CLASSES)), n) / per  # signs by themselves
        tail = _KIND[body[end - 1]]
        out[:, k + 6] = np.bincount(of, (tail == 3) | (tail == 5), n) / per  # words that end in signs
        out[:, k + 7] = np.bincount(of, (tail == 6), n) / per
    out[:, k + 8] = np.log1p(many) / 5
    return out, counts


class Attention:
    """Weights of the encoder, of the gated attention and of the score."""

    def __init__(self, inputs: int = FEATURES, units: int = UNITS, seed: int = 0):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.p = {
            "W": r.normal(0, inputs**-0.5, (inputs, units)), "b": np.zeros(units), "V": r.normal(0, units**-0.5, (units, units)), "U": r.normal(0, units**-0.5, (units, units)),
            "a": r.normal(0, 2 * units**-0.5, units), "c": r.normal(0, units**-0.5, units), "d": np.zeros(1),
        }

    def encode(self, x: np.ndarray):
        h = np.tanh(((x - self.mean) / self.scale) @ self.p["W"] + self.p["b"])
        t, g = np.tanh(h @ self.p["V"]), 1 / (1 + np.exp(-(h @ self.p["U"])))
        return h, t, g, (t * g) @ self.p["a"]

    def pool(self, x: np.ndarray, at: np.ndarray):
        h, t, g, e = self.encode(x)
        n = np.diff(at)
        w = np.exp(e - np.repeat(np.maximum.reduceat(e, at[:-1]), n))
        w /= np.repeat(np.add.reduceat(w, at[:-1]), n)
        z = np.add.reduceat(h * w[:, None], at[:-1])
        score = 1 / (1 + np.exp(-np.clip(z @ self.p["c"] + self.p["d"], -30, 30)))
        return score, (h, t, g, w, z, n)

    def attention(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The weight of every passage in its text."""
        return self.pool(x, at)[1][3]

    def __call__(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.pool(x, at)[0] if len(at) > 1 else np.zeros(0)

    def gradient(self, x: np.ndarray, at: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        score, (h, t, g, w, z, n) = self.pool(x, at)
        s = (score - y) / len(y)
        p = self.p
        dz = np.repeat(s, n)[:, None] * p["c"]
        de = w * ((h - np.repeat(z, n, axis=0)) * dz).sum(1)  # through the softmax
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        dh = w[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
        du = dh * (1 - h * h)
        return {"W": ((x - self.mean) / self.scale).T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ s, "d": np.array([s.sum()])}


def fit(texts: list[str], labels: list[int], epochs: int = 40, batch: int = 64, prior: float | None = None) -> Attention | None:
    """Adam with decoupled decay on the logistic loss, in an order fixed by a seed; None unless both labels are there."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return None
    x, at = passages(pa.array(texts, pa.string()))
    x = x.astype(float)
    model, rng = Attention(), np.random.default_rng(1)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for k in range(0, len(y), batch):
            some = order[k : k + batch]
            n = at[some + 1] - at[some]
            ends = np.concatenate([[0], np.cumsum(n)])
            rows = np.repeat(at[some] - ends[:-1], n) + np.arange(ends[-1])
            step += 1
            for name, g in model.gradient(x[rows], ends, y[some]).items():
                m, v = moment[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                if name in ("W", "c"):  # decay apart from the gradient's moments, and not of the attention
                    model.p[name] *= 1 - 0.01 * rate
    if prior is not None:  # the sample has more of the rare label than the corpus
        here = y.mean()
        model.p["d"] += np.log(prior / (1 - prior)) - np.log(here / (1 - here))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> Attention | None:
    counts = {r["y"]: r["n"] for r in pick(labels, doc_id="long", **{label: "int"}).where(~held_out(F.col("doc_id"))).groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).where("y IN (0, 1)").collect()}
    rows = sample(docs, labels, label, most)
    prior = counts[1] / (counts[0] + counts[1]) if len(counts) == 2 else None
    return fit([x for x, _ in rows], [y for _, y in rows], prior=prior)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **options))  # a few thousand numbers

    def rows(batches):
        for batch in pieces(batches):
            score = np.full(batch.num_rows, 0.5)
            if model.value is not None:
                score = model.value(*passages(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    found = pick(docs, doc_id="long", text="string").mapInArrow(rows, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
