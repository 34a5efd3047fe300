import math
import zlib

import numpy as np
import pyarrow as pa

from permlab.llm import quality as q

RNG = np.random.default_rng(2)


def good(n):
    return " ".join(f"word{w}" for w in RNG.integers(0, 500, n)) + "."


def bad(n):
    return " ".join(f"X{w}!!" for w in RNG.integers(0, 500, n))


ROWS = [(k, bad(90) + good(100 * (k % 3)) if k % 4 == 0 else good(int(RNG.integers(5, 300))), int(k % 4 > 0)) for k in range(400)]


def test_passages_cover_whole_texts_alone_or_together(monkeypatch):
    texts = [None, "", "a", " \n ", *[x for _, x, _ in ROWS[:20]], "é ß " * 500]
    x, at = q.passages(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        alone, _ = q.passages(pa.array([text], pa.string()))
        assert np.array_equal(alone, x[at[k] : at[k + 1]])
        assert len(alone) == max(1, (len((text or "").split()) + q.PASSAGE // 2) // q.PASSAGE)
    monkeypatch.setattr(q, "STEP", 200)
    again, _ = q.passages(pa.array(texts, pa.string()))
    assert np.array_equal(again, x)


def test_gradient_against_differences():
    x = RNG.normal(size=(12, q.FEATURES))
    at, y = np.array([0, 3, 4, 12]), np.array([1.0, 0.0, 1.0])
    model = q.Attention(seed=4)
    loss = lambda: -np.mean(np.log(np.where(y == 1, s := model(x, at), 1 - s)))
    for name, g in model.gradient(x, at, y).items():
        flat = model.p[name].reshape(-1)
        for k in range(0, len(flat), max(1, len(flat) // 5)):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-5 - g.reshape(-1)[k]) < 1e-6


def plain(model, x):
    """Score of one text, passage by passage."""
    p, hs, es = model.p, [], []
    for row in x:
        h = [math.tanh(sum((row[i] - model.mean[i]) / model.scale[i] * p["W"][i][u] for i in range(len(row))) + p["b"][u]) for u in range(q.UNITS)]
        gates = [math.tanh(sum(h[i] * p["V"][i][u] for i in range(q.UNITS))) / (1 + math.exp(-sum(h[i] * p["U"][i][u] for i in range(q.UNITS)))) for u in range(q.UNITS)]
        hs.append(h)
        es.append(math.exp(sum(g * a for g, a in zip(gates, p["a"]))))
    z = [sum(e * h[u] for e, h in zip(es, hs)) / sum(es) for u in range(q.UNITS)]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(z, p["c"])) - p["d"][0]))


def test_scores_against_a_plain_forward_pass():
    model = q.fit([t for _, t, _ in ROWS[:120]], [y for *_, y in ROWS[:120]], epochs=4)
    texts = [t for _, t, _ in ROWS[120:150]] + [None, "", "word " * 3000]
    x, at = q.passages(pa.array(texts, pa.string()))
    got = model(x, at)
    assert np.allclose(got, [plain(model, x[a:b].astype(float)) for a, b in zip(at[:-1], at[1:])], atol=1e-9)


def test_attention_finds_the_few_passages_that_decide():
    """One passage in up to 60 is bad, or none; the others vary in the same figures, so that a plain mean hardly tells."""
    r = np.random.default_rng(12)

    def passage(bad):
        many = 34 if bad else int(r.integers(0, 9))
        return " ".join(f"w{w}!!" if k < many else f"w{w}" for k, w in enumerate(r.integers(0, 900, q.PASSAGE)))

    def text(y):
        n = int(r.integers(10, 60))
        at = int(r.integers(n)) if not y else -1
        return " ".join(passage(k == at) for k in range(n))

    labels = [int(k % 2) for k in range(500)]
    texts = [text(y) for y in labels]
    model = q.fit(texts[:400], labels[:400])
    x, at = q.passages(pa.array(texts[400:]))
    y = np.array(labels[400:])
    assert ((model(x, at) > 0.5) == y).mean() > 0.95
    # where a bad passage is, it gets most of the weight
    w = model.attention(x, at)
    peak = [w[a:b].max() * (b - a) for (a, b), l in zip(zip(at[:-1], at[1:]), y) if not l]
    assert np.median(peak) > 5
    # the same model with equal weights fails
    model.p["a"] = np.zeros(q.UNITS)
    assert ((model(x, at) > 0.5) == y).mean() < 0.8


def test_tables(spark):
    rows = [*ROWS, (9001, None, 1), (9002, "", 0), (None, good(30), 1), (7, good(50), 1)]
    docs = spark.createDataFrame([(a, b, "x") for a, b, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(a, y) for a, _, y in rows] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = q.scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {a: y for a, _, y in ROWS}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) > 0.95
    assert q.scores(docs.limit(0), labels).collect() == []
    assert {r.score for r in q.scores(docs.limit(5), labels.limit(0)).collect()} == {0.5}
