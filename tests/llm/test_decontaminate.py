import re

import numpy as np
import pyarrow as pa

from permlab.llm import decontaminate as d

RNG = np.random.default_rng(5)
SAY = lambda n: " ".join(f"{w:x}é" for w in RNG.integers(0, 5000, n))
ITEMS = [(1, SAY(40)), (2, SAY(25)), (3, SAY(5)), (4, ""), (5, SAY(60)), (None, SAY(30))]


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def plain(texts, least=d.LEAST, match=d.MATCH):
    """Every diagonal of every item; those with a window that a mask lets agree count."""
    out = set()
    for t, text in enumerate(texts):
        w = words(text)
        for i, item in ITEMS:
            v = words(item)
            for p in range(-len(v), len(w)):
                agree = [float(0 <= p + k < len(w) and w[p + k] == v[k]) for k in range(len(v))]
                if len(v) < d.SPAN:
                    hit = bool(v) and all(agree)
                else:
                    hit = any(all(agree[k + j] for j, c in enumerate(m) if c == "1") for m in d.MASKS for k in range(len(v) - d.SPAN + 1))
                if not hit:
                    continue
                lo = max(0, -p)
                inside = np.array(agree[lo : len(w) - p])
                best = max(((b - a, -a) for a in range(len(inside)) for b in range(a + 1, len(inside) + 1) if inside[a] and inside[b - 1] and inside[a:b].sum() >= match * (b - a) - 1e-9), default=None)
                if best and best[0] >= min(least, len(v)):
                    a = lo - best[1]
                    out.add((t, i, p + a, best[0], int(sum(agree[a : a + best[0]]))))
    return out


def texts():
    item = dict(ITEMS)
    swap = words(item[5])
    swap[7] = swap[20] = swap[21] = swap[40] = "other"
    return [
        SAY(50) + " " + item[1].upper() + ". " + SAY(20), SAY(200), None, "", item[3], item[2] + "\n" + item[1], SAY(10) + " " + ", ".join(swap) + " " + SAY(10),
        " ".join(words(item[1])[5:20]), " ".join(words(item[1])[5:12]), SAY(3) + " " + " ".join(words(item[5])[:31]) + " new " + " ".join(words(item[5])[31:]), item[None],
    ]


def test_overlaps(monkeypatch):
    rows = texts()
    bench = d.Benchmark(ITEMS)
    got = d.overlaps(pa.array(rows, pa.string()), bench)
    assert {r[:5] for r in got} == plain(rows)
    assert {r[0] for r in got} == {0, 4, 5, 6, 7, 9, 10}
    for t, _, first, n, _, a, b in got:
        assert words(rows[t].lower().encode()[a:b].decode()) == words(rows[t])[first : first + n]
    monkeypatch.setattr(d, "STEP", 100)
    assert d.overlaps(pa.array(rows, pa.string()), bench) == got


def test_tables(spark):
    rows = [(k, x, "z") for k, x in enumerate(texts())] + [(None, dict(ITEMS)[1], "z"), (0, dict(ITEMS)[1], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = sorted(map(tuple, d.contaminated(docs, bench).collect()), key=repr)
    assert one == sorted(map(tuple, d.contaminated(docs, bench, block_words=30).collect()), key=repr)
    assert {r[0] for r in one} == {0, 4, 5, 6, 7, 9, 10, None}
    for block in (30, d.BLOCK_WORDS):
        kept = d.keep_clean(docs, bench, block_words=block)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 8]
    assert d.contaminated(docs.limit(0), bench).collect() == [] == d.contaminated(docs, bench.limit(0)).collect()


def test_masks_let_every_overlap_through():
    """The best share of a run that no mask lets through, over all runs of each length, by its last SPAN - 1 words: 1 for a word that agrees, -4 for another."""
    n, never = 1 << (d.SPAN - 1), -(10**9)
    state, window = np.arange(n), np.arange(2 * n)
    hit = np.any([window & m == m for m in (sum(1 << k for k, c in enumerate(x) if c == "1") for x in d.MASKS)], axis=0)
    ones = sum(state >> k & 1 for k in range(d.SPAN - 1))
    best = np.where(state & 1, 5 * ones - 4 * (d.SPAN - 1), never)
    for length in range(d.SPAN, 300):
        new = np.full(n, never)
        for bit in (0, 1):
            to = state | bit << (d.SPAN - 1)
            np.maximum.at(new, to >> 1, np.where(hit[to], never, best + (1 if bit else -4)))
        best = new
        assert best[n >> 1 :].max() < 0, length


def test_all_diagonals_without_masks():
    rng = np.random.default_rng(8)
    items, rows = [], []
    for k in range(300):
        v = [f"i{k}w{j}" for j in range(int(rng.integers(12, 61)))]
        items.append((k, " ".join(v)))
        w = list(v)
        if k % 3:
            gone = 1 + rng.permutation(len(v) - 2)[: (len(v) - int(np.ceil(0.8 * len(v) - 1e-9)))]
        else:
            gone = np.arange(k // 3 % 5, len(v), 5)
        for j in gone:
            w[j] = "other"
        rows.append("before it " + " ".join(w) + " after it")
    got = {r[:5] for r in d.overlaps(pa.array(rows), d.Benchmark(items))}
    want = set()
    for t, row in enumerate(rows):
        w, v = words(row), words(items[t][1])
        for p in range(1 - len(v), len(w)):
            lo, hi = max(0, p), min(len(w), p + len(v))
            run = d.stretch(np.array([float(w[x] == v[x - p]) for x in range(lo, hi)]), min(d.LEAST, len(v)), d.MATCH)
            if run:
                want.add((t, t, lo + run[0], run[1] - run[0], sum(w[x] == v[x - p] for x in range(lo + run[0], lo + run[1]))))
    assert got == want and len(want) > 280


def test_long_overlaps_and_short_items(spark):
    import time

    agree = (np.arange(400_000) % 7 != 3).astype(float)
    began = time.process_time()
    assert d.stretch(agree, 13, 0.8) == (0, 400_000) and time.process_time() - began < 5
    rng = np.random.default_rng(2)
    for _ in range(300):
        agree = (rng.random(int(rng.integers(1, 40))) < rng.choice([0.3, 0.7, 0.9])).astype(float)
        runs = [(a - b, a, b) for a in range(len(agree)) for b in range(a + 1, len(agree) + 1) if agree[a] and agree[b - 1] and agree[a:b].mean() >= 0.8 - 1e-12 and b - a >= 5]
        assert d.stretch(agree, 5, 0.8) == (min(runs)[1:] if runs else None)
    docs = spark.createDataFrame([(1, "the end of it"), (2, "one two three four five six"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "one two three four five")], "item_id long, text string")
    assert sorted(r.doc_id for r in d.keep_clean(docs, items).collect()) == [1, 3]
    assert sorted(r.doc_id for r in d.keep_clean(docs, items, shortest=1).collect()) == [3]
