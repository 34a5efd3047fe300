import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from permlab.llm import lexical
from permlab.llm.lexical import Found, WaveletTree

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain(docs, items, k=20):
    own = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    n_docs, all_terms = sum(n > 0 for *_, n in own), sum(n for *_, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, n in own:
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // all_terms)))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


WORDS = st.text("abcDÄé1_- \x1c\x7f　日", max_size=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), WORDS), min_size=1, max_size=40), WORDS, st.integers(1, 5))
def test_trees(texts, query, k):
    tree = WaveletTree.build(np.arange(len(texts))[::-1].copy(), pa.array(texts, pa.string()), max(1, sum(bool(terms(t)) for t in texts)), max(1, sum(len(terms(t)) for t in texts)))
    if tree is None:
        assert not any(map(terms, texts))
        return
    tree = WaveletTree.read(dict(zip(WaveletTree.NAMES, tree.row(), strict=True)))
    asked = Counter(terms(query))
    names = [t.encode() for t in asked]
    own = pa.array([" ".join(asked)])
    data, a, b, _ = lexical.bounds_of_terms(own)
    at = lexical.terms_at(tree.hashes, tree.words, tree.word_at, lexical.term_hashes(data, a, b), names)
    have = {t for text in texts for t in terms(text)}
    assert [i >= 0 for i in at] == [t in have for t in asked]
    use, weight = at >= 0, np.arange(3, 3 + len(at)) * np.array(list(asked.values()), np.int64)
    found = Found(1, k, np.ones(1, np.int64))
    if use.any():
        lexical.search(tree, np.zeros(use.sum(), np.int64), at[use], weight[use], found, at_once=1)
    n_docs, all_terms = sum(bool(terms(t)) for t in texts), sum(len(terms(t)) for t in texts)
    want = []
    for d, text in zip(range(len(texts) - 1, -1, -1), texts, strict=True):
        c, n = Counter(terms(text)), len(terms(text))
        score = sum((i + 3) * asked[t] * (10**9 * c[t] // (1000 * c[t] + 12 * (75 + 25 * n * n_docs // all_terms))) for i, t in enumerate(asked) if c[t])
        if score:
            want.append((-score, d))
    assert list(zip((-found.score).tolist(), found.doc.tolist(), strict=True)) == sorted(want)[:k]


def test_terms_whose_hashes_collide(monkeypatch):
    monkeypatch.setattr(lexical, "term_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    texts = pa.array(["ab cd ab efg", "cd xyz ab", "q"])
    tree = WaveletTree.build(np.arange(3), texts, 3, 8)
    held = {bytes(tree.words[a:b]): int(n) for a, b, n in zip(tree.word_at[:-1], tree.word_at[1:], np.diff(tree.begin), strict=True)}
    assert held == {b"ab": 2, b"cd": 2, b"efg": 1, b"xyz": 1, b"q": 1}
    names = [b"cd", b"ab", b"zz"]
    at = lexical.terms_at(tree.hashes, tree.words, tree.word_at, np.array([2, 2, 2], np.uint64), names)
    assert [tree.words[tree.word_at[i] : tree.word_at[i + 1]] if i >= 0 else None for i in at] == [b"cd", b"ab", None]


def test_few_nodes_are_split():
    """A document that holds the query's rare terms is found without looking at most others."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 60) % 5000) for _ in range(4000)]
    texts[1234] += " needle thread"
    tree = WaveletTree.build(np.arange(4000), pa.array(texts), 4000, 240_000)
    data, a, b, _ = lexical.bounds_of_terms(pa.array(["needle thread w1 w2"]))
    at = lexical.terms_at(tree.hashes, tree.words, tree.word_at, lexical.term_hashes(data, a, b), [b"needle", b"thread", b"w1", b"w2"])
    found = Found(1, 1, np.ones(1, np.int64))
    split = lexical.search(tree, np.zeros(4, np.int64), at, np.array([7000, 7000, 100, 300]), found)
    assert found.doc.tolist() == [1234] and split < 100


def test_queries_over_shards_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(f"w{x}" for x in rng.zipf(1.4, n) % 300)
    docs = [(int(i), say(int(rng.integers(0, 60)))) for i in rng.permutation(400)] + [(None, "w1 w2 W3"), (7, "w1 w2"), (7, "w1 w2"), (8, None), (9, ""), (10, "..."), (11, "w5 " * 3000), (12, "ÄÖ äö Straße 日本語")]
    items = [(k, say(int(rng.integers(1, 30)))) for k in range(30)] + [(50, None), (51, ""), (52, "w5 w5 w5 w9"), (None, "w1 w77"), (53, "ÄÖ straße unknown"), (52, "w5 W6")]
    frame = lambda rows, schema: spark.createDataFrame([(*r, "z", 1) for r in rows], f"{schema}, rank string, query int").repartition(5)
    d, q = frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")
    want = plain(docs, items)
    assert sorted(map(tuple, lexical.ranked(d, q).collect()), key=repr) == want
    monkeypatch.setattr(lexical, "SHARD_ROWS", 16)
    monkeypatch.setattr(lexical, "SHARD_BYTES", 3000)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 4)
    assert sorted(map(tuple, lexical.ranked(d, q).collect()), key=repr) == want
    assert lexical.ranked(d, q.limit(0)).collect() == [] and lexical.ranked(d.limit(0), q).collect() == []
    assert lexical.ranked(frame([(1, "..."), (2, None)], "doc_id long, text string"), q).collect() == []
