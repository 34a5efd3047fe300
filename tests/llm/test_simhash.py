import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from permlab.llm import simhash


def plain(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [words[i : i + width] for i in range(len(words) - width + 1)] or ([words] if words else [])
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=2):
    fps = [plain(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids) if ids else None))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB \n\x0b\x1cé ", max_size=40)), max_size=8))
def test_fingerprints(texts):
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == [plain(t) for t in texts]


def test_fingerprints_over_many_steps(monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 50)
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    texts = [" ".join(f"w{i * j % 11}" for i in range(n)) for j, n in enumerate((0, 1, 2, 3, 40, 200))]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [plain(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 9), st.integers(1, 200), st.integers(0, 5))
def test_close_pairs(seed, n, radius):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 1 << 64, 4, np.uint64)[rng.integers(0, 4, n)]
    for _ in range(3):
        values ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    i, j = simhash.close_pairs(values, radius)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if (int(values[a]) ^ int(values[b])).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_links_of_large_buckets_lose_none(spark):
    rng = np.random.default_rng(3)
    values = np.unique(np.concatenate([np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), rng.integers(0, 1 << 64, 200, np.uint64)])).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in values], "fp long")
    from permlab.operators.graph import components

    got = {(r.node, r.root) for r in components(simhash.links(df, 2, cell=16)).collect()}
    i, j = simhash.close_pairs(values.view(np.uint64), 2)
    order = np.argsort(values)
    root = simhash.forest(len(values), np.argsort(order)[i], np.argsort(order)[j])
    ordered = values[order]
    want = {(int(ordered[k]), int(ordered[root[k]])) for k in range(len(values)) if (root == root[k]).sum() > 1}
    assert got == want


BASE = " ".join(f"word{i}" for i in range(400))
ROWS = [(7, BASE), (3, BASE), (9, BASE + " end"), (None, BASE), (11, ""), (12, None), (13, "a"), (14, "A"), (14, "A"), (None, "lonely text"), (15, BASE.replace("word7 ", "other ")), (16, "quite another text of a few words")]


def test_documents(spark):
    df = spark.createDataFrame([(d, t, "z") for d, t in ROWS], "doc_id long, text string, fp string")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted(plain_components(ROWS), key=repr)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    want = {c for *_, c in plain_components(ROWS)}
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert simhash.near_duplicates(df.limit(0)).collect() == [] and simhash.keep_one(df.limit(0)).collect() == []


def test_unlinked_texts_without_an_id_or_with_the_same(spark):
    unlike = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcde"]
    rows = [(None, unlike[0]), (None, unlike[1]), (5, unlike[2]), (5, unlike[3]), (8, unlike[3]), (9, unlike[2]), (None, unlike[4]), (5, unlike[2])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(None, unlike[0]), (None, unlike[1]), (None, unlike[4]), (5, unlike[2]), (5, unlike[3])], key=repr)


def test_whole_texts_over_many_steps(monkeypatch):
    texts = [" ".join(f"w{i * j % 101}" for i in range(n)) for j, n in enumerate((0, 3, 40, 900, 2000))] + [None, ""]
    whole = simhash.fingerprints(pa.array(texts), 5)
    assert whole.tolist() == [int(simhash.fingerprints(pa.array([t], pa.string()), 5)[0]) for t in texts]
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    assert np.array_equal(simhash.fingerprints(pa.array(texts), 5), whole)


def test_keys_are_of_one_text_alone():
    texts = [" ".join(f"w{i * j % 101}" for i in range(n)) for j, n in enumerate((0, 3, 40, 900, 2000))] + [None, "", "one two three four five"]
    keys, counts = simhash.band_keys(pa.array(texts), 5)
    alone = [simhash.band_keys(pa.array([t], pa.string()), 5) for t in texts]
    assert keys.tolist() == [x for a in alone for x in a[0].tolist()] and counts.tolist() == [int(a[1][0]) for a in alone]
    assert [c > 0 for c in counts] == [False, False, True, True, True, False, False, True]
    assert simhash.band_keys(pa.array([], pa.string()), 5)[0].tolist() == []


def _alike(rows):
    grams = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in rows}
    by = {}
    for d, g in grams.items():
        for x in g:
            by.setdefault(x, set()).add(d)
    near = {p for ds in by.values() if len(ds) < 200 for p in ((a, b) for a in ds for b in ds if a < b)}
    return {(a, b) for a, b in near if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}


@pytest.mark.parametrize("hub", ["each", "all", "licence"])
def test_near_copies_behind_hubs(spark, hub):
    """Originals with a copy each; longer documents hold every original, or one holds all, or all share a line: by brute force nothing is lost."""
    rng = np.random.default_rng(9)
    say = lambda n: [f"w{w}" for w in rng.integers(0, 10**6, n)]
    rows, hosts, line = [], [], say(40)
    for k in range(60):
        text = say(300)
        copy = list(text)
        for i in rng.permutation(300)[: 4 if k % 2 else 6]:
            copy[i] = say(1)[0]
        if hub == "licence":
            text, copy = text + line, line + copy
        rows += [(k, text), (1000 + k, copy)]
        if hub == "each":
            hosts.append((2000 + k, say(400) + text + say(500)))
    if hub == "all":
        hosts.append((2000, [w for _, t in rows[::2] for w in t]))
    if hub == "licence":
        hosts += [(2000 + k, say(30) + line + say(30)) for k in range(100)]
    rows += hosts
    wanted = {b for _, b in _alike(rows)}
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()}
    gone = {d for d, _ in rows} - kept
    assert len(wanted) >= 50 and gone <= wanted and len(gone) >= 0.97 * len(wanted)


def test_a_set_goes_to_its_pairs_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PARTNERS", 3)
    sets = spark.createDataFrame([(k, np.array(sorted({*range(20), k} - {k % 7}), "<u4").tobytes()) for k in range(100, 140)], "fp long, own binary")
    pairs = [(a, b) for b in (100, 107, 111) for a in range(100, 140) if a != b]
    got = {tuple(r) for r in simhash.verified(spark.createDataFrame(pairs, "a long, b long"), sets, 0.9).collect()}
    own = {k: {*range(20), k} - {k % 7} for k in range(100, 140)}
    assert got == {(a, b) for a, b in pairs if len(own[a] & own[b]) >= 0.9 * len(own[a] | own[b])} and got


def test_near_copies_stay_once(spark):
    """Every kept text against every other by brute force: what is similar by 0.8 goes, what is like nothing stays."""
    rng = np.random.default_rng(8)
    say = lambda n: [f"w{w}" for w in rng.integers(0, 10**6, n)]
    line = say(30)  # a line that all texts hold
    rows, near, at = [], 0, 0
    for k in range(60):
        text = say(int(rng.integers(60, 300)))
        at += 1
        rows.append((1000 + k, text[:20] + line + text[20:]))
        for _ in range(1 + 9 * (k == 0)):
            copy = list(rows[-1 - 0][1]) if k else list(rows[0][1])
            for i in rng.permutation(len(copy))[: int(rng.integers(1, max(2, len(copy) // 50)))]:
                copy[i] = say(1)[0]
            at += 1
            rows.append((2000 + at, copy))
    grams = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in rows}
    alike = {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()}
    gone = set(grams) - kept
    near = {d for p in alike for d in p}
    assert gone <= near and {d for d in grams if d < 2000} <= kept
    wanted = {max(p) for p in alike}
    assert len(wanted) > 50 and len(gone & wanted) >= 0.9 * len(wanted)


def test_no_link_between_classes_is_left_out(spark):
    """Chains of copies, each like the next ones only; copies whose fingerprints are far apart; unlike texts of one fingerprint with a copy of one each."""
    rng = np.random.default_rng(5)
    say = lambda n: [f"w{w}" for w in rng.integers(0, 10**6, n)]
    rows = []
    for k in range(6):
        text = say(300)
        for j in range(12):
            rows.append((100 * k + j, list(text)))
            for i in rng.permutation(300)[:3]:
                text[i] = say(1)[0]
    for k in range(10):
        body, other, loud, louder = say(300), say(300), say(5) * 300, say(5) * 300
        rows += [(1000 + 10 * k, body + loud), (1001 + 10 * k, body + louder), (1002 + 10 * k, other + loud), (1003 + 10 * k, other + say(5) * 300)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()}
    assert kept == {100 * k for k in range(6)} | {1000 + 10 * k for k in range(10)}


@pytest.mark.parametrize("few", [0, 2, 100])
def test_common_shingles_of_a_cell(monkeypatch, few):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(simhash, "COLUMNS", 5)
    monkeypatch.setattr(simhash, "FEW", few)
    own = [np.unique(rng.integers(0, 40, n)).astype("<u4") for n in (0, 1, 5, 30, 60, 60, 9)]
    for held, asked in ((own, own[::-1]), (own[:3], own), (own, own[:1]), ([], own), (own[:1], own)):
        got = simhash._Cell(held, [0] * len(held)).common(asked)
        assert got.tolist() == [[len(np.intersect1d(a, b)) for b in held] for a in asked]


def test_texts_of_a_key_in_parts(spark):
    """All pairs of different classes are compared, however the texts of a key are dealt."""
    rng = np.random.default_rng(6)
    own = {t: {int(x) for x in rng.permutation(14)[:10]} for t in range(60)} | {60: set()}
    sets = spark.createDataFrame([(t, np.array(sorted(s), "<u4").tobytes()) for t, s in own.items()], "text_id long, own binary")
    root = {t: t if t > 25 else 0 for t in own}
    left = spark.createDataFrame([(key, t, root[t]) for key in (1, 2) for t in own if t % 3 or key == 1], "key long, text_id long, root long")
    pairs = {(root[a], root[b]) for a in own for b in own if root[a] != root[b] and own[a] & own[b] and len(own[a] & own[b]) >= 0.6 * len(own[a] | own[b])}
    from permlab.operators.graph import components

    want = {tuple(r) for r in components(spark.createDataFrame([*pairs], "a long, b long")).collect()}
    for cell, most in ((2048, 1 << 24), (9, 1 << 24), (2048, 100)):
        got = {tuple(r) for r in components(simhash._between_classes(left, sets, 0.6, cell, most)).collect()}
        assert got == want and len(want) > 10
