import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from permlab.llm import passages as p
from permlab.llm import shingling

RNG = np.random.default_rng(9)
SAY = lambda n: [f"{w:x}Q" for w in RNG.integers(0, 10**6, n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=40), min_size=1, max_size=4), st.integers(1, 8))
def test_windows_hold_every_passage_once(texts, least):
    at = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    values = np.array([y for x in texts for y in x], np.uint64)
    got = list(zip(*(x.tolist() for x in p.windows(values, at, least)), strict=True))
    for a, b in zip(at[:-1], at[1:]):
        for i in range(a, b):
            for j in range(i + least, b + 1):
                c = i + int(values[i:j].argmin())
                assert [w for w in got if w[0] <= i <= w[1] < j <= w[2]] == [w for w in got if w[1] == c and w[0] <= i and j <= w[2]]
                assert sum(w[0] <= i <= w[1] < j <= w[2] for w in got) == 1


def test_shingles_alone_or_together(monkeypatch):
    texts = [None, "", "a b c d", "A b c d e", " ".join(SAY(300)), "x\x0by\tz  w v u", "é ß " * 40]
    s, at = p.shingles(pa.array(texts, pa.string()))
    assert np.diff(at).tolist() == [max(0, len((t or "").split()) - 4) for t in texts]
    monkeypatch.setattr(shingling, "STEP", 30)
    again, _ = p.shingles(pa.array(texts, pa.string()))
    assert np.array_equal(s, again)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=40), st.sampled_from([0.5, 0.8, 8 / 9]))
def test_longest_dense_run(hits, share):
    hits = np.array(hits, bool)
    runs = [(b - a) for a in range(len(hits)) for b in range(a + 1, len(hits) + 1) if hits[a] and hits[b - 1] and hits[a:b].sum() >= share * (b - a) - 1e-9]
    got = p._dense(hits, share)
    assert (got is None) == (not runs)
    if runs:
        assert got[1] - got[0] == max(runs)


def documents():
    shared, other, long = SAY(55), SAY(60), SAY(400)
    near = list(shared)
    near[20] = "changed"
    far = [w if k % 6 else "changed" for k, w in enumerate(other)]
    rows = [(3, SAY(100) + shared + SAY(50)), (8, shared), (9, SAY(10) + [w.upper() for w in shared] + SAY(300)), (11, SAY(90) + near + SAY(90)), (12, other + SAY(50)), (13, SAY(50) + far), (20, long), (21, SAY(30) + long[:200] + SAY(20) + long[200:]), (30, SAY(500)), (31, shared[:40] + SAY(100)), (32, "of the of the of the".split() * 60)]
    rows = [(i, " ".join(w)) for i, w in rows] + [(40, None), (41, ""), (None, " ".join(shared)), (8, " ".join(shared))]
    return rows


def test_documents(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in documents()], "doc_id long, text string, key string")
    got = p.near_duplicate_passages(df).collect()
    texts = {i: (t or "").lower().split() for i, t in documents() if i is not None}
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    for r in got:
        a, b = (grams(texts[d][k : k + n]) for d, k, n in ((r.doc_id, r.word, r.words), (r.of_id, r.of_word, r.of_words)))
        assert abs(len(a & b) / len(a | b) - r.similarity) < 1e-9 and r.similarity >= 0.8 and min(r.words, r.of_words) >= 50
    links = {(r.of_id, r.doc_id) for r in got}
    assert {(3, 8), (3, 9), (3, 11), (20, 21)} <= links <= {(3, 8), (3, 9), (3, 11), (20, 21), (8, 9), (8, 11), (9, 11)}
    assert {(r.word, r.words, r.of_word, r.of_words) for r in got if (r.of_id, r.doc_id) == (3, 8)} == {(0, 55, 100, 55)}
    assert p.near_duplicate_passages(df.limit(0)).collect() == []


def test_a_denser_stretch_inside_one_that_fails():
    exact = np.arange(60, dtype=np.uint64)
    scattered = np.arange(1000, 1040, dtype=np.uint64)
    one = np.concatenate([exact, scattered])
    other = np.concatenate([exact, np.arange(5000, 5100, dtype=np.uint64), *(np.array([x, 9000 + int(x), 9500 + int(x)], np.uint64) for x in scattered)])
    assert p.compare(one, other) == [(0, 60, 0, 60, 1.0)]


def test_an_exact_passage_whose_least_shingles_a_smaller_document_holds_too(spark):
    rows = []
    for k in range(12):
        passage = SAY(50)
        part = passage[: 20 + 2 * k]
        rows += [(k, SAY(40) + part + SAY(40)), (100 + k, SAY(30) + passage + SAY(60)), (200 + k, passage + SAY(9)), (300 + k, SAY(70) + passage)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.of_id, r.doc_id, r.word, r.words, r.similarity) for r in p.near_duplicate_passages(df).collect()}
    either = {(a + k, b + k, w, 50, 1.0) for k in range(12) for a, b, w in ((100, 200, 0), (100, 300, 70), (200, 300, 70))}
    assert {(100 + k, 200 + k, 0, 50, 1.0) for k in range(12)} | {(100 + k, 300 + k, 70, 50, 1.0) for k in range(12)} <= got <= either


def behind_decoys(seed):
    """A passage, and texts that hold its least shingles of each pair of functions and not the passage."""
    rng = np.random.default_rng(seed)
    say = lambda n: [f"{w:x}V" for w in rng.integers(0, 10**6, n)]
    keys = lambda words: set(p._keyed(np.zeros(1, np.int64), pa.array([" ".join(words)]))[0].tolist())
    for _ in range(2000):
        passage = say(50)
        s, _at = p.shingles(pa.array([" ".join(passage)]))
        at = [int(p.mixed(s ^ x).argmin()) for x in p._SEED]
        if min(at) < 8 or max(at) > 37:
            continue
        decoys, want = [], keys(passage)
        for x, y in zip(at[::2], at[1::2]):
            for _ in range(30):
                decoy = say(25) + passage[min(x, y) : max(x, y) + 5] + say(25)
                if want & keys(decoy):
                    decoys += decoy
                    want -= keys(decoy)
                    break
        if not want:
            return passage, decoys, say
    raise AssertionError("no such passage")


def test_a_head_that_holds_the_passage_behind_its_least_shingles(spark):
    rows = []
    for k in range(3):
        passage, decoys, say = behind_decoys(k)
        rows += [(k, decoys + say(200) + passage + say(60)), (100 + k, say(60) + passage + say(60))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.of_id, r.doc_id) for r in p.near_duplicate_passages(df).collect()}
    assert got == {(k, 100 + k) for k in range(3)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1 << 60), min_size=40, max_size=130), min_size=1, max_size=3))
def test_runs_part_the_starts_by_their_least_shingles(texts):
    at = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    one = np.array([y for x in texts for y in x], np.uint64)
    other = p.mixed(one)
    start, end, least = p.runs([one, other], at)
    got = {s: (int(c), int(e)) for a, b, c, e in zip(start, end, *least, strict=True) for s in range(a, b + 1)}
    want = {int(s): tuple(int(s + v[s : s + p.LEAST].argmin()) for v in (one, other)) for a, b in zip(at[:-1], at[1:]) for s in range(a, b - p.LEAST + 1)}
    assert got == want and sum(end - start + 1) == len(want)


def test_a_repeated_line_is_one_run(monkeypatch):
    texts = ["a b c d e f g " * 400, "x " * 300, " ".join(SAY(500)), ""]
    for bits in (18, 7):
        monkeypatch.setattr(p, "RUN_BITS", bits)
        key, doc, place = p._keyed(np.arange(4), pa.array(texts))
        starts = {d: [] for d in range(4)}
        for d, x in zip(doc.tolist(), place.tolist()):
            first, more = x >> bits + 6, x >> 6 & (1 << bits) - 1
            starts[d] += range(first, first + more + 1)
        for d, t in enumerate(texts):
            n = max(0, len(t.split()) - 4 - p.LEAST + 1)
            assert sorted(starts[d]) == sorted(list(range(n)) * len(p.PAIRS))
        assert (doc == 1).sum() == len(p.PAIRS) * (1 if bits == 18 else 4)


def connected(links):
    """doc -> least document that it is connected with."""
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def near_texts(share, pairs=60, hub=True):
    """Passages of 60 to 90 words in two documents, the second with that share of words replaced, and a smaller document with a part and the same shingles scattered."""
    rows = []
    for k in range(pairs):
        passage = SAY(60 + k % 30)
        near = list(passage)
        for i in RNG.permutation(len(near))[: round(share * len(near))]:
            near[i] = SAY(1)[0]
        scattered = [w for i in range(0, len(passage) - 5, 7) for w in passage[i : i + 5] + SAY(3)]
        rows += [(k, SAY(20) + passage[: 20 + k % 20] + scattered)] if hub else []
        rows += [(1000 + k, SAY(30) + passage + SAY(60)), (2000 + k, SAY(90) + near + SAY(9))]
    return rows


def test_recall_of_near_passages_by_brute_force(spark):
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    wanted = found = 0
    for share in (0.0, 0.01, 0.02, 0.03):
        rows = near_texts(share)
        texts = dict(rows)
        df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
        root = connected((r.of_id, r.doc_id) for r in p.near_duplicate_passages(df).collect())
        for k in range(60):
            # all pairs of stretches of 50 words or more on the common diagonal, without the operator's code
            a, b = texts[1000 + k][30 : 90 + k % 30], texts[2000 + k][90 : 150 + k % 30]
            spans = [(x, y) for x in range(0, len(a) - 49, 3) for y in range(len(a), x + 49, -3)]
            if any(len(grams(a[x:y]) & grams(b[x:y])) >= 0.8 * len(grams(a[x:y]) | grams(b[x:y])) for x, y in spans):
                wanted += 1
                hit = root.get(1000 + k, 0) == root.get(2000 + k, 1)
                found += hit
                assert hit or share
    assert wanted > 150 and found >= 0.9 * wanted


def test_partitions_and_order_change_nothing(spark):
    rows = near_texts(0.02, 40)
    rows = [(i, " ".join(w)) for i, w in rows] + [(5000 + i, " ".join(w)) for i, w in rows[:20]]
    see = lambda df: sorted(map(tuple, p.near_duplicate_passages(df).collect()))
    one = spark.createDataFrame(rows, "doc_id long, text string")
    assert see(one.repartition(1)) == see(one.repartition(17)) and see(one)


def test_a_key_that_many_documents_hold(spark, monkeypatch):
    monkeypatch.setattr(p, "HOT_LEAST", 2)
    monkeypatch.setattr(p, "LOOK", 2)
    monkeypatch.setattr(p, "HOT", 0.01)
    shared = SAY(70)
    df = spark.createDataFrame([(i, " ".join(SAY(i % 7) + shared + SAY(20))) for i in range(300)], "doc_id long, text string")
    assert len(p.hot_keys(df))
    got = p.near_duplicate_passages(df).collect()
    assert set(connected((r.of_id, r.doc_id) for r in got).values()) == {0} and len({r.doc_id for r in got}) == 299
    assert max(np.bincount([r.of_id for r in got])) < 200


def test_a_very_long_text(spark):
    long = SAY(30000)
    df = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(SAY(50) + long)), (3, "the same line again " * 9000), (4, "the same line again " * 9000)], "doc_id long, text string")
    got = p.near_duplicate_passages(df).collect()
    assert (1, 2, 50, 30000) in {(r.of_id, r.doc_id, r.word, r.words) for r in got}
    assert 4 in {r.doc_id for r in got}


def test_near_passages_behind_a_head_that_only_holds_their_least_shingles(spark):
    keys = lambda words: set(p._keyed(np.zeros(1, np.int64), pa.array([" ".join(words)]))[0].tolist())
    rows = []
    for k in range(3):
        passage, decoys, say = behind_decoys(10 + k)
        # one word in each 50 is changed, so no passage of 50 words is the same
        near = next(n for i in range(5, 45) if len(keys(n := passage[:i] + say(1) + passage[i + 1 :]) & keys(passage)) > 1)
        rows += [(k, decoys + say(60)), (100 + k, say(60) + passage + say(60)), (200 + k, say(30) + near + say(60))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = p.near_duplicate_passages(df).collect()
    assert {(r.of_id, r.doc_id) for r in got} == {(100 + k, 200 + k) for k in range(3)}
    assert {(r.word, r.words, r.of_word, r.of_words) for r in got} == {(30, 50, 60, 50)}


def test_runs_of_a_key_are_compared_in_parts(spark, monkeypatch):
    """A head that none is like, two kinds of passages that share their least shingles, and one like neither."""
    monkeypatch.setattr(p, "CELL", 3)
    monkeypatch.setattr(p, "STRAYS", 2)
    rng = np.random.default_rng(4)
    line = SAY(60)
    kinds = [[w if 20 <= i < 40 else f"{rng.integers(0, 10**6):x}W" for i, w in enumerate(line)] for _ in range(4)]
    rows = [(k, SAY(20) + kinds[0 if k == 0 else 3 if k == 20 else 1 + k % 2] + SAY(20)) for k in range(21)]
    for k, (_, w) in enumerate(rows[1:20]):
        w[20 + (k // 2 % 2) * 59] = SAY(1)[0]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    links = p.links(df)
    left = p.unsettled(links, links)
    assert left.agg({"parts": "max"}).first()[0] > 3
    _, cuts = p._read_again(df, links.withColumn("failed", p.F.lit(True)), left)
    root = connected((r.of_id, r.doc_id) for r in p.between(left, cuts, p.LEAST, p.SIMILARITY).collect())
    assert root == {k: 2 - k % 2 if k % 2 == 0 else 1 for k in range(1, 20)}
