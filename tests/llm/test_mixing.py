import hashlib
import re


from permlab.llm import mixing


def plain_targets(sizes):
    """Shares by weight again and again; what is above three times the source goes to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in above}


def rows():
    out = [(k, "w " * (k * 7 % 40), f"src{k % 7}") for k in range(900)] + [(k, "w " * 30, None) for k in range(900, 960)]
    return [*out, (2000, None, "src1"), (2001, "", "src1"), (2002, "a\x0bb\x1cc", "Z"), (None, "x y", "src2"), (5, "same row", "src3"), (5, "same row", "src3"), (7, "tiny", "tiny")]


def test_mix(spark):
    df = spark.createDataFrame([(*r, 9) for r in rows()], "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows():
        sizes[s] = sizes.get(s, 0) + size(t)
    want = plain_targets(sizes)
    assert sorted(((r.doc_id, r.size, r.source) for r in got), key=repr) == sorted(((d, size(t), s) for d, t, s in rows()), key=repr)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3 and (r.position is None) == (r.copies == 0)
    for s in sizes:
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - want[s]) <= 40 and abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    again = mixing.mix(df).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_queue_is_by_digest_and_positions_follow_the_schedule(spark):
    df = spark.createDataFrame([(k, "w w", "a" if k % 2 else "b") for k in range(40)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    for s, tilt in (("a", 0.5), ("b", 0.0)):
        mine = sorted((d for d, r in got.items() if r.source == s), key=lambda d: hashlib.md5(f"42:{d}:{hashlib.md5(b'w w').hexdigest()}".encode()).hexdigest())
        at = 1.0
        for d in mine:
            if got[d].copies:
                t = got[d].position
                assert abs(got[d].target * (t + tilt * (t - t * t)) - at) < 1e-6
            at += 2
    order = [r.position for r in mixing.sorted_mix(df).collect() if r.position is not None]
    assert order == sorted(order)


def test_documents(spark):
    df = spark.createDataFrame([(*r, "z") for r in rows()], "doc_id long, text string, source string, mix_nth string")
    counts = {}
    for r in mixing.mix(df).collect():
        counts[r.doc_id, r.source] = counts.get((r.doc_id, r.source), 0) + r.copies
    got = {}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    for r in out.collect():
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    assert got == {k: n for k, n in counts.items() if n}
    assert mixing.mix(df.limit(0)).collect() == [] == mixing.mixed_documents(df.limit(0)).collect()


def test_the_order_of_a_queue_is_not_that_of_its_buckets(spark, monkeypatch):
    df = spark.createDataFrame([(k, "w " * (k % 9 + 1), "abc"[k % 3]) for k in range(200)], "doc_id long, text string, source string")
    see = lambda: sorted((r.doc_id, r.at) for r in mixing.mix(df).collect())
    some = see()
    monkeypatch.setattr(mixing.math, "isqrt", lambda n: 3 * n + 1)
    assert see() == some
    monkeypatch.setattr(mixing.math, "isqrt", lambda n: 1)
    assert see() == some
