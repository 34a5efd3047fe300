import math

import numpy as np
import pytest

from permlab.llm import topk


def brute(rows, k=5, every=50):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(fine):
        if i is not None and i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0, j) for other, (j, v) in enumerate(fine) if other != at and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, _, _, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def rows():
    r = np.random.default_rng(8)
    out = [(int(i), r.normal(0, 0.2, 6).round(2).tolist()) for i in range(700)]
    out += [(int(i), [0.5] * 6) for i in range(1000, 1300)]  # a common vector
    out += [(50, [0.5] * 6), (50, [0.5] * 6), (50, [-0.1] * 6), (None, [0.9] * 6), (None, [0.9] * 6)]
    out += [(100, [1.0, 2.0]), (101, [2.0, -1.0]), (150, [3.0]), (2000, None), (2050, []), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2150, [float("nan")] + [0.0] * 5), (2200, [float("inf")] + [1.0] * 5)]
    return out


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, v, "z") for i, v in rows()], "vec_id long, embedding array<float>, score string")
    want = brute(rows())
    for options in ({}, {"shard": 100, "block": 7}):
        assert sorted(map(tuple, topk.top_k(df, **options).collect()), key=repr) == want
    assert topk.top_k(df.limit(0)).collect() == []
    assert topk.top_k(df.where("vec_id % 50 <> 0")).collect() == []


def test_large_components_are_exact_or_an_error(spark):
    r = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(v)) for v in r.normal(0, 1e6, 5)]) for i in range(120)]  # scores beyond 2^53, within 2^63
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, shard=40).collect()), key=repr) == brute(rows)
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 1e9])], "vec_id long, embedding array<float>")).collect()
    with pytest.raises(Exception, match="beyond 2.53"):
        topk.top_k(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<float>")).collect()


def test_tree_opens_few_leaves_where_balls_are_apart():
    r = np.random.default_rng(0)
    points = np.concatenate([r.normal(0, 3, (500, 8)) + 1000 * r.normal(0, 1, 8) for _ in range(20)]).round().astype(np.int64)
    tree = topk.BallTree(points, np.arange(len(points)), np.arange(len(points)), leaf=16)
    asks = points[::97]
    best = topk.Best(len(asks), 5)
    opened = tree.search(asks, np.full(len(asks), -1), best)
    order = np.lexsort((best.id, -best.score, best.query))
    got = list(zip(best.query[order].tolist(), (-best.score[order]).tolist(), best.id[order].tolist(), strict=True))
    want = [(i, s, j) for i, q in enumerate(asks) for s, j in sorted(zip((-(points @ q)).tolist(), range(len(points))))[:5]]
    assert got == want
    assert opened < tree.leaf.sum() * len(asks) / 10


def test_the_kth_score_of_other_shards_closes_leaves():
    r = np.random.default_rng(1)
    points = np.concatenate([r.normal(0, 3, (200, 8)) + 300 * r.normal(0, 1, 8) for _ in range(20)]).round().astype(np.int64)
    asks, own = points[::50], np.full(80, -1)
    numbers = np.arange(2000)
    one, other = topk.BallTree(points[::2], numbers, numbers, 16), topk.BallTree(points[1::2], numbers, numbers, 16)
    alone = other.search(asks, own, topk.Best(80, 5))
    best = topk.Best(80, 5)
    one.search(asks, own, best)
    assert other.search(asks, own, best) < alone
