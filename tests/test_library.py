"""Functions, relations, graphs and searches against plain Python and known figures."""

from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from permlab.functions import columns as C
from permlab.functions import numbers
from permlab.operators import generate as G
from permlab.operators import graph, search
from permlab.operators import relations as R


def cheb(u, v):
    return max(abs(x - y) for x, y in zip(u, v))


def frame(spark, rows):
    return spark.createDataFrame([(k, list(map(int, u))) for k, u in enumerate(rows)], "row_id long, u array<int>")


def rows_of(df):
    return [tuple(r["u"]) for r in df.orderBy("row_id").collect()]


@pytest.fixture(scope="module")
def array():
    r = np.random.default_rng(1)
    rows = [tuple(r.permutation(6)) for _ in range(60)]
    return rows + rows[:5]


def test_conflicts_degrees_and_score(spark, array):
    df, d = frame(spark, array), 3
    pairs = {(a, b) for a, b in combinations(range(len(array)), 2) if cheb(array[a], array[b]) < d}
    assert {(r.a, r.b) for r in R.conflicts(df, d).collect()} == pairs
    deg = [sum(k in p for p in pairs) for k in range(len(array))]
    assert [r.degree for r in R.degrees(df, d).orderBy("row_id").collect()] == deg
    s = R.score(df, d).first()
    assert (s.n_rows, s.conflicts, s.score, s.coverage, s.verified) == (len(array), len(pairs), 2 * len(pairs), deg.count(0), not pairs)
    assert {tuple(r) for r in R.ranked(df, d).select("row_id", "rank").collect()} == {(k, i + 1) for i, k in enumerate(sorted(range(len(array)), key=lambda k: (-deg[k], -k)))}
    empty = R.score(df.limit(0), d).first()
    assert (empty.n_rows, empty.score, empty.verified) == (0, 0, True)


@pytest.mark.parametrize("n, d, rows, foes", [(5, 3, 10, 45), (6, 3, 20, 190), (8, 3, 560, 25480), (8, 4, 70, 2415)])
def test_templates_and_foes(spark, n, d, rows, foes):
    t = G.templates(spark, n, d)
    assert t.count() == rows == G.expected_templates(n, d)
    assert R.foe_pairs(t).count() == 2 * foes + rows


@pytest.mark.parametrize("n, conflicts, sizes", [(4, 1, {2: 1, 1: 4}), (6, 14, {6: 1, 2: 2, 1: 10}), (8, 158, {20: 1, 6: 2, 2: 5, 1: 28})])
def test_lexicographic_arrays(spark, n, conflicts, sizes):
    a = G.lexicographic_array(spark, n)
    edges = R.conflicts(a, n // 2)
    assert edges.count() == conflicts
    members = graph.array_components(a, edges)
    assert {r["size"]: r["n_components"] for r in graph.size_histogram(members).collect()} == sizes


def test_ascending_arrays_are_valid(spark):
    for n, d in ((6, 3), (8, 4)):
        a = G.templates(spark, n, d).select("row_id", C.quick_fill("t", d).alias("u"))
        assert all(sorted(u) == list(range(n)) for u in rows_of(a))
    assert G.near_identity(spark, 4).count() == 1 and G.near_identity(spark, 6).count() == 37 and G.near_identity(spark, 8).count() == 1493


def test_violations(spark):
    rows = [[0, 1, 2], [2, 1, 0], [0, 1], [0, 0, 2], [0, 1, 3], [-1, 1, 2]]
    got = {r.row_id: r.problem for r in R.invalid_rows(frame(spark, rows)).collect()}
    assert got == {2: "arity", 3: "duplicate", 4: "max", 5: "min"}


def test_ulam_and_pair_value(spark):
    def lcs(u, v):
        return max(len(s) for k in range(len(u) + 1) for s in combinations(u, k) if [x for x in v if x in s] == list(s))

    ps = list(permutations(range(4)))
    df = spark.createDataFrame([(list(u), list(v)) for u in ps for v in ps], "u array<int>, v array<int>").select("u", "v", C.ulam("u", "v").alias("x"))
    assert all(r.x == 4 - lcs(tuple(r.u), tuple(r.v)) for r in df.collect())
    rows = [(["L", "6", "L"], ["6", "L", "H"], -5), (["L", "7"], ["6", "L"], None), (["8", "L"], ["L", "H"], 0), (["L", "7"], ["7", "L"], -1), (["L", "6"], ["7", "L"], -2)]
    df = spark.createDataFrame([(u, v) for u, v, _ in rows if _ is not None], "u array<string>, v array<string>")
    assert [r.x for r in df.select(C.pair_value("u", "v").alias("x")).collect()] == [x for *_, x in rows if x is not None]


def test_bounds():
    assert float(numbers.lower_bound(40, 10)) == 92.8666 and float(numbers.lower_bound(50, 10)) == 22.2363 and float(numbers.lower_bound(80, 20)) == 52380.9334
    assert numbers.coverage_score([0, 0, 3]) == -1


def test_covers_cliques_and_removal():
    r = np.random.default_rng(2)
    for _ in range(30):
        n = 9
        pairs = [(a, b) for a, b in combinations(range(n), 2) if r.random() < 0.3]
        covers = [c for k in range(n + 1) for c in combinations(range(n), k) if all(a in c or b in c for a, b in pairs)]
        best = min(map(len, covers))
        found = graph.least_cover(pairs)
        assert len(found) == best and all(a in found or b in found for a, b in pairs)
        for cover in (graph.matching_cover(pairs), graph.greedy_removal(pairs)):
            assert all(a in cover or b in cover for a, b in pairs)
        assert len(graph.matching_cover(pairs)) <= 2 * best
        near = {x: {y for p in pairs if x in p for y in p} | {x} for p in pairs for x in p}
        assert set().union(*(near[x] for x in graph.dominating(pairs)), set()) == set(near)
        full = [c for k in range(2, n + 1) for c in combinations(sorted(near), k) if all((a, b) in pairs for a, b in combinations(c, 2))]
        assert graph.cliques(pairs) == sorted(list(c) for c in full if not any(set(c) < set(x) for x in full))


def test_removal_in_spark(spark, array):
    df = frame(spark, array)
    edges = R.conflicts(df, 3)
    kept = graph.cleaned(df, edges)
    assert R.score(kept, 3).first().verified
    gone = graph.greedy_removal([(r.a, r.b) for r in edges.collect()])
    assert {r.row_id for r in kept.collect()} == set(range(len(array))) - set(gone)
    assert graph.largest_independent(df, R.conflicts(df, 2)).count() >= graph.cleaned(df, R.conflicts(df, 2)).count()


@pytest.mark.parametrize("options", [{}, {"pick": "degree"}, {"objective": "coverage"}, {"move": "subset"}, {"image": "complement"}, {"candidates": 4}, {"masked": True}])
def test_climbing_keeps_what_it_must(options):
    r = np.random.default_rng(3)
    rows = np.array([r.permutation(6) for _ in range(12)])
    start = search.conflict_matrix(rows, 3, search.IMAGES[options.get("image")], options.get("masked", False)).sum()
    found, score, log = search.climb(rows, 3, 5, steps=300, **options)
    again, _, _ = search.climb(rows, 3, 5, steps=300, **options)
    assert np.array_equal(found, again) and (np.sort(found, 1) == np.arange(6)).all()
    assert score <= start or options.get("objective") == "coverage"
    assert score == search.conflict_matrix(found, 3, search.IMAGES[options.get("image")], options.get("masked", False)).sum()
    if options.get("move") != "subset":
        assert np.array_equal(found // 3, rows // 3)


def test_maintained_conflicts_are_those_found_anew(spark, array):
    df = frame(spark, array)
    new = R.replaced(R.conflicts(df, 3), df, 7, [5, 4, 3, 2, 1, 0], 3)
    changed = list(array)
    changed[7] = (5, 4, 3, 2, 1, 0)
    assert {(r.a, r.b) for r in new.collect()} == {(r.a, r.b) for r in R.conflicts(frame(spark, changed), 3).collect()}


def test_searches(spark):
    kept = search.lexicode(4, 4, 2)
    assert kept[0] == [0, 1, 2, 3] and all(cheb(u, v) >= 2 for u, v in combinations(kept, 2))
    assert all(any(cheb(u, v) < 2 for v in kept) for u in permutations(range(4)) if list(u) not in kept)
    slots = [[[0, 1, 2], [2, 1, 0]], [[0, 2, 1], [2, 0, 1]], [[1, 2, 0]]]
    best = search.choose(slots, 2, skip=True)
    assert all(cheb(slots[a][x], slots[b][y]) >= 2 for (a, x), (b, y) in combinations(best, 2))
    ways = search.frontier(spark.createDataFrame([(k, u) for k, s in enumerate(slots[:2]) for u in s], "slot int, u array<int>"), 2)
    assert {tuple(map(tuple, r["rows"])) for r in ways.collect()} == {(tuple(u), tuple(v)) for u in slots[0] for v in slots[1] if cheb(u, v) >= 2}
    rows = np.array(search.lexicode(5, 5, 3))
    assert not search.conflict_matrix(search.increment(rows, 3, [[4, 3, 2, 1, 0]], 1), 3).any()
    r = np.random.default_rng(4)
    mess = np.array([r.permutation(6) for _ in range(8)])
    assert search.conflict_matrix(search.tournament(mess, 3, 2), 3).sum() <= search.conflict_matrix(mess, 3).sum()
    assert R.score(search.construct(spark, 6, 3), 3).first().n_rows == 20
    assert len(search.largest([list(u) for u in permutations(range(3))], lambda u, v: cheb(u, v) >= 2)) >= 2


def test_greedy_weaves(spark):
    rows = rows_of(G.weave_high(G.lexicographic_array(spark, 4), 6, 2))
    kept = search.greedy_keep(rows, 3)
    more = search.greedy_keep(rows, 3, orders=search.high_orders(6, 2))
    for found in (kept, more):
        assert all(cheb(u, v) >= 3 for u, v in combinations(found, 2))
    assert all(any(cheb(u, v) < 3 for v in kept) for u in rows if list(u) not in kept) and len(more) >= len(kept)
