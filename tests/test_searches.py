"""Searches over many small arrays at once against plain Python."""

from itertools import combinations, permutations, product
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from permlab.functions import columns as C
from permlab.operators import blocks, choose, compatible, complete, covering, lazy, model, moves, search
from permlab.operators import generate as G
from permlab.sources.storage import shared_dir


def cheb(u, v):
    return max(abs(x - y) for x, y in zip(u, v, strict=True))


def ways(rows, d):
    """All completions of rows (groups, given symbols)."""
    n = len(rows[0][0])
    fits = [[u for u in permutations(range(n)) if all(x // d == g and (s is None or s == x) for x, g, s in zip(u, t, given, strict=True))] for t, given in rows]
    return [us for us in product(*fits) if all(cheb(u, v) >= d for u, v in combinations(us, 2))]


PUZZLES = {
    0: [([0, 1, 0, 1], [0, None, None, 3]), ([1, 0, 0, 1], [None, None, None, None])],
    1: [([0, 1, 0, 1], [None] * 4)] * 2,  # equal groups are never two apart
    2: [([0, 1, 0, 1], [1, 1, None, None]), ([1, 0, 1, 0], [None] * 4)],  # a symbol twice, out of its group
    3: [([0, 0, 1, 1], [None] * 4), ([0, 1, 0, 1], [None] * 4), ([1, 0, 0, 1], [2, None, None, None])],
    4: [([0, 0, 1, 1], [0, 1, None, None])],  # one row alone
}


def puzzles(spark):
    return spark.createDataFrame([(p, r, t, g) for p, rows in PUZZLES.items() for r, (t, g) in enumerate(rows)], "puzzle long, row int, t array<int>, given array<int>")


def test_completions(spark):
    found = {}
    for r in complete.completions(puzzles(spark), 2).collect():
        found.setdefault((r.puzzle, r.state), {})[r.row] = tuple(r.u)
    got = sorted((p, tuple(rows[k] for k in sorted(rows))) for (p, _), rows in found.items())
    assert got == sorted((p, us) for p, rows in PUZZLES.items() for us in ways(rows, 2))
    assert complete.completions(puzzles(spark).limit(0), 2).collect() == []


def test_completions_are_dealt_anew(spark):
    """What a task doesn't come to within its steps goes on elsewhere, with the same result."""
    found = lambda steps: sorted((r.puzzle, r.state, r.row, r.u) for r in complete.completions(puzzles(spark), 2, steps).collect())
    assert found(2) == found(1024) != []


def test_realised(spark):
    got = {r.puzzle: r.rows for r in complete.realised(puzzles(spark), 2).collect()}
    want = {p: min(ways(rows, 2), default=None) for p, rows in PUZZLES.items()}
    assert {p: rows and tuple(map(tuple, rows)) for p, rows in got.items()} == want and want[1] is None and want[3]


def test_compatible_seeds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    seeds = {s: [rng.permutation(6).tolist() for _ in range(2)] for s in range(40)} | {90: [[0, 1, 2, 3, 4, 5]]}
    rows = spark.createDataFrame([(s, k, list(map(int, u))) for s, us in seeds.items() for k, u in enumerate(us)], "seed long, nth long, u array<int>")
    whole = compatible.whole_seeds(rows)
    good = {(a, b) for a, b in combinations(range(40), 2) if all(cheb(u, v) >= 4 for u in seeds[a] for v in seeds[b])}
    monkeypatch.setattr(compatible, "BUCKET", 32768)
    monkeypatch.setattr(compatible, "PROBES", 7)
    pairs = compatible.compatible_pairs(whole, 4)
    assert {tuple(r) for r in pairs.collect()} == good and good
    triples = {(a, b, c) for a, b in good for c in range(40) if (a, c) in good and (b, c) in good}
    assert {tuple(r.seeds) for r in compatible.compatible_sets(pairs, 3).collect()} == triples
    probe = spark.createDataFrame([(7, [u for s in (1, 2) for u in seeds[s]]), (8, [[0, 1]]), (9, [])], "probe long, rows array<array<int>>")
    want = {(7, s) for s in range(40) if all(cheb(u, v) >= 4 for t in (1, 2) for u in seeds[t] for v in seeds[s])}
    assert {tuple(r) for r in compatible.compatible(compatible.seed_index(whole, 4), probe).collect()} == want
    assert compatible.compatible_pairs(whole.limit(0), 4).collect() == []


@pytest.mark.parametrize("block", [4, 17, 8192])
def test_triples_of_seeds_are_neither_written_nor_shuffled(spark, monkeypatch, block):
    rng = np.random.default_rng(3)
    seeds = {3 * s - 20: [rng.permutation(6).tolist() for _ in range(2)] for s in range(70)}
    seeds |= {1000 + s: seeds[-20] for s in range(3)}
    whole = spark.createDataFrame([(s, us) for s, us in seeds.items()], "seed long, rows array<array<int>>")
    good = {(a, b) for a, b in combinations(sorted(seeds), 2) if all(cheb(u, v) >= 4 for u in seeds[a] for v in seeds[b])}
    want = sorted((a, b, c) for a, b in good for c in seeds if (a, c) in good and (b, c) in good)
    written, staged = [], compatible.staged
    monkeypatch.setattr(compatible, "staged", lambda df, label, *more: written.append(df.count()) or staged(df, label, *more))
    monkeypatch.setattr(compatible, "BLOCK", block)
    monkeypatch.setattr(compatible, "FOUND", 5)
    got = compatible.compatible_triples(whole, 4)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 300
    assert max(written, default=0) <= len(seeds)
    assert compatible.compatible_triples(whole.limit(0), 4).collect() == []
    assert compatible.compatible_triples(whole.limit(1), 4).collect() == []


def test_pairs_of_seeds_are_passed_on(monkeypatch):
    """What many probes find is not held together."""
    import pyarrow as pa

    monkeypatch.setattr(compatible, "FOUND", 100)
    bits = np.full(compatible.BUCKET // 64, ~np.uint64(0)).tobytes()
    index = {"probe": None, "rows": None, "far": [{"nth": 0, "col": 0, "of": 0, "bits": bits}], "ids": list(range(30)), "k": 1, "n": 1, "m": 1}
    probes = [{"probe": 500 + p, "rows": [[0]], "far": None, "ids": None, "k": None, "n": None, "m": None} for p in range(2000)]
    types = pa.schema([("probe", pa.int64()), ("rows", pa.list_(pa.list_(pa.int32()))), ("far", pa.list_(pa.struct([("nth", pa.int32()), ("col", pa.int32()), ("of", pa.int32()), ("bits", pa.binary())]))), ("ids", pa.list_(pa.int64())), *[(c, pa.int32()) for c in "knm"]])
    got = list(compatible._meet([pa.RecordBatch.from_pylist([index, *probes], schema=types)]))
    assert max(b.num_rows for b in got) < 100 + 30
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [(500 + p, s) for p in range(2000) for s in range(30)]



def test_model_of_an_array(spark):
    rows = [list(u) for u in G.ascending_array(spark, 6, 3).orderBy("row_id").select("u").toPandas()["u"].map(list)]
    rows = [list(map(int, u)) for u in rows if cheb(u, rows[0]) >= 3][:4]
    rows = next([list(a), list(b), list(c)] for a, b, c in combinations(rows + [[0, 1, 2, 3, 4, 5]], 3) if min(cheb(a, b), cheb(a, c), cheb(b, c)) >= 3)
    grid = spark.createDataFrame([(1, k, [x // 3 for x in u]) for k, u in enumerate(rows)], "model long, row int, t array<int>")
    check = lambda us: sorted(tuple(r)[1:] for r in model.broken(model.terms(grid, 3), model.constraints(grid), spark.createDataFrame([(1, k, u) for k, u in enumerate(us)], "model long, row int, u array<int>")).collect())
    assert check(rows) == []
    spoilt = [rows[0], [*rows[1][:5], rows[1][0]], list(rows[0])]
    want = [("symbol", 1, rows[1][5], 0), ("symbol", 1, rows[1][0], 2)] + [("group", k, c, 0) for k in (1, 2) for c in range(6) if spoilt[k][c] // 3 != rows[k][c] // 3]
    want += [("apart", a, b, 0) for a, b in combinations(range(3), 2) if cheb(spoilt[a], spoilt[b]) < 3]
    assert check(spoilt) == sorted(want)
    assert all(2 in r[1:3] for r in check(rows[:2])) and check(rows[:2])


def test_conflicts_on_demand(spark):
    rng = np.random.default_rng(5)
    rows = {k: rng.permutation(6).tolist() for k in range(50)}
    frame = lambda some: spark.createDataFrame([(k, list(map(int, u))) for k, u in some.items()], "row_id long, u array<int>")
    ids = lambda *some: spark.createDataFrame([(k,) for k in some], "row_id long")
    array, state = frame(rows), lazy.Conflicts.new(spark, 4)
    near = lambda k: {j for j in rows if j != k and cheb(rows[k], rows[j]) < 4}
    assert {tuple(r) for r in state.ask(array, ids(3, 4, 3, 99)).collect()} == {(k, j) for k in (3, 4) for j in near(k)}
    assert {tuple(r) for r in state.ask(array, ids(4)).collect()} == {(4, j) for j in near(4)} and state.version == 1
    new = {3: rows[10], 20: rows[3], 21: rows[21]}
    rows |= new
    array = state.replace(array, frame(new))
    state = lazy.Conflicts.open(spark, state.folder, 4)
    assert {tuple(r) for r in state.edges().collect()} == {(min(k, j), max(k, j)) for k in (3, 4) for j in near(k)}
    assert [(r.batch, r.rows, r.joined) for r in state.log().orderBy("version").collect()] == [("ask", 2, 2), ("replace", 3, 3)]


def test_choices_cut_most_of_the_tree(spark):
    rng = np.random.default_rng(1)
    slots = [(p, s, o, list(map(int, rng.permutation(6)))) for p in range(4) for s in range(2, 8) for o in range(5)]
    frame = spark.createDataFrame(slots, "puzzle long, slot int, option int, u array<int>")
    worth = lambda u, v: min(cheb(u, v), 4) - 4
    found, log = choose.best_choices(frame, 1, lambda u, v: F.least(C.distance(u, v), F.lit(4)) - 4)
    for r in found.collect():
        options = [[(o, u) for p, t, o, u in slots if p == r.puzzle and t == s] for s in range(2, 8)]
        every = [([o for o, _ in w], sum(worth(u, v) for (_, u), (_, v) in combinations(w, 2))) for w in product(*options) if all(cheb(u, v) >= 1 for (_, u), (_, v) in combinations(w, 2))]
        assert (r.path, r.worth) == min(every, key=lambda x: (-x[1], x[0]))
    assert sum(r.opened for r in log.collect()) < 0.5 * 4 * sum(5**k for k in range(1, 7))
    assert choose.best_choices(frame.limit(0), 1)[0].collect() == []


def test_fullest_fillings_without_listing_them(spark):
    rng = np.random.default_rng(7)
    u = [0, 3, 1, 4, 2, 5]
    held = [[int(x) for x in rng.permutation(6)] for _ in range(8)]
    rows = spark.createDataFrame([(1, u)], "row_id long, u array<int>")
    against = spark.createDataFrame([(1, v) for v in held + held[:3]], "row_id long, v array<int>")
    got = covering.fullest(rows, against, 3).first()
    every = [[x // 3 * 3 + y for x, y in zip(u, f, strict=True)] for f in product(range(3), repeat=6)]
    covered = [sum(cheb(f, v) >= 3 for v in held + held[:3]) for f in every]
    best = [f for f, c in zip(every, covered, strict=True) if c == max(covered)]
    assert (got.covered, got.n_fillings, got["first"]) == (max(covered), len(best), min(best))
    nine = [0, 3, 6, 1, 4, 7, 2, 5, 8]
    found = covering.best_cover(nine, [("".join(str(int(abs(x // 3 * 3 + y - v) >= 3)) for x, v in zip(nine, row, strict=True) for y in range(3)), 1) for row in (rng.permutation(9).tolist() for _ in range(60))], 3)
    assert found[0] <= 60 and len(found[2]) == 9


def test_revolving_door(spark):
    rows = [tuple(r.ps) for r in G.combinations_in(spark, 8, 3).orderBy("id").collect()]
    assert sorted(rows) == sorted(combinations(range(8), 3))
    assert all(len(set(a) & set(b)) == 2 for a, b in zip(rows, rows[1:] + rows[:1], strict=True))
    assert [tuple(r.ps) for r in G.combinations_in(spark, 8, 3, first=20, many=5).orderBy("id").collect()] == rows[20:25]
    masks = [tuple(r.ps) for r in G.combinations_in(spark, 7, 3, "mask").orderBy("id").collect()]
    assert masks == sorted(combinations(range(7), 3), key=lambda ps: sum(1 << p for p in ps))
    large = G.combinations_in(spark, 40, 20, first=comb(40, 20) - 2).orderBy("id").collect()
    assert len(large) == 2 and len(set(large[0].ps) & set(large[1].ps)) == 19


def test_a_chain_that_stops_goes_on_as_if_unbroken(spark):
    array = G.weave_high(G.ascending_array(spark, 4, 2), 6, 2)
    whole = {(r.seed, r.row_id, tuple(r.u)) for r in search.chains_until(array, 2, [1, 2], shared_dir(spark, "chains"), segments=3, steps=15).collect()}
    folder = shared_dir(spark, "chains")
    first = search.chains_until(array, 2, [1, 2], folder, seconds=0, steps=15)
    assert {r.segment for r in first.collect()} == {1}
    assert {(r.seed, r.row_id, tuple(r.u)) for r in search.chains_until(array, 2, [1, 2], folder, segments=3, steps=15).collect()} == whole
    open(f"{folder}/stop", "w").close()
    assert {r.segment for r in search.chains_until(array, 2, [1, 2], folder, segments=9, steps=15).collect()} <= {3}


def plan_gain(rows, plan, d):
    score = lambda us: sum(cheb(a, b) < d for a, b in combinations(us.values(), 2))
    return score(rows) - score(rows | plan)


def test_a_repair_of_three_moves_is_found(spark):
    rows = {0: [0, 1, 2, 3], 1: [0, 1, 3, 2], 2: [1, 0, 2, 3], 3: [2, 3, 0, 1], 4: [2, 3, 1, 0], 5: [0, 2, 1, 3]}
    frame = spark.createDataFrame(list(rows.items()), "row_id long, u array<int>")
    d, every = 2, [list(u) for u in permutations(range(4))]
    pots = {k: [v for v in every if [x // d for x in v] == [x // d for x in u] and len({x // d for x, y in zip(u, v, strict=True) if x != y}) == 1] for k, u in rows.items()}
    got = {(tuple((m.row_id, tuple(m.u)) for m in r.plan), r.gain) for r in moves.look_ahead(frame, d, depth=3, width=None).collect()}
    assert all(plan_gain(rows, {k: list(u) for k, u in plan}, d) == gain for plan, gain in got)

    def grown(now, plan, total):
        out = set()
        bad = {k for a, b in combinations(now, 2) if cheb(now[a], now[b]) < d for k in (a, b)} - {k for k, _ in plan}
        for k in bad:
            for v in pots[k]:
                gain = plan_gain(now, {k: v}, d)
                if gain >= 0:
                    more = (*plan, (k, tuple(v)))
                    if total + gain > 0:
                        out.add((more, total + gain))
                    if len(more) < 3:
                        out |= grown(now | {k: v}, more, total + gain)
        return out

    assert got == grown(rows, (), 0)
    assert moves.look_ahead(frame.where("row_id IN (0, 3)"), d).collect() == []


def test_blocks_by_themselves(spark):
    rng = np.random.default_rng(3)
    rows = {b: [rng.permutation(4).tolist() for _ in range(9)] for b in range(5)}
    frame = spark.createDataFrame([(b, k, list(map(int, u))) for b, us in rows.items() for k, u in enumerate(us)], "block long, row_id long, u array<int>")

    def kept(us, complementing):
        held, names, turned = [], [], 0
        for k, u in enumerate(us):
            other = [[3 - x for x in v] for v in held]
            if all(cheb(u, v) >= 2 for v in held):
                held, names = [*held, u], [*names, k]
            elif complementing and all(cheb(u, v) >= 2 for v in other):
                held, names, turned = [*other, u], [*names, k], turned + 1
        return names, held, turned

    for complementing in (False, True):
        got = {}
        for r in blocks.kept_greedily(frame, 2, complementing).orderBy("row_id").collect():
            got.setdefault(r.block, []).append((r.row_id, list(r.u), r.score))
        assert got == {b: [(k, u, t) for k, u in zip(*kept(us, complementing)[:2], strict=True)] for b, us in rows.items() for t in [kept(us, complementing)[2]]}
    sizes = {b: max(len(s) for k in range(10) for s in combinations(us, k) if all(cheb(u, v) >= 2 for u, v in combinations(s, 2))) for b, us in rows.items()}
    assert {r.block: r["count"] for r in blocks.largest(frame, 2).groupBy("block").count().collect()} == sizes
    for found in (blocks.climbed(frame, 2, steps=30), blocks.climbed(frame, 2, kind="disturb", steps=30), blocks.tournaments(frame, 2, rounds=2, steps=20), blocks.incremented(frame, 2, steps=10)):
        assert all(r.valid and r.scored for r in blocks.checked(found, 2).collect())
    assert blocks.climbed(frame.limit(0), 2).collect() == []
