"""Greedy searches by rounds of joins against the sequential ones, whatever is ended in one task."""

import numpy as np
import pytest

from permlab.operators import graph, rounds


def sequential_kings(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    cover, out = set(), []
    for u in sorted(near):
        if not near[u] & cover:
            out.append(u)
            cover |= near[u] | {u}
    return out


def graphs():
    rng = np.random.default_rng(3)
    yield "random", {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 40, (50, 2)) if a != b}
    yield "star, path and clique", {(0, k) for k in range(1, 8)} | {(20 + k, 21 + k) for k in range(5)} | {(40 + a, 40 + b) for a in range(5) for b in range(a)}


@pytest.mark.parametrize("name, pairs", [*graphs()], ids=[n for n, _ in graphs()])
def test_rounds_are_sequential_searches(spark, name, pairs):
    rows = [*pairs, *list(pairs)[:5], *[(b, a) for a, b in list(pairs)[:5]], (7, 7)]
    edges = spark.createDataFrame(rows, "a long, b long")
    plain = sorted((min(p), max(p)) for p in pairs)
    nodes = lambda df: sorted(r.node for r in df.collect())
    assert nodes(rounds.matching_cover(edges.limit(0))) == []
    assert nodes(rounds.matching_cover(edges)) == graph.matching_cover(plain) == nodes(rounds.matching_cover(edges, 10))
    assert nodes(rounds.greedy_removal(edges)) == sorted(graph.greedy_removal(plain)) == nodes(rounds.greedy_removal(edges, 25))
    assert nodes(rounds.dominating(edges)) == sorted(graph.dominating(plain))
    assert nodes(rounds.dominating(edges, 3)) == sorted(graph.dominating(plain, 3))
    assert nodes(rounds.kings(edges)) == sequential_kings(plain)


def test_components_in_one_task_are_those_of_rounds(spark):
    rng = np.random.default_rng(4)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))], "a long, b long")
    found = lambda small: {tuple(r) for r in graph.components(edges, small).collect()}
    assert found(0) == found(1000)


def test_partly_dominating_goes_back():
    star = [(0, k) for k in range(1, 6)] + [(10, k) for k in range(11, 16)] + [(5, 11)]
    assert graph.partly_dominating(star, newbies=5, left=3) == [0, 10]
    # taking 0 first leaves too little for 1, so the search goes back
    pairs = [(0, 2), (0, 3), (0, 4), (1, 3), (1, 4), (1, 5), (1, 6), (2, 7), (2, 8), (2, 9)]
    got = graph.partly_dominating(pairs, newbies=3, left=4)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    covered = set()
    for x in got:
        assert x not in covered and len(near[x] - covered) >= 3
        covered |= near[x]
    assert len(near) - len(covered) < 4 and got[0] != 0
    assert graph.partly_dominating(pairs, newbies=5, left=1) is None
    with pytest.raises(RuntimeError, match="steps"):
        graph.partly_dominating(pairs, newbies=1, left=0, budget=5)
