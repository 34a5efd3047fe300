"""Searches over classes of equal rows against the sequential ones over all rows."""

import numpy as np
import pytest
from tests.test_rounds import sequential_kings

from permlab.operators import classes, graph, rounds


def conflicts(rows, d):
    return [(a, b) for a in rows for b in rows if a < b and max(abs(x - y) for x, y in zip(rows[a], rows[b])) < d]


def arrays():
    rng = np.random.default_rng(11)
    some = [rng.permutation(5).tolist() for _ in range(70)]
    names = rng.permutation(300)[: len(some)].tolist()
    yield "copies, numbers in no order", dict(zip(names, some))
    yield "all equal", {k: [0, 1, 2] for k in range(5)}
    yield "no conflict", {4: [0, 1, 2], 9: [2, 1, 0]}
    yield "no row", {}


@pytest.mark.parametrize("name, rows", [*arrays()], ids=[n for n, _ in arrays()])
def test_classes_are_searched_as_rows(spark, name, rows):
    df = spark.createDataFrame([*rows.items()], "row_id long, u array<int>")
    pairs = conflicts(rows, 2)
    nodes = lambda found: sorted(r.node for r in found.collect())
    assert sorted(r.row_id for r in classes.cleaned(df, 2).collect()) == sorted({*rows} - {*graph.greedy_removal(pairs)})
    assert nodes(classes.searched(df, 2, classes.matching_cover, rounds.matching_cover)) == graph.matching_cover(pairs)
    assert nodes(classes.searched(df, 2, classes.kings, rounds.kings)) == sequential_kings(pairs)
    for least in (1, 3):
        assert nodes(classes.searched(df, 2, lambda held: classes.dominating(held, least), None)) == sorted(graph.dominating(pairs, least))
    assert sorted(r.members for r in classes.maximal_cliques(df, 2).collect()) == graph.cliques(pairs)


def test_cliques_are_found_from_their_least_node(spark):
    """Of one component, by several tasks; edges repeated and both ways."""
    rng = np.random.default_rng(8)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 30, (220, 2)) if a != b})
    edges = spark.createDataFrame([*pairs, *pairs[:9], *[(b, a) for a, b in pairs[:9]], (3, 3)], "a long, b long")
    found = graph.maximal_cliques(edges)
    assert sorted(r.members for r in found.collect()) == graph.cliques(pairs)
    assert found.where("size <> size(members)").isEmpty()


def test_more_than_a_task_searches_goes_by_rounds(spark):
    rows = next(arrays())[1]
    df = spark.createDataFrame([*rows.items()], "row_id long, u array<int>")
    found = lambda whole: sorted(r.row_id for r in classes.cleaned(df, 2, whole).collect())
    assert found(0) == found(1 << 20)


def test_many_classes_in_blocks():
    """More classes than a block of keys has, without Spark, against the sequential search."""
    rng = np.random.default_rng(2)
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 2000, (5000, 2)) if a != b})
    held = classes.Held(np.arange(2000), np.arange(2000), *(np.array(x) for x in zip(*pairs)))
    assert classes.greedy_removal(held) == graph.greedy_removal(pairs)
    assert sorted(classes.matching_cover(held)) == graph.matching_cover(pairs)
    assert classes.dominating(held, 2) == graph.dominating(pairs, 2)
