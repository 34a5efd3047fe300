"""Going on from files, sinks that publish, budgets, and the two kinds of disturbance."""

from itertools import combinations

import numpy as np
import pytest

from permlab.operators import generate as G
from permlab.operators import graph, search
from permlab.operators import relations as R
from permlab.sources import text


def rows_of(df):
    return [tuple(r["u"]) for r in df.orderBy("row_id").collect()]


def test_resume_takes_the_first_file_of_the_order(spark, tmp_path):
    folder = str(tmp_path / "pa")
    array, name = search.resume(spark, folder, 6, 3)
    assert name is None and rows_of(array) == rows_of(G.ascending_array(spark, 6, 3))
    text.dump(G.ascending_array(spark, 3, 3), f"{folder}/pa_3_choose_3.txt")
    array, name = search.resume(spark, folder, 6, 3)
    assert name == "pa_3_choose_3.txt" and rows_of(array) == rows_of(G.weave_high(G.ascending_array(spark, 3, 3), 6, 3))
    text.dump(G.lexicographic_array(spark, 6), f"{folder}/pa_6_choose_3_unfinished.txt")
    array, name = search.resume(spark, folder, 6, 3)
    assert name == "pa_6_choose_3_unfinished.txt" and rows_of(array) == rows_of(G.lexicographic_array(spark, 6))
    with pytest.raises(ValueError, match="isn't verified"):
        search.resume(spark, folder, 6, 3, verified=True)
    array, name = search.resume(spark, folder, 6, 3, patterns=[("pa_{n}_choose_{d}_symmetric.txt", 0), ("pa_{n}_choose_{d}.txt", 1)])
    assert name == "pa_3_choose_3.txt" and array.count() == 20
    assert search.resume(spark, folder, 7, 3, steps=20)[0].count() > 0


def test_sinks(spark, tmp_path):
    array, path = G.lexicographic_array(spark, 4), str(tmp_path / "a.txt")
    text.publish(array, path)
    text.publish(array, path, "# score: 2")
    assert rows_of(text.load(spark, path, "lenient")) == rows_of(array)
    assert {x.name for x in tmp_path.iterdir()} == {"a.txt"}
    text.dump_annotated(array, f"{tmp_path}/b.txt", R.degrees(array, 2))
    lines = [x for f in sorted((tmp_path / "b.txt").glob("part-*")) for x in f.read_text().split("\n")]
    assert lines[0].startswith("# Disagreements: 1 Counter({") and lines[1] == ""
    assert text.dump_trimmed(array, f"{tmp_path}/pa_4_choose_2.txt", 2, R.happy(array, 2)) == f"{tmp_path}/trimmed_2_from_pa_4_choose_2.txt"
    assert rows_of(text.load(spark, f"{tmp_path}/trimmed_2_from_pa_4_choose_2.txt", "lenient")) == rows_of(R.happy(array, 2))
    text.dump_by_size(array.selectExpr("CAST(row_id % 2 AS INT) AS size", "row_id", "u"), f"{tmp_path}/sizes")
    assert all(x.read_bytes().endswith(b"\r\n") for x in (tmp_path / "sizes").glob("size=*/part-*")) and len(list((tmp_path / "sizes").glob("size=*"))) == 2
    (tmp_path / "named").mkdir()
    for n in (4, 5):
        (tmp_path / "named" / f"pa_{n}_choose_2.txt").write_text("0 1 2 3\n1 0 2 3\n")
    assert [(r.n, r.found) for r in text.misnamed(spark, f"{tmp_path}/named").collect()] == [(5, 4)]


def test_budgets_are_never_passed_in_silence():
    with pytest.raises(search.SearchEnded):
        search.largest([[k] for k in range(30)], lambda u, v: (u[0] + v[0]) % 3 > 0, budget=50)
    with pytest.raises(search.SearchEnded):
        search.choose([[[0, 0]]] * 12, 1, skip=True, budget=20)
    assert search.largest([[k] for k in range(9)], lambda u, v: abs(u[0] - v[0]) > 3) == [[0], [4], [8]]


def test_disturbance_keeps_rows_and_improves():
    rows = []
    for ps in combinations(range(6), 3):
        lows, highs = iter((0, 1, 2)), iter((3, 4, 5))
        rows.append([next(highs) if k in ps else next(lows) for k in range(6)])
    rows = np.array(rows)
    found, score, log = search.disturb(rows, 3, 4, steps=600, gentle=30, great=90)
    again = search.disturb(rows, 3, 4, steps=600, gentle=30, great=90)
    assert np.array_equal(found, again[0]) and score == search.conflict_matrix(found, 3).sum() < search.conflict_matrix(rows, 3).sum()
    assert all(sorted(u) == list(range(6)) for u in found.tolist())
    assert np.array_equal(found >= 3, rows >= 3) and [s for _, s in log] == sorted((s for _, s in log), reverse=True)


def test_cliques_until_one_is_large_enough():
    pairs = [(a, b) for a in range(6) for b in range(a + 1, 6)] + [(0, 9), (9, 10)]
    assert [0, 1, 2, 3, 4, 5] in graph.cliques(pairs) and len(graph.cliques(pairs)) == 3
    assert max(map(len, graph.cliques(pairs, 6))) == 6


def test_templates_and_direct_pairs_agree(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [r.permutation(7).tolist() for _ in range(150)]
    rows += rows[:30] + rows[:10]
    df = spark.createDataFrame(list(enumerate(rows)), "row_id long, u array<int>")
    see = lambda: (sorted(map(tuple, R.conflicts(df, 3).collect())), sorted(map(tuple, R.degrees(df, 3).collect())), R.least_distance(df).first()[0], sorted(map(tuple, R.row_summary(df, 4).collect())))
    direct = see()
    monkeypatch.setattr(R, "SMALL", 0)
    assert see() == direct
    assert len({p[:2] for p in direct[0]}) == len(direct[0]) == sum(x for _, x in direct[1]) // 2 and direct[2] == 0
    alone = df.where("row_id BETWEEN 100 AND 140")
    assert R.least_distance(alone).first()[0] == min(max(abs(x - y) for x, y in zip(rows[a], rows[b])) for a in range(100, 141) for b in range(a))
    assert R.least_distance(df.limit(1)).first()[0] is None and R.nearest_pairs(df.limit(1)).collect() == []
