import os

from pyspark.sql import functions as F

from permlab.sources import text
from permlab.streaming import watch


def write(folder, name, body):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(body)
    return path


def rows(df):
    return [list(r["u"]) for r in df.orderBy("row_id").collect()]


def test_loaders(spark, tmp_path):
    d = str(tmp_path)
    strict = write(f"{d}/a", "pa_3_choose_2.txt", "# score: 4\n0 1 2 \n\n2 1 0\n")
    assert rows(text.load(spark, strict)) == [[0, 1, 2], [2, 1, 0]]
    assert text.headers(spark, strict).first().score == 4
    assert tuple(text.names(text.headers(spark, f"{d}/a")).select("n", "d").first()) == (3, 2)
    loose = write(f"{d}/b", "x.txt", "0, 1, 2 # note\n[-1 200]\n#\n1 0 # x\n% end\n5 5\n")
    assert rows(text.load(spark, loose, "lenient")) == [[0, 1, 2], [-1, -56], [1, 0]]
    marks = write(f"{d}/c", "y.txt", "[0, 1, 2]\n---\n[-2, 1, 0]\n")
    assert rows(text.load(spark, marks, "digits")) == [[0, 1, 2], [], [2, 1, 0]]
    assert rows(text.load(spark, marks, "nonempty")) == [[0, 1, 2], [2, 1, 0]]
    blocks = write(f"{d}/d", "z.txt", "[[0, 1],\n [1, 0]]\n^ 0 ^\n[1, 0]\n---\n\n[0, 1]\n")
    assert sorted((r.block_id, r.row_id, list(r.u)) for r in text.load_blocks(spark, blocks).collect()) == [(0, 0, [0, 1]), (0, 1, [1, 0]), (1, 0, [1, 0]), (2, 0, [0, 1])]
    bits = write(f"{d}/e", "m", "010\n101\n010\n")
    assert sorted(map(tuple, text.load_bits(spark, bits).collect())) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    state = write(f"{d}/f", "s", "[[1, 2], [0], [0]]")
    assert sorted(map(tuple, text.load_state(spark, state).collect())) == [(0, 1), (0, 2), (1, 0), (2, 0)]
    table = write(f"{d}/g", "b.csv", "5,20,11,4.25\n100,400,201,1.5e34\n")
    assert [tuple(r) for r in text.load_bounds(spark, table).orderBy("k").collect()] == [(5, 20, 11, 4.25), (100, 400, 201, 1.5e34)]


def test_sinks(spark, tmp_path):
    array = text.literals(spark, [[2, 1, 0], [0, 1, 2]])
    path = str(tmp_path / "out")
    assert text.maybe_dump(array, path, 6) and text.headers(spark, path).first().score == 6
    assert rows(text.load(spark, path)) == [[2, 1, 0], [0, 1, 2]]
    assert not text.maybe_dump(array, path, 8) and text.maybe_dump(array, path, 2) and not text.maybe_dump(array, path, 3)
    edges = spark.createDataFrame([(0, 1), (1, 0)], "a long, b long")
    text.dump_edges(edges, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    text.dump_state(edges, str(tmp_path / "j"))
    bounds = spark.createDataFrame([(5, 20, 11, 4.25)], "k int, n int, d int, bound double")
    text.dump_bounds(bounds, str(tmp_path / "c"))
    assert text.load_bounds(spark, str(tmp_path / "c")).collect() == bounds.collect()
    assert text.literals(spark, [["L", 6]]).first()["u"] == ["L", "6"]
    assert text.trimmed_name("x/pa.txt", 3) == "x/trimmed_3_from_pa.txt"


def test_resolve():
    have = ["x/pa_6_choose_2.txt", "x/pa_6_choose_2_unfinished.txt", "x/pa_4_choose_2_verified.txt"]
    assert text.resolve(have, 6, 2) == have[1] and text.resolve(have[2:], 6, 2) == have[2] and text.resolve([], 6, 2) is None


def test_watch(spark, tmp_path):
    folder, kept, points = (str(tmp_path / x) for x in ("in", "kept", "check"))
    write(folder, "pa_3_choose_2.txt", "# score: 4\n0 1 2\n1 0 2\n")
    write(folder, "pa_3_choose_2_b.txt", "# score: 2\n0 1 2\n2 1 0\n")
    write(folder, "pa_4_choose_2.txt", "# score: 0\n0 1 2 3\n")
    watch.watch(spark, folder, kept, points, once=True).awaitTermination()
    assert {(r.n, r.d, r.score) for r in watch.current(spark, kept).collect()} == {(3, 2, 2), (4, 2, 0)}
    write(folder, "pa_3_choose_2_c.txt", "# score: 0\n2 1 0\n")
    write(folder, "pa_4_choose_2_c.txt", "# score: 9\n0 1 2 3\n")
    watch.watch(spark, folder, kept, points, once=True).awaitTermination()
    now = watch.current(spark, kept)
    assert {(r.n, r.d, r.score) for r in now.collect()} == {(3, 2, 0), (4, 2, 0)}
    assert now.where("n = 3").select(F.explode("rows")).first()[0] == "2 1 0"


def test_a_square_of_bits_in_many_files(spark, tmp_path):
    """Written by several tasks, and read back in parts of 64 bytes with the numbers of lines that they have in the whole."""
    near = {k: sorted({(k * 7) % 50, (k * k) % 50, 49 - k}) for k in range(0, 50, 2)}
    rows = spark.createDataFrame([(k, near.get(k), 49) for k in range(50)], "id long, near array<long>, last long")
    text.dump_bits(rows.repartition(3), f"{tmp_path}/many")
    assert sum(p.name.endswith(".txt.gz") for p in (tmp_path / "many").iterdir()) > 1
    want = [(a, b) for a, bs in near.items() for b in bs]
    assert sorted(map(tuple, text.load_bits(spark, f"{tmp_path}/many").collect())) == sorted(want)
    (tmp_path / "plain.txt").write_text("\r\n".join("".join("01"[b in near.get(k, [])] for b in range(50)) for k in range(50)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        assert sorted(map(tuple, text.load_bits(spark, f"{tmp_path}/plain.txt").collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_bits_that_are_read_are_not_written_anew(spark, tmp_path, monkeypatch):
    shared = []
    monkeypatch.setattr(text, "staged", lambda df, label: shared.append(label) or df, raising=False)
    for k, lines in enumerate(("0101\n1000\n", "0001\n1010\n")):
        with open(f"{tmp_path}/part-{k}.txt", "w") as f:
            f.write(lines)
    got = sorted(map(tuple, text.load_bits(spark, str(tmp_path)).collect()))
    assert got == [(0, 1), (0, 3), (1, 0), (2, 3), (3, 0), (3, 2)] and not shared
