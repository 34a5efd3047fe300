import hashlib
import math
import random
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from permlab.llm import upsert

CLIENTS = "client_id long, master_id long, source string, home string, segment string, city string, balance double, `a.b` int"
CHANGES = "change_id long, client_id long, seq long, op string, note string, source string, segment string, city string, balance double"


def crc(x):
    return zlib.crc32(str(x).encode())


def plain(clients, changes, names):
    """The contract, step by step, over dictionaries with unique client_ids. Returns files as (rewritten, rows)."""
    m = 1 + len(clients) // 1500
    rows = sorted((r for r in clients if r["client_id"] is not None and crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [rows[i : i + m] for i in range(0, len(rows), m)]
    starts = [f[0]["client_id"] for f in files]
    homes = [{r["client_id"]: r for r in f} for f in files]
    best = {}
    for c in changes:
        rank = (c["seq"] is not None, c["seq"] or 0, c["change_id"] is not None, c["change_id"] or 0)
        if c["client_id"] is not None and (c["client_id"] not in best or rank > best[c["client_id"]][0]):
            best[c["client_id"]] = rank, c
    for i, (_, c) in best.items():
        home = max([k for k, s in enumerate(starts) if s <= i], default=0)
        h = crc(starts[home]) % 10
        if h > 7:
            continue
        if c["op"] == "D" or c["change_id"] is not None and crc(c["change_id"]) % 8 < h:
            homes[home].pop(i, None)
        else:
            old = homes[home].get(i, dict.fromkeys(names) | {"client_id": i})
            homes[home][i] = old | {k: c[k] for k in ("source", "segment", "city", "balance")}
    out = []
    for k, f in enumerate(files):
        now = sorted(homes[k].values(), key=lambda r: r["client_id"])
        if now == f:
            out.append((False, now))
            continue
        many = -(-len(now) // m)
        at = 0
        for i in range(many):
            n = len(now) // many + (i < len(now) % many)
            part, at = now[at : at + n], at + n
            if out and out[-1][0] and len(out[-1][1]) + n <= m:
                out[-1] = True, out[-1][1] + part
            else:
                out.append((True, part))
    return out


def described(files, names):
    z = lambda x: 0 if x is None else math.floor(100 * x + 0.5)
    return [
        (
            f[0]["client_id"], len(f), sum(z(r["balance"]) for r in f), sum(crc("|".join(r[k] or "" for k in ("source", "segment", "city"))) for r in f),
            hashlib.sha256(",".join(str(r["client_id"]) for r in f).encode()).hexdigest(), ",".join(names), again,
        )
        for again, f in files
    ]


def compare(spark, clients, changes):
    got = upsert.upserted_clients(clients, changes).orderBy("first_id").collect()
    rows = lambda df: [r.asDict() for r in df.collect()]
    want = plain(rows(clients), rows(changes), clients.columns)
    assert [(r.first_id, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.columns, r.rewritten) for r in got] == described(want, clients.columns)
    if got:
        folder = Path(got[0].path.removeprefix("file:")).parent
        assert {p.name for p in folder.glob("*.parquet")} == {Path(r.path).name for r in got}
        for r, (_, f) in zip(got, want, strict=True):
            held = pq.read_table(r.path.removeprefix("file:"))
            assert held.column_names == clients.columns and held.column("client_id").to_pylist() == [x["client_id"] for x in f]
            assert [{k: x[k] for k in ("source", "city", "balance")} for x in held.to_pylist()] == [{k: x[k] for k in ("source", "city", "balance")} for x in f]
    return got


def test_tables(spark):
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    got = compare(spark, table("clients"), table("client_changes"))
    assert {r.rewritten for r in got} == {True, False}


@pytest.mark.parametrize("seed", [1, 2])
def test_files_of_several_rows_that_split_join_and_vanish(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice([None, "", "a", "bé", "c"])
    money = lambda: rng.choice([None, 0.0, -0.005, 12.345, 1e6])
    clients = [(i * 3, rng.randrange(9), word(), word(), word(), word(), money(), rng.randrange(5)) for i in range(50, 6050)] + [(None, 1, "x", "y", "z", "q", 1.0, 2)]
    ids = [rng.randrange(-20, 20000) for _ in range(9000)] + list(range(6000, 9000))
    changes = [(k, i, rng.choice([None, 0, 1, 2, 3]), rng.choice("UUUUID"), "n", word(), word(), word(), money()) for k, i in enumerate(ids)]
    changes += [(None, 300, 9, "U", "n", "x", None, None, None), (10**6, None, 9, "D", "n", "x", None, None, None), (10**6 + 1, 303, 9, None, "n", "x", None, None, None)]
    changes += changes[:300]
    got = compare(spark, spark.createDataFrame(clients, CLIENTS).repartition(5), spark.createDataFrame(changes, CHANGES).repartition(3))
    assert max(r.n_rows for r in got) == 5


def test_nothing_to_do_and_empty_tables(spark):
    clients = spark.createDataFrame([(i, 1, "s", "h", "g", "c", 1.0, 1) for i in range(40)], CLIENTS)
    none = spark.createDataFrame([], CHANGES)
    assert not any(r.rewritten for r in compare(spark, clients, none))
    assert upsert.upserted_clients(clients.limit(0), none).collect() == []
    one = spark.createDataFrame([(1, 5, 1, "U", "n", "x", "y", None, 2.5), (2, 6, 1, "D", "n", "x", "y", None, 2.5)], CHANGES)
    got = upsert.upserted_clients(clients.limit(0), one).collect()  # one home without a first key
    assert [(r.first_id, r.n_rows, r.cents, r.rewritten) for r in got] == [(5, 1, 250, True)]


def test_repeated_keys_and_all_rows_deleted(spark):
    folder = upsert.shared_dir(spark, "test")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (2, "d"), (3, "e"), (3, "e")], "id int, v string")
    upsert.write_sorted(rows, "id", 2, folder)
    change = lambda *kv: spark.createDataFrame(kv, "id int, v string").select(F.col("id").alias("key"), F.struct("v").alias("change"))
    upsert.upsert(spark, folder, rows.schema, "id", change((2, "z")), lambda first, c: F.lit("set"), ["v"], 2)
    assert sorted(map(tuple, spark.read.parquet(folder).collect())) == [(1, "a"), (2, "z"), (2, "z"), (2, "z"), (3, "e"), (3, "e")]
    upsert.upsert(spark, folder, rows.schema, "id", change((1, ""), (2, ""), (3, "")), lambda first, c: F.lit("delete"), ["v"], 2)
    assert list(Path(folder).glob("*.parquet")) == []
    upsert.upsert(spark, folder, rows.schema, "id", change((7, "g"), (4, "f"), (9, "h")), lambda first, c: F.lit("set"), ["v"], 2)
    assert sorted(map(tuple, spark.read.parquet(folder).collect())) == [(4, "f"), (7, "g"), (9, "h")]
    assert sorted(pq.read_table(p).num_rows for p in Path(folder).glob("*.parquet")) == [1, 2]
