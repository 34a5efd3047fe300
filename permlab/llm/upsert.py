"""Keyed upserts into a folder of sorted Parquet files, copy on write.

A file is the home of the keys from its first key on, up to the next file's. The upsert is set algebra on rows with their homes: an anti-join
takes away the rows that are deleted, an inner join makes the updated ones, another anti-join finds the keys to insert. EXCEPT ALL of the rows
before and after, both ways, gives the homes whose rows differ; only rows with a change go there, as all others are the same by
construction. Those homes alone are rewritten: their rows before and the new ones are united, sorted and cut into files.

Nothing that grows with the table goes through one task, a broadcast or the driver: homes of new keys are found by one range sort of keys and
file starts, rows get their file by numbers from a range sort, and files that may join are planned for each run of neighbouring dirty
homes. The driver only sees the names of replaced files, one after another, to delete them. New files are written before old ones go; a
reader that lists the folder in between would see both.

Cases: a null key takes no part, neither as a row nor as a change. Repeated keys: all rows of a key are updated or deleted, each in its own
file, with the decision of the key's home. A table without rows has one home without a first key. A change's null values are
set like others. Columns may have any names; rows with equal keys are in the order of their digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permlab.llm.common import shared_dir, staged
from permlab.operators.numbering import numbered


def _packed(table: DataFrame, key: str) -> DataFrame:
    """key and row, all columns as one value; rows without a key are left out."""
    return table.where(table[key].isNotNull()).select(table[key].alias("key"), F.struct(*[table[f"`{c}`"] for c in table.columns]).alias("row"))


def _write(rows: DataFrame, files: int, folder: str) -> None:
    """rows: key, row, file (0 to files - 1), nth. A file for each number, written by one task, streaming."""
    rows.repartitionById(files, F.col("file").cast("int")).sortWithinPartitions("file", "nth").select("row.*").write.mode("append").parquet(folder)


def write_sorted(table: DataFrame, key: str, per_file: int, folder: str) -> None:
    """Writes the rows in the order of the key into files of so many rows each; the last has the rest."""
    rows = numbered(_packed(table, key), [F.col("key").asc(), F.xxhash64("row").asc()], "nth")
    n = rows.agg(F.max("nth")).first()[0]
    if n is not None:
        _write(rows.withColumn("file", F.floor(F.col("nth") / per_file)), n // per_file + 1, folder)


def _read(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The files of a folder, which may not be there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema).withColumn("_metadata", F.expr("named_struct('file_path', '', 'row_index', 0L)"))


def homes(spark: SparkSession, folder: str, key: str, schema: T.StructType) -> DataFrame:
    """path, first, home: the files in the order of their first and last keys, numbered from 0."""
    rows = _read(spark, folder, schema)
    files = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    found = numbered(files, [F.col(c).asc() for c in ("first", "last", "path")], "home").select("path", "first", "home")
    if found.isEmpty():
        found = spark.range(1).select(F.lit(None).cast("string").alias("path"), F.lit(None).cast(schema[key].dataType).alias("first"), F.lit(0).cast("long").alias("home"))
    return found


def at_home(changes: DataFrame, starts: DataFrame) -> DataFrame:
    """changes: key and others; starts: first, home. Adds home, first: of the last start at or below the key, else of the first start.

    Starts and keys are sorted together in ranges; a row for each range tells the next ones where it ended.
    """
    own = F.struct(*changes.columns).alias("change")
    both = changes.select("key", F.lit(1).alias("kind"), own, F.lit(None).cast("struct<home: long, first: string>").alias("start"))
    begin = F.struct("home", F.col("first").cast("string").alias("first"))
    both = both.unionByName(starts.select(F.col("first").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast(changes.select(own).schema[0].dataType).alias("change"), begin.alias("start")))
    order = ["key", "kind", "start"]
    parts = max(1, int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged(both.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "starts-and-keys")
    upto = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ends = dealt.groupBy("part").agg(F.max("start").alias("end"), F.min("start").alias("least"))  # a row for each range
    ends = ends.select(F.col("part").alias("of"), F.last("end", True).over(before).alias("earlier"), F.min("least").over(W.partitionBy(F.lit(0))).alias("lowest"))
    found = dealt.withColumn("within", F.last("start", True).over(upto)).where("kind = 1").join(F.broadcast(ends), F.col("part") == F.col("of"))
    at = F.coalesce("within", "earlier", "lowest")
    return found.select("change.*", at["home"].alias("home"), at["first"].cast(starts.schema["first"].dataType).alias("first"))


def latest(changes: DataFrame, key: str, *order: str) -> DataFrame:
    """For every key the change that is highest by `order` (null lowest), then by its other columns. Partly combined before rows are shuffled."""
    rank = F.struct(*order, F.xxhash64(*changes.columns).alias("_"), F.struct(*changes.columns).alias("change"))
    return changes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(rank).alias("r")).select("key", "r.change")


def planned(sizes: DataFrame, per_file: int) -> DataFrame:
    """sizes: home, run, n. run, at (rows of the run before the file), n of the files to write.

    A home's rows go into the fewest files of per_file rows at most, sizes at most one apart and larger ones first; then each file joins
    its left neighbour in the run while both have per_file rows or fewer. Only sizes are gathered, of the dirty homes between two clean ones.
    """

    def plan(frame):
        import pandas as pd

        files = []
        for n in frame.sort_values("home")["n"].tolist():
            many = -(-n // per_file)
            for i in range(many):
                size = n // many + (i < n % many)
                if files and files[-1] + size <= per_file:
                    files[-1] += size
                else:
                    files.append(size)
        n = np.array(files, np.int64)
        return pd.DataFrame({"run": np.full(len(n), frame["run"].iloc[0], np.int64), "at": np.cumsum(n) - n, "n": n})

    return sizes.groupBy("run").applyInPandas(plan, "run long, at long, n long")


def upsert(spark: SparkSession, folder: str, schema: T.StructType, key: str, changes: DataFrame, action: Callable[[Column, Column], Column], columns: list[str], per_file: int) -> DataFrame:
    """Applies changes (key, change: one a key) to the files of the folder. Returns the paths of the files that are replaced.

    action(first, change), with the first key of the change's home, is 'delete' or 'set'; anything else ignores the change. Set: the named columns
    get the change's values, and a key that isn't there is inserted with nulls in the others.
    """
    starts = staged(homes(spark, folder, key, schema), "homes")
    table = _read(spark, folder, schema)
    base = table.select(table[key].alias("key"), F.struct(*[table[f"`{c}`"] for c in schema.names]).alias("row"), F.col("_metadata.file_path").alias("path"))
    base = base.join(starts.select(F.col("path").alias("of"), "home"), F.col("path") == F.col("of")).select("key", "home", "row")
    decided = at_home(changes, starts).withColumn("action", action(F.col("first"), F.col("change"))).where("action IN ('delete', 'set')")
    decided = staged(decided.select("key", "home", "action", "change"), "decided")
    gone = decided.where("action = 'delete'").select(F.col("key").alias("k"))
    sets = decided.where("action = 'set'").select(F.col("key").alias("k"), F.col("home").alias("h"), "change")

    same = F.col("key") == F.col("k")
    before = staged(base.join(decided.select(F.col("key").alias("k")), same, "left_semi"), "before")
    kept = before.join(gone, same, "left_anti")
    value = lambda c: F.col("change")[c].cast(schema[c].dataType)
    new = F.struct(*[(value(c) if c in columns else F.col("row")[c]).alias(c) for c in schema.names])
    updated = kept.join(sets, same).select("key", "home", new.alias("row"))
    fresh = F.struct(*[(F.col("k") if c == key else value(c) if c in columns else F.lit(None).cast(schema[c].dataType)).alias(c) for c in schema.names])
    inserted = sets.join(before.select("key"), same, "left_anti").select(F.col("k").alias("key"), F.col("h").alias("home"), fresh.alias("row"))
    after = staged(updated.unionByName(inserted), "after")

    one, other = before.select("home", "row"), after.select("home", "row")
    dirty = one.exceptAll(other).select("home").unionByName(other.exceptAll(one).select("home")).distinct()
    dirty = numbered(dirty, [F.col("home").asc()], "nth").select(F.col("home").alias("dirty"), (F.col("home") - F.col("nth")).alias("run"))
    dirty = staged(dirty, "dirty")  # homes in a row have the same difference to their number among the dirty ones

    untouched = base.join(decided.select(F.col("key").alias("k")), same, "left_anti")
    rows = untouched.unionByName(after).join(dirty, F.col("home") == F.col("dirty")).select("key", "home", "run", "row")
    rows = numbered(rows, [F.col("home").asc(), F.col("key").asc(), F.xxhash64("row").asc()], "nth")
    homes_left = rows.groupBy("home", "run").agg(F.count("*").alias("n"), F.min("nth").alias("base"))
    homes_left = staged(homes_left, "sizes")
    files = planned(homes_left.select("home", "run", "n"), per_file)
    bases = homes_left.groupBy(F.col("run").alias("r")).agg(F.min("base").alias("base"))
    files = files.join(bases, F.col("run") == F.col("r")).select((F.col("base") + F.col("at")).alias("begin"), (F.col("base") + F.col("at") + F.col("n")).alias("end"))
    files = numbered(files, [F.col("begin").asc()], "file")
    many = files.count()
    if many:
        # a file holds numbers of two ranges of per_file at most
        spread = files.withColumn("range", F.explode(F.sequence(F.floor(F.col("begin") / per_file), F.floor((F.col("end") - 1) / per_file))))
        placed = rows.withColumn("of", F.floor(F.col("nth") / per_file)).join(spread, (F.col("of") == F.col("range")) & (F.col("nth") >= F.col("begin")) & (F.col("nth") < F.col("end")))
        _write(placed, many, folder)
    old = starts.join(dirty, F.col("home") == F.col("dirty"), "left_semi").where("path IS NOT NULL").select("path")
    _delete(old)
    return starts.where("path IS NOT NULL").select("path")


def _delete(paths: DataFrame) -> None:
    """Deletes files, whose names come to the driver one partition after another."""
    spark = paths.sparkSession
    for row in paths.toLocalIterator():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI.create(row["path"]))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def file_digests(spark: SparkSession, folder: str, schema: T.StructType, key: str, cents: Column, code: Column) -> DataFrame:
    """path, first_id, n_rows, cents, rows_crc, ids_sha256 of every file of the folder; rows stream through a task file by file, in their order."""
    table = _read(spark, folder, schema)
    rows = table.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("nth"), table[key].cast("long").alias("key"), cents.cast("long").alias("cents"), code.cast("long").alias("code"))
    rows = rows.repartition(F.col("path")).sortWithinPartitions("path", "nth")

    def sums(batches):
        path, state = None, None

        def ended():
            first, n, c, r, digest = state
            return pa.RecordBatch.from_pylist([{"path": path, "first_id": first, "n_rows": n, "cents": c, "rows_crc": r, "ids_sha256": digest.hexdigest()}], schema=pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("ids_sha256", pa.string())]))

        for batch in batches:
            names = batch.column("path").to_pylist()
            cut = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)] if names else []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                part = batch.slice(a, b - a)
                ids = part.column("key").to_pylist()
                if names[a] != path:
                    if path is not None:
                        yield ended()
                    path, state = names[a], [ids[0], 0, 0, 0, hashlib.sha256()]
                state[4].update((("," if state[1] else "") + ",".join(map(str, ids))).encode())
                state[1] += len(ids)
                state[2] += sum(part.column("cents").to_pylist())
                state[3] += sum(part.column("code").to_pylist())
        if path is not None:
            yield ended()

    return rows.mapInArrow(sums, "path string, first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string")


# -- the shop's clients


def _crc(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))


def shop_action(first: Column, change: Column) -> Column:
    """By the check sum of the home's first id: ignored above 7; a delete by op or by the change's own check sum; else set."""
    h = _crc(first) % 10
    deletes = F.coalesce((change["op"] == "D") | (_crc(change["change_id"]) % 8 < h), change["op"] == "D", F.lit(False))
    return F.when(h > 7, "ignore").when(deletes, "delete").otherwise("set")


def upserted_clients(clients: DataFrame, changes: DataFrame) -> DataFrame:
    """Writes a part of clients as sorted files, applies the latest changes and describes the files that the folder then holds."""
    spark = clients.sparkSession
    folder, key = shared_dir(spark, "clients"), "client_id"
    per_file = 1 + clients.count() // 1500  # so at most 1500 starting files, however large the table
    write_sorted(clients.where(_crc(F.col(key)) % 7 > 3), key, per_file, folder)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in clients.schema.fields])
    wanted = ["change_id", "client_id", "seq", "op", "source", "segment", "city", "balance"]
    newest = latest(changes.select(*wanted), key, "seq", "change_id")
    before = upsert(spark, folder, schema, key, newest, shop_action, ["source", "segment", "city", "balance"], per_file)
    whole = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0).otherwise(F.coalesce(F.floor(100 * x + 0.5), F.lit(0)))
    code = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("source", "segment", "city")])
    files = file_digests(spark, folder, schema, key, whole(F.col("balance").cast("double")), _crc(code))
    files = files.join(before.select(F.col("path").alias("was")), F.col("path") == F.col("was"), "left")
    return files.select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit(",".join(schema.names)).alias("columns"), "path", F.col("was").isNull().alias("rewritten"))
