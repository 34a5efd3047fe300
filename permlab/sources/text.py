"""Permutation arrays in text files, as sources and sinks of (row_id, u).

Numbers of lines come from Spark's reader: files are read whole where order inside a file matters, one row a file.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permlab.functions import columns as C

_INTS = "array<int>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, value: every line with its number in its file. Array files are small; a file is one row until it is exploded."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def _rows(found: DataFrame, u: Column) -> DataFrame:
    """Dense row numbers in each file."""
    kept = found.select("file", "line", u.alias("u")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "u"))).alias("rows"))
    return kept.select("file", F.posexplode("rows").alias("row_id", "r")).select("file", F.col("row_id").cast("long").alias("row_id"), F.col("r.u").alias("u"))


def load(spark: SparkSession, path: str, mode: str = "strict") -> DataFrame:
    """file, row_id, u. Modes:

    strict: blank lines and lines that start with # are skipped; a token that is no number is an error.
    lenient: # ends a line, % ends the file; anything but digits, - and blanks is a blank; symbols wrap as signed bytes.
    digits: as strict, but anything that is neither digit nor blank is deleted first, signs too.
    nonempty: as digits, without the rows that become empty.
    """
    rows = lines(spark, path)
    if mode == "lenient":
        stop = rows.where(F.ltrim("value").startswith("%")).groupBy("file").agg(F.min("line").alias("stop"))
        rows = rows.join(stop, "file", "left").where(F.col("stop").isNull() | (F.col("line") < F.col("stop")))
        tokens = _tokens(F.regexp_replace(F.regexp_replace("value", "#.*", ""), r"[^0-9\- ]", " "))
        wrapped = F.transform(tokens.cast(_INTS), lambda x: (F.pmod(x + 128, F.lit(256)) - 128).cast("int"))
        return _rows(rows.where(F.size(tokens) > 0), wrapped)
    rows = rows.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    tokens = _tokens(F.col("value") if mode == "strict" else F.regexp_replace("value", r"[^\d\s]", ""))
    if mode == "nonempty":
        rows = rows.where(F.size(tokens) > 0)
    return _rows(rows, tokens.cast(_INTS))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def load_blocks(spark: SparkSession, path: str) -> DataFrame:
    """file, block_id, row_id, u: rows of two numbers or more; any other line ends a block."""
    tokens = _tokens(F.regexp_replace("value", "[^0-9]", " "))
    rows = lines(spark, path).withColumn("u", tokens.cast(_INTS))
    order = W.partitionBy("file").orderBy("line")
    rows = rows.withColumn("ends", F.sum((F.size("u") < 2).cast("int")).over(order)).where(F.size("u") > 1)
    rows = rows.withColumn("block_id", F.dense_rank().over(W.partitionBy("file").orderBy("ends")) - 1)
    return rows.select("file", "block_id", (F.row_number().over(W.partitionBy("file", "ends").orderBy("line")) - 1).cast("long").alias("row_id"), "u")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """file, score of the first line, null without one. What it says need not be true."""
    first = lines(spark, path).where("line = 0")
    found = F.regexp_extract("value", r"^# score: (-?\d+)", 1)
    return first.select("file", F.when(found != "", found.cast("long")).alias("score"))


def names(files: DataFrame) -> DataFrame:
    """file, n, d from the first two numbers of a file's name, where 1 <= d < n."""
    numbers = F.regexp_extract_all(F.element_at(F.split("file", "/"), -1), F.lit(r"(\d+)"), 1)
    rows = files.select("file", F.get(numbers, F.lit(0)).cast("int").alias("n"), F.get(numbers, F.lit(1)).cast("int").alias("d"))
    return rows.where("d >= 1 AND d < n")


def misnamed(spark: SparkSession, path: str) -> DataFrame:
    """file, n, found: files whose first row isn't as long as their name says."""
    first = load(spark, path, "lenient").groupBy("file").agg(F.min_by(F.size("u"), "row_id").alias("found"))
    return names(first.select("file")).join(first, "file").where(F.col("n") != F.col("found")).select("file", "n", "found")


def load_bits(spark: SparkSession, path: str) -> DataFrame:
    """a, b: set bits of a square of 0 and 1. The files of a folder are one square, by their names; a file may be read by several tasks, line by line."""
    found = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        seen: dict[tuple[str, int], int] = {}
        for batch in batches:
            for file, block, value in zip(*(batch.column(c) for c in ("file", "block", "value")), strict=True):
                key = (file.as_py(), block.as_py())
                line, seen[key] = seen.get(key, 0), seen.get(key, 0) + 1
                text = value.as_py().removesuffix("\r").strip(" ")
                bits = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == ord("1")) if text.isascii() else [i for i, x in enumerate(text) if x == "1"]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([line], pa.int64()), pa.array([bits], pa.list_(pa.int64()))], names=["file", "block", "line", "bits"])

    held = found.mapInArrow(run, "file string, block long, line long, bits array<long>")
    # lines are counted by a reading of their own, so that no bit is written anew
    before = W.partitionBy(F.lit(0)).orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    sizes = found.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return held.join(F.broadcast(sizes), ["file", "block"]).select((F.col("base") + F.col("line")).alias("a"), F.explode("bits").alias("b"))  # a row for each part of a file


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """a, b: adjacency lists of a JSON array of arrays."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<array<long>>")).alias("a", "near")).select(F.col("a").cast("long").alias("a"), F.explode("near").alias("b"))


def load_bounds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("k int, n int, d int, bound double").csv(path)


def literals(spark: SparkSession, rows: list[list]) -> DataFrame:
    """row_id, u of rows written in a program; strings for symbolic ones."""
    kind = "string" if any(isinstance(x, str) for r in rows for x in r) else "int"
    data = [(k, [str(x) for x in r] if kind == "string" else list(r)) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, f"row_id long, u array<{kind}>")


def resolve(names_: list[str], n: int, d: int) -> str | None:
    """The file to go on from: for (n, d) verified, unfinished, plain; then for (n - d, d) unfinished, plain, verified. The first by this order."""
    base = [f"pa_{n}_choose_{d}{s}.txt" for s in ("_verified", "_unfinished", "")] + [f"pa_{n - d}_choose_{d}{s}.txt" for s in ("_unfinished", "", "_verified")]
    have = {x.rsplit("/", 1)[-1]: x for x in names_}
    return next((have[x] for x in base if x in have), None)


# -- sinks


def as_lines(array: DataFrame) -> DataFrame:
    return array.select("row_id", F.array_join(F.col("u").cast("array<string>"), " ").alias("value"))


def dump(array: DataFrame, path: str, header: str | None = None) -> None:
    """One text file in the order of row_id, with a first line if there is one. Arrays are small; the order needs one task."""
    rows = as_lines(array)
    if header is not None:
        rows = rows.unionByName(array.sparkSession.createDataFrame([(-1, header)], "row_id long, value string"))
    rows.coalesce(1).sortWithinPartitions("row_id").select("value").write.mode("overwrite").text(path)


def dump_scored(array: DataFrame, path: str, score: int) -> None:
    dump(array, path, f"# score: {score}")


def dump_annotated(array: DataFrame, path: str, degrees: DataFrame) -> None:
    """With a first line of the conflicts (half the sum of the degrees) and each conflicting row's degree, highest first, and an empty line."""
    rows = degrees.where("degree > 0").orderBy(F.col("degree").desc(), "row_id").collect()  # of one array that people read
    told = ", ".join(f"{r['row_id']}: {r['degree']}" for r in rows)
    dump(array, path, f"# Disagreements: {sum(r['degree'] for r in rows) // 2} Counter({{{told}}})\n")


def dump_trimmed(array: DataFrame, path: str, d: int, kept: DataFrame) -> str:
    """What is kept of an array, beside the file that it came from. Returns the new path."""
    dump(array.join(kept.select("row_id"), "row_id", "left_semi"), trimmed_name(path, d))
    return trimmed_name(path, d)


def dump_by_size(rows: DataFrame, path: str) -> None:
    """rows: size, row_id, u, arrays of several sizes. A folder for each size, lines with CR and LF."""
    lines_ = rows.select("size", "row_id", F.array_join(F.col("u").cast("array<string>"), " ").alias("value"))
    lines_.repartition("size").sortWithinPartitions("size", "row_id").select("size", "value").write.mode("overwrite").partitionBy("size").option("lineSep", "\r\n").text(path)


def publish(array: DataFrame, path: str, header: str | None = None) -> None:
    """Writes beside the path, then renames: a reader finds the old file or the new one, or none for a moment, and never half of one."""
    spark = array.sparkSession
    fresh = f"{path.rstrip('/')}.temp-{uuid.uuid4().hex}"
    dump(array, fresh, header)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = fs.exists(jvm(path)) and fs.rename(jvm(path), old)
    if not fs.rename(jvm(fresh), jvm(path)):
        raise OSError(f"{fresh} couldn't be renamed to {path}")
    if had:
        fs.delete(old, True)


def maybe_dump(array: DataFrame, path: str, score: int) -> bool:
    """Writes unless the file says that it has a better score, above 0."""
    spark = array.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = None
    if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        old = headers(spark, path).agg(F.max("score").alias("s")).first()["s"]
    if old is not None and 0 < old < score:
        return False
    dump_scored(array, path, score)
    return True


def dump_edges(edges: DataFrame, path: str) -> None:
    edges.select("a", "b").write.mode("overwrite").parquet(path)


def dump_bits(rows: DataFrame, path: str) -> None:
    """rows: id, near (ids or null), last. A line of 0 and 1 (0 to last) for each row, by id, in gzipped files whose names are in this order."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for near, last in zip(batch.column("near"), batch.column("last"), strict=True):
                line = np.full(last.as_py() + 1, ord("0"), np.uint8)
                if near.is_valid:
                    line[near.values.to_numpy(zero_copy_only=False)] = ord("1")
                yield pa.RecordBatch.from_arrays([pa.array([line.tobytes()], pa.binary()).cast(pa.string())], names=["value"])

    tasks = rows.sparkSession.sparkContext.defaultParallelism * 4
    rows.repartitionByRange(tasks, "id").sortWithinPartitions("id").select("near", "last").mapInArrow(run, "value string").write.mode("overwrite").text(path, compression="gzip")


def dump_state(edges: DataFrame, path: str) -> None:
    edges.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("near")).orderBy("a").write.mode("overwrite").json(path)


def dump_bounds(bounds: DataFrame, path: str) -> None:
    bounds.select("k", "n", "d", "bound").write.mode("overwrite").csv(path)


def report(array: DataFrame, pairs: DataFrame) -> DataFrame:
    """row_id, row, near: each row as text with the rows that it conflicts with."""
    two = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = two.groupBy(F.col("a").alias("row_id")).agg(C.text(F.array_sort(F.collect_list("b"))).alias("near"))
    return array.join(near, "row_id", "left").select("row_id", C.text("u").alias("row"), F.coalesce("near", F.lit("")).alias("near"))


def trimmed_name(path: str, d: int) -> str:
    return re.sub(r"([^/]*)$", lambda m: f"trimmed_{d}_from_{m[1]}", path, count=1)
