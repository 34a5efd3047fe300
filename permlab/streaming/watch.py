"""A folder of array files, watched by Structured Streaming: the best array seen is kept for every (n, d)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def scored(files: DataFrame) -> DataFrame:
    """file, n, d, score, rows: arrays of whole files (file, value), scored by what they say in their first line."""
    numbers = F.regexp_extract_all(F.element_at(F.split("file", "/"), -1), F.lit(r"(\d+)"), 1)
    said = F.regexp_extract("value", r"^# score: (-?\d+)", 1)
    body = F.filter(F.split("value", "\r?\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    return files.select("file", F.get(numbers, F.lit(0)).cast("int").alias("n"), F.get(numbers, F.lit(1)).cast("int").alias("d"), F.when(said != "", said.cast("long")).alias("score"), body.alias("rows")).where("score IS NOT NULL AND n IS NOT NULL AND d IS NOT NULL")


def best(found: DataFrame) -> DataFrame:
    """n, d, score, file, rows: the lowest score, ties to the first file."""
    return found.groupBy("n", "d").agg(F.min(F.struct("score", "file", "rows")).alias("b")).select("n", "d", "b.score", "b.file", "b.rows")


def watch(spark: SparkSession, folder: str, kept: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keeps best() of all files so far as versions of a table below `kept`; current() reads the newest."""
    files = spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def adopt(batch: DataFrame, number: int) -> None:
        new = scored(batch)
        old = current(batch.sparkSession, kept, number)
        (new if old is None else old.unionByName(new.select(*old.columns))).transform(best).write.mode("overwrite").parquet(f"{kept}/version={number}")

    out = files.writeStream.foreachBatch(adopt).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def current(spark: SparkSession, kept: str, before: int | None = None) -> DataFrame | None:
    """The newest version, or the newest before a number: a batch that is run again starts from the same one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(kept)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    versions = [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(path) if s.getPath().getName().startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    versions = [v for v in versions if before is None or v < before]
    return spark.read.parquet(f"{kept}/version={max(versions)}").select("n", "d", "score", "file", "rows") if versions else None
