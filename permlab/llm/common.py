"""What the operators of this subpackage share: tables, shared storage, names, batches of text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permlab.sources.storage import RAW, shared_dir, staged

__all__ = ["RAW", "WORD", "estimated_bytes", "fresh", "modest_batches", "pick", "pieces", "row_key", "rows_of", "shared_dir", "spans_of", "staged", "table", "text_bytes", "with_fields"]

#: The words of a text in every contract here: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def modest_batches(spark: SparkSession) -> None:
    """Batches of 1000 rows for Python workers where the session has Spark's default of 10000: rows here are whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's size, exact for files; 0 where it has none."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast to the given types; a column that is absent is null."""
    modest_batches(df.sparkSession)
    have = set(df.columns)
    return df.select(*[(df[c] if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base = f"_{base}"
    return base


def row_key(df: DataFrame) -> Column:
    """A digest of doc_id and text, nulls apart from all values: rows with the same key are copies of one document."""
    return F.md5(F.concat_ws(":", F.coalesce(df["doc_id"].cast("string"), F.lit("")), F.coalesce(F.md5(df["text"].cast("string")), F.lit(""))))


def rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of docs for each row_key of chosen (row_key, again: whether docs has several such rows), with its own columns only."""
    key = fresh(docs, "row_key")
    own = docs.withColumn(key, row_key(docs))
    single = own.join(chosen.where("NOT again").select(F.col("row_key").alias("chosen_key")), F.col(key) == F.col("chosen_key"), "left_semi")
    several = own.join(chosen.where("again").select(F.col("row_key").alias("chosen_key")), F.col(key) == F.col("chosen_key"), "left_semi")
    return single.unionByName(several.dropDuplicates([key])).select(*docs.columns)


def with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t, True) for n, t in fields)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without copying, and the n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n, (_, ends, data) = len(column), column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of(sizes: np.ndarray, most: int):
    """Consecutive ranges (a, b) of items whose sizes sum to most or less; a larger item is alone."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, "right")))
        yield a, b
        a = b


def pieces(batches, most: int = 1 << 22, column: str = "text"):
    """The record batches in slices of at most so many bytes of text, or one row: what is made of a slice stays small."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b in spans_of(sizes + 64, most):
            yield batch.slice(a, b - a)
