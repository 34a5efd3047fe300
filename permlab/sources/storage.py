"""Shared storage for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a temporary one, which only a local master can use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(shared_dir, "local", None)
        if base is None:
            base = shared_dir.local = tempfile.mkdtemp(prefix="permlab-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: For tables of long binary values, which don't compress: pages of one value if need be, and no buffers for compression.
RAW = {"compression": "uncompressed", "parquet.enable.dictionary": "false", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "100"}


def staged(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written as Parquet to shared storage and read again: lineage ends there, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession, label)
    df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
