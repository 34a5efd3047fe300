"""Permutations derived from the driver's tables: the rank order of the first n components of every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rank_array(spark: SparkSession, sf_dir: str, n: int = 8) -> DataFrame:
    """row_id, u; equal components rank by their place."""
    x = F.slice("embedding", 1, n)
    rank = F.transform(x, lambda a, i: F.size(F.filter(F.transform(x, lambda b, j: (b < a) | ((b == a) & (j < i))), lambda z: z)))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), rank.alias("u"))


RANK_SQL = """pa AS (SELECT vec_id AS row_id, list_transform(range(1, {n} + 1), lambda i: len(list_filter(range(1, {n} + 1),
  lambda j: embedding[j] < embedding[i] OR (embedding[j] = embedding[i] AND j < i)))::INT) AS u FROM embeddings)"""
