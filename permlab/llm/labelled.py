"""Labelled documents to fit a classifier on: a bounded sample of rows that aren't held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permlab.llm.common import pick

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id's text leaves no remainder by FOLDS; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> list[tuple[str, int]]:
    """Up to `most` texts of each label 0 and 1, of rows that aren't held out, chosen by a hash of doc_id. Null labels don't count."""
    own = pick(labels, doc_id="long", **{label: "int"}).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]).withColumnRenamed("doc_id", "of"))  # 2 * most rows of two numbers
    rows = pick(docs, doc_id="long", text="string").join(few, F.col("doc_id") == F.col("of"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("r"))
    return [(r["text"] or "", r["y"]) for (r,) in rows.orderBy(F.xxhash64("doc_id")).select("r").collect()]
