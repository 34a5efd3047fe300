"""Conflicts that are found only for the rows that are asked for, kept in a table from batch to batch.

A state is a folder of versions; each holds `known` (row_id) and `edges` (a, b). What holds of every version: edges are exactly the conflicts that have
a known row at one end. ask() finds the conflicts of new rows alone, against all rows; replace() drops what the old rows had and finds
what the new ones have, against the known rows, and against all rows only for those that are known themselves. A version is written
whole before the next one starts, so a search can stop after any batch and go on from the folder. The log has a row for each version with
the number of rows that were joined.

Cases: rows asked for again cost nothing; unknown row_ids are ignored; a row that is replaced by an equal one keeps its conflicts; repeated rows
of one row_id are not allowed; an empty array has no conflicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permlab.functions import columns as C
from permlab.operators.relations import ball_of, meeting
from permlab.sources.storage import shared_dir, staged

_EDGES, _KNOWN, _LOG = "a long, b long", "row_id long", "version long, batch string, rows long, joined long"


def between(some: DataFrame, array: DataFrame, d: int) -> DataFrame:
    """a (of some), b (of array): conflicts of different rows; by the balls of permutations, else only templates are joined by a test, rows by templates."""
    renamings, many = ball_of(some.select("u").unionByName(array.select("u")), d)
    if renamings is not None:
        found = meeting(some.select("u", F.col("row_id").cast("long").alias("a")), array, renamings, many, ("a",))
        return found.where(F.col("a") != F.col("b")).select("a", "b")
    one = some.select(F.col("row_id").alias("a"), F.col("u").alias("x"), C.groups("u", d).alias("t"))
    other = array.select(F.col("row_id").alias("b"), F.col("u").alias("y"), C.groups("u", d).alias("s"))
    near = one.select("t").distinct().join(other.select("s").distinct(), C.foes("t", "s"))
    near = near.select(F.col("t").alias("t1"), F.col("s").alias("s1"))
    found = one.join(near, F.col("t") == F.col("t1")).join(other, F.col("s1") == F.col("s"))
    return found.where((F.col("a") != F.col("b")) & ~C.separated("x", "y", d)).select("a", "b")


class Conflicts:
    """The state in a folder. `version` is the last one that is whole."""

    def __init__(self, spark: SparkSession, folder: str, d: int, version: int = 0):
        self.spark, self.folder, self.d, self.version = spark, folder.rstrip("/"), d, version

    @classmethod
    def new(cls, spark: SparkSession, d: int) -> Conflicts:
        return cls(spark, shared_dir(spark, "conflicts"), d)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, d: int) -> Conflicts:
        """The last version of a folder; the log is written last."""
        log = spark.read.schema(_LOG).parquet(f"{folder.rstrip('/')}/log")
        return cls(spark, folder, d, log.agg(F.max("version")).first()[0])

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{self.version}/{name}") if self.version else self.spark.createDataFrame([], schema)

    def edges(self) -> DataFrame:
        return self._table("edges", _EDGES)

    def known(self) -> DataFrame:
        return self._table("known", _KNOWN)

    def log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(f"{self.folder}/log")

    def _next(self, edges: DataFrame, known: DataFrame, batch: str, rows: int, joined: int) -> None:
        at = f"{self.folder}/{self.version + 1}"
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().write.parquet(f"{at}/edges")
        known.write.parquet(f"{at}/known")
        self.spark.createDataFrame([(self.version + 1, batch, rows, joined)], _LOG).write.mode("append").parquet(f"{self.folder}/log")
        self.version += 1

    def ask(self, array: DataFrame, rows: DataFrame) -> DataFrame:
        """rows: row_id. Makes them known, and returns their conflicts row_id, other."""
        asked = rows.select("row_id").distinct().join(array.select("row_id"), "row_id", "left_semi")
        new = staged(asked.join(self.known(), "row_id", "left_anti"), "new")
        joined = new.count()
        if joined:
            found = between(array.join(new, "row_id", "left_semi"), array, self.d)
            self._next(self.edges().unionByName(found), self.known().unionByName(new), "ask", asked.count(), joined)
        both = self.edges().unionByName(self.edges().select(F.col("b").alias("a"), F.col("a").alias("b")))
        return both.join(asked.select(F.col("row_id").alias("of")), F.col("a") == F.col("of")).select(F.col("a").alias("row_id"), F.col("b").alias("other"))

    def replace(self, array: DataFrame, changes: DataFrame) -> DataFrame:
        """changes: row_id, u (one a row). Returns the array with these rows, and brings the state in line with it."""
        changed = staged(changes.join(array.select("row_id"), "row_id", "left_semi"), "changes")
        ids = changed.select(F.col("row_id").alias("of"))
        now = staged(array.join(changed.withColumnRenamed("u", "new"), "row_id", "left").select("row_id", F.coalesce("new", "u").alias("u")), "array")
        kept = self.edges().join(ids, F.col("a") == F.col("of"), "left_anti").join(ids, F.col("b") == F.col("of"), "left_anti")
        met = now.join(self.known(), "row_id", "left_semi")
        own = changed.join(self.known(), "row_id", "left_semi")
        found = between(changed, met, self.d).unionByName(between(own, now, self.d))
        self._next(kept.unionByName(found), self.known(), "replace", changed.count(), met.count() + own.count())
        return now
