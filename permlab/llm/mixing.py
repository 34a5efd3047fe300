"""Mixing sources to target weights along a training curriculum. DataFrame functions only.

Every source has a weight schedule over training time t in [0, 1], linear between its value at 0 and at 1.
Its integral is the source's weight in the whole mix; the integral up to t, scaled to the source's target,
is the tokens the curriculum has demanded of it by t. Documents of a source queue in a pseudo-random fixed
order; a copy whose middle token is number x in that queue is read when the demand reaches x, that is at the
inverse of the demand in x. Sorting all copies by that position gives the training order.

Scale: the queue's prefix sums are taken in two levels, per (source, bucket) and per source over its bucket sums, so that a
source with a third of all rows is dealt over all its buckets. Buckets are ranges of the order key, a digest of doc_id and text,
about as many as the root of the number of rows: both levels stay short, and the order of a queue depends on its
documents alone, not on the number of buckets. Only per-source totals, a row for each source, are ever brought together.

Cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its own, last in order;
a null doc_id has the place of its text; repeated rows are separate documents, one after another; an empty table gives an empty result; other columns are kept or ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permlab.llm.common import WORD, fresh, pick, staged


def order_key(df: DataFrame, seed: int) -> Column:
    """The place of a document in its source's queue: a digest of the seed, doc_id and text."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), df["doc_id"].cast("long").cast("string"), F.md5(F.coalesce(df["text"].cast("string"), F.lit("")))))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """sizes: source, source_size. Adds the rank by code point (null last), weight and target.

    A target stops at `most` times its source; what is above goes to the others by weight. That ends at
    min(most * size, level * weight) for one level, found by a scan over the sources in the order in which they fill up.
    """
    every = W.partitionBy(F.lit(0))
    ranked = sizes.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    fill = every.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumns(
        {
            "left": F.sum("source_size").over(every).cast("double") * share - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    ranked = ranked.withColumn("holds", F.col("cap") * F.col("left_weight") >= F.col("left") * F.col("weight"))
    # the first source in filling order that isn't full sets the level for itself and all after it
    first = F.min_by(F.struct("left", "left_weight"), F.struct(F.col("cap") / F.col("weight"), F.col("rank")))
    level = ranked.where("holds").agg(first.alias("level"))
    return ranked.crossJoin(F.broadcast(level)).select(
        "source", "rank", "weight", "source_size",
        F.when(F.col("level").isNull(), F.col("cap").cast("double"))
        .otherwise(F.least(F.col("cap").cast("double"), F.col("level.left") * F.col("weight") / F.col("level.left_weight")))
        .alias("target"),
    )


def position(x: Column, target: Column, tilt: Column) -> Column:
    """The time t at which a schedule 1 + tilt * (1 - 2t), whose integral is t + tilt * (t - t * t), has demanded x of target."""
    u = x / target
    root = F.sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * u)
    return F.when(tilt == 0, u).otherwise(2 * u / (1 + tilt + root))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), tilts: tuple[float, ...] = (0.5, 0.0, -0.5), share: float = 1.0, most: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, position of the first copy; a row for each document.

    The weight of the source of rank r falls from weight * (1 + tilt) to weight * (1 - tilt) over training,
    with both taken from the tuples, repeating. A copy is taken if its middle token is within the target.
    """
    own = pick(docs, doc_id="long", text="string", source="string")
    rows = staged(own.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key(own, seed).alias("key")), "mix")
    buckets = max(1, math.isqrt(rows.count()))
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets, 32).cast("int"))
    sums = staged(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-sums")
    plan = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    plan = plan.withColumn("tilt", F.element_at(F.array(*map(F.lit, tilts)), (F.col("rank") % len(tilts) + 1).cast("int")))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "bucket_size")
    starts = starts.withColumnsRenamed({"source": "s", "bucket": "b"})
    inner = W.partitionBy("source", "bucket").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    queue = rows.withColumn("queued", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    # the middle of copy e is at e * source_size + at; it is taken while below the target
    queue = queue.withColumn("at", F.col("start") + F.col("queued") + F.col("size") / 2)
    copies = sum((F.when(F.col("at") + F.col("source_size") * e < F.col("target"), 1).otherwise(0) for e in range(most)), F.lit(0))
    queue = queue.withColumn("copies", copies)
    return queue.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
        F.when(F.col("copies") > 0, position(F.col("at"), F.col("target"), F.col("tilt"))).alias("position"), "at", "tilt", "key",
    )


def sorted_mix(docs: DataFrame, **options) -> DataFrame:
    """mix() in the order of first positions, documents that aren't taken last, by a range sort."""
    return mix(docs, **options).orderBy(F.col("position").asc_nulls_last(), "key")


def mixed_documents(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The documents themselves, with all their columns, each as often as the mix takes it, in training order.

    A document's choice is joined back by its source and order key; identical rows are numbered on both sides.
    """
    name, key, nth = (fresh(docs, x) for x in ("mix_source", "mix_key", "mix_nth"))
    tag = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    chosen = mix(docs, seed=seed, **options).select(tag(F.col("source")).alias("m_source"), F.col("key").alias("m_key"), "at", "copies", "source_size", "target", "tilt")
    chosen = staged(chosen, "mix-chosen")
    several = staged(chosen.groupBy("m_source", "m_key").count().where("count > 1").select(F.col("m_source").alias("s_source"), F.col("m_key").alias("s_key")), "mix-several")
    same = (F.col("m_source") == F.col("s_source")) & (F.col("m_key") == F.col("s_key"))
    taken = lambda rows: rows.where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("m_position", position(F.col("at") + F.col("epoch") * F.col("source_size"), F.col("target"), F.col("tilt")))
    own = docs.withColumn(name, tag(docs["source"])).withColumn(key, order_key(docs, seed))
    mine = (F.col(name) == F.col("m_source")) & (F.col(key) == F.col("m_key"))
    kept = [*docs.columns, "m_position", "m_key"]
    single = own.join(taken(chosen.join(several, same, "left_anti")).select("m_source", "m_key", "m_position"), mine).select(*kept)
    # rows that occur more than once
    numbered = chosen.join(several, same, "left_semi").withColumn("m_nth", F.row_number().over(W.partitionBy("m_source", "m_key").orderBy("at")))
    again = own.join(several, (F.col(name) == F.col("s_source")) & (F.col(key) == F.col("s_key")), "left_semi").withColumn(nth, F.row_number().over(W.partitionBy(name, key).orderBy(F.lit(0))))
    again = again.join(taken(numbered).select("m_source", "m_key", "m_nth", "m_position"), mine & (F.col(nth) == F.col("m_nth"))).select(*kept)
    return single.unionByName(again).orderBy("m_position", "m_key").select(*docs.columns)
