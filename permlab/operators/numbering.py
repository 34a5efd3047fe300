"""Dense numbers in an order, by a range sort: no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from permlab.sources.storage import staged


def numbered(rows: DataFrame, order: list[Column], name: str, keep: str | None = None) -> DataFrame:
    """rows with their number from 0 in the order; with `keep`, also the number of the range in a column of that name.

    The sort numbers rows within each range, in the upper and lower bits of an id; a row for each range adds what comes before it.
    """
    local = F.monotonically_increasing_id()
    held = staged(rows.orderBy(*order).withColumn("_at", local), "numbered")
    part, inner = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    out = held.join(F.broadcast(sizes), part == F.col("_part"))
    extra = [] if keep is None else [F.col("_part").alias(keep)]
    return out.select(*rows.columns, (F.col("_base") + inner).alias(name), *extra)
