"""Places in a distributed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.sources.shared import stored


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place from 1 in ``order`` as ``name``; no task sees more than its range.

    Rows are sorted by ranges and stored with their place in their partition; what comes to the driver is a
    count for each partition.  ``order`` should settle ties: rows that tie may be in either order.
    """
    laid = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    starts, before = [], 0
    for p, n in sorted(laid.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((p, before))
        before += n
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _start long"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return laid.withColumn("_part", part).join(first, "_part").withColumn(name, place).drop("_at", "_part", "_start")
