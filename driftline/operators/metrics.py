"""Operational metrics: trailing sums, series, rates, percentiles, token buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing(events: DataFrame, now: Column, seconds: int) -> DataFrame:
    """(requests, feed, errors, limited, avg_ms) of the whole seconds before ``now``; it has ts, kind, status, ms."""
    second = F.date_trunc("second", "ts")
    since = F.date_trunc("second", now) - F.expr(f"interval {seconds} seconds")
    rows = events.where((second >= since) & (second < F.date_trunc("second", now)))
    feed = F.col("kind") == "feed"
    return rows.agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(feed).alias("feed"),
        F.count_if(F.col("status") >= 500).alias("errors"),
        F.count_if(F.col("status") == 429).alias("limited"),
        F.coalesce(F.sum(F.when(feed, F.col("ms"))) / F.nullif(F.count_if(feed), F.lit(0)), F.lit(0.0)).alias("avg_ms"),
    )


def minute_series(events: DataFrame, end: Column, points: int = 60) -> DataFrame:
    """(minute, per_second): the ``points`` whole minutes before ``end``, empty ones too."""
    spark = events.sparkSession
    last = spark.range(1).select(F.date_trunc("minute", end).alias("end")) if not isinstance(end, DataFrame) else end.select(F.date_trunc("minute", F.col(end.columns[0])).alias("end"))
    spine = last.select("end", F.explode(F.sequence(F.col("end") - F.expr(f"interval {points} minutes"), F.col("end") - F.expr("interval 1 minute"), F.expr("interval 1 minute"))).alias("minute"))
    counted = events.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counted, "minute", "left").select("minute", (F.coalesce("n", F.lit(0)) / F.lit(60.0)).alias("per_second"))


#: Ranges of values that the places of a group are counted in.
RANGES = 64


def place_percentiles(values: DataFrame, value: str, by: str) -> DataFrame:
    """(by, p50, p99) by place: sorted[n / 2] and sorted[min(99 n / 100, n - 1)].

    Each distinct value is counted first, map-side; the counts are put in ranges by approximate
    quantiles and summed there, so no group is sorted or put together in one task.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    edges = sorted(set(values.approxQuantile(value, [i / RANGES for i in range(1, RANGES)], 0.005)))
    part = F.array_position(F.array_sort(F.array_append(F.lit(edges).cast("array<double>"), F.col(value).cast("double"))), F.col(value).cast("double")) if edges else F.lit(1)
    parted = counted.withColumn("part", part)
    totals = parted.groupBy(by, "part").agg(F.sum("c").alias("c"))
    before = totals.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("size", F.sum("c").over(Window.partitionBy(by))).drop("c")  # RANGES rows for each group
    inner = F.sum("c").over(Window.partitionBy(by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = parted.withColumn("upto", inner).join(before, [by, "part"]).withColumn("upto", F.col("before") + F.col("upto"))
    p = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    return ranked.groupBy(by).agg(p(F.floor(F.col("size") / 2)).alias("p50"), p(F.least(F.floor(F.col("size") * 99 / 100), F.col("size") - 1)).alias("p99"))


def counter_rate(samples: DataFrame, by: str, seconds: int = 60) -> DataFrame:
    """(by, rate): increase a second of a counter since the latest sample at least ``seconds`` older than the last.

    A smaller value than before starts a new series; only the last series counts.  Without so old
    a sample the oldest is taken; one sample alone gives 0.
    """
    order = Window.partitionBy(by).orderBy("ts")
    reset = samples.withColumn("new", F.coalesce((F.col("n") < F.lag("n").over(order)).cast("int"), F.lit(0)))
    series = reset.withColumn("series", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(by)
    last = series.withColumn("latest", F.max("series").over(whole)).where(F.col("series") == F.col("latest"))
    ends = last.groupBy(by).agg(F.max("ts").alias("t1"), F.max_by("n", "ts").alias("n1"), F.min("ts").alias("t0"))
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    old = last.join(ends, by).where(sec("t1") - sec("ts") >= seconds).groupBy(by).agg(F.max("ts").alias("told"))
    start = ends.join(old, by, "left").withColumn("ts", F.coalesce("told", "t0"))
    rate = (F.col("n1") - F.col("n")) / F.nullif(sec("t1") - sec("ts"), F.lit(0.0))
    return start.join(last.select(by, "ts", "n"), [by, "ts"]).select(by, F.coalesce(rate, F.lit(0.0)).alias("rate"))


#: Seconds between samples of a counter, and samples kept: an hour of them and one.
SAMPLE_SECONDS, SAMPLES = 10, 361


def sampled(counters: DataFrame, by: str, value: str = "n", seconds: int = SAMPLE_SECONDS, most: int = SAMPLES) -> DataFrame:
    """(by, ts, value): a counter's last reading in each ``seconds``, the newest ``most`` of each series."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))
    last = counters.groupBy(by, slot.alias("slot")).agg(F.max("ts").alias("ts"), F.max_by(value, F.struct("ts", value)).alias(value))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("slot")))
    return last.withColumn("place", place).where(F.col("place") <= most).select(by, "ts", value)


def ewma(values: Column, keep: float = 0.8) -> Column:
    """keep * old + (1 - keep) * new over an ordered array; the first value seeds it."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda a, x: a * keep + x * (1 - keep))


def token_bucket(events: DataFrame, by: str, rate: float = 5.0, burst: float = 20.0, id: str = "event_id") -> DataFrame:
    """(by, id, allowed): the bucket of each key, filled by ``rate`` a second to ``burst``, one token an event.

    The fold needs each key's events in order; keys are folded in sorted batches, with the last
    state carried from one to the next, so a hot key needs no memory.
    """
    import numpy as np
    import pyarrow as pa

    kinds = {c: events.schema[c].dataType.simpleString() for c in (by, id)}

    def run(batches):
        key, tokens, last = None, burst, 0.0
        for b in batches:
            out = np.zeros(b.num_rows, bool)
            for i, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if k != key:
                    key, tokens, last = k, burst, t
                tokens, last = min(burst, tokens + (t - last) / 1e6 * rate), t
                if tokens >= 1:
                    tokens -= 1
                    out[i] = True
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out)], [by, id, "allowed"])

    ordered = events.select(by, id, F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).repartition(by).sortWithinPartitions(by, "us", id)
    return ordered.mapInArrow(run, f"{by} {kinds[by]}, {id} {kinds[id]}, allowed boolean")


def backfill_progress(seen: Column, total: Column, queue: Column, rate: Column, fetched: Column) -> tuple[Column, Column]:
    """(percent, seconds left): of a backfill, by the share that is kept and the rate of embedding."""
    share = F.when(seen > 0, F.least(F.lit(1.0), fetched / F.greatest(seen, F.lit(1)))).otherwise(1.0)
    return F.when(total > 0, F.least(F.lit(100.0), seen / total * 100)).otherwise(0.0), F.when(rate > 0, ((total - seen) * share + queue) / rate)
