"""Queries of metrics, user lists and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.operators import explore, filters, metrics, taste
from driftline.plans.tables import INTERACTIONS_SQL, REQUESTS_SQL, interactions, requests, table
from driftline.sources.shared import shared_path
from driftline.streaming import jobs

QUERIES, SQL = {}, {}
NOW = "TIMESTAMP '2024-01-20 12:00:30'"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {REQUESTS_SQL}, r AS (SELECT * FROM requests WHERE date_trunc('second', ts) >= {NOW} - INTERVAL 86400 SECOND AND date_trunc('second', ts) < {NOW}) SELECT count(*) AS requests, count(*) FILTER (WHERE kind = 'feed') AS feed, count(*) FILTER (WHERE status >= 500) AS errors, count(*) FILTER (WHERE status = 429) AS limited, round(coalesce(avg(ms) FILTER (WHERE kind = 'feed'), 0), 4) AS avg_ms FROM r")
def metrics_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.trailing(requests(spark, sf_dir), F.expr(NOW), 86400).withColumn("avg_ms", F.round("avg_ms", 4))


@query(f"WITH s AS (SELECT unnest(generate_series(date_trunc('minute', {NOW}) - INTERVAL 600 MINUTE, date_trunc('minute', {NOW}) - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS minute), c AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1) SELECT s.minute, round(coalesce(n, 0) / 60.0::DOUBLE, 6) AS per_second FROM s LEFT JOIN c ON s.minute = c.minute")
def metrics_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.minute_series(table(spark, sf_dir, "events"), F.expr(NOW), 600).withColumn("per_second", F.round("per_second", 6))


@query(f"WITH {REQUESTS_SQL}, v AS (SELECT kind, list(ms ORDER BY ms) AS v FROM requests GROUP BY kind) SELECT kind, round(v[len(v) // 2 + 1], 6) AS p50, round(v[least(len(v) * 99 // 100, len(v) - 1) + 1], 6) AS p99 FROM v")
def latency_p50_p99(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.place_percentiles(requests(spark, sf_dir), "ms", "kind").select("kind", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


_SAMPLES = "samples AS (SELECT user_id, ts, n FROM (SELECT user_id, ts, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) % 40 * 7 AS n, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS one FROM events) WHERE one = 1)"


@query(
    f"WITH {_SAMPLES}, l AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM samples), s AS (SELECT *, sum(CASE WHEN n < before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS series FROM l), "
    "m AS (SELECT * FROM (SELECT *, max(series) OVER (PARTITION BY user_id) AS latest FROM s) WHERE series = latest), e AS (SELECT user_id, max(ts) AS t1, arg_max(n, ts) AS n1, min(ts) AS t0 FROM m GROUP BY user_id), "
    "o AS (SELECT m.user_id, max(m.ts) AS told FROM m JOIN e ON m.user_id = e.user_id WHERE epoch_us(t1) - epoch_us(ts) >= 60000000 GROUP BY m.user_id), b AS (SELECT e.*, coalesce(told, t0) AS t FROM e LEFT JOIN o ON e.user_id = o.user_id) "
    "SELECT b.user_id, round(coalesce((n1 - n) / nullif((epoch_us(t1) - epoch_us(t)) / 1000000.0::DOUBLE, 0), 0), 9) AS rate FROM b JOIN m ON b.user_id = m.user_id AND b.t = m.ts"
)
def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) % 40 * 7
    one = F.row_number().over(Window.partitionBy("user_id", "ts").orderBy("event_id"))
    samples = e.withColumn("n", n).withColumn("one", one).where("one = 1").select("user_id", "ts", "n")
    return metrics.counter_rate(samples, "user_id").select("user_id", F.round("rate", 9).alias("rate"))


@query("WITH v AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(v, lambda a, x: a * 0.8::DOUBLE + x * 0.2::DOUBLE), 6) AS rate FROM v")
def ewma_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    return v.select("user_id", F.round(metrics.ewma(F.col("v")), 6).alias("rate"))


@query(
    "WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS ("
    "SELECT user_id, event_id, us, i, 2.0::DOUBLE AS had FROM o WHERE i = 1 UNION ALL "
    "SELECT o.user_id, o.event_id, o.us, o.i, least(2.0::DOUBLE, f.had - CASE WHEN f.had >= 1 THEN 1 ELSE 0 END + (o.us - f.us) / 1000000.0::DOUBLE * 0.00005::DOUBLE) FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1) "
    "SELECT user_id, event_id, had >= 1 AS allowed FROM f"
)
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.token_bucket(table(spark, sf_dir, "events"), "user_id", rate=0.00005, burst=2.0)


@query(f"WITH {INTERACTIONS_SQL}, f AS (SELECT user_id, id, min(ts) AS ts FROM interactions WHERE kind = 'seen' GROUP BY user_id, id) SELECT user_id, id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS place FROM f) WHERE place <= 10")
def seen_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taste.ring(interactions(spark, sf_dir).where("kind = 'seen'"), 10).select("user_id", "id", "place")


@query("WITH s AS (SELECT user_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || CAST(event_id % 4 AS VARCHAR) AS q, ts FROM events), l AS (SELECT user_id, lower(q) AS k, arg_max(q, struct_pack(ts := ts, q := q)) AS q, max(ts) AS ts FROM s GROUP BY user_id, lower(q)) SELECT user_id, q, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, k) AS place FROM l) WHERE place <= 12")
def recent_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), (F.col("event_id") % 4).cast("string"))
    return taste.recent_searches(table(spark, sf_dir, "events").select("user_id", q.alias("q"), "ts")).select("user_id", "q", "place")


@query("WITH c AS (SELECT CASE WHEN coalesce(source, '') = '' THEN 'Unknown field' ELSE source END AS name, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS place, count(*) OVER () AS groups FROM c) SELECT CASE WHEN groups > 8 AND place >= 8 THEN 'Other' ELSE name END AS name, CAST(sum(n) AS BIGINT) AS n, CAST(min(place) AS INTEGER) AS place FROM p GROUP BY 1")
def liked_by_field_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taste.bars(table(spark, sf_dir, "documents"), "source")


@query(f"WITH {INTERACTIONS_SQL} SELECT user_id, arg_max(id, struct_pack(ts := ts, id := id)) AS id FROM interactions WHERE kind = 'like' GROUP BY user_id")
def last_like_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taste.last_likes(interactions(spark, sf_dir).where("kind = 'like'"))


@query("SELECT event_id, CASE WHEN event_id < 60 THEN 'just now' WHEN event_id < 3600 THEN CAST(event_id // 60 AS VARCHAR) || 'm ago' WHEN event_id < 86400 THEN CAST(event_id // 3600 AS VARCHAR) || 'h ago' ELSE CAST(event_id // 86400 AS VARCHAR) || 'd ago' END AS ago FROM events")
def relative_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.ago(F.col("event_id")).alias("ago"))


@query("SELECT DISTINCT n_chars, ceil(n_chars / pow(10.0::DOUBLE, floor(log10(n_chars)))) * pow(10.0::DOUBLE, floor(log10(n_chars))) AS top FROM documents WHERE n_chars > 0")
def nice_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("n_chars > 0").select("n_chars").distinct().select("n_chars", S.nice_max(F.col("n_chars").cast("double")).alias("top"))


def _drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream gives over what is there now, through files in the shared folder; of a complete result the last one."""
    spark = stream.sparkSession
    path = shared_path(spark, f"stream-{name}")
    run_over(stream, path, mode)
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{path}/out")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def run_over(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Let a stream go over what is there now: its batches to ``path``/out, where it got to in ``path``/checkpoint."""
    with jobs.state_store(stream.sparkSession):
        q = stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}")).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT event_type, user_id, count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1, 2")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir).select(F.concat_ws("|", "event_type", "user_id").alias("id"), "event_type", "user_id")
    return _drain(jobs.new_rows(e, title=None), "dedupe").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f'WITH {REQUESTS_SQL} SELECT date_trunc(\'minute\', ts) AS "start", kind, count(*) AS n, count(*) FILTER (WHERE status >= 500) AS errors, count(*) FILTER (WHERE status = 429) AS limited FROM requests GROUP BY 1, 2')
def stream_minute_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir)
    kind = F.when(F.col("event_type") == "view", "feed").when(F.col("event_type") == "click", "search").otherwise(F.col("event_type"))
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 429).otherwise(200)
    counted = jobs.counters(e.select(F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), status.alias("status"), F.col("value").alias("ms")), "1 minute")
    return _drain(counted, "minutes", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", "errors", "limited")


@query("SELECT DISTINCT 'W' || CAST(user_id AS VARCHAR) AS id FROM events WHERE event_type = 'click'")
def stream_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir).where("event_type = 'click'").select(F.concat(F.when(F.col("event_id") % 2 == 0, "W").otherwise("X"), F.col("user_id").cast("string")).alias("id"))
    good = _stream(spark, sf_dir).where("event_type = 'click'").select(F.concat(F.lit("W"), F.col("user_id").cast("string")).alias("id"))
    return _drain(jobs.pending_ids(e.unionAll(good)), "pending")


@query("SELECT DISTINCT user_id, event_id % 500 AS id FROM events JOIN embeddings ON event_id % 500 = vec_id WHERE event_type = 'purchase' AND vec_id % 3 <> 0")
def stream_pending_likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likes of papers that the index holds by now, with the index as the static side."""
    e = _stream(spark, sf_dir).where("event_type = 'purchase'").select("user_id", (F.col("event_id") % 500).alias("id"))
    index = table(spark, sf_dir, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"))
    return _drain(jobs.pending_likes(e, index), "likes").distinct()


@query("SELECT user_id, max(epoch_us(ts)) AS us, arg_max(n, struct_pack(ts := ts, n := n)) AS n FROM (SELECT *, epoch_us(ts) // 10000000 AS slot FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)) GROUP BY user_id, slot QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY slot DESC) <= 361")
def sampler_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    s = metrics.sampled(table(spark, sf_dir, "events").withColumn("n", n.cast("long")), "user_id")
    return s.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "n")


@query("SELECT event_id, CASE WHEN event_id % 40 - 10 BETWEEN 1 AND 20 THEN event_id % 40 - 10 ELSE 8 END AS k, CASE WHEN event_id % 3 = 0 THEN 'top' ELSE '' END AS mode, CASE WHEN event_id % 7 = 0 THEN 1 ELSE greatest(1, least(50, event_id % 90 - 20)) END AS page FROM events")
def request_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    mode = F.when(e % 3 == 0, "top").when(e % 3 == 1, "bad")
    asked = filters.request_columns(e % 40 - 10, mode, F.when(e % 7 != 0, e % 90 - 20))
    return table(spark, sf_dir, "events").select("event_id", *[c.cast("string" if n == "mode" else "long").alias(n) for n, c in asked.items()])


@query("SELECT event_id, CAST(year(ts) - 2 AS INTEGER) AS two, CAST(year(ts) - 5 AS INTEGER) AS five, CAST(year(ts) - 10 AS INTEGER) AS ten FROM events")
def year_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    floors = explore.year_floors(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", floors[2].alias("two"), floors[5].alias("five"), floors[10].alias("ten"))


@query(f"WITH {INTERACTIONS_SQL}, a AS (SELECT user_id, id, min(ts) AS ts FROM interactions WHERE kind = 'seen' GROUP BY user_id, id), b AS (SELECT user_id, list(id ORDER BY ts, id) AS l FROM a GROUP BY user_id) SELECT user_id, CASE WHEN len(l) > 1000 THEN list_slice(l, -1000, -1) ELSE l END AS seen, list_transform(CASE WHEN len(l) > 500 THEN list_slice(l, -500, -1) ELSE l END, lambda x: x + 1) AS bookmarks FROM b")
def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists exported as JSON and imported again, cut to their newest."""
    first = interactions(spark, sf_dir).where("kind = 'seen'").groupBy("user_id", "id").agg(F.min("ts").alias("ts"))
    lists = first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id"))), lambda x: x["id"]).alias("seen"))
    out = taste.export_state(lists.withColumn("bookmarks", F.transform("seen", lambda x: x + 1)))
    return taste.import_lists(out).select("user_id", "seen", "bookmarks")


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of events as requests."""
    e = _stream(spark, sf_dir)
    kind = F.when(F.col("event_type") == "view", "feed").when(F.col("event_type") == "click", "search").otherwise(F.col("event_type"))
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 429).otherwise(200)
    return e.select(F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), status.alias("status"), F.col("value").alias("ms"))


_CLOSED = "epoch_us(date_trunc('second', ts)) + 1000000 <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000"


@query(
    f"WITH {REQUESTS_SQL}, s AS (SELECT kind, epoch_us(date_trunc('second', ts)) // 1000000 AS second, count(*) AS n, count(*) FILTER (WHERE status >= 500) AS errors, sum(ms) AS ms FROM requests WHERE {_CLOSED} GROUP BY 1, 2), "
    "w AS (SELECT unnest([60, 3600]) AS span) SELECT a.kind, a.second, CAST(span AS INTEGER) AS span, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n, CAST(coalesce(sum(b.errors), 0) AS BIGINT) AS errors, round(coalesce(sum(b.ms), 0), 4) AS ms "
    "FROM s a CROSS JOIN w LEFT JOIN s b ON a.kind = b.kind AND b.second >= a.second - span AND b.second < a.second GROUP BY 1, 2, 3"
)
def stream_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the minute and of the hour before each second that has requests, from a ring that the stream keeps."""
    out = _drain(jobs.trailing_sums(_timed(spark, sf_dir)), "trailing")
    return out.select("kind", "second", "span", "n", "errors", F.round("ms", 4).alias("ms"))


@query(
    "SELECT user_id, max(epoch_us(ts)) AS us, arg_max(event_id, struct_pack(ts := ts, n := event_id)) AS n FROM (SELECT *, epoch_us(ts) // 10000000 AS slot FROM events) "
    "WHERE (slot + 1) * 10000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000 GROUP BY user_id, slot"
)
def stream_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last reading of each ten seconds and user, as soon as they are over."""
    e = _stream(spark, sf_dir).select("user_id", "ts", F.col("event_id").alias("n"))
    return _drain(jobs.samples(e, "user_id"), "samples").select(F.col("key").alias("user_id"), "us", "n")


@query(
    "SELECT user_id, vec_id AS id, CAST(CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS build FROM (SELECT DISTINCT user_id, event_id % 700 AS id FROM events WHERE event_type = 'purchase') JOIN embeddings ON id = vec_id WHERE vec_id % 3 <> 2"
)
def stream_waiting_likes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likes wait until a build has their paper: builds come one after the other, and each like is passed on once, with the first that has it."""
    path = shared_path(spark, "waiting")
    likes = _stream(spark, sf_dir).where("event_type = 'purchase'").select("user_id", (F.col("event_id") % 700).alias("id")).distinct()
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    for build, rows in ((1, e.where("id % 3 = 0")), (2, e.where("id % 3 <> 2"))):
        rows.withColumn("build", F.lit(build).cast("long")).write.mode("append").parquet(f"{path}/builds")
        builds = spark.readStream.schema("id long, build long").parquet(f"{path}/builds")
        run_over(jobs.waiting_likes(likes, builds), f"{path}/stream")
    return spark.read.schema("user_id long, id long, build long, batch long").parquet(f"{path}/stream/out").drop("batch")
