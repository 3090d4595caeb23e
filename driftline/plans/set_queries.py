"""Queries of set operations, validation and transport."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.functions import vectors as V
from driftline.operators import metrics, sets
from driftline.plans.tables import INTERACTIONS_SQL, PAPERS_SQL, interactions, papers, search_index, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"WITH {INTERACTIONS_SQL} SELECT user_id, id FROM interactions WHERE kind = 'seen' UNION SELECT user_id, id FROM interactions WHERE kind = 'like'")
def set_seen_or_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = interactions(spark, sf_dir)
    return sets.union_distinct(i.where("kind = 'seen'"), i.where("kind = 'like'"), "user_id", "id")


@query(f"WITH {INTERACTIONS_SQL} SELECT user_id, id FROM interactions WHERE kind = 'seen' EXCEPT SELECT user_id, id FROM interactions WHERE kind = 'like'")
def set_seen_except_liked(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = interactions(spark, sf_dir)
    return i.where("kind = 'seen'").select("user_id", "id").distinct().join(i.where("kind = 'like'"), ["user_id", "id"], "left_anti")


@query(f"WITH {INTERACTIONS_SQL} SELECT count(*) AS both FROM (SELECT user_id, id FROM interactions WHERE kind = 'seen' INTERSECT SELECT user_id, id FROM interactions WHERE kind = 'like')")
def set_seen_and_liked(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = interactions(spark, sf_dir)
    return i.where("kind = 'seen'").select("user_id", "id").intersect(i.where("kind = 'like'").select("user_id", "id")).agg(F.count(F.lit(1)).alias("both"))


_ORDERED = "SELECT user_id, list(id ORDER BY ts, event_id) FILTER (WHERE kind = 'seen') AS a, list(id ORDER BY ts, event_id) FILTER (WHERE kind = 'click') AS b FROM interactions GROUP BY user_id"


@query(
    f"WITH {INTERACTIONS_SQL}, l AS ({_ORDERED}), p AS (SELECT user_id, unnest(list_concat(coalesce(a, []), coalesce(b, []))) AS id, generate_subscripts(list_concat(coalesce(a, []), coalesce(b, [])), 1) AS i FROM l), "
    "f AS (SELECT user_id, id, min(i) AS i FROM p GROUP BY user_id, id), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS back FROM f) SELECT user_id, list(id ORDER BY i) AS sent FROM n WHERE back <= 15 GROUP BY user_id"
)
def set_newest_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ts", "event_id", "id")))), lambda x: x["id"])
    lists = interactions(spark, sf_dir).groupBy("user_id").agg(ordered("seen").alias("a"), ordered("click").alias("b"))
    return lists.select("user_id", sets.newest_distinct(F.col("a"), F.col("b"), size=15).alias("sent"))


@query("SELECT id, page, place FROM (SELECT event_id % 700 AS id, event_id // 1000 AS page, event_id % 1000 AS place, row_number() OVER (PARTITION BY event_id % 700 ORDER BY event_id // 1000, event_id % 1000) AS n FROM events) WHERE n = 1")
def set_merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return sets.merge_pages(table(spark, sf_dir, "events").select((e % 700).alias("id"), F.floor(e / 1000).alias("page"), (e % 1000).alias("place")))


@query("SELECT o_custkey, list_slice(list(p ORDER BY i), 1, 3) AS first FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS i FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def set_first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("all"))
    return o.select("o_custkey", sets.first_values(F.col("all"), 3).alias("first"))


@query("SELECT vec_id, vec_id % 3 = 0 AS valid FROM embeddings")
def vec_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests' vectors: whole ones are good, short ones and those with a NaN are not."""
    e, v = table(spark, sf_dir, "embeddings"), F.col("embedding")
    sent = F.when(F.col("vec_id") % 3 == 0, v).when(F.col("vec_id") % 3 == 1, F.slice(v, 1, 63)).otherwise(F.transform(v, lambda x, i: F.when(i == 5, float("nan")).otherwise(x)))
    return e.select("vec_id", V.valid_query(sent, 64).alias("valid"))


@query("SELECT vec_id, CAST(round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS DOUBLE) AS total, 256 AS bytes FROM embeddings")
def vector_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors through base64 and back."""
    sent = table(spark, sf_dir, "embeddings").select("vec_id", F.base64(V.encode_f32("embedding")).alias("s"))
    back = sent.select("vec_id", F.unbase64("s").alias("raw")).select("vec_id", V.decode_f32("raw").alias("v"), F.octet_length("raw").alias("bytes"))
    return back.select("vec_id", F.round(F.aggregate(V.doubles(F.col("v")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"), "bytes")


@query(f"WITH {PAPERS_SQL} SELECT i.id, i.cited FROM papers i WHERE i.id IN (3, 14, 159)")
def vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.sources.files import lookup

    return lookup(papers(spark, sf_dir), ["W3", "https://w.example/W14", "159", "none"]).select("id", "cited")


@query("SELECT (SELECT count(*) FROM documents) AS fetched, (SELECT count(*) FROM embeddings) AS embedded, (SELECT count(*) FROM embeddings JOIN documents ON vec_id = doc_id) AS indexed, (SELECT count(*) FROM documents) - (SELECT count(*) FROM embeddings) AS queue")
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.sources.sinks import status

    return status(papers(spark, sf_dir), table(spark, sf_dir, "embeddings"), search_index(spark, sf_dir))


@query("SELECT doc_id, round(least(100, doc_id / 1000000000.0::DOUBLE * 100), 9) AS percent, round(((1000000000 - doc_id) * (CASE WHEN doc_id > 0 THEN least(1, (doc_id // 2) / CAST(greatest(doc_id, 1) AS DOUBLE)) ELSE 1 END) + 10) / 2.5::DOUBLE, 4) AS seconds FROM documents")
def backfill_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    percent, seconds = metrics.backfill_progress(F.col("doc_id"), F.lit(1_000_000_000), F.lit(10), F.lit(2.5), F.floor(F.col("doc_id") / 2))
    return d.select("doc_id", F.round(percent, 9).alias("percent"), F.round(seconds, 4).alias("seconds"))


@query("SELECT n_chars, CASE WHEN n_chars < 90 THEN CAST(n_chars AS VARCHAR) || 's' WHEN n_chars < 5400 THEN CAST(CAST(round(n_chars / 60.0::DOUBLE) AS BIGINT) AS VARCHAR) || ' min' WHEN n_chars < 172800 THEN printf('%.1f', n_chars / 3600.0::DOUBLE) || ' h' ELSE printf('%.1f', n_chars / 86400.0::DOUBLE) || ' days' END AS said FROM (SELECT DISTINCT n_chars FROM documents)")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("n_chars").distinct().select("n_chars", S.duration(F.col("n_chars")).alias("said"))
