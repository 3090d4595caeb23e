"""Adapters from the test tables to papers, vectors, interactions and request metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import vectors as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``papers`` without their field, which takes a join that moves every text."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
        F.col("lang"),
        F.col("source").alias("venue"),
        F.col("n_chars").alias("cited"),
        (2000 + F.col("doc_id") % 26).cast("int").alias("year"),
        (10000 + F.col("doc_id") % 37).cast("int").alias("topic"),
        F.col("doc_id").alias("seq"),
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers; year, topic and exclusion are synthetic attributes of the id."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return texts(spark, sf_dir).join(e, "id", "left").select("*", F.coalesce(F.concat(F.lit("field"), F.col("label").cast("string")), F.lit("")).alias("field")).drop("label")


PAPERS_SQL = """papers AS (
  SELECT d.doc_id AS id, split_part(d.text, chr(10), 1) AS title, d.text AS abstract, d.lang, d.source AS venue, d.n_chars AS cited,
         CAST(2000 + d.doc_id % 26 AS INTEGER) AS year, CAST(10000 + d.doc_id % 37 AS INTEGER) AS topic, d.doc_id AS seq,
         coalesce('field' || CAST(e.label AS VARCHAR), '') AS field
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, row, label, u, scale, q) of all embeddings."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("row"), "label", V.normalize(F.col("embedding")).alias("u"))
    return e.withColumn("scale", V.scale_of(F.col("u"))).withColumn("q", V.quantize(F.col("u")))


VECTORS_SQL = """raw AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), norms AS (
  SELECT id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM raw
), unit AS (
  SELECT id, label, CASE WHEN norm > 0 THEN list_transform(e, lambda x: x / norm) ELSE e END AS u FROM norms
), scaled AS (
  SELECT id, label, u, list_max(list_transform(u, lambda x: abs(x))) / 127.0::DOUBLE AS scale FROM unit
), vectors AS (
  SELECT id, label, u, scale, list_transform(u, lambda x: CASE WHEN scale > 0 THEN CAST(greatest(-127, least(127, round(x / scale))) AS INTEGER) ELSE 0 END) AS q FROM scaled
)"""


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with their paper's attributes; the label is the cluster."""
    p = papers(spark, sf_dir).select("id", "year", "cited", "field", "topic", "venue")
    return unit_vectors(spark, sf_dir).join(p, "id").withColumn("cluster", F.col("label").cast("int"))


INDEX_SQL = f"""{VECTORS_SQL}, {PAPERS_SQL}, idx AS (
  SELECT v.id, v.label AS cluster, v.u, v.scale, v.q, p.year, p.cited, p.field, p.topic, p.venue FROM vectors v JOIN papers p ON v.id = p.id
)"""


def queries_of(index: DataFrame, every: int) -> DataFrame:
    """Query vectors: those whose id is divisible by ``every``."""
    return index.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "u", "q", "scale")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as interactions: purchases are likes, views are seen, clicks are opened; the paper is the id modulo 500."""
    kind = F.when(F.col("event_type") == "purchase", "like").when(F.col("event_type") == "view", "seen").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("user_id", "ts", kind.alias("kind"), (F.col("event_id") % 500).alias("id"), "event_id")


INTERACTIONS_SQL = """interactions AS (
  SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'like' WHEN 'view' THEN 'seen' ELSE event_type END AS kind, event_id % 500 AS id, event_id FROM events)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: views are feeds, clicks searches, errors fail, signups are limited; the value is milliseconds."""
    kind = F.when(F.col("event_type") == "view", "feed").when(F.col("event_type") == "click", "search").otherwise(F.col("event_type"))
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 429).otherwise(200)
    return table(spark, sf_dir, "events").select("event_id", "ts", kind.alias("kind"), status.alias("status"), F.col("value").alias("ms"), "user_id")


REQUESTS_SQL = """requests AS (
  SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'feed' WHEN 'click' THEN 'search' ELSE event_type END AS kind,
         CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 429 ELSE 200 END AS status, value AS ms, user_id FROM events)"""
