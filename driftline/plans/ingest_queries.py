"""Queries of readers, writers and the streams of the ingest loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import text as X
from driftline.functions.scalars import parse_id
from driftline.operators import feed, ingest, search
from driftline.operators.order import ranked
from driftline.plans.metric_queries import _drain, _stream, run_over
from driftline.plans.tables import INDEX_SQL, INTERACTIONS_SQL, PAPERS_SQL, interactions, papers, table, unit_vectors
from driftline.plans.vector_queries import CENTROIDS_SQL, FDOT, NARROW, NARROW_SQL, U_SQL
from driftline.schema import WORK
from driftline.sources import crawl, files, sinks
from driftline.sources.shared import shared_path
from driftline.streaming import jobs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as crawled works: titles from the first line, the words of the whole text as an inverted index, attributes by id."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "n_chars")
    n = F.col("doc_id")
    field = F.struct(F.when(n % 4 == 3, "https://f.example/23").otherwise("https://f.example/17").alias("id"), F.when(n % 2 == 0, "Science").otherwise("").alias("display_name"))
    topic = F.struct(F.concat(F.lit("https://t.example/T"), (n % 7).cast("string")).alias("id"), F.concat(F.lit("Topic "), (n % 7).cast("string")).alias("display_name"), F.struct(F.concat(F.lit("https://s.example/"), (n % 5).cast("string")).alias("id"), F.lit("").alias("display_name")).alias("subfield"), field.alias("field"))
    return d.select(
        F.concat(F.lit("https://w.example/W"), n.cast("string")).alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        X.invert_text(F.col("text")).alias("abstract_inverted_index"),
        F.array(*[F.struct(F.struct(x.alias("display_name")).alias("author")) for x in (F.lit("Ann"), F.lit(""), F.when(n % 2 == 0, "Bo"))]).alias("authorships"),
        (2000 + n % 26).cast("int").alias("publication_year"),
        F.struct(F.lit("").alias("landing_page_url"), F.struct(F.lit("Journal").alias("display_name")).alias("source")).alias("primary_location"),
        F.struct(F.lit(None).cast("string").alias("pdf_url")).alias("best_oa_location"),
        F.lit(None).cast("string").alias("doi"),
        F.col("n_chars").alias("cited_by_count"),
        topic.alias("primary_topic"),
        (n % 19 == 0).alias("is_retracted"),
        F.when(F.col("lang") == "en", "en").when(n % 3 == 0, "").otherwise(F.col("lang")).alias("language"),
    )


def _labels(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    topics = spark.createDataFrame([("T0", "Zero"), ("T1", None), ("T2", "Two")], "topic_id string, category string")
    return topics, spark.createDataFrame([("1", "Sub one"), ("2", "Sub two")], "subfield_id string, category string")


_CLEAN = r"trim(regexp_replace(regexp_replace(replace({0}, '\n', ' '), '<[^>]+>', '', 'g'), '[\s\x0B]+', ' ', 'g'))"
_CONVERTED = f"""w AS (
  SELECT doc_id AS id, {_CLEAN.format("split_part(text, chr(10), 1)")} AS title, {_CLEAN.format("text")} AS abstract, n_chars AS cited_by,
         CASE WHEN lang = 'en' THEN 'en' WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS language FROM documents
), good AS (
  SELECT * FROM w WHERE id % 19 <> 0 AND language IN ('', 'en') AND length(title) >= 8 AND length(abstract) >= 200 AND id % 4 <> 3 AND id % 7 <> 1
    AND NOT regexp_matches(lower(title), '^(proceedings of|front matter|table of contents|index$|preface)')
), converted AS (
  SELECT id, title, length(abstract) AS n, cited_by, CASE WHEN id % 7 = 0 THEN 'Zero' WHEN id % 7 = 2 THEN 'Two' WHEN id % 5 = 1 THEN 'Sub one' WHEN id % 5 = 2 THEN 'Sub two' WHEN id % 2 = 0 THEN 'Science' ELSE 'Other' END AS field,
         CASE WHEN id % 2 = 0 THEN 'Ann,Bo' ELSE 'Ann' END AS authors, 'T' || CAST(id % 7 AS VARCHAR) AS topic_id FROM good)"""


@query(f"WITH {_CONVERTED} SELECT * FROM converted")
def convert_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of a gzipped JSON-lines snapshot as papers: those worth showing, with rebuilt abstracts, fields and authors."""
    path = shared_path(spark, "snapshot")
    _works(spark, sf_dir).write.option("compression", "gzip").json(path)
    assert files.snapshot(spark, path).schema == WORK
    p = ingest.convert(files.snapshot(spark, path), *_labels(spark))
    return p.select("id", "title", F.length("abstract").cast("long").alias("n"), "cited_by", "field", F.array_join("authors", ",").alias("authors"), "topic_id")


@query(f"WITH {PAPERS_SQL}, k AS (SELECT id, title, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS key FROM papers), h AS (SELECT id, key, 1 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS r FROM k WHERE id % 3 = 0) WHERE r = 1), "
       "r AS (SELECT id, key, 2 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id) AS r FROM k WHERE id NOT IN (SELECT id FROM h) AND key NOT IN (SELECT key FROM h)) WHERE r = 1) SELECT id, batch FROM h UNION ALL SELECT id, batch FROM r")
def append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers appended in two batches, the second twice: ids and titles that are there stay out."""
    p, path = papers(spark, sf_dir).select("id", "title", "seq"), shared_path(spark, "papers")
    sinks.append_new(p.where("id % 3 = 0").withColumn("batch", F.lit(1)), path)
    for _ in range(2):
        sinks.append_new(p.withColumn("batch", F.lit(2)), path)
    return spark.read.parquet(path).select("id", "batch")


@query(
    f"WITH {INDEX_SQL}, {CENTROIDS_SQL}, near AS (SELECT z.id, i.cluster, row_number() OVER (PARTITION BY z.id ORDER BY round({FDOT}, 12) DESC, i.cluster) AS r FROM centroids i, idx z) "
    'SELECT id, CAST(cluster AS INTEGER) AS cluster, row_number() OVER (ORDER BY cluster, id) - 1 AS "row" FROM near WHERE r = 1 AND id % 13 <> 0'
)
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index without excluded papers, grouped by cluster, written, pointed to, and opened again."""
    p = papers(spark, sf_dir).select("id", "year", "cited", "field", "topic", "venue", "seq", (F.col("id") % 13 == 0).alias("excluded"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(p, "id")
    path = shared_path(spark, "index")
    sinks.write_index(search.build_index(rows, search.mean_centroids(unit_vectors(spark, sf_dir))), path)
    return files.index_scan(spark, path).select("id", "cluster", F.col("row").cast("long").alias("row"))


@query(f"WITH {INTERACTIONS_SQL}, f AS (SELECT 'W' || CAST(event_id * 7 % 5000 AS VARCHAR) AS id, min(event_id) AS e FROM interactions WHERE kind = 'click' GROUP BY 1) SELECT id FROM f ORDER BY e, id LIMIT 300")
def pending_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pending log takes an id once, and no more than it has room for."""
    log = interactions(spark, sf_dir).where("kind = 'click'").select(F.concat(F.lit("W"), (F.col("event_id") * 7 % 5000).cast("string")).alias("id"), F.col("event_id").alias("ts"))
    path = shared_path(spark, "pending")
    for part in (log.unionAll(log.withColumn("id", F.lit("X1"))), log):
        sinks.append_pending(part, path, 300)
    return spark.read.parquet(path).select("id")


@query("SELECT user_id, max(epoch_us(ts)) AS us, count(*) AS n FROM (SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2) GROUP BY user_id")
def stream_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids remembered for two weeks of event time: of each the first, as all events are within that time of one another."""
    ordered = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"))
    path = shared_path(spark, "events")
    for _ in range(2):  # the same rows again, as a margin for late data brings them
        ordered.select(F.concat_ws("|", "user_id", "event_type").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(path)
    s = spark.readStream.schema("id string, user_id long, ts timestamp").parquet(path)
    return _drain(jobs.new_rows(s, title=None, ts="ts"), "late").groupBy("user_id").agg(F.max(F.unix_micros("ts")).alias("us"), F.count(F.lit(1)).alias("n"))


@query(
    "WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS ("
    "SELECT user_id, event_id, us, i, 2.0::DOUBLE AS had FROM o WHERE i = 1 UNION ALL "
    "SELECT o.user_id, o.event_id, o.us, o.i, least(2.0::DOUBLE, f.had - CASE WHEN f.had >= 1 THEN 1 ELSE 0 END + (o.us - f.us) / 1000000.0::DOUBLE * 0.00005::DOUBLE) FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1) "
    'SELECT user_id AS "key", event_id, had >= 1 AS allowed FROM f'
)
def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets of ``token_bucket`` as the state of a stream."""
    return _drain(jobs.limited(_stream(spark, sf_dir), "user_id", 0.00005, 2.0), "buckets")


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings")
def matrix_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as raw float files, read again by ranges of rows and paired with their ids by position."""
    path = shared_path(spark, "matrix")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    laid = ranked(e, [F.asc("id")], "place")
    sinks.write_matrix(laid.repartitionByRange("place").sortWithinPartitions("place"), path)
    rows = files.in_file_order(files.matrix(spark, path, 64, rows=300))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("position", F.round(total, 4).alias("total")).join(laid.select("id", (F.col("place") - 1).alias("position")), "position").select("id", "total", "position")


@query("SELECT doc_id AS id, CAST(length(split_part(text, chr(10), 1)) AS INTEGER) AS n, n_chars AS cited FROM documents")
def stream_crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as page files of a crawl, streamed some pages a batch, over two starts; each work once."""
    path = shared_path(spark, "pages")
    d = table(spark, sf_dir, "documents")
    work = F.to_json(F.struct(F.concat(F.lit("https://w.example/W"), F.col("doc_id").cast("string")).alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("n_chars").alias("cited_by_count")))
    pages = d.groupBy(F.floor(F.col("doc_id") / 500).alias("page")).agg(F.concat(F.lit('{"results": ['), F.array_join(F.collect_list(work), ","), F.lit("]}")).alias("value"))
    for odd in (0, 1):
        pages.where(F.col("page") % 2 == odd).repartition("page").write.mode("append").partitionBy("page").text(f"{path}/in")
        run_over(crawl.folder_stream(spark, f"{path}/in", 40, "*.txt"), f"{path}/stream")
    found = spark.read.schema("file string, id string, body string, batch long").parquet(f"{path}/stream/out")
    return crawl.works(found).select(parse_id(F.col("id")).alias("id"), F.length("title").alias("n"), F.col("cited_by_count").alias("cited"))


_BUILDS = """first AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS "row" FROM idx WHERE id % 13 <> 0), second AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS "row" FROM idx WHERE id % 11 <> 0)"""


@query(
    f"WITH {INDEX_SQL}, {_BUILDS}, ring AS (SELECT id, row_number() OVER (ORDER BY {U_SQL('name')}, id) - 1 AS place FROM (SELECT id, CAST(id AS VARCHAR) || '|st' AS name FROM idx WHERE id % 11 <> 0 AND {NARROW_SQL})), "
    f"starts AS (SELECT query_id, CAST(floor({U_SQL('name')} * (SELECT count(*) FROM ring)) AS BIGINT) AS first FROM (SELECT 1000 + k AS query_id, CAST(1000 + k AS VARCHAR) || '|st|at' AS name FROM (SELECT unnest(generate_series(0, 4)) AS k))), "
    "others AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY (place - first + (SELECT count(*) FROM ring)) % (SELECT count(*) FROM ring)) AS turn FROM starts, ring) "
    "SELECT \"row\" % 50 AS query_id, id, 'kept' AS how FROM second WHERE \"row\" % 7 = 0 UNION ALL SELECT 100 + f.\"row\" % 50, f.id, 'mapped' FROM first f JOIN second s ON f.id = s.id WHERE f.\"row\" % 5 = 0 "
    "UNION ALL SELECT query_id, id, 'random' FROM others WHERE turn <= 8"
)
def feed_stale_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that askers hold of the current build, of the one before, and of one that is gone: kept, mapped, or random ones instead."""
    p = papers(spark, sf_dir).select("id", "year", "cited", "field", "topic", "venue", "seq")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(p, "id")
    path = shared_path(spark, "builds")
    old = sinks.write_index(search.build_index(rows.where("id % 13 <> 0")), path)
    reader = files.Reader(spark, path)
    now = sinks.write_index(search.build_index(rows.where("id % 11 <> 0")), path)
    reader.reload()
    held = lambda build, every, first: files.index_scan(spark, path, build).where(F.col("row") % every == 0).select((first + F.col("row") % 50).alias("query_id"), F.lit(build).alias("build"), "row")
    gone = spark.range(5).select((1000 + F.col("id")).alias("query_id"), F.lit("an older build").alias("build"), F.col("id").alias("row"))
    kept, stale = files.current_rows(reader, held(now, 7, 0).unionAll(held(old, 5, 100)).unionAll(gone))
    random = feed.walks(feed.ring(reader.rows(), "st", NARROW), stale, 8, "st").select("query_id", "id", F.lit("random").alias("how"))
    return kept.select("query_id", "id", "how").unionByName(random)
