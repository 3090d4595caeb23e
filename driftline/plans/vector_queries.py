"""Vector queries: quantisation, exact and clustered search, tastes, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import vectors as V
from driftline.operators import feed, search, taste
from driftline.operators.filters import EXCLUDE_LIMIT, Filter, count_matching
from driftline.sources import files, sinks
from driftline.sources.shared import shared_path, stored
from driftline.plans.tables import INDEX_SQL, INTERACTIONS_SQL, PAPERS_SQL, VECTORS_SQL, interactions, papers, queries_of, search_index, table, unit_vectors

QUERIES, SQL = {}, {}
FILTER = Filter(year_min=2005, year_max=2020, cited_min=500, fields=("field1", "field2"), topics=(10003, 10004, 10005))
FILTER_SQL = "(year >= 2005 AND year <> 0 AND year <= 2020 AND cited >= 500 AND (field IN ('field1', 'field2') OR topic IN (10003, 10004, 10005)))"
NARROW = Filter(year_min=2010, venues=("src1", "src2", "src3"))
NARROW_SQL = "(year >= 2010 AND venue IN ('src1', 'src2', 'src3'))"
DOT = "CAST(list_sum(list_transform(generate_series(1, len(i.q)), lambda k: i.q[k] * z.q[k])) AS BIGINT)"
FDOT = "list_sum(list_transform(generate_series(1, len(i.u)), lambda k: i.u[k] * z.u[k]))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def topk_sql(index: str, queries: str, k: int, where: str = "TRUE") -> str:
    """The k best (query_id, rank, id, dot, score) in order of dot * scale, then id."""
    return f"""SELECT query_id, CAST(rank AS INTEGER) AS rank, id, dot, round(score, 6) AS score FROM (
  SELECT z.id AS query_id, i.id AS id, {DOT} AS dot, {DOT} * i.scale * z.scale AS score,
         row_number() OVER (PARTITION BY z.id ORDER BY {DOT} * i.scale DESC, i.id) AS rank
  FROM {index} i, {queries} z WHERE {where}) WHERE rank <= {k}"""


def slim(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "dot", F.round("score", 6).alias("score"))


@query(f"WITH {VECTORS_SQL} SELECT id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS norm FROM vectors")
def vec_normalize_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit_vectors(spark, sf_dir)
    return u.select("id", F.round(V.dot(F.col("u"), F.col("u")), 6).alias("norm"))


@query(f"WITH {VECTORS_SQL} SELECT id, round(scale, 6) AS scale, CAST(list_sum(list_transform(q, lambda x: abs(x))) AS BIGINT) AS total FROM vectors")
def vec_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit_vectors(spark, sf_dir)
    total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + F.abs(x.cast("int")))
    return u.select("id", F.round("scale", 6).alias("scale"), total.alias("total"))


@query(f"WITH {VECTORS_SQL} SELECT id, round(list_max(list_transform(generate_series(1, len(u)), lambda k: abs(u[k] - q[k] * scale))) / scale, 4) AS worst FROM vectors")
def vec_dequant_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit_vectors(spark, sf_dir)
    apart = F.zip_with("u", V.dequantize(F.col("q"), F.col("scale")), lambda a, b: F.abs(a - b))
    return u.select("id", F.round(F.array_max(apart) / F.col("scale"), 4).alias("worst"))


@query(f"WITH {VECTORS_SQL}, one AS (SELECT * FROM vectors WHERE id = 7) {topk_sql('vectors', 'one', 10)}")
def knn_exact_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit_vectors(spark, sf_dir)
    return slim(search.exact_topk(u, u.where("id = 7").select(F.col("id").alias("query_id"), "q", "scale"), 10))


@query(f"WITH {VECTORS_SQL}, asked AS (SELECT * FROM vectors WHERE id % 100 = 0) {topk_sql('vectors', 'asked', 10)}")
def knn_exact_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit_vectors(spark, sf_dir)
    return slim(search.exact_topk(u, queries_of(u, 100), 10))


@query(
    f"WITH {VECTORS_SQL}, {INTERACTIONS_SQL}, asked AS (SELECT * FROM vectors WHERE id % 100 = 0), "
    "banned AS (SELECT DISTINCT user_id * 100 AS query_id, id FROM interactions WHERE kind = 'seen') "
    + topk_sql("vectors", "asked", 10, "NOT EXISTS (SELECT 1 FROM banned b WHERE b.query_id = z.id AND b.id = i.id)")
)
def knn_exclude_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit_vectors(spark, sf_dir)
    seen = interactions(spark, sf_dir).where("kind = 'seen'").select((F.col("user_id") * 100).alias("query_id"), "id")
    return slim(search.exact_topk(u, queries_of(u, 100), 10, exclude=seen))


@query(f"WITH {INDEX_SQL}, asked AS (SELECT * FROM idx WHERE id % 100 = 0) {topk_sql('idx', 'asked', 10, FILTER_SQL.replace('year', 'i.year').replace('cited', 'i.cited').replace('field IN', 'i.field IN').replace('topic', 'i.topic'))}")
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = search_index(spark, sf_dir)
    return slim(search.exact_topk(i, queries_of(i, 100), 10, FILTER))


_EACH = NARROW_SQL.replace("year", "i.year").replace("venue", "i.venue")


@query(f"WITH {INDEX_SQL}, asked AS (SELECT * FROM idx WHERE id % 100 = 0) {topk_sql('idx', 'asked', 10, f'(z.id % 200 <> 0 OR {_EACH})')}")
def knn_mixed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = search_index(spark, sf_dir)
    q = queries_of(i, 100)
    narrow = q.where("query_id % 200 = 0").select("query_id", F.lit(NARROW.year_min).alias("year_min"), F.array(*map(F.lit, NARROW.venues)).alias("venues"))
    return slim(search.mixed_topk(i, q, narrow, 10))


#: A filter of its own for every query: a bound of years, one of citations, and every third time a subject.
_OWN = "i.year >= 2000 + z.id // 50 % 20 AND i.cited >= z.id % 7 * 100 AND (z.id // 50 % 3 <> 0 OR i.field = 'field' || CAST(z.id // 50 % 5 AS VARCHAR) OR i.topic = 10000 + z.id % 37)"
_SEEN_BY = f"SELECT user_id * 100 AS query_id, id FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, id DESC) AS n FROM interactions WHERE kind = 'seen' GROUP BY user_id, id) WHERE n <= {EXCLUDE_LIMIT}"


@query(f"WITH {INDEX_SQL}, {INTERACTIONS_SQL}, banned AS ({_SEEN_BY}), asked AS (SELECT * FROM idx WHERE id % 50 = 0) {topk_sql('idx', 'asked', 10, _OWN + ' AND NOT EXISTS (SELECT 1 FROM banned b WHERE b.query_id = z.id AND b.id = i.id)')}")
def knn_own_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query has a filter and a list of seen papers of its own; one scan tests them all."""
    i = search_index(spark, sf_dir)
    q = queries_of(i, 50)
    n = F.floor(F.col("query_id") / 50)
    subject = n % 3 == 0
    own = q.select(
        "query_id",
        (2000 + n % 20).alias("year_min"),
        (F.col("query_id") % 7 * 100).alias("cited_min"),
        F.when(subject, F.array(F.concat(F.lit("field"), (n % 5).cast("string")))).alias("fields"),
        F.when(subject, F.array((10000 + F.col("query_id") % 37).cast("int"))).alias("topics"),
    )
    return slim(search.mixed_topk(i, q, own, 10, exclude=_seen(spark, sf_dir)))


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(spark, sf_dir).where("kind = 'seen'").select((F.col("user_id") * 100).alias("query_id"), "id", "ts")


CENTROIDS_SQL = """means AS (
  SELECT label AS cluster, k, avg(u[k]) AS x FROM vectors, (SELECT unnest(generate_series(1, 64)) AS k) GROUP BY label, k
), centres AS (
  SELECT cluster, list(x ORDER BY k) AS m FROM means GROUP BY cluster
), centroids AS (
  SELECT cluster, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS u FROM centres
)"""


@query(f"WITH {VECTORS_SQL}, {CENTROIDS_SQL} SELECT id, CAST(cluster AS INTEGER) AS cluster FROM (SELECT z.id, i.cluster, row_number() OVER (PARTITION BY z.id ORDER BY round({FDOT}, 12) DESC, i.cluster) AS r FROM centroids i, vectors z) WHERE r = 1")
def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit_vectors(spark, sf_dir)
    return search.assign(u, search.mean_centroids(u)).select("id", "cluster")


@query("WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), s AS (SELECT list(n ORDER BY n) AS s FROM n) SELECT s[1] AS least, s[len(s) // 2 + 1] AS median, s[len(s)] AS most FROM s")
def ivf_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cluster_sizes(table(spark, sf_dir, "embeddings").withColumn("cluster", F.col("label")))


_PROBES = f"""probes AS (
  SELECT id, cluster, r FROM (SELECT z.id, i.cluster, row_number() OVER (PARTITION BY z.id ORDER BY round({FDOT}, 12) DESC, i.cluster) AS r FROM centroids i, asked z))"""
_PROBED = "EXISTS (SELECT 1 FROM probes p WHERE p.id = z.id AND p.cluster = i.label AND p.r <= 3)"


def _clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    u = unit_vectors(spark, sf_dir).withColumn("cluster", F.col("label").cast("int"))
    return u, search.mean_centroids(u)


@query(f"WITH {VECTORS_SQL}, {CENTROIDS_SQL}, asked AS (SELECT * FROM vectors WHERE id % 100 = 0), {_PROBES} {topk_sql('vectors', 'asked', 10, _PROBED)}")
def ivf_probe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, c = _clustered(spark, sf_dir)
    return slim(search.ivf_topk(u, c, queries_of(u, 100), 10, 3))


@query(
    f"WITH {VECTORS_SQL}, {CENTROIDS_SQL}, asked AS (SELECT * FROM vectors WHERE id % 100 = 0), {_PROBES}, a AS ({topk_sql('vectors', 'asked', 10, _PROBED)}), e AS ({topk_sql('vectors', 'asked', 10)}) "
    "SELECT count(a.id) AS hits, count(*) AS truth, round(count(a.id) / CAST(count(*) AS DOUBLE), 6) AS recall FROM e LEFT JOIN a ON e.query_id = a.query_id AND e.id = a.id"
)
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, c = _clustered(spark, sf_dir)
    q = queries_of(u, 100)
    return search.recall(search.ivf_topk(u, c, q, 10, 3), search.exact_topk(u, q, 10)).select("hits", "truth", F.round("recall", 6).alias("recall"))


_WAVES = f"""per AS (
  SELECT p.id, p.cluster, p.r, coalesce(n, 0) AS n FROM probes p LEFT JOIN (SELECT cluster, count(*) AS n FROM idx WHERE {FILTER_SQL} GROUP BY cluster) e ON p.cluster = e.cluster
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY id ORDER BY r) AS so_far, least(10, 2 * (CASE WHEN r <= 2 THEN 1 WHEN r <= 6 THEN 3 ELSE 7 END)) AS until FROM per
), reach AS (
  SELECT id, CAST(coalesce(min(CASE WHEN so_far >= 10 THEN until END), 10) AS INTEGER) AS last FROM summed GROUP BY id)"""
_I = FILTER_SQL.replace("year", "i.year").replace("cited", "i.cited").replace("field IN", "i.field IN").replace("topic", "i.topic")


@query(
    f"WITH {INDEX_SQL}, {CENTROIDS_SQL}, asked AS (SELECT * FROM idx WHERE id % 100 = 0), {_PROBES}, {_WAVES} "
    + topk_sql("idx", "asked", 10, f"{_I} AND EXISTS (SELECT 1 FROM summed p JOIN reach t ON p.id = t.id WHERE p.id = z.id AND p.cluster = i.cluster AND p.r <= t.last)")
)
def ivf_filtered_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = search_index(spark, sf_dir)
    return slim(search.filtered_topk(i, search.mean_centroids(unit_vectors(spark, sf_dir)), queries_of(i, 100), FILTER, 10, 2))


@query(f"WITH {VECTORS_SQL}, asked AS (SELECT * FROM vectors WHERE id % 100 = 0) {topk_sql('vectors', 'asked', 5, 'i.id <> z.id')}")
def more_like_this(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit_vectors(spark, sf_dir)
    q = queries_of(u, 100)
    return slim(search.exact_topk(u, q, 5, exclude=q.select("query_id", F.col("query_id").alias("id"))))


_LINKS = "links AS (SELECT vec_id AS query_id, unnest([vec_id + 1, vec_id + 2, vec_id + 1, vec_id + 100000]) AS linked FROM embeddings WHERE vec_id % 100 = 0)"


@query(f"WITH {VECTORS_SQL}, {_LINKS} SELECT query_id, count(*) AS basis, CAST(k - 1 AS INTEGER) AS i, round(sum(q[k] * scale), 6) AS x FROM links JOIN vectors v ON linked = v.id, (SELECT unnest(generate_series(1, 64)) AS k) GROUP BY query_id, k")
def seed_from_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit_vectors(spark, sf_dir)
    links = u.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2, F.col("id") + 1, F.col("id") + 100000)).alias("linked"))
    return search.seed_vector(links, u).select("query_id", "basis", "i", F.round("x", 6).alias("x"))


_TASTE = f"""{VECTORS_SQL}, {INTERACTIONS_SQL}, firsts AS (
  SELECT user_id, id, min(ts) AS ts FROM interactions WHERE kind = 'like' GROUP BY user_id, id
), numbered AS (
  SELECT f.user_id, v.u, row_number() OVER (PARTITION BY user_id ORDER BY ts, f.id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM firsts f JOIN vectors v ON f.id = v.id
), tastes AS (
  SELECT user_id, n, k, sum(u[k] * (CASE WHEN i = 1 THEN pow(2.0::DOUBLE, 1 - n) ELSE pow(2.0::DOUBLE, i - n - 1) END)) AS x
  FROM numbered, (SELECT unnest(generate_series(1, 64)) AS k) GROUP BY user_id, n, k)"""


def _tastes(spark: SparkSession, sf_dir: str) -> DataFrame:
    likes = interactions(spark, sf_dir).where("kind = 'like'").select("user_id", "ts", "id")
    return taste.taste_arrays(likes, unit_vectors(spark, sf_dir).select("id", F.col("u").alias("v")))


@query(f"WITH {_TASTE} SELECT user_id, n, CAST(k - 1 AS INTEGER) AS i, round(x, 6) AS x FROM tastes")
def taste_vector_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tastes(spark, sf_dir).select("user_id", "n", F.posexplode("v").alias("i", "x")).select("user_id", "n", "i", F.round("x", 6).alias("x"))


_OPENED = "NOT EXISTS (SELECT 1 FROM interactions o WHERE o.kind = 'click' AND o.user_id = i.user_id AND o.id = i.id)"
_UNLIKED = _TASTE.replace("FROM interactions WHERE kind = 'like'", f"FROM interactions i WHERE kind = 'like' AND {_OPENED}")


@query(f"WITH {_UNLIKED} SELECT user_id, n, CAST(k - 1 AS INTEGER) AS i, round(x, 6) AS x FROM tastes")
def taste_after_unlikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tastes without the likes that were taken back; here a click on a paper takes its like back."""
    all = interactions(spark, sf_dir)
    likes, back = (all.where(F.col("kind") == k).select("user_id", "ts", "id") for k in ("like", "click"))
    vectors = unit_vectors(spark, sf_dir).select("id", F.col("u").alias("v"))
    return taste.taste_vectors(likes, vectors, unlikes=back).select("user_id", "n", "i", F.round("x", 6).alias("x"))


_TASTE_Q = """vecs AS (
  SELECT user_id AS id, list(x ORDER BY k) AS t FROM tastes GROUP BY user_id
), tu AS (
  SELECT id, list_transform(t, lambda x: x / sqrt(list_sum(list_transform(t, lambda y: y * y)))) AS u FROM vecs
), ts AS (
  SELECT id, u, list_max(list_transform(u, lambda x: abs(x))) / 127.0::DOUBLE AS scale FROM tu
), tq AS (
  SELECT id, scale, list_transform(u, lambda x: CAST(round(x / scale) AS INTEGER)) AS q FROM ts)"""


@query(f"WITH {_TASTE}, {_TASTE_Q} {topk_sql('vectors', 'tq', 5)}")
def taste_closest5(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tastes(spark, sf_dir).select(F.col("user_id").alias("query_id"), V.normalize(F.col("v")).alias("u"))
    q = t.select("query_id", V.scale_of(F.col("u")).alias("scale"), V.quantize(F.col("u")).alias("q"))
    return slim(search.exact_topk(unit_vectors(spark, sf_dir), q, 5))


@query(
    f"WITH {_TASTE}, vecs AS (SELECT user_id, list(abs(x) ORDER BY abs(x)) AS a FROM tastes GROUP BY user_id), t AS (SELECT user_id, a, coalesce(CASE WHEN a[CAST(floor(0.98 * len(a)) AS INTEGER) + 1] > 0 THEN a[CAST(floor(0.98 * len(a)) AS INTEGER) + 1] END, CASE WHEN list_max(a) > 0 THEN list_max(a) END, 1.0) AS top FROM vecs) "
    "SELECT user_id, round(top, 6) AS top, CAST(len(list_filter(a, lambda x: x > top)) AS INTEGER) AS clipped FROM t"
)
def taste_heat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tastes(spark, sf_dir)
    return t.select("user_id", F.round(V.heat_limit(F.col("v")), 6).alias("top"), V.clipped(F.col("v")).alias("clipped"))


@query(f'WITH {PAPERS_SQL} SELECT count(*) FILTER (WHERE {FILTER_SQL}) AS "count", count(*) AS total FROM papers')
def filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_matching(papers(spark, sf_dir), FILTER)


FNV_SQL = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(generate_series(1, CAST(length({0}) AS BIGINT)), lambda k: CAST(ascii(substr({0}, CAST(k AS INTEGER), 1)) AS BIGINT))), lambda h, b: CAST((xor(h, b) * 16777619) % 4294967296 AS BIGINT))"
U_SQL = _U = lambda s: f"(({FNV_SQL.format(s)} + 0.5) / 4294967296.0::DOUBLE)"


@query(f"SELECT DISTINCT source AS s, {FNV_SQL.format('source')} AS h FROM documents WHERE source <> ''")
def fnv_hash32(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.functions.scalars import fnv32

    return table(spark, sf_dir, "documents").where("source <> ''").select(F.col("source").alias("s")).distinct().select("s", fnv32(F.col("s")).alias("h"))


_HITS = f"hits AS (SELECT query_id, id, dot / 16129.0::DOUBLE AS score, rank FROM ({topk_sql('vectors', 'asked', 100)}))"


def _hits(u: DataFrame, every: int = 100) -> DataFrame:
    h = search.exact_topk(u, queries_of(u, every), feed.CANDIDATES)
    return h.select("query_id", "id", (F.col("dot") / 16129.0).alias("score"), "rank")


@query(
    f"WITH {VECTORS_SQL}, asked AS (SELECT * FROM vectors WHERE id % 100 = 0), {_HITS}, named AS (SELECT *, CAST(id AS VARCHAR) || '|' || CAST(query_id AS VARCHAR) || '|s1' AS name, max(score) OVER (PARTITION BY query_id) AS best FROM hits), "
    f"keyed AS (SELECT query_id, id, ln({_U('name')}) / exp((score - best) / 0.05::DOUBLE) AS key FROM named) "
    "SELECT query_id, CAST(slot AS INTEGER) AS slot, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY key DESC, id) AS slot FROM keyed) WHERE slot <= 8"
)
def feed_softmax_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.sample(_hits(unit_vectors(spark, sf_dir)), 8, "s1").select("query_id", F.col("slot").cast("int").alias("slot"), "id")


@query(
    f"WITH {PAPERS_SQL}, u AS (SELECT id, {_U('name')} AS u FROM (SELECT id, CAST(id AS VARCHAR) || '|pick' AS name FROM papers WHERE {NARROW_SQL})) SELECT id, CAST(row_number() OVER (ORDER BY u, id) AS INTEGER) AS place FROM u ORDER BY u, id LIMIT 20"
)
def random_pick_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.random_rows(papers(spark, sf_dir), 20, "pick", NARROW).select("id", F.col("place").cast("int").alias("place"))


@query(
    f"WITH {INDEX_SQL}, asked AS (SELECT * FROM idx WHERE id = 100), hits AS (SELECT query_id, id, dot / 16129.0::DOUBLE AS score FROM ({topk_sql('idx', 'asked', 100, _EACH)})), "
    "named AS (SELECT *, CAST(id AS VARCHAR) || '|' || CAST(query_id AS VARCHAR) || '|s4' AS name, max(score) OVER () AS best, count(*) OVER () AS n FROM hits), "
    f"keyed AS (SELECT id, score, CASE WHEN n <= 8 THEN score ELSE ln({_U('name')}) / exp((score - best) / 0.05::DOUBLE) END AS key FROM named), "
    "picked AS (SELECT id, score, row_number() OVER (ORDER BY key DESC, id) AS slot FROM keyed), kept AS (SELECT *, 's4|x|' || CAST(slot AS VARCHAR) AS sname FROM picked WHERE slot <= 8), "
    f"swaps AS (SELECT id, score, slot, {_U('sname')} < 0.15 AS swap FROM kept), turns AS (SELECT *, CASE WHEN swap THEN sum(CASE WHEN swap THEN 1 ELSE 0 END) OVER (ORDER BY slot) END AS turn FROM swaps), "
    f"free AS (SELECT id, CAST(id AS VARCHAR) || '|s4' AS name FROM idx WHERE {NARROW_SQL} AND id NOT IN (SELECT id FROM kept)), pool AS (SELECT id, row_number() OVER (ORDER BY {_U('name')}, id) AS turn FROM free), "
    "c AS (SELECT count(*) FILTER (WHERE swap) AS used, count(*) AS have FROM swaps) "
    "SELECT CAST(t.slot AS INTEGER) AS slot, coalesce(p.id, t.id) AS id, CASE WHEN p.id IS NULL THEN 'for-you' ELSE 'explore' END AS reason FROM turns t LEFT JOIN pool p ON t.turn = p.turn "
    "UNION ALL SELECT CAST(have + turn - used AS INTEGER), id, 'random' FROM pool, c WHERE turn > used AND turn <= used + 8 - have AND turn <= 16"
)
def feed_explore_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = search_index(spark, sf_dir)
    h = search.exact_topk(i, i.where("id = 100").select(F.col("id").alias("query_id"), "q", "scale"), feed.CANDIDATES, NARROW)
    return feed.next_feed(h.select("query_id", "id", (F.col("dot") / 16129.0).alias("score")), i, 8, "s4", NARROW).select(F.col("slot").cast("int").alias("slot"), "id", "reason")


#: The ring of rows that match, each asker's place on it, and the rows on from there that they have neither seen nor picked.
_RING = f"""ring AS (
  SELECT id, row_number() OVER (ORDER BY {_U('name')}, id) - 1 AS place FROM (SELECT id, CAST(id AS VARCHAR) || '|b' AS name FROM idx WHERE {NARROW_SQL})
), starts AS (
  SELECT query_id, CAST(floor({_U('name')} * (SELECT count(*) FROM ring)) AS BIGINT) AS first FROM (SELECT id AS query_id, CAST(id AS VARCHAR) || '|b|at' AS name FROM asked)
), others AS (
  SELECT query_id, r.id, row_number() OVER (PARTITION BY query_id ORDER BY (r.place - first + (SELECT count(*) FROM ring)) % (SELECT count(*) FROM ring)) AS turn
  FROM starts s, ring r WHERE NOT EXISTS (SELECT 1 FROM skipped k WHERE k.query_id = s.query_id AND k.id = r.id))"""


@query(
    f"WITH {INDEX_SQL}, {INTERACTIONS_SQL}, asked AS (SELECT * FROM idx WHERE id % 100 = 0), banned AS ({_SEEN_BY}), "
    f"hits AS (SELECT query_id, id, dot / 16129.0::DOUBLE AS score FROM ({topk_sql('idx', 'asked', 100, _EACH + ' AND NOT EXISTS (SELECT 1 FROM banned b WHERE b.query_id = z.id AND b.id = i.id)')})), "
    "named AS (SELECT *, CAST(id AS VARCHAR) || '|' || CAST(query_id AS VARCHAR) || '|b' AS name, max(score) OVER (PARTITION BY query_id) AS best, count(*) OVER (PARTITION BY query_id) AS n FROM hits), "
    f"keyed AS (SELECT query_id, id, CASE WHEN n <= 8 THEN score ELSE ln({_U('name')}) / exp((score - best) / 0.05::DOUBLE) END AS key FROM named), "
    "picked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY key DESC, id) AS slot FROM keyed), kept AS (SELECT *, 'b|' || CAST(query_id AS VARCHAR) || '|x|' || CAST(slot AS VARCHAR) AS sname FROM picked WHERE slot <= 8), "
    f"swaps AS (SELECT query_id, id, slot, {_U('sname')} < 0.15 AS swap FROM kept), turns AS (SELECT *, CASE WHEN swap THEN sum(CASE WHEN swap THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY slot) END AS turn FROM swaps), "
    f"skipped AS (SELECT query_id, id FROM kept UNION SELECT query_id, id FROM banned), {_RING}, "
    "c AS (SELECT a.id AS query_id, coalesce(used, 0) AS used, coalesce(have, 0) AS have FROM asked a LEFT JOIN (SELECT query_id, count(*) FILTER (WHERE swap) AS used, count(*) AS have FROM swaps GROUP BY query_id) s ON a.id = s.query_id) "
    "SELECT t.query_id, CAST(t.slot AS INTEGER) AS slot, coalesce(p.id, t.id) AS id, CASE WHEN p.id IS NULL THEN 'for-you' ELSE 'explore' END AS reason FROM turns t LEFT JOIN others p ON t.query_id = p.query_id AND t.turn = p.turn AND p.turn <= 8 "
    "UNION ALL SELECT o.query_id, CAST(have + turn - used AS INTEGER), id, 'random' FROM others o JOIN c ON o.query_id = c.query_id WHERE turn > used AND turn <= used + 8 - have AND turn <= 8"
)
def feed_explore_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of many users at once: seen papers are left out, some picks are swapped for rows on from the user's place, and short feeds are topped up."""
    i = search_index(spark, sf_dir)
    q, seen = queries_of(i, 100), _seen(spark, sf_dir)
    h = search.exact_topk(i, q, feed.CANDIDATES, NARROW, exclude=seen)
    feeds = feed.next_feeds(h.select("query_id", "id", (F.col("dot") / 16129.0).alias("score")), feed.ring(i, "b", NARROW), q, 8, "b", seen)
    return feeds.select("query_id", F.col("slot").cast("int").alias("slot"), "id", "reason")


@query(
    f"WITH {INDEX_SQL}, {INTERACTIONS_SQL}, asked AS (SELECT * FROM idx WHERE id % 20 = 0), skipped AS (SELECT user_id * 20 AS query_id, id FROM interactions WHERE kind IN ('seen', 'like')), {_RING} "
    "SELECT query_id, CAST(turn AS INTEGER) AS turn, id FROM others WHERE turn <= 20"
)
def random_pick_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random rows for many users, each their own, without what they have seen or liked."""
    i = search_index(spark, sf_dir)
    met = interactions(spark, sf_dir).where("kind in ('seen', 'like')").select((F.col("user_id") * 20).alias("query_id"), "id")
    return feed.walks(feed.ring(i, "b", NARROW), queries_of(i, 20), 20, "b", met).select("query_id", "turn", "id")


@query(
    f"WITH {VECTORS_SQL}, {CENTROIDS_SQL}, asked AS (SELECT * FROM vectors WHERE id % 20 = 0), {_PROBES}, a AS ({topk_sql('vectors', 'asked', 10, _PROBED)}), e AS ({topk_sql('vectors', 'asked', 10)}), "
    "h AS (SELECT count(a.id) AS hits, count(*) AS truth FROM e LEFT JOIN a ON e.query_id = a.query_id AND e.id = a.id), "
    "m AS (SELECT avg(x.s / y.s) AS similarity FROM (SELECT query_id, avg(score) AS s FROM a GROUP BY query_id) x JOIN (SELECT query_id, avg(score) AS s FROM e GROUP BY query_id) y ON x.query_id = y.query_id) "
    "SELECT 3 AS nprobe, round(hits / CAST(truth AS DOUBLE), 6) AS recall, round(similarity, 4) AS similarity, round(3 / CAST((SELECT count(DISTINCT label) FROM embeddings) AS DOUBLE), 6) AS scanned FROM h, m"
)
def ivf_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, c = _clustered(spark, sf_dir)
    r = search.evaluate(u, c, queries_of(u, 20), 10, (3,))
    return r.select("nprobe", F.round("recall", 6).alias("recall"), F.round("similarity", 4).alias("similarity"), F.round("scanned", 6).alias("scanned"))


def _kmeans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An index laid out by the clusters of k-means, written and opened again, and its centroids."""
    u = unit_vectors(spark, sf_dir).drop("row")
    c = stored(search.kmeans(u, 16), "centroids")
    p = papers(spark, sf_dir).select("id", "year", "cited", "field", "topic", "venue", "seq")
    path = shared_path(spark, "index")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(p, "id")
    sinks.write_index(search.build_index(rows, c), path)
    return files.index_scan(spark, path), c


@query()
def ivf_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster, n, mean): clusters of k-means over all vectors, their sizes and their rows' mean product with the centroid."""
    u = unit_vectors(spark, sf_dir)
    c = stored(search.kmeans(u, 16), "centroids")
    return search.assign(u, c).join(F.broadcast(c), "cluster").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg(V.dot(F.col("u"), F.col("c"))).alias("mean"))


@query(f"WITH {INDEX_SQL}, asked AS (SELECT * FROM idx WHERE id % 100 = 0) {topk_sql('idx', 'asked', 10)}")
def ivf_all_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every cluster probed, the stored index gives what an exact search gives; rows of equal scores are in order of id there."""
    i, c = _kmeans(spark, sf_dir)
    q = i.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.transform("q", lambda x: x * F.col("scale")).alias("u"), "q", "scale")
    probes = search.rank_clusters(q, c)
    return slim(search.exact_topk(i.withColumn("row", F.col("id")), q, 10, probes=probes))


@query(f"WITH {_TASTE} SELECT user_id, CAST(k - 1 AS INTEGER) AS i, round(x, 6) AS x FROM tastes")
def taste_fold_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older likes folded into a base, the newest 64 kept apart: the same vectors as of all likes."""
    likes = interactions(spark, sf_dir).where("kind = 'like'").select("user_id", "ts", "id")
    state = taste.folded_state(likes, unit_vectors(spark, sf_dir).select("id", F.col("u").alias("v")))
    return taste.unfolded(state).select("user_id", F.posexplode("v").alias("i", "x")).select("user_id", "i", F.round("x", 6).alias("x"))


@query(f"WITH {PAPERS_SQL}, n AS (SELECT count(*) AS total, count(*) FILTER (WHERE {NARROW_SQL}) AS n FROM papers), u AS (SELECT id, {_U('name')} AS u FROM (SELECT id, CAST(id AS VARCHAR) || '|pool' AS name FROM papers WHERE {NARROW_SQL})) SELECT id, CAST(row_number() OVER (ORDER BY u, id) AS INTEGER) AS place, n * 16 <= total AS held FROM u, n ORDER BY u, id LIMIT 20")
def pool_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random rows from a filter's pool, where it is small enough to be held."""
    p = papers(spark, sf_dir)
    held = feed.pool(p, NARROW)
    return feed.random_rows(p, 20, "pool", NARROW, held=held).select("id", F.col("place").cast("int").alias("place"), F.lit(held is not None).alias("held"))


@query("SELECT CAST(vec_id AS BIGINT) AS id, CAST(round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS DOUBLE) AS total, CAST(1 AS BIGINT) AS times FROM embeddings")
def append_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings appended in two runs, the second over all: each is there once."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    path = shared_path(spark, "vectors")
    for part in (e.where("id % 2 = 0"), e, e):
        sinks.append_missing(part, path)
    total = F.aggregate(V.doubles(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return spark.read.parquet(path).groupBy("id").agg(F.round(F.first(total), 6).alias("total"), F.count(F.lit(1)).alias("times"))
