"""Queries of text search, exploration and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.functions import text as X
from driftline.operators import explore, fts, ingest
from driftline.operators.embed import embedding_text
from driftline.plans.tables import INTERACTIONS_SQL, PAPERS_SQL, interactions, papers, table, texts
from driftline.sources import files
from driftline.sources.shared import exists, shared_path
from driftline.sources.sinks import article_json, sitemap
from driftline.sources.textindex import TextIndex

QUERIES, SQL = {}, {}
STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
TOKENS = "list_filter(" + WORDS + f", lambda w: w NOT IN ({STOPS}))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


POSTS_SQL = f"""{PAPERS_SQL}, tok AS (
  SELECT id, 'title' AS col, {TOKENS.format("title")} AS t FROM papers UNION ALL SELECT id, 'abstract', {TOKENS.format("abstract")} FROM papers
), posts AS (
  SELECT id, col, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tok)"""


_STORED: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The text index of all papers; built at the first query of a session, opened by the others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED or not exists(spark, _STORED[key]):
        path = shared_path(spark, "text")
        TextIndex(spark, path, columns=("title", "abstract")).sync(texts(spark, sf_dir), 0)
        _STORED[key] = path
    return TextIndex(spark, _STORED[key], columns=("title", "abstract"))


def and_sql(words: list[str], source: str = "posts") -> str:
    inside = ", ".join(f"'{w}'" for w in words)
    return f"SELECT id FROM {source} WHERE term IN ({inside}) GROUP BY id HAVING count(DISTINCT term) = {len(set(words))}"


def or_sql(words: list[str], source: str = "posts") -> str:
    return f"SELECT DISTINCT id FROM {source} WHERE term IN ({', '.join(repr(w) for w in words)})"


def phrase_sql(words: list[str], source: str = "posts") -> str:
    """(id, col, tf) of a phrase."""
    joins = " ".join(f"JOIN {source} p{i} ON p{i}.id = p0.id AND p{i}.col = p0.col AND p{i}.pos = p0.pos + {i} AND p{i}.term = '{w}'" for i, w in enumerate(words) if i)
    return f"SELECT p0.id, p0.col, count(*) AS tf FROM {source} p0 {joins} WHERE p0.term = '{words[0]}' GROUP BY p0.id, p0.col"


def bm25_sql(words: list[str], source: str = "posts", any_word: bool = False, weighted: bool = True) -> str:
    """(id, bm25), the published formula with the engine's constants."""
    match = or_sql(words, source) if any_word else and_sql(words, source)
    inside = ", ".join(f"'{w}'" for w in set(words))
    phrase = f" UNION ALL SELECT id, col, '#phrase' AS term, tf FROM ({phrase_sql(words, source)})" if len(words) > 1 and not any_word else ""
    weight = "CASE col WHEN 'title' THEN 10.0::DOUBLE WHEN 'authors' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END" if weighted else "1.0::DOUBLE"
    return f"""SELECT w.id, sum(greatest(1e-6, ln((docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE))) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average))) AS bm25 FROM (
    SELECT id, term, sum(tf * {weight}) AS f FROM (SELECT id, col, term, count(*) AS tf FROM {source} WHERE term IN ({inside}) GROUP BY id, col, term{phrase}) GROUP BY id, term) w
  JOIN (SELECT term, count(DISTINCT id) AS n FROM (SELECT id, term FROM {source} WHERE term IN ({inside}){phrase.replace("id, col, '#phrase' AS term, tf", "id, '#phrase'") }) GROUP BY term) s ON w.term = s.term
  JOIN (SELECT id, count(*) AS length FROM {source} GROUP BY id) l ON w.id = l.id
  CROSS JOIN (SELECT count(*) AS docs, avg(length) AS average FROM (SELECT id, count(*) AS length FROM {source} GROUP BY id)) c
  WHERE w.id IN ({match}) GROUP BY w.id"""


def search_sql(words: list[str], order: str = "score DESC, id", page: int = 1) -> str:
    low = (page - 1) * 20
    return f"""t AS ({bm25_sql(words, "titles", weighted=False)}), a AS ({bm25_sql(words)}), hits AS (
  SELECT id, bm25, 1 AS tier FROM t UNION ALL SELECT id, bm25, 2 FROM a WHERE id NOT IN (SELECT id FROM t)
), scored AS (
  SELECT h.id, tier, bm25 + 0.15::DOUBLE * ln(1 + cited) AS score, cited, year FROM hits h JOIN papers p ON h.id = p.id
) SELECT CAST(row_number() OVER (ORDER BY tier, {order}) AS INTEGER) AS place, id, CAST(tier AS INTEGER) AS tier, round(score, 5) AS score FROM scored ORDER BY tier, {order} LIMIT 20 OFFSET {low}"""


_TITLES = f"{POSTS_SQL}, titles AS (SELECT * FROM posts WHERE col = 'title')"


def _search(spark: SparkSession, sf_dir: str, q: str, sort: str = "", page: int = 1) -> DataFrame:
    return stored_index(spark, sf_dir).search(texts(spark, sf_dir), q, sort, page).select("place", "id", "tier", F.round("score", 5).alias("score"))


@query(f"WITH {PAPERS_SQL} SELECT id, {TOKENS.format('abstract')} AS tokens FROM papers")
def fts_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("id", X.index_tokens(F.col("abstract")).alias("tokens"))


@query(f"WITH {POSTS_SQL} {and_sql(['erst', 'thnt'])}")
def fts_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.matches(stored_index(spark, sf_dir).postings(), fts.Query.of(spark, "The Erst thnt"))


@query(f"WITH {POSTS_SQL}, m AS ({and_sql(['erst', 'nosuchword'])}) SELECT id FROM m UNION SELECT id FROM ({or_sql(['erst', 'nosuchword'])}) WHERE NOT EXISTS (SELECT 1 FROM m)")
def fts_or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts, q = stored_index(spark, sf_dir).postings(), fts.Query.of(spark, "erst nosuchword")
    found = fts.matches(posts, q)
    return found if found.limit(1).count() else fts.matches(posts, q, any_word=True)


@query(f"WITH {POSTS_SQL} {phrase_sql(['der', 'die'])}")
def fts_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.phrase_hits(stored_index(spark, sf_dir).postings(), ("der", "die"))


@query(f"WITH {POSTS_SQL} SELECT id, round(bm25, 5) AS bm25 FROM ({bm25_sql(['der', 'die'])})")
def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored_index(spark, sf_dir)
    return fts.bm25(index.postings(), fts.Query.of(spark, "der die"), sizes=index.sizes().of(False)).select("id", F.round("bm25", 5).alias("bm25"))


@query(f"WITH {_TITLES}, {search_sql(['der', 'im'])}")
def fts_two_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "der im")


@query(f"WITH {_TITLES}, {search_sql(['der'], 'cited DESC, id')}")
def fts_sort_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "der", "cited")


@query(f"WITH {_TITLES}, {search_sql(['der'], 'year DESC, cited DESC, id')}")
def fts_sort_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "der", "recent")


@query(f"WITH {_TITLES}, {search_sql(['der'], page=2)}")
def fts_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "der", page=2)


@query(f"WITH {POSTS_SQL}, n AS (SELECT count(*) AS n FROM ({or_sql(['ed', 'der', 'que', 'le', 'en'])})) SELECT CAST(least(n, 500) AS BIGINT) AS total, n > 500 AS capped FROM n")
def fts_count_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fts.matches(stored_index(spark, sf_dir).postings(), fts.Query.of(spark, "ed der que le en"), any_word=True)
    return fts.capped_count(found, 500).select(F.col("total").cast("long").alias("total"), "capped")


@query("""WITH w AS (SELECT doc_id, list_slice(list_filter(list_slice(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 1, 24), lambda w: w NOT IN (""" + STOPS + """)), 1, 12) AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) = 0 THEN '' WHEN len(w) = 1 THEN '"' || w[1] || '"' ELSE '("' || array_to_string(w, '" "') || '") OR "' || array_to_string(w, ' ') || '"' END AS expression FROM w""")
def fts_match_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.match_expression(F.col("text")).alias("expression"))


@query(f"WITH {PAPERS_SQL} SELECT venue AS name, count(*) AS n FROM papers WHERE venue <> '' GROUP BY venue ORDER BY n DESC, name LIMIT 20")
def facet_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.matching_options(explore.counts(papers(spark, sf_dir), "venue"), "")


@query(f"WITH {PAPERS_SQL} SELECT venue AS name, count(*) AS n FROM papers WHERE contains(lower(venue), 'c1') GROUP BY venue ORDER BY n DESC, name LIMIT 20")
def facet_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.matching_options(explore.counts(papers(spark, sf_dir), "venue"), " C1 ")


@query(f"WITH {PAPERS_SQL} SELECT 'T' || CAST(topic AS VARCHAR) AS topic_id, arg_min(title, seq) AS name, arg_min(field, seq) AS field, count(*) AS n FROM papers GROUP BY topic")
def facet_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir).withColumn("topic_id", F.concat(F.lit("T"), F.col("topic").cast("string"))).withColumn("topic", F.col("title"))
    return explore.topics(p)


@query(f"WITH {PAPERS_SQL} SELECT field AS name, count(*) AS n FROM papers WHERE field <> '' GROUP BY field UNION ALL SELECT '', count(*) FROM papers")
def explore_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.with_all(papers(spark, sf_dir))


def _lists_sql(size: int, where: str = "TRUE") -> str:
    return f"""lists AS (SELECT list, CAST(place AS INTEGER) AS place, id FROM (
  SELECT list, id, row_number() OVER (PARTITION BY list ORDER BY cited DESC, id) AS place FROM (
    SELECT id, cited, '' AS list FROM papers WHERE {where} UNION ALL SELECT id, cited, field FROM papers WHERE {where} AND field <> '')) WHERE place <= {size})"""


def _lists(spark: SparkSession, sf_dir: str, size: int, since: int | None = None) -> DataFrame:
    return explore.top_lists(papers(spark, sf_dir).withColumn("cited_by", F.col("cited")), size, since)


@query(f"WITH {PAPERS_SQL}, {_lists_sql(30)} SELECT list, place, id FROM lists")
def explore_top_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir, 30)


@query(f"WITH {PAPERS_SQL}, {_lists_sql(30, 'year >= 2023')} SELECT list, place, id FROM lists")
def explore_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lists(spark, sf_dir, 30, 2025 - explore.RECENT_YEARS)


@query(f"WITH {PAPERS_SQL}, {_lists_sql(480)} SELECT place, id, (SELECT max(place) FROM lists WHERE list = '') > 48 AS more FROM lists WHERE list = '' AND place BETWEEN 25 AND 48")
def explore_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.page_of(_lists(spark, sf_dir, explore.TOP), "", 2)


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(replace(html, '\n', ' '), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS cleaned FROM pages")
def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.clean(F.col("html")).alias("cleaned"))


@query(f"WITH {PAPERS_SQL}, k AS (SELECT id, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS key FROM papers) SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY key ORDER BY id) AS r FROM k) WHERE r = 1")
def title_key_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.new_papers(papers(spark, sf_dir)).select("id")


@query(f"WITH {PAPERS_SQL} SELECT id FROM papers WHERE id % 17 <> 0 AND (lang = '' OR lang = 'en') AND length(title) >= 8 AND (id % 5 = 0 OR length(abstract) >= 200) AND NOT regexp_matches(lower(title), '^(proceedings of|front matter|table of contents|index$|preface)')")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    return p.where(ingest.good(F.col("title"), F.col("abstract"), F.col("lang"), F.col("id") % 17 == 0, F.col("id") % 5 == 0)).select("id")


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, '\n', ' '), '<[^>]+>', '', 'g'), '[\s\x0B]+', ' ', 'g')) AS abstract FROM documents")
def abstract_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.rebuild_text(X.invert_text(F.col("text"))).alias("abstract"))


_TOPICS_SQL = """topics AS (SELECT 'T' || CAST(n_nationkey AS VARCHAR) AS topic_id, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_name END AS category FROM nation),
subs AS (SELECT CAST(r_regionkey AS VARCHAR) AS subfield_id, r_name AS category FROM region)"""
_CLASSIFIED = f"""{_TOPICS_SQL}, classified AS (
  SELECT d.doc_id, CASE WHEN t.topic_id IS NOT NULL THEN t.category ELSE coalesce(s.category, CASE WHEN d.source <> '' THEN d.source END, 'Other') END AS category, t.topic_id IS NOT NULL AND t.category IS NULL AS excluded
  FROM documents d LEFT JOIN topics t ON 'T' || CAST(d.doc_id % 40 AS VARCHAR) = t.topic_id LEFT JOIN subs s ON CAST(d.doc_id % 9 AS VARCHAR) = s.subfield_id)"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = table(spark, sf_dir, "nation").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("topic_id"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("category"))
    subs = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("subfield_id"), F.col("r_name").alias("category"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://t.example/T"), (F.col("doc_id") % 40).cast("string")).alias("topic_id"), (F.col("doc_id") % 9).cast("string").alias("subfield_id"), F.col("source").alias("field_name"))
    return ingest.classify(d, topics, subs).select("doc_id", "category", "excluded")


@query(f"WITH {_CLASSIFIED} SELECT doc_id, category, excluded FROM classified")
def taxonomy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir)


@query(
    f"WITH {_CLASSIFIED}, r AS (SELECT d.doc_id, d.doc_id % 11 = 0 AS was, CASE WHEN c.doc_id IS NULL THEN d.doc_id % 11 = 0 ELSE c.excluded AND d.doc_id % 6 <> 0 END AS now, CASE WHEN c.doc_id IS NULL THEN d.source ELSE coalesce(c.category, CASE WHEN d.doc_id % 6 = 0 THEN 'Other' ELSE '' END) END AS field FROM documents d LEFT JOIN (SELECT * FROM classified WHERE doc_id % 3 <> 0) c ON d.doc_id = c.doc_id) "
    "SELECT field, count(*) AS n, count(*) FILTER (WHERE now) AS excluded, count(*) FILTER (WHERE now AND NOT was) AS newly FROM r GROUP BY field"
)
def relabel_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("field"), (F.col("doc_id") % 11 == 0).alias("excluded"))
    new = _classified(spark, sf_dir).where("doc_id % 3 <> 0")
    r = ingest.relabel(d, new, d.where("doc_id % 6 = 0"), "doc_id")
    return r.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if("excluded").alias("excluded"), F.count_if(F.col("excluded") & ~F.col("was_excluded")).alias("newly"))


@query(f"WITH {INTERACTIONS_SQL} SELECT 'W' || CAST(event_id * 7 % 5000 AS VARCHAR) AS id, min(ts) AS ts FROM interactions WHERE kind = 'click' AND event_id * 7 % 5000 NOT IN (SELECT vec_id FROM embeddings) GROUP BY 1 ORDER BY ts, id LIMIT 200")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("W"), c.cast("string")).alias("id")
    log = interactions(spark, sf_dir).where("kind = 'click'").select(name(F.col("event_id") * 7 % 5000), "ts")
    return ingest.pending(log, table(spark, sf_dir, "embeddings").select(name(F.col("vec_id"))))


@query(f"WITH {PAPERS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'p' || CAST(id AS VARCHAR) WHEN id % 3 = 1 AND venue <> '' THEN venue WHEN id % 5 = 0 THEN 'doi' ELSE 'w/' || CAST(id AS VARCHAR) END AS link FROM papers")
def link_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("id").cast("string")
    one = lambda when, c: F.when(when, c).otherwise("")
    link = S.link(one(F.col("id") % 3 == 0, F.concat(F.lit("p"), text)), one(F.col("id") % 3 == 1, F.col("venue")), one(F.col("id") % 5 == 0, F.lit("doi")), F.concat(F.lit("w/"), text))
    return papers(spark, sf_dir).select("id", link.alias("link"))


@query(f"WITH {PAPERS_SQL} SELECT id, array_to_string(list_filter([lang || ', ' || field, venue, CASE WHEN id % 4 = 0 THEN '' ELSE CAST(year AS VARCHAR) END], lambda x: x <> ''), ' · ') AS byline FROM papers")
def byline(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("year"))
    return papers(spark, sf_dir).select("id", S.byline(F.array("lang", "field"), F.col("venue"), year).alias("byline"))


@query(
    f"WITH {PAPERS_SQL}, c AS (SELECT id, unnest(string_split(substr(abstract, 1, 301), '')) AS c, generate_subscripts(string_split(substr(abstract, 1, 301), ''), 1) AS i FROM papers WHERE strlen(abstract) > 300), "
    "e AS (SELECT *, sum(strlen(c)) OVER (PARTITION BY id ORDER BY i) AS z FROM c), k AS (SELECT id, greatest(coalesce(max(z) FILTER (WHERE c = ' ' AND z <= 300) - 1, 0), 200) AS cut FROM e GROUP BY id), "
    "h AS (SELECT e.id, coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE z <= cut), '') || CASE WHEN bool_or(z > cut AND z - strlen(c) < cut) THEN '\ufffd' ELSE '' END || '…' AS head FROM e JOIN k ON e.id = k.id GROUP BY e.id) "
    "SELECT p.id, coalesce(head, abstract) AS description FROM papers p LEFT JOIN h ON p.id = h.id"
)
def description_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("id", S.description(F.col("abstract")).alias("description"))


@query("SELECT (l_orderkey * 8 + l_linenumber) // 49999 AS chunk, count(*) AS n FROM lineitem GROUP BY 1")
def sitemap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"), F.col("l_orderkey").cast("string").alias("url"))
    return sitemap(rows).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PAPERS_SQL} SELECT id, title, CASE WHEN id % 2 = 0 THEN CAST(cited AS DOUBLE) END AS score, CASE WHEN id % 3 = 0 THEN 'explore' END AS reason FROM papers")
def rows_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses parsed again: zero scores and missing reasons are left out on the way."""
    from driftline.sources.sinks import paper_json

    score = F.when(F.col("id") % 2 == 0, F.col("cited").cast("double")).otherwise(0.0)
    j = papers(spark, sf_dir).select(paper_json(["id", "title"], score=score, reason=F.when(F.col("id") % 3 == 0, "explore")).alias("j"))
    return j.select(F.from_json("j", "id long, title string, score double, reason string").alias("r")).select("r.*")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id END AS parsed, CASE WHEN doc_id % 7 = 0 OR doc_id > 65535 THEN 0 ELSE CAST(doc_id AS INTEGER) END AS topic FROM documents")
def parse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("X"), n)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("https://w.example/W"), n)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("W"), n)).otherwise(n)
    t = F.when(F.col("doc_id") % 7 == 0, F.lit("Tx")).otherwise(F.concat(F.lit("https://t.example/T"), n))
    return table(spark, sf_dir, "documents").select("doc_id", S.parse_id(raw).alias("parsed"), S.topic_number(t).alias("topic"))


@query(f"WITH {PAPERS_SQL} SELECT id, coalesce(title, '') || ' [SEP] ' || coalesce(abstract, '') AS text FROM papers")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("id", embedding_text(F.col("title"), F.col("abstract")).alias("text"))


@query(
    f"WITH {PAPERS_SQL} SELECT id, title AS headline, CASE WHEN id % 4 = 0 THEN NULL ELSE CAST(year AS VARCHAR) END AS published, CASE WHEN venue <> '' THEN venue END AS journal, CASE WHEN field <> '' THEN field END AS about, "
    "CASE WHEN id % 3 = 0 THEN NULL ELSE 'Person ' || lang END AS author, id % 5 = 0 AS free FROM papers"
)
def paper_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema.org objects of papers, read again: keys without a value are not there."""
    p = papers(spark, sf_dir).withColumn("year", F.when(F.col("id") % 4 == 0, 0).otherwise(F.col("year"))).withColumn("authors", F.when(F.col("id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Person "), F.col("lang")))))
    p = p.withColumn("pdf_url", F.when(F.col("id") % 5 == 0, "pdf").otherwise("")).withColumn("doi", F.lit(""))
    j = p.select("id", article_json(F.lit("https://p.example"), F.lit("https://w.example")).alias("j"))
    read = j.select("id", F.from_json("j", "headline string, datePublished string, isPartOf struct<name string>, about string, author array<struct<name string>>, isAccessibleForFree boolean").alias("r"))
    return read.select("id", "r.headline", F.col("r.datePublished").alias("published"), F.col("r.isPartOf.name").alias("journal"), F.col("r.about").alias("about"), F.get("r.author", F.lit(0))["name"].alias("author"), F.col("r.isAccessibleForFree").alias("free"))


@query(
    f"WITH {INTERACTIONS_SQL}, ids AS (SELECT 'W' || CAST(event_id * 7 % 5000 AS VARCHAR) AS id, min(ts) AS ts FROM interactions WHERE kind = 'click' GROUP BY 1), tried AS (SELECT 'W' || CAST(event_id % 5000 AS VARCHAR) AS id FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-20 12:00:30' - INTERVAL 7 DAY) "
    "SELECT id, ts FROM ids WHERE id NOT IN (SELECT 'W' || CAST(vec_id AS VARCHAR) FROM embeddings) AND id NOT IN (SELECT id FROM tried) ORDER BY ts, id LIMIT 200"
)
def pending_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to look up: not stored, and not tried within the last seven days."""
    name = lambda c: F.concat(F.lit("W"), c.cast("string")).alias("id")
    log = interactions(spark, sf_dir).where("kind = 'click'").select(name(F.col("event_id") * 7 % 5000), "ts")
    tried = table(spark, sf_dir, "events").where("event_type = 'error'").select(name(F.col("event_id") % 5000), "ts")
    return ingest.pending(log, table(spark, sf_dir, "embeddings").select(name(F.col("vec_id"))), tried, F.expr("TIMESTAMP '2024-01-20 12:00:30'"))


@query(f"WITH {PAPERS_SQL} SELECT id, title, CAST(year AS INTEGER) AS year, '' AS field, CAST(0 AS BIGINT) AS cited_by, false AS excluded FROM papers")
def jsonl_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers written as JSON lines without some keys, read with defaults for them."""
    path = shared_path(spark, "papers-jsonl")
    papers(spark, sf_dir).select("id", "title", "year").write.json(path)
    return files.papers(spark, path).select("id", "title", "year", "field", "cited_by", "excluded")


# the stored text index


@query(f"WITH {_TITLES}, {search_sql(['der', 'im'])}")
def fts_unstored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same page as of the stored index, from papers tokenised for this one search."""
    p = texts(spark, sf_dir)
    found = fts.search(p, fts.postings(p, columns=("title", "abstract")), "der im")
    return found.select("place", "id", "tier", F.round("score", 5).alias("score"))


@query(f"WITH {_TITLES}, {search_sql(['der'], 'cited DESC, id', 2)}")
def fts_cited_page2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "der", "cited", 2)


_CHANGED = f"""{PAPERS_SQL}, changed AS (
  SELECT id, CASE WHEN id % 10 = 0 THEN 'erneuerter Titel der ' || CAST(id AS VARCHAR) ELSE title END AS title, abstract FROM papers WHERE NOT (id % 25 = 0 AND id % 10 = 0) AND id % 33 <> 1
), ctok AS (
  SELECT id, 'title' AS col, {TOKENS.format("title")} AS t FROM changed UNION ALL SELECT id, 'abstract', {TOKENS.format("abstract")} FROM changed
), cposts AS (SELECT id, col, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM ctok)"""


@query(f"WITH {_CHANGED} SELECT id, col, count(*) AS n, CAST(sum(pos * length(term)) AS BIGINT) AS weight FROM cposts GROUP BY id, col")
def fts_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings after changed titles, exclusions and deletions came in as segments, the changes twice, and all were merged."""
    p = texts(spark, sf_dir)
    index = TextIndex(spark, shared_path(spark, "text"), columns=("title", "abstract"))
    index.sync(p, 1)
    changed = p.where("id % 10 = 0").withColumn("title", F.concat(F.lit("erneuerter Titel der "), F.col("id").cast("string"))).withColumn("excluded", F.col("id") % 25 == 0)
    for _ in range(2):
        index.sync(changed, 2)
    index.delete(p.where("id % 33 = 1"), 3)
    index.optimize()
    return index.postings().groupBy("id", "col").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pos") * F.length("term")).alias("weight"))


@query(f"WITH {_CHANGED}, cp AS (SELECT id, title, abstract FROM changed), posts AS (SELECT * FROM cposts), titles AS (SELECT * FROM cposts WHERE col = 'title'), {search_sql(['erneuerter', 'der'])}")
def fts_after_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over segments that are not merged yet."""
    p = texts(spark, sf_dir)
    index = TextIndex(spark, shared_path(spark, "text"), columns=("title", "abstract"))
    index.sync(p, 1)
    index.sync(p.where("id % 10 = 0").withColumn("title", F.concat(F.lit("erneuerter Titel der "), F.col("id").cast("string"))).withColumn("excluded", F.col("id") % 25 == 0), 2)
    index.delete(p.where("id % 33 = 1"), 3)
    return index.search(p, "erneuerter der").select("place", "id", "tier", F.round("score", 5).alias("score"))


@query()
def fts_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search in which postings and query are stemmed and folded; DuckDB has no stemmer here, so tests compare with Python."""
    p = texts(spark, sf_dir)
    index = TextIndex(spark, shared_path(spark, "stems"), stemmed=True, columns=("title", "abstract"))
    index.sync(p, 0)
    return index.search(p, "Licenses released").select("place", "id", "tier", F.round("score", 5).alias("score"))


_AUTHORED = f"""{PAPERS_SQL}, atok AS (
  SELECT id, 'title' AS col, {TOKENS.format("title")} AS t FROM papers UNION ALL SELECT id, 'abstract', {TOKENS.format("abstract")} FROM papers UNION ALL SELECT id, 'authors', {WORDS.format("'Ann ' || venue || ' The ' || lang")} FROM papers
), posts AS (SELECT id, col, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM atok)"""


@query(f"WITH {_AUTHORED} SELECT id, round(bm25, 5) AS bm25 FROM ({bm25_sql(['ann', 'src3'])})")
def fts_bm25_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, authors and abstract with their weights; authors keep stop words."""
    p = texts(spark, sf_dir).withColumn("authors", F.array(F.concat(F.lit("Ann "), F.col("venue")), F.concat(F.lit("The "), F.col("lang"))))
    return fts.bm25(fts.postings(p), fts.Query.of(spark, "ann src3")).select("id", F.round("bm25", 5).alias("bm25"))
