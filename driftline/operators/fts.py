"""Full-text search: postings, matching, BM25, phrases, and title-first ranking.

Postings are a table (id, col, term, pos); a query is a few terms, so every search is an
equality filter on ``term`` (pushed to the scan), a join with document lengths, and sums by id.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import text as X
from driftline.operators.filters import valid_query_text

#: Weights of the columns, BM25's constants, weight of ln(1 + citations); fixed values.
WEIGHTS = {"title": 10.0, "authors": 3.0, "abstract": 1.0}
K1, B, POPULARITY = 1.2, 0.75, 0.15
PAGE, LAST_PAGE, COUNT_CAP = 20, 50, 1000


def postings(papers: DataFrame, id: str = "id", columns: tuple[str, ...] = ("title", "authors", "abstract"), stemmed: bool = False) -> DataFrame:
    """(id, col, term, pos) of all tokens; authors keep stop words; ``stemmed`` folds and stems them; excluded papers have none."""
    out = None
    if "excluded" in papers.columns:
        papers = papers.where(~F.coalesce(F.col("excluded"), F.lit(False)))
    for c in columns:
        kind = dict(papers.dtypes).get(c)
        if kind is None:
            continue
        source = F.array_join(F.col(c), " ") if kind.startswith("array") else F.col(c)
        tokens = X.index_tokens(source, stop=c != "authors")
        part = papers.select(F.col(id).cast("long").alias("id"), F.lit(c).alias("col"), F.posexplode(X.stems(tokens) if stemmed else tokens).alias("pos", "term"))
        out = part if out is None else out.unionAll(part)
    return out.select("id", "col", "term", "pos")


def lengths(posts: DataFrame) -> DataFrame:
    """(id, length) over all columns."""
    return posts.groupBy("id").agg(F.count(F.lit(1)).alias("length"))


@dataclass(frozen=True)
class Sizes:
    """Stored (id, length, title_length), and (documents, tokens) of all columns and of titles."""

    documents: DataFrame
    all: tuple[int, int]
    titles: tuple[int, int]

    def of(self, title: bool) -> tuple[DataFrame, float, float]:
        """(id, length) of documents that have tokens, their number, and their average length."""
        n, total = self.titles if title else self.all
        size = self.documents.select("id", F.col("title_length" if title else "length").alias("length"))
        return size.where("length > 0"), float(n), total / n if n else 0.0


@dataclass(frozen=True)
class Query:
    """The words of a query, and its phrase if there are two or more."""

    words: tuple[str, ...]

    @classmethod
    def of(cls, spark, q: str, stemmed: bool = False) -> Query:
        """Words by the same expressions that tokenise documents."""
        if stemmed:
            got = spark.range(1).select(X.stems(X.query_words(F.lit(q))).alias("w")).first()["w"]
        else:
            got = spark.range(1).select(X.query_words(F.lit(q)).alias("w")).first()["w"]
        return cls(tuple(got))

    @property
    def terms(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.words))


def matches(posts: DataFrame, query: Query, any_word: bool = False) -> DataFrame:
    """(id): documents with every word in some column, or with ``any_word`` any word."""
    found = posts.where(F.col("term").isin(*query.terms))
    if any_word or len(query.terms) < 2:
        return found.select("id").distinct()
    return found.groupBy("id").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(query.terms)).select("id")


def phrase_hits(posts: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(id, col, tf): how often the words stand in a row within a column."""
    found = posts.where(F.col("term").isin(*dict.fromkeys(words)))
    starts = found.select("id", "col", F.explode(F.array(*[F.when(F.col("term") == w, F.struct((F.col("pos") - i).alias("at"), F.lit(i).alias("i"))) for i, w in enumerate(words)])).alias("s")).where("s is not null")
    whole = starts.groupBy("id", "col", "s.at").agg(F.count_distinct("s.i").alias("n")).where(F.col("n") == len(words))
    return whole.groupBy("id", "col").agg(F.count(F.lit(1)).alias("tf"))


def bm25(posts: DataFrame, query: Query, any_word: bool = False, weights: dict[str, float] | None = None, sizes: tuple[DataFrame, float, float] | None = None) -> DataFrame:
    """(id, bm25) of matching documents, higher is better.

    Sum over words, and the phrase where every word must match, of idf * f * (k1 + 1) / (f + k1 * (1 - b +
    b * length / average)), f being the tf weighted by column; idf = ln((N - n + 0.5) / (n + 0.5)), 1e-6 at least.
    ``sizes`` has lengths, N and average if they are stored; else they are counted.
    """
    weights = weights or WEIGHTS
    weight = F.lit(1.0)
    for c, w in weights.items():
        weight = F.when(F.col("col") == c, F.lit(w)).otherwise(weight)
    if sizes:
        size, corpus = sizes[0], posts.sparkSession.range(1).select(F.lit(sizes[1]).alias("docs"), F.lit(sizes[2]).alias("average"))
    else:
        size = lengths(posts)
        corpus = size.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("average"))
    tf = posts.where(F.col("term").isin(*query.terms)).groupBy("id", "col", "term").agg(F.count(F.lit(1)).alias("tf"))
    if len(query.words) > 1 and not any_word:
        tf = tf.unionByName(phrase_hits(posts, query.words).withColumn("term", F.lit("\0phrase")))
    weighted = tf.groupBy("id", "term").agg(F.sum(F.col("tf") * weight).alias("f"))
    seen = weighted.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    kept = weighted.join(matches(posts, query, any_word), "id", "left_semi")
    # a row for each word of the query, and one for the corpus
    scored = kept.join(F.broadcast(seen), "term").join(size, "id").crossJoin(F.broadcast(corpus))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    # added up in the order of the query: in any other, papers of the same text could differ in the last bit and lose their order by id
    terms = [*query.terms, "\0phrase"]
    parts = scored.groupBy("id").agg(*[F.sum(F.when(F.col("term") == t, part)).alias(f"_{i}") for i, t in enumerate(terms)])
    return parts.select("id", sum((F.coalesce(f"_{i}", F.lit(0.0)) for i in range(len(terms))), F.lit(0.0)).alias("bm25"))


def order_key(sort: str) -> list[Column]:
    """Order within a tier; unknown sorts are by relevance; the id settles ties."""
    return {
        "cited": [F.desc("cited"), F.asc("id")],
        "recent": [F.desc("year"), F.desc("cited"), F.asc("id")],
    }.get(sort, [F.desc("score"), F.asc("id")])


def capped_count(rows: DataFrame, cap: int = COUNT_CAP) -> DataFrame:
    """(total, capped): counting stops after cap + 1 rows."""
    return rows.limit(cap + 1).agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("total"), (F.count(F.lit(1)) > cap).alias("capped"))


def search(papers: DataFrame, posts: DataFrame, q: str, sort: str = "", page: int = 1, title_cap: int = COUNT_CAP, stemmed: bool = False, sizes: Sizes | None = None) -> DataFrame:
    """(place, id, tier, score): a page of results, title matches first, each tier in its own order.

    Any word will do only where no document has all.  With more than ``title_cap`` title
    matches there is no second tier.  ``papers`` has id, cited and year; papers that are not in
    it are left out, as the postings may be ahead of the index.  ``stemmed`` must be as the
    postings are.  A query of no words, or of none or over 200 bytes, finds nothing.
    """
    spark = papers.sparkSession
    query, page = Query.of(spark, q if valid_query_text(q) else "", stemmed), max(1, min(LAST_PAGE, page))
    empty = spark.createDataFrame([], "place int, id long, tier int, score double")
    if not query.words:
        return empty
    any_word = matches(posts, query).limit(1).count() == 0
    titles = posts.where(F.col("col") == "title")
    in_title = bm25(titles, query, any_word, {"title": 1.0}, sizes.of(True) if sizes else None).withColumn("tier", F.lit(1))
    rest = bm25(posts, query, any_word, sizes=sizes.of(False) if sizes else None).join(in_title.select("id"), "id", "left_anti").withColumn("tier", F.lit(2))
    titled = matches(titles, query, any_word).limit(title_cap + 1).count()
    hits = in_title if titled > title_cap else in_title.unionByName(rest)
    scored = hits.join(papers.select("id", "cited", "year"), "id").withColumn("score", F.col("bm25") + POPULARITY * F.log1p("cited"))
    low = (page - 1) * PAGE
    best = scored.orderBy("tier", *order_key(sort)).limit(low + PAGE)
    placed = best.withColumn("place", F.row_number().over(Window.orderBy("tier", *order_key(sort))))  # at most LAST_PAGE * PAGE rows
    return placed.where(F.col("place") > low).select("place", "id", "tier", "score")


class TtlCache:
    """Results by key for ``seconds``; beyond ``most`` of them all go.  ``clock`` gives the time."""

    def __init__(self, seconds: float = 300, most: int = 2000, clock=time.monotonic):
        self.seconds, self.most, self.clock, self.held = seconds, most, clock, {}

    def get(self, key, make):
        """What ``key`` has, or what ``make()`` gives now; errors are not kept."""
        now = self.clock()
        if key in self.held and now - self.held[key][0] < self.seconds:
            return self.held[key][1]
        value = make()
        if len(self.held) >= self.most:
            self.held.clear()
        self.held[key] = (now, value)
        return value
