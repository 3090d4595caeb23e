"""Ingest: quality filter, conversion of works, dedupe, classification, relabelling, pending ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.functions import text as X

#: Fixed values of the quality filter.
LEAST_TITLE, LEAST_ABSTRACT, LANGUAGE, FIELD_TAIL = 8, 200, "en", "/17"
NOT_A_PAPER = r"(?i)^(proceedings of|front matter|table of contents|index$|preface)"
MOST_AUTHORS = 20
PENDING_ID = r"^W\d{1,12}$"


def good(title: Column, abstract: Column, language: Column, retracted: Column, requested: Column | None = None) -> Column:
    """Worth showing: not retracted, English or of no stated language, with a title and an abstract, no front matter.

    What a user asked for needs no abstract.
    """
    requested = F.lit(False) if requested is None else F.coalesce(requested, F.lit(False))
    return (
        ~F.coalesce(retracted, F.lit(False))
        & (F.coalesce(language, F.lit("")).isin("", LANGUAGE))
        & (F.length(title) >= LEAST_TITLE)
        & (requested | (F.length(abstract) >= LEAST_ABSTRACT))
        & ~title.rlike(NOT_A_PAPER)
    )


def tail(address: Column) -> Column:
    return F.element_at(F.split(F.coalesce(address, F.lit("")), "/"), -1)


def classify(df: DataFrame, topics: DataFrame, subfields: DataFrame, topic_id: str = "topic_id", subfield_id: str = "subfield_id", fallback: str = "field_name") -> DataFrame:
    """``df`` with ``category`` and ``excluded``.

    A known topic decides, and one without a category excludes; else a known subfield; else the
    given name, or 'Other'.  ``topics`` (topic_id, category) and ``subfields`` (subfield_id, category)
    are the program's own tables of a few hundred rows, and broadcast.
    """
    t = F.broadcast(topics.select(F.col("topic_id").alias("_t"), F.col("category").alias("_topic"), F.lit(True).alias("_known")))
    s = F.broadcast(subfields.select(F.col("subfield_id").alias("_s"), F.col("category").alias("_sub")))
    met = df.join(t, tail(F.col(topic_id)) == F.col("_t"), "left").join(s, tail(F.col(subfield_id)) == F.col("_s"), "left")
    name = F.coalesce(F.when(F.col(fallback) != "", F.col(fallback)), F.lit("Other"))
    known = F.coalesce("_known", F.lit(False))
    return met.withColumn("category", F.when(known, F.col("_topic")).otherwise(F.coalesce("_sub", name))).withColumn("excluded", known & F.col("_topic").isNull()).drop("_t", "_s", "_topic", "_sub", "_known")


def convert(works: DataFrame, topics: DataFrame, subfields: DataFrame, requested: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Papers of crawled works (schema WORK): those worth showing, projected to the stored fields.

    Unless requested, works outside the subject or of an excluded topic go; requested ones of an
    excluded topic are kept under their field's name.  Columns in ``keep`` are passed on.
    """
    topic = F.col("primary_topic")
    base = works.select(
        F.col("id").alias("_id"),
        X.clean(F.col("title")).alias("title"),
        X.rebuild_text(F.col("abstract_inverted_index")).alias("abstract"),
        F.slice(F.filter(F.transform(F.coalesce("authorships", F.array()), lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n, F.lit("")) != ""), 1, MOST_AUTHORS).alias("authors"),
        F.coalesce("publication_year", F.lit(0)).alias("year"),
        F.coalesce("primary_location.source.display_name", F.lit("")).alias("venue"),
        F.coalesce(topic["display_name"], F.lit("")).alias("topic"),
        tail(topic["id"]).alias("topic_id"),
        tail(topic["subfield"]["id"]).alias("subfield_id"),
        F.coalesce(topic["field"]["display_name"], F.lit("")).alias("field_name"),
        F.coalesce(topic["field"]["id"].cast("string"), F.lit("")).alias("field_id"),
        F.coalesce("doi", F.lit("")).alias("doi"),
        F.coalesce("primary_location.landing_page_url", F.lit("")).alias("url"),
        F.coalesce("best_oa_location.pdf_url", F.lit("")).alias("pdf_url"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by"),
        "language",
        "is_retracted",
        *keep,
    )
    rows = base.where(good(F.col("title"), F.col("abstract"), F.col("language"), F.col("is_retracted"), F.lit(requested)))
    if not requested:
        rows = rows.where(F.col("field_id").endswith(FIELD_TAIL))
    rows = classify(rows, topics, subfields)
    own_name = F.when(F.col("field_name") != "", F.col("field_name")).otherwise("Other")
    rows = rows.withColumn("field", F.when(F.col("excluded"), own_name).otherwise(F.col("category"))) if requested else rows.where(~F.col("excluded")).withColumn("field", F.col("category"))
    return rows.select(S.parse_id(F.col("_id")).alias("id"), "title", "abstract", "authors", "year", "venue", "field", "topic", "topic_id", "doi", "url", "pdf_url", "cited_by", *keep)


def new_papers(batch: DataFrame, existing: DataFrame | None = None, id: str = "id", title: str = "title", order: str = "seq") -> DataFrame:
    """Rows of a batch whose id and title key are new, the first of each in order of arrival.

    A row turned away by its id leaves its title free.  Of rows that agree in id and order one stays.
    """
    known = None
    if existing is not None:
        known = existing.select(F.col(id)), existing.select(X.title_key(F.col(title)).alias("_key"))
    return first_of_each(batch.withColumn("_key", X.title_key(F.col(title))), ["_key"], known, id, order).drop("_key")


def first_of_each(batch: DataFrame, key: list[str], known: tuple[DataFrame, DataFrame] | None = None, id: str = "id", order: str = "seq") -> DataFrame:
    """Rows of a batch whose id, and whose key then, is neither in ``known`` (ids, keys) nor in a row before it by (order, id).

    Winners are found on ids, keys and order alone, in aggregates, so that a key of very many rows is settled
    before the shuffle; whole rows are read once, for those that win.
    """
    slim = batch.select(id, *key, order)
    if known is not None:
        slim = slim.join(known[0].select(id).distinct(), id, "left_anti").join(known[1].select(*key).distinct(), key, "left_anti")
    first = slim.groupBy(id).agg(F.min_by(F.struct(*key), F.col(order)).alias("_k"), F.min(order).alias(order)).select(id, "_k.*", order)
    won = first.groupBy(*key).agg(F.min(F.struct(order, id)).alias("_w")).select(F.col(f"_w.{id}").alias("_id"), F.col(f"_w.{order}").alias("_order"))
    return batch.join(won, F.col(id).eqNullSafe(F.col("_id")) & F.col(order).eqNullSafe(F.col("_order")), "left_semi").dropDuplicates([id, order])


def pending(log: DataFrame, existing: DataFrame, tried: DataFrame | None = None, now: Column | None = None, limit: int | None = 200, retry_days: int = 7, id: str = "id") -> DataFrame:
    """Ids of the log to look up: well-formed, distinct, not stored, not tried within ``retry_days``; the oldest ``limit``."""
    ids = log.where(F.col(id).rlike(PENDING_ID)).groupBy(id).agg(F.min("ts").alias("ts"))
    ids = ids.join(existing.select(id).distinct(), id, "left_anti")
    if tried is not None and now is not None:
        ids = ids.join(tried.where(F.col("ts") > now - F.expr(f"interval {retry_days} days")).select(id).distinct(), id, "left_anti")
    return ids.orderBy("ts", id).limit(limit) if limit else ids


def relabel(papers: DataFrame, labels: DataFrame, requested: DataFrame | None = None, id: str = "id") -> DataFrame:
    """Papers with their new field and exclusion; without a new label the old stays; requested ones are never excluded."""
    new = labels.select(id, F.col("category").alias("_field"), F.col("excluded").alias("_out"), F.lit(True).alias("_new"))
    rows = papers.join(new, id, "left")
    asked = F.lit(False)
    if requested is not None:
        rows = rows.join(requested.select(id, F.lit(True).alias("_asked")).distinct(), id, "left")
        asked = F.coalesce("_asked", F.lit(False))
    known = F.coalesce("_new", F.lit(False))
    was = F.coalesce("excluded", F.lit(False))
    return (
        rows.withColumn("was_excluded", was)
        .withColumn("excluded", F.when(known, F.coalesce("_out", F.lit(False)) & ~asked).otherwise(was))
        .withColumn("field", F.when(known, F.coalesce("_field", F.when(asked, "Other"), F.lit(""))).otherwise(F.col("field")))
        .drop("_field", "_out", "_new", "_asked")
    )


def rebuild_due(new: int, indexed: int, age_hours: float | None, first: int = 500) -> bool:
    """Whether to build the index anew: with none yet, at once; else at 2,000 new rows or a tenth, or after six hours."""
    if age_hours is None:
        return new > 0 or indexed >= first
    return new > 0 and (new >= max(2000, indexed // 10) or age_hours >= 6)
