"""Facets and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP, PAGE, OPTIONS, RECENT_YEARS = 480, 24, 20, 2
#: Years back that filters offer.
YEARS_BACK = (2, 5, 10)


def year_floors(now: Column) -> dict[int, Column]:
    """The first year of each of YEARS_BACK, by a date or time."""
    return {n: (F.year(now) - n).cast("int") for n in YEARS_BACK}


def counts(papers: DataFrame, by: str) -> DataFrame:
    """(name, n) of values that are not blank."""
    return papers.where(F.coalesce(by, F.lit("")) != "").groupBy(F.col(by).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def topics(papers: DataFrame) -> DataFrame:
    """(topic_id, name, field, n), name and field as first seen."""
    seen = papers.where(F.coalesce("topic_id", F.lit("")) != "")
    return seen.groupBy("topic_id").agg(F.min_by("topic", "seq").alias("name"), F.min_by("field", "seq").alias("field"), F.count(F.lit(1)).alias("n"))


def with_all(papers: DataFrame, by: str = "field") -> DataFrame:
    """(name, n): each value's count, and '' for all papers, blank ones too."""
    grouped = papers.groupingSets([[F.col(by)], []], F.col(by)).agg(F.count(F.lit(1)).alias("n"), F.grouping(by).alias("all"))
    return grouped.where((F.col("all") == 1) | (F.coalesce(by, F.lit("")) != "")).select(F.when(F.col("all") == 1, "").otherwise(F.col(by)).alias("name"), "n")


def matching_options(facets: DataFrame, q: str, limit: int = OPTIONS) -> DataFrame:
    """Facets whose name contains ``q`` (any case, literally), the most frequent first."""
    wanted = facets.where(F.contains(F.lower("name"), F.lit(q.strip().lower()))) if q.strip() else facets
    return wanted.orderBy(F.desc("n"), "name").limit(limit)


def top_lists(papers: DataFrame, size: int = TOP, since: int | None = None, by: str = "field") -> DataFrame:
    """(list, place, id): the most cited of each field, and of all under ''; ``since`` confines years.

    A row stands in two lists at most; ranks within a list are limited before the shuffle.
    """
    rows = papers if since is None else papers.where(F.col("year") >= since)
    lists = F.array_distinct(F.array(F.lit(""), F.coalesce(by, F.lit(""))))
    placed = rows.select("id", "cited_by", F.explode(lists).alias("list"))
    place = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("cited_by"), "id"))
    return placed.withColumn("place", place).where(F.col("place") <= size).select("list", "place", "id")


def page_of(lists: DataFrame, name: str, page: int, size: int = PAGE) -> DataFrame:
    """(place, id, more): a page of a list and whether another follows."""
    own = lists.where(F.col("list") == name)
    more = F.max("place").over(Window.partitionBy("list")) > page * size
    return own.withColumn("more", more).where(F.col("place").between((page - 1) * size + 1, page * size)).select("place", "id", "more")


def response(row: dict[str, Column]) -> Column:
    """A JSON object of columns; null ones are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in row.items()]))
