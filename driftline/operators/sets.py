"""Set operations on lists of papers: unions, distinct concatenations, page merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENT = 1000


def union_distinct(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Rows of either, each once."""
    return a.select(*by).union(b.select(*by)).distinct()


def newest_distinct(*lists: Column, size: int = SENT) -> Column:
    """The lists one after the other, first occurrences only, and of these the newest ``size``."""
    all_ = F.array_distinct(F.concat(*lists))
    return F.when(F.size(all_) > size, F.slice(all_, -size, size)).otherwise(all_)


def merge_pages(pages: DataFrame, by: str = "id", order: tuple[str, ...] = ("page", "place")) -> DataFrame:
    """Rows of several pages, of each id the first."""
    first = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return pages.withColumn("_n", first).where("_n = 1").drop("_n")


def first_values(values: Column, size: int = 32) -> Column:
    """A list without repeats, its first ``size`` values."""
    return F.slice(F.array_distinct(values), 1, size)
