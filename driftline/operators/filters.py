"""Filters of papers: scalar bounds and lists, as one Catalyst predicate, or as rows of a table, one for each query."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Values kept of each list, and seen papers kept of an exclusion.
LIST_LIMIT, EXCLUDE_LIMIT = 32, 1024
#: What filters look at.
ATTRIBUTES = ("year", "cited", "field", "topic", "venue")
#: A filter in a table; null counts as open.
FILTER_ROW = "struct<year_min:int,year_max:int,cited_min:bigint,fields:array<string>,topics:array<int>,venues:array<string>>"


@dataclass(frozen=True)
class Filter:
    """Zero and empty mean open.  ``field in fields or topic in topics`` is one condition; year 0 is unknown and fails any bound."""

    year_min: int = 0
    year_max: int = 0
    cited_min: int = 0
    fields: tuple[str, ...] = ()
    topics: tuple[int, ...] = ()
    venues: tuple[str, ...] = ()

    @classmethod
    def from_request(cls, year_min=0, year_max=0, cited_min=0, fields=(), topics=(), venues=()) -> Filter:
        """A request's values held within bounds: years 0-9999, citations 0-2**31, 32 values a list; bad topics are left out, and nothing left matches all."""
        year = lambda y: max(0, min(9999, int(y or 0)))
        first = lambda xs: tuple(dict.fromkeys(xs))[:LIST_LIMIT]
        numbers = [int(m[1]) for t in list(topics)[:LIST_LIMIT] if (m := re.fullmatch(r"(?:.*/)?T?(\d{1,9})", str(t))) and 0 < int(m[1]) <= 65535]
        return cls(year(year_min), year(year_max), max(0, min(1 << 31, int(cited_min or 0))), first(fields), first(numbers), first(venues))

    @property
    def empty(self) -> bool:
        return self == Filter()

    def predicate(self) -> Column:
        """Columns year, cited, field, topic (number) and venue of the filtered table."""
        p = F.lit(True)
        year, cited = F.coalesce("year", F.lit(0)), F.coalesce("cited", F.lit(0))
        if self.year_min:
            p &= year >= self.year_min
        if self.year_max:
            p &= (year != 0) & (year <= self.year_max)
        if self.cited_min:
            p &= cited >= self.cited_min
        if self.fields or self.topics:
            p &= F.col("field").isin(*self.fields) | F.col("topic").isin(*self.topics)
        if self.venues:
            p &= F.col("venue").isin(*self.venues)
        return p

    def apply(self, df: DataFrame) -> DataFrame:
        """The rows that match; a table without attributes is passed as it is."""
        if self.empty or not set(ATTRIBUTES) <= set(df.columns):
            return df
        return df.where(self.predicate())

    def summary(self) -> str:
        """In words: years, citations, subjects, venues."""
        parts: list[str] = []
        if self.year_min and self.year_max:
            parts.append(str(self.year_min) if self.year_min == self.year_max else f"{self.year_min}–{self.year_max}")
        elif self.year_min:
            parts.append(f"{self.year_min} or later")
        elif self.year_max:
            parts.append(f"{self.year_max} or earlier")
        if self.cited_min:
            parts.append(f"{self.cited_min:,}+ citations")
        for values, many in (((*self.fields, *self.topics), "subjects"), (self.venues, "venues")):
            limit = 2 if many == "subjects" else 1
            if values:
                parts.append(", ".join(map(str, values)) if len(values) <= limit else f"{len(values)} {many}")
        return " · ".join(parts)


def count_matching(df: DataFrame, f: Filter) -> DataFrame:
    """(count, total) in one pass."""
    return df.agg(F.count_if(f.predicate()).alias("count"), F.count(F.lit(1)).alias("total"))


def filter_rows(filters: DataFrame | SparkSession, own: dict[int, Filter] | None = None) -> DataFrame:
    """(query_id, filter): a table of filters with query_id and any of the columns of ``FILTER_ROW``, or a dictionary, as rows.

    A query has one filter.
    """
    if own is not None:
        rows = [(q, f.year_min, f.year_max, f.cited_min, list(f.fields), list(f.topics), list(f.venues)) for q, f in own.items()]
        filters = filters.createDataFrame(rows, "query_id long, year_min int, year_max int, cited_min long, fields array<string>, topics array<int>, venues array<string>")
    if "filter" in filters.columns:
        return filters.select("query_id", "filter")
    kinds = [part.split(":") for part in FILTER_ROW[7:-1].split(",")]
    own = lambda c: F.when(F.col("query_id").isNotNull(), F.col(c)) if c in filters.columns else F.lit(None)  # noqa: E731  nullable, as queries without a filter have none
    return filters.select("query_id", F.struct(*(own(c).cast(kind).alias(c) for c, kind in kinds)).alias("filter"))


def filter_of(row: dict | None) -> Filter:
    """The filter of a row of ``filter_rows``; without one all match."""
    r = row or {}
    return Filter(r.get("year_min") or 0, r.get("year_max") or 0, r.get("cited_min") or 0, *(tuple(r.get(c) or ()) for c in ("fields", "topics", "venues")))


def bitmaps(filters: list[Filter], rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Which rows match each filter, as ``Filter.predicate`` has it, and at the end a line that has all; without attributes all match."""
    out = np.ones((len(filters) + 1, rows.num_rows), bool)
    if not set(ATTRIBUTES) <= set(rows.schema.names):
        return out
    whole = lambda c: np.asarray((x.combine_chunks() if isinstance(x := rows.column(c), pa.ChunkedArray) else x).fill_null(0))
    year, cited = whole("year"), whole("cited")
    codes: dict[str, tuple[dict, np.ndarray]] = {}
    for c in ("field", "topic", "venue"):
        column = rows.column(c)
        coded = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
        known = {v: i for i, v in enumerate(coded.dictionary.to_pylist())}
        codes[c] = known, np.asarray(coded.indices.fill_null(len(known)))

    def among(c: str, values: tuple) -> np.ndarray:
        known, at = codes[c]
        wanted = np.zeros(len(known) + 1, bool)
        wanted[[known[v] for v in values if v in known]] = True
        return wanted[at]

    for i, f in enumerate(filters):
        if f.year_min:
            out[i] &= year >= f.year_min
        if f.year_max:
            out[i] &= (year != 0) & (year <= f.year_max)
        if f.cited_min:
            out[i] &= cited >= f.cited_min
        if f.fields or f.topics:
            out[i] &= among("field", f.fields) | among("topic", f.topics)
        if f.venues:
            out[i] &= among("venue", f.venues)
    return out


def newest_pairs(seen: DataFrame, limit: int = EXCLUDE_LIMIT) -> DataFrame:
    """(query_id, id): pairs to leave out; of a table with ts the newest ``limit`` of each query, each id by its last time, ties to the larger id."""
    if "ts" not in seen.columns:
        return seen.select("query_id", "id")
    last = seen.groupBy("query_id", "id").agg(F.max("ts").alias("ts"))
    newest = Window.partitionBy("query_id").orderBy(F.desc("ts"), F.desc("id"))
    return last.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).select("query_id", "id")


def newest_excluded(seen: Column, limit: int = EXCLUDE_LIMIT) -> Column:
    """The newest ``limit`` of a list in order of time."""
    return F.when(F.size(seen) > limit, F.slice(seen, -limit, limit)).otherwise(seen)


@dataclass(frozen=True)
class FeedRequest:
    """What a feed request may ask, brought within bounds."""

    k: int = 8
    mode: str = ""
    page: int = 1

    @classmethod
    def of(cls, k: int = 8, mode: str = "", page: int = 1) -> FeedRequest:
        return cls(k if 0 < k <= 20 else 8, mode if mode in ("", "top") else "", max(1, min(50, page)))


def request_columns(k: Column, mode: Column, page: Column) -> dict[str, Column]:
    """``FeedRequest.of`` for columns."""
    return {"k": F.when((k > 0) & (k <= 20), k).otherwise(8), "mode": F.when(mode == "top", "top").otherwise(""), "page": F.greatest(F.lit(1), F.least(F.lit(50), F.coalesce(page, F.lit(1))))}


def valid_query_text(q: str) -> bool:
    """1 to 200 bytes once trimmed."""
    return 0 < len(q.strip().encode()) <= 200
