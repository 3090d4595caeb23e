"""Tables that grow by segments: each segment in hash buckets by key, segments of like size merged.

A lookup of some keys reads the buckets that they fall in, in each segment, and nothing else.  Buckets are
powers of two that follow a segment's rows, so a key's bucket in a small segment is its bucket in a large
one, modulo.  Segments are merged when ``FAN`` of a tier have come together, so there are some
``FAN`` * log(rows) of them and a row is written again log(rows) times at most, to the base of ``FAN``.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.text import title_key
from driftline.sources.shared import exists, read_pointer, remove, write_pointer

FAN = 8
#: Rows of a bucket, about, and bounds of the buckets of a segment and of a lookup that names its buckets.
BUCKET_ROWS, MOST_BUCKETS, MOST_TOUCHED = 16_384, 65_536, 4_096


def buckets_for(rows: int) -> int:
    """A power of two, one for each ``BUCKET_ROWS`` rows."""
    n = 1
    while n < MOST_BUCKETS and n * BUCKET_ROWS < rows:
        n *= 2
    return n


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merge_from(sizes: list[int], fan: int = FAN) -> int:
    """Where the segments begin that are merged into one now that the last has come; their number if none are."""

    def tier(n: int) -> int:
        t = 0
        while n >= fan:
            n, t = n // fan, t + 1
        return t

    held, start = list(sizes), len(sizes)
    while held:
        run = 0
        while run < len(held) and tier(held[-1 - run]) <= tier(held[-1]):
            run += 1
        if run < fan:
            break
        held[-run:] = [sum(held[-run:])]
        start = len(held) - 1
    return start


def touched(keys: DataFrame, key: str, buckets: int) -> list[int] | None:
    """The buckets, of so many, that hold some keys; None (all) beyond ``MOST_TOUCHED``."""
    found = [r[0] for r in keys.select(bucket_of(F.col(key), buckets)).distinct().limit(MOST_TOUCHED + 1).collect()]
    return sorted(found) if len(found) <= MOST_TOUCHED else None


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    laid = df.withColumn("bucket", bucket_of(F.col(key), buckets))
    (laid.coalesce(1) if buckets == 1 else laid.repartition("bucket")).write.partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: str, buckets: int, some: list[int] | None = None) -> DataFrame:
    """A segment's table; with ``some`` buckets (of as many or more) only their files are read."""
    df = spark.read.schema(f"{schema}, bucket int").parquet(path)
    if some is not None and buckets > 1:
        df = df.where(F.col("bucket").isin(*sorted({b % buckets for b in some})) if some else F.lit(False))
    return df.drop("bucket")


@dataclass
class Segment:
    name: str
    rows: int
    buckets: int


class KeyIndex:
    """Ids and title keys of a table of papers, beside it: what an append asks about its batch.

    Title keys are kept as two 64-bit hashes (two different ones among 10**10 titles agree with a probability
    below 10**-18).  The pointer says when an append is under way; where one was cut off, the
    index is made anew from the table once.
    """

    IDS, TITLES = "id long", "a long, b long"

    def __init__(self, spark: SparkSession, table: str, into: str = ""):
        """``into`` is the folder of the table that appended rows go to, if it is a partitioned one."""
        self.spark, self.table, self.path = spark, table.rstrip("/"), f"{table.rstrip('/')}-keys"
        self.into = f"{self.table}/{into}" if into else self.table
        self.state = read_pointer(spark, f"{self.path}/current")
        if self.state is None or self.state["open"]:
            self.state = {"segments": [], "open": False, "retired": []}
            if exists(spark, self.table):
                self._add(spark.read.parquet(self.table).select("id", "title"))
            else:
                self._save()

    def _save(self, **changes) -> None:
        self.state |= changes
        write_pointer(self.spark, f"{self.path}/current", self.state)

    @property
    def segments(self) -> list[Segment]:
        return [Segment(**s) for s in self.state["segments"]]

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments)

    @staticmethod
    def keys(papers: DataFrame, id: str = "id", title: str = "title") -> DataFrame:
        """(id, a, b) of papers."""
        a, b = KeyIndex.hashes(F.col(title))
        return papers.select(F.col(id).cast("long").alias("id"), a.alias("a"), b.alias("b"))

    @staticmethod
    def hashes(title: Column) -> tuple[Column, Column]:
        """Two hashes of a title's key."""
        return F.xxhash64(title_key(title)), F.xxhash64(F.lit(91), title_key(title))

    def _read(self, kind: str, schema: str, segments: list[Segment], some: list[int] | None) -> DataFrame:
        parts = [read_buckets(self.spark, f"{self.path}/{kind}/segment={s.name}", schema, s.buckets, some) for s in segments]
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], schema)

    def known(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(ids, title keys): those that are there in the buckets of ``keys`` (id, a, b); few, whatever the table's size."""
        widest = max([1, *(s.buckets for s in self.segments)])
        ids, titles = (touched(keys, c, widest) if widest > 1 else None for c in ("id", "a"))
        return self._read("ids", self.IDS, self.segments, ids), self._read("titles", self.TITLES, self.segments, titles)

    def _write(self, ids: DataFrame, titles: DataFrame, rows: int) -> Segment:
        s = Segment(uuid.uuid4().hex, rows, buckets_for(rows))
        write_buckets(ids, f"{self.path}/ids/segment={s.name}", "id", s.buckets)
        write_buckets(titles, f"{self.path}/titles/segment={s.name}", "a", s.buckets)
        return s

    def _add(self, papers: DataFrame) -> int:
        """A segment with the keys of new papers, and the merge that it may bring; the merged segments stay until the next merge."""
        keys = self.keys(papers)
        n = keys.count()
        segments, retired = self.segments, self.state["retired"]
        if n:
            segments.append(self._write(keys.select("id"), keys.select("a", "b"), n))
        low = merge_from([s.rows for s in segments])
        gone: list[str] = []
        if low < len(segments):
            old = segments[low:]
            segments[low:] = [self._write(self._read("ids", self.IDS, old, None), self._read("titles", self.TITLES, old, None), sum(s.rows for s in old))]
            gone, retired = retired, [s.name for s in old]
        self._save(segments=[asdict(s) for s in segments], open=False, retired=retired)
        for name in gone:
            for kind in ("ids", "titles"):
                remove(self.spark, f"{self.path}/{kind}/segment={name}")
        return n

    def append(self, rows: DataFrame) -> int:
        """Append rows that are known to be new to the table and their keys to the index; how many.  ``rows`` should be stored."""
        self._save(open=True)
        rows.write.mode("append").parquet(self.into)
        return self._add(rows.select("id", "title"))
