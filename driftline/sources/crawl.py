"""A works API as a Python data source: pages behind cursors, batch and stream.

An ``Api`` gives pages: from an HTTP address, with retries, or from a folder of page files
(``page-000000.json`` and on) on any file system that Arrow knows, shared ones among them.  A page is a
JSON array of works, or an object with ``results`` and ``meta`` (``next_cursor``, ``count``).
A crawl starts at cursor ``*`` and goes where each page's cursor says, so its place is one string:
a stream's offset, or a state that a job keeps.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from driftline.operators.fts import TtlCache
from driftline.schema import WORK

#: Works of a page; tries of a request, seconds before the second one (then twice as many each), and seconds of Retry-After that are worth waiting for.
PAGE_SIZE, TRIES, WAIT, PATIENCE = 200, 4, 0.4, 2
START = "*"
SCHEMA = "page int, cursor string, id string, body string"


class Throttled(Exception):
    """The API wants to be left alone for ``retry_after`` seconds."""

    def __init__(self, retry_after: float):
        super().__init__(f"throttled for {retry_after} s")
        self.retry_after = retry_after


@dataclass
class Page:
    results: list[dict]
    next: str | None
    count: int | None = None


def get_json(url: str, sleep=time.sleep):
    """The JSON at ``url``; rate limits, errors of the server and of the network are tried again with growing waits."""
    error: Exception = ValueError(url)
    for attempt in range(TRIES):
        if attempt:
            sleep(WAIT * 2 ** (attempt - 1))
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            error = e
            if e.code != 429 and e.code < 500:
                raise
            if (e.headers.get("Retry-After") or "").isdigit() and int(e.headers["Retry-After"]) > PATIENCE:
                raise Throttled(int(e.headers["Retry-After"])) from None
        except (urllib.error.URLError, TimeoutError) as e:
            error = e
    raise error


@dataclass
class Api:
    """Pages of works at ``base``, an http address or a folder; ``params`` go along with every request, a filter among them beside the request's own."""

    base: str
    params: dict[str, str] = field(default_factory=dict)
    size: int = PAGE_SIZE

    def page(self, cursor: str = START, since: str | None = None, sort: str | None = None, ids: list[str] | None = None, where: str = "") -> Page:
        """The page at ``cursor``: of works published from ``since`` (a date) on, in order of ``sort``, or of those with ``ids``; ``where`` is a filter as the API writes it."""
        if self.base.startswith(("http://", "https://")):
            filters = [self.params.get("filter"), where, f"ids:{'|'.join(ids)}" if ids else "", f"from_publication_date:{since}" if since else ""]
            joined = ",".join(f for f in filters if f)
            asked = {"cursor": cursor, "per-page": str(self.size), **({"sort": sort} if sort else {}), **self.params, **({"filter": joined} if joined else {})}
            return self.parsed(get_json(f"{self.base}?{urllib.parse.urlencode(asked)}"))
        return self._from_folder(cursor, since, ids)

    @staticmethod
    def parsed(raw, after: str | None = None) -> Page:
        if isinstance(raw, list):
            return Page(raw, after)
        meta = raw.get("meta") or {}
        return Page(raw.get("results") or [], meta.get("next_cursor") or after, meta.get("count"))

    def _folder(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.base if "://" in self.base else f"file://{self.base}")

    def _read(self, n: int):
        store, folder = self._folder()
        path = f"{folder}/page-{n:06d}.json"
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def pages(self) -> list[int]:
        """Numbers of a folder's pages."""
        store, folder = self._folder()
        return sorted(int(f.base_name[5:-5]) for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("page-") and f.base_name.endswith(".json"))

    def _from_folder(self, cursor: str, since: str | None, ids: list[str] | None) -> Page:
        if ids is not None:  # a lookup goes through all pages
            wanted = set(ids)
            return Page([w for n in self.pages() for w in self.parsed(self._read(n)).results if str(w.get("id", "")).rsplit("/", 1)[-1] in wanted], None)
        n = 0 if cursor == START else int(cursor)
        raw = self._read(n)
        if raw is None:
            return Page([], None)
        page = self.parsed(raw, str(n + 1) if n + 1 in self.pages() else None)
        if since:
            page.results = [w for w in page.results if published(w) >= since[: len(published(w))] and published(w)]
        return page


class Lookup:
    """Single works of an API, each asked for once in ten minutes, and 512 held."""

    def __init__(self, api: Api, seconds: float = 600, most: int = 512, clock=time.monotonic):
        self.api, self.cache = api, TtlCache(seconds, most, clock)

    def work(self, id: str) -> dict | None:
        return self.cache.get(id, lambda: next(iter(self.api.page(ids=[id]).results), None))


def published(work: dict) -> str:
    """The date of a work, or its year, or ''."""
    return str(work.get("publication_date") or work.get("publication_year") or "")


def rows_of(n: int, cursor: str, page: Page) -> Iterator[tuple]:
    for w in page.results:
        yield n, cursor, w.get("id"), json.dumps(w, ensure_ascii=False)


def works(pages: DataFrame) -> DataFrame:
    """Works (schema WORK) of rows of the data source."""
    return pages.select(F.from_json("body", WORK).alias("w")).select("w.*")


def folder_stream(spark: SparkSession, path: str, pages_per_trigger: int = 10, pattern: str = "*.json") -> DataFrame:
    """(file, id, body): works of a folder's page files as a stream; ``works`` parses them.

    Spark's file source lists the folder, admits ``pages_per_trigger`` files to a batch, remembers in the
    checkpoint what it has read, and lets the tasks read and parse pages side by side.  Pages that are
    no JSON have no works.
    """
    text = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", pages_per_trigger).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return _page_works(text)


def folder_batch(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``folder_stream`` of what is there now, as a table."""
    return _page_works(spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path))


def _page_works(text: DataFrame) -> DataFrame:
    bare = F.from_json("value", "array<string>")
    results = F.from_json("value", "results array<string>")["results"]
    each = text.select(F.col("_metadata.file_name").alias("file"), F.explode(F.when(F.ltrim("value").startswith("["), bare).otherwise(results)).alias("body"))
    return each.select("file", F.get_json_object("body", "$.id").alias("id"), "body")


def _api(options: dict) -> Api:
    return Api(options["path"], {}, int(options.get("size", PAGE_SIZE)))


class _Batch(DataSourceReader):
    """A folder's pages are read by a task each; cursors can only be followed one after the other, by one."""

    def __init__(self, options: dict):
        self.api, self.most, self.since, self.sort = _api(options), int(options.get("pages", 1 << 30)), options.get("since"), options.get("sort")

    def partitions(self) -> list[InputPartition]:
        if self.api.base.startswith("http"):
            return [InputPartition(None)]
        return [InputPartition(n) for n in self.api.pages()[: self.most]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is not None:
            yield from rows_of(partition.value, str(partition.value), self.api.page(str(partition.value), self.since))
            return
        cursor, n = START, 0
        while cursor and n < self.most:
            page = self.api.page(cursor, self.since, self.sort)
            yield from rows_of(n, cursor, page)
            cursor, n = page.next, n + 1


class _Stream(SimpleDataSourceStreamReader):
    """A crawl by cursors, which can only be followed one after the other; a folder's pages are better read by ``folder_stream``.

    An empty page is not the end of a crawl: it is passed over if another follows.
    """

    def __init__(self, options: dict):
        self.api, self.per_trigger, self.since, self.sort = _api(options), int(options.get("pagesPerTrigger", 10)), options.get("since"), options.get("sort")

    def initialOffset(self) -> dict:
        return {"page": 0, "cursor": START, "done": False}

    def _walk(self, start: dict, until: int) -> tuple[list[tuple], dict]:
        n, cursor, out = start["page"], start["cursor"], []
        while not start["done"] and n < until:
            page = self.api.page(cursor, self.since, self.sort)
            out += rows_of(n, cursor, page)
            if page.next is None:
                return out, {"page": n + 1, "cursor": cursor, "done": True}
            n, cursor = n + 1, page.next
        return out, {"page": n, "cursor": cursor, "done": start["done"]}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, end = self._walk(start, start["page"] + self.per_trigger)
        return iter(out), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._walk(start, end["page"])[0])


class Works(DataSource):
    """``spark.dataSource.register(Works)``, then format("works") with options path, size, since, sort, and pages or pagesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "works"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)
