"""A stored text index: segments of postings, and a pointer that names them and how far they reach.

A sync adds a segment with the postings of its papers and a row for each paper with its lengths, in buckets
by id.  Postings lie in files by parts of the papers, each sorted by term, so no posting is moved to be stored.  Rows of older segments that it replaces are looked up in the
buckets of its ids, and named in the segment's list of what is gone; so each paper has one
row that is not gone, totals change by what came and what went, and a commit reads its batch and
what it replaces.  Segments of like size are merged (see segments), so a posting is written again
log(papers) times at most.  Segment and offset are committed by one change of the pointer, so a
batch that comes again after a failure is known by its offset and changes nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import fts
from driftline.sources.segments import buckets_for, merge_from, read_buckets, touched, write_buckets
from driftline.sources.shared import read_pointer, remove, stored, write_pointer

#: Papers added since all segments were merged beyond which they are again, if there are as many as before; a fixed value.
MERGE_AT = 50_000
#: Bytes of text whose postings a task sorts, and rows gone up to which they are broadcast; fixed values.
PART_BYTES, FEW_GONE = 16 << 20, 1_000_000
POSTING = "id long, col string, term string, pos int"
DOCUMENT = "id long, length long, title_length long"
GONE = "id long, segment string"
KINDS = ("postings", "documents", "gone")
NO_TOTALS = {"docs": 0, "length": 0, "titled": 0, "title_length": 0}


class TextIndex:
    """Postings of papers at ``path``; ``stemmed`` holds for them and for every query on them."""

    def __init__(self, spark: SparkSession, path: str, stemmed: bool = False, columns: tuple[str, ...] = ("title", "authors", "abstract")):
        self.spark, self.path, self.columns = spark, path, columns
        self.state = read_pointer(spark, f"{path}/current") or {"segments": [], "offset": -1, "added": 0, "merged": 0, "retired": [], "stemmed": stemmed, **NO_TOTALS}
        if self.state["stemmed"] != stemmed:
            raise ValueError(f"{path}: postings and queries must both be stemmed or not")

    @property
    def stemmed(self) -> bool:
        return self.state["stemmed"]

    def _at(self, kind: str, name: str) -> str:
        return f"{self.path}/{kind}/segment={name}"

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.unionAll, parts) if parts else self.spark.createDataFrame([], schema)

    def _documents(self, segments: list[dict], some: list[int] | None = None) -> DataFrame:
        """Rows of some segments' papers with their segment, gone ones included; of some buckets only."""
        parts = [read_buckets(self.spark, self._at("documents", s["name"]), DOCUMENT, s["buckets"], some).withColumn("segment", F.lit(s["name"])) for s in segments]
        return self._union(parts, f"{DOCUMENT}, segment string")

    def _gone(self, some: list[int] | None = None) -> DataFrame | None:
        """(id, segment) of rows that later segments have replaced or taken out; None without any."""
        holders = [s for s in self.state["segments"] if s["gone"]]
        return self._union([read_buckets(self.spark, self._at("gone", s["name"]), GONE, s["gone_buckets"], some) for s in holders], GONE) if holders else None

    def _without_gone(self, rows: DataFrame, some: list[int] | None = None) -> DataFrame:
        gone = self._gone(some)
        if gone is None:
            return rows
        few = sum(s["gone"] for s in self.state["segments"]) <= FEW_GONE
        return rows.join(F.broadcast(gone) if few else gone, ["id", "segment"], "left_anti")

    def documents(self) -> DataFrame:
        """(id, length, title_length) of the papers that can be found."""
        return self._without_gone(self._documents(self.state["segments"])).drop("segment")

    def _postings(self, segments: list[dict]) -> DataFrame:
        parts = [self.spark.read.schema(POSTING).parquet(self._at("postings", s["name"])).withColumn("segment", F.lit(s["name"])) for s in segments if s["rows"]]
        return self._without_gone(self._union(parts, f"{POSTING}, segment string")).drop("segment")

    def postings(self) -> DataFrame:
        """(id, col, term, pos); filters on term reach the scans of the segments."""
        return self._postings(self.state["segments"])

    def replaced(self, ids: DataFrame) -> DataFrame:
        """(id, length, title_length, segment): the rows that are there for some ids, read from their buckets."""
        widest = max([1, *(s["buckets"] for s in self.state["segments"]), *(s["gone_buckets"] for s in self.state["segments"])])
        some = touched(ids, "id", widest) if widest > 1 else None
        return self._without_gone(self._documents(self.state["segments"], some).join(ids.select("id").distinct(), "id", "left_semi"), some)

    def _write(self, posts: DataFrame | None, documents: DataFrame | None, gone: DataFrame, papers: DataFrame | None = None) -> dict:
        """A segment's tables.  Without ``documents`` the lengths of ``papers`` (id) are counted from the postings once they are written."""
        name = uuid.uuid4().hex
        if posts is None:  # only deletions
            documents = self.spark.createDataFrame([], DOCUMENT)
        else:
            posts.sortWithinPartitions("term", "id").write.parquet(self._at("postings", name))
        if documents is None:
            written = self.spark.read.schema(POSTING).parquet(self._at("postings", name))
            sizes = written.groupBy("id").agg(F.count(F.lit(1)).alias("length"), F.count_if(F.col("col") == "title").alias("title_length"))
            documents = stored(papers.join(sizes, "id", "left").na.fill(0, ["length", "title_length"]), "lengths")
        rows, lost = documents.count(), gone.count()
        write_buckets(documents.select("id", "length", "title_length"), self._at("documents", name), "id", buckets_for(rows))
        if lost:
            write_buckets(gone.select("id", "segment"), self._at("gone", name), "id", buckets_for(lost))
        return {"name": name, "rows": rows, "buckets": buckets_for(rows), "gone": lost, "gone_buckets": buckets_for(lost)}

    def _totals(self, documents: DataFrame) -> dict[str, int]:
        got = documents.agg(F.count_if(F.col("length") > 0), F.sum("length"), F.count_if(F.col("title_length") > 0), F.sum("title_length")).first()
        return {k: int(v or 0) for k, v in zip(NO_TOTALS, got, strict=True)}

    def _add(self, posts: DataFrame | None, papers: DataFrame | None, ids: DataFrame, offset: int) -> None:
        """Commit a segment of ``posts`` of ``papers`` in place of what is there for ``ids``."""
        before = stored(self.replaced(ids), "replaced") if self.state["segments"] else self.spark.createDataFrame([], f"{DOCUMENT}, segment string")
        segment = self._write(posts, None, before, papers)
        came, went = self._totals(self._documents([segment])), self._totals(before)
        totals = {k: self.state[k] + came[k] - went[k] for k in NO_TOTALS}
        self._commit([*self.state["segments"], segment], offset=offset, added=self.state["added"] + segment["rows"] + segment["gone"], **totals)

    def _commit(self, segments: list[dict], **changes) -> None:
        self.state |= {"segments": segments, **changes}
        write_pointer(self.spark, f"{self.path}/current", self.state)
        whole = self.state["added"] > max(MERGE_AT, self.state["merged"])
        low = 0 if whole else merge_from([s["rows"] + s["gone"] for s in segments])
        if low < len(segments):
            self._merge(low)

    def _merge(self, low: int) -> None:
        """Merge the segments from ``low`` on; what was merged the time before is removed."""
        segments = self.state["segments"]
        kept, old = segments[:low], segments[low:]
        names = [s["name"] for s in old]
        rows = self._without_gone(self._documents(old))
        holders = [s for s in old if s["gone"]]
        gone = self._union([read_buckets(self.spark, self._at("gone", s["name"]), GONE, s["gone_buckets"]) for s in holders], GONE)
        one = self._write(self._postings(old), stored(rows, "merged"), stored(gone.where(~F.col("segment").isin(*names)), "merged-gone"))
        retired = self.state["retired"]
        whole = {"added": 0, "merged": one["rows"]} if low == 0 else {}
        self.state |= {"segments": [*kept, one], "retired": names, **whole}
        write_pointer(self.spark, f"{self.path}/current", self.state)
        for name in retired:
            for kind in KINDS:
                remove(self.spark, self._at(kind, name))

    def sync(self, papers: DataFrame, offset: int) -> bool:
        """Put ``papers`` in, in place of those with their ids; excluded ones only go.  An offset that is done changes nothing.

        Of rows that repeat an id one is taken, the last by ``seq`` if there is one.
        """
        if offset <= self.state["offset"]:
            return False
        papers = stored(self._once(papers), "papers")
        ids = papers.select(F.col("id").cast("long").alias("id"))
        live = ids if "excluded" not in papers.columns else papers.where(~F.coalesce(F.col("excluded"), F.lit(False))).select(F.col("id").cast("long").alias("id"))
        self._add(fts.postings(self._parts(papers), columns=self.columns, stemmed=self.stemmed), live, ids, offset)
        return True

    @staticmethod
    def _once(papers: DataFrame) -> DataFrame:
        """One row for each id; only rows whose id repeats are grouped, so that the texts of the others aren't moved."""
        again = stored(papers.groupBy("id").count().where("count > 1").select(F.col("id").alias("_id")), "again")
        if not again.limit(1).count():
            return papers
        same = F.col("id").eqNullSafe(F.col("_id"))
        some, rest = papers.join(again, same, "left_semi"), papers.join(again, same, "left_anti")
        if "seq" in papers.columns:
            one = some.groupBy("id").agg(F.max_by(F.struct(*[c for c in papers.columns if c != "id"]), "seq").alias("p")).select("id", "p.*")
        else:
            one = some.dropDuplicates(["id"])
        return rest.select(*papers.columns).unionAll(one.select(*papers.columns))

    def _parts(self, papers: DataFrame) -> DataFrame:
        """Papers in parts of some ``PART_BYTES`` of text, whose postings a task can sort in memory."""
        kinds = dict(papers.dtypes)
        size = [F.coalesce(F.octet_length(F.array_join(F.col(c), " ") if kinds[c].startswith("array") else F.col(c)), F.lit(0)) for c in self.columns if c in kinds]
        total = papers.agg(F.sum(sum(size, F.lit(0)).cast("long"))).first()[0] or 0
        spread = min(self.spark.sparkContext.defaultParallelism, total >> 20)
        return papers.repartition(max(1, spread, -(-total // PART_BYTES)), "id")

    def delete(self, ids: DataFrame, offset: int) -> bool:
        """Take papers out by id."""
        if offset <= self.state["offset"]:
            return False
        out = ids.select(F.col("id").cast("long").alias("id")).distinct()
        self._add(None, None, out, offset)
        return True

    def optimize(self) -> None:
        """Merge all segments into one; readers of the old ones keep their files until the next merge."""
        if self.state["segments"]:
            self._merge(0)

    def sizes(self) -> fts.Sizes:
        """The lengths and totals that are stored beside the postings."""
        return fts.Sizes(self.documents(), (self.state["docs"], self.state["length"]), (self.state["titled"], self.state["title_length"]))

    def search(self, papers: DataFrame, q: str, sort: str = "", page: int = 1, title_cap: int = fts.COUNT_CAP) -> DataFrame:
        """``fts.search`` on the stored postings."""
        return fts.search(papers, self.postings(), q, sort, page, title_cap, self.stemmed, self.sizes())
