"""Writers: deduplicated appends, the versioned index, responses, sitemaps, status.  Postings are in textindex."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.scalars import SITEMAP_URLS
from driftline.operators.ingest import PENDING_ID, first_of_each
from driftline.sources.files import FORMAT_VERSION
from driftline.sources.segments import KeyIndex
from driftline.sources.shared import exists, read_pointer, remove, stored, write_pointer


def append_new(batch: DataFrame, path: str, keys: KeyIndex | None = None) -> int:
    """Append the rows whose id and title are new to a Parquet table; how many.

    Known keys are looked up in the index beside the table (``keys``, if it is open already), in the
    buckets of the batch, so the cost follows the batch.
    """
    keys = keys or KeyIndex(batch.sparkSession, path)
    batch = stored(batch, "batch")
    own = KeyIndex.keys(batch)
    ids, titles = keys.known(own)
    marked = batch.withColumns({c: own_key for c, own_key in zip(("_a", "_b"), KeyIndex.hashes(F.col("title")), strict=True)})
    new = stored(first_of_each(marked, ["_a", "_b"], (ids, titles.select(F.col("a").alias("_a"), F.col("b").alias("_b")))).drop("_a", "_b"), "new")
    return keys.append(new)


#: Ids that a pending log takes; a fixed value.
PENDING_ROOM = 200_000


def append_pending(batch: DataFrame, path: str, room: int = PENDING_ROOM) -> int:
    """Append well-formed ids that are not there yet, the earliest first, while there is room; how many it took."""
    spark = batch.sparkSession
    ids = batch.where(F.col("id").rlike(PENDING_ID)).groupBy("id").agg(F.min("ts").alias("ts"))
    if exists(spark, path):
        old = spark.read.parquet(path)
        room -= old.count()
        ids = ids.join(old.select("id"), "id", "left_anti")
    some = ids.orderBy("ts", "id").limit(max(0, room)).persist()
    n = some.count()
    some.write.mode("append").parquet(path)
    some.unpersist()
    return n


def append_missing(vectors: DataFrame, path: str, id: str = "id") -> None:
    """Append the embeddings whose id is not there yet; run again after a failure, it adds what is missing."""
    spark = vectors.sparkSession
    if exists(spark, path):
        vectors = vectors.join(spark.read.parquet(path).select(id), id, "left_anti")
    vectors.write.mode("append").parquet(path)


def write_index(index: DataFrame, path: str, partitions: int | None = None) -> str:
    """Write a build beside the others, then point ``current`` at it in one step; readers keep the build they opened.

    Two builds stay, the current one and the one before; older ones are removed.  Rows are laid out by cluster, so that a probe reads the files and row groups of its clusters alone.
    """
    spark, build = index.sparkSession, uuid.uuid4().hex
    laid = index.repartitionByRange(partitions, "cluster", "row") if partitions else index.repartitionByRange("cluster", "row")
    laid.sortWithinPartitions("cluster", "row").write.parquet(f"{path}/build={build}")
    rows = spark.read.parquet(f"{path}/build={build}").count()
    before = read_pointer(spark, f"{path}/current") or {}
    write_pointer(spark, f"{path}/current", {"build": build, "version": FORMAT_VERSION, "rows": rows, "previous": before.get("build")})
    if before.get("previous"):
        for part in ("build", "centroids"):
            remove(spark, f"{path}/{part}={before['previous']}")
    return build


def write_matrix(df: DataFrame, path: str, vector: str = "embedding") -> DataFrame:
    """Write vectors as raw little-endian 32-bit floats, a file for each partition in its order; (file, rows) of what was written.

    A file takes its place when it is whole, under its partition's number, so a task that runs again writes it anew.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]):
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.f32"
        beside, n = f"{folder}/_{uuid.uuid4().hex}", 0
        with store.open_output_stream(beside) as out:
            for b in batches:
                out.write(np.asarray(b.column(0).flatten(), "<f4").tobytes())
                n += b.num_rows
        store.move(beside, f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n])], ["file", "rows"])

    return stored(df.select(F.col(vector).cast("array<float>")).mapInArrow(run, "file string, rows long"), "matrix")


def paper_json(columns: list[str], vec: Column | None = None, scale: Column | None = None, score: Column | None = None, reason: Column | None = None) -> Column:
    """A response's object: the paper's columns, and vector (base64), scale, score and reason where there are any; 0 counts as none."""
    more = [(vec, "vec"), (scale, "scale"), (score, "score"), (reason, "reason")]
    extra = [(F.base64(c) if name == "vec" else F.nullif(c, F.lit(0.0)) if name in ("scale", "score") else c).alias(name) for c, name in more if c is not None]
    return F.to_json(F.struct(*columns, *extra))


def sitemap(pages: DataFrame, row: str = "row", url: str = "url", home: str | None = None) -> DataFrame:
    """(chunk, line): URLs of sitemap files; the first also has the home page."""
    lines = pages.select(F.floor(F.col(row) / SITEMAP_URLS).cast("long").alias("chunk"), F.col(url).alias("line"))
    return lines.unionByName(pages.sparkSession.createDataFrame([(0, home)], "chunk long, line string")) if home else lines


def write_sitemap(pages: DataFrame, path: str, home: str | None = None) -> None:
    sitemap(pages, home=home).repartition("chunk").write.mode("overwrite").partitionBy("chunk").text(path)


def article_json(url: Column, same_as: Column) -> Column:
    """The schema.org object of a paper's page; date, identifier, journal, subject and authors only where there are any."""
    some = lambda c, value=None: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c) if value is None else value)
    people = F.transform("authors", lambda a: F.struct(F.lit("Person").alias("@type"), a.alias("name")))
    keys = {
        "@context": F.lit("https://schema.org"),
        "@type": F.lit("ScholarlyArticle"),
        "headline": F.col("title"),
        "name": F.col("title"),
        "abstract": F.col("abstract"),
        "url": url,
        "sameAs": F.array(same_as),
        "isAccessibleForFree": F.coalesce(F.col("pdf_url"), F.lit("")) != "",
        "datePublished": F.when(F.col("year") != 0, F.col("year").cast("string")),
        "identifier": some("doi"),
        "isPartOf": some("venue", F.struct(F.lit("Periodical").alias("@type"), F.col("venue").alias("name"))),
        "about": some("field"),
        "author": F.when(F.size("authors") > 0, people),
    }
    return F.to_json(F.struct(*[c.alias(k) for k, c in keys.items()]))


def write_status(row: DataFrame, path: str) -> None:
    """The one row of ``status`` as a JSON object at ``path``, put there in one step."""
    write_pointer(row.sparkSession, path, row.first().asDict())


def status(papers: DataFrame, vectors: DataFrame, index: DataFrame) -> DataFrame:
    """One row of counters: fetched, embedded, indexed and waiting papers."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both = one(papers, "fetched").crossJoin(one(vectors, "embedded")).crossJoin(one(index, "indexed"))  # single rows
    return both.withColumn("queue", F.col("fetched") - F.col("embedded"))
