"""Readers: crawl snapshots, JSON lines, float matrices, the versioned index, pending logs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from driftline.functions.scalars import parse_id
from driftline.schema import INDEX, PAPER, PENDING, WORK, with_defaults
from driftline.sources.shared import read_pointer

FORMAT_VERSION = 3


def snapshot(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Works of a crawl snapshot: all gzipped JSON-lines files below ``path``."""
    df = spark.read.schema(WORK).option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").json(path)
    return df.limit(most) if most else df


def papers(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Stored papers with defaults for what is missing; malformed lines fail, or are skipped if not ``strict``."""
    return with_defaults(spark.read.schema(PAPER).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path))


def pending_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PENDING).option("mode", "DROPMALFORMED").json(path)


#: Rows of a float matrix that one task reads, and rows of a batch.
MATRIX_ROWS, MATRIX_BATCH = 65_536, 4_096


@dataclass
class RowRange(InputPartition):
    file: str
    first: int
    rows: int


class _MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dim = options["path"], int(options["dim"])
        self.rows = int(options.get("rowsPerTask", MATRIX_ROWS))
        if self.dim < 1 or self.rows < 1:
            raise ValueError("dim and rowsPerTask must be positive")

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def partitions(self) -> list[RowRange]:
        store, path = self._store()
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            whole = f.size // (4 * self.dim)  # an incomplete last row is ignored
            out += [RowRange(f.path, low, min(self.rows, whole - low)) for low in range(0, whole, self.rows)]
        return out or [RowRange("", 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        store, _ = self._store()
        with store.open_input_file(partition.file) as f:
            for low in range(partition.first, partition.first + partition.rows, MATRIX_BATCH):
                n = min(MATRIX_BATCH, partition.first + partition.rows - low)
                x = np.frombuffer(f.read_at(4 * self.dim * n, 4 * self.dim * low), "<f4")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, self.dim, dtype=np.int32)), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * n), pa.array(np.arange(low, low + n)), vectors], ["file", "i", "embedding"])


class Matrix(DataSource):
    """Raw little-endian 32-bit float matrices, a file or a folder of them: options path, dim and rowsPerTask; a task reads a range of rows."""

    @classmethod
    def name(cls) -> str:
        return "float_matrix"

    def schema(self) -> str:
        return "file string, i long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _MatrixReader(self.options)


def matrix(spark: SparkSession, path: str, dim: int, rows: int = MATRIX_ROWS) -> DataFrame:
    """(file, i, embedding) of raw little-endian 32-bit float matrices; an incomplete last row is ignored.

    A task reads ``rows`` rows, whatever a file's size, from any file system that Arrow knows.
    """
    spark.dataSource.register(Matrix)
    return spark.read.format("float_matrix").option("dim", str(dim)).option("rowsPerTask", str(rows)).load(path)


def in_file_order(rows: DataFrame) -> DataFrame:
    """``matrix`` rows with ``position``, from 0 over all files in order of their names; a count for each file comes to the driver."""
    starts, before = [], 0
    for file, n in sorted(rows.groupBy("file").agg(F.count(F.lit(1))).collect()):
        starts.append((file, before))
        before += n
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "file string, _first long"))
    return rows.join(first, "file").withColumn("position", F.col("_first") + F.col("i")).drop("_first")


def current_build(spark: SparkSession, path: str) -> str | None:
    """The build that an index's pointer names; None without one of this version."""
    meta = read_pointer(spark, f"{path}/current")
    return meta["build"] if meta and meta["version"] == FORMAT_VERSION else None


def index_scan(spark: SparkSession, path: str, build: str | None = None) -> DataFrame:
    """A build of an index (see sinks.write_index), the current one if none is named; its version and columns are checked."""
    build = build or current_build(spark, path)
    if build is None:
        raise ValueError(f"{path}: no index of version {FORMAT_VERSION}")
    df = spark.read.parquet(f"{path}/build={build}")
    missing = {f.name for f in INDEX} - set(df.columns)
    if missing:
        raise ValueError(f"{path}: without {sorted(missing)}")
    return df


class Reader:
    """An index held open: it keeps its build until ``reload`` finds another, and then the one before too.

    ``rows`` of a build that is neither is None: the asker's row numbers are stale.  ``current_rows`` brings
    rows of either build to the current one and says who is stale.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.builds = spark, path, []
        self.reload()

    def reload(self) -> bool:
        """Whether there was a new build."""
        now = current_build(self.spark, self.path)
        if now is None or now in self.builds[:1]:
            return False
        self.builds = [now, *self.builds[:1]]
        return True

    def rows(self, build: str | None = None) -> DataFrame | None:
        build = build or (self.builds[0] if self.builds else None)
        return index_scan(self.spark, self.path, build) if build in self.builds else None


def row_map(spark: SparkSession, path: str, old: str, new: str) -> DataFrame:
    """(old_row, id, row): where the rows of a build are in another one; rows that it lacks are left out."""
    return index_scan(spark, path, old).select(F.col("row").alias("old_row"), "id").join(index_scan(spark, path, new).select("id", "row"), "id").select("old_row", "id", "row")


def current_rows(reader: Reader, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that askers hold, (query_id, build, row), by the current build: (query_id, id, row, how), and the (query_id) whose build is gone.

    Rows of the current build are ``kept``; those of the one before are ``mapped`` by id, unless the paper is gone.
    An asker of any other build is stale, and should get random rows (see feed.walks).
    """
    now, *before = reader.builds
    kept = asked.where(F.col("build") == now).join(index_scan(reader.spark, reader.path, now).select("row", "id"), "row").select("query_id", "id", "row", F.lit("kept").alias("how"))
    held = F.col("build").isin(*reader.builds)
    stale = asked.where(~F.coalesce(held, F.lit(False))).select("query_id").distinct()
    if before:
        moved = row_map(reader.spark, reader.path, before[0], now)
        old = asked.where(F.col("build") == before[0]).select("query_id", F.col("row").alias("old_row"))
        kept = kept.unionByName(old.join(moved, "old_row").select("query_id", "id", "row", F.lit("mapped").alias("how")))
    return kept, stale


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(i, line) of a text file, lines numbered from 0 in the file's order.

    Each split is numbered by its task; the counts of the splits, which is what comes to the
    driver, say where it begins.
    """

    def number(batches):
        block, i = None, 0
        for b in batches:
            start = b.column("block").to_numpy()
            out = np.empty(len(start), np.int64)
            for at, s in enumerate(start.tolist()):
                block, i = (block, i + 1) if s == block else (s, 0)
                out[at] = i
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(out), b.column("value")], ["block", "k", "line"])

    rows = spark.read.text(path).select(F.col("_metadata.file_block_start").alias("block"), "value").mapInArrow(number, "block long, k long, line string")
    begin, first = [], 0
    for block, n in sorted(rows.groupBy("block").agg(F.count(F.lit(1))).collect()):  # a row for each split
        begin.append((block, first))
        first += n
    starts = F.broadcast(spark.createDataFrame(begin, "block long, first long"))
    return rows.join(starts, "block").select((F.col("first") + F.col("k")).alias("i"), "line")


def paired(spark: SparkSession, papers_path: str, matrix_path: str, dim: int) -> DataFrame:
    """Papers of a JSON-lines file with the row of a float matrix that has their line's number; both must have as many.

    Excluded papers are dropped with their rows.
    """
    lines = numbered_lines(spark, papers_path).where("trim(line) <> ''")
    own = with_defaults(lines.select("i", F.from_json("line", PAPER, {"mode": "FAILFAST"}).alias("p")).select("p.*", F.col("i").alias("seq_")).drop("seq").withColumnRenamed("seq_", "seq"))
    vectors = matrix(spark, matrix_path, dim).select("i", "embedding")
    n, m = own.count(), vectors.count()
    if n != m:
        raise ValueError(f"{n} papers and {m} rows")
    return own.join(vectors, own["seq"] == vectors["i"]).drop("i").where(~F.col("excluded"))


def lookup(df: DataFrame, ids: list[str], id: str = "id", most: int = 500) -> DataFrame:
    """Rows of the given ids (123, W123 or an address); at most ``most`` are looked up, and the filter reaches the scan."""
    spark = df.sparkSession
    wanted = [r[0] for r in spark.createDataFrame([(i,) for i in ids[:most]], "s string").select(parse_id(F.col("s"))).collect()] if ids else []
    return df.where(F.col(id).isin(*[w for w in wanted if w is not None])) if wanted else df.limit(0)
