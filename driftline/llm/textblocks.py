"""Arrow text columns as flat numpy byte arrays, and the hashes made from them.

Everything here works on whole texts.  Long columns are cut into blocks of whole
rows, so memory follows the block size (or the longest single text), never the
partition size.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text handled at a time; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes hashed at a time within a block.
HASH_BYTES = 1 << 19

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
#: One random 64-bit code for each byte; with and without A-Z lower-cased.
CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CODES_LOWER = CODES.copy()
CODES_LOWER[65:91] = CODES[97:123]
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_libc = ctypes.CDLL(None)


def trim() -> None:
    """Give freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with freed memory given back after each batch."""

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            trim()

    return lambda batches: run(source(batches))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls while they are short."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, HASH_BYTES + 4096)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done, step = 1, base
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = have[:more] * np.uint64(step)
            done, step = done + more, step * step % (1 << 64)
        if size <= 4 * HASH_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets, null flags) for runs of rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    nulls = np.asarray(column.is_null()) if column.null_count else np.zeros(n, bool)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], nulls[i:j]
        i = j


def words(buf: np.ndarray, offsets: np.ndarray, separates: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words, ``[^\\x20\\x09-\\x0D]+`` unless other bytes separate; first[r] is the index of row r's first word."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~separates[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:n]
    closes = solid
    closes[:-1] &= ~solid[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """A 64-bit hash of each of the disjoint ascending spans; equal bytes, equal hash."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + HASH_BYTES, "right")))
        piece = buf[at : ends[j - 1]]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(codes[piece] * powers(BASE, len(piece)), out=sums[1:])
        a = starts[i:j] - at
        out[i:j] = (sums[ends[i:j] - at] - sums[a]) * powers(BASE_INVERSE, len(piece) + 1)[a]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = (total ^ word_hashes[k : k + n]) * np.uint64(0x9FB21C651E98DF25 + 2 * k)
        total ^= total >> np.uint64(29)
    return mix(total)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and the length of each list."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    The setting is read from the session; only where it is unset and the master is a single
    process, as in tests, a folder under /tmp/checkpoints stands in for it.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file:///tmp/checkpoints"
    return f"{folder.rstrip('/')}/driftline-llm/{conf.get('spark.app.id', 'app')}/{name}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> bool:
    """Remove all intermediate tables of this session; results that were not written elsewhere are gone then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "x").rsplit("/", 1)[0])
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a batch that goes to a worker while a table is stored; whole texts are long, and both sides hold some batches at a time.
BATCH_ROWS = 2_000
#: Bytes of input, about, that a task of a stage with ``small`` results takes at least.
TASK_BYTES = 32 << 20


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Batches of ``rows`` rows at most for what runs within; the session's own setting holds again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        if int(before) <= 0 or int(before) > rows:
            spark.conf.set(name, str(rows))
        yield
    finally:
        spark.conf.set(name, before)


def input_bytes(df: DataFrame) -> int:
    """The size of the tables that a plan reads; very large if one doesn't tell."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def stored(df: DataFrame, name: str, small: bool = False, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and a lost executor costs nothing.

    A stage with ``small`` results puts tiny partitions together, up to ``TASK_BYTES`` of its input a task and
    no fewer than four tasks a core, as it would else write many tiny files; larger ones stay as they are.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if small:
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, min(1 << 30, -(-input_bytes(df) // TASK_BYTES))))
    out = df.write.option("compression", codec) if codec else df.write
    with small_batches(spark):
        out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
