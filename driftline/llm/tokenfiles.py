"""Token ids in binary files (operator 10): frequency-ranked ids in byte-aligned codes.

Files of a folder:

    ranks   (rank, id) rows: the ids that occur, most frequent in all documents first
    blocks  rows of a part, a block in it, and the block's bytes

Format of a block (all numbers little-endian):

    "VTK2"  u32 documents  u32 ids  u32 data bytes
    i64 document ids, u8 flags (1: the id is null), u32 ids of each document
    control bytes: two bits for each id, four ids a byte, low bits first: bytes of its rank - 1
    data bytes: ranks, one to four bytes each, low byte first

Texts are encoded once; their ids, and not they, are counted and put in order.  Both kinds of
rows are in Parquet files, one file of blocks for each range of document ids, so the writer's
commit protocol, and not this module, sees to lost executors and half-written files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.textblocks import lean, shared_path, stored, text_blocks
from driftline.llm.tokens import encoder, tokenizer

MAGIC = b"VTK2"
END_ID = 2
HEAD = struct.Struct("<4s3I")
#: Bytes of ids in a block, about; a longer document makes a block of its own.
BLOCK_IDS = 1 << 19
#: Bytes of each of the four ids of a control byte.
SIZES = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1
SCHEMA = "part int, block int, first_start long, n_docs long, n_ids long, payload binary"


def ranking(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank table: ids, most frequent first, ties to the smaller id; rank of each id up to the largest)."""
    table = ids[np.lexsort((ids, -counts))].astype(np.uint32)
    rank = np.zeros(int(table.max()) + 1 if len(table) else 0, np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)
    return table, rank


def pack_ids(ids: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of ids."""
    value = rank[ids]
    size = 1 + (value > 0xFF).astype(np.uint8) + (value > 0xFFFF) + (value > 0xFFFFFF)
    bits = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    bits[: len(ids)] = size - 1
    control = (bits.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    at = np.cumsum(size, dtype=np.int64) - size
    data = np.zeros(int(size.sum(dtype=np.int64)), np.uint8)
    data[at] = value & 0xFF
    for k in (1, 2, 3):
        some = np.flatnonzero(size > k)
        data[at[some] + k] = value[some] >> (8 * k) & 0xFF
    return control, data


def unpack_ids(table: np.ndarray, control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ids back, by table lookup of control bytes."""
    size = SIZES[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    value = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        some = np.flatnonzero(size > k)
        value[some] |= data[at[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return table[value]


def pack_block(doc_ids: np.ndarray, null: np.ndarray, lengths: np.ndarray, ids: np.ndarray, rank: np.ndarray) -> bytes:
    control, data = pack_ids(ids, rank)
    head = HEAD.pack(MAGIC, len(doc_ids), len(ids), len(data))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), lengths.astype("<u4").tobytes(), control.tobytes(), data.tobytes()])


def unpack_block(payload: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, null flags, lengths, ids); raises ValueError where the payload is no whole block."""
    magic, docs, n, size = HEAD.unpack_from(payload)
    at, parts = HEAD.size, []
    for kind, many in (("<i8", docs), ("u1", docs), ("<u4", docs), ("u1", -(-n // 4)), ("u1", size)):
        parts.append(np.frombuffer(payload, kind, many, at))
        at += parts[-1].nbytes
    if magic != MAGIC or at != len(payload):
        raise ValueError("not a block of token ids")
    doc_ids, null, lengths, control, data = parts
    return doc_ids, null.astype(bool), lengths.astype(np.int64), unpack_ids(table, control, data, n)


def raw_kind(tokenizer_file: str, end_id: int = END_ID) -> str:
    """The shortest kind of number for the ids of a tokenizer and the end id."""
    return "<u2" if max(end_id, *tokenizer(tokenizer_file).get_vocab(True).values()) < 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, version, row, ids) of each document: its text's hash, a number of its own, and its ids with the end id, as numbers of ``raw_kind``."""
    kind = np.dtype(raw_kind(tokenizer_file, end_id))

    def run(batches: Iterator[pa.RecordBatch]):
        enc, number = encoder(tokenizer_file), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, buf, offsets, _ in text_blocks(batch.column(2)):
                ids, ends = enc.encode(buf, offsets)
                ids, n = np.insert(ids, ends[1:], end_id).astype(kind), np.diff(ends) + 1
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], kind.itemsize * np.cumsum(n)]).astype(np.int64)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), batch.column(1).slice(at, len(n)), pa.array(number + np.arange(len(n))), raw.cast(pa.binary())], ["id", "version", "row", "ids"])
                number += len(n)

    own = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("version"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(lean(run), "id long, version long, row long, ids binary")


def _counts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for _, buf, _, _ in text_blocks(batch.column(0)):
                now = np.bincount(np.frombuffer(buf.tobytes(), kind))
                if len(now) > len(total):
                    now, total = total, now
                total[: len(now)] += now
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    return run


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, id: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write ranks and blocks to ``path``, documents in ascending order of id.

    Null or empty text: the end id alone.  Null ids come first, and rows that repeat an id
    stand together, ordered by their text's hash; they may go on in the next file.  Other
    columns are ignored; an empty table writes no block.
    """
    spark = docs.sparkSession
    rows = stored(encoded(docs, tokenizer_file, end_id, id, text), "encoded", small=True, codec="zstd")
    kind = np.dtype(raw_kind(tokenizer_file, end_id))
    counted = rows.select("ids").mapInArrow(lean(_counts(kind.str)), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each token of the vocabulary at most
    table, rank = ranking(*(counted.column(c).to_numpy() for c in ("id", "n")))
    spark.createDataFrame(list(enumerate(table.tolist())), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    shared = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]):
        part, block, first = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            keys = batch.column(0)
            doc_ids, null = np.asarray(keys.fill_null(0)), np.asarray(keys.is_null())
            for at, buf, offsets, _ in text_blocks(batch.column(1), BLOCK_IDS):
                ids, n = np.frombuffer(buf.tobytes(), kind).astype(np.uint32), np.diff(offsets) // kind.itemsize
                rows = slice(at, at + len(n))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([len(n)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pack_block(doc_ids[rows], null[rows], n, ids, shared.value)], pa.binary())], [c.split()[0] for c in SCHEMA.split(", ")])
                block, first = block + 1, first + len(ids)

    order = ("id", "version", "row")  # the last two split an id with very many rows
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "ids")
    ordered.mapInArrow(lean(run), SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents of the files: id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids)."""
    ranks = spark.read.schema("rank long, id long").parquet(f"{path}/ranks").orderBy("rank").toArrow()
    shared = spark.sparkContext.broadcast(ranks.column("id").to_numpy().astype(np.uint32))
    blocks = spark.read.schema(SCHEMA).parquet(f"{path}/blocks")
    totals = dict(blocks.groupBy("part").agg(F.sum("n_ids")).collect())  # a number for each file
    before, total = {}, 0
    for part in sorted(totals):
        before[part], total = total, total + totals[part]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part, first, payload in zip(*(batch.column(k) for k in ("part", "first_start", "payload")), strict=True):
                doc_ids, null, n, ids = unpack_block(payload.as_buffer(), shared.value)
                ends = np.cumsum(n)
                raw = ids.astype("<u4", copy=False)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                out = [pa.array(doc_ids, pa.int64(), mask=null), pa.array(before[part.as_py()] + first.as_py() + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, ["id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return blocks.select("part", "first_start", "payload").mapInArrow(lean(run), "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids).withColumnRenamed("id", id)


def write_and_read(docs: DataFrame, tokenizer_file: str, end_id: int = END_ID, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``write`` to ``path`` (by default a new one in the shared folder), then ``read``."""
    path = path or shared_path(docs.sparkSession, "token-files")
    write(docs, path, tokenizer_file, end_id, id, text)
    return read(docs.sparkSession, path, id)
