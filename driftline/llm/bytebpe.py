"""Byte-level BPE with the tiktoken library and a local rank file (operator 6)."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters encoded at a time.
PIECE_CHARS = 1 << 18
#: A single space between two characters that are not white space: whatever matched
#: before it ends there and the next match begins there, so texts may be cut at it.
SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file (base64 token, space, rank on each line)."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` in pieces that encode as they do within the whole; without a safe place a piece is longer."""
    at = 0
    while len(text) - at > limit:
        cut = SAFE.search(text, at + limit - 1)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_text(enc, text: str, limit: int = PIECE_CHARS) -> list[int]:
    """Ids of the whole text, without special tokens."""
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in pieces(text, limit):
        ids += enc.encode_ordinary(piece)
    return ids


def _local(path: str) -> str:
    return SparkFiles.get(path[len("sparkfile:") :]) if path.startswith("sparkfile:") else path


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of ``df`` plus ``out``, an array of ids.

    A null or empty text has no ids; rows are independent, so repeated rows and clashing
    names need nothing special (an input column named ``out`` is replaced).
    ``rank_file`` is a path that every executor can open, or ``sparkfile:NAME`` for a
    file handed out by ``SparkContext.addFile``.
    """

    @F.pandas_udf("array<int>")
    def ids(texts):
        enc = encoding(_local(rank_file), pattern)
        return texts.map(lambda t: encode_text(enc, t) if t else [])

    return df.withColumn(out, ids(F.col(f"`{text}`")))


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """All columns of ``df`` plus ``out``, the raw bytes of the ids (null ids: no bytes)."""

    @F.pandas_udf("binary")
    def raw(rows):
        enc = encoding(_local(rank_file), pattern)
        return rows.map(lambda x: b"" if x is None else enc.decode_bytes([int(i) for i in x]))

    return df.withColumn(out, raw(F.col(f"`{ids}`")))


def round_trip_digests(df: DataFrame, rank_file: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text and return digests only: id, n_tokens, ids_sha256, decoded_sha256, lossless.

    The same ``encode_text`` and raw-byte decoding as ``encode`` and ``decode``, in one pass
    over Arrow batches, so ids never travel back to the JVM.  Null texts count as empty; a
    null id stays null.
    """
    kind = df.select(F.col(f"`{id}`")).schema[0].dataType.simpleString()

    def run(batches):
        enc = encoding(_local(rank_file), pattern)
        for batch in batches:
            rows: list[tuple[int, str, str, bool]] = []
            for value in batch.column(1):
                s = value.as_py() or ""
                tokens = encode_text(enc, s)
                back = enc.decode_bytes(tokens)
                rows.append((len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), back == s.encode()))
            n, a, b, c = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.bool_())], ["id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"])

    return (
        df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
        .withColumnRenamed("id", id)
    )
