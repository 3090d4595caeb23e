"""Packing documents into training sequences by non-negative least squares (operator 8).

Every document is cut into full windows and one remainder.  Remainders are packed on the
histogram of their lengths alone (at most ``window`` numbers): shallow combinations that fill
a window are enumerated, repeat counts solved by non-negative least squares against the
histogram and rounded down, and what is left is packed greedily, still on the histogram.
Pieces then find their place from their rank within their length; a length is ranked in parts
by its count, so no task sees more than its share and the driver sees only the histogram, the
plan and the sizes of the parts (``MOST_PARTS`` numbers and one for each length at most).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.textblocks import lean, stored, text_blocks
from driftline.llm.tokens import encoder

WINDOW = 2048
END_ID = 1
#: Most frequent lengths that triples are built from.
TRIPLE_BASE = 24
#: Pieces of one length that are ranked together, until there would be so many parts in all; then more.
PART_ROWS = 512
MOST_PARTS = 65_536
#: Rounds of the solver at most, and the share by which a round must still lower the squared error.
ROUNDS, LEAST_GAIN = 2000, 1e-5


def pieces(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, start, length, ids_crc32, doc_tokens) of all pieces: full windows, then the remainder; ``row`` is a number of its own.

    A null or empty text has the end id alone.  Rows that repeat an id, or have none, are
    documents of their own.  Other columns are ignored.
    """
    own = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        enc, number = encoder(tokenizer_file), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, buf, offsets, _ in text_blocks(batch.column(1)):
                ids, ends = enc.encode(buf, offsets)
                n = np.diff(ends) + 1
                count = (n + window - 1) // window
                row = np.repeat(np.arange(len(n)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
                length = np.minimum(n[row] - start, window)
                last = start + length == n[row]
                raw, end = ids.astype("<u4", copy=False), np.array([end_id], "<u4").tobytes()
                low = ends[row] + start
                crc = [zlib.crc32(end, c) if z else c for c, z in zip((zlib.crc32(raw[a:b]) for a, b in zip(low.tolist(), (low + length - last).tolist(), strict=True)), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(row))), batch.column(0).take(pa.array(at + row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(n[row], pa.int64())], ["row", "id", "start", "length", "ids_crc32", "doc_tokens"])
                number += len(row)

    return own.mapInArrow(lean(run), f"row long, id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(count: np.ndarray, window: int, base: int = TRIPLE_BASE) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill a window exactly, from lengths that occur."""
    have = np.flatnonzero(count)
    have = have[have > 0]
    present = np.zeros(window + 1, bool)
    present[have] = True
    rows = [np.array([[window, 0, 0]], np.int64)]
    a = have[(have < window) & (have >= window - have)]
    a = a[present[window - a]]
    rows.append(np.stack([a, window - a, np.zeros_like(a)], 1))
    often = have[np.argsort(-count[have], kind="stable")][:base]
    a, b = (x.ravel() for x in np.meshgrid(have, often, indexing="ij"))
    c = window - a - b
    ok = (c > 0) & present[np.clip(c, 0, window)]
    if ok.any():
        rows.append(np.unique(np.sort(np.stack([a, b, c], 1)[ok], 1)[:, ::-1], axis=0))
    return np.concatenate(rows)


def solve_repeats(combos: np.ndarray, count: np.ndarray, rounds: int = ROUNDS, gain: float = LEAST_GAIN) -> np.ndarray:
    """x >= 0 that minimises |A x - count|, A having the lengths of each combination (multiplicative updates, until they no longer gain)."""
    valid = combos > 0
    target = count.astype(float)
    x = np.where(valid, target[combos], np.inf).min(1) / 2 + 1e-9
    upper = np.where(valid, target[combos], 0).sum(1)
    used = np.unique(combos[valid])
    before = np.inf
    for _ in range(rounds):
        made = np.bincount(combos[valid], np.broadcast_to(x[:, None], combos.shape)[valid], len(count))
        error = float(((made - target)[used] ** 2).sum())
        if error >= before * (1 - gain):
            break
        before = error
        lower = np.where(valid, made[combos], 0).sum(1)
        x *= upper / np.maximum(lower, 1e-12)
    return x


def plan(count: np.ndarray, window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pieces as (length, how many) of a sequence, number of such sequences)]; uses every piece of the histogram once."""
    left = count.astype(np.int64).copy()
    out: list[tuple[list[tuple[int, int]], int]] = []

    def use(pattern: list[tuple[int, int]], times: int) -> None:
        for length, many in pattern:
            left[length] -= many * times
        out.append((pattern, times))

    combos = combinations(left, window)
    x = solve_repeats(combos, left)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 1:
            break
        lengths, many = np.unique(combos[k][combos[k] > 0], return_counts=True)
        times = min(int(x[k]), *(left[lengths] // many).tolist())
        if times > 0:
            use([(int(a), int(m)) for a, m in zip(lengths[::-1], many[::-1], strict=True)], times)
    # greedy: the longest piece left, then always the longest that still fits
    have = np.flatnonzero(left)
    while len(have):
        room, pattern, below = window, [], len(have)
        while below:
            below = int(np.searchsorted(have[:below], room, "right"))
            if not below:
                break
            length = int(have[below - 1])
            many = min(room // length, int(left[length]))
            pattern.append((length, many))
            room -= many * length
            below -= 1
        use(pattern, min(int(left[length]) // many for length, many in pattern))
        have = have[left[have] > 0]
    return out


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """Slots sorted by (length, first rank): which ranks of a length go where."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, many in pattern:
            low = taken.get(length, 0)
            rows.append((length, low, many, sequence, offset))
            taken[length] = low + many * times
            offset += length * many
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "low", "many", "sequence", "offset"), table.T, strict=True))


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their place: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding.

    Within a length, pieces are placed in the order in which they were cut.  Sequences have ``window`` ids at most; ``padding`` is what theirs lacks.  An empty table
    gives no pieces.  See ``pieces`` for nulls, repeated ids and clashing columns.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_file, window, end_id, id, text), "pieces", small=True)
    hist = np.zeros(window + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # window rows at most
        hist[length] = n
    patterns = plan(hist, window)
    slots = places(patterns)
    starts = np.concatenate([[0], np.cumsum([t for _, t in patterns])]).astype(np.int64)
    pad_of = np.array([window - sum(a * m for a, m in p) for p, _ in patterns], np.int64)
    # a rank within (length, part), plus the parts before it
    parts = -(-hist // max(PART_ROWS, int(hist.sum()) // MOST_PARTS))
    have = np.flatnonzero(hist)
    of_length = F.broadcast(spark.createDataFrame(list(zip(have.tolist(), parts[have].tolist(), strict=True)), "length long, parts long"))
    parted = cut.join(of_length, "length").withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    sizes = parted.groupBy("length", "part").count().toArrow()
    first = np.cumsum(parts) - parts
    held = np.zeros(int(parts.sum()), np.int64)
    held[first[sizes.column("length").to_numpy()] + sizes.column("part").to_numpy()] = sizes.column("count").to_numpy()
    before = np.cumsum(held) - held
    before -= np.repeat(np.append(before, 0)[first], parts)  # from the length's first part on
    shared = spark.sparkContext.broadcast((slots, starts, pad_of, first, before))
    ranked = parted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("row")) - 1)

    def place(batches: Iterator[pa.RecordBatch]):
        slots, starts, pad_of, first, before = shared.value
        key = slots["length"] << 44 | slots["low"]
        for b in batches:
            length, rank = (np.asarray(b.column(k)) for k in ("length", "rank"))
            rank = rank + before[first[length] + np.asarray(b.column("part"))]
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            inside = rank - slots["low"][at]
            sequence = slots["sequence"][at] + inside // slots["many"][at]
            offset = slots["offset"][at] + inside % slots["many"][at] * length
            padding = pad_of[np.searchsorted(starts, sequence, "right") - 1]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset), pa.array(padding)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding"])

    return (
        ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank")
        .mapInArrow(lean(place), f"id {cut.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long")
        .withColumnRenamed("id", id)
    )
