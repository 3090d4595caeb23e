"""Quality rules with cross-document line frequency (operator 7).

Base figures come from each text alone.  Boilerplate comes from all of them: normalised
lines are hashed, distinct documents are counted for each host and line, lines above the limits
are taken out, and a document that loses most of its words that way is depleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.textblocks import CODES, CODES_LOWER, lean, lists, mix, shingle_hashes, span_hashes, stored, text_blocks, words

MIN_WORDS = 50
#: A line goes if more than so many documents of a host have it, and these are more than this share of the host's, or more than so many at any share.
LINE_DOCS = 20
LINE_SHARE = 0.02
LINE_MOST = 1000
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.3
#: Frequent lines of all hosts are sent to the workers if they are no more than this (8 bytes each); else lines are joined with them.
SEND_LINES = 1_000_000
#: Parts that the lines of a host and key are dealt in for that join.
SALTS = 32
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Flags of keys found twice or more."""
    order = np.argsort(keys)
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def block_figures(buf: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Figures by row, and (hash, words, row) of the lines that have words."""
    starts, ends, first = words(buf, offsets)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    begin_char = (buf & 0xC0) != 0x80  # a code point begins
    points = np.concatenate([[0], np.cumsum(begin_char & True, dtype=np.int64)]) if len(buf) else np.zeros(1, np.int64)
    out = {"n_words": np.diff(first), "word_chars": _per_row(points[ends] - points[starts], first), "n_symbols": _per_row(SYMBOLS[buf], offsets)}
    del points, begin_char
    # words in 3-word windows found twice or more in the same text
    hashes = span_hashes(buf, starts, ends)
    three = shingle_hashes(hashes, 3)
    flags = np.zeros(len(hashes), bool)
    if len(three):
        inside = np.flatnonzero(row[2:] == row[:-2])
        again = inside[_repeated(three[inside] ^ mix(row[inside].astype(np.uint64), 7))]
        for k in range(3):
            flags[again + k] = True
    out["n_repeat_words"] = _per_row(flags, first)
    # lines; a row's end ends a line
    cuts = np.unique(np.concatenate([np.flatnonzero(buf == 10), offsets[1:] - 1])) if len(buf) else np.zeros(0, np.int64)
    cuts = cuts[cuts >= 0]
    low = np.concatenate([[0], cuts[:-1] + 1]) if len(cuts) else cuts
    high = np.where(buf[cuts] == 10, cuts, cuts + 1) if len(cuts) else cuts
    a, b = np.searchsorted(starts, low), np.searchsorted(starts, high)
    some = b > a
    low, high, a, b = low[some], high[some], a[some], b[some]
    line_row = row[a]
    exact = span_hashes(buf, low, high, CODES) ^ mix(line_row.astype(np.uint64), 9)
    order = np.lexsort((low, exact))
    dup = np.zeros(len(low), bool)
    if len(order):
        dup[order[1:]] = exact[order[1:]] == exact[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_row[dup], minlength=rows)
    # the normalised line: from its first word to its last, A-Z lower-cased
    normal = span_hashes(buf, starts[a], ends[b - 1], CODES_LOWER)
    return out, normal, b - a, line_row


def figures(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """row (a number of its own), id, host, the base figures, and the normalised lines as arrays line_keys and line_words."""
    own = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    kind, host_kind = (own.schema[c].dataType.simpleString() for c in ("id", "host"))

    def run(batches: Iterator[pa.RecordBatch]):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, buf, offsets, _ in text_blocks(batch.column(2)):
                out, key, size, row = block_figures(buf, offsets)
                n = np.bincount(row, minlength=len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(n))), *(batch.column(k).slice(at, len(n)) for k in (0, 1)), *(pa.array(out[c].astype(np.int64)) for c in BASE_COLUMNS), lists(key.view(np.int64), n, pa.int64()), lists(size.astype(np.int32), n, pa.int32())], ["row", "id", "host", *BASE_COLUMNS, "line_keys", "line_words"])
                number += len(n)

    return own.mapInArrow(lean(run), f"row long, id {kind}, host {host_kind}, {', '.join(c + ' long' for c in BASE_COLUMNS)}, line_keys array<long>, line_words array<int>")


def pair_hashes(site: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(mix(site.view(np.uint64), 61) ^ key.view(np.uint64), 62)


def frequent_words(base: DataFrame, frequent: DataFrame, send_lines: int = SEND_LINES) -> DataFrame:
    """``base`` with n_frequent_words, the words of the lines in ``frequent`` (site, key); no host or line goes to one task."""
    if frequent.count() <= send_lines:
        got = frequent.toArrow()
        pairs = np.unique(pair_hashes(*(got.column(c).to_numpy() for c in ("site", "key"))))
        shared = base.sparkSession.sparkContext.broadcast(pairs)

        def run(batches: Iterator[pa.RecordBatch]):
            pairs = shared.value
            for b in batches:
                n = np.asarray(b.column("line_keys").value_lengths())
                ends = np.concatenate([[0], np.cumsum(n)])
                own = pair_hashes(np.repeat(np.asarray(b.column("site")), n), np.asarray(b.column("line_keys").flatten()))
                at = np.searchsorted(pairs, own)
                hit = np.zeros(len(own), bool)
                inside = at < len(pairs)
                hit[inside] = pairs[at[inside]] == own[inside]
                lost = _per_row(np.where(hit, np.asarray(b.column("line_words").flatten()), 0), ends)
                yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(c) for c in BASE_COLUMNS), pa.array(lost)], ["id", *BASE_COLUMNS, "n_frequent_words"])

        return base.mapInArrow(lean(run), f"id {base.schema['id'].dataType.simpleString()}, {', '.join(c + ' long' for c in (*BASE_COLUMNS, 'n_frequent_words'))}")
    lines = base.select("row", "site", F.explode(F.arrays_zip("line_keys", "line_words")).alias("x")).select("row", "site", F.col("x.line_keys").alias("key"), F.col("x.line_words").alias("n"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    salted = frequent.select("site", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    lost = lines.join(salted, ["site", "key", "salt"]).groupBy("row").agg(F.sum("n").alias("n_frequent_words"))
    return base.join(lost, "row", "left").select("id", *BASE_COLUMNS, F.coalesce("n_frequent_words", F.lit(0)).alias("n_frequent_words"))


def judge(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    line_docs: int = LINE_DOCS,
    line_share: float = LINE_SHARE,
    line_most: int = LINE_MOST,
    left_share: float = LEFT_SHARE,
    send_lines: int = SEND_LINES,
) -> DataFrame:
    """One row for each row of ``docs``: id, the base figures, n_frequent_words, base_failed, depleted, kept.

    A line with words (key: from first word to last, A-Z lower-cased) is frequent if more
    than ``line_docs`` documents of its host have it, and these are more than ``line_share`` of the
    host's documents or more than ``line_most``.  Without them a document keeps n_words -
    n_frequent_words; with less than ``left_share`` of its words left it is depleted.
    ``base_failed``: fewer than 50 words, or more than half of them in repeated 3-word windows.

    Null text: no words, base_failed.  A null host is a host like any other.  Rows that repeat
    an id count as documents of their own.  Other columns are ignored.
    """
    base = stored(figures(docs, id, text, host).withColumn("site", F.xxhash64("host", F.isnull("host"))), "figures")
    holders = base.select("site", F.explode(F.array_distinct("line_keys")).alias("key")).groupBy("site", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > line_docs)
    sizes = base.groupBy("site").agg(F.count(F.lit(1)).alias("docs"))
    frequent = stored(holders.join(sizes, "site").where((F.col("n") > line_share * F.col("docs")) | (F.col("n") > line_most)).select("site", "key"), "frequent", small=True)
    return (
        frequent_words(base, frequent, send_lines)
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("depleted", F.col("n_words") - F.col("n_frequent_words") < left_share * F.col("n_words"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .withColumnRenamed("id", id)
    )
