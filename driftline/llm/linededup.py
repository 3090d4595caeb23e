"""Line dedup across documents (operator 2), DataFrame functions only.

Lines become 128-bit hashes; the hashes are range-partitioned, sorted by hash,
document and position, and streamed past a window that remembers the first holder.
What comes back is a run-length coded keep bitmap for each document; texts do not
travel with the hashes.

Hot lines: one line may be in a third of all documents.  ``HOT_SLOTS`` hashes at most
are found hot in a sample; their first holder comes from a map-side aggregate and is
broadcast (``HOT_SLOTS`` rows of 40 bytes, whatever the input), so they skip the range
partitions.  They are the most frequent ones, so a hash beyond them has at most one line in
``HOT_SLOTS``, about.  Which hashes are treated as hot changes the route, not the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.textblocks import stored

MIN_KEY_CHARS = 10
HOT_SLOTS = 1024
#: One document in so many is looked at for hot lines.
HOT_SAMPLE = 64
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased (other letters as they are)."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(0x5DEECE66D), key).alias("b"))


def hashed_lines(text: Column, min_chars: int = MIN_KEY_CHARS) -> Column:
    """An array with a hash for each line; null for lines with a short key."""
    return F.transform(
        F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line_key),
        lambda k: F.when(F.length(k) >= min_chars, _hash(k)),
    )


def late_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """(id, version, late): for each text that loses lines, their positions from 0, ascending.

    ``version`` is the text's hash; it tells rows that repeat an id apart.
    """
    own = docs.where(F.col(f"`{id}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{id}`").alias("id"), F.xxhash64(f"`{text}`").alias("version"), F.col(f"`{text}`").alias("text"))
    # hashed once; the steps below read 40 bytes a line
    lines = stored(own.select("id", "version", F.posexplode(hashed_lines(F.col("text"), min_chars)).alias("pos", "h")).where("h is not null"), "lines")
    # which lines are hot is estimated from a sample; their first holder is exact
    hot_keys = lines.where(F.pmod(F.xxhash64("id"), F.lit(HOT_SAMPLE)) == 0).groupBy("h").count().where("count > 8").orderBy(F.desc("count"), "h").limit(HOT_SLOTS).select("h")
    hot = F.broadcast(lines.join(F.broadcast(hot_keys), "h", "left_semi").groupBy("h").agg(F.min("id").alias("first")))
    marked = lines.join(hot, "h", "left")
    late_hot = marked.where("first < id").select("id", "version", "pos")
    rest = marked.where("first is null").select("h", "id", "version", "pos").repartitionByRange("h").sortWithinPartitions("h", "id", "pos")
    by_hash = Window.partitionBy("h").orderBy("id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    late = rest.withColumn("first", F.first("id").over(by_hash)).where("first < id").select("id", "version", "pos")
    return late.unionByName(late_hot).groupBy("id", "version").agg(F.array_sort(F.collect_set("pos")).alias("late"))


def keep_bitmaps(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_KEY_CHARS, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: id, n_lines, n_dropped, keep_runs, the kept ``text`` if ``with_text``, and the columns in ``keep``.

    ``keep_runs`` is the run-length coded keep bitmap over lines: lengths of alternating
    runs, kept lines first (0 if the first line goes).  A line goes if its key has at least
    ``min_chars`` code points and a document with a smaller id has it too.

    Null or empty text: one empty line, kept.  A row with a null id keeps all its lines and
    makes no other row lose any.  Rows that repeat an id are judged alike, each on its own
    text; lines that repeat within the first holder stay.  Other columns are ignored.
    """
    late = late_lines(docs, id, text, min_chars).withColumnsRenamed({"id": "_id", "version": "_version"})
    own = docs.select(F.col(f"`{id}`").alias("_doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)])
    more = [f"_k{i}" for i in range(len(keep))]
    p, lines = F.col("_late"), F.col("_lines")
    before = lambda j: F.coalesce(F.get("_ends", j - 1), F.lit(-1))
    found = (
        own.join(late, (F.col("_doc") == F.col("_id")) & (F.xxhash64("_text") == F.col("_version")), "left")
        .select("_doc", F.split("_text", "\n", -1).alias("_lines"), F.coalesce("late", F.array().cast("array<int>")).alias("_late"), "_text", *more)
        .select(
            *["_doc", "_lines", "_late", "_text", *more],
            F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1) != x - 1, F.lit(True))).alias("_starts"),
            F.filter(p, lambda x, i: F.coalesce(F.get(p, i + 1) != x + 1, F.lit(True))).alias("_ends"),
        )
        .select(
            F.col("_doc").alias(id),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(p).cast("long").alias("n_dropped"),
            F.concat(F.flatten(F.transform("_starts", lambda s, j: F.array(s - before(j) - 1, F.get("_ends", j) - s + 1))), F.array(F.size(lines) - F.coalesce(F.get(p, F.size(p) - 1), F.lit(-1)) - 1)).alias("keep_runs"),
            *([lines, "_text"] if with_text else []),
            *more,
        )
    )
    kept = F.when(F.size("keep_runs") == 1, F.col("_text")).otherwise(kept_lines(lines, F.col("keep_runs")))
    return found.select(id, "n_lines", "n_dropped", "keep_runs", *([kept.alias(text)] if with_text else []), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)])


def kept_lines(lines: Column, keep_runs: Column) -> Column:
    """The lines that a run-length coded bitmap keeps, joined: its runs spread out to one flag a line."""
    flags = F.flatten(F.transform(keep_runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    return F.array_join(F.filter(lines, lambda line, i: F.get(flags, i)), "\n")


def drop_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_KEY_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep_bitmaps`` with the kept text of each row (null text: empty; all lines gone: empty)."""
    return keep_bitmaps(docs, id, text, min_chars, True, keep)
