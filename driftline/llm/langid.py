"""Language identification by rank-order profiles (operator 9).

A profile is the list of the most frequent character n-grams.  A document goes to the
language whose profile is nearest by out-of-place distance: the sum, over the document's
own most frequent n-grams, of how far each is from its place in the language's profile,
with a fixed penalty for those not in it (Cavnar and Trenkle, 1994).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.textblocks import lean

#: n-grams in a profile, and the longest n-gram.
PROFILE = 400
LONGEST = 3
#: Labelled documents read for each language at most, those with the smallest id hashes.
TRAIN_PER_LANGUAGE = 2000
#: Characters of a text turned into n-grams at a time.
PIECE = 1 << 18
UNKNOWN = "und"
BITS = 21  # a code point


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """For code points: the lower-case letter, or a space for all that is no letter."""
    import sys
    import unicodedata

    table = np.full(sys.maxunicode + 1, 32, np.uint64)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if unicodedata.category(s)[0] == "L":
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of all n-grams of 1..longest; words stand between single spaces, and no n-gram has a space inside."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    folded = fold_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    line = np.concatenate([[np.uint64(32)], folded[keep], [np.uint64(32)]])
    for low in range(0, len(line), PIECE):
        part = line[low : low + PIECE + longest - 1]
        own = min(PIECE, len(line) - low)
        codes = np.zeros(len(part), np.uint64)
        space = part == 32
        inner = np.zeros(len(part), bool)  # a space that is not the first
        for n in range(1, longest + 1):
            size = len(part) - n + 1
            if size <= 0:
                break
            codes = codes[:size] << np.uint64(BITS) | part[n - 1 :]
            if n == 1:
                good = ~space
            else:
                if n > 2:
                    inner = inner[:size] | space[n - 2 : n - 2 + size]
                else:
                    inner = np.zeros(size, bool)
                good = ~inner[:size] & ~(space[:size] & space[n - 1 :])
            got = np.sort(codes[:own][good[:own]])
            if len(got):
                new = np.flatnonzero(np.concatenate([[True], got[1:] != got[:-1]]))
                keys.append(got[new])
                counts.append(np.diff(np.append(new, len(got))))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


def ranked(key: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first, ties to the smaller code."""
    if len(key) > size:
        least = np.partition(count, len(count) - size)[len(count) - size]
        some = count >= least
        key, count = key[some], count[some]
    return key[np.lexsort((key, -count))][:size]


@dataclass
class Profiles:
    """Languages and, for every n-gram of any profile, its rank in each (the penalty where it has none)."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, lists: dict[str, np.ndarray], size: int = PROFILE) -> Profiles:
        names = sorted(lists)
        codes = np.unique(np.concatenate([lists[x] for x in names])) if names else np.zeros(0, np.uint64)
        ranks = np.full((len(names), len(codes) + 1), size, np.int64)
        for k, name in enumerate(names):
            ranks[k, np.searchsorted(codes, lists[name])] = np.arange(len(lists[name]))
        return cls(names, codes, ranks, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is 1 for the profile itself and 0 for a text with none of its n-grams; ties to the smaller name."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(*grams(text), self.size)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[(at >= len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        there = self.ranks[:, at]
        apart = np.where(there == self.size, self.size, np.abs(there - np.arange(len(own))))
        total = apart.sum(1)
        k = int(total.argmin())
        return self.languages[k], 1 - float(total[k]) / (self.size * len(own))


def held_out(value) -> bool:
    """Whether an id belongs to the third that nothing is learned from."""
    return zlib.crc32(str(value).encode()) % 3 == 1


def training_rows(rows: DataFrame, per_language: int) -> DataFrame:
    """(lang, text) of ``per_language`` ids of each language at most, those with the smallest hashes; of an id's texts the least.

    No texts but these are moved: ids are counted by language, their hashes below a bound that leaves
    somewhat more than are wanted are gathered, and the last wanted one is the limit for texts.
    """
    hashed = rows.withColumn("place", F.pmod(F.xxhash64("id"), F.lit(1 << 52)))
    least = 1.25 * per_language + 10 * per_language**0.5 + 10  # more than per_language pass this, all but surely
    some = hashed.groupBy("lang").agg((F.lit(least * (1 << 52)) / F.approx_count_distinct("id", 0.02)).alias("bound"))
    limits = hashed.select("lang", "place").join(F.broadcast(some), "lang").where("place <= bound").groupBy("lang").agg(F.array_sort(F.collect_set("place")).alias("places"))
    limits = limits.select("lang", F.coalesce(F.get("places", F.lit(per_language - 1)), F.lit(1 << 52)).alias("limit"))
    # both broadcasts have a row for each language, like the profiles themselves
    chosen = hashed.join(F.broadcast(some), "lang").join(F.broadcast(limits), "lang").where("place <= limit and place <= bound")
    return chosen.groupBy("lang", "id").agg(F.min("text").alias("text")).select("lang", "text")


def learn(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, size: int = PROFILE, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of the languages among rows with id, text and language, held-out ids left out.

    Each language's ``per_language`` ids with the smallest hashes are read, their texts whole; the
    n-gram counts are summed on the executors and the profiles alone come to the driver.
    """
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
    sample = training_rows(rows, per_language)

    def count(batches: Iterator[pa.RecordBatch]):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                key, n = grams(value.as_py())
                k0, n0 = total.get(name.as_py(), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                both, inverse = np.unique(np.concatenate([k0, key]), return_inverse=True)
                total[name.as_py()] = both, np.bincount(inverse, np.concatenate([n0, n]), len(both)).astype(np.int64)
        for name, (key, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("place") <= size)
    lists: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "place").collect():  # size rows for each language
        lists.setdefault(r["lang"], []).append(r["gram"])
    return Profiles.of({k: np.array(v, np.uint64) for k, v in lists.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score, held_out for each row, and the columns named in ``keep``.

    Only the text is used.  Null texts, texts without a letter, and all texts if nothing was
    learned: ``und`` with score 0.  Rows are independent; ids may repeat or be null.
    """
    own = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            got = [profiles.predict(t.as_py()) for t in batch.column(1)]
            out = [batch.column(0), pa.array([held_out(i.as_py()) if i.is_valid else False for i in batch.column(0)], pa.bool_()), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*out, *batch.columns[2:]], ["id", "held_out", "lang_pred", "score", *[f"k{i}" for i in range(len(keep))]])

    more = "".join(f", k{i} {own.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    return own.mapInArrow(lean(run), f"id {kind}, held_out boolean, lang_pred string, score double{more}").withColumnsRenamed({"id": id} | {f"k{i}": c for i, c in enumerate(keep)})
