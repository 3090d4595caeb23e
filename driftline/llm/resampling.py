"""Importance resampling towards a target distribution (operator 12), Spark SQL throughout.

Texts become hashed n-gram features.  Bucket counts of the corpus and of the target give each bucket
a gain, the log of its share in the target over its share in the corpus; gains go out as a
broadcast table (one row a bucket) and are summed by document.  Gumbel noise by document makes the
highest scores a draw without replacement.  Scores are put in order by ranges, and a row's rank
is its place in its partition after the rows of the partitions before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.linededup import LOWER, UPPER
from driftline.llm.textblocks import stored

BUCKETS, SIZES, SEED = 10_000, 3, "42"
#: Documents need so many words to be drawn, and so many in a hundred of them are.
MIN_WORDS, PERCENT = 20, 5
#: Buckets at most, as their gains are broadcast (16 bytes each).
MOST_BUCKETS = 1 << 20
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; null without any."""
    spaced = F.btrim(F.translate(text, UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS)), F.lit(" "))
    return F.when(spaced != "", F.split(spaced, " +"))


def _count(words: Column, sizes: int) -> Column:
    n = F.coalesce(F.size(words), F.lit(0)).cast("long")
    return reduce(lambda a, k: a + F.greatest(n - k, F.lit(0)), range(1, sizes), n)


def features(docs: DataFrame, buckets: int = BUCKETS, sizes: int = SIZES, carry: tuple[str, ...] = ()) -> DataFrame:
    """The columns in ``carry`` and ``bucket`` for each feature of ``words``: runs of 1 to ``sizes`` words joined by one space.

    Places where no run begins give rows with a null bucket, so rows without words are kept.
    """
    each = docs.select(*carry, "words", F.posexplode_outer("words").alias("pos", "w"))
    runs = [F.col("w")]
    for k in range(1, sizes):
        runs.append(F.concat(runs[-1], F.lit(" "), F.get("words", F.col("pos") + k)))  # null beyond the end
    grams = each.select(*carry, F.explode(F.array(*runs)).alias("gram"))
    return grams.select(*carry, F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def _with_words(docs: DataFrame, id: str | None, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), *([F.col(f"`{id}`").alias("id")] if id else []), words(F.col(f"`{text}`")).alias("words"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", buckets: int = BUCKETS, sizes: int = SIZES) -> DataFrame:
    """(bucket, gain) for each bucket: floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))).

    s and t are the bucket's features in ``docs`` and in ``target``, S and T all of them.
    """
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")
    count = lambda df, c, name: features(_with_words(df, None, c), buckets, sizes).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias(name))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(count(docs, text, "s"), "bucket", "left").join(count(target, target_text, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    both = stored(both, "bucket-counts", small=True)
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).first()
    d = lambda x: x.cast("double")
    ratio = d(F.col("t") + 1) * d(F.lit(total["all_s"] + buckets)) / (d(F.col("s") + 1) * d(F.lit(total["all_t"] + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gain: DataFrame, id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, sizes: int = SIZES) -> DataFrame:
    """(row, id, n_words, n_features, weight) for each row of ``docs``; ``row`` tells rows of equal ids apart."""
    own = _with_words(docs, id, text).select("row", "id", "words", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words"), _count(F.col("words"), sizes).alias("n_features"))
    keys = ("row", "id", "n_words", "n_features")
    met = features(own, buckets, sizes, keys).join(F.broadcast(gain), "bucket", "left")
    return met.groupBy(*keys).agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))


def noise(id: Column, seed: str = SEED) -> Column:
    """floor(-1000 * ln(-ln(u))) for u from the first 32 bits of sha256(``seed:id``)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place from 1 in ``order`` as ``name``: sorted by ranges, each partition's rows counted from where the one before ends.

    What comes to the driver is a count for each partition.  ``order`` should settle ties, as
    rows that tie may be cut by a range.
    """
    place = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    starts, before = [], 0
    for p, n in sorted(place.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((p, before))
        before += n
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "_part long, _start long"))
    inner = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return place.withColumn("_part", part).join(first, "_part").withColumn(name, F.col("_start") + inner + 1).drop("_at", "_part", "_start")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    buckets: int = BUCKETS,
    sizes: int = SIZES,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_features, weight, score, rank.

    ``weight`` sums the gains of the row's features (none: 0); ``score`` adds the noise of its id.  Of the N
    rows with at least ``min_words`` words and an id, the floor(percent * N / 100) highest scores are
    drawn, ties to the smaller id; ``rank`` counts them from 1 and is null for all others.

    Null or empty text, or text of separators alone: no words.  A null id has no score and is never
    drawn.  Rows that repeat an id are drawn each on its own text (ties to the larger weight, then to
    fewer features; equal rows in any order).  An empty target or corpus counts as 0 in every
    bucket.  Texts are taken whole, whatever their length; other columns are ignored.
    """
    weighed = weigh(docs, gains(docs, target, text, target_text, buckets, sizes), id, text, buckets, sizes)
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scored")
    can = F.col("score").isNotNull() & (F.col("n_words") >= min_words)
    n = scored.where(can).count()
    order = [F.desc("score"), F.asc("id"), F.desc("weight"), F.asc("n_features"), F.asc("row")]
    drawn = ranked(scored.where(can), order, "rank").withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = scored.where(~can).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("id").alias(id), "n_words", "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, result: DataFrame, id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose ids ``resample`` has drawn, with score and rank (of the best row, where an id repeats)."""
    best = result.where("rank is not null").groupBy(F.col(f"`{id}`").alias("_drawn")).agg(F.min("rank").alias("_rank"), F.max("score").alias("_score"))
    return docs.join(best, F.col(f"`{id}`") == F.col("_drawn")).drop("_drawn")
