"""Feeds: softmax sampling of candidates, exploration, random picks, for one user or a batch of them.

Random numbers are hashes of (seed, id), so a feed is reproducible and any engine can repeat it.  One
user's random rows come in the order of their hashes.  For a batch the rows are laid out once in that order,
as on a ring; each user starts at a place of their own and walks on, past what they have seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions.scalars import unit_hash
from driftline.operators.filters import Filter, count_matching, newest_pairs
from driftline.operators.order import ranked
from driftline.sources.shared import stored

CANDIDATES, TEMPERATURE, EXPLORE = 100, 0.05, 0.15


def sample(hits: DataFrame, k: int, seed: str, temperature: float = TEMPERATURE, id: str = "id") -> DataFrame:
    """(query_id, slot, id, score): k hits of each query without replacement, by softmax weights, in draw order.

    Keys ln(u) / exp((score - best) / T), largest first.  No more than k hits are taken as they are.
    """
    whole = Window.partitionBy("query_id")
    best, n = F.max("score").over(whole), F.count(F.lit(1)).over(whole)
    keyed = hits.withColumn("key", F.log(unit_hash(F.col(id), F.col("query_id"), F.lit(seed))) / F.exp((F.col("score") - best) / temperature)).withColumn("n", n)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.when(F.col("n") <= k, F.col("score")).otherwise(F.col("key"))), id)
    return keyed.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= k).select("query_id", "slot", id, "score")


#: A filter's rows are held as a pool if they are no more than this share of the index.
POOL_SHARE = 16


def pool(index: DataFrame, f: Filter) -> DataFrame | None:
    """The rows that match, stored for later picks, if they are one in POOL_SHARE or fewer; None if there are more, which a scan finds soon enough."""
    n, total = count_matching(index, f).first()
    return stored(f.apply(index), "pool") if n * POOL_SHARE <= total else None


def random_rows(index: DataFrame, k: int, seed: Column | str, f: Filter | None = None, skip: DataFrame | None = None, id: str = "id", held: DataFrame | None = None) -> DataFrame:
    """(id, place): k rows that match, in the order of their hashes; never fewer than there are.  ``held`` is the filter's pool."""
    rows = held if held is not None else f.apply(index) if f else index
    if skip is not None:
        rows = rows.join(skip.select(id).distinct(), id, "left_anti")
    u = unit_hash(F.col(id), F.lit(seed) if isinstance(seed, str) else seed)
    top = rows.select(id, u.alias("u")).orderBy("u", id).limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy("u", id))).select(id, "place")  # k rows


def next_feed(hits: DataFrame, index: DataFrame, k: int, seed: str, f: Filter | None = None, seen: DataFrame | None = None, explore: float = EXPLORE, id: str = "id") -> DataFrame:
    """(slot, id, score, reason) for one user: sampled hits, some slots swapped for random rows, topped up to k.

    Hits are candidates of one query.  A slot is swapped if its hash is below ``explore``; the
    pick it had stays taken.  Random rows match the filter and are neither seen nor taken.
    """
    picked = sample(hits, k, seed, id=id)
    swap = unit_hash(F.lit(seed), F.lit("x"), F.col("slot")) < explore
    slots = picked.withColumn("swap", swap).withColumn("turn", F.when(F.col("swap"), F.sum(F.col("swap").cast("int")).over(Window.orderBy("slot"))))  # k rows
    taken = picked.select(id) if seen is None else picked.select(id).union(seen.select(id))
    pool = random_rows(index, 2 * k, seed, f, taken, id).select(F.col(id).alias("other"), F.col("place").alias("turn"))
    mixed = slots.join(pool, "turn", "left").select("slot", F.coalesce("other", F.col(id)).alias(id), F.when(F.col("other").isNull(), F.col("score")).alias("score"), F.when(F.col("other").isNull(), "for-you").otherwise("explore").alias("reason"))
    used = slots.agg(F.count_if("swap").alias("used"), F.count(F.lit(1)).alias("have"))
    more = pool.crossJoin(used).where((F.col("turn") > F.col("used")) & (F.col("turn") <= F.col("used") + k - F.col("have")))  # one row of counts
    top_up = more.select((F.col("have") + F.col("turn") - F.col("used")).cast("int").alias("slot"), F.col("other").alias(id), F.lit(None).cast("double").alias("score"), F.lit("random").alias("reason"))
    return mixed.unionByName(top_up)


def ring(index: DataFrame, seed: str, f: Filter | None = None, id: str = "id") -> DataFrame:
    """(id, place): the rows that match, from 0 in the order of their hashes."""
    rows = (f.apply(index) if f else index).select(F.col(id).alias("id")).withColumn("_u", unit_hash(F.col("id"), F.lit(seed)))
    return ranked(rows, [F.asc("_u"), F.asc("id")], "place").select("id", (F.col("place") - 1).alias("place"))


def walks(places: DataFrame, users: DataFrame, want: int, seed: str, skip: DataFrame | None = None) -> DataFrame:
    """(query_id, turn, id): for each user ``want`` rows of a ring, on from their own place, without those in ``skip`` (query_id, id).

    All that is free on the ring, if that is less.  Only the places that a user skips and the rows that they get are
    looked up; with the skipped ones in order on the walk, the j-th free place is the j-th after as many
    of them as lie before it.
    """
    n = places.count()
    offset = F.floor(unit_hash(F.col("query_id"), F.lit(seed), F.lit("at")) * n)
    asked = users.select("query_id").distinct().withColumn("offset", offset)
    if skip is not None:
        met = skip.select("query_id", "id").distinct().join(places, "id").join(asked, "query_id")
        away = F.pmod(F.col("place") - F.col("offset"), F.lit(max(n, 1)))
        asked = asked.join(met.groupBy("query_id").agg(F.array_sort(F.collect_list(away)).alias("taken")), "query_id", "left")
    taken = F.coalesce("taken", F.array().cast("array<bigint>")) if skip is not None else F.array().cast("array<bigint>")
    free = F.least(F.lit(want).cast("long"), F.lit(n).cast("long") - F.size("taken"))
    asked = asked.select("query_id", "offset", taken.alias("taken")).withColumn("free", free).where("free > 0")
    steps = F.transform(F.sequence(F.lit(0).cast("long"), F.col("free") - 1), lambda j: j + F.size(F.filter("taken", lambda x, i: x - i <= j)))
    walked = asked.select("query_id", "offset", F.posexplode(steps).alias("at", "step"))
    return walked.withColumn("place", F.pmod(F.col("offset") + F.col("step"), F.lit(max(n, 1)))).join(places, "place").select("query_id", (F.col("at") + 1).alias("turn"), "id")


def next_feeds(hits: DataFrame, places: DataFrame, users: DataFrame, k: int, seed: str, seen: DataFrame | None = None, explore: float = EXPLORE) -> DataFrame:
    """(query_id, slot, id, score, reason): ``next_feed`` for a batch of users; ``places`` is the ``ring`` of the rows that match.

    ``hits`` are candidates (query_id, id, score), ``users`` has every query_id, with or without hits, and ``seen`` what each has
    seen (query_id, id, and ts: then the newest).  Rows that replace or top up are neither seen nor picked.
    """
    picked = sample(hits, k, seed).withColumn("swap", unit_hash(F.lit(seed), F.col("query_id"), F.lit("x"), F.col("slot")) < explore)
    so_far = Window.partitionBy("query_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    slots = stored(picked.withColumn("turn", F.when(F.col("swap"), F.sum(F.col("swap").cast("int")).over(so_far))), "slots")  # k rows a user
    skip = slots.select("query_id", "id")
    if seen is not None:
        skip = skip.unionByName(newest_pairs(seen))
    others = stored(walks(places, users, k, seed, skip).withColumnRenamed("id", "other"), "walks")
    mixed = slots.join(others, ["query_id", "turn"], "left").select("query_id", "slot", F.coalesce("other", "id").alias("id"), F.when(F.col("other").isNull(), F.col("score")).alias("score"), F.when(F.col("other").isNull(), "for-you").otherwise("explore").alias("reason"))
    used = slots.groupBy("query_id").agg(F.count_if("swap").alias("used"), F.count(F.lit(1)).alias("have"))
    more = others.join(used, "query_id", "left").na.fill(0, ["used", "have"]).where((F.col("turn") > F.col("used")) & (F.col("turn") <= F.col("used") + k - F.col("have")))
    top_up = more.select("query_id", (F.col("have") + F.col("turn") - F.col("used")).cast("int").alias("slot"), F.col("other").alias("id"), F.lit(None).cast("double").alias("score"), F.lit("random").alias("reason"))
    return mixed.unionByName(top_up)
