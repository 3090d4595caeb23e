"""What users like: taste vectors, ring buffers, bars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths of the lists kept for a user; fixed values.
RINGS = {"seen": 1000, "liked": 200, "history": 300, "bookmarks": 500, "searches": 12}


def taste_arrays(likes: DataFrame, vectors: DataFrame, user: str = "user_id", unlikes: DataFrame | None = None) -> DataFrame:
    """(user, n, v): the fold acc = (acc + v) / 2 over likes in order of time, in closed form.

    Of n likes the first weighs 2**-(n-1) and the i-th 2**-(n-i+1).  ``likes`` has user, ts, id;
    repeated likes of a paper count once, at the first; unlikes are taken out before.  The
    window has a user's likes in one task, one after the other, so that they are summed there as they pass.
    """
    if unlikes is not None:
        likes = likes.join(unlikes.select(user, "id").distinct(), [user, "id"], "left_anti")
    first = likes.groupBy(user, "id").agg(F.min("ts").alias("ts"))
    met = first.join(vectors.select("id", "v"), "id")
    order = Window.partitionBy(user).orderBy("ts", "id")
    numbered = met.withColumn("i", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(user)))
    weight = F.when(F.col("i") == 1, F.pow(F.lit(2.0), 1 - F.col("n"))).otherwise(F.pow(F.lit(2.0), F.col("i") - F.col("n") - 1))
    kind = likes.schema[user].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]):
        held: np.ndarray | None = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("v").flatten(), float).reshape(b.num_rows, -1) * np.asarray(b.column("w"))[:, None]
            users, left = b.column("user"), np.asarray(b.column("n")) - np.asarray(b.column("i"))
            last = np.flatnonzero(left == 0)  # where a user's likes end
            starts = np.append(0, last + 1)
            sums = np.add.reduceat(x, starts[starts < len(x)], axis=0)
            if held is not None:
                sums[0] += held
            held = sums[len(last)] if len(sums) > len(last) else None  # a user who goes on in the next batch
            sums = sums[: len(last)]
            if len(last):
                take = pa.array(last)
                ends = np.arange(0, sums.size + 1, sums.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([users.take(take), b.column("n").take(take), pa.ListArray.from_arrays(pa.array(ends), pa.array(sums.ravel()))], ["user", "n", "v"])

    rows = numbered.select(F.col(user).alias("user"), "n", F.col("i").cast("long").alias("i"), weight.alias("w"), "v")
    return rows.mapInArrow(add, f"user {kind}, n long, v array<double>").withColumnRenamed("user", user)


def taste_vectors(likes: DataFrame, vectors: DataFrame, user: str = "user_id", unlikes: DataFrame | None = None) -> DataFrame:
    """(user, n, i, x): the components of ``taste_arrays``."""
    return taste_arrays(likes, vectors, user, unlikes).select(user, "n", F.posexplode("v").alias("i", "x"))


#: Likes whose vectors are kept apart; older ones are folded into one base vector.
APART = 64


def folded_state(likes: DataFrame, vectors: DataFrame, user: str = "user_id", apart: int = APART) -> DataFrame:
    """(user, n, base, likes): the fold of all but the newest ``apart`` likes (null if there are no more), and those, oldest first, as (id, ts, v).

    ``likes`` as in ``taste_vectors``; a user's likes are sorted in one row, as a client keeps them.
    """
    first = likes.groupBy(user, "id").agg(F.min("ts").alias("ts"))
    met = first.join(vectors.select("id", F.col("v").cast("array<double>").alias("v")), "id")
    sorted_ = met.groupBy(user).agg(F.array_sort(F.collect_list(F.struct("ts", "id", "v"))).alias("all")).withColumn("n", F.size("all"))
    old = F.slice("all", 1, F.greatest(F.col("n") - apart, F.lit(0)))
    base = F.when(F.col("n") > apart, fold(F.transform(old, lambda x: x["v"])))
    new = F.when(F.col("n") > apart, F.slice("all", -apart, apart)).otherwise(F.col("all"))
    return sorted_.select(user, "n", base.alias("base"), F.transform(new, lambda x: F.struct(x["id"].alias("id"), x["ts"].alias("ts"), x["v"].alias("v"))).alias("likes"))


def unfolded(state: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, v): the taste vector of a ``folded_state``, the same as of all likes."""
    recent = F.transform("likes", lambda x: x["v"])
    return state.select(user, fold(F.when(F.col("base").isNull(), recent).otherwise(F.concat(F.array("base"), recent))).alias("v"))


def as_arrays(parts: DataFrame, *by: str) -> DataFrame:
    """(by, v): components put together in order."""
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def fold(vectors: Column) -> Column:
    """The same fold as an expression over an ordered array of vectors."""
    return F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0))), F.get(vectors, F.lit(0)), lambda acc, v: F.zip_with(acc, v, lambda a, b: (a + b) / 2))


def ring(events: DataFrame, size: int, user: str = "user_id", item: str = "id", newest: str = "first") -> DataFrame:
    """(user, item, ts, place): each user's newest ``size`` distinct items; an item's time is its first or last."""
    when = F.min("ts") if newest == "first" else F.max("ts")
    one = events.groupBy(user, item).agg(when.alias("ts"))
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("ts"), F.desc(item)))
    return one.withColumn("place", place).where(F.col("place") <= size)


def recent_searches(searches: DataFrame, size: int = RINGS["searches"], user: str = "user_id") -> DataFrame:
    """(user, q, ts, place): newest queries, one of each spelling apart from case, as last typed."""
    last = searches.groupBy(user, F.lower("q").alias("k")).agg(F.max_by("q", F.struct("ts", "q")).alias("q"), F.max("ts").alias("ts"))
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("ts"), "k"))
    return last.withColumn("place", place).where(F.col("place") <= size).select(user, "q", "ts", "place")


def bars(rows: DataFrame, by: str, most: int = 8, blank: str = "Unknown field") -> DataFrame:
    """(name, n, place): counts; of more than ``most`` groups all but the first most - 1 are 'Other'."""
    counts = rows.groupBy(F.when(F.coalesce(by, F.lit("")) == "", blank).otherwise(F.col(by)).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "name").limit(most)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "name")))  # ``most`` rows
    whole = counts.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("total"))  # one row
    own = placed.crossJoin(whole).where((F.col("groups") <= most) | (F.col("place") < most)).select("name", "n", "place")
    kept = placed.where(F.col("place") < most).agg(F.sum("n").alias("kept"))
    rest = whole.crossJoin(kept).where(F.col("groups") > most).select(F.lit("Other").alias("name"), (F.col("total") - F.col("kept")).alias("n"), F.lit(most).alias("place"))
    return own.unionAll(rest).groupBy("name").agg(F.sum("n").alias("n"), F.min("place").cast("int").alias("place"))


def last_likes(likes: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, id): each user's newest like."""
    return likes.groupBy(user).agg(F.max_by("id", F.struct("ts", "id")).alias("id"))


def export_state(lists: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, state): a user's lists (columns named in RINGS, newest last) as a JSON text, each cut to its newest."""
    cut = [F.when(F.size(c) > n, F.slice(c, -n, n)).otherwise(F.col(c)).alias(c) for c, n in RINGS.items() if c in lists.columns]
    return lists.select(user, F.to_json(F.struct(F.lit(1).alias("version"), *cut)).alias("state"))


def import_lists(states: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, and a list for each of RINGS) of exported states; texts that are no state of this version are left out, lists are cut again."""
    schema = ", ".join(["version int", *(f"{c} array<{'string' if c == 'searches' else 'long'}>" for c in RINGS)])
    read = states.select(user, F.from_json("state", schema).alias("s")).where("s.version = 1")
    own = lambda c: F.coalesce(F.filter(F.col(f"s.{c}"), lambda x: x.isNotNull()), F.array())
    return read.select(user, *[F.when(F.size(own(c)) > n, F.slice(own(c), -n, n)).otherwise(own(c)).alias(c) for c, n in RINGS.items()])


def import_state(vectors: Column, dim: int) -> Column:
    """Of imported like vectors those of the right dimension with finite numbers."""
    from driftline.functions.vectors import valid_query

    return F.filter(vectors, lambda v: valid_query(v, dim))
