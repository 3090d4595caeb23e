"""Connected components of links between integer ids.

Up to ``ONE_TASK`` links, by count, are joined by union-find in one task (16 bytes a link).  More
go by alternating large and small stars: each round is an aggregate and a join, so a node
with very many links is summed before the shuffle and its rows can be split.  Nothing but
two numbers a round comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.textblocks import stored


#: Links that one task joins.
ONE_TASK = 500_000


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id in reach) by lowering labels along links and jumping to the label's label."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y, label[x], label[y]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _union_all(batches: Iterator[pa.RecordBatch]):
    got = [(np.asarray(b.column("a")), np.asarray(b.column("b"))) for b in batches]
    if got:
        ids, label = union(*(np.concatenate(c) for c in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], ["id", "component"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: every greater neighbour of a node is tied to the least in reach; small: all smaller ones and the node itself."""
    if large:
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = links.select(F.col("b").alias("u"), F.col("a").alias("v"))  # a < b
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = sides.join(least, "u")
    tied = met.where("v > u").select("v", "m") if large else met.select("v", "m").unionAll(least.select(F.col("u").alias("v"), "m"))
    return tied.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): the smallest id in reach, for every id that has a link.  ``links`` has a and b; order and repeats don't matter."""
    now = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links", small=True)
    if now.count() <= one_task:
        return now.repartition(1).mapInArrow(_union_all, "id long, component long")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        if not state[0]:
            break
        now = stored(_star(_star(now, True), False), "links", small=True)
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
