"""Streaming jobs: dedupe, counters, pending ids, token buckets, index maintenance."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftline.functions.text import title_key
from driftline.operators.ingest import PENDING_ID

LATENESS = "14 days"


def new_rows(stream: DataFrame, id: str = "id", title: str | None = "title", ts: str | None = None) -> DataFrame:
    """Rows whose id, and whose title key, were not seen before; with ``ts``, ids are remembered for two weeks."""
    out = stream.withWatermark(ts, LATENESS).dropDuplicatesWithinWatermark([id]) if ts else stream.dropDuplicates([id])
    return out.withColumn("key", title_key(F.col(title))).dropDuplicates(["key"]).drop("key") if title else out


def _sums(stream: DataFrame, every: str, late: str) -> DataFrame:
    """(w, kind, n, errors, limited, ms): sums of request metrics by window."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", every).alias("w"), "kind")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 500).alias("errors"), F.count_if(F.col("status") == 429).alias("limited"), F.sum("ms").alias("ms"))
    )


def counters(stream: DataFrame, every: str = "1 second", late: str = "1 hour") -> DataFrame:
    """(start, kind, n, errors, limited, ms): tumbling sums of request metrics."""
    return _sums(stream, every, late).select(F.col("w.start").alias("start"), "kind", "n", "errors", "limited", "ms")


def pending_ids(stream: DataFrame) -> DataFrame:
    """Well-formed ids of the pending log, each once."""
    return stream.where(F.col("id").rlike(PENDING_ID)).dropDuplicates(["id"])


def pending_likes(likes: DataFrame, index: DataFrame) -> DataFrame:
    """Likes of papers that are in the index by now; the static side is read again with each start."""
    return likes.join(index, "id")


#: The store that processors with timers and several states need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB; the session's own setting holds again afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class WaitingLikes(StatefulProcessor):
    """By paper: whether a build has it, and the users whose likes wait until one has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.there = handle.getValueState("there", "build long")
        self.waiting = handle.getListState("waiting", "user_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        build, users = None, set()
        for part in rows:
            builds = part["build"].dropna()
            if len(builds):
                build = min(int(builds.min()), build) if build is not None else int(builds.min())
            users.update(int(u) for u in part["user_id"].dropna())
        there = int(self.there.get()[0]) if self.there.exists() else build
        if there is None:
            if users:
                self.waiting.appendList([(u,) for u in sorted(users)])
            return
        if not self.there.exists():
            self.there.update((there,))
            users |= {int(u) for (u,) in self.waiting.get()}
            self.waiting.clear()
        if users:
            yield pd.DataFrame({"user_id": sorted(users), "id": int(key[0]), "build": there})


def waiting_likes(likes: DataFrame, builds: DataFrame) -> DataFrame:
    """(user_id, id, build): each like of a stream (user_id, id) once a build of a stream (id, build) has its paper, with the first that has.

    Likes wait in keyed state for as long as it takes; a like and a build may come in any order.  Start it
    within ``state_store``.
    """
    both = likes.select(F.col("id").cast("long").alias("id"), F.col("user_id").cast("long").alias("user_id"), F.lit(None).cast("long").alias("build")).unionByName(
        builds.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("user_id"), F.col("build").cast("long").alias("build"))
    )
    return both.groupBy("id").transformWithStateInPandas(WaitingLikes(), "user_id long, id long, build long", "append", "none")


#: Seconds that a ring of counters holds, the columns of a slot, and the seconds of a day.
RING = 3600
SUMS = ("n", "errors", "limited", "ms")
DAY = 86_400


class SecondsRing(StatefulProcessor):
    """By kind and day: a ring of the last RING seconds, and trailing sums at each second of the day; gone when the day is over."""

    def __init__(self, spans: tuple[int, ...]):
        self.spans = spans

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getValueState("ring", "seconds binary, sums binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kind, day = key
        new = pd.concat(list(rows)).sort_values("second")  # a row for each second that has ended since the last batch, of a day and an hour at most
        seconds, sums = new["second"].to_numpy(np.int64), new[list(SUMS)].fillna(0).to_numpy(float)
        own = seconds[seconds >= day * DAY]
        if self.ring.exists():  # what it holds is older, as seconds end in order
            held = [np.frombuffer(x, t) for x, t in zip(self.ring.get(), (np.int64, np.float64), strict=True)]
            seconds, sums = np.concatenate([held[0], seconds]), np.concatenate([held[1].reshape(-1, len(SUMS)), sums])
        else:
            self.handle.registerTimer((day + 1) * DAY * 1000)
        kept = seconds >= seconds[-1] - RING
        self.ring.update((seconds[kept].tobytes(), sums[kept].tobytes()))
        if not len(own):
            return
        upto, running = np.searchsorted(seconds, own), np.zeros((len(seconds) + 1, len(SUMS)), np.longdouble)
        np.cumsum(sums, 0, np.longdouble, running[1:])
        for span in self.spans:  # the seconds before each one
            since = np.searchsorted(seconds, own - span)
            total = (running[upto] - running[since]).astype(float)
            frame = pd.DataFrame(total, columns=list(SUMS)).astype({"n": "int64", "errors": "int64", "limited": "int64"})
            frame.insert(0, "kind", kind)
            frame.insert(1, "second", own)
            frame.insert(2, "span", np.int32(span))
            yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        return iter(())


def trailing_sums(stream: DataFrame, spans: tuple[int, ...] = (60, RING), late: str = "1 hour") -> DataFrame:
    """(kind, second, span, n, errors, limited, ms): at each second of a kind that has requests, the sums of the ``span`` seconds before it.

    Seconds are counted in windows that close as the watermark passes them.  Each goes to its own day, and one of
    the last hour to the next day too, whose first seconds look back on it; so a task holds a day and an hour of a kind
    and no more.  Start it within ``state_store``.
    """
    if max(spans) > RING:
        raise ValueError(f"spans of {RING} seconds at most")
    closed = _sums(stream, "1 second", late).select(F.window_time("w").alias("at"), "kind", F.unix_seconds("w.start").alias("second"), *SUMS)
    dealt = closed.withColumn("day", F.explode(F.array_distinct(F.array(F.floor(F.col("second") / DAY), F.floor((F.col("second") + RING) / DAY)))))
    kind = closed.schema["kind"].dataType.simpleString()
    return dealt.groupBy("kind", "day").transformWithStateInPandas(SecondsRing(spans), f"kind {kind}, second long, span int, n long, errors long, limited long, ms double", "append", "eventTime")


class Sampler(StatefulProcessor):
    """By series: readings of slots that have ended are passed on; the newest ones stay as a ring."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getListState("slots", "us long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = [tuple(x) for x in self.slots.get()]
        for part in rows:
            us, n = part["us"].to_numpy(), part["n"].to_numpy()
            last = np.argsort(us)[-self.most :]
            newest = sorted([*newest, *zip(us[last].tolist(), n[last].tolist(), strict=True)])[-self.most :]
            yield pd.DataFrame({"key": key[0], "us": us, "n": n})
        self.slots.put(newest)


def samples(stream: DataFrame, by: str, value: str = "n", seconds: int = 10, most: int = 361, late: str = "10 minutes") -> DataFrame:
    """(key, us, n): a counter's last reading in each ``seconds``, once the watermark has passed them; ``most`` of each series are kept as state.

    Slots are windows that Spark counts and closes; Python sees those that have ended, a series at a time, and
    writes its ring once a batch.  Start it within ``state_store``.
    """
    kind = stream.schema[by].dataType.simpleString()
    timed = stream.select(by, F.col("ts").cast("timestamp").alias("ts"), F.col(value).cast("long").alias("n")).withWatermark("ts", late).where("n is not null")
    ended = timed.groupBy(by, F.window("ts", f"{seconds} seconds").alias("w")).agg(F.max(F.struct(F.unix_micros("ts").alias("us"), "n")).alias("last"))
    return ended.select(by, "last.us", "last.n").groupBy(by).transformWithStateInPandas(Sampler(most), f"key {kind}, us long, n long", "append", "none")


def fill(seconds: np.ndarray, state: tuple[float, float] | None, rate: float, burst: float) -> tuple[np.ndarray, float, float]:
    """Events of one key, in order of time, through its bucket: which are allowed, and its state."""
    tokens, last = state if state else (burst, None)
    allowed = np.zeros(len(seconds), bool)
    for i, t in enumerate(seconds.tolist()):
        tokens, last = min(burst, tokens + (t - (t if last is None else last)) * rate), t
        allowed[i] = tokens >= 1
        tokens -= float(allowed[i])
    return allowed, float(tokens), float(last)


class Bucket(StatefulProcessor):
    """By key: tokens and the time of the last event; gone ten minutes of event time after it, when the bucket is full again anyway."""

    IDLE = 600_000

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        us, ids = (np.concatenate(c) for c in zip(*((part["us"].to_numpy(), part["event_id"].to_numpy()) for part in rows), strict=True))
        order = np.lexsort((ids, us))  # two numbers of each of the key's events in a batch
        allowed, tokens, last = fill(us[order] / 1e6, tuple(self.bucket.get()) if self.bucket.exists() else None, self.rate, self.burst)
        self.bucket.update((tokens, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(last * 1000), timerValues.getCurrentWatermarkInMs()) + self.IDLE)
        yield pd.DataFrame({"key": key[0], "event_id": ids[order], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bucket.clear()
        return iter(())


def limited(stream: DataFrame, by: str, rate: float = 5.0, burst: float = 20.0) -> DataFrame:
    """(key, event_id, allowed): every event of a stream of (by, event_id, ts) through its key's bucket.

    Start it within ``state_store``.
    """
    kind, event = (stream.schema[c].dataType.simpleString() for c in (by, "event_id"))
    timed = stream.select(by, "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "10 minutes").withColumn("us", F.unix_micros("ts"))
    return timed.groupBy(by).transformWithStateInPandas(Bucket(rate, burst), f"key {kind}, event_id {event}, allowed boolean", "append", "eventTime")


def maintain(stream: DataFrame, path: str, checkpoint: str, apply) -> object:
    """Start a job that passes each batch to ``apply(batch, path)``; the checkpoint holds what was passed on."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
