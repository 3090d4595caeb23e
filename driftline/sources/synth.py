"""Synthetic papers and embeddings, the same for the same seed at any parallelism."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = [f"Field {i:02d}" for i in range(20)]
VENUES = [f"Venue {i:02d}" for i in range(21)]


def generate(spark: SparkSession, n: int, dim: int = 64, topics: int = 20, subtopics: int = 6, noise: tuple[float, float] = (0.7, 0.9), seed: int = 42, lowrank: int = 0) -> DataFrame:
    """n papers with embeddings around subtopics of topics; ``lowrank`` draws them from so many directions instead.

    Centres come from the seed, each row's noise from the seed and its id.
    """
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(topics, dim))
    subs = centres[:, None] + noise[0] * rng.normal(size=(topics, subtopics, dim))
    basis = rng.normal(size=(max(1, lowrank), dim))

    def vectors(batches):
        for b in batches:
            ids = np.asarray(b.column("id"))
            x = np.empty((len(ids), dim), np.float32)
            for i, v in enumerate(ids.tolist()):
                own = np.random.default_rng((seed, v))
                x[i] = own.normal(size=lowrank) @ basis + 0.1 * own.normal(size=dim) if lowrank else subs[v % topics, v // topics % subtopics] + noise[1] * own.normal(size=dim)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim, dtype=np.int32)), pa.array(x.ravel()))], [*b.schema.names, "embedding"])

    topic = F.col("id") % topics
    pick = lambda names, salt: F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(names))) + 1).cast("int"))
    base = spark.range(n).select(
        "id",
        F.concat(F.lit("Paper "), F.col("id").cast("string"), F.lit(" on subject "), topic.cast("string")).alias("title"),
        (2000 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(26))).cast("int").alias("year"),
        pick(VENUES, 2).alias("venue"),
        F.element_at(F.array(*[F.lit(FIELDS[t % len(FIELDS)]) for t in range(topics)]), (topic + 1).cast("int")).alias("field"),
        (10000 + topic * subtopics + F.floor(F.col("id") / topics) % subtopics).cast("int").alias("topic"),
        F.pmod(F.xxhash64("id", F.lit(3)), F.lit(500)).alias("cited"),
        F.col("id").alias("seq"),
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(vectors, f"{schema}, embedding array<float>")


def taste_queries(index: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """(query_id, i, x): normalised means of one to four random rows, as tastes are."""
    from driftline.functions.vectors import dequantize

    total = index.agg(F.max("row")).first()[0]
    rng = np.random.default_rng(seed)
    picks = [(q, int(r)) for q in range(n) for r in rng.integers(0, (total or 0) + 1, rng.integers(1, 5))]
    wanted = index.sparkSession.createDataFrame(picks, "query_id long, row long")
    parts = index.select("row", F.posexplode(dequantize(F.col("q"), F.col("scale"))).alias("i", "x")).join(F.broadcast(wanted), "row")  # a few rows a query
    return parts.groupBy("query_id", "i").agg(F.avg("x").alias("x"))
