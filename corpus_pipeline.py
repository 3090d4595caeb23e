"""The corpus pipeline: five operators in a row, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes each stage's result to the shared folder and reads it
again, so no stage is computed twice and lost executors cost one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import jaccard, langid, linededup, packing, suffix
from driftline.llm.textblocks import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, without documents that have no text left."""
    return df.withColumn("n_chars", F.length("text").cast("long")).where(F.col("text").rlike(r"\S")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without text, go; profiles are learned from the labelled ones, and where none can be the letters alone decide."""
    profiles = langid.learn(docs)
    if not profiles.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    told = langid.identify(docs, profiles, keep=("text", "lang", "source", "n_chars"))
    return told.where(F.col("lang_pred") != langid.UNKNOWN).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go, and documents that lose all their text."""
    return _documents(linededup.drop_repeated_lines(docs, keep=("lang", "source")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, and of a repeated row (same id and text) one.

    Rows with a null id are in no group: one of each text stays, unless a row with an id has the same text.
    """
    found = jaccard.near_duplicates(docs)
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select(*COLUMNS, F.sha2("text", 256).alias("digest"))
    named = rows.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "digest"])
    held = rows.where(F.col("doc_id").isNotNull()).select("digest").distinct()
    nameless = rows.where(F.col("doc_id").isNull()).dropDuplicates(["digest"]).join(held, "digest", "left_anti")
    return named.select(*COLUMNS).unionAll(nameless.select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that occur twice go, and documents that lose all their text."""
    kept = suffix.remove_repeats(docs, keep=("lang", "source"), with_bytes=False, with_text=True)
    return _documents(kept.withColumnRenamed("kept_text", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]
#: Profiles, set similarity and tokens are beyond SQL; tests/llm compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; the pieces of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
