"""Repeated ids, columns with clashing names, and what operators leave in the session."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import jaccard, linededup, quality, suffix, textblocks

A = "one two three four five six seven eight nine ten eleven twelve"
B = "red orange yellow green blue indigo violet black white grey brown pink"
ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def components_of(df):
    return sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=lambda r: (r[0] or 0, r[1]))


def test_sets_of_one_id_are_linked(spark):
    rows = [(3, A), (5, B), (7, A), (7, B), (9, B + " gold"), (11, ""), (12, None), (13, ""), (13, A + " extra words that are many more than before"), (14, "lonely"), (14, ""), (15, "x y z"), (15, "x y z"), (None, A)]
    got = components_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    of = {}
    for doc, _, component in got:
        of.setdefault(doc, set()).add(component)
    assert of == {3: {3}, 5: {3}, 7: {3}, 9: {3}, 11: {11}, 12: {12}, 13: {13}, 14: {14}, 15: {15}, None: {None}} and len(got) == len(rows)


def test_a_chain_through_ids_and_texts(spark):
    """Ids link texts and texts link ids, over several steps."""
    texts = [f"{c} " * 3 + " ".join(f"{c}{i}" for i in range(20)) for c in "abcdefgh"]
    rows = [(i + 1, texts[i]) for i in range(8)] + [(i + 1, texts[i + 1]) for i in range(0, 7) if i != 3]
    got = components_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(d, c) for d, _, c in got} == {(i, 1) for i in range(1, 5)} | {(i, 5) for i in range(5, 9)}


def test_the_pipeline_keeps_one_document_of_linked_rows(spark, sf):
    rows = [(3, A, "en", "s", 1), (5, B, "en", "s", 1), (7, A, "en", "s", 1), (7, B, "en", "s", 1), (8, "alone here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.ngram_jaccard(spark, docs, sf).collect()) == [3, 8]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_leave_the_session_as_it_was(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    before = spark.conf.get(ARROW)
    assert stage(spark, docs, sf).count() > 0 and spark.conf.get(ARROW) == before


def test_batches_are_small_only_within(spark):
    before = spark.conf.get(ARROW)
    with pytest.raises(ZeroDivisionError), textblocks.small_batches(spark, 7):
        assert spark.conf.get(ARROW) == "7"
        1 / 0
    assert spark.conf.get(ARROW) == before
    spark.conf.set(ARROW, "5")
    try:
        with textblocks.small_batches(spark, 7):
            assert spark.conf.get(ARROW) == "5"
    finally:
        spark.conf.set(ARROW, before)


def test_small_results_keep_the_tasks_of_large_inputs(spark, monkeypatch):
    """Tiny partitions are put together; partitions of some size are left alone."""
    wide = spark.range(0, 3000, 1, 300)
    assert textblocks.stored(wide, "tiny", small=True).inputFiles().__len__() <= 4 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(textblocks, "TASK_BYTES", 8)
    assert len(textblocks.stored(wide, "whole", small=True).inputFiles()) == 300


def test_bitmaps_decode_to_the_kept_lines(spark):
    rows = [(list("abcdef"), [6]), (list("abcdef"), [0, 6, 0]), (list("abcdef"), [0, 1, 2, 1, 2]), (list("abcdef"), [1, 4, 1]), ([""], [1])]
    df = spark.createDataFrame(rows, "lines array<string>, runs array<int>")
    got = [r[0] for r in df.select(linededup.kept_lines(F.col("lines"), F.col("runs"))).collect()]
    assert got == ["a\nb\nc\nd\ne\nf", "", "b\nc\ne\nf", "a\nf", ""]


CLASH = ["id", "ref", "more", "n", "version", "late", "gram", "h", "pos", "group", "component", "row", "site", "key", "host", "spans", "_id", "_text"]


@pytest.mark.parametrize("run", [jaccard.near_duplicates, suffix.remove_repeats, linededup.drop_repeated_lines, quality.judge], ids=lambda f: f.__name__)
def test_columns_with_clashing_names_are_ignored(spark, sf, run):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40").select("doc_id", "text", "source")
    clash = docs.select("*", *[F.lit("x").alias(c) for c in CLASH])
    rows = lambda df: sorted(repr(r) for r in df.collect())
    assert rows(run(clash)) == rows(run(docs))


def test_one_text_in_a_third_of_all_rows(spark):
    """Many batches and partitions; its grams are known as frequent, as the sample is by id."""
    page = " ".join(hashlib.sha256(str(i).encode()).hexdigest()[:9] for i in range(60))
    rows = [(i, page if i % 3 == 0 else " ".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest()[:7] for k in range(40))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(docs).collect()}
    assert got == {i: (len(page), 1) if i % 3 == 0 else (0, 0) for i in range(900)}


def test_near_copies_of_very_long_texts(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(60_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:59_000])), (3, " ".join(words[30_000:])), (4, A)]
    got = components_of(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == [(1, 59_996, 1), (2, 58_996, 1), (3, 29_996, 3), (4, 8, 4)]
