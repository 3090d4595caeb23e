"""Tables in segments: merges, lookups by bucket, appends by key, the text index's costs."""

import math

import pytest
from pyspark.sql import functions as F

from driftline.operators import fts, ingest
from driftline.schema import PAPER, with_defaults
from driftline.sources import segments, shared, sinks
from driftline.sources.crawl import Api
from driftline.sources.segments import KeyIndex, buckets_for, merge_from
from driftline.sources.textindex import TextIndex


def test_segments_are_written_again_a_few_times():
    sizes, written = [], [0] * 3000
    owners: list[list[int]] = []
    for n in range(3000):
        sizes.append(5)
        owners.append([n])
        low = merge_from(sizes)
        if low < len(sizes):
            merged = [x for o in owners[low:] for x in o]
            for x in merged:
                written[x] += 1
            sizes[low:], owners[low:] = [sum(sizes[low:])], [merged]
        assert len(sizes) <= segments.FAN * math.log(5 * (n + 2), segments.FAN)
    assert sum(sizes) == 15_000 and max(written) <= math.log(15_000, segments.FAN) and merge_from([]) == 0


def test_buckets_follow_the_rows():
    assert [buckets_for(n) for n in (0, 1, segments.BUCKET_ROWS, segments.BUCKET_ROWS + 1, 10**6, 10**12)] == [1, 1, 1, 2, 64, segments.MOST_BUCKETS]


def files_read(df):
    """Files that the scans of a plan without exchanges have read."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def papers_of(spark, ids, title="title {}"):
    return with_defaults(spark.createDataFrame([(i, title.format(i), n) for n, i in enumerate(ids)], "id long, title string, seq long"))


def test_appends_read_the_buckets_of_their_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET_ROWS", 50)
    path = f"file://{tmp_path}/p"
    assert sinks.append_new(papers_of(spark, range(3000)), path) == 3000
    batch = papers_of(spark, [5, 3000, 3001, 3000])
    index = KeyIndex(spark, path)
    ids, titles = index.known(KeyIndex.keys(batch))
    every = index._read("ids", KeyIndex.IDS, index.segments, None)
    assert index.segments[0].buckets == 64 and files_read(every) == 64 and files_read(ids) <= 3 and files_read(titles) <= 3
    assert sinks.append_new(batch, path, index) == 2 and index.rows == 3002
    # what has a title that is there is not new, and a row that its id turns away leaves its title free
    more = with_defaults(spark.createDataFrame([(9001, "Title 7!", 1), (6, "Of its own", 2), (9002, "of its own", 3), (9003, "OF ITS OWN", 4)], "id long, title string, seq long"))
    assert sinks.append_new(more, path) == 1
    assert sorted(r["id"] for r in spark.read.parquet(path).where("id >= 3000").collect()) == [3000, 3001, 9002]


def test_an_append_that_was_cut_off_is_found(spark, tmp_path):
    """The rows are in the table and the pointer says that an append was under way: the keys are read from the table."""
    path = f"file://{tmp_path}/p"
    sinks.append_new(papers_of(spark, range(10)), path)
    index = KeyIndex(spark, path)
    index._save(open=True)
    papers_of(spark, range(10, 14)).write.mode("append").parquet(path)
    assert sinks.append_new(papers_of(spark, range(8, 20)), path) == 6
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(20))


def test_many_small_appends_leave_few_segments(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    index = KeyIndex(spark, path)
    for n in range(9):
        index.append(papers_of(spark, range(3 * n, 3 * n + 3)))
    assert index.rows == 27 and len(index.segments) == 2 and KeyIndex(spark, path).rows == 27
    assert sinks.append_new(papers_of(spark, range(30)), path) == 3


def test_first_of_each_by_order(spark):
    rows = [(1, "A", 5, "x"), (1, "B", 3, "y"), (2, "b", 4, "z"), (3, "C", 9, "u"), (4, "c!", 8, "v"), (None, "D", 1, "w")]
    got = ingest.new_papers(spark.createDataFrame(rows, "id long, title string, seq long, more string"))
    assert sorted((r["id"] or 0, r["title"], r["more"]) for r in got.collect()) == [(0, "D", "w"), (1, "B", "y"), (4, "c!", "v")]


# text index


def text_rows(spark, ids, words="alpha beta"):
    return spark.createDataFrame([(i, f"title {words} n{i}", f"abstract of {i}") for i in ids], "id long, title string, abstract string")


def test_a_commit_reads_what_it_replaces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET_ROWS", 20)
    index = TextIndex(spark, f"file://{tmp_path}/t", columns=("title", "abstract"))
    index.sync(text_rows(spark, range(1000)), 1)
    assert index.state["segments"][0]["buckets"] == 64
    ids = spark.createDataFrame([(3,), (5000,)], "id long")
    assert files_read(index._documents(index.state["segments"], segments.touched(ids, "id", 64))) <= 2
    assert [r["id"] for r in index.replaced(ids).collect()] == [3]


def test_many_small_batches_of_text(spark, tmp_path):
    """Upserts and deletions in turn: the postings and totals of an index of what is left, and few segments, each posting written again a few times."""
    index = TextIndex(spark, f"file://{tmp_path}/t", columns=("title", "abstract"))
    writes, plain = [], TextIndex._merge
    index._merge = lambda low: (writes.append(low), plain(index, low))
    left = {}
    for n in range(12):
        ids = list(range(2 * n, 2 * n + 4))  # half of them are there
        index.sync(text_rows(spark, ids, f"w{n}"), 2 * n)
        left |= {i: n for i in ids}
        if n % 4 == 3:
            index.delete(spark.createDataFrame([(2 * n,), (2 * n + 1,), (77,)], "id long"), 2 * n + 1)
            left = {i: m for i, m in left.items() if i not in (2 * n, 2 * n + 1)}
    want = fts.postings(spark.createDataFrame([(i, f"title w{n} n{i}", f"abstract of {i}") for i, n in left.items()], "id long, title string, abstract string"), columns=("title", "abstract"))
    rows = lambda df: sorted(tuple(r) for r in df.select("id", "col", "term", "pos").collect())
    again = TextIndex(spark, f"file://{tmp_path}/t", columns=("title", "abstract"))
    assert rows(again.postings()) == rows(want) and sorted(r["id"] for r in again.documents().collect()) == sorted(left)
    counted = index._totals(index.documents())
    assert {k: index.state[k] for k in counted} == counted and counted["docs"] == len(left)
    assert len(index.state["segments"]) <= segments.FAN and 1 <= len(writes) <= 3
    index.optimize()
    assert len(index.state["segments"]) == 1 and not index.state["segments"][0]["gone"] and rows(index.postings()) == rows(want)


def test_papers_without_words_are_documents(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/t", columns=("title", "abstract"))
    index.sync(spark.createDataFrame([(1, "", ""), (2, "word", "")], "id long, title string, abstract string"), 1)
    assert sorted(r["id"] for r in index.documents().collect()) == [1, 2] and index.state["docs"] == 1


def test_two_builds_stay(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    rows = spark.range(5).select(F.col("id"), F.lit(0).alias("cluster"), F.col("id").alias("row"))
    builds = [sinks.write_index(rows, path) for _ in range(3)]
    assert [shared.exists(spark, f"{path}/build={b}") for b in builds] == [False, True, True]


# crawl


@pytest.mark.parametrize(
    "params, asked, want",
    [
        ({"filter": "has_abstract:true"}, {"ids": ["W1", "W2"]}, "has_abstract:true,ids:W1|W2"),
        ({"filter": "has_abstract:true"}, {"since": "2024-01-01", "where": "language:en"}, "has_abstract:true,language:en,from_publication_date:2024-01-01"),
        ({}, {"where": "language:en"}, "language:en"),
        ({"filter": "a:b"}, {}, "a:b"),
        ({"mailto": "x"}, {}, None),
    ],
)
def test_a_base_filter_stands_beside_the_others(monkeypatch, params, asked, want):
    from urllib.parse import parse_qs, urlparse

    seen = []
    monkeypatch.setattr("driftline.sources.crawl.get_json", lambda url: seen.append(parse_qs(urlparse(url).query)) or [])
    Api("http://x.example/works", params).page(**asked)
    assert seen[0].get("filter", [None])[0] == want and (params.get("mailto") is None or seen[0]["mailto"] == ["x"])


def test_paper_columns_have_defaults(spark):
    assert [f.name for f in papers_of(spark, [1]).schema] == [f.name for f in PAPER]


def test_postings_are_stored_without_moving_them(spark, tmp_path):
    """Files hold the postings of parts of the papers, each sorted by term; of repeated ids the last row by seq is taken."""
    index = TextIndex(spark, f"file://{tmp_path}/t", columns=("title", "abstract"))
    rows = [(i, f"title {i}", "plain words " * 2000, i) for i in range(200)] + [(7, "later title", "novel", 900), (7, "earlier title", "novel", 800)]
    index.sync(spark.createDataFrame(rows, "id long, title string, abstract string, seq long").repartition(5), 1)
    files = index.postings().withColumn("f", F.input_file_name())
    assert files.where("term = 'plain'").select("f").distinct().count() > 1  # a frequent term is not one task's
    assert sorted(r[0] for r in index.postings().where("id = 7").select("term").collect()) == ["later", "novel", "title"]
    assert index.state["docs"] == 200


def test_papers_of_one_text_have_one_score(spark):
    """Sums in any order differ in the last bit, and ties then aren't by id."""
    p = spark.createDataFrame([(i, "", "der im wald " + "der " * (i % 7) + "im " * (i % 3) + "x " * (i % 5)) for i in range(2100)], "id long, title string, abstract string").repartition(7)
    got = fts.bm25(fts.postings(p), fts.Query(("der", "im", "x")), any_word=True).collect()
    assert len(got) == 2100 and len({(r["id"] % 105, r["bm25"]) for r in got}) == 105
