"""Properties, goldens and edge cases of the main operators."""

import datetime as dt
import json

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import scalars as S
from driftline.functions import text as X
from driftline.functions import vectors as V
from driftline.functions.scalars import unit_hash
from driftline.operators import feed, ingest, metrics, search, taste
from driftline.operators.filters import EXCLUDE_LIMIT, FeedRequest, Filter, bitmaps, newest_excluded, newest_pairs, valid_query_text
from driftline.operators.fts import Query
from driftline.plans import text_queries
from driftline.schema import WORK
from driftline.sources import files, sinks, synth
from driftline.sources.crawl import Works, works
from driftline.streaming import jobs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "q, expression",
    [
        ("graph neural networks", '("graph" "neural" "networks") OR "graph neural networks"'),
        ('"; DROP TABLE fts; --', '("drop" "table" "fts") OR "drop table fts"'),
        ("the theory of computation", '("theory" "computation") OR "theory computation"'),
        ("the of and", ""),
        ("   ", ""),
        ("Résumé", '"résumé"'),
    ],
)
def test_match_expression(spark, q, expression):
    assert one(spark, X.match_expression(F.lit(q)))[0] == expression


def test_match_any_word(spark):
    assert one(spark, X.match_expression(F.lit("x y"), True))[0] == '"x" OR "y"'
    assert Query.of(spark, "Learning networks", stemmed=True).words == ("learn", "network")


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("adjustable", "adjust"), ("controlling", "control"), ("probate", "probat"), ("agreed", "agre"), ("sky", "sky")])
def test_porter(word, stem):
    assert X.Porter.stem(word) == stem


def test_quantize_rounds_half_away_from_zero(spark):
    q, s = one(spark, V.quantize(F.array(*map(F.lit, [127.0, -2.5, 2.5, 0.4]))), V.scale_of(F.array(*map(F.lit, [127.0, -2.5, 2.5, 0.4]))))
    assert (list(q), s) == ([127, -3, 3, 0], 1.0)
    z = F.array(F.lit(0.0), F.lit(0.0))
    assert list(one(spark, V.quantize(z))[0]) == [0, 0] and one(spark, V.scale_of(z))[0] == 0


def test_float_bytes_round_trip(spark):
    df = spark.createDataFrame([([1.5, -2.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(V.decode_f32(V.encode_f32("v"))).collect()] == [[1.5, -2.0], None]
    assert not one(spark, V.valid_query(F.array(F.lit(1.0), F.lit(float("nan"))), 2))[0]
    small = spark.createDataFrame([([1, -127],), (None,)], "v array<tinyint>")
    assert [r[0] for r in small.select(V.encode_i8("v")).collect()] == [bytes([1, 129]), None]


def test_taste_fold_and_its_closed_form(spark):
    assert list(one(spark, V.normalize(F.array(*map(F.lit, [3.0, 0.0, 4.0, 0.0]))))[0]) == pytest.approx([0.6, 0, 0.8, 0])
    likes = spark.createDataFrame([(1, t, t) for t in range(5)], "user_id long, ts long, id long")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, v array<double>")
    got = {r["i"]: r["x"] for r in taste.taste_vectors(likes, vectors).collect()}
    acc = np.array([0.0, 1.0])
    for i in range(1, 5):
        acc = (acc + [i, 1.0]) / 2
    assert [got[0], got[1]] == pytest.approx(acc.tolist())
    gone = taste.taste_vectors(likes, vectors, unlikes=likes.where("id = 4"))
    assert {r["n"] for r in gone.collect()} == {4}


def test_filters(spark):
    assert Filter.from_request(topics=["bad", "T0", "T99999"]).empty
    assert Filter.from_request(year_min=-3, cited_min=1 << 40).cited_min == 1 << 31
    rows = spark.createDataFrame([(0, 5, "", 0, "a"), (2012, 5, "DB", 3, "b"), (2012, 5, "OS", 7, "b")], "year int, cited long, field string, topic int, venue string")
    count = lambda **f: Filter(**f).apply(rows).count()
    assert [count(year_max=2020), count(year_min=1), count(fields=("DB",), topics=(7,)), count(venues=("a",)), count()] == [2, 2, 2, 1, 3]
    assert Filter(2020, 2025, 1000, ("AI", "NLP")).summary() == "2020–2025 · 1,000+ citations · AI, NLP"
    assert FeedRequest.of(99, "x", 99) == FeedRequest(8, "", 50)
    assert valid_query_text("é" * 100) and not valid_query_text("é" * 101) and not valid_query_text("  ")
    assert list(one(spark, newest_excluded(F.sequence(F.lit(1), F.lit(1030))))[0])[:2] == [7, 8]


@pytest.fixture(scope="module")
def index(spark):
    papers = synth.generate(spark, 1500, 32, 5)
    plain = search.quantized(papers)
    return search.build_index(papers, search.kmeans(plain, 12)).cache(), search.kmeans(plain, 12)


def test_index_rows_are_grouped_by_cluster(index):
    rows = index[0].select("row", "cluster", "id").orderBy("row").toPandas()
    assert rows["row"].tolist() == list(range(1500)) and rows["cluster"].is_monotonic_increasing


def test_search_against_brute_force(spark, index):
    idx, centroids = index
    queries = idx.where("id < 6").select(F.col("id").alias("query_id"), F.transform("q", lambda x: x * F.col("scale")).alias("u"), "q", "scale")
    pdf = idx.toPandas()
    x = np.stack(pdf["q"]).astype(int)
    hits = search.exact_topk(idx, queries, 20).toPandas()
    for q, g in hits.groupby("query_id"):
        s = x @ x[pdf.index[pdf["id"] == q][0]] * pdf["scale"].to_numpy()
        order = np.lexsort((pdf["row"].to_numpy(), -s))[:20]
        assert g.sort_values("rank")["id"].tolist() == pdf["id"].to_numpy()[order].tolist()
        assert g.sort_values("rank")["id"].iloc[0] == q
    every = search.ivf_topk(idx, centroids, queries, 20, 12).toPandas()
    assert sorted(map(tuple, every[["query_id", "id"]].to_numpy())) == sorted(map(tuple, hits[["query_id", "id"]].to_numpy()))
    some = search.ivf_topk(idx, centroids, queries, 20, 4)
    assert search.recall(some, search.exact_topk(idx, queries, 20)).first()["recall"] > 0.8
    banned = hits.groupby("query_id").head(3)[["query_id", "id"]]
    left = search.exact_topk(idx, queries, 20, exclude=spark.createDataFrame(banned)).toPandas()
    assert len(left) == 120 and not set(map(tuple, banned.to_numpy())) & set(map(tuple, left[["query_id", "id"]].to_numpy()))
    assert search.exact_topk(idx, queries, 0).count() == 0


@pytest.mark.parametrize("f", [Filter(2010, 2015), Filter(cited_min=400), Filter(venues=("Venue 03",)), Filter(fields=("Field 02",), topics=(10003,), year_min=2020), Filter(venues=("none",))])
@pytest.mark.parametrize("nprobe", [0, 2])
def test_filtered_search(index, f, nprobe):
    idx, centroids = index
    queries = idx.where("id < 3").select(F.col("id").alias("query_id"), F.transform("q", lambda x: x * F.col("scale")).alias("u"), "q", "scale")
    got = search.filtered_topk(idx, centroids, queries, f, 50, nprobe)
    want = min(50, f.apply(idx).count())
    assert {r["query_id"]: r["count"] for r in got.groupBy("query_id").count().collect()} == ({0: want, 1: want, 2: want} if want else {})
    assert got.join(f.apply(idx).select("id"), "id", "left_anti").count() == 0


def test_waves_equal_the_loop(index):
    idx, centroids = index
    queries = idx.where("id < 3").select(F.col("id").alias("query_id"), F.transform("q", lambda x: x * F.col("scale")).alias("u"), "q", "scale")
    f = Filter(venues=("Venue 03",))
    got = {(r["query_id"], r["cluster"]) for r in search.wave_probes(idx, centroids, queries, 20, 2, f).collect()}
    eligible = {r["cluster"]: r["count"] for r in f.apply(idx).groupBy("cluster").count().collect()}
    ranks: dict[int, list[int]] = {}
    for r in search.rank_clusters(queries, centroids).orderBy("query_id", "rank").collect():
        ranks.setdefault(r["query_id"], []).append(r["cluster"])
    expected = set()
    for q, order in ranks.items():
        end, wave = 0, 2
        while end < len(order):
            end = min(len(order), end + wave)
            wave *= 2
            if sum(eligible.get(c, 0) for c in order[:end]) >= 20:
                break
        expected |= {(q, c) for c in order[:end]}
    assert got == expected


def test_sampling_favours_high_scores(spark):
    hits = spark.createDataFrame([(q, i, 0.9 - 0.005 * i) for q in range(200) for i in range(100)], "query_id long, id long, score double")
    got = feed.sample(hits, 8, "s").toPandas()
    assert len(got) == 1600 and not got.duplicated(["query_id", "id"]).any()
    assert (got["id"] < 10).sum() > 5 * (got["id"] >= 90).sum()
    assert feed.sample(hits.where("id < 5 and query_id = 0"), 8, "s").orderBy("slot").toPandas()["id"].tolist() == [0, 1, 2, 3, 4]


def test_random_rows_match_and_are_never_short(index):
    f = Filter(venues=("Venue 03",))
    assert feed.random_rows(index[0], 10_000, "a", f).count() == f.apply(index[0]).count()
    assert feed.random_rows(index[0], 5, "a", Filter(venues=("none",))).count() == 0


def test_token_bucket(spark):
    rows = [("a", i, dt.datetime(2024, 1, 1)) for i in range(4)] + [("b", 9, dt.datetime(2024, 1, 1)), ("a", 10, dt.datetime(2024, 1, 1, 0, 0, 2))]
    got = {r["event_id"]: r["allowed"] for r in metrics.token_bucket(spark.createDataFrame(rows, "k string, event_id long, ts timestamp"), "k", 1, 3).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 9: True, 10: True}


def test_streaming_token_bucket_equals_the_batch(spark, tmp_path):
    rows = [(str(i % 3), i, dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=250 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, event_id long, ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = jobs.limited(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k", 1, 3).writeStream.format("memory").queryName("bucket").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {(r["event_id"], r["allowed"]) for r in metrics.token_bucket(df, "k", 1, 3).collect()}
    assert {(r["event_id"], r["allowed"]) for r in spark.table("bucket").collect()} == batch


WORKS = [
    {"id": "https://w.example/W1", "title": "A <i>long</i> enough title", "abstract_inverted_index": {"word": list(range(0, 60)), "last": [60]}, "publication_year": 2020, "language": "en", "cited_by_count": 3, "authorships": [{"author": {"display_name": n}} for n in ["Ann", "", None, "Bo"]], "primary_topic": {"id": "https://t.example/T1", "display_name": "Topic", "field": {"id": "https://f.example/17", "display_name": "CS"}}},
    {"id": "W2", "title": "Front matter of it", "abstract_inverted_index": {"word": list(range(60))}, "language": "en", "primary_topic": {"id": "T1", "field": {"id": "x/17"}}},
    {"id": "W3", "title": "Another good title", "abstract_inverted_index": {"word": list(range(60))}, "language": None, "primary_topic": {"id": "T2", "field": {"id": "x/17", "display_name": "CS"}}},
    {"id": "W4", "title": "Another good title", "abstract_inverted_index": None, "language": "de", "primary_topic": None},
]


def test_convert_and_classify(spark, tmp_path):
    import gzip

    (tmp_path / "a").mkdir()
    with gzip.open(tmp_path / "a" / "part.gz", "wt") as f:
        f.write("\n".join(map(json.dumps, WORKS)))
    works = files.snapshot(spark, str(tmp_path))
    assert works.schema == WORK and works.count() == 4
    topics = spark.createDataFrame([("T1", "Programming"), ("T2", None)], "topic_id string, category string")
    subs = spark.createDataFrame([("1705", "Networks")], "subfield_id string, category string")
    rows = ingest.convert(works, topics, subs).collect()
    assert [(r["id"], r["title"], r["field"], list(r["authors"]), r["abstract"].split()[-1]) for r in rows] == [(1, "A long enough title", "Programming", ["Ann", "Bo"], "last")]
    asked = {r["id"]: r["field"] for r in ingest.convert(works, topics, subs, requested=True).collect()}
    assert asked == {1: "Programming", 3: "CS"}
    df = spark.createDataFrame([("T1", "", "x"), ("T2", "1705", "x"), ("T9", "1705", "x"), ("T9", "", "Given"), (None, None, None)], "topic_id string, subfield_id string, field_name string")
    got = [(r["category"], r["excluded"]) for r in ingest.classify(df, topics, subs).collect()]
    assert sorted(got, key=str) == sorted([("Programming", False), (None, True), ("Networks", False), ("Given", False), ("Other", False)], key=str)


def test_dedupe_keeps_the_first(spark):
    batch = spark.createDataFrame([(1, "A b!", 0), (1, "Other", 1), (2, "a-B", 2), (3, "日本", 3), (4, "中国", 4), (5, "old", 5)], "id long, title string, seq long")
    old = spark.createDataFrame([(5, "whatever"), (6, "x")], "id long, title string")
    assert sorted(r["id"] for r in ingest.new_papers(batch, old).collect()) == [1, 3]


def test_rebuild_due():
    assert ingest.rebuild_due(1, 0, None) and not ingest.rebuild_due(0, 10, 9) and ingest.rebuild_due(1, 10, 6) and not ingest.rebuild_due(1999, 10, 1) and ingest.rebuild_due(3000, 30000, 1)


def test_scalars(spark):
    row = one(spark, S.fnv32(F.lit("PLDI")), S.fnv32(F.lit("")), S.thousands(F.lit(331210)), S.topic_number(F.lit("https://t/T65536")), S.duration(F.lit(7200)), S.description(F.lit("a" * 350)))
    assert list(row)[:5] == [1754418250, 0, "331,210", 0, "2.0 h"] and row[5] == "a" * 200 + "…"
    inverted = F.create_map(F.lit("b"), F.array(F.lit(1), F.lit(4)), F.lit("a"), F.array(F.lit(0)))
    assert one(spark, X.rebuild_text(inverted))[0] == "a b b"
    assert one(spark, X.clean(F.lit("a\\nb <b>c</b>  d ")))[0] == "a b c d"
    assert one(spark, metrics.ewma(F.array(F.lit(1.0), F.lit(2.0))))[0] == pytest.approx(1.2)
    assert search.auto_nlist(199_999) == 0 and search.auto_nlist(8_300_000) == 4096 and search.auto_nlist(200_000) == 512


def test_texts_are_inverted_and_stemmed_without_moving_words(spark):
    rows = spark.createDataFrame([(1, "b a  b\x0bc\n"), (2, None), (3, "")], "i int, s string").select("i", X.invert_text("s").alias("m"), X.stems(F.split("s", " ")).alias("t"))
    got = {r["i"]: (r["m"], r["t"]) for r in rows.collect()}
    assert got[1][0] == {"b": [0, 2], "a": [1], "c": [3], "": [4]} and got[2] == ({"": [0]}, None) and got[3][0] == {"": [0]}
    assert "Exchange" not in rows.coalesce(1)._jdf.queryExecution().executedPlan().toString().replace("CoalesceExchange", "")


def test_durations_are_rounded_by_their_exact_value(spark):
    """Every tenth of an hour and of a day, and the halves between them, as printf writes them."""
    n = [*range(5400, 172800, 60), *range(172800, 3_000_000, 4320), 5940, 2**40 + 1, 2**50]
    want = [f"{x / 3600:.1f} h" if x < 172800 else f"{x / 86400:.1f} days" for x in n]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in n], "n long").coalesce(1).select(S.duration(F.col("n"))).collect()] == want


def test_index_is_versioned_and_readers_keep_their_build(spark, index, tmp_path):
    path = f"{tmp_path}/index"
    sinks.write_index(index[0], path, 2)
    first = files.index_scan(spark, path)
    sinks.write_index(index[0].where("id < 10"), path, 1)
    assert (first.count(), files.index_scan(spark, path).count()) == (1500, 10)
    assert sorted(r["id"] for r in files.lookup(first, ["W3", "https://x/W4", "5", "bad"]).collect()) == [3, 4, 5]


def test_matrix_ignores_an_incomplete_row(spark, tmp_path):
    np.arange(7, dtype="<f4").tofile(tmp_path / "m.f32")
    assert [list(r["embedding"]) for r in files.matrix(spark, str(tmp_path / "m.f32"), 3).collect()] == [[0, 1, 2], [3, 4, 5]]


def test_append_new_twice(spark, tmp_path):
    batch = spark.createDataFrame([(1, "One title", 0), (2, "two", 1)], "id long, title string, seq long")
    for _ in range(2):
        sinks.append_new(batch, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2


def test_crawl_source_batch_and_stream(spark, tmp_path):
    for n, found in enumerate([[{"id": "W1", "publication_year": 2020}], [], [{"id": "W2"}, {"id": "W3", "publication_year": 1990}]]):
        (tmp_path / f"page-{n:06d}.json").write_text(json.dumps(found))
    spark.dataSource.register(Works)
    assert sorted(r["id"] for r in spark.read.format("works").option("path", str(tmp_path)).load().collect()) == ["W1", "W2", "W3"]
    q = spark.readStream.format("works").option("path", str(tmp_path)).option("since", "2000").option("pagesPerTrigger", 2).load().writeStream.format("memory").queryName("works_in").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["id"] for r in spark.table("works_in").collect()] == ["W1"]
    parsed = works(spark.read.format("works").option("path", str(tmp_path)).load())
    assert parsed.schema == WORK and {r["id"]: r["publication_year"] for r in parsed.collect()} == {"W1": 2020, "W2": None, "W3": 1990}


def test_sitemap_chunks(spark):
    pages = spark.createDataFrame([(0, "a"), (48_998, "b"), (48_999, "c"), (49_999, "d")], "row long, url string")
    got = {(r["chunk"], r["line"]) for r in sinks.sitemap(pages, home="/").collect()}
    assert got == {(0, "/"), (0, "a"), (0, "b"), (0, "c"), (1, "d")}


def test_sitemap_files_are_written_by_chunk(spark, tmp_path):
    sinks.write_sitemap(spark.createDataFrame([(0, "a"), (49_999, "d")], "row long, url string"), f"file://{tmp_path}/map", home="/")
    got = {p.name: sorted("".join(f.read_text() for f in p.glob("*.txt")).split()) for p in (tmp_path / "map").glob("chunk=*")}
    assert got == {"chunk=0": ["/", "a"], "chunk=1": ["d"]}


def test_backfill_progress(spark):
    row = one(spark, *metrics.backfill_progress(F.lit(50), F.lit(200), F.lit(10), F.lit(2.0), F.lit(25)))
    assert row[0] == 25 and math.isclose(row[1], (150 * 0.5 + 10) / 2)


def test_embedding_hook(spark):
    from driftline.operators.embed import embed

    df = spark.createDataFrame([(i, "x" * i) for i in range(10)] + [(10, None)], "id long, text string")
    got = {r["id"]: list(r["embedding"]) for r in embed(df, lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), batch=3).collect()}
    assert got == {i: [float(i), 1.0] for i in range(10)} | {10: [0.0, 1.0]}


def test_abstracts_are_rebuilt_whole(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert sum("\n" in r["text"] for r in d) > len(d) / 2
    got = text_queries.abstract_rebuild(spark, sf).collect()
    want = {r["doc_id"]: re.sub(r"[ \t\n\x0b\x0c\r]+", " ", re.sub(r"<[^>]+>", "", r["text"].replace("\\n", " "))).strip(" ") for r in d}
    assert len(got) == len(d) and {r["doc_id"]: r["abstract"] for r in got} == want


# filters and exclusions as data


def _asked(idx, n):
    return idx.where(f"id < {n}").select(F.col("id").alias("query_id"), F.transform("q", lambda x: x * F.col("scale")).alias("u"), "q", "scale")


def _brute(pdf, queries, k, may):
    """(query, id) of the best k rows that ``may(query, row)`` allows."""
    x, out = np.stack(pdf["q"]).astype(int), set()
    for q in queries:
        s = x @ x[pdf.index[pdf["id"] == q][0]] * pdf["scale"].to_numpy()
        keep = np.array([may(q, r) for r in pdf.itertuples()])
        order = [i for i in np.lexsort((pdf["row"].to_numpy(), -s)) if keep[i]][:k]
        out |= {(q, int(pdf["id"].iloc[i])) for i in order}
    return out


def _own_filter(q):
    return Filter(2000 + q % 25 if q % 3 else 0, 2020 if q % 4 == 0 else 0, 100 * (q % 5), (f"Field {q % 7:02d}",) if q % 2 else (), (10000 + q % 9,) if q % 2 else (), (f"Venue {q % 20:02d}", "none") if q % 6 == 0 else ())


def _allows(f, r):
    return (not f.year_min or r.year >= f.year_min) and (not f.year_max or 0 < r.year <= f.year_max) and r.cited >= f.cited_min and (not (f.fields or f.topics) or r.field in f.fields or r.topic in f.topics) and (not f.venues or r.venue in f.venues)


@pytest.mark.parametrize("chunk", [4096, 7])
def test_every_query_with_a_filter_and_seen_papers_of_its_own(spark, index, monkeypatch, chunk):
    """One scan, or blocks of rows and queries: the rows that brute force finds."""
    idx, centroids = index
    monkeypatch.setattr(search, "QUERY_CHUNK", chunk)
    monkeypatch.setattr(search, "EXACT_ROWS", 300)
    queries, pdf = _asked(idx, 40), idx.toPandas()
    filters = {q: _own_filter(q) for q in range(40)}
    seen = {(q, i) for q in range(0, 40, 2) for i in range(q, 1500, 3)} | {(999, 1), (0, 10**9)}
    banned = spark.createDataFrame(sorted(seen), "query_id long, id long")
    got = search.mixed_topk(idx, queries, filters, 15, exclude=banned)
    assert {(r["query_id"], r["id"]) for r in got.collect()} == _brute(pdf, range(40), 15, lambda q, r: _allows(filters[q], r) and (q, r.id) not in seen)
    near = search.ivf_topk(idx, centroids, queries, 15, 11, exclude=banned).join(banned, ["query_id", "id"], "left_semi")
    assert near.count() == 0


def test_two_thousand_filters_are_one_scan(spark, index):
    idx, _ = index
    pdf = idx.toPandas()
    queries = idx.where("id < 5").crossJoin(spark.range(400).select(F.col("id").alias("n"))).select((F.col("id") * 400 + F.col("n")).alias("query_id"), "q", "scale")
    filters = {q: Filter(cited_min=q % 500, year_min=1990 + q % 30, venues=(f"Venue {q % 20:02d}",)) for q in range(2000)}
    hits = search.mixed_topk(idx, queries, filters, 3)
    assert hits._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2
    got = {}
    for r in hits.collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    x = np.stack(pdf["q"]).astype(int)
    for q in range(0, 2000, 41):
        s = x @ x[pdf.index[pdf["id"] == q // 400][0]] * pdf["scale"].to_numpy()
        keep = np.array([_allows(filters[q], r) for r in pdf.itertuples()])
        assert got.get(q, set()) == {int(pdf["id"].iloc[i]) for i in [i for i in np.lexsort((pdf["row"].to_numpy(), -s)) if keep[i]][:3]}


def test_tasks_pass_on_no_more_than_k_rows_whatever_was_seen(spark, index):
    idx, _ = index
    queries = _asked(idx, 3)
    banned = spark.range(5000).select((F.col("id") % 3).alias("query_id"), F.floor(F.col("id") / 3).alias("id"))
    points = idx.select("id", "row", "scale", "q").repartition(4)
    asked = queries.select("query_id", "q", "scale", F.lit(6).alias("k"))
    rows = search._by_scan(points, asked, None, banned.where("id < 1450"))
    most = rows.groupBy(F.spark_partition_id(), "query_id").count().agg(F.max("count")).first()[0]
    assert most <= 6 and {r["id"] for r in search.exact_topk(idx, queries, 6, exclude=banned.where("id < 1495")).collect()} <= set(range(1495, 1500))


def test_only_the_newest_seen_papers_count(spark, index):
    idx, _ = index
    seen = spark.createDataFrame([(0, i, i) for i in range(1400)] + [(0, 5, 5000)], "query_id long, id long, ts long")
    left = {r["id"] for r in search.exact_topk(idx, _asked(idx, 1), 1500, exclude=seen).collect()}
    assert left == set(range(1500)) - set(range(1400 - EXCLUDE_LIMIT + 1, 1400)) - {5}


def test_bitmaps_are_the_predicates(spark):
    """Null attributes too."""
    rows = [(i, *r) for i, r in enumerate((y, c, f, t, v) for y in (0, 2010, None) for c in (0, 500, None) for f in ("a", None) for t in (1, None) for v in ("x", "", None))]
    df = spark.createDataFrame(rows, "id long, year int, cited long, field string, topic int, venue string")
    filters = [Filter(), Filter(2010), Filter(0, 2015), Filter(0, 0, 1), Filter(fields=("a", "zz")), Filter(topics=(1,)), Filter(fields=("b",), topics=(1, 2)), Filter(venues=("x",)), Filter(2000, 2020, 400, ("a",), (), ("x", "y"))]
    got = bitmaps(filters, df.orderBy("id").toArrow())
    for f, line in zip(filters, got, strict=False):
        assert np.flatnonzero(line).tolist() == sorted(r["id"] for r in f.apply(df).collect())
    assert got[-1].all() and bitmaps(filters, df.drop("year").toArrow()).all()


def test_waves_leave_out_what_was_seen(spark, index):
    idx, centroids = index
    f = Filter(venues=("Venue 03",))
    seen = f.apply(idx).select(F.lit(0).cast("long").alias("query_id"), "id").where("id % 2 = 0")
    got = search.filtered_topk(idx, centroids, _asked(idx, 2), f, 20, 1, exclude=seen).toPandas()
    free = f.apply(idx).where("id % 2 = 1").count()
    assert (got["query_id"] == 0).sum() == min(20, free) and not (got[got["query_id"] == 0]["id"] % 2 == 0).any()


# feeds of many users


def test_walks_against_brute_force(spark, index):
    idx, _ = index
    f = Filter(venues=("Venue 03", "Venue 04"))
    places = feed.ring(idx, "s", f).cache()
    order = [r["id"] for r in places.orderBy("place").collect()]
    assert sorted(order) == sorted(r["id"] for r in f.apply(idx).collect()) and [r["place"] for r in places.orderBy("place").collect()] == list(range(len(order)))
    rng = np.random.default_rng(4)
    skip = {(q, int(i)) for q in range(30) for i in rng.choice(order, int(rng.integers(0, len(order) + 1)), replace=False)} | {(q, i) for q in (3,) for i in order} | {(1, 10**9)}
    users = spark.range(32).select(F.col("id").alias("query_id"))
    got = {}
    for r in feed.walks(places, users, 9, "s", spark.createDataFrame(sorted(skip), "query_id long, id long")).orderBy("query_id", "turn").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    start = {r["id"]: r["at"] for r in spark.range(32).select("id", F.floor(unit_hash(F.col("id"), F.lit("s"), F.lit("at")) * len(order)).alias("at")).collect()}
    for q in range(32):
        assert got.get(q, []) == [i for i in order[start[q] :] + order[: start[q]] if (q, i) not in skip][:9]
    assert feed.walks(places.limit(0), users, 9, "s").count() == 0


def test_feeds_of_a_batch_are_whole(spark, index):
    """No paper twice, none that was seen, k of them; users without candidates get random ones."""
    idx, _ = index
    queries = _asked(idx, 50)
    seen = spark.createDataFrame([(q, i, 1) for q in range(50) for i in range(q, 1500, 2)], "query_id long, id long, ts int")
    hits = search.exact_topk(idx, queries.where("query_id < 45"), 100, exclude=seen).select("query_id", "id", "score").where("query_id <> 7 or id < 300")
    feeds = feed.next_feeds(hits, feed.ring(idx, "z"), queries, 8, "z", seen).toPandas()
    newest = {(r["query_id"], r["id"]) for r in newest_pairs(seen).collect()}
    assert feeds.groupby("query_id").size().tolist() == [8] * 50 and not feeds.duplicated(["query_id", "id"]).any() and not feeds.duplicated(["query_id", "slot"]).any()
    assert not newest & set(zip(feeds["query_id"], feeds["id"], strict=True)) and set(feeds["slot"]) == set(range(1, 9))
    assert set(feeds[feeds["query_id"] >= 45]["reason"]) == {"random"} and 0.05 < (feeds["reason"] == "explore").mean() < 0.3
    assert len({tuple(g["id"]) for _, g in feeds[feeds["query_id"] >= 45].groupby("query_id")}) == 5
