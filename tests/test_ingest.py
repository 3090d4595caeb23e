"""The ingest loop and what it is made of: crawl, text index, versions, positional joins."""

import http.server
import json
import math
import threading
from collections import Counter
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import text as X
from driftline.functions import vectors as V
from driftline.operators import feed, fts, metrics, search, taste
from driftline.operators.filters import Filter
from driftline.plans import text_queries, vector_queries
from driftline.plans.tables import papers, unit_vectors
from driftline.sources import crawl, files, shared, sinks, synth
from driftline.sources.textindex import TextIndex
from driftline.streaming.loop import Ingest, Limits


def work(n, cited=0, day="2024-01-01", title=None, subject="17"):
    return {
        "id": f"https://w.example/W{n}",
        "title": title or f"Title number {n} of all",
        "abstract_inverted_index": {"words": list(range(59)), f"own{n}": [59]},
        "publication_year": int(day[:4]),
        "publication_date": day,
        "language": "en",
        "cited_by_count": cited,
        "primary_topic": {"id": "https://t.example/T1", "field": {"id": f"https://f.example/{subject}", "display_name": "CS"}},
    }


class Server:
    """An API over some works: pages of two by cursor, filters by date and ids, and answers that are set to fail."""

    def __init__(self):
        self.works, self.fail, self.empty_at, self.asked = [], [], None, []
        outer = self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                outer.asked.append(q)
                if outer.fail:
                    code, after = outer.fail.pop(0)
                    self.send_response(code)
                    if after:
                        self.send_header("Retry-After", after)
                    self.end_headers()
                    return
                rows = outer.works
                for f in filter(None, q.get("filter", "").split(",")):
                    name, value = f.split(":", 1)
                    rows = [w for w in rows if (w["publication_date"] >= value if name == "from_publication_date" else w["id"].rsplit("/", 1)[-1] in value.split("|"))]
                key = "cited_by_count" if q.get("sort", "").startswith("cited") else "publication_date"
                rows = sorted(rows, key=lambda w: w[key], reverse=True)
                at = 0 if q["cursor"] == "*" else int(q["cursor"])
                page = rows if "ids:" in q.get("filter", "") else rows[at : at + 2]
                if outer.empty_at == at and "filter" not in q:
                    page, outer.empty_at = [], None
                more = str(at + 2) if at + 2 < len(rows) and "ids:" not in q.get("filter", "") else None
                body = json.dumps({"results": page, "meta": {"count": len(rows), "next_cursor": more if page else None}}).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/works"


@pytest.fixture
def server():
    s = Server()
    yield s
    s.server.shutdown()


def test_requests_are_tried_again(server):
    server.works = [work(1)]
    waits = []
    server.fail = [(503, None), (429, "1")]
    assert len(crawl.get_json(server.url + "?cursor=*", waits.append)["results"]) == 1 and waits == [0.4, 0.8]
    server.fail = [(429, "3600")]
    with pytest.raises(crawl.Throttled) as e:
        crawl.get_json(server.url + "?cursor=*", waits.append)
    assert e.value.retry_after == 3600
    server.fail = [(404, None)]
    with pytest.raises(Exception, match="404"):
        crawl.get_json(server.url + "?cursor=*", waits.append)
    server.fail = [(500, None)] * 4
    with pytest.raises(Exception, match="500"):
        crawl.get_json(server.url + "?cursor=*", waits.append)


def test_single_works_are_looked_up_once_in_a_while(server):
    server.works, now = [work(1), work(2)], [0.0]
    look = crawl.Lookup(crawl.Api(server.url), clock=lambda: now[0])
    assert [look.work("W2")["id"], look.work("W2")["id"], look.work("W9")] == ["https://w.example/W2", "https://w.example/W2", None] and len(server.asked) == 2
    now[0] = 601.0
    assert look.work("W2") and len(server.asked) == 3


def test_cursor_crawl_over_http(spark, server):
    server.works = [work(n, cited=n, day=f"20{10 + n}-01-01") for n in range(7)]
    spark.dataSource.register(crawl.Works)
    rows = spark.read.format("works").option("path", server.url).option("sort", "cited_by_count:desc").load()
    assert [r["id"][-2:] for r in rows.orderBy("page").collect()][::2] == ["W6", "W4", "W2", "W0"] and rows.count() == 7
    late = spark.read.format("works").option("path", server.url).option("since", "2014-01-01").load()
    assert sorted(r["publication_year"] for r in crawl.works(late).collect()) == [2014, 2015, 2016]


def loop(spark, server, tmp_path, clock, **limits):
    topics = spark.createDataFrame([("T1", "Programming")], "topic_id string, category string")
    subs = spark.createDataFrame([], "subfield_id string, category string")
    model = lambda: lambda texts: np.array([[len(t), len(set(t)), 1.0] for t in texts], float)
    return Ingest(spark, f"file://{tmp_path}/home", crawl.Api(server.url, size=2), model, topics, subs, Limits(**({"pages": 2} | limits)), lambda: clock[0])


def test_rounds_of_the_loop(spark, server, tmp_path):
    """Backfill by pages, back-pressure, an empty page, requested ids, the two-week margin, builds, and a restart."""
    server.works = [work(n, cited=100 - n) for n in range(9)] + [work(50, title="Title number 1 of all", cited=1)]
    clock = [1_700_000_000.0]
    job = loop(spark, server, tmp_path, clock)
    server.empty_at = 4
    did = job.round()
    assert (did["backfill"], did["embed"], did["build"]) == (4, 4, 1) and job.state["cursor"] == "4"
    assert job.round()["backfill"] == 0 and job.paused() and not job.state["done"]  # an empty page long before the end
    assert "backfill" not in job.round()
    clock[0] += 1801
    job = loop(spark, server, tmp_path, clock)  # a restart goes on where the state says
    assert job.round()["backfill"] == 4 and job.state["cursor"] == "8"
    did = job.round()
    assert did["backfill"] == 2 and job.state["done"] and did["new"] == 0
    ids = sorted(r["id"] for r in job.papers().collect())
    assert ids == list(range(9))  # W50 has a title that is there
    assert job.queue() == 0 and sorted(r["id"] for r in job.vectors().collect()) == ids
    # what was asked for is looked up, whatever its subject, and not again within a week
    server.works.append(work(77, subject="18"))
    spark.createDataFrame([("W77", 1), ("W78", 2), ("bad", 3), ("W3", 4)], "id string, ts long").coalesce(1).write.json(f"file://{tmp_path}/home/pending")
    asked = len(server.asked)
    assert job.round()["pending"] == 1
    assert [q["filter"] for q in server.asked[asked:]] == ["ids:W77|W78"]
    asked = len(server.asked)
    assert job.round()["pending"] == 0 and len(server.asked) == asked
    # new works: those published since two weeks before the last look
    clock[0] += 7 * 3600
    server.works += [work(90, day="2023-11-10"), work(91, day="2023-10-01")]
    did = job.round()
    assert "from_publication_date:2023-10-31" in [q.get("filter") for q in server.asked]
    assert did["new"] >= 1 and 90 in {r["id"] for r in job.papers().collect()} and 91 not in {r["id"] for r in job.papers().collect()}
    assert did["build"] == 1 and files.index_scan(spark, f"{job.home}/index").count() == 11  # six hours old
    found = job.text.search(job.papers().withColumn("cited", F.col("cited_by")), "title number 90")
    assert found.orderBy("place").first()["id"] == 90
    row = job.status().first()
    assert (row["fetched"], row["embedded"], row["indexed"], row["queue"]) == (11, 11, 11, 0) and shared.read_pointer(spark, f"{job.home}/status")["queue"] == 0
    # labels of a new version: excluded papers leave the text index, asked ones stay
    labels = spark.createDataFrame([(90, None, True), (77, None, True), (3, "Systems", False)], "id long, category string, excluded boolean")
    assert job.relabel(labels, "v2") and not job.relabel(labels, "v2")
    got = {r["id"]: (r["field"], r["excluded"]) for r in job.papers().collect()}
    assert got[90][1] and got[77] == ("Other", False) and got[3] == ("Systems", False) and got[4] == ("Programming", False)
    assert 90 not in {r["id"] for r in job.text.documents().collect()}


def test_loop_waits_when_throttled_and_when_many_wait(spark, server, tmp_path):
    server.works = [work(n) for n in range(6)]
    clock = [1_700_000_000.0]
    job = loop(spark, server, tmp_path, clock, embed=1, queue=3)
    server.fail = [(429, "600")]
    assert "backfill" not in job.round() and job.paused()
    clock[0] += 661
    assert job.round() == {"pending": 0, "backfill": 4, "new": 0, "embed": 1, "build": 1}
    assert job.round()["backfill"] == 0 and job.queue() == 2  # three waited before it
    slept = []
    assert job.run(1, slept.append)[0]["backfill"] == 2 and not slept


# text index


def brute_stemmed_search(rows, q):
    """(id, tier) of the first page with stemmed words, all of which must be there, by title matches first and BM25."""
    import re

    words = lambda s: [w for w in re.findall(r"[^\W_]+", s.lower()) if w not in X.STOP_WORDS]
    stem = lambda s: [X.Porter.stem(X.fold(w)) for w in words(s)]
    query = stem(q)

    def scores(docs, weights):
        length = {i: sum(len(c) for c in cols) for i, cols in docs.items()}
        length = {i: n for i, n in length.items() if n}
        average, n = sum(length.values()) / len(length), len(length)
        tf = {i: {t: sum(w * c.count(t) for c, w in zip(cols, weights, strict=True)) for t in query} for i, cols in docs.items()}
        phrase = {i: sum(w * sum(c[k : k + len(query)] == query for k in range(len(c))) for c, w in zip(cols, weights, strict=True)) for i, cols in docs.items()}
        for i in tf:
            tf[i]["#"] = phrase[i]
        seen = {t: sum(1 for i in tf if tf[i][t]) for t in [*query, "#"]}
        out = {}
        for i, f in tf.items():
            if all(f[t] for t in query):
                out[i] = sum(max(1e-6, math.log((n - seen[t] + 0.5) / (seen[t] + 0.5))) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * length[i] / average)) for t, x in f.items() if x)
        return out

    docs = {r["id"]: (stem(r["title"]), stem(r["abstract"])) for r in rows}
    cited = {r["id"]: r["cited"] for r in rows}
    top = scores({i: c[:1] for i, c in docs.items()}, (1.0,))
    rest = {i: s for i, s in scores(docs, (10.0, 1.0)).items() if i not in top}
    ranked = [(tier, s + 0.15 * math.log1p(cited[i]), i) for tier, hits in ((1, top), (2, rest)) for i, s in hits.items()]
    return [(i, tier, round(s, 5)) for tier, s, i in sorted(ranked, key=lambda x: (x[0], -x[1], x[2]))[:20]]


def test_stemmed_search_against_brute_force(spark, sf):
    got = [(r["id"], r["tier"], r["score"]) for r in text_queries.fts_stemmed(spark, sf).orderBy("place").collect()]
    want = brute_stemmed_search(papers(spark, sf).collect(), "Licenses released")
    assert got and [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-5)


def test_text_index_upserts_merges_and_knows_its_offset(spark, tmp_path, monkeypatch):
    p = lambda *rows: spark.createDataFrame(rows, "id long, title string, abstract string, excluded boolean")
    index = TextIndex(spark, f"file://{tmp_path}/t", stemmed=True)
    assert index.postings().count() == 0 and index.documents().count() == 0
    assert index.sync(p((1, "Neural networks", "a", False), (2, "Graphs", "b", False), (3, "Gone", "c", True)), 5)
    assert not index.sync(p((9, "late", "", False)), 5) and not index.delete(p((1, "", "", False)), 4)
    assert sorted(r["term"] for r in index.postings().where("col = 'title'").collect()) == ["graph", "network", "neural"]
    assert index.sync(p((2, "Résumé network", "b", False)), 6)
    again = TextIndex(spark, f"file://{tmp_path}/t", stemmed=True)
    terms = lambda i: sorted((r["id"], r["term"]) for r in i.postings().where("col = 'title'").collect())
    assert terms(again) == [(1, "network"), (1, "neural"), (2, "network"), (2, "resum")]
    facts = spark.createDataFrame([(1, 0, 2000), (2, 5, 2001)], "id long, cited long, year int")
    assert [r["id"] for r in again.search(facts, "NETWORKS").orderBy("place").collect()] == [2, 1]
    assert again.search(facts, "x" * 201).count() == 0 and again.search(facts, "the of").count() == 0
    assert again.delete(p((1, "", "", False)), 7) and terms(again) == [(2, "network"), (2, "resum")]
    monkeypatch.setattr("driftline.sources.textindex.MERGE_AT", 1)
    assert again.sync(p((4, "fourth", "", False)), 8)
    assert len(again.state["segments"]) == 1 and again.state["docs"] == 2 and terms(TextIndex(spark, f"file://{tmp_path}/t", stemmed=True)) == [(2, "network"), (2, "resum"), (4, "fourth")]
    with pytest.raises(ValueError):
        TextIndex(spark, f"file://{tmp_path}/t")


def test_stored_and_unstored_scores_are_the_same(spark, tmp_path):
    """Papers without any word count for neither."""
    rows = [(i, f"title {'graph ' * (i % 3)}of {i}", f"{'graph theory ' * (i % 4)}and {'more ' * i}", i, 2000 + i) for i in range(1, 30)] + [(40 + i, "", "the of and", 0, 0) for i in range(5)]
    p = spark.createDataFrame(rows, "id long, title string, abstract string, cited long, year int")
    index = TextIndex(spark, f"file://{tmp_path}/t", columns=("title", "abstract"))
    index.sync(p, 1)
    for q in ("graph", "graph theory", "graph nowhere"):
        want = sorted(tuple(r) for r in fts.search(p, fts.postings(p), q).collect())
        got = sorted(tuple(r) for r in index.search(p, q).collect())
        assert want and [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_results_are_held_for_a_while():
    now, made = [0.0], []
    cache = fts.TtlCache(300, 2, lambda: now[0])
    make = lambda: made.append(1) or len(made)
    assert [cache.get("a", make), cache.get("a", make)] == [1, 1]
    now[0] = 301
    assert cache.get("a", make) == 2 and cache.get("b", make) == 3 and cache.get("c", make) == 4 and cache.get("a", make) == 5


# versions, positions


def test_readers_hold_two_builds(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    idx = search.build_index(synth.generate(spark, 40, 8, 2))
    assert files.Reader(spark, path).rows() is None
    first = sinks.write_index(idx, path, 1)
    reader = files.Reader(spark, path)
    second = sinks.write_index(idx.where("id < 5"), path, 1)
    assert reader.rows().count() == 40 and reader.reload() and not reader.reload()
    assert (reader.rows().count(), reader.rows(first).count(), reader.rows(second).count()) == (5, 40, 5)
    sinks.write_index(idx.where("id < 3"), path, 1)
    assert reader.reload() and reader.rows(first) is None  # stale: the asker falls back to random rows
    assert feed.random_rows(reader.rows(), 2, "s").count() == 2


def test_pointers_change_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/p/current"
    assert shared.read_pointer(spark, path) is None
    for n in range(3):
        shared.write_pointer(spark, path, {"n": n, "s": "é"})
        assert shared.read_pointer(spark, path) == {"n": n, "s": "é"}
    assert [f.name for f in (tmp_path / "p").iterdir() if not f.name.startswith(".")] == ["current"]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i * 37 % 90) for i in range(500)]
    (tmp_path / "f.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = files.numbered_lines(spark, str(tmp_path / "f.txt"))
        assert got.rdd.getNumPartitions() > 1 and {r["i"]: r["line"] for r in got.collect()} == dict(enumerate(lines))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_papers_are_paired_with_rows_by_position(spark, tmp_path):
    rows = [{"id": 100 + i, "title": f"t{i}", "excluded": i == 2} for i in range(6)]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    np.arange(18, dtype="<f4").tofile(tmp_path / "m.f32")
    got = files.paired(spark, str(tmp_path / "p.jsonl"), str(tmp_path / "m.f32"), 3)
    assert {r["id"]: list(r["embedding"]) for r in got.collect()} == {100 + i: [3.0 * i, 3.0 * i + 1, 3.0 * i + 2] for i in range(6) if i != 2}
    with pytest.raises(ValueError):
        files.paired(spark, str(tmp_path / "p.jsonl"), str(tmp_path / "m.f32"), 6)


def test_shared_folder_is_cleaned_up(spark):
    df = shared.stored(spark.range(3), "x")
    assert df.count() == 3 and shared.cleanup(spark)
    assert not shared.exists(spark, df.inputFiles()[0])


# search


def test_kmeans_against_brute_force(spark):
    df = search.quantized(synth.generate(spark, 600, 16, 5))
    got = np.array([r["c"] for r in search.kmeans(df, 7, rounds=4).orderBy("cluster").collect()])
    rows = df.select("id", "u", F.pmod(F.xxhash64(F.lit(7), F.col("id")), F.lit(1 << 30)).alias("h")).orderBy("h", "id").collect()
    x = np.array([r["u"] for r in rows])
    c = x[:7].copy()
    for _ in range(4):
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == k].sum(0) if (near == k).any() else c[k] for k in range(7)])
        c /= np.linalg.norm(c, axis=1)[:, None]
    assert np.allclose(got, c)
    assert search.kmeans(df.limit(0), 7).count() == 0 and search.kmeans(df.limit(3), 7).count() == 3


def test_kmeans_query_lowers_the_distance(spark, sf):
    rows = vector_queries.ivf_kmeans(spark, sf).collect()
    assert sum(r["n"] for r in rows) == unit_vectors(spark, sf).count() and np.average([r["mean"] for r in rows], weights=[r["n"] for r in rows]) > 0.3


@pytest.mark.parametrize("rows", [3, 8192])
def test_many_queries_meet_rows_by_cluster(spark, monkeypatch, rows):
    idx = search.build_index(p := synth.generate(spark, 400, 16, 5), search.kmeans(search.quantized(p), 6))
    centroids = search.mean_centroids(search.quantized(idx), "cluster")
    q = idx.where("id % 9 = 0").select(F.col("id").alias("query_id"), F.transform("q", lambda x: x * F.col("scale")).alias("u"), "q", "scale")
    want = sorted(tuple(r) for r in search.ivf_topk(idx, centroids, q, 7, 3).collect())
    monkeypatch.setattr(search, "QUERY_CHUNK", 10)
    monkeypatch.setattr(search, "BLOCK_ROWS", rows)
    monkeypatch.setattr(search, "BLOCK_CELLS", 64)
    assert sorted(tuple(r) for r in search.ivf_topk(idx, centroids, q, 7, 3).collect()) == want
    exact = sorted(tuple(r) for r in search.exact_topk(idx, q, 7).collect())
    monkeypatch.setattr(search, "QUERY_CHUNK", 4096)
    assert sorted(tuple(r) for r in search.exact_topk(idx, q, 7).collect()) == exact


def test_ranks_of_some_clusters_are_the_first_of_all(spark):
    c = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(9)], "cluster int, c array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "query_id long, u array<double>")
    every = {(r["query_id"], r["rank"]): r["cluster"] for r in search.rank_clusters(q, c).collect()}
    assert len(every) == 45 and [every[0, k] for k in range(1, 10)] == [2, 5, 8, 1, 4, 7, 0, 3, 6]
    some = {(r["query_id"], r["rank"]): r["cluster"] for r in search.rank_clusters(q, c, most=4).collect()}
    assert some == {k: v for k, v in every.items() if k[1] <= 4}


def test_vector_functions_are_linear_and_right(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 300))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, [0.0] * 3), (100, None)], "id long, v array<double>")
    got = {r["id"]: r for r in df.select("id", V.normalize(F.col("v")).alias("u"), V.quantize(F.col("v")).alias("q"), V.clipped(F.col("v")).alias("c")).collect()}
    for i in range(50):
        s = np.abs(x[i]).max() / 127
        assert np.allclose(got[i]["u"], x[i] / np.linalg.norm(x[i])) and list(got[i]["q"]) == np.clip(np.sign(x[i]) * np.floor(np.abs(x[i] / s) + 0.5), -127, 127).tolist()
        assert got[i]["c"] == (np.abs(x[i]) > np.sort(np.abs(x[i]))[294]).sum()
    assert list(got[99]["u"]) == [0.0] * 3 and got[100]["u"] is None


# users and metrics


def test_folded_likes_equal_all_likes(spark):
    likes = spark.createDataFrame([(u, t, t) for u, n in ((1, 5), (2, 3), (3, 1)) for t in range(n)], "user_id long, ts long, id long")
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, v array<double>")
    state = taste.folded_state(likes, vectors, apart=3)
    assert {r["user_id"]: (r["n"], r["base"] is None, len(r["likes"])) for r in state.collect()} == {1: (5, False, 3), 2: (3, True, 3), 3: (1, True, 1)}
    want = {r["user_id"]: list(r["v"]) for r in taste.as_arrays(taste.taste_vectors(likes, vectors), "user_id").collect()}
    assert {r["user_id"]: pytest.approx(list(r["v"])) for r in taste.unfolded(state).collect()} == want


def test_tastes_over_many_small_batches(spark):
    rng = np.random.default_rng(2)
    rows = [(int(u), int(t), int(rng.integers(0, 30))) for u in range(40) for t in range(int(rng.integers(1, 25)))]
    x = rng.normal(size=(30, 5))
    likes = spark.createDataFrame(rows, "user_id long, ts long, id long")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["user_id"]: (r["n"], list(r["v"])) for r in taste.taste_arrays(likes, vectors).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for u in range(40):
        ids = list(dict.fromkeys(i for w, _, i in sorted(rows) if w == u))
        acc = x[ids[0]]
        for i in ids[1:]:
            acc = (acc + x[i]) / 2
        assert got[u][0] == len(ids) and got[u][1] == pytest.approx(acc.tolist())


def test_lists_are_cut_and_bad_states_left_out(spark):
    lists = spark.createDataFrame([(1, list(range(1500)), ["q"])], "user_id long, seen array<long>, searches array<string>")
    out = taste.export_state(lists).unionAll(spark.createDataFrame([(2, "no json"), (3, '{"version": 9}'), (4, '{"version": 1, "seen": [1, null]}')], "user_id long, state string"))
    got = {r["user_id"]: r for r in taste.import_lists(out).collect()}
    assert set(got) == {1, 4} and list(got[1]["seen"]) == list(range(500, 1500)) and list(got[1]["searches"]) == ["q"] and list(got[4]["seen"]) == [1] and list(got[4]["liked"]) == []


def test_imported_vectors_are_checked(spark):
    rows = spark.createDataFrame([([[1.0, 2.0], [1.0], [float("nan"), 1.0], [float("inf"), 1.0], None, [3.0, 4.0]],), ([],), (None,)], "vs array<array<double>>")
    assert [r[0] for r in rows.select(taste.import_state(F.col("vs"), 2)).collect()] == [[[1.0, 2.0], [3.0, 4.0]], [], None]


def test_folding_takes_diacritics_alone():
    assert [X.fold(w) for w in ("caf\u00e9", "\ufb01n", "x\u00b2", "\ud55c\uad6d", "e\u0301")] == ["cafe", "\ufb01n", "x\u00b2", "\ud55c\uad6d", "e"]


def test_percentiles_by_place(spark):
    rng = np.random.default_rng(1)
    data = {"a": rng.integers(0, 9, 1000).astype(float), "b": rng.normal(size=777), "c": np.array([5.0]), "d": np.full(300, 2.0)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "k string, x double")
    got = {r["k"]: (r["p50"], r["p99"]) for r in metrics.place_percentiles(df, "x", "k").collect()}
    assert got == {k: (np.sort(x)[len(x) // 2], np.sort(x)[min(len(x) * 99 // 100, len(x) - 1)]) for k, x in data.items()}


def test_bars_beyond_the_first_are_other(spark):
    rows = spark.createDataFrame([(f"n{i}",) for i in range(12) for _ in range(12 - i)] + [("",), (None,)], "name string")
    got = {r["name"]: (r["n"], r["place"]) for r in taste.bars(rows, "name", 4).collect()}
    assert got == {"n0": (12, 1), "n1": (11, 2), "n2": (10, 3), "Other": (47, 4)}
    assert {r["name"]: r["n"] for r in taste.bars(rows, "name", 13).collect()}["Unknown field"] == 2


def test_texts_are_cut_by_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    from driftline.operators.embed import token_cut

    path = public_tokenizers.path("word_bpe_49k.json")
    text = "some words of a longer text, again and again. " * 20
    cut = token_cut(path, 7)([text, "two words", ""])
    assert cut[1:] == ["two words", ""] and text.startswith(cut[0]) and len(Tokenizer.from_file(path).encode(cut[0], add_special_tokens=False).ids) == 7


def test_pools_are_held_when_small(spark):
    idx = synth.generate(spark, 400, 8, 5).withColumn("cluster", F.lit(0))
    assert feed.pool(idx, Filter()) is None
    held = feed.pool(idx, Filter(venues=("Venue 03",), year_min=2010))
    assert held.count() == Filter(venues=("Venue 03",), year_min=2010).apply(idx).count()
    tastes = synth.taste_queries(search.build_index(idx.drop("cluster")), 5)
    assert {r["query_id"]: r["count"] for r in tastes.groupBy("query_id").count().collect()} == dict.fromkeys(range(5), 8)


def test_maintained_table_takes_each_batch_once(spark, tmp_path):
    from driftline.streaming import jobs

    df = spark.createDataFrame([(i, f"title {i}", i) for i in range(6)], "id long, title string, seq long")
    df.where("id < 3").write.parquet(f"{tmp_path}/in")
    run = lambda: jobs.maintain(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/out", f"{tmp_path}/c", lambda batch, path: sinks.append_new(batch, path)).awaitTermination()
    run()
    df.where("id >= 2").write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    assert Counter(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == Counter(range(6))
