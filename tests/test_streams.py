"""State of streams, page folders, float matrices by ranges, builds that are gone, and parts of a relabelling."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import ingest, search
from driftline.sources import crawl, files, shared, sinks, synth
from driftline.streaming import jobs
from driftline.streaming.loop import Ingest, Limits


class Steps:
    """A stream over a folder that gets rows batch by batch; a restart after each."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, f"file://{path}", schema

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self, make):
        """What the stream gives over the rows that came since the last run."""
        got = []
        with jobs.state_store(self.spark):
            q = make(self.stream()).writeStream.foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option("checkpointLocation", f"{self.path}/c").trigger(availableNow=True).start()
            q.awaitTermination()
        return got


def at(seconds):
    return 1_700_000_000 + seconds


@pytest.fixture
def few(spark):
    """Fewer partitions of state, for speed."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_buckets_go_on_over_restarts_and_idle_keys_expire(spark, tmp_path, few):
    steps = Steps(spark, tmp_path, "k string, event_id long, t long")
    make = lambda s: jobs.limited(s.select("k", "event_id", F.timestamp_seconds("t").alias("ts")), "k", 0.001, 2)
    steps.put([("a", i, at(0)) for i in range(3)] + [("b", 9, at(0))])
    assert sorted(steps.run(make)) == [("a", 0, True), ("a", 1, True), ("a", 2, False), ("b", 9, True)]
    steps.put([("a", 10, at(1)), ("c", 11, at(5))])  # the bucket of a is still empty
    assert sorted(steps.run(make)) == [("a", 10, False), ("c", 11, True)]
    steps.put([("b", 20, at(5000))])  # the watermark passes ten idle minutes of a
    steps.run(make)
    state = spark.read.format("statestore").option("path", f"{steps.path}/c").option("stateVarName", "bucket").load()
    assert [r["key"]["k"] for r in state.collect()] == ["b"]
    steps.put([("a", 30, at(5001)), ("a", 31, at(5001))])
    assert sorted(steps.run(make)) == [("a", 30, True), ("a", 31, True)]


def test_the_setting_of_the_store_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with pytest.raises(ZeroDivisionError), jobs.state_store(spark):
        assert spark.conf.get(name) == jobs.ROCKS
        1 / 0
    assert spark.conf.get(name, None) == before


def test_likes_wait_for_a_build(spark, tmp_path, few):
    """A like before its paper's build, one after it, one that no build has, and each like once."""
    steps = Steps(spark, tmp_path, "user_id long, id long, build long")
    make = lambda s: jobs.waiting_likes(s.where("build is null").select("user_id", "id"), s.where("build is not null").select("id", "build"))
    steps.put([(1, 10, None), (2, 10, None), (1, 11, None), (3, 12, None), (1, 10, None)])
    assert steps.run(make) == []
    steps.put([(None, 10, 1), (None, 99, 1)])
    assert sorted(steps.run(make)) == [(1, 10, 1), (2, 10, 1)]
    steps.put([(None, 10, 2), (None, 11, 2), (4, 10, None), (5, 99, None)])
    assert sorted(steps.run(make)) == [(1, 11, 2), (4, 10, 1), (5, 99, 1)]


def test_trailing_sums_over_batches(spark, tmp_path, few):
    steps = Steps(spark, tmp_path, "kind string, t long, status int, ms double")
    make = lambda s: jobs.trailing_sums(s.select("kind", F.timestamp_seconds("t").alias("ts"), "status", "ms"), (60, 3600), "10 seconds")
    rng = np.random.default_rng(1)
    rows = [("ab"[int(k)], at(int(t)), int(s), float(m)) for k, t, s, m in zip(rng.integers(0, 2, 300), np.sort(rng.integers(0, 9000, 300)), rng.choice([200, 429, 500], 300), rng.integers(1, 50, 300), strict=True)]
    got = []
    for part in (rows[:120], rows[120:250], rows[250:]):
        steps.put(part)
        got += steps.run(make)
    ended = max(r[1] for r in rows) - 10
    want = []
    for kind, second in {r[:2] for r in rows if r[1] + 1 <= ended}:
        for span in (60, 3600):
            b = [r for r in rows if r[0] == kind and second - span <= r[1] < second]
            want.append((kind, second, span, len(b), sum(r[2] >= 500 for r in b), sum(r[2] == 429 for r in b), sum(r[3] for r in b)))
    assert sorted(got) == sorted(want)


def test_samples_over_batches(spark, tmp_path, few):
    steps = Steps(spark, tmp_path, "s string, t double, n long")
    make = lambda s: jobs.samples(s.select("s", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("ts"), "n"), "s", most=3, late="5 seconds")
    rows = [("a", at(0) + 1.5 * i, i) for i in range(60)] + [("b", at(0) + 7.0 * i, 100 + i) for i in range(8)]
    rows.sort(key=lambda r: r[1])
    got = []
    for part in (rows[:20], rows[20:45], rows[45:]):
        steps.put(part)
        got += steps.run(make)
    last = {}
    for s, t, n in rows:
        last[s, int(t // 10)] = max(last.get((s, int(t // 10)), (0, 0)), (round(t * 1_000_000), n))
    ended = max(r[1] for r in rows) - 5
    assert sorted(got) == sorted((s, us, n) for (s, slot), (us, n) in last.items() if (slot + 1) * 10 <= ended)
    slots = spark.read.format("statestore").option("path", f"{steps.path}/c").option("stateVarName", "slots").load().groupBy("key.s").count().collect()
    assert all(r["count"] <= 3 + 2 for r in slots)  # the ring, and slots that haven't ended


def test_samples_are_passed_on_by_series_not_by_slot(spark):
    """A call of Python for each reading, and one for each slot's timer, made a large stream fail by time."""
    made = []

    class Slots:
        held = []
        get = lambda self: iter(self.held)
        put = lambda self, rows: made.append(rows)

    sampler = jobs.Sampler(3)
    sampler.slots = Slots()
    parts = [pd.DataFrame({"us": np.arange(k, 1000, 2), "n": np.arange(k, 1000, 2) + 7}) for k in (0, 1)]
    out = pd.concat(list(sampler.handleInputRows(("a",), iter(parts), None)))
    assert sorted(out["us"]) == list(range(1000)) and (out["n"] == out["us"] + 7).all()
    assert made == [[(997, 1004), (998, 1005), (999, 1006)]]


def test_trailing_sums_hold_a_day_of_a_kind(spark, tmp_path, few):
    """Seconds of several days meet in groups by day, and sums look back across midnight; a day's ring goes when the day is over."""
    steps = Steps(spark, tmp_path, "kind string, t long, status int, ms double")
    make = lambda s: jobs.trailing_sums(s.select("kind", F.timestamp_seconds("t").alias("ts"), "status", "ms"), (60, 3600), "10 seconds")
    midnight = (at(0) // 86400 + 1) * 86400
    rows = [("a", midnight + s, 200, 0.5) for s in (-3601, -3600, -40, -1, 0, 20, 3599, 86399, 86400, 4 * 86400)]
    got = []
    for part in (rows[:5], rows[5:8], rows[8:], [("a", midnight + 9 * 86400, 200, 0.5)], [("a", midnight + 9 * 86400 + 60, 200, 0.5)]):
        steps.put(part)
        got += steps.run(make)
    got = [r for r in got if r[1] <= rows[-1][1]]
    assert sorted(got) == sorted((k, t, span, n := sum(t - span <= u < t for _, u, _, _ in rows), 0, 0, n * 0.5) for k, t, _, _ in rows for span in (60, 3600))
    left = spark.read.format("statestore").option("path", f"{steps.path}/c").option("stateVarName", "ring").load()
    assert "day" in left.select("key.*").columns and left.where(F.col("key.day") < midnight // 86400 + 5).count() == 0


# page folders


def test_folder_pages_are_admitted_some_a_batch(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    put = lambda n, body: (folder / f"page-{n:06d}.json").write_text(body)
    for n in range(5):
        put(n, json.dumps({"results": [{"id": f"https://w.example/W{10 * n + i}", "title": f"t {i}\n"} for i in range(n)], "meta": {"count": 9}}))
    put(5, json.dumps([{"id": "W90", "title": "bare"}]))
    put(6, "no json")
    batches = []

    def run():
        q = crawl.folder_stream(spark, f"file://{folder}", 2).writeStream.foreachBatch(lambda b, n: batches.append(sorted((r["file"], r["id"]) for r in b.collect()))).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    ids = [i for b in batches for _, i in b]
    assert len(batches) == 4 and len(ids) == len(set(ids)) == 11 and all(len({f for f, _ in b}) <= 2 for b in batches)
    put(7, json.dumps([{"id": "W91"}]))
    run()  # a restart reads the new page alone
    assert batches[4:] == [[("page-000007.json", "W91")]]
    table = crawl.works(crawl.folder_batch(spark, f"file://{folder}"))
    assert table.count() == 12 and table.where("title = 'bare'").count() == 1


# matrices


@pytest.mark.parametrize("rows", [1, 7, 100, 10_000])
def test_matrices_are_read_by_ranges(spark, tmp_path, rows):
    x = np.random.default_rng(2).normal(size=(250, 6)).astype("<f4")
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.f32").write_bytes(x[:101].tobytes() + b"\x00" * 23)  # an incomplete last row
    (tmp_path / "m" / "b.f32").write_bytes(x[101:].tobytes())
    (tmp_path / "m" / "_tmp").write_bytes(b"\x00" * 240)
    got = files.in_file_order(files.matrix(spark, f"file://{tmp_path}/m", 6, rows=max(rows, 20)))
    back = got.orderBy("position").collect()
    assert [r["position"] for r in back] == list(range(250)) and np.array_equal(np.array([r["embedding"] for r in back], "<f4"), x)
    one = files.matrix(spark, f"{tmp_path}/m/a.f32", 6, rows=max(rows, 20))
    assert one.count() == 101 and one.rdd.getNumPartitions() == -(-101 // max(rows, 20))


def test_matrices_of_nothing(spark, tmp_path):
    (tmp_path / "e.f32").write_bytes(b"")
    assert files.matrix(spark, f"file://{tmp_path}/e.f32", 4).count() == 0
    with pytest.raises(Exception, match="No such|NotFound|not.*found|none.f32"):
        files.matrix(spark, f"file://{tmp_path}/none.f32", 4).count()


def test_a_written_matrix_keeps_the_order(spark, tmp_path):
    df = spark.range(100).select("id", F.array(*[(F.col("id") + k).cast("float") for k in range(3)]).alias("embedding")).repartitionByRange(3, "id").sortWithinPartitions("id")
    parts = sinks.write_matrix(df, f"file://{tmp_path}/m")
    assert parts.agg(F.sum("rows")).first()[0] == 100
    back = files.in_file_order(files.matrix(spark, f"file://{tmp_path}/m", 3)).orderBy("position").collect()
    assert [r["embedding"] for r in back] == [[float(i + k) for k in range(3)] for i in range(100)]


# builds


def test_rows_of_two_builds_are_brought_to_the_current_one(spark, tmp_path):
    p = synth.generate(spark, 30, 8, 2)
    path = f"file://{tmp_path}/i"
    builds = []
    reader = None
    for part in (p.where("id < 20"), p.where("id >= 5"), p.where("id >= 10")):
        builds.append(sinks.write_index(search.build_index(part), path))
        reader = reader or files.Reader(spark, path)
        reader.reload()
    asked = spark.createDataFrame([(1, builds[2], 0), (2, builds[1], 0), (2, builds[1], 7), (3, builds[0], 0), (4, None, 1)], "query_id long, build string, row long")
    kept, stale = files.current_rows(reader, asked)
    ids = [[r["id"] for r in files.index_scan(spark, path, b).orderBy("row").collect()] for b in builds[1:]]
    want = [(1, ids[1][0], 0, "kept")] + [(2, ids[0][n], ids[1].index(ids[0][n]), "mapped") for n in (0, 7) if ids[0][n] in ids[1]]
    assert sorted(tuple(r) for r in kept.collect()) == sorted(want) and sorted(r[0] for r in stale.collect()) == [3, 4]


# the loop


class Pages:
    """An API of a few works in memory that notes what it is asked."""

    def __init__(self, works):
        self.works, self.asked = works, []

    def page(self, cursor="*", since=None, sort=None, ids=None, where=""):
        self.asked.append({"cursor": cursor, "since": since, "ids": ids, "where": where})
        if ids is not None:
            return crawl.Page([w for w in self.works if w["id"].rsplit("/", 1)[-1] in ids], None)
        n = 0 if cursor == "*" else int(cursor)
        return crawl.Page(self.works[n : n + 2], str(n + 2) if n + 2 < len(self.works) else None, len(self.works))


def made(n):
    return {"id": f"https://w.example/W{n}", "title": f"Title number {n} of all", "abstract_inverted_index": {"words": list(range(59)), f"own{n}": [59]}, "publication_year": 2024, "language": "en", "primary_topic": {"id": "https://t.example/T1", "field": {"id": "https://f.example/17", "display_name": "CS"}}}


def test_loop_asks_with_its_filter_cuts_texts_and_relabels_in_parts(spark, tmp_path, monkeypatch):
    topics = spark.createDataFrame([("T1", "Programming")], "topic_id string, category string")
    subfields = spark.createDataFrame([], "subfield_id string, category string")
    api, clock, lengths = Pages([made(n) for n in range(6)]), [1_700_000_000.0], tmp_path / "lengths"

    def model():
        def embed(texts):
            with open(lengths, "a") as f:
                f.writelines(f"{len(t)}\n" for t in texts)
            return np.ones((len(texts), 4), np.float32)

        return embed

    cut = lambda: lambda texts: [t[:30] for t in texts]
    make = lambda: Ingest(spark, f"file://{tmp_path}/home", api, model, topics, subfields, Limits(crawl="has_abstract:true", relabel=2), lambda: clock[0], cut)
    job = make()
    assert job.backfill() == 6 and job.state["done"] and job.queue() == 6
    assert {a["where"] for a in api.asked} == {"has_abstract:true"}
    assert job.embed() == 6 and job.queue() == 0 and set(lengths.read_text().split()) == {"30"}
    clock[0] += 7 * 3600
    job.fresh()
    assert api.asked[-1]["where"] == "has_abstract:true" and api.asked[-1]["since"]
    # a relabelling in parts that is stopped after the first goes on with the second
    labels = spark.createDataFrame([(n, f"New {n}", n == 4) for n in range(6)], "id long, category string, excluded boolean")
    save, done = Ingest.save, []

    def stop(self, **changes):
        save(self, **changes)
        if changes.get("relabel") and changes["relabel"]["done"] == 1 and not done:
            done.append(1)
            raise KeyboardInterrupt

    monkeypatch.setattr(Ingest, "save", stop)
    with pytest.raises(KeyboardInterrupt):
        job.relabel(labels, "v2")
    job = make()
    assert job.state["relabel"]["done"] == 1 and job.state["relabel"]["parts"] == 3 and job.papers().where("field = 'Programming'").count() == 6
    api.works.append(made(50))
    job.add([made(50)])  # comes while papers are rewritten
    rewritten, own = [], ingest.relabel
    monkeypatch.setattr(ingest, "relabel", lambda *a, **b: rewritten.append(1) or own(*a, **b))
    assert job.relabel(labels, "v2") and len(rewritten) == 3 and not job.relabel(labels, "v2")
    assert sorted((r["id"], r["field"], r["excluded"]) for r in job.papers().collect()) == sorted([(n, f"New {n}", n == 4) for n in range(6)] + [(50, "Programming", False)])
    assert job.add([made(50), made(51)]) == 1 and job.papers().count() == 8 and job.queue() == 2
    # an index of an older format is built anew by the next round
    assert job.embed() == 2 and job.build(force=True) and not job.upgrade()
    pointer = f"file://{tmp_path}/home/index/current"
    old = shared.read_pointer(spark, pointer)
    shared.write_pointer(spark, pointer, old | {"version": old["version"] - 1})
    assert job.round()["build"] == 1
    new = shared.read_pointer(spark, pointer)
    assert new["version"] == old["version"] and new["build"] != old["build"] and not job.upgrade()
