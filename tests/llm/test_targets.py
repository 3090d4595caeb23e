"""Decontamination, importance resampling and whitening against brute force, with edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.llm import decontaminate, queries, resampling, whitening
from driftline.llm.decontaminate import Automaton, Battery

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate(UPPER))


# 11: decontamination


def brute_hits(docs, items, window=10):
    """(n_words, hit words, items) of each text."""
    windows = [(name, w[p : p + (m := min(window, len(w)))]) for name, text in items if (w := words_of(text)) for p in range(max(1, len(w) - window + 1))]
    out = []
    for text in docs:
        w, hit, found = words_of(text), set(), set()
        for name, g in windows:
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit.update(range(p, p + len(g)))
                    if name is not None:
                        found.add(str(name))
        out.append((len(w), sorted(hit), sorted(found)))
    return out


def spans_of(hit):
    return [(a, b) for a, b in zip([x for x in hit if x - 1 not in hit], [x + 1 for x in hit if x + 1 not in hit], strict=True)]


ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"),
    (2, "three four five six seven eight nine ten eleven twelve thirteen"),
    (3, "Red, green; BLUE"),
    (4, "ééé 日本語"),
    (4, "another text of item four that has more than ten words in it"),
    (5, None),
    (6, "..."),
    (None, "a nameless item of only a few words"),
    (7, "x x x x x x x x x x x"),
    (8, "one two three four five six seven eight nine ten eleven twelve"),
    (10, "red green blue"),
]
DOCS = [
    (1, None),
    (2, ""),
    (3, "zero ONE two-three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (3, "zero ONE two-three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (4, "one two three four five six seven eight nine"),
    (5, "x " * 9),
    (6, "y " + "x " * 40 + "red green blue red green blu"),
    (None, "ééé, 日本語! éé 日本語 a NAMELESS item of only a few words"),
    (7, "word " * 3000 + "red green blue " + "one two three four five six seven eight nine ten " * 300),
    (8, "it has more than ten words in it another text of item four that has more than ten words in it"),
    (9, " ?!\n"),
]


@pytest.fixture(scope="module")
def tests_and_docs(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit("x")).withColumn("items", F.lit(1))
    docs = spark.createDataFrame([(*r, "s", 1, "t") for r in DOCS], "doc_id long, text string, source string, items int, n_hit string").repartition(3)
    return items, docs


@pytest.mark.parametrize("sent", [{}, {"send_words": 25, "part_words": 12}, {"part_words": 1}])
@pytest.mark.parametrize("piece", [512, 4])
def test_hits_against_brute_force(monkeypatch, tests_and_docs, sent, piece):
    items, docs = tests_and_docs
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    got = decontaminate.decontaminate(docs, items, keep=("source",), **sent).collect()
    want = []
    for (doc, text), (n, hit, names) in zip(DOCS, brute_hits([t for _, t in DOCS], ITEMS), strict=True):
        raw, at = text or "", [m.span() for m in WORD.finditer((text or "").translate(UPPER))]
        spans = spans_of(hit)
        kept, last = "", 0
        for a, b in spans:
            kept += raw[last : at[a][0]]
            last = at[b - 1][1]
        kept = None if text is None else kept + raw[last:]
        want.append((doc, n, len(hit), [a for a, _ in spans], [b for _, b in spans], names, len(hit) > 0.5 * n, kept, "s"))
    rows = [(r["doc_id"], r["n_words"], r["n_hit"], r["starts"], r["ends"], r["items"], r["dropped"], r["text"], r["source"]) for r in got]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    longest = {r["doc_id"]: r["longest"] for r in got}
    assert (longest[3], longest[4], longest[5], longest[6], longest[2]) == (12, 9, 9, 11, 0)


def test_hits_without_items_or_documents(tests_and_docs):
    items, docs = tests_and_docs
    none = decontaminate.decontaminate(docs, items.limit(0))
    assert {(r["n_hit"], r["longest"], len(r["items"])) for r in none.collect()} == {(0, 0, 0)} and none.count() == len(DOCS)
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


def test_long_items_are_cut_without_losing_a_window(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_PIECE", 30)
    rng = np.random.default_rng(5)
    item = [f"w{i}" for i in rng.integers(0, 40, 700)]
    texts = [" ".join(item[a : a + n]) for a, n in ((0, 700), (3, 10), (17, 9), (25, 60), (690, 10))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"), with_text=False)
    want = [(i, n, len(hit)) for i, (n, hit, _) in enumerate(brute_hits(texts, [(1, " ".join(item))]))]
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"]) for r in got.collect()) == want


@pytest.mark.parametrize("seed", range(4))
def test_automaton_gives_longest_matches(seed):
    """Random sequences over few letters, which share and repeat many runs."""
    rng = np.random.default_rng(seed)
    sequences = [rng.integers(0, 3, n) for n in (1, 12, 30, 30, 7)] + [np.zeros(9, np.int64)]
    text = rng.integers(0, 4, 200)
    known = {tuple(s[a:b].tolist()) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    a = Automaton.of(sequences, 4)
    states, lengths = a.walk(text, np.array([0, 50]), np.array([50, 200]))
    for p in range(200):
        low = 0 if p < 50 else 50
        want = max([n for n in range(1, p - low + 2) if tuple(text[p - n + 1 : p + 1].tolist()) in known], default=0)
        assert lengths[p] == want
        for m in range(1, want + 1):  # one state for each set of runs with the same places
            s = a.shortened(states[p : p + 1], m)[0]
            assert a.length[a.link[s]] < m <= a.length[s]


def test_a_template_that_all_items_share(spark):
    """Every item begins alike: documents with that text name them all, those with the rest one."""
    head = "answer the following question with one of the letters a b c d"
    items = [(i, f"{head} number{i} is the only word that tells this one item from any other") for i in range(200)]
    docs = [(1, head), (2, items[7][1]), (3, "is the only word that tells this one item from any"), (4, "number5 " * 30)]
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), with_text=False, part_words=500).collect()}
    assert [len(got[i]["items"]) for i in (1, 2, 3, 4)] == [200, 200, 200, 0]
    assert got[1]["items"] == sorted(map(str, range(200))) and got[2]["n_hit"] == got[2]["n_words"]


def test_stretches_stay_within_a_row():
    battery = Battery.of([np.arange(10, dtype=np.uint64)], ["a"], 10)
    hashes = np.tile(np.arange(10, dtype=np.uint64), 2)
    hit, _, pairs = battery.match(hashes, np.repeat([0, 1, 2], [5, 10, 5]))
    assert not hit.any() and not pairs.size
    hit, _, pairs = battery.match(hashes, np.repeat([0, 1], 10))
    assert hit.all() and pairs.T.tolist() == [[0, 0], [1, 0]]


# 12: importance resampling


def grams_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, buckets=10_000, min_words=20, percent=5):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for text in texts for g in grams_of(text)) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        g = grams_of(text)
        weight, score = sum(gain[bucket(x)] for x in g), None
        if doc is not None:
            h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(words_of(text)), len(g), weight, score, None])
    can = sorted((r for r in rows if r[1] >= min_words and r[0] is not None), key=lambda r: (-r[4], r[0], -r[3], r[2]))
    for i, r in enumerate(can[: percent * len(can) // 100]):
        r[5] = i + 1
    return sorted(map(repr, rows))


def test_resampling_against_brute_force(spark):
    rng = np.random.default_rng(3)
    text = lambda n, low, high: " ".join(f"{'Wé'[i % 2]}{i}" for i in rng.integers(low, high, n))
    docs = [(i, text(int(rng.integers(0, 60)), 0, 50 if i % 3 else 400)) for i in range(200)]
    docs += [(200, None), (201, ""), (202, " ... \x00\x7f"), (None, text(40, 0, 30)), (203, text(30_000, 0, 300)), (204, "aa, BB;cc")]
    docs += [(5, text(40, 0, 30)), (6, docs[6][1]), (7, "one " * 25), (7, "one " * 26)]
    target = [text(60, 0, 30) for _ in range(5)] + [None, ""]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, rank int, bucket string").repartition(5)
    items = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resampling.resample(df, items, percent=30)
    assert sorted(repr([r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")]) for r in got.collect()) == brute_resample(docs, target, percent=30)
    drawn = resampling.drawn_documents(df, got)
    assert {r["doc_id"] for r in drawn.collect()} == {r["doc_id"] for r in got.where("rank is not null").collect()} and set(df.columns) < set(drawn.columns)


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d " * 30)], "doc_id long, text string")
    none = docs.limit(0)
    assert resampling.resample(none, docs).count() == 0
    got = resampling.resample(docs, none, percent=100).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["rank"]) for r in got] == [(1, None), (2, 1)]
    with pytest.raises(ValueError, match="buckets"):
        resampling.gains(docs, docs, buckets=0)


def test_resampling_stays_in_the_engine(spark, sf):
    df = queries.op12_importance_resampling(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for plan in (df, resampling.weigh(docs, resampling.gains(docs, docs))):
        assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())


def test_ranks_go_on_from_partition_to_partition(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).repartition(9)
    got = resampling.ranked(df, [F.desc("v")], "place").collect()
    assert [r["v"] for r in sorted(got, key=lambda r: r["place"])] == sorted((r["v"] for r in got), reverse=True) and sorted(r["place"] for r in got) == list(range(1, 1001))


# 13: whitening


def brute_whitening(vectors, components=8):
    """(n, deviations, whitened up to sign, shares), the covariance from exact fractions."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(v[k] for v in x) for k in range(d)]
    deviation = [sum((n * v[k] - s[k]) ** 2 for k in range(d)) for v in x]
    exact = [[n * sum(v[i] * v[j] for v in x) - s[i] * s[j] for j in range(d)] for i in range(d)]
    values, vectors = np.linalg.eigh(np.array([[e / n**2 for e in row] for row in exact]))
    centred = np.array([[(n * v[k] - s[k]) / n for k in range(d)] for v in x])
    white = centred @ vectors[:, ::-1][:, :components] / np.sqrt(values[::-1][:components])
    return n, deviation, white, values[::-1][:components] * n**2 / sum(exact[i][i] for i in range(d))


def agrees(got, vectors, components=8):
    n, deviation, white, shares = brute_whitening(vectors, components)
    ours = np.array([r["whitened"] for r in got])
    sign = np.sign((ours * white).sum(0))
    assert {r["n"] for r in got} == {n} and [int(r["deviation"]) for r in got] == deviation
    assert np.allclose(ours * sign, white, atol=1e-6) and np.allclose(got[0]["explained"], shares, rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6


def test_whitening_of_all_embeddings(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = whitening.whiten(e).orderBy("vec_id").collect()
    agrees(got, [r["embedding"] for r in e.orderBy("vec_id").collect()])
    assert queries.op13_embedding_whitening(spark, sf).count() == 8 * len(got)


@pytest.mark.parametrize("far", [0.0, 1e6, 3e12, 2.0**52])
def test_whitening_is_exact_far_from_zero(spark, far):
    """Large means and spreads go through longer integers; the scatter stays exact."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) * [1, 4, 2, 9, 3] * (1 if far < 1e12 else far / 64) + far
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(7)
    n, sums, cross = whitening.scatter(df, 5)
    y = [[math.floor(1024 * c) + 100_000 for c in v] for v in x.tolist()]
    y = [[min(max(c, -(2**63)), 2**63 - 1) for c in v] for v in y]
    assert n == 300 and sums == [sum(v[k] for v in y) for k in range(5)]
    assert cross == [[sum(v[i] * v[j] for v in y) for j in range(5)] for i in range(5)]
    if far < 1e12:
        agrees(whitening.whiten(df).orderBy("vec_id").collect(), x.tolist(), 5)


def test_blocks_are_multiplied_exactly():
    rng = np.random.default_rng(2)
    for top in (9, 1 << 20, 1 << 27, 1 << 29, 1 << 40):
        y = rng.integers(-top, top, (50, 4))
        assert whitening.cross_products(y).tolist() == (y.astype(object).T @ y.astype(object)).tolist()
    v = np.array([0, 1, -1, 2**32, -(2**32), 2**190, -(2**190) + 5], object)
    back = sum(limb.astype(object) << whitening.LIMB_BITS * k for k, limb in enumerate(whitening.limbs(v)))
    assert back.tolist() == v.tolist()


def test_whitening_of_odd_vectors(spark):
    kind = "vec_id long, embedding array<double>, n int, whitened string"
    good = [(i, [float(i % 5), float(i % 7), float(i % 3)]) for i in range(40)] + [(None, [1.0, 2.0, 0.5]), (3, [9.0, 1.0, 1.0])]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in good + bad], kind).repartition(3)
    got = whitening.whiten(df)
    rows = got.collect()
    assert len(rows) == len(good) and {r["n"] for r in rows} == {len(good)}
    assert sorted((int(r["deviation"]) for r in rows)) == sorted(brute_whitening([v for _, v in good], 3)[1])
    same = whitening.whiten(spark.createDataFrame([(i, [1.5, 2.0], 1, "x") for i in range(4)], kind)).collect()
    assert [(int(r["deviation"]), r["whitened"], r["identity_error"]) for r in same] == [(0, [None, None], None)] * 4
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 1, "x") for i in range(9)], kind)).collect()
    assert all(r["whitened"][1:] == [None, None] and r["whitened"][0] is not None for r in line) and line[0]["identity_error"] < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(0, [1e300], 1, "x"), (1, [-1e300], 1, "x"), (2, [0.0], 1, "x")], kind)).collect()
    assert len(huge) == 3 and huge[0]["identity_error"] < 1e-6
    none = whitening.whiten(df.where("vec_id between 100 and 104"))
    assert none.count() == 0 and none.columns == got.columns


def test_limbs_leave_the_tasks_as_longs():
    assert all(a.dtype == np.int64 for a in whitening.limbs(np.array([5, -7], object)))
    assert pa.array(whitening.limbs(np.array([-(2**200)], object))[-1]).to_pylist() == [-(2 ** (200 - 192))]
