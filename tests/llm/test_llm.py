"""The llm operators against brute force, exact round trips and held-out accuracy, with edge cases."""

import hashlib
import re
import zlib
from collections import Counter
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import ann, bytebpe, components, jaccard, langid, licenses, linededup, packing, quality, queries, suffix, textblocks, tokenfiles
from tests.compare import duck, same_rows

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i} x{i % 7}." for i in range(40_000))
EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, "One single line of text", None, "a"),
    (4, "One single line of text", "en", "a"),
    (4, "One single line of text", "en", "a"),
    (None, "One single line of text\nand\nanother quite long line", "en", "b"),
    (5, LONG, "en", "a"),
    (6, "aaaa " * 300, "de", ""),
    (7, " \t\n\x0b\x0c\r", "de", "b"),
    (8, "ééé <|endoftext|> 日本語 don't 12 3", "fr", "b"),
    (9, LONG[:5000] + " tail", "en", "a"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(*r, len(r[1] or ""), 0, "x") for r in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, h string").repartition(3)


@pytest.fixture(scope="module")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    same_rows(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLE_SQL[name])


def test_intermediate_tables_are_cleaned_up(spark):
    kept = textblocks.stored(spark.range(5), "x", codec="zstd")
    assert kept.count() == 5 and textblocks.cleanup(spark) and not textblocks.cleanup(spark)


# 1: nearest neighbours


def test_neighbours_reach_recall(spark, sf):
    got = queries.op1_nearest_neighbours(spark, sf).toPandas()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        s[i] = -np.inf
        order = np.lexsort((ids, -s))[:20]
        g = got[got["query_id"] == ids[i]].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21))
        assert g["score"].tolist() == [s[ids == v][0] for v in g["vec_id"]]
        hit, total = hit + len(set(ids[order]) & set(g["vec_id"])), total + 20
    assert hit / total >= 0.9


def test_neighbours_of_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, None), (101, [0.0, 0.0]), (102, [float("nan"), 1.0]), (103, [1.0, None]), (104, [float("inf"), 1.0]), (None, [1.0, 1.0]), (105, [1.0]), (0, [1.0, 0.0]), (106, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("rank", F.lit(1))
    got = ann.search(df, df.where("vec_id in (0, 100, 101, 106)"), 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, i, 1.0) for i in (1, 2, 3, 4, 5)] + [(106, i, 0.5) for i in range(5)]
    few = df.where("vec_id in (1, 106)")
    assert [r["vec_id"] for r in ann.search(few, few.where("vec_id = 1"), 5).collect()] == [106]
    assert ann.search(df.limit(0), df.limit(0), 5).count() == 0


def brute_neighbours(x, ids, queries, k):
    out = []
    for i in queries:
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("block", [512, 4096])
def test_neighbours_with_many_ties(spark, monkeypatch, block):
    """All binary vectors of 11 dimensions but zero, every leaf visited: ties go to the smaller id."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 8)
    x = np.array([[n >> k & 1 for k in range(11)] for n in np.random.default_rng(2).permutation(2047) + 1], float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 100 = 0"), 20, sample=600, target=2.0).collect()
    assert sorted(tuple(r) for r in got) == brute_neighbours(x, np.arange(len(x)), range(0, len(x), 100), 20)


def test_neighbours_in_leaves_that_grow(spark, monkeypatch):
    monkeypatch.setattr(ann, "SPLIT_ROWS", 200)
    monkeypatch.setattr(ann, "SPLIT_SAMPLE", 300)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8))
    x = np.round(centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 8)), 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    points = ann.usable(df, "vec_id", "embedding")
    upper, _ = ann.fit(points, 500)
    tree, placed = ann.indexed(points, 10, 500)
    assert tree.leaves > upper.leaves and placed.select(F.explode("ids")).count() == 4000 and tree.visits < tree.leaves and 0.95 <= tree.recall <= 1
    assert sorted(n for n in tree.leaf if n >= 0) == list(range(tree.leaves))
    want = brute_neighbours(x, np.arange(4000), range(0, 4000, 20), 10)
    got = {tuple(r) for r in ann.search(df, df.where("vec_id % 20 = 0"), 10, sample=500).select("query_id", "vec_id").collect()}
    assert len(got & {(q, v) for q, _, v, _ in want}) / len(want) >= 0.9
    every = ann.search(df, df.where("vec_id % 20 = 0"), 10, sample=500, target=2.0).collect()
    assert sorted(tuple(r) for r in every) == want


# 2: lines


def brute_lines(rows):
    keys = [[ln.strip(" \t\n\x0b\x0c\r").translate(UPPER) for ln in (t or "").split("\n")] for _, t in rows]
    first = {}
    for (d, _), ks in zip(rows, keys, strict=True):
        for k in ks:
            if d is not None and len(k) >= 10:
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, t), ks in zip(rows, keys, strict=True):
        gone = [d is not None and k in first and first[k] < d for k in ks]
        out.append((d, len(ks), sum(gone), "\n".join(ln for ln, g in zip((t or "").split("\n"), gone, strict=True) if not g)))
    return sorted(out, key=str)


def test_lines_with_edges(edge, empty):
    rows = [(r[0], r[1]) for r in EDGE] + [(20, "Next LINE OF TEXT x\nshort\nnext line of text x\nfree 1234567"), (21, "  next line of text X \nshort\n\nfree 1234567\nown line of this one"), (22, "next line of text x")]
    df = edge.sparkSession.createDataFrame(rows, "doc_id long, text string")
    got = linededup.drop_repeated_lines(df)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=str) == brute_lines(rows)
    runs = {r["doc_id"]: list(r["keep_runs"]) for r in got.collect() if r["doc_id"] in (20, 21, 22)}
    assert runs == {20: [4], 21: [0, 1, 2, 1, 1], 22: [0, 1, 0]}
    assert linededup.drop_repeated_lines(empty).count() == 0


def test_hot_lines_take_the_other_way(spark, monkeypatch):
    """With every document in the sample, the commonest lines go by the broadcast, three of them at most."""
    monkeypatch.setattr(linededup, "HOT_SAMPLE", 1)
    monkeypatch.setattr(linededup, "HOT_SLOTS", 3)
    rows = [(i, "\n".join(f"line of group number {i % k}" for k in (2, 3, 5, 40)) + f"\nown line {i:09d}\nline of group number 0") for i in range(200)] + [(7, "line of group number 1"), (None, "line of group number 1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = linededup.drop_repeated_lines(df)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=str) == brute_lines(rows)


# 3: near copies


def brute_components(rows, size=5):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    top = {d: d for d, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                top[max(x, y)] = min(x, y) if x != y else top[max(x, y)]
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def test_near_copies_against_brute_force(docs, texts):
    got = sorted((tuple(r) for r in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == brute_components(list(texts.items()))


def sets_of_all_sizes():
    rng = np.random.default_rng(5)
    rows, n = [(r[0], r[1]) for r in EDGE if r[1] != LONG], 100
    for size in (3, 5, 6, 7, 8, 9, 10, 11, 13, 17, 18, 30, 60, 120):
        base = [f"a{size}b{i}" for i in range(size)]
        for _ in range(12):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(0, len(w)))] = f"z{int(rng.integers(0, 9))}"
            rows.append((n, " ".join(w[: size - int(rng.integers(0, 2))])))
            n += 1
    base = [f"g{i}" for i in range(150)]
    for _ in range(60):
        w = list(base)
        for _ in range(int(rng.integers(1, 9))):
            w[int(rng.integers(0, 150))] = f"y{int(rng.integers(0, 5000))}"
        rows.append((n, " ".join(w)))
        n += 1
    return rows


@pytest.mark.parametrize("how", ["as the model says", "allocations", "blocks", "fetched by shuffle"])
def test_near_copies_of_all_sizes_and_a_large_group(spark, monkeypatch, how):
    rows = sets_of_all_sizes()
    if how == "allocations":  # in every band, nothing, contents and neighbourhoods in turn
        worth = lambda band: jaccard.allocate(*np.random.default_rng(band).random((2, jaccard.allotted(band))), jaccard.most_apart(band) + 1)[0]
        monkeypatch.setattr(jaccard, "with_allocations", lambda docs, heat, *_: jaccard.Heat(heat.keys, heat.counts, {b: worth(b) for b in range(8)}))
        assert {int(v) for b in range(3, 8) for v in worth(b)} == {0, 1, 2}
    if how == "blocks":
        monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
        monkeypatch.setattr(jaccard, "SMALL_GROUP", 2)
        monkeypatch.setattr(jaccard, "PIVOT_ROWS", 7)
    if how == "fetched by shuffle":
        monkeypatch.setattr(jaccard, "SEND_SETS", 0)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.near_duplicates(df).collect()), key=str) == brute_components(rows)


def test_allocations_are_the_cheapest_that_add_up():
    from itertools import product

    rng = np.random.default_rng(6)
    for m, need in ((1, 2), (3, 2), (5, 4), (6, 9), (7, 14)):
        exact, around = rng.random((2, m)) * [[1], [2]]
        worth, cost = jaccard.allocate(exact, around, need)
        price = lambda w: sum((0.0, exact[i], around[i])[x] for i, x in enumerate(w))
        assert worth.sum() >= need and cost == pytest.approx(price(worth)) == pytest.approx(min(price(w) for w in product((0, 1, 2), repeat=m) if sum(w) >= need))


def test_the_model_takes_allocations_where_items_meet_often(spark, monkeypatch):
    """Short sets whose shingles are all common: neighbourhoods of whole sets meet less often than their items."""
    monkeypatch.setattr(jaccard, "COST_SAMPLE", 1)
    rng = np.random.default_rng(9)
    starts = rng.integers(0, 4, 400).tolist()
    rows = [(i, " ".join(f"c{x}" for x in [*range(a, a + 5), *rng.integers(0, 40, 5)])) for i, a in enumerate(starts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    heat = jaccard.heat_of(df)
    assert 0 in jaccard.with_allocations(df, heat).allocations
    free = spark.createDataFrame([(i, " ".join(f"f{i}x{k}" for k in range(40))) for i in range(50)], "doc_id long, text string")
    assert jaccard.with_allocations(free, heat).allocations == {}


def test_near_copies_of_nothing(empty):
    assert jaccard.near_duplicates(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    for one_task in (0, 1000):
        got = {r["id"]: r["component"] for r in components.components(df, one_task).collect()}
        assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components.components(df.limit(0)).count() == 0


# 4: licences


def test_licence_digests(spark, edge, empty):
    mit = licenses.KNOWN[0][1]
    rows = [(1, mit), (2, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("SUBLICENSE", "sub-license").replace(",", " ;")), (3, mit + " more"), (4, None), (5, ""), (6, "Prose.\nReleased under the MIT licence.\nLicensed under CC BY-NC 4.0."), (7, "...")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r["license_id"] for k, r in got.items()} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: None}
    assert got[1]["digest"] == got[2]["digest"] and got[4]["digest"] is None and got[6]["line_licenses"] == "CC-BY-NC-4.0,MIT"
    assert licenses.scan(edge).count() == len(EDGE) and licenses.scan(empty).count() == 0


def test_licence_lines_of_any_length_and_wording(spark):
    one = licenses.KNOWN[0][1].replace("\n", " ")
    rows = [(1, "x\n" + one), (2, "x\n" + one.replace(" ", " " * 8) + "\n" + one.replace(" ", " ~ ") + "\r\n"), (3, "Do what you want.\n  do WHAT you want  \n" + one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = lambda **more: {r["doc_id"]: (r["n_license_lines"], r["line_licenses"]) for r in licenses.scan(df, **more).collect()}
    assert lines() == {1: (1, "MIT"), 2: (2, "MIT"), 3: (1, "MIT")}
    assert lines(known=(("W", "Do what you want."),)) == {1: (0, ""), 2: (0, ""), 3: (2, "W")}
    assert lines(known=()) == {1: (0, ""), 2: (0, ""), 3: (0, "")}


def test_licences_as_they_are_written(spark):
    known = dict(reversed([x for x in licenses.KNOWN if "\n" in x[1]]))
    wrap = lambda t: "\n".join(re.sub(r"(.{40,70}) ", r"\1\n", ln) for ln in t.split("\n"))
    rows = [
        ("MIT", "MIT License\n\nCopyright (c) 2024 A Name\n\n" + wrap(known["MIT"])),
        ("MIT", "The MIT License (MIT)\r\n\r\nCopyright © The Authors\r\n" + known["MIT"].replace("\n", "\r\n")),
        ("ISC", "ISC License\n\nCopyright (c) A Name <a@b.c>\n\n" + wrap(known["ISC"])),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, A Name\nAll rights reserved.\n\n" + wrap(known["BSD-3-Clause"]).replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")),
        ("BSD-2-Clause", wrap(known["BSD-2-Clause"]).replace("COPYRIGHT HOLDER", "copyright owner")),
        ("Unlicense", wrap(known["Unlicense"]).replace("recognize", "recognise")),
        (None, "(c) You must retain what is said\n" + known["MIT"]),
        (None, "Copyright law is hard.\n" + known["MIT"]),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(rows))] == [name for name, _ in rows]


def test_long_licences_by_their_digests(spark):
    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    have = [f for f in files if (folder / f).exists()]
    if not have:
        pytest.skip("no licence files on this machine")
    rows = [(i, re.sub(r"\s+", " ", t) if i % 2 and "opyright (" not in t else t) for i, f in enumerate(have) for t in [(folder / f).read_text(errors="replace")]]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(have))] == [files[f] for f in have]


# 5: passages


def brute_passages(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, raw, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def passages(df):
    cols = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r) for r in suffix.remove_repeats(df).select(*cols).collect()), key=str)


def test_passages_against_brute_force(docs, texts):
    assert passages(docs) == brute_passages(list(texts.items()))


def test_passages_with_edges(spark, empty):
    rows = [(r[0], r[1] if r[1] != LONG else LONG[:9000]) for r in EDGE] + [(30, LONG[100:299]), (31, LONG[100:300]), (32, "ab" * 400), (33, "é" * 150 + LONG[2000:2300])]
    assert passages(spark.createDataFrame(rows, "doc_id long, text string")) == brute_passages(rows)
    assert suffix.remove_repeats(empty).count() == 0


def test_passages_of_one_gram_over_several_shards(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix, "SHARD_BYTES", 3000)
    rng = np.random.default_rng(3)
    base = bytes(rng.choice(list(b"abcdefgh "), 4000).astype(np.uint8))
    rows = []
    for k in range(200):
        a, n = int(rng.integers(0, 3000)), int(rng.choice([200, 230, 300]))
        x = bytearray(base[a : a + n])
        if k % 2:
            x[int(rng.integers(0, n))] = 120
        rows.append((7, k, 7, a, n - 199, 1, bytes(x)))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["gram", "id", "version", "start", "windows", "weight", "payload"])
    got: set = set()
    for out in suffix._shards(200)(iter([batch.slice(0, 70), batch.slice(70)])):
        for i, _, a, b in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got |= {(i, s) for s in range(a, b - 199)}
    seen = Counter(r[6][i : i + 200] for r in rows for i in range(len(r[6]) - 199))
    assert got == {(r[1], r[3] + i) for r in rows for i in range(len(r[6]) - 199) if seen[r[6][i : i + 200]] > 1}


def collapse_rows(rows):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["gram", "part", "digest", "more", "id", "version", "start", "windows", "weight"])


def test_torn_grams_lose_no_block(monkeypatch):
    """A batch with the rest of one torn gram and too many rows of the next."""
    monkeypatch.setattr(suffix, "HELD_ROWS", 3)
    rows = [(1, 0, i, 0, i, 0, 0, 5, 1) for i in range(5)] + [(1, 0, 50, 0, 50, 0, 0, 5, 1)] + [(2, 0, i, 0, 100 + i, 0, 0, 5, 1) for i in range(5)] + [(2, 0, 9, 9, 109, 0, 0, 5, 1), (3, 0, 1, 1, 200, 0, 0, 5, 1)]
    for cut in range(1, len(rows)):
        got = [r for b in suffix._collapse(iter([collapse_rows(rows[:cut]), collapse_rows(rows[cut:])])) for r in b.to_pylist()]
        assert {r["id"] for r in got if not r["settled"]} >= {*range(5), 50, *range(100, 105), 109}
        assert all(len({r["hot"] for r in got if r["gram"] == g}) == 1 for g in (1, 2))


def test_blocks_with_half_a_digest_in_common_are_different():
    rows = [(1, 0, 7, 1, 1, 0, 0, 5, 1), (1, 0, 7, 2, 2, 0, 0, 5, 1)]
    assert [r["settled"] for b in suffix._collapse(iter([collapse_rows(rows)])) for r in b.to_pylist()] == [False, False]


@pytest.mark.parametrize("hot, shard, parts", [(1, 1 << 19, False), (1, 700, False), (1 << 20, 700, False), (1 << 20, 700, True), (1, 1 << 19, True)])
def test_passages_of_hot_grams(monkeypatch, hot, shard, parts):
    """Hot grams collapsed in parts and dealt by their second gram, and keys over several shards, as one task does it."""
    monkeypatch.setattr(suffix, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    import pyarrow as pa

    rng = np.random.default_rng(8)
    base, texts = "".join(rng.choice(list("abcd \x00"), 600)), []
    for k in range(40):
        a, n = int(rng.integers(0, 350)), int(rng.integers(180, 250))
        texts.append("".join(rng.choice(list("abcd "), int(rng.integers(0, 60)))) + base[a : a + n] + "".join(rng.choice(list("xyz"), int(rng.integers(0, 60)))))
    texts += ["a" * 300, "a" * 250 + "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary()), pa.array([0] * len(texts), pa.int64())], ["id", "text", "version"])
    raw = [t.encode() for t in texts]
    batches = [batch.slice(0, 20), batch.slice(20)]  # copies are in one batch, and over both
    rows_of = lambda known: [r for b in suffix._block_rows(200, known)(iter(batches)) for r in b.to_pylist()]
    often = sorted(g for g, n in Counter(r["gram"] for r in rows_of(None)).items() if n > 2)
    frequent = {g: k % 2 == 0 for k, g in enumerate(often)}
    assert set(frequent.values()) == {True, False}
    found = rows_of(frequent if parts else None)
    assert any(r["part"] for r in found) == parts
    found.sort(key=lambda r: (r["gram"], r["part"], r["digest"], r["more"], r["windows"]))
    rows = [tuple(r[k] for k in ("gram", "part", "digest", "more", "id", "version", "start", "windows", "weight")) for r in found]
    cut = {p: [r for r in rows if r[1] % 3 == p] for p in range(3)}  # parts are in tasks of their own
    got, sent = set(), []
    for r in (r for own in cut.values() if own for b in suffix._collapse(iter([collapse_rows(own)])) for r in b.to_pylist()):
        blob = raw[r["id"]][r["start"] : r["start"] + r["windows"] + 199]
        if r["settled"]:
            got |= {(r["id"], r["start"] + i) for i in range(r["windows"])}
        elif r["hot"]:
            cuts = suffix.second_cuts(blob, r["windows"], r["gram"])
            assert sum(n for _, n, _ in cuts) == r["windows"]
            sent += [(key, r["id"], 0, r["start"] + at, n, r["weight"], blob[at : at + n + 199]) for at, n, key in cuts]
        else:
            sent.append((r["gram"], r["id"], 0, r["start"], r["windows"], r["weight"], blob))
    sent.sort(key=lambda r: r[0])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in sent], t) for i, t in enumerate(kinds)], ["gram", "id", "version", "start", "windows", "weight", "payload"])
    for out in suffix._shards(200)(iter([batch])):
        for i, _, a, b in zip(*(c.to_pylist() for c in out.columns), strict=True):
            got |= {(i, s) for s in range(a, b - 199)}
    seen = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    assert got == {(k, i) for k, t in enumerate(raw) for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1}


@pytest.mark.parametrize("size", [600, 4096])
def test_blocks_of_texts_longer_than_a_piece(monkeypatch, size):
    raw = [LONG[:9000].encode(), b"", LONG[4000:13000].encode(), b"x" * 199]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    windows = lambda found: {(int(r), int(a) + i) for _, _, r, a, n in zip(*found, strict=True) for i in range(int(n))}
    whole = windows(suffix.blocks(buf, offsets))
    assert whole == {(r, i) for r, t in enumerate(raw) for i in range(len(t) - 199)}
    monkeypatch.setattr(suffix, "PIECE_BYTES", size)
    assert windows(suffix.blocks(buf, offsets)) == whole


# 6: byte BPE


def test_byte_bpe_round_trip(edge, empty):
    enc = bytebpe.encoding(BYTE, P.PATTERN)
    expected = sorted((str(d), len(i := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in EDGE)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bytebpe.round_trip_digests(edge, BYTE, P.PATTERN).collect())
    assert got == expected and bytebpe.round_trip_digests(empty, BYTE, P.PATTERN).count() == 0
    back = bytebpe.decode(bytebpe.encode(edge, BYTE, P.PATTERN), BYTE, P.PATTERN).collect()
    assert all(bytes(r["bytes"]) == (r["text"] or "").encode() for r in back)


def test_byte_bpe_of_all_documents(spark, sf, texts):
    enc = bytebpe.encoding(BYTE, P.PATTERN)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    got = {tuple(r) for r in queries.op6_byte_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    assert got == {(d, len(i := enc.encode_ordinary(t)), digest(np.array(i, "<u4").tobytes()), digest(t.encode())) for d, t in texts.items()}


@pytest.mark.parametrize("text", [LONG[:3000], "a" * 500, "x  y   z \n\n q " * 60, "don't  we'll " * 50 + "é 日本 " * 40])
def test_pieces_encode_as_the_whole(text):
    enc = bytebpe.encoding(BYTE, P.PATTERN)
    assert "".join(bytebpe.pieces(text, 20)) == text
    assert bytebpe.encode_text(enc, text, 20) == enc.encode_ordinary(text)


# 7: quality


def brute_figures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = set()
    for i in range(len(w) - 2):
        if three[tuple(w[i : i + 3])] > 1:
            rep |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for ln in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", ln):
            dup += ln in seen
            seen.add(ln)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep))


def test_quality_figures(spark, docs, texts, empty):
    rows = list(texts.items()) + [(5000 + i, r[1]) for i, r in enumerate(EDGE)] + [(6000, "a b c\na b c\n a b c\n\n\nx"), (6001, "#* é|\n#* é|\r\n#* é|")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("one"))
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    for d, t in rows:
        n, c, s, dup, rep = brute_figures(t)
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, c, s, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n) and (not r["base_failed"] or not r["kept"])
    assert quality.judge(empty).count() == 0


@pytest.mark.parametrize("send", [0, 1000])
def test_frequent_lines_deplete(spark, send):
    """Both routes to the frequent lines, with a hot host, a null host and repeated rows."""
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    menu = " ".join(f"menu{k}" for k in range(300))
    rows = [(i, body(i), "h") for i in range(100)] + [(1000 + i, "  " + menu.upper() + "\n" + body(2000 + i), "h") for i in range(30)] + [(5000, menu + "\n" + body(7), "other")]
    rows += [(6000, menu + "\n\n" + menu + "\n" + body(i), None) for i in range(22)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    all_ = quality.judge(df, send_lines=send).collect()
    got = {r["doc_id"]: r for r in all_}
    assert len(all_) == len(rows) and all(got[i]["kept"] for i in range(100)) and got[5000]["kept"]
    assert all(got[1000 + i]["depleted"] and got[1000 + i]["n_frequent_words"] == 300 for i in range(30))
    assert [r["n_frequent_words"] for r in all_ if r["doc_id"] == 6000] == [600] * 22
    # a small share of a large host is no line of a host, a large number is at any share
    wide = lambda most: quality.judge(df, line_share=0.9, line_most=most, send_lines=send).where("doc_id between 1000 and 2000 and depleted").count()
    assert (wide(29), wide(30)) == (30, 0)


# 8: packing


@lru_cache(maxsize=1)
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def tokens_of(t, end):
    return [*library().encode(t or "", add_special_tokens=False).ids, end]


def check_packing(rows, pieces):
    own, filled = {}, {}
    for d, t in rows:
        own.setdefault(d, []).append(tokens_of(t, 1))
    for r in pieces:
        ids = next(x for x in own[r["doc_id"]] if len(x) == r["doc_tokens"])
        part = ids[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in pieces) == sum(len(x) for xs in own.values() for x in xs)
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(r["length"] for r in pieces) / (2048 * len(filled))


def test_packing_places_every_token_once(docs, texts, edge, empty):
    share = check_packing(list(texts.items()), packing.pack(docs, WORD).collect())
    assert share > 0.97
    check_packing([(r[0], r[1]) for r in EDGE], packing.pack(edge, WORD).collect())
    assert packing.pack(empty, WORD).count() == 0


def test_packing_ranks_in_many_parts(monkeypatch, docs, texts):
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    assert check_packing(list(texts.items()), packing.pack(docs, WORD).collect()) > 0.97
    monkeypatch.setattr(packing, "MOST_PARTS", 10)
    assert check_packing(list(texts.items()), packing.pack(docs, WORD).collect()) > 0.97


def test_solver_stops_where_it_no_longer_gains():
    rng = np.random.default_rng(1)
    count = np.bincount(np.minimum(rng.geometric(1 / 600, 20_000), 2048), minlength=2049)
    combos = packing.combinations(count, 2048)
    error = lambda x: ((np.bincount(combos[combos > 0], np.broadcast_to(x[:, None], combos.shape)[combos > 0], len(count)) - count) ** 2).sum()
    assert error(packing.solve_repeats(combos, count)) <= 1.05 * error(packing.solve_repeats(combos, count, 20_000, 0))


def test_plan_uses_the_histogram_up():
    rng = np.random.default_rng(1)
    count = np.bincount(np.minimum(rng.geometric(1 / 600, 20_000), 2048), minlength=2049)
    used, room = np.zeros_like(count), 0
    for pattern, times in packing.plan(count):
        assert sum(a * m for a, m in pattern) <= 2048
        room += 2048 * times
        for length, many in pattern:
            used[length] += many * times
    assert (used == count).all() and (count * np.arange(2049)).sum() / room > 0.995


# 9: languages


def test_languages_are_told_on_held_out_documents(spark, sf):
    got = queries.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in got["doc_id"]]).all()


def brute_grams(t):
    """n-grams of 1 to 3 of letters, words between single spaces, none with a space inside; as (n, count) by the code points of the n-gram."""
    import unicodedata

    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] == "L" else " " for c in t)
    line = " " + " ".join(letters.split()) + " "
    return Counter(g for n in (1, 2, 3) for i in range(len(line) - n + 1) if " " not in (g := line[i : i + n])[1:-1] and not (g[0] == " " == g[-1]))


def brute_ranking(counts, size=400):
    """Most frequent first; ties by the code that orders n-grams: the code points as digits."""
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:size]


@pytest.mark.parametrize("per_language", [langid.TRAIN_PER_LANGUAGE, 5])
def test_languages_against_brute_force(spark, docs, per_language):
    """Training rows, profiles, out-of-place distances and scores, all without the operator's code."""
    extra = spark.createDataFrame([(9001, "\n9 !?", "en"), (9002, None, "en"), (9003, "日本語の文書", None), (9004, "Ωmega ŒUVRE straße İstanbul", None), (9005, "the", None)], "doc_id long, text string, lang string")
    df = docs.select("doc_id", "text", "lang").unionAll(extra).unionAll(extra)
    rows = df.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52))).distinct().collect()
    by_lang = {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            by_lang.setdefault(r["lang"], []).append((r["h"], r["text"]))
    profile = {}
    for name, own in by_lang.items():
        total = Counter()
        for _, t in sorted(own)[:per_language]:
            total.update(brute_grams(t))
        if total:
            profile[name] = {g: k for k, g in enumerate(brute_ranking(total))}
    got = {r["doc_id"]: r for r in langid.identify(df, langid.learn(df, per_language)).collect()}
    for r in rows:
        own = brute_ranking(brute_grams(r["text"] or ""))
        want = ("und", 0.0)
        if own:
            apart = {name: sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(own)) for name, p in profile.items()}
            name = min(apart, key=lambda x: (apart[x], x))
            want = (name, 1 - apart[name] / (400 * len(own)))
        assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == pytest.approx(want)


def test_languages_with_edges(edge, empty):
    profiles = langid.learn(edge)
    got = langid.identify(edge, profiles, keep=("h", "id")).collect()
    assert len(got) == len(EDGE) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 7)} == {"und"}
    assert langid.identify(empty, profiles).count() == 0 and langid.learn(empty).languages == []
    assert langid.identify(edge, langid.learn(empty)).where("lang_pred <> 'und'").count() == 0


def test_grams_are_counted_whole(monkeypatch):
    text = "Äb  b3b ab" * 50
    whole = langid.grams(text)
    line = " " + re.sub(r"[^a-zäö]+", " ", text.lower()).strip() + " "
    brute = Counter(g for n in (1, 2, 3) for i in range(len(line) - n + 1) if " " not in (g := line[i : i + n])[1:-1] and g != " " and g.strip() and not (g[0] == " " == g[-1]))
    assert sorted(whole[1].tolist()) == sorted(brute.values())
    monkeypatch.setattr(langid, "PIECE", 7)
    assert [x.tolist() for x in langid.grams(text)] == [x.tolist() for x in whole]


# 10: files


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_codes_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 100_000).astype(np.uint32)
    table, rank = tokenfiles.ranking(*np.unique(ids, return_counts=True))
    control, data = tokenfiles.pack_ids(ids, rank)
    assert (tokenfiles.unpack_ids(table, control, data, n) == ids).all() and len(control) == -(-n // 4)
    # more bytes for rarer ids, of one to four
    rank = np.arange(1 << 25, dtype=np.uint32)
    some = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24], np.uint32)
    control, data = tokenfiles.pack_ids(some, rank)
    assert len(data) == 1 + 1 + 2 + 2 + 3 + 3 + 4 and (tokenfiles.unpack_ids(rank, control, data, 7) == some).all()


def test_files_give_the_ids_back(spark, edge, empty, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tokenfiles.write(edge, path, WORD)
    got = tokenfiles.read(spark, path, with_ids=True).orderBy("start").collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == sorted((str(d), tokens_of(t, 2)) for d, t, *_ in EDGE)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert tokenfiles.write_and_read(empty, WORD).count() == 0
    with pytest.raises(ValueError):
        tokenfiles.unpack_block(tokenfiles.pack_block(np.array([1]), np.array([False]), np.array([1]), np.array([5], np.uint32), np.arange(6)) + b"x", np.arange(6))
    count = Counter(i for r in got for i in r["ids"])
    ranks = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()]
    assert ranks == sorted(count, key=lambda i: (-count[i], i))


def test_files_of_one_id_with_very_many_rows(spark, tmp_path):
    rows = [(None if i % 3 else i, f"text number {i % 50}") for i in range(600)]
    path = f"file://{tmp_path}/tokens"
    tokenfiles.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, WORD)
    got = tokenfiles.read(spark, path, with_ids=True).orderBy("start").collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == sorted((str(d), tokens_of(t, 2)) for d, t in rows)
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)


# pipeline


def test_pipeline_against_brute_force(spark, sf, docs):
    """Each stage on its own input: what it keeps follows from the brute-force versions above."""
    now = docs.select(*corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        after = stage(spark, now, sf).cache()
        if name == "packing":
            assert check_packing(list(before.items()), after.collect()) > 0.97
            break
        assert tuple(after.columns) == corpus_pipeline.COLUMNS
        kept = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "language_id":
            assert kept == {d: t for d, t in before.items() if re.search(r"[^\W\d_]", t or "")}
        if name == "line_dedup":
            assert kept == {d: t for d, _, _, t in brute_lines(sorted(before.items())) if t.strip()}
        if name == "ngram_jaccard":
            assert set(kept) == {d for d, _, c in brute_components(sorted(before.items())) if d == c}
        if name == "suffix_dedup":
            rows = {r[0]: r for r in brute_passages(sorted(before.items()))}
            assert all(len(kept.get(d, "").encode()) in range(rows[d][1] - rows[d][2] - 6 * rows[d][3] - 1, rows[d][1] - rows[d][2] + 1) or d not in kept for d in before)
        now = after
    assert corpus_pipeline.run(spark, sf).count() == after.count()


def test_pipeline_stages_with_edges(spark, sf):
    twice, free = " ".join(f"t{i}" for i in range(90)), " ".join(f"n{i}" for i in range(110))
    rows = [*EDGE, (20, twice, "en", "a"), (20, twice, "en", "a"), (20, free[:300] + " own", "en", "a"), (None, free, "en", "b"), (None, free, "en", "b"), (None, twice, "en", "b"), (None, "nameless and unique", "en", "b")]
    df = spark.createDataFrame([(d, t, lang, source, len(t or "")) for d, t, lang, source in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name: sorted(((r["doc_id"], r["text"]) for r in stages[name](spark, df, sf).collect()), key=str)
    all_rows = [(r[0], r[1]) for r in rows]
    assert kept("language_id") == sorted((x for x in all_rows if re.search(r"[^\W\d_]", x[1] or "")), key=str)
    assert kept("line_dedup") == sorted(((d, t) for d, _, _, t in brute_lines(all_rows) if t.strip()), key=str)
    component = {d: c for d, _, c in brute_components([x for x in all_rows if x[1] != LONG])}
    held = {t for d, t in all_rows if d is not None}
    once = {(d, t) for d, t in all_rows if (t not in held if d is None else component.get(d, d) == d)}
    assert kept("ngram_jaccard") == sorted(once, key=str)
    assert {(20, twice), (None, "nameless and unique")} <= once and (None, free) in once
    # what the stage before leaves goes through the next one: a document ingested twice stays
    after = stages["suffix_dedup"](spark, stages["ngram_jaccard"](spark, df, sf), sf)
    assert [r["text"] for r in after.where("doc_id = 20").collect()].count(twice) == 1
    check_packing(all_rows, stages["packing"](spark, df, sf).collect())


def test_token_ids_are_those_of_the_library(spark):
    texts = ["hello <|endoftext|> world", "x<|endoftext|>y <|startoftext|>", "<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>", *[r[1] or "" for r in EDGE]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = tokens_of
    assert ids(texts[0], 2)[:-1] == [3306, 49407, 1002]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    files = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.write_and_read(df, WORD).collect()}
    assert files == {d: (len(x := ids(t, 2)), crc(x)) for d, t in enumerate(texts)}
    for r in packing.pack(df, WORD).collect():
        x = ids(texts[r["doc_id"]], 1)
        assert r["doc_tokens"] == len(x) and r["ids_crc32"] == crc(x[r["start"] : r["start"] + r["length"]])


def test_language_stage_without_labels(spark, edge, sf):
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    want = sorted(((r[0], r[1]) for r in EDGE if re.search(r"[^\W\d_]", r[1] or "")), key=str)
    held = next(i for i in range(100) if langid.held_out(i))
    unlabelled = edge.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(((r["doc_id"], r["text"]) for r in stage(spark, unlabelled, sf).collect()), key=str) == want
    all_held = edge.withColumn("doc_id", F.lit(held).cast("long"))
    assert sorted(r["text"] for r in stage(spark, all_held, sf).collect()) == sorted(t for _, t in want)
