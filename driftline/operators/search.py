"""Vector search: quantised index, exact and clustered top-k, filtered and not.

Scores are the quantised inner product times both scales (about the cosine, as vectors are
normalised); order is score descending, then row ascending.  A search is a plan over rows of
the index and rows of queries: a checked number of queries, with their filters and the ids they
leave out, is broadcast and scored in numpy blocks, and each task passes on a top-k; more queries
than that meet the index's rows in blocks of both.  Filters and exclusions are tested while a block
is scored, so a task never passes on more than k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import vectors as V
from driftline.operators.filters import ATTRIBUTES, Filter, bitmaps, filter_of, filter_rows, newest_pairs
from driftline.sources.shared import stored

#: Queries scored in one scan; their vectors are broadcast (QUERY_CHUNK * dimension bytes), and so are the ids they leave out (16 bytes each).
QUERY_CHUNK = 4096
PAIR_CHUNK = 4096 * 1024
#: Below so many rows an index has no clusters; bounds of their number.
FLAT_BELOW, LEAST_LISTS, MOST_LISTS = 200_000, 256, 65_536
NPROBE = 48
#: Numbers in a block of scores, and rows of a cluster in a block.
BLOCK_CELLS, BLOCK_ROWS = 1 << 21, 8192
#: Rows and queries of a block of an exact search of many queries; a row travels once for each block of queries.
EXACT_ROWS = 65_536


def auto_nlist(n: int) -> int:
    """Clusters for n rows: none below 200,000, else the next power of two of the root, 256 to 65,536, one for 8 rows at most."""
    if n < FLAT_BELOW:
        return 0
    k = 1 << (int(n**0.5) - 1).bit_length()
    k = min(max(LEAST_LISTS, min(MOST_LISTS, k)), n // 8)
    return k if k > 1 else 0


def quantized(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``df`` with the unit vector ``u``, its 8-bit components ``q`` and their ``scale``."""
    u = df.withColumn("u", V.normalize(F.col(vector)))
    return u.withColumn("scale", V.scale_of(F.col("u"))).withColumn("q", V.quantize(F.col("u")))


def build_index(papers: DataFrame, centroids: DataFrame | None = None, id: str = "id", vector: str = "embedding", order: str = "seq") -> DataFrame:
    """The index of papers that are not excluded: their columns, cluster, row, scale and q.

    ``row`` is the place after a stable grouping by cluster.  Rows are put in order by ranges, each
    task numbers its own, and the counts of the tasks before, which are what comes to the driver,
    are added; so neither a flat index nor a hot cluster is numbered in one task.
    """
    df = quantized(papers.where(~F.coalesce(F.col("excluded"), F.lit(False))) if "excluded" in papers.columns else papers, vector)
    df = assign(df, centroids) if centroids is not None else df.withColumn("cluster", F.lit(0))
    ordered = df.drop("u").repartitionByRange("cluster", order, id).sortWithinPartitions("cluster", order, id)

    def number(batches: Iterator[pa.RecordBatch]):
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(done, done + b.num_rows))], [*b.schema.names, "_part", "_inner"])
            done += b.num_rows

    numbered = stored(ordered.mapInArrow(number, T.StructType([*ordered.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_inner", T.LongType())])), "numbered")
    starts, before = [], 0
    for part, n in sorted(numbered.groupBy("_part").agg(F.count(F.lit(1))).collect()):
        starts.append((part, before))
        before += n
    first = F.broadcast(papers.sparkSession.createDataFrame(starts, "_part int, _start long"))
    return numbered.join(first, "_part").withColumn("row", F.col("_start") + F.col("_inner")).drop("_part", "_inner", "_start")


def centroid_table(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, one row each): centroids (at most MOST_LISTS, by ``auto_nlist``) as a matrix."""
    t = centroids.select(F.col("cluster").cast("int"), F.col("c").cast("array<double>")).orderBy("cluster").limit(MOST_LISTS + 1).toArrow()
    if len(t) > MOST_LISTS:
        raise ValueError("too many clusters")
    return t.column(0).to_numpy(), matrix_of(t.column(1).combine_chunks())


def matrix_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1 if len(column) else 0)


def _rows_of(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(x.ravel()))


def nearest(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The row of ``table`` of the largest inner product, for each row of ``x``; ties to the first."""
    step = max(1, BLOCK_CELLS // max(1, len(table)))
    return np.concatenate([np.zeros(0, np.int64), *((x[low : low + step] @ table.T).argmax(1) for low in range(0, len(x), step))])


def assign(df: DataFrame, centroids: DataFrame, vector: str = "u") -> DataFrame:
    """``df`` with its ``cluster``: the centroid of the largest inner product, ties to the smaller number."""
    own = df.drop("cluster")
    shared = df.sparkSession.sparkContext.broadcast(centroid_table(centroids))
    at = own.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]):
        numbers, table = shared.value
        for b in batches:
            near = numbers[nearest(matrix_of(b.column(at)), table)] if b.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32())], [*b.schema.names, "cluster"])

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("cluster", T.IntegerType())]))


def mean_centroids(df: DataFrame, by: str = "label", vector: str = "u") -> DataFrame:
    """(cluster, c): for each value of ``by`` the mean direction of its vectors."""
    parts = df.select(F.col(by).cast("int").alias("cluster"), F.posexplode(vector).alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
    c = parts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    return c.select("cluster", V.normalize(F.col("m")).alias("c"))


def kmeans(df: DataFrame, k: int, vector: str = "u", rounds: int = 10, sample: int = 262_144, seed: int = 7, id: str = "id") -> DataFrame:
    """(cluster, c): spherical k-means on about ``sample`` rows; all rows are assigned by ``assign``.

    Rows, seeds and the rows that empty clusters start anew from are those with the smallest hashes of
    their ids.  In a round every task sums its rows by cluster, the sums are added by cluster, and
    the centroids alone come to the driver.
    """
    spark, n = df.sparkSession, df.count()
    h = F.pmod(F.xxhash64(F.lit(seed), F.col(id)), F.lit(1 << 30))
    rows = df.select(h.alias("h"), F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = stored(rows.where(F.col("h") < (1 << 30) * min(1.0, sample / max(1, n))), "sample")
    spare = k // 8 + 16
    x = matrix_of(rows.orderBy("h", "id").limit(k + spare).select("v").toArrow().column(0).combine_chunks())
    if not len(x):
        return spark.createDataFrame([], "cluster int, c array<double>")
    k = min(k, len(x))
    c, spares = x[:k].copy(), x[k:]

    def add(t: pa.Table) -> pa.Table:
        total = matrix_of(t.column("s").combine_chunks()).sum(0)
        return pa.table({"cluster": t.column("cluster").slice(0, 1), "s": _rows_of(total[None])})

    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(c)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                v = matrix_of(b.column("v"))
                near = nearest(v, shared.value)
                order = np.argsort(near, kind="stable")
                which, at = np.unique(near[order], return_index=True)
                for cluster, s in zip(which.tolist(), np.add.reduceat(v[order], at), strict=True):
                    total[cluster] = total[cluster] + s if cluster in total else s
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), _rows_of(np.stack(list(total.values())))], ["cluster", "s"])

        total = np.zeros_like(c)
        got = rows.select("v").mapInArrow(sums, "cluster int, s array<double>").groupBy("cluster").applyInArrow(add, "cluster int, s array<double>").toArrow()
        if len(got):
            total[got.column("cluster").to_numpy()] = matrix_of(got.column("s").combine_chunks())
        size = np.linalg.norm(total, axis=1)
        empty = np.flatnonzero(size == 0)
        if len(empty) and len(spares):
            total[empty] = spares[(np.arange(len(empty)) + turn) % len(spares)]
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-12)[:, None], c)
    return spark.createDataFrame(pa.table({"cluster": pa.array(np.arange(len(c), dtype=np.int32)), "c": _rows_of(c)}), "cluster int, c array<double>")


def merged_top(parts: list[tuple[np.ndarray, ...]], want: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Of (query, id, row, dot, score) parts the best ``want`` of each query."""
    if not parts:
        return []
    who, ids, rows, dots, s = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((rows, -s, who))
    who, ids, rows, dots, s = who[order], ids[order], rows[order], dots[order], s[order]
    at = np.arange(len(who))
    new = np.concatenate([[True], who[1:] != who[:-1]])
    keep = at - np.maximum.accumulate(np.where(new, at, 0)) < want[who]
    return [(who[keep], ids[keep], rows[keep], dots[keep], s[keep])]


def _block_top(q: np.ndarray, rows: np.ndarray, k: np.ndarray, x: np.ndarray, scale: np.ndarray, allowed: np.ndarray | None = None, out: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the best k of a block: (query, places, integer products, scores).

    ``allowed`` says which rows a query may have, and ``out`` has (query, place) pairs that it may not.
    """
    dots = q @ x.T  # integers below 2**53, so exact in doubles
    score = dots * scale
    if allowed is not None:
        score[~allowed] = -np.inf
    if out is not None:
        score[out] = -np.inf
    for i in range(len(q)):
        want = min(int(k[i]), len(rows))
        if want <= 0:
            continue
        s = score[i]
        least = np.partition(s, len(s) - want)[len(s) - want] if want < len(s) else -np.inf
        some = np.flatnonzero(s >= least if least > -np.inf else s > -np.inf)
        some = some[np.lexsort((rows[some], -s[some]))][:want]
        yield i, some, dots[i, some].astype(np.int64), s[some]


HITS = "query_id long, id long, row long, dot long, partial double"


def _by_scan(points: DataFrame, asked: DataFrame, probes: DataFrame | None, banned: DataFrame | None) -> DataFrame:
    """HITS of a chunk of queries, which are broadcast: each task scores its rows in blocks and passes on a top-k.

    Filters are numbered; a batch of rows gets a bitmap for each distinct one.  Excluded (id, query) pairs
    are sorted by id, so a batch looks its own ids up.
    """
    spark = points.sparkSession
    got = asked.orderBy("query_id").toArrow()  # a chunk of queries, about
    names = got.column("query_id").to_numpy()
    allowed = None
    if probes is not None:
        by_cluster: dict[int, list[int]] = {}
        at = {query: i for i, query in enumerate(names.tolist())}
        for query, cluster in probes.select("query_id", "cluster").collect():  # nprobe for each query of the one chunk
            if query in at:
                by_cluster.setdefault(cluster, []).append(at[query])
        allowed = {c: np.array(v) for c, v in by_cluster.items()}
        if len(by_cluster) <= 4096:  # clusters that nobody probes are not read
            points = points.where(F.col("cluster").isin(*sorted(by_cluster)))
    filters, which_filter = _numbered_filters(got.column("filter").to_pylist()) if "filter" in got.column_names else ([], None)
    out_ids, out_query = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if banned is not None:  # PAIR_CHUNK pairs at most
        pairs = banned.select("query_id", "id").orderBy("id").toArrow()
        out_ids, out_query = pairs.column("id").to_numpy(), np.searchsorted(names, pairs.column("query_id").to_numpy())
    sent = spark.sparkContext.broadcast((names, matrix_of(got.column("q").combine_chunks()), got.column("k").to_numpy(), allowed, filters, which_filter, out_ids, out_query))

    def score(batches: Iterator[pa.RecordBatch]):
        names, q, want, allowed, filters, which_filter, out_ids, out_query = sent.value
        best: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows or not len(names):
                continue
            ids, rows, scale = (np.asarray(b.column(c)) for c in ("id", "row", "scale"))
            x = matrix_of(b.column("q"))
            masks = bitmaps(filters, b) if which_filter is not None else None
            low, high = np.searchsorted(out_ids, ids, "left"), np.searchsorted(out_ids, ids, "right")
            many = high - low
            out_row = np.repeat(np.arange(len(ids)), many)
            out_who = out_query[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
            jobs = [(np.arange(len(names)), np.arange(len(rows)))]
            if allowed is not None:
                cluster = np.asarray(b.column("cluster"))
                jobs = [(allowed[c], np.flatnonzero(cluster == c)) for c in np.unique(cluster).tolist() if c in allowed]
            for who, which in jobs:
                step = max(1, BLOCK_CELLS // len(which))
                for at in range(0, len(who), step):
                    some = who[at : at + step]
                    may = masks[which_filter[some]][:, which] if masks is not None else None
                    out = _within(some, which, out_who, out_row, len(names), len(ids)) if len(out_row) else None
                    best += [(np.full(len(found), some[i]), ids[which[found]], rows[which[found]], dots, s) for i, found, dots, s in _block_top(q[some], rows[which], want[some], x[which], scale[which], may, out)]
            if sum(len(p[0]) for p in best) > 4 * max(1, int(want.sum())):
                best = merged_top(best, want)
        for who, *rest in merged_top(best, want):
            yield pa.RecordBatch.from_arrays([pa.array(names[who]), *map(pa.array, rest)], ["query_id", "id", "row", "dot", "partial"])

    return points.mapInArrow(score, HITS)


def _numbered_filters(rows: list[dict | None]) -> tuple[list[Filter], np.ndarray]:
    """The distinct filters, and the number of each row's, -1 without one: it is the last of the bitmaps, which has all rows."""
    numbers: dict[Filter, int] = {}
    which = [-1 if (f := filter_of(r)).empty else numbers.setdefault(f, len(numbers)) for r in rows]
    return list(numbers), np.array(which, np.int64)


def _within(some: np.ndarray, which: np.ndarray, who: np.ndarray, row: np.ndarray, queries: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The (query, row) pairs that are in a block of some queries and some rows, by their places there."""
    at_query, at_row = np.full(queries, -1), np.full(rows, -1)
    at_query[some], at_row[which] = np.arange(len(some)), np.arange(len(which))
    a, b = at_query[who], at_row[row]
    inside = (a >= 0) & (b >= 0)
    return a[inside], b[inside]


def _by_block(points: DataFrame, asked: DataFrame, probes: DataFrame | None, banned: DataFrame | None) -> DataFrame:
    """HITS of any number of queries: rows and queries meet by cluster, large ones in blocks of rows and of queries.

    Without probes all rows are one cluster.  An excluded id travels only to the block that has its row.
    """
    spark = points.sparkSession
    size = BLOCK_ROWS if probes is not None else EXACT_ROWS
    if probes is None:
        points, walked = points.withColumn("cluster", F.lit(0)), asked.withColumn("cluster", F.lit(0))
    else:
        walked = asked.join(probes.select("query_id", "cluster"), "query_id")
    block = lambda df, name: df.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    parts = block(points, "row_parts").join(block(walked, "ask_parts"), "cluster")
    parts = F.broadcast(spark.createDataFrame(parts.collect(), "cluster int, row_parts int, ask_parts int"))  # a row for each cluster
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    placed = points.join(parts, "cluster").withColumn("row_part", F.pmod(F.xxhash64("id"), "row_parts").cast("int"))
    left = placed.select(*points.columns, "row_part", every("ask_parts").alias("ask_part"))
    filtered = "filter" in asked.columns
    right = walked.join(parts, "cluster").select("cluster", "query_id", F.col("q").alias("asked"), "k", *(["filter"] if filtered else []), F.pmod(F.xxhash64("query_id"), "ask_parts").cast("int").alias("ask_part"), every("row_parts").alias("row_part"))
    if banned is not None:
        own = banned.join(placed.select("id", "cluster", "row_part"), "id").groupBy("query_id", "cluster", "row_part").agg(F.collect_list("id").alias("out"))
        right = right.join(own, ["query_id", "cluster", "row_part"], "left")
    group = ("cluster", "row_part", "ask_part")

    def score(a: pa.Table, b: pa.Table) -> pa.Table:
        best: list[tuple[np.ndarray, ...]] = []
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        names = ["query_id", "id", "row", "dot", "partial"]
        if len(a) and len(b):
            ids, rows, scale = (a.column(c).to_numpy() for c in ("id", "row", "scale"))
            x, q = matrix_of(a.column("q").combine_chunks()), matrix_of(b.column("asked").combine_chunks())
            who, want = b.column("query_id").to_numpy(), b.column("k").to_numpy()
            masks = None
            if filtered:
                filters, which_filter = _numbered_filters(b.column("filter").to_pylist())
                masks = bitmaps(filters, a)
            out_who = out_row = np.zeros(0, np.int64)
            if "out" in b.column_names:
                lists = b.column("out").combine_chunks()
                many = np.asarray(lists.value_lengths().fill_null(0))
                order = np.argsort(ids)
                out_who, out_row = np.repeat(np.arange(len(b)), many), order[np.searchsorted(ids, np.asarray(lists.flatten()), sorter=order)]
            step = max(1, BLOCK_CELLS // len(x))
            for low in range(0, len(who), step):
                part = slice(low, low + step)
                may = masks[which_filter[part]] if masks is not None else None
                inside = (out_who >= low) & (out_who < low + step)
                out = (out_who[inside] - low, out_row[inside]) if inside.any() else None
                best += [(np.full(len(at), who[low + i]), ids[at], rows[at], dots, s) for i, at, dots, s in _block_top(q[part], rows, want[part], x, scale, may, out)]
        columns = [np.concatenate(c) for c in zip(*best, strict=True)] if best else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(score, HITS)


def exact_topk(index: DataFrame, queries: DataFrame, k: int = 100, f: Filter | None = None, exclude: DataFrame | None = None, id: str = "id", probes: DataFrame | None = None, filters: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, id, row, dot, score): the k best rows of the index for each query.

    ``queries`` has query_id, q and scale; an optional column k overrides ``k``.  ``exclude`` has
    (query_id, id) pairs left out; with a column ts only the newest of each query count (see
    filters.newest_pairs).  ``filters`` has a filter for some queries (see filters.filter_rows), ``f`` is one for
    all of them.  ``probes`` has (query_id, cluster) pairs to which the scan is confined.  All are tested while
    rows are scored, in one scan.  k = 0 gives nothing.
    """
    points = (f.apply(index) if f else index).select(F.col(id).cast("long").alias("id"), F.col("row").cast("long").alias("row"), "scale", "q", *(["cluster"] if probes is not None else []), *(c for c in ATTRIBUTES if filters is not None and c in index.columns))
    asked = queries.select("query_id", "q", "scale", (F.col("k") if "k" in queries.columns else F.lit(k)).cast("int").alias("k"))
    if filters is not None:
        asked = asked.join(filter_rows(filters), "query_id", "left")
    banned = None
    if exclude is not None:
        banned = newest_pairs(exclude).select("query_id", F.col("id").cast("long").alias("id")).distinct().join(asked.select("query_id"), "query_id", "left_semi")
    total, most = asked.agg(F.count(F.lit(1)), F.coalesce(F.max("k"), F.lit(0))).first()
    few = total <= QUERY_CHUNK and (banned is None or banned.count() <= PAIR_CHUNK)
    found = (_by_scan if few else _by_block)(points, asked, probes, banned)
    # ranked first, so that the tops of all tasks meet their queries' scales as one top
    best = Window.partitionBy("query_id").orderBy(F.desc("partial"), "row")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
    scales = asked.select("query_id", F.col("scale").alias("q_scale"), "k")
    scored = top.join(F.broadcast(scales) if total <= QUERY_CHUNK else scales, "query_id").where(F.col("rank") <= F.col("k"))
    return scored.select("query_id", "rank", F.col("id").alias(id), "row", "dot", (F.col("partial") * F.col("q_scale")).alias("score"))


def rank_clusters(queries: DataFrame, centroids: DataFrame, vector: str = "u", most: int | None = None) -> DataFrame:
    """(query_id, cluster, rank): the ``most`` nearest clusters of each query (all without it), scored in blocks against the broadcast centroids."""
    shared = queries.sparkSession.sparkContext.broadcast(centroid_table(centroids))
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        numbers, table = shared.value
        many = len(numbers) if most is None else min(most, len(numbers))
        for b in batches:
            for low, near in _cluster_products(matrix_of(b.column(1)), table):
                ranked = [first_ranks(row, many) for row in near] if many else []
                if ranked:
                    who = b.column(0).take(pa.array(np.repeat(np.arange(low, low + len(near)), many)))
                    yield pa.RecordBatch.from_arrays([who, pa.array(numbers[np.concatenate(ranked)]), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(near)))], ["query_id", "cluster", "rank"])

    return queries.select("query_id", F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"query_id {kind}, cluster int, rank int")


def _cluster_products(x: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, products with all centroids) in blocks."""
    step = max(1, BLOCK_CELLS // max(1, len(table)))
    for low in range(0, len(x), step):
        yield low, np.round(x[low : low + step] @ table.T, 12)


def first_ranks(near: np.ndarray, many: int) -> np.ndarray:
    """The ``many`` largest of a row, best first, ties to the smaller number."""
    if many < len(near):  # all that tie with the last one that counts
        at = np.flatnonzero(near >= -np.partition(-near, many - 1)[many - 1])
    else:
        at = np.arange(len(near))
    return at[np.argsort(-near[at], kind="stable")][:many]


def ivf_topk(index: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = 100, nprobe: int = NPROBE, exclude: DataFrame | None = None, id: str = "id") -> DataFrame:
    """``exact_topk`` within each query's ``nprobe`` nearest clusters; exact if that is none or all."""
    nlist = centroids.count()
    if nlist == 0 or nprobe == 0 or nprobe >= nlist:
        return exact_topk(index, queries, k, exclude=exclude, id=id)
    probes = rank_clusters(queries, centroids, most=nprobe)
    return exact_topk(index, queries, k, exclude=exclude, id=id, probes=probes)


def wave_probes(index: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int, f: Filter, exclude: DataFrame | None = None, id: str = "id") -> DataFrame:
    """(query_id, cluster, rank, eligible, until): the clusters that widening waves reach.

    Waves end after nprobe, 3, 7, ... times as many clusters; the first to hold k eligible rows
    is the last.  Eligible rows are counted by cluster (those of the query's excluded ones taken off) and
    sent along with the centroids; a task ranks a query's clusters wave by wave, only as far as it
    needs, and passes on those that it reaches.
    """
    spark = queries.sparkSession
    numbers, table = centroid_table(centroids)
    nlist = len(numbers)
    nprobe = nprobe if 0 < nprobe < nlist else nlist
    rows = f.apply(index)
    eligible = np.zeros(nlist, np.int64)
    counted = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a row for each cluster
    eligible[np.searchsorted(numbers, counted.column("cluster").to_numpy())] = counted.column("n").to_numpy()
    shared = spark.sparkContext.broadcast((numbers, table, eligible))
    asked = queries.select("query_id", F.col("u").cast("array<double>").alias("v"))
    if exclude is not None:
        out = newest_pairs(exclude).select("query_id", F.col("id").alias(id)).distinct().join(rows.select(id, "cluster"), id).groupBy("query_id").agg(F.collect_list(F.col("cluster").cast("int")).alias("out"))
        asked = asked.join(out, "query_id", "left")
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        numbers, table, eligible = shared.value
        for b in batches:
            outs = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            for low, near in _cluster_products(matrix_of(b.column(1)), table):
                who, found, ranks, left, ends = [], [], [], [], []
                for i, row in enumerate(near):
                    own = eligible.copy() if outs[low + i] else eligible
                    for c in outs[low + i] or ():
                        own[np.searchsorted(numbers, c)] -= 1
                    until = wave = nprobe
                    order = first_ranks(row, until)
                    while until < len(numbers) and own[order].sum() < k:
                        wave *= 2
                        until = min(len(numbers), until + wave)
                        order = first_ranks(row, until)
                    who.append(np.full(len(order), low + i))
                    found.append(numbers[order])
                    ranks.append(np.arange(1, len(order) + 1, dtype=np.int32))
                    left.append(own[order])
                    ends.append(np.full(len(order), until, np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(who))), *(pa.array(np.concatenate(c)) for c in (found, ranks, left, ends))], ["query_id", "cluster", "rank", "eligible", "until"])

    return asked.mapInArrow(run, f"query_id {kind}, cluster int, rank int, eligible long, until int")


def filtered_topk(index: DataFrame, centroids: DataFrame | None, queries: DataFrame, f: Filter, k: int = 100, nprobe: int = NPROBE, exclude: DataFrame | None = None, id: str = "id") -> DataFrame:
    """The k best rows that match, by waves of clusters; exact without clusters."""
    if centroids is None or f.empty:
        return exact_topk(index, queries, k, f, exclude, id) if centroids is None else ivf_topk(index, centroids, queries, k, nprobe, exclude, id)
    return exact_topk(index, queries, k, f, exclude, id, wave_probes(index, centroids, queries, k, nprobe, f, exclude, id))


def mixed_topk(index: DataFrame, queries: DataFrame, filters: DataFrame | dict[int, Filter], k: int = 100, exclude: DataFrame | None = None, id: str = "id") -> DataFrame:
    """Queries with filters of their own beside unfiltered ones, in one shared scan; ``filters`` is a table (see filters.filter_rows)."""
    if isinstance(filters, dict):
        filters = filter_rows(index.sparkSession, filters)
    return exact_topk(index, queries, k, exclude=exclude, id=id, filters=filters)


def seed_vector(links: DataFrame, index: DataFrame, id: str = "id") -> DataFrame:
    """(query_id, basis, i, x): the sum of the vectors of linked papers that are in the index; repeated links count."""
    met = links.join(index.select(F.col(id).alias("linked"), "q", "scale"), "linked")
    basis = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("basis"))
    summed = met.select("query_id", F.posexplode(V.dequantize(F.col("q"), F.col("scale"))).alias("i", "x")).groupBy("query_id", "i").agg(F.sum("x").alias("x"))
    return summed.join(basis, "query_id")


def recall(approximate: DataFrame, exact: DataFrame, at: int = 10, id: str = "id") -> DataFrame:
    """(hits, truth, recall, similarity): shared rows of the first ``at``, and mean score against the exact one."""
    a = approximate.where(F.col("rank") <= at).select("query_id", id, F.col("score").alias("a_score"))
    e = exact.where(F.col("rank") <= at).select("query_id", id, F.col("score").alias("e_score"))
    hits = e.join(a, ["query_id", id], "left").agg(F.count("a_score").alias("hits"), F.count(F.lit(1)).alias("truth"))
    means = a.groupBy("query_id").agg(F.avg("a_score").alias("a")).join(e.groupBy("query_id").agg(F.avg("e_score").alias("e")), "query_id").agg(F.avg(F.col("a") / F.col("e")).alias("similarity"))
    return hits.crossJoin(means).select("hits", "truth", (F.col("hits") / F.col("truth")).alias("recall"), "similarity")


def evaluate(index: DataFrame, centroids: DataFrame, queries: DataFrame, k: int = 10, nprobes: tuple[int, ...] = (16, NPROBE, 128, 256)) -> DataFrame:
    """(nprobe, recall, similarity, scanned): clustered search against the exact one; ``scanned`` is the share of clusters."""
    nlist, out = centroids.count(), None
    exact = stored(exact_topk(index, queries, k), "exact")
    for nprobe in nprobes:
        row = recall(ivf_topk(index, centroids, queries, k, nprobe), exact, k).select(F.lit(nprobe).alias("nprobe"), "recall", "similarity", F.lit(min(1.0, nprobe / nlist) if nlist and nprobe else 1.0).alias("scanned"))
        out = row if out is None else out.unionAll(row)
    return out


def cluster_sizes(index: DataFrame) -> DataFrame:
    """(least, median, most) of clusters; the median is the element at half."""
    sizes = index.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list("n")).alias("s"))
    return sizes.select(F.array_min("s").alias("least"), F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("median"), F.array_max("s").alias("most"))
