"""Approximate nearest neighbours by a hierarchical k-means tree (operator 1).

The upper tree is fitted on a bounded sample.  Leaves that hold many rows grow a subtree of their
own, fitted on the executors on a bounded sample of the leaf's rows, so leaves grow in number with the
data until the two bounds are used up (``SAMPLE`` and ``SPLIT_SAMPLE`` over ``LEAF_SAMPLE``: some
50,000 leaves; the tree that is broadcast is bounded by them).  Every row is put in a leaf.  A query walks
the tree best bin first: a priority queue of nodes by the distance of their centres gives
its leaves in order of promise.  How many leaves it visits is widened until the recall of held-out
queries, against brute force over the whole table, reaches the target.

Leaves that follow each other in the tree share a cell of some thousand rows; a query goes to a
cell once, with the leaves that it visits there, and brings its k best back.  Copies of
a vector are one vector with its smallest ids, as many as any result could show, so a very
common vector fills neither a leaf nor a task; large leaves are split in blocks.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.textblocks import lean, lists, stored

#: Vectors the tree is fitted on, those with the smallest id hashes.
SAMPLE = 20_000
#: Children of a node, and vectors of the sample in a leaf, about.
BRANCH = 16
LEAF_SAMPLE = 100
#: Share of the sample that the tree is fitted on; the rest, which it has not seen, calibrates it.
FIT_SHARE = 0.6
#: Held-out queries for calibration, and the recall they must reach.
CALIBRATE = 400
TARGET = 0.95
#: A leaf with more rows grows a subtree, fitted on about so many of them.
SPLIT_ROWS = 8192
SPLIT_SAMPLE = 8000
#: Rows and queries of a cell in one block, and queries scored at a time.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 4096
SLICE = 256


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centres, nearest centre of each row), Lloyd's rounds from k distinct rows."""
    centres = np.unique(x, axis=0)
    if len(centres) <= k:
        k = len(centres)
    else:
        centres = centres[rng.choice(len(centres), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        some = count > 0
        centres = np.where(some[:, None], total / np.maximum(count, 1)[:, None], centres)
    return centres, nearest(x, centres)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


@dataclass
class Tree:
    """Nodes as lists: children (indices), their centres; a leaf has its number."""

    children: list[list[int]] = field(default_factory=list)
    centres: list[np.ndarray | None] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0
    visits: int = 1
    recall: float = 1.0

    @classmethod
    def fit(cls, x: np.ndarray, branch: int = BRANCH, leaf_size: int = LEAF_SAMPLE, seed: int = 7) -> Tree:
        tree, rng = cls(), np.random.default_rng(seed)

        def grow(rows: np.ndarray) -> int:
            me = len(tree.leaf)
            tree.children.append([])
            tree.centres.append(None)
            tree.leaf.append(-1)
            parts: list[np.ndarray] = []
            if len(rows) > leaf_size:
                centres, near = kmeans(x[rows], branch, rng)
                parts = [rows[near == c] for c in range(len(centres))]
                keep = [c for c, p in enumerate(parts) if len(p)]
                parts, centres = [parts[c] for c in keep], centres[keep]
            if len(parts) < 2:
                tree.leaf[me] = tree.leaves
                tree.leaves += 1
            else:
                tree.centres[me] = centres
                tree.children[me] = [grow(p) for p in parts]
            return me

        grow(np.arange(len(x)))
        return tree

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at every node."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            near = nearest(x[rows], self.centres[node])
            todo += [(child, rows[near == c]) for c, child in enumerate(self.children[node]) if (near == c).any()]
        return out

    def best_first(self, q: np.ndarray, visits: int) -> list[int]:
        """The first ``visits`` leaves, nodes taken from a queue by the distance of their centres."""
        queue, found = [(0.0, 0)], []
        while queue and len(found) < visits:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                continue
            apart = ((self.centres[node] - q) ** 2).sum(1)
            for d, child in zip(apart.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (d, child))
        return found

    def graft(self, subtrees: dict[int, Tree]) -> Tree:
        """This tree with subtrees in place of some leaves; leaves are numbered anew, in the order of a walk."""
        out = Tree()

        def copy(tree: Tree, node: int, top: bool) -> int:
            if top and tree.leaf[node] in subtrees:
                return copy(subtrees[tree.leaf[node]], 0, False)
            me = len(out.leaf)
            out.children.append([])
            out.centres.append(tree.centres[node])
            out.leaf.append(-1)
            if tree.leaf[node] >= 0:
                out.leaf[me], out.leaves = out.leaves, out.leaves + 1
            else:
                out.children[me] = [copy(tree, child, top) for child in tree.children[node]]
            return me

        copy(self, 0, True)
        return out

    def calibrate(self, queries: np.ndarray, found: list[np.ndarray], target: float) -> None:
        """Widen ``visits`` until the target share of the leaves ``found`` (of each query's true neighbours) is visited; all leaves reach 1."""
        self.visits, self.recall = self.leaves, 1.0
        needed = []
        for q, leaves in zip(queries, found, strict=True):
            place = np.empty(self.leaves, np.int64)
            path = self.best_first(q, self.leaves)
            place[path] = np.arange(len(path))
            needed.append(place[leaves])
        flat = np.concatenate([*needed, np.zeros(0, np.int64)])
        if not len(flat):
            return
        self.visits = 1
        while (recall := float((flat < self.visits).mean())) < target and self.visits < self.leaves:
            self.visits = min(self.leaves, max(self.visits + 1, self.visits * 17 // 16))
        self.recall = recall


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v) of rows with an id and a vector of finite numbers, not all zero."""
    kind = rows.select(F.col(f"`{vector}`")).schema[0].dataType.simpleString()
    v = F.col(f"`{vector}`").cast(kind if kind == "array<float>" else "array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(f"`{id}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fine, F.lit(False)))


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[Tree, np.ndarray]:
    """The upper tree from (id, v) rows, and vectors that it has not seen; ``sample`` rows come to the driver."""
    top = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    if not len(top):
        return Tree.fit(np.zeros((0, 1))), np.zeros((0, 1))
    x = np.stack(top["v"].to_numpy()).astype(float)
    seen = max(1, int(len(x) * FIT_SHARE))
    return Tree.fit(x[:seen]), x[seen:][:CALIBRATE]


def vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1)


def assigned(rows: DataFrame, tree: Tree) -> DataFrame:
    """(ids, v) rows with their leaf, stored."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                leaf = shared.value.assign(vectors(b.column("v")))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), b.column("ids"), b.column("v")], ["leaf", "ids", "v"])

    return stored(rows.select("ids", "v").mapInArrow(lean(run), f"leaf long, ids array<long>, v {rows.schema['v'].dataType.simpleString()}"), "placed")


def subtrees(placed: DataFrame, sizes: dict[int, int]) -> dict[int, Tree]:
    """Trees of the leaves with more than SPLIT_ROWS rows, each fitted in a task on about SPLIT_SAMPLE of them."""
    big = [(leaf, min(1.0, SPLIT_SAMPLE / n)) for leaf, n in sizes.items() if n > SPLIT_ROWS]
    if not big:
        return {}
    share = F.broadcast(placed.sparkSession.createDataFrame(big, "leaf long, share double"))  # leaves of the upper tree

    def grow(t: pa.Table) -> pa.Table:
        tree = Tree.fit(vectors(t.column("v").combine_chunks()))
        return pa.table({"leaf": t.column("leaf").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    some = placed.join(share, "leaf").where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    grown = some.select("leaf", "v").groupBy("leaf").applyInArrow(grow, "leaf long, tree binary")
    return {r["leaf"]: pickle.loads(r["tree"]) for r in grown.collect()}  # SPLIT_SAMPLE / LEAF_SAMPLE centres each, about


def true_leaves(placed: DataFrame, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the leaves of its k nearest among all rows, by brute force; the query's own vector is left out."""
    shared = placed.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]):
        q = shared.value
        best, where = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
        for b in batches:
            for low in range(0, b.num_rows, BLOCK_ROWS):
                x, leaf = vectors(b.column("v").slice(low, BLOCK_ROWS)), np.asarray(b.column("leaf").slice(low, BLOCK_ROWS))
                score = q @ x.T
                near = np.argwhere(score >= (q**2).sum(1)[:, None] * (1 - 1e-9))
                own = near[(x[near[:, 1]] == q[near[:, 0]]).all(1)]
                score[own[:, 0], own[:, 1]] = -np.inf
                best = np.concatenate([best, score], 1)
                where = np.concatenate([where, np.broadcast_to(leaf, score.shape)], 1)
                if best.shape[1] > k:
                    top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                    best, where = np.take_along_axis(best, top, 1), np.take_along_axis(where, top, 1)
        row = np.repeat(np.arange(len(q)), best.shape[1])
        some = np.isfinite(best.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array(best.ravel()[some]), pa.array(where.ravel()[some])], ["query", "score", "leaf"])

    top = Window.partitionBy("query").orderBy(F.desc("score"))
    out: list[list[int]] = [[] for _ in queries]
    for r in placed.mapInArrow(lean(run), "query long, score double, leaf long").withColumn("place", F.row_number().over(top)).where(F.col("place") <= k).select("query", "leaf").collect():
        out[r["query"]].append(r["leaf"])  # k rows for each of CALIBRATE queries
    return [np.array(x, np.int64) for x in out]


def cells(sizes: dict[int, int], leaves: int) -> list[tuple[int, int, int]]:
    """(leaf, cell, row parts): neighbours in the tree share a cell of BLOCK_ROWS rows, larger leaves have parts."""
    out, cell, held = [], 0, 0
    for leaf in range(leaves):
        n = sizes.get(leaf, 0)
        if held and held + n > BLOCK_ROWS:
            cell, held = cell + 1, 0
        out.append((leaf, cell, max(1, -(-n // BLOCK_ROWS))))
        held += n
    return out


def best_of(x: np.ndarray, leaf: np.ndarray, ids: pa.ListArray, q: np.ndarray, me: np.ndarray, visited: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score): each query's k best ids among the rows of the leaves it visits, ties to the smaller id.

    Rows are sifted by a matrix product, with all kept that its rounding could have put behind.
    """
    first, flat = ids.offsets.to_numpy(), np.asarray(ids.values)
    known, leaf = np.unique(leaf, return_inverse=True)
    slack = 4 * x.shape[1] * np.finfo(float).eps * np.sqrt((q**2).sum(1) * (x**2).sum(1).max())
    names, near, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for low in range(0, len(q), SLICE):
        part = q[low : low + SLICE]
        open_ = np.zeros((len(part), len(known)), bool)
        for i, v in enumerate(visited[low : low + SLICE]):
            at = np.searchsorted(known, v)
            at = at[at < len(known)]
            open_[i, at[np.isin(known[at], v)]] = True
        seen = open_[:, leaf]
        rough = np.where(seen, part @ x.T, -np.inf)
        want = min(k + 1, len(x))
        least = np.partition(rough, len(x) - want, axis=1)[:, len(x) - want] - slack[low : low + SLICE]
        keep = seen & ~(rough < least[:, None])
        for i, own in enumerate(me[low : low + SLICE].tolist()):
            best = np.flatnonzero(keep[i])
            exact = (x[best] * part[i]).sum(1)
            size = first[best + 1] - first[best]
            who = np.concatenate([flat[first[j] : first[j + 1]] for j in best.tolist()]) if len(best) else flat[:0]
            s = np.repeat(exact, size)
            s, who = s[who != own], who[who != own]
            order = np.lexsort((who, -s))[:k]
            near.append(who[order])
            scores.append(s[order])
            names.append(np.full(len(order), own))
    return np.concatenate(names), np.concatenate(near), np.concatenate(scores)


def indexed(points: DataFrame, k: int, sample: int = SAMPLE, target: float = TARGET) -> tuple[Tree, DataFrame]:
    """A calibrated tree and all (id, v) rows in its leaves: leaf, ids (of copies of a vector the smallest k + 1), v."""
    tree, held_out = fit(points, sample)
    # of copies, the k + 1 smallest ids are all that a result can show; limited before the shuffle, too
    copies = Window.partitionBy("h", "g").orderBy("id")
    key = (F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    ranked = points.select("id", "v", *key).withColumn("place", F.dense_rank().over(copies)).where(F.col("place") <= k + 1)
    classes = ranked.groupBy("h", "g").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("v").alias("v"))
    placed = assigned(classes, tree)
    more = subtrees(placed, dict(placed.groupBy("leaf").count().collect()))  # a number for each leaf of the upper tree
    if more:
        tree = tree.graft(more)
        placed = assigned(placed, tree)
    tree.calibrate(held_out, true_leaves(placed, held_out, k) if len(held_out) else [], target)
    return tree, placed


def search(rows: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """(query_id, rank, id, score): for each query its k rows of largest inner product found, itself left out.

    ``rows`` and ``queries`` have ids and vectors; a query's own row is known by its id.  Scores
    are inner products of the original vectors in double precision, ties go to the smaller
    id; fewer rows than k give all.  Vectors that are null, zero, or hold null or non-finite
    numbers take no part, nor do rows with null ids or with another dimension than most of the
    sample's.  A repeated row (same id and vector) counts once.
    """
    spark = rows.sparkSession
    points, asked = usable(rows, id, vector), usable(queries, id, vector)
    sizes = points.orderBy(F.xxhash64("id"), "id").limit(1001).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes[0] if sizes else 0
    points, asked = (t.where(F.size("v") == dim).distinct() if t is asked else t.where(F.size("v") == dim) for t in (points, asked))
    tree, placed = indexed(points, k, sample, target)
    held = dict(placed.groupBy("leaf").count().collect())  # a number for each leaf
    where = cells(held, tree.leaves)
    shared = spark.sparkContext.broadcast((tree, np.array([c for _, c, _ in where], np.int64)))

    def walk(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            tree, cell_of = shared.value
            row, cell, visited = [], [], []
            for i, q in enumerate(vectors(b.column("v"))):
                path = np.sort(np.array(tree.best_first(q, tree.visits), np.int64))  # leaves of a cell are neighbours
                cut = np.flatnonzero(np.diff(cell_of[path])) + 1
                row += [i] * (len(cut) + 1)
                cell += cell_of[path[np.concatenate([[0], cut])]].tolist()
                visited += np.split(path, cut)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), b.column("id").take(take), b.column("v").take(take), lists(np.concatenate(visited), np.array([len(v) for v in visited]), pa.int64())], ["cell", "id", "v", "visited"])

    kind = asked.schema["v"].dataType.simpleString()
    walked = stored(asked.select("id", "v").mapInArrow(lean(walk), f"cell long, id long, v {kind}, visited array<long>"), "walked")
    ask_parts = {r[0]: -(-r[1] // BLOCK_QUERIES) for r in walked.groupBy("cell").count().collect()}  # a number for each cell
    row_parts = {cell: parts for leaf, cell, parts in where if leaf in held}
    both = [(cell, row_parts[cell], ask_parts[cell]) for cell in sorted(row_parts.keys() & ask_parts.keys())]
    parts = F.broadcast(spark.createDataFrame(both, "cell long, row_parts int, ask_parts int"))
    of_leaf = F.broadcast(spark.createDataFrame([(leaf, cell) for leaf, cell, _ in where], "leaf long, cell long"))
    row_side = placed.join(of_leaf, "leaf").join(parts, "cell").select("cell", "leaf", "ids", "v", F.pmod(F.xxhash64("v"), "row_parts").cast("int").alias("row_part"), F.explode(F.sequence(F.lit(0), F.col("ask_parts") - 1)).alias("ask_part"))
    ask_side = walked.join(parts, "cell").select("cell", "id", "v", "visited", F.pmod(F.xxhash64("id"), "ask_parts").cast("int").alias("ask_part"), F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)).alias("row_part"))
    group = ("cell", "row_part", "ask_part")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of one block of rows and one of queries, each query's k best."""
        out = {"query_id": pa.int64(), "id": pa.int64(), "score": pa.float64()}
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], t) for c, t in out.items()})
        l, r = left.combine_chunks(), right.combine_chunks()
        got = best_of(vectors(l.column("v").chunk(0)), l.column("leaf").to_numpy(), l.column("ids").chunk(0), vectors(r.column("v").chunk(0)), r.column("id").to_numpy(), [np.asarray(x.values) for x in r.column("visited")], k)
        return pa.table({c: pa.array(v, t) for (c, t), v in zip(out.items(), got, strict=True)})

    found = row_side.groupBy(*group).cogroup(ask_side.groupBy(*group)).applyInArrow(score, "query_id long, id long, score double")
    # an id with two vectors may be found twice; equal scores have one rank, and the repeats go
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.dense_rank().over(top)).where(F.col("rank") <= k).distinct().select("query_id", "rank", F.col("id").alias(id), "score")
