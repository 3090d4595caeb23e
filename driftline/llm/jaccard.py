"""Exact Jaccard self-join on word shingles (operator 3), universe-partition pigeonhole.

A set is looked at in its size band, and in the next if a partner can be there; two similar sets
share a band and differ there in a known number of shingles at most.  Each band has one of two
schemes, for all its sets.

Items: shingles are hashed into segments; a segment with its content is an item.  One
shingle of difference spoils one item at most, so sets that differ in d shingles share
all but d of their items, and their first d + 1 items in any common order meet.  Sets
therefore index only so many items, those of the rarest shingles first (their frequency is
estimated from a sample, which moves cost, not results).

Allocation: shingles are hashed into fewer segments, and each segment of the band gets nothing,
its exact content, or its content with its one-deletion neighbourhood, worth 0, 1 or 2.  If these add up
to more than the sets can differ in, some segment is equal, or differs in one shingle where it
has its neighbourhood.  The cheapest such allocation is found by dynamic programming over the
entries and meetings of each segment, which a sample of documents gives, and the band takes it
where it costs less than items.

Items are kept in packed buckets.  Of sets that meet, the parities of shingle counts in hashed
cells are compared first: each cell that differs is a shingle that differs, so too many rule
a pair out.  The rest are verified on their whole shingle sets: in groups of a few, all
pairs; in larger groups everyone with a pivot, the set that is in most groups and so the
likely original.  What is not connected then is compared cell by cell within its group, in
blocks, and only the closest pairs of two components are verified, more in each round, until
no pair of different components is left that might be similar.  Equal sets are one set from
the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.components import components
from driftline.llm.textblocks import CODES_LOWER, lean, mix, shingle_hashes, span_hashes, stored, text_blocks, words

SHINGLE = 5
#: Similarity as a fraction, to stay in integers.
PERCENT = 75
#: Sets of the lowest band have fewer shingles than this, differ in one at most, and are one segment of an allocation.
LOWEST = (2 * (100 + PERCENT) - 1) // (100 - PERCENT) // 2 + 1
#: Shingles known to be frequent: at most so many, found in a sample of one document in so many.
HOT_SHINGLES = 200_000
HOT_SAMPLE = 16
#: The cost model looks at one document in so many; a meeting of two sets costs as much as so many entries.
COST_SAMPLE, MEETING_COST = 64, 8
#: Entries of a bucket, about.
BUCKET = 1_000_000
#: Groups of up to so many sets are verified in all pairs at once.
SMALL_GROUP = 6
#: Members verified against one pivot in one group of rows.
PIVOT_ROWS = 500
#: Sets of a group compared in one block, and pairs of two components verified in the first round.
BLOCK_SETS, FIRST_PAIRS = 8192, 16
BYTES = 6
#: Sets to be fetched are sent to all executors if they are no more than this; else texts are shuffled.
SEND_SETS = 100_000


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The ascending shingle hashes of each row (A-Z lower-cased words); a row with fewer words has one of all of them."""
    starts, ends, first = words(buf, offsets)
    hashes = span_hashes(buf, starts, ends, CODES_LOWER)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = hashes[a:b]
        if 0 < b - a < size:
            yield shingle_hashes(own, b - a)
        else:
            yield np.unique(shingle_hashes(own, size))


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    if not len(s):
        return 0, 0
    a, b = mix(s, 11).sum(dtype=np.uint64), mix(s, 12).sum(dtype=np.uint64)
    two = mix(np.array([a, b], np.uint64) ^ np.uint64(len(s)), 13).view(np.int64)
    return int(two[0]), int(two[1])


def parities(s: np.ndarray) -> bytes:
    """A bit for each of at least 2 * len(s) cells: whether it has an odd number of shingles."""
    cells = max(64, 2 << (max(1, len(s)) - 1).bit_length())
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Shingles that differ at least; the finer sketch is folded to the cells of the other."""
    x, y, bits = int.from_bytes(a, "little"), int.from_bytes(b, "little"), 8 * min(len(a), len(b))
    wide = 8 * max(len(a), len(b))
    while wide > bits:
        wide //= 2
        if len(a) > len(b):
            x = (x ^ x >> wide) & (1 << wide) - 1
        else:
            y = (y ^ y >> wide) & (1 << wide) - 1
    return (x ^ y).bit_count()


def bands(n: int) -> tuple[tuple[int, int], ...]:
    """(band, number of items) that a set of ``n`` shingles indexes: in its own band, and in the next if a partner can be there.

    Partners have n * 4 / 3 shingles at most, so differences number (n + 4n/3) / 7 at most.
    """
    band, top = 0, LOWEST
    while n >= top:
        band, top = band + 1, top * 2
    most = n * 100 // PERCENT
    k = (n + most) * (100 - PERCENT) // (100 + PERCENT) + 1
    return ((band, k),) if most < top else ((band, k), (band + 1, k))


def segments(band: int) -> int:
    """Segments of a band: half its largest size, so that items outnumber any difference."""
    return LOWEST << band >> 1


def most_apart(band: int) -> int:
    """Shingles that two similar sets of a band differ in at most."""
    return 2 * ((LOWEST << band) - 1) * (100 - PERCENT) // (100 + PERCENT)


def allotted(band: int) -> int:
    """Segments of a band's allocation: a quarter more than neighbourhoods would need, so that some can get nothing."""
    return -(-(most_apart(band) + 1) // 2) * 5 // 4


@dataclass
class Heat:
    """Frequent shingles and how many documents of the sample have them; and the bands that have an allocation."""

    keys: np.ndarray
    counts: np.ndarray
    allocations: dict[int, np.ndarray] = field(default_factory=dict)

    def of(self, s: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.keys, s), len(self.keys) - 1)
        return np.where(self.keys[at] == s, self.counts[at], 0)


def allocate(exact: np.ndarray, around: np.ndarray, need: int) -> tuple[np.ndarray, float]:
    """The cheapest worths (0, 1, 2 for each segment, at the cost of 0, ``exact`` or ``around``) that add up to ``need``, and their cost."""
    best = np.full(need + 1, np.inf)  # by worth that is still needed
    best[0] = 0.0
    taken = np.zeros((len(exact), need + 1), np.uint8)
    for i, (one, two) in enumerate(zip(exact, around, strict=True)):
        by_one = np.concatenate([[best[0]], best[:-1]]) + one
        by_two = np.concatenate([best[:1], best[:1], best[:-2]])[: need + 1] + two
        new = np.minimum(np.minimum(best, by_one), by_two)
        taken[i] = np.where(new == best, 0, np.where(new == by_one, 1, 2))
        best = new
    worth, left = np.zeros(len(exact), np.uint8), need
    for i in range(len(exact) - 1, -1, -1):
        worth[i] = taken[i, left]
        left = max(0, left - int(worth[i]))
    return worth, float(best[need])


def segment_entries(s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exact entry of each segment of a band's allocation, the entries that lack one shingle, their segments)."""
    m = allotted(band)
    part = (mix(s, 51 + band) % np.uint64(m)).astype(np.int64)
    own = mix(s, 21)
    content = np.zeros(m, np.uint64)
    np.add.at(content, part, own)
    number = mix(np.arange(m, dtype=np.uint64), 53 + band)
    return mix(content ^ number, 22), mix(content[part] - own ^ number[part], 22), part


def allocated_entries(s: np.ndarray, band: int, worth: np.ndarray) -> np.ndarray:
    """The index entries of a set in a band with an allocation; a segment without shingles is one too."""
    exact, lacking, part = segment_entries(s, band)
    return np.concatenate([exact[worth > 0], lacking[worth[part] > 1]])


def items(s: np.ndarray, heat: np.ndarray, band: int, k: int) -> np.ndarray:
    """The first k items of a set in a band: least heat, then least hash.

    Should so few segments be filled that differences might spoil all items, the first k
    shingles are items as well; if only one of two sets does so, the other has items enough.
    """
    m = segments(band)
    where = mix(s, 31 + band) % np.uint64(m)
    order = np.argsort(where, kind="stable")
    w = where[order]
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    content = np.add.reduceat(mix(s, 32)[order], first)
    entry = mix(content ^ mix(w[first], 33 + band), 34)
    warm = np.minimum.reduceat(heat[order], first)
    if len(entry) > k:
        return entry[np.lexsort((entry, warm))[:k]]
    if len(entry) < k:
        own = mix(s, 35 + band)
        return np.concatenate([entry, own[np.lexsort((own, heat))[:k]]])
    return entry


def entries(s: np.ndarray, heat: Heat) -> np.ndarray:
    """All index entries of a set."""
    warm = heat.of(s)
    got = []
    for band, k in bands(len(s)):
        worth = heat.allocations.get(band)
        got.append(items(s, warm, band, k) if worth is None else allocated_entries(s, band, worth))
    return np.concatenate(got)


def pack_entries(keys: np.ndarray, doc: np.ndarray, refs: np.ndarray, sizes: np.ndarray) -> bytes:
    """Entries of documents in one bucket: u32 documents, refs, sizes, counts, then six bytes an entry."""
    own, count = np.unique(doc, return_counts=True)
    raw = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]
    return b"".join([np.array([len(own)], "<u4").tobytes(), refs[own].astype("<i8").tobytes(), sizes[own].astype("<u4").tobytes(), count.astype("<u4").tobytes(), raw.tobytes()])


def unpack_entries(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, refs, sizes), an element an entry."""
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    refs, sizes, count = np.frombuffer(blob, "<i8", n, 4), np.frombuffer(blob, "<u4", n, 4 + 8 * n), np.frombuffer(blob, "<u4", n, 4 + 12 * n)
    raw = np.frombuffer(blob, np.uint8, offset=4 + 16 * n).reshape(-1, BYTES)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, :BYTES] = raw
    return keys.view("<u8").ravel(), np.repeat(refs, count), np.repeat(sizes, count).astype(np.int64)


def near_enough(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sizes allow the similarity."""
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def meetings(keys: np.ndarray, refs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket: candidate pairs (ref, ref) of small groups, and members of larger ones (group, ref).

    A group is the sets that share a key, in order of size and ref; equal groups count once.
    """
    order = np.lexsort((refs, sizes, keys))
    keys, refs, sizes = keys[order], refs[order], sizes[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (refs[1:] != refs[:-1])
    keys, refs, sizes = keys[new], refs[new], sizes[new]
    # a group ends where the key changes, or where the next size suits none before
    cut = np.ones(len(keys), bool)
    cut[1:] = (keys[1:] != keys[:-1]) | ~near_enough(sizes[1:], sizes[:-1])
    first = np.flatnonzero(cut)
    count = np.diff(np.append(first, len(keys)))
    first, count = first[count > 1], count[count > 1]
    none = np.zeros(0, np.int64)
    a, b, groups, members = [none], [none], [none], [none]
    for g in range(2, SMALL_GROUP + 1):
        at = first[count == g]
        if len(at):
            i, j = np.triu_indices(g, 1)
            x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            ok = near_enough(sizes[x], sizes[y])
            a.append(refs[x[ok]])
            b.append(refs[y[ok]])
    seen: set[int] = set()
    for at, n in zip(first[count > SMALL_GROUP].tolist(), count[count > SMALL_GROUP].tolist(), strict=True):
        r = refs[at : at + n]
        gid = int(mix(r.view(np.uint64), 43).sum(dtype=np.uint64).view(np.int64))
        if gid not in seen:
            seen.add(gid)
            groups.append(np.full(n, gid))
            members.append(r)
    x, y = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    return x[new], y[new], np.concatenate(groups), np.concatenate(members)


def _own(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))


def _sets_of(batch: pa.RecordBatch, column: str, size: int) -> Iterator[np.ndarray]:
    for _, buf, offsets, _ in text_blocks(batch.column(column)):
        yield from shingle_sets(buf, offsets, size)


def sets(docs: DataFrame, size: int = SHINGLE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, ref, more, sketch): size, 128-bit hash and parities of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n, a, b, c = [], [], [], []
            for s in _sets_of(batch, "text", size):
                x, y = set_hashes(s)
                n.append(len(s))
                a.append(x)
                b.append(y)
                c.append(parities(s))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (n, a, b)), pa.array(c, pa.binary())], ["id", "n", "ref", "more", "sketch"])

    return _own(docs, id, text).mapInArrow(lean(run), "id long, n long, ref long, more long, sketch binary")


def sifted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of refs (a, b) with their sets (x, y: ids; more), ``least`` shingles that differ, and whether they may be ``close``."""
    one = classes.select(F.col("ref").alias("a"), F.col("more").alias("a_more"), F.col("rep").alias("x"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"))
    two = classes.select(F.col("ref").alias("b"), F.col("more").alias("b_more"), F.col("rep").alias("y"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch"))
    names = ["a", "b", "a_more", "b_more", "x", "y", "a_n", "b_n"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            least = np.array([least_difference(p, q) for p, q in zip(b.column("a_sketch").to_pylist(), b.column("b_sketch").to_pylist(), strict=True)], np.int64)
            total = np.asarray(b.column("a_n")) + np.asarray(b.column("b_n"))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in names), pa.array(least), pa.array(least * (100 + PERCENT) <= (100 - PERCENT) * total)], [*names, "least", "close"])

    return pairs.join(one, "a").join(two, "b").select(*names, "a_sketch", "b_sketch").mapInArrow(lean(run), ", ".join(f"{c} long" for c in names) + ", least long, close boolean")


def heat_of(docs: DataFrame, size: int = SHINGLE, id: str = "doc_id", text: str = "text") -> Heat:
    """The most frequent shingles of a sample; HOT_SHINGLES rows come to the driver at most."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for s in _sets_of(batch, "text", size):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["shingle"])

    sample = _own(docs, id, text).where(F.pmod(F.xxhash64("id"), F.lit(HOT_SAMPLE)) == 0)
    top = sample.mapInArrow(lean(run), "shingle long").groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(HOT_SHINGLES).collect()
    keys, counts = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    order = np.argsort(keys)
    return Heat(keys[order], counts[order])


def with_allocations(docs: DataFrame, heat: Heat, size: int = SHINGLE, id: str = "doc_id", text: str = "text") -> Heat:
    """``heat`` with an allocation for each band in which it costs less than items.

    Entries and meetings are those of a sample, in which equal sets are one: with all documents there are
    COST_SAMPLE times as many entries, and COST_SAMPLE squared as many meetings.  Sums by band and
    segment are what comes to the driver.
    """
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast((heat.keys, heat.counts))  # HOT_SHINGLES entries at most

    def run(batches: Iterator[pa.RecordBatch]):
        heat, names = Heat(*hot.value), ["band", "segment", "worth", "entry"]
        for batch in batches:
            for s in _sets_of(batch, "text", size):
                if not len(s):
                    continue
                warm = heat.of(s)
                for band, k in bands(len(s)):
                    exact, lacking, part = segment_entries(s, band)
                    own = items(s, warm, band, k)
                    segment = np.concatenate([np.full(len(own), -1), np.arange(len(exact)), np.arange(len(exact)), part])
                    worth = np.repeat([0, 1, 2], [len(own), len(exact), len(exact) + len(lacking)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(segment), band, np.int32)), pa.array(segment, pa.int32()), pa.array(worth, pa.int32()), pa.array(np.concatenate([own, exact, exact, lacking]).view(np.int64))], names)

    sample = _own(docs, id, text).where(F.pmod(F.xxhash64("id"), F.lit(COST_SAMPLE)) == 0).dropDuplicates(["text"])
    met = sample.mapInArrow(lean(run), "band int, segment int, worth int, entry long").groupBy("band", "segment", "worth", "entry").agg(F.count(F.lit(1)).alias("n"))
    cost = F.sum("n") * COST_SAMPLE + F.sum(F.col("n") * (F.col("n") - 1) / 2) * (MEETING_COST * COST_SAMPLE**2)
    found: dict[int, dict[tuple[int, int], float]] = {}
    for r in met.groupBy("band", "segment", "worth").agg(cost.alias("cost")).collect():
        found.setdefault(r["band"], {})[r["segment"], r["worth"]] = float(r["cost"])
    chosen = {}
    for band, costs in found.items():
        by = lambda w, costs=costs, band=band: np.array([costs.get((i, w), 0.0) for i in range(allotted(band))])
        worth, least = allocate(by(1), by(2), most_apart(band) + 1)
        if least < costs[-1, 0]:
            chosen[band] = worth
    return Heat(heat.keys, heat.counts, chosen)


def candidates(docs: DataFrame, heat: Heat, total: int, size: int = SHINGLE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, group, ref): pairs of set refs to verify, and members of the larger groups."""
    buckets = max(8, total // 2 // BUCKET)
    hot = docs.sparkSession.sparkContext.broadcast((heat.keys, heat.counts, heat.allocations))  # HOT_SHINGLES entries, and segments of bands, at most

    def index(batches: Iterator[pa.RecordBatch]):
        heat = Heat(*hot.value)
        names = ["bucket", "blob"]

        def emit(found, refs, sizes):
            keys = np.concatenate(found)
            doc = np.repeat(np.arange(len(found)), [len(x) for x in found])
            bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            keys, doc, bucket = keys[order], doc[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            last = np.append(first[1:], len(bucket))
            r, z = np.array(refs, np.int64), np.array(sizes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), pa.array([pack_entries(keys[i:j], doc[i:j], r, z) for i, j in zip(first, last, strict=True)], pa.binary())], names)

        for batch in batches:
            found, refs, sizes, held, seen = [], [], [], 0, set()
            for s in _sets_of(batch, "text", size):
                ref = set_hashes(s)[0]
                if not len(s) or ref in seen:
                    continue
                seen.add(ref)
                found.append(entries(s, heat))
                refs.append(ref)
                sizes.append(len(s))
                held += len(found[-1])
                if held > 500_000:
                    yield emit(found, refs, sizes)
                    found, refs, sizes, held = [], [], [], 0
            if found:
                yield emit(found, refs, sizes)

    def meet(batches: Iterator[pa.RecordBatch]):
        names = ["a", "b", "group", "ref"]

        def solve(blobs):
            x, y, g, r = meetings(*(np.concatenate(c) for c in zip(*map(unpack_entries, blobs), strict=True)))
            blank = lambda n: pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), blank(len(x)), blank(len(x))], names)
            yield pa.RecordBatch.from_arrays([blank(len(g)), blank(len(g)), pa.array(g), pa.array(r)], names)

        held: list[bytes] = []
        bucket = None
        for batch in batches:
            for k, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if held and k != bucket:
                    yield from solve(held)
                    held = []
                bucket = k
                held.append(blob)
        if held:
            yield from solve(held)

    packed = _own(docs, id, text).where("id is not null").mapInArrow(lean(index), "bucket long, blob binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(meet), "a long, b long, group long, ref long")


def verified(docs: DataFrame, pairs: DataFrame, size: int = SHINGLE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, x, y, shared, joint): for sifted pairs, sizes of intersection and union."""
    # sets with more partners than a group of rows holds, sent if they are few; the others have one part
    many = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PIVOT_ROWS).alias("parts")).where("parts > 1"), "many", small=True)
    dealt = pairs.join(F.broadcast(many) if many.count() <= SEND_SETS else many, "a", "left").withColumn("group", F.xxhash64("a", "a_more", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))))
    member = dealt.select(F.col("y").alias("rep"), F.col("b").alias("ref"), F.col("b_more").alias("more"), "group", F.lit(1).alias("role"))
    pivot = dealt.select(F.col("x").alias("rep"), F.col("a").alias("ref"), F.col("a_more").alias("more"), "group", F.lit(0).alias("role")).distinct()
    wanted = stored(member.unionAll(pivot).groupBy("rep").agg(F.collect_list(F.struct("ref", "more", "group", "role")).alias("wanted")), "wanted", small=True)
    if wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0] <= SEND_SETS:
        wanted = F.broadcast(wanted)  # 40 bytes each
    asked = wanted.join(_own(docs, id, text), F.col("rep") == F.col("id")).select("id", "text", "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]):
        names = ["group", "role", "id", "ref", "items"]
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for i, s, want in zip(batch.column("id").to_pylist(), _sets_of(batch, "text", size), batch.column("wanted"), strict=True):
                ref, more = set_hashes(s)
                blob = s.astype("<u8").tobytes()
                for w in want.as_py():
                    if (w["ref"], w["more"]) == (ref, more):
                        out.append((w["group"], w["role"], i, ref, blob))
                        held += len(blob)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

    def compare(batches: Iterator[pa.RecordBatch]):
        group = first = None
        for batch in batches:
            out: list[tuple] = []
            for g, role, i, ref, blob in zip(*(batch.column(k) for k in ("group", "role", "id", "ref", "items")), strict=True):
                s = np.frombuffer(blob.as_buffer(), "<u8")
                g, i, ref = g.as_py(), i.as_py(), ref.as_py()
                if g != group or role.as_py() == 0:
                    group, first = g, (ref, i, s.copy())
                    continue
                p = first[2]
                at = np.searchsorted(p, s)
                at[at == len(p)] = len(p) - 1
                shared = int((p[at] == s).sum())
                out.append((first[0], ref, first[1], i, shared, len(p) + len(s) - shared))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "x", "y", "shared", "joint"])

    sent = asked.mapInArrow(lean(fetch), "group long, role int, id long, ref long, items binary").repartition("group").sortWithinPartitions("group", "role")
    return sent.mapInArrow(lean(compare), "a long, b long, x long, y long, shared long, joint long")


def close_pairs(refs: np.ndarray, n: np.ndarray, labels: np.ndarray, sketches: list[bytes], own: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of sets with different labels that may be similar, the closest ``most`` of each two labels, and whether there are more.

    ``own`` tells two sides apart: with both present, pairs are across them only.
    """
    order = np.lexsort((refs, n))
    refs, n, labels, own = refs[order], n[order], labels[order], own[order]
    sketches = [sketches[i] for i in order.tolist()]
    across = len(np.unique(own)) > 1
    wide = np.array([len(x) for x in sketches])
    edges = np.searchsorted(n * PERCENT, 100 * n, "right")  # sizes that suit end here
    bits: dict[tuple[int, int], np.ndarray] = {}

    def folded(width: int, to: int) -> np.ndarray:
        if (width, to) not in bits:
            x = np.frombuffer(b"".join(sketches[i] for i in np.flatnonzero(wide == width).tolist()), "<u8").reshape(-1, width // 8)
            bits[width, to] = np.bitwise_xor.reduce(x.reshape(len(x), width // to, to // 8), axis=1)
        return bits[width, to]

    place = np.zeros(len(wide), np.int64)
    for width in np.unique(wide).tolist():
        place[wide == width] = np.arange(int((wide == width).sum()))
    kept: list[np.ndarray] = []
    more = False

    def reduce(rows: np.ndarray) -> np.ndarray:
        """Rows (i, j, difference): the closest of each two labels."""
        nonlocal more
        low, high = np.minimum(labels[rows[:, 0]], labels[rows[:, 1]]), np.maximum(labels[rows[:, 0]], labels[rows[:, 1]])
        rank = np.lexsort((rows[:, 1], rows[:, 0], rows[:, 2], high, low))
        low, high, rows = low[rank], high[rank], rows[rank]
        at = np.arange(len(rows))
        new = np.ones(len(rows), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        inside = at - np.maximum.accumulate(np.where(new, at, 0))
        more |= bool((inside >= most).any())
        return rows[inside < most]

    for low in range(0, len(refs), 128):
        mine = np.arange(low, min(low + 128, len(refs)))
        end = int(edges[mine].max())
        to = int(wide[mine].min())
        for width in np.unique(wide[low:end]).tolist():
            if width < to:
                continue
            theirs = low + np.flatnonzero(wide[low:end] == width)
            y = folded(width, to)[place[theirs]]
            for i in mine.tolist():
                ok = (theirs > i) & (theirs < edges[i]) & (labels[theirs] != labels[i])
                if across:
                    ok &= own[theirs] != own[i]
                which = np.flatnonzero(ok)
                if not len(which):
                    continue
                x = folded(int(wide[i]), to)[place[i]]
                apart = np.bitwise_count(y[which] ^ x).sum(1, dtype=np.int64)
                near = apart * (100 + PERCENT) <= (100 - PERCENT) * (n[i] + n[theirs[which]])
                if near.any():
                    j = theirs[which[near]]
                    kept.append(reduce(np.stack([np.full(len(j), i), j, apart[near]], 1)))
        if sum(map(len, kept)) > 200_000:
            kept = [reduce(np.concatenate(kept))]
    if not kept:
        return refs[:0], refs[:0], False
    rows = reduce(np.concatenate(kept))
    return refs[rows[:, 0]], refs[rows[:, 1]], more


def open_pairs(placed: DataFrame, most: int) -> DataFrame:
    """(a, b, more): for groups of several components, pairs of these that may be similar.

    ``placed`` has group (its pivot), ref, n, component and sketch.  A group larger than a block is dealt
    to pairs of blocks.
    """
    sizes = placed.groupBy("group").agg(F.min("component").alias("l"), F.max("component").alias("h"), F.count(F.lit(1)).alias("size")).where("l < h").select("group", F.ceil(F.col("size") / BLOCK_SETS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("ref"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = placed.join(sizes, "group").withColumn("part", part).select("*", other).select("group", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "ref", "n", "component", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]):
        held: list[tuple] = []
        cell = None

        def solve():
            part, refs, n, labels = (np.array([r[k] for r in held], np.int64) for k in (3, 4, 5, 6))
            a, b, more = close_pairs(refs, n, labels, [r[7] for r in held], part, most)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), more))], ["a", "b", "more"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("group", "i", "j", "part", "ref", "n", "component", "sketch")), strict=True):
                if row[:3] != cell:
                    if len(held) > 1:
                        yield solve()
                    held, cell = [], row[:3]
                held.append(row)
        if len(held) > 1:
            yield solve()

    return dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(lean(compare), "a long, b long, more boolean")


def shared_ids(found: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(id, rep, first): the sets of ids that have several, empty ones left out, with the first of each id; None without such ids.

    An id's least and largest hash tell whether it has several, so an id of very many rows is settled before the shuffle.
    """
    edges = [f(c).alias(f"{c}_{name}") for c in ("ref", "more", "n") for name, f in (("l", F.min), ("h", F.max))]
    several = found.where("id is not null").groupBy("id").agg(*edges).where("ref_l < ref_h or more_l < more_h or n_l < n_h").select("id")
    several = stored(several, "several", small=True)
    if not several.limit(1).count():
        return None
    own = found.join(several, "id", "left_semi").select("id", "ref", "more").distinct().join(classes.select("ref", "more", "rep"), ["ref", "more"]).select("id", "rep")
    return stored(own.join(own.groupBy("id").agg(F.min("rep").alias("first")), "id"), "shared-ids", small=True)


def similar_sets(docs: DataFrame, size: int = SHINGLE, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(sets, classes, labels, shared): set hashes of all rows, one row for each distinct set, (rep, component) of sets with links, and ``shared_ids``.

    Sets of one id are linked, whatever they hold.
    """
    found = stored(sets(docs, size, id, text), "sets")
    classes = stored(found.where("n > 0 and id is not null").groupBy("ref", "more").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes", small=True)
    total = classes.agg(F.sum("n")).first()[0] or 0
    heat = with_allocations(docs, heat_of(docs, size, id, text), size, id, text)
    met = stored(candidates(docs, heat, total, size, id, text), "meetings")
    entered = met.where("group is not null").select("group", "ref").distinct()
    # of each group the set that is in most groups is the pivot; groups with one pivot become one
    often = entered.groupBy("ref").agg(F.count(F.lit(1)).alias("groups"))
    pivots = entered.join(often, "ref").groupBy("group").agg(F.max_by("ref", F.struct("groups", "ref")).alias("pivot"))
    members = stored(entered.join(pivots, "group").select(F.col("pivot").alias("group"), "ref").distinct(), "members", small=True)
    stars = members.where("ref <> group").select(F.col("group").alias("a"), F.col("ref").alias("b"))
    pairs = met.where("a is not null").select("a", "b").unionAll(stars).distinct()
    is_link = F.col("shared") * 100 >= F.col("joint") * PERCENT
    shared = shared_ids(found, classes)
    links = None if shared is None else shared.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    seen = None
    most = FIRST_PAIRS
    while True:
        met_now = stored(sifted(pairs, classes), "sifted", small=True)
        checked = stored(verified(docs, met_now.where("close"), size, id, text), "checked", small=True)
        new = checked.where(is_link).select(F.col("x").alias("a"), F.col("y").alias("b"))
        links = new if links is None else links.unionAll(new)
        tried = met_now.select("a", "b").unionAll(met_now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = tried if seen is None else seen.unionAll(tried)
        label = stored(components(links).withColumnRenamed("id", "rep"), "labels", small=True)
        if not members.limit(1).count():
            break
        placed = members.join(classes.select("ref", "rep", "n", "sketch").join(label, "rep", "left").select("ref", "n", "sketch", F.coalesce("component", "rep").alias("component")), "ref")
        left = stored(open_pairs(placed, most), "open", small=True)
        pairs = stored(left.select("a", "b").distinct().join(seen, ["a", "b"], "left_anti"), "pairs", small=True)
        if not pairs.limit(1).count():
            if not left.where("more").limit(1).count():
                break
        most *= 16
    return found, classes, label, shared


def near_duplicates(docs: DataFrame, size: int = SHINGLE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id.

    Two documents link if their sets of ``size``-word shingles have a Jaccard similarity of
    0.75 or more; component_id is the smallest id in reach.  A text without words (or null)
    has an empty set and stays alone, with its own id.  A row with a null id links with none and
    has a null component.  Rows that repeat an id are one node with the links of
    all, and share a component.  Texts are taken whole, whatever their length; an empty table gives no rows.
    Ids are cast to long; other columns are ignored.
    """
    found, classes, label, shared = similar_sets(docs, size, id, text)
    # one row for each set: hot sets are split by adaptive execution
    of_set = classes.join(label, "rep", "left").select("ref", "more", F.coalesce("component", "rep").alias("component"))
    rows = found.join(of_set, ["ref", "more"], "left")
    if shared is not None:  # rows without words go where their id's other rows are
        of_id = shared.groupBy(F.col("id").alias("_id")).agg(F.min("first").alias("rep")).join(label, "rep", "left").select("_id", F.coalesce("component", "rep").alias("_component"))
        rows = rows.join(of_id, F.col("id") == F.col("_id"), "left").withColumn("component", F.when(F.col("n") == 0, F.col("_component")).otherwise(F.col("component")))
    return rows.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
