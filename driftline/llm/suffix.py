"""Suffix-array dedup (operator 5): passages of ``length`` bytes that occur twice anywhere are removed.

1. Blocks.  Every window of ``length`` bytes has a first smallest 32-byte gram by hash; windows
   that follow each other with that gram at the same place make a block.  Equal windows have
   equal grams at equal distances, so only blocks under the same gram can hold equal
   windows, and no block holds two.
2. Copies of a block are collapsed: within a map task at once, then under each gram.  All windows
   of a block with a copy repeat.  A gram with a single block is done with.  Copies are blocks
   whose BLAKE2b digests of 128 bits are equal; that two different ones among n blocks share a digest has
   a probability below n * n / 2**129, under one in 10**13 for the blocks of 100 TB.
   Grams that a sample shows to be very frequent are collapsed in parts by digest, so copies still meet.
3. Blocks under a gram with other blocks go to shards, whole grams together.  A gram with more
   blocks than two shards hold is dealt further: equal windows have the same smallest other gram as well,
   so its blocks are cut where that changes and dealt by both.  A shard's
   suffixes are sorted by Larsson-Sadakane refinement (only unsorted groups are sorted again,
   by the ranks of what follows), as far as ``length`` bytes, and common prefixes of neighbours
   are taken by Kasai's argument: where the next suffix's neighbour is the next position, one
   more byte decides.
4. A key with more blocks than a shard holds spans shards; their sorted suffixes are merged by
   binary search, byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.textblocks import lean, lists, mix, stored, text_blocks

LENGTH = 200
GRAM = 32
#: Bytes of text looked at together, and bytes of blocks in a shard.
PIECE_BYTES = 1 << 19
#: Bits of a place in a piece.
PLACE_BITS = 20
SHARD_BYTES = 1 << 19
#: Rows under one gram held while its blocks are collapsed; beyond, they count as different blocks.
HELD_ROWS = 200_000
#: Different blocks under one gram, beyond which it is dealt by its windows' second gram too.
HOT_BLOCKS = 4096
#: Grams known to be frequent, found in a sample of one document in so many; the rows of each are dealt in parts.
#: A gram that is not among them has at most one row in HOT_GRAMS, about.
HOT_GRAMS, HOT_SAMPLE, HOT_PARTS = 1024, 64, 64
_K = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes at each place that has so many."""
    n = len(buf) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    t = np.ndarray((len(buf) - 7,), "<u8", np.ascontiguousarray(buf), strides=(1,)) * _K[0]
    t ^= t >> np.uint64(29)
    g = t[:n] * _K[1]
    for k in (1, 2, 3):
        g += t[8 * k : 8 * k + n] * _K[k + 1]
        g ^= g >> np.uint64(31)
    g *= _K[2]
    g ^= g >> np.uint64(32)
    return g


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b for each span, as two numbers."""
    raw = memoryview(np.ascontiguousarray(buf))
    return np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), "<u8").reshape(-1, 2)


def blocks(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(gram, digest as two columns, row, start in row, windows) of all blocks of the rows."""
    out: list[tuple[np.ndarray, ...]] = []
    low = 0
    while low < len(buf):  # pieces overlap by length - 1 bytes, so that each window lies whole in one
        piece = buf[low : low + PIECE_BYTES + length - 1]
        n = min(PIECE_BYTES, len(piece) - length + 1)
        if n > 0:
            grams = gram_hashes(piece)
            place = np.uint64((1 << PLACE_BITS) - 1)
            # the hash above, the place below: of equal hashes the first is least
            least = sliding_least(grams & ~place | np.arange(len(grams), dtype=np.uint64), length - GRAM + 1)[:n]
            first = np.searchsorted(offsets, low, "right") - 1
            last = np.searchsorted(offsets, low + len(piece), "left")
            bounds = offsets[first : last + 1] - low
            whole = np.zeros(n + 1, np.int8)  # +1 where windows of a row begin, -1 where they end
            a, b = np.clip(bounds[:-1], 0, n), np.clip(bounds[1:] - length + 1, 0, n)
            some = b > a
            np.add.at(whole, a[some], 1)
            np.add.at(whole, b[some], -1)
            whole = np.cumsum(whole[:n]).astype(bool)
            new = np.ones(n, bool)
            new[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
            new[a[some]] = True
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, n))
            ok = whole[start]
            start, size = start[ok], size[ok]
            row = np.searchsorted(offsets, start + low, "right") - 1
            out.append((grams[least[start] & place], digests(piece, start, start + size + length - 1), row, start + low - offsets[row], size))
        low += PIECE_BYTES
    if not out:
        return tuple(np.zeros(k, t) for k, t in ((0, np.uint64), ((0, 2), np.uint64), (0, np.int64), (0, np.int64), (0, np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _block_rows(length: int, frequent: dict[int, bool] | None = None):
    """Rows of blocks; those of ``frequent`` grams have a part from 1, or, if they are said to have very many different blocks, from HOT_PARTS + 1; the others 0."""
    known_grams = np.array(sorted(frequent or ()), np.int64)
    first_part = np.array([1 + HOT_PARTS * (frequent or {})[g] for g in known_grams.tolist()], np.int32)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = []
            for at, buf, offsets, _ in text_blocks(batch.column(1), PIECE_BYTES):
                g, d, row, start, size = blocks(buf, offsets, length)
                found.append((g, d, row + at, start, size))
            if not found:
                continue
            g, d, row, start, size = (np.concatenate(x) for x in zip(*found, strict=True))
            # copies within the batch: all of them repeat, and one stands for them
            order = np.lexsort((d[:, 1], d[:, 0], g))
            gs, ds, ss = g[order], d[order], size[order]
            new = np.ones(len(order), bool)
            new[1:] = (gs[1:] != gs[:-1]) | (ds[1:] != ds[:-1]).any(1) | (ss[1:] != ss[:-1])
            many = np.diff(np.append(np.flatnonzero(new), len(order)))
            weight = np.zeros(len(order), np.int8)
            weight[np.flatnonzero(new)] = np.minimum(many, 2)
            done = order[np.repeat(many, many) > 1]
            lead = order[new]
            # runs of settled blocks in a row become one; they have weight 0 and are dealt by place
            done = done[np.lexsort((start[done], row[done]))]
            head = np.ones(len(done), bool)
            head[1:] = (row[done[1:]] != row[done[:-1]]) | (start[done[1:]] > start[done[:-1]] + size[done[:-1]])
            head = np.flatnonzero(head)
            whole = size.copy()
            if len(done):
                last = done[np.append(head[1:], len(done)) - 1]
                done = done[head]
                whole[done] = start[last] + size[last] - start[done]
            pick = np.concatenate([lead, done])
            w = np.concatenate([weight[new], np.zeros(len(done), np.int8)])
            length_of = np.concatenate([size[lead], whole[done]])
            gram = g.view(np.int64)[pick]
            gram[len(lead) :] = mix((row[done] << 20 ^ start[done]).astype(np.uint64)).view(np.int64)
            part = np.zeros(len(pick), np.int32)
            if len(known_grams):
                at = np.minimum(np.searchsorted(known_grams, gram[: len(lead)]), len(known_grams) - 1)
                known = np.flatnonzero(known_grams[at] == gram[: len(lead)])
                part[known] = first_part[at[known]] + (d[lead[known], 0] % np.uint64(HOT_PARTS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(part), *(pa.array(d[pick, k].view(np.int64)) for k in (0, 1)), batch.column(0).take(pa.array(row[pick])), pa.array(np.asarray(batch.column(2))[row[pick]]), pa.array(start[pick]), pa.array(length_of.astype(np.int32)), pa.array(w)], ["gram", "part", "digest", "more", "id", "version", "start", "windows", "weight"])

    return run


def _collapse(batches: Iterator[pa.RecordBatch]):
    """Rows sorted by gram, part, digest, windows: settled runs, and blocks that other blocks must be compared with (``hot``: of a gram with very many)."""
    names = ["gram", "id", "version", "start", "windows", "weight", "settled", "hot"]

    def out(t: pa.Table, take: np.ndarray, weight: np.ndarray, settled: bool, hot: np.ndarray | None = None):
        t = t.take(pa.array(take))
        n = len(take)
        return pa.RecordBatch.from_arrays([*(t.column(k).combine_chunks() for k in names[:5]), pa.array(weight.astype(np.int8)), pa.array(np.full(n, settled)), pa.array(np.zeros(n, bool) if hot is None else hot)], names)

    def solve(t: pa.Table, forced: set[int]):
        """``t`` has whole grams but those in parts or ``forced``, whose blocks all count as different from those elsewhere."""
        g, part, d, e, s, w = (t.column(k).to_numpy() for k in ("gram", "part", "digest", "more", "windows", "weight"))
        free = np.flatnonzero(w == 0)
        if len(free):
            yield out(t, free, w[free], True)
        own = np.flatnonzero(w > 0)
        if not len(own):
            return
        g, part, d, e, s, w = g[own], part[own], d[own], e[own], s[own], w[own].astype(np.int64)
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (e[1:] != e[:-1]) | (s[1:] != s[:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(w, first)
        many = np.diff(np.append(first, len(g)))
        # weight 2 was settled where it was found, as were all rows of such a run
        known = np.repeat(total, many) > 1
        settle = known & (w == 1)
        if settle.any():
            yield out(t, own[settle], w[settle], True)
        gf = g[first]
        begin = np.flatnonzero(np.concatenate([[True], gf[1:] != gf[:-1]]))
        kinds = np.diff(np.append(begin, len(gf)))  # different blocks of each gram
        torn, in_part = np.isin(gf[begin], list(forced)), part[first][begin]
        very = np.where(in_part > 0, in_part > HOT_PARTS, (kinds > HOT_BLOCKS) | torn)  # the same for all parts of a gram
        mixed, hot = np.repeat((kinds > 1) | torn | (in_part > 0), kinds), np.repeat(very, kinds)
        if mixed.any():
            yield out(t, own[first[mixed]], np.minimum(total[mixed], 2), False, hot[mixed])

    held: pa.Table | None = None
    forced: set[int] = set()  # the grams of which a part is done; the last one at most goes on
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        g = t.column("gram").to_numpy()
        cut = int(np.searchsorted(g, g[-1], "left")) if len(g) else 0
        if len(g) - cut > HELD_ROWS:
            forced.add(int(g[-1]))
            cut = len(g)
        if cut:
            yield from solve(t.slice(0, cut), forced)
            forced &= {int(g[-1])}
        held = t.slice(cut)
    if held is not None and len(held):
        yield from solve(held, forced)


def window_ranks(buf: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane refinement of the suffixes of several texts, as far as ``length`` bytes.

    ``buf`` holds texts that end at ``ends``; ``starts`` are the places that have ``length`` bytes.
    Returns the order of ``starts`` and flags: equal to the one before in all ``length`` bytes.
    """
    n = len(buf)
    room = (np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(n)).astype(np.int32)  # bytes to the text's end
    depth = 8
    place = np.flatnonzero(room >= depth)
    key = np.ndarray((n - 7,), ">u8", np.ascontiguousarray(buf), strides=(1,))[place].astype(np.uint64)
    rank = np.full(n, -1, np.int32)
    order = np.argsort(key)
    place, key = place[order], key[order]
    index = np.arange(len(place), dtype=np.int32)

    def regroup(place, key, index):
        new = np.ones(len(place), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, index, 0))
        rank[place] = first
        return first, ~(new & np.append(new[1:], True))

    first, open_ = regroup(place, key, index)
    while depth < length:
        step = min(depth, length - depth)
        stay = open_ & (room[place] >= depth + step)
        place, first = place[stay], first[stay]
        if not len(place):
            break
        follow = rank[place + step].astype(np.uint64)
        key = first.astype(np.uint64) << np.uint64(32) | follow
        order = np.argsort(key)
        place, key, first = place[order], key[order], first[order]
        # within a group, the i-th has the group's first number plus i
        new = np.ones(len(place), bool)
        new[1:] = first[1:] != first[:-1]
        at = np.arange(len(place), dtype=np.int32)
        index = first + at - np.maximum.accumulate(np.where(new, at, 0))
        first, open_ = regroup(place, key, index)
        depth += step
    order = np.argsort(rank[starts], kind="stable")
    ranks = rank[starts][order]
    same = np.zeros(len(starts), bool)
    same[1:] = ranks[1:] == ranks[:-1]
    return order, same


def common_prefixes(buf: np.ndarray, place: np.ndarray, before: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the suffixes at ``place`` (ascending) and ``before`` share ``length`` bytes.

    Kasai: where both go on by one from the pair before, only the last byte is new.
    """
    goes_on = np.zeros(len(place), bool)
    goes_on[1:] = (place[1:] == place[:-1] + 1) & (before[1:] == before[:-1] + 1)
    good = buf[place + length - 1] == buf[before + length - 1]
    head = np.flatnonzero(~goes_on)
    full = np.ones(len(head), bool)
    for at in range(0, length, 64):
        w = min(64, length - at)
        span = np.arange(at, at + w)
        full &= (buf[place[head, None] + span] == buf[before[head, None] + span]).all(1)
    good[head] = full
    # a pair is equal if its head is and no byte since differed
    run = np.cumsum(~goes_on) - 1
    bad = np.concatenate([[0], np.cumsum(~good)])
    return (bad[1:] - bad[head][run]) == 0


def repeated_windows(payloads: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(buffer, starts, payload of each start, window of it, repeated flags, sorted different windows) of a shard."""
    buf = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.array([len(p) for p in payloads], np.int64)
    ends = np.cumsum(sizes)
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(payloads)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = (ends - sizes)[owner] + inner
    order, same = window_ranks(buf, ends, starts, length)
    twin = np.flatnonzero(same)
    flags = np.zeros(len(starts), bool)
    if len(twin):
        place, before = starts[order[twin]], starts[order[twin - 1]]
        by_text = np.argsort(place)
        sure = np.zeros(len(twin), bool)
        sure[by_text] = common_prefixes(buf, place[by_text], before[by_text], length)
        flags[order[twin[sure]]] = True
        flags[order[twin[sure] - 1]] = True
    return buf, starts, owner, inner, flags, order[~same]


class _Spanning:
    """Windows of one key over several shards: sorted suffixes, merged by binary search.

    A shard is kept as its bytes and the places of its different windows in order.
    """

    def __init__(self, length: int):
        self.length = length
        self.shards: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple]]] = []

    def suffixes(self, buf: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The windows at ``places`` as byte strings that compare whole; a last byte keeps zero bytes from being stripped."""
        table = np.ones((len(places), self.length + 1), np.uint8)
        table[:, :-1] = np.lib.stride_tricks.sliding_window_view(buf, self.length)[places]
        return table.reshape(-1).view(f"S{self.length + 1}")

    def add(self, buf: np.ndarray, starts: np.ndarray, owner: np.ndarray, inner: np.ndarray, order: np.ndarray, blocks: list[tuple], flags: np.ndarray) -> list[tuple]:
        """Flags windows with matches in earlier shards; returns (block, window) of earlier windows that repeat."""
        late: list[tuple] = []
        for their_buf, places, their_owner, their_inner, their_blocks in self.shards:
            theirs = self.suffixes(their_buf, places)
            for low in range(0, len(order), 1 << 15):
                part = order[low : low + (1 << 15)]
                mine = self.suffixes(buf, starts[part])
                at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
                hit = theirs[at] == mine
                flags[part[hit]] = True
                late += [(their_blocks[their_owner[i]], int(their_inner[i])) for i in at[hit].tolist()]
        # one place for each window: its twins in the same shard are flagged already
        self.shards.append((buf, starts[order].astype(np.int32), owner[order].astype(np.int32), inner[order].astype(np.int32), blocks))
        return late


def second_cuts(raw: bytes, windows: int, gram: int, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(first window, windows, key): a block cut where the smallest gram besides ``gram`` changes its place; equal windows get equal keys."""
    grams = gram_hashes(np.frombuffer(raw, np.uint8))
    own = np.uint64(gram & (1 << 64) - 1)
    place = np.uint64((1 << PLACE_BITS) - 1)
    top = np.iinfo(np.uint64).max
    # the place in the low bits, so that of equal hashes the first is least; blocks are shorter than 2**PLACE_BITS
    least = sliding_least(np.where(grams == own, top, grams & ~place | np.arange(len(grams), dtype=np.uint64)), length - GRAM + 1)[:windows]
    none = least == top
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    other = np.where(none[first], np.uint64(0), grams[np.where(none[first], 0, least[first] & place)])
    key = mix(other ^ mix(np.array([own]), 51), 52).view(np.int64)
    return list(zip(first.tolist(), np.diff(np.append(first, windows)).tolist(), key.tolist(), strict=True))


def _shards(length: int):
    names = ["id", "version", "start", "stop"]

    def spans(rows: list[tuple], flags: np.ndarray, owner: np.ndarray, inner: np.ndarray, late: list):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
        out: list[tuple] = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            while a < b:  # a run of starts may go on into the next payload
                k = owner[a]
                z = min(b, a + int(np.searchsorted(owner[a:b], k, "right")))
                if rows[k][5] == 1:
                    out.append((rows[k][1], rows[k][2], rows[k][3] + int(inner[a]), rows[k][3] + int(inner[z - 1]) + length))
                a = z
        out += [(r[1], r[2], r[3] + i, r[3] + i + length) for r, i in late if r[5] == 1]
        return out

    def run(batches: Iterator[pa.RecordBatch]):
        rows: list[tuple] = []
        held, spanning, gram = 0, None, None

        def flush(goes_on: bool):
            nonlocal rows, held, spanning
            buf, starts, owner, inner, flags, order = repeated_windows([r[6] for r in rows], length)
            late: list = []
            if goes_on or spanning is not None:
                mine = np.array([r[0] == gram for r in rows])
                spanning = spanning or _Spanning(length)
                late = spanning.add(buf, starts, owner, inner, order[mine[owner[order]]], [r[:6] for r in rows], flags)
                if not goes_on:
                    spanning = None
            got = spans(rows, flags, owner, inner, late)
            rows, held = [], 0
            return got

        kind = None

        def batch_of(got):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in got], kind), *(pa.array([r[k] for r in got], pa.int64()) for k in (1, 2, 3))], names)

        for batch in batches:
            kind = batch.schema.field("id").type
            for row in zip(*(batch.column(k).to_pylist() for k in ("gram", "id", "version", "start", "windows", "weight", "payload")), strict=True):
                if held >= SHARD_BYTES and row[0] != gram or spanning is not None and row[0] != gram:
                    if rows:
                        yield batch_of(flush(False))
                    spanning = None
                elif held >= 2 * SHARD_BYTES:
                    yield batch_of(flush(True))
                gram = row[0]
                rows.append(row)
                held += len(row[6])
        if rows:
            yield batch_of(flush(False))

    return run


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, version, start, stop): byte runs of each text whose windows of ``length`` bytes all repeat; runs may overlap."""
    kind = docs.select(F.col(f"`{id}`")).schema[0].dataType.simpleString()
    own = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    texts = own.where(F.octet_length("text") >= length).select("id", "text", "version")
    rows = f"gram long, part int, digest long, more long, id {kind}, version long, start long, windows int, weight byte"
    seen = texts.where(F.pmod(F.xxhash64("id"), F.lit(HOT_SAMPLE)) == 0).mapInArrow(lean(_block_rows(length)), rows).where("weight > 0").groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("digest").alias("kinds"))
    frequent = {r["gram"]: r["kinds"] * HOT_SAMPLE > HOT_BLOCKS for r in seen.where("n > 8").orderBy(F.desc("n"), "gram").limit(HOT_GRAMS).collect()}
    found = texts.mapInArrow(lean(_block_rows(length, frequent)), rows)
    collapsed = stored(found.repartition("gram", "part").sortWithinPartitions("gram", "part", "digest", "more", "windows").mapInArrow(lean(_collapse), f"gram long, id {kind}, version long, start long, windows int, weight byte, settled boolean, hot boolean"), "blocks", small=True)
    settled = collapsed.where("settled").select("id", "version", "start", (F.col("start") + F.col("windows") + (length - 1)).alias("stop"))
    wanted = collapsed.where("not settled").groupBy("id", "version").agg(F.collect_list(F.struct("gram", "start", "windows", "weight", "hot")).alias("wanted"))

    def payloads(batches: Iterator[pa.RecordBatch]):
        names = ["gram", "id", "version", "start", "windows", "weight", "payload"]
        for batch in batches:
            parts: list[list[pa.Array]] = [[] for _ in names]
            held = 0
            for i in range(batch.num_rows):
                raw, want = batch.column("text")[i].as_buffer(), batch.column("wanted")[i].values
                found: list[tuple] = []
                for gram, low, size, weight, hot in zip(*(c.to_pylist() for c in want.flatten()), strict=True):
                    blob = raw[low : low + size + length - 1].to_pybytes()
                    if hot:
                        found += [(key, low + at, n, weight, blob[at : at + n + length - 1]) for at, n, key in second_cuts(blob, size, gram, length)]
                    else:
                        found.append((gram, low, size, weight, blob))
                grams, low, size, weight, blobs = zip(*found, strict=True)
                row = pa.array(np.full(len(low), i))
                for part, x in zip(parts, [pa.array(grams, pa.int64()), batch.column("id").take(row), batch.column("version").take(row), pa.array(low, pa.int64()), pa.array(size, pa.int32()), pa.array(weight, pa.int8()), pa.array(blobs, pa.binary())], strict=True):
                    part.append(x)
                held += sum(map(len, blobs))
                if held >= SHARD_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in parts], names)
                    parts, held = [[] for _ in names], 0

    # rows that repeat id and text are one here: what they would be cut from is the same
    asked = own.join(wanted.withColumnsRenamed({"id": "_id", "version": "_version"}), F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")))
    blocks_of = asked.select("id", "version", "text", "wanted").mapInArrow(lean(payloads), f"gram long, id {kind}, version long, start long, windows int, weight byte, payload binary")
    compared = blocks_of.repartition("gram").sortWithinPartitions("gram").mapInArrow(lean(_shards(length)), f"id {kind}, version long, start long, stop long")
    return settled.unionByName(compared)


def merged(starts: list[int], stops: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending runs that neither overlap nor touch."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.asarray(starts, np.int64), np.asarray(stops, np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, keep: tuple[str, ...] = (), with_bytes: bool = True, with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans, the columns in ``keep``, ``kept`` (bytes), and with ``with_text`` ``kept_text``, without characters that were cut in part.

    Every byte covered by a ``length``-byte string that also starts elsewhere, in the same text
    or another, goes.  ``spans`` are the maximal removed runs (start, stop).  Null or shorter texts
    lose nothing.  Rows are documents: a repeated row repeats all its text.  Null ids are ids.
    """
    kind = docs.select(F.col(f"`{id}`")).schema[0].dataType.simpleString()
    spans = repeated_spans(docs, id, text, length).groupBy("id", "version").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumnsRenamed({"id": "_id", "version": "_version"})
    own = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]).withColumn("version", F.xxhash64("text"))
    more = "".join(f", k{i} {own.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n, gone, many, digest, raw_kept, a_all, b_all = [], [], [], [], [], [], []
            for value, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = value.as_buffer()
                pair = found.values.flatten() if found.is_valid else ([], [])
                a, b = merged(np.asarray(pair[0]), np.asarray(pair[1]))
                rest = b"".join(raw[x:y].to_pybytes() for x, y in zip([0, *b.tolist()], [*a.tolist(), raw.size], strict=True)) if len(a) else raw.to_pybytes()
                n.append(raw.size)
                gone.append(raw.size - len(rest))
                many.append(len(a))
                digest.append(hashlib.sha256(rest).hexdigest())
                a_all.append(a)
                b_all.append(b)
                if with_bytes or with_text:
                    raw_kept.append(rest)
            flat = lambda x: np.concatenate([*x, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (n, gone, many)), pa.array(digest, pa.string()), lists(flat(a_all), np.array(many, np.int64), pa.int64()), lists(flat(b_all), np.array(many, np.int64), pa.int64()), *(batch.column(f"k{i}") for i in range(len(keep))), *([pa.array(raw_kept, pa.binary())] if with_bytes else []), *([pa.array([r.decode("utf-8", "ignore") for r in raw_kept], pa.string())] if with_text else [])], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops", *(f"k{i}" for i in range(len(keep))), *["kept"] * with_bytes, *["kept_text"] * with_text])

    joined = own.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left").select("id", "text", "spans", *[f"k{i}" for i in range(len(keep))])
    return joined.mapInArrow(lean(cut), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, stops array<long>{more}" + ", kept binary" * with_bytes + ", kept_text string" * with_text).withColumnsRenamed({"id": id} | {f"k{i}": c for i, c in enumerate(keep)})
