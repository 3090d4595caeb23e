"""Benchmark decontamination by a generalised suffix automaton (operator 11).

Test items become sequences of word hashes, and a generalised suffix automaton of them is sent to the
executors, in parts of a bounded size.  Documents stream past it: each task keeps, for every
word, the automaton's state and the length of the longest run of words that ends there and is in
an item.  Where that length reaches a window, the state of the window's length names the items.
Stretches whose short runs are in no item can't hold a window and are not walked.

All is done in one scan without a shuffle; benchmarks beyond ``SEND_WORDS`` take a scan for each
so many words.  Words are told apart by 64-bit hashes; a wrong hit needs a collision beside as many
true words of one item as the rest of a window has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.textblocks import CODES_LOWER, lean, lists, span_hashes, stored, text_blocks, words

#: Words of an item in a window, and the share of a document's words above which it goes whole.
WINDOW, COVERAGE = 10, 0.5
#: Item words of one automaton, and of all that are sent for a scan (some 50 bytes each).
PART_WORDS, SEND_WORDS = 250_000, 2_000_000
#: Words of an item in one sequence; longer items become several that overlap.
ITEM_PIECE = 20_000
#: Words of the runs that a stretch must have at every place, and words walked in one piece, at least.
SEED, PIECE = 3, 512
SEED_BITS = 21

#: What parts words: ASCII but letters and digits.
SEPARATES = np.zeros(256, bool)
SEPARATES[:128] = [not chr(c).isalnum() for c in range(128)]


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts, ends, first word of each row, hashes) for blocks of texts; A-Z count as a-z."""
    for at, buf, offsets, _ in text_blocks(column):
        starts, ends, first = words(buf, offsets, SEPARATES)
        yield at, buf, starts, ends, first, span_hashes(buf, starts, ends, CODES_LOWER)


@dataclass
class Automaton:
    """A generalised suffix automaton as flat arrays: transitions by state * tokens + token, suffix links, longest lengths."""

    tokens: int
    keys: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, sequences: list[np.ndarray], tokens: int) -> Automaton:
        after: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def state(size: int, moves: dict[int, int], suffix: int) -> int:
            after.append(moves)
            link.append(suffix)
            length.append(size)
            return len(after) - 1

        def exact(source: int, token: int) -> int:
            """The state of ``source``'s longest run followed by ``token``; split from a longer one if need be."""
            there = after[source][token]
            if length[there] == length[source] + 1:
                return there
            split = state(length[source] + 1, dict(after[there]), link[there])
            link[there] = split
            while source >= 0 and after[source].get(token) == there:
                after[source][token] = split
                source = link[source]
            return split

        for sequence in sequences:
            last = 0
            for token in sequence.tolist():
                if token in after[last]:  # a run that an earlier sequence has
                    last = exact(last, token)
                    continue
                new, back = state(length[last] + 1, {}, 0), last
                while back >= 0 and token not in after[back]:
                    after[back][token] = new
                    back = link[back]
                if back >= 0:
                    link[new] = exact(back, token)
                last = new
        size = np.fromiter(map(len, after), np.int64, len(after))
        n = int(size.sum())
        token = np.fromiter((t for moves in after for t in moves), np.int64, n)
        target = np.fromiter((t for moves in after for t in moves.values()), np.int32, n)
        keys = np.repeat(np.arange(len(after), dtype=np.int64), size) * tokens + token
        order = np.argsort(keys)
        return cls(tokens, keys[order], target[order], np.array(link, np.int32), np.array(length, np.int32))

    def walk(self, tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, longest match) at each word of the pieces [start, end); pieces are walked side by side."""
        order = np.argsort(starts - ends, kind="stable")
        starts, sizes = starts[order], (ends - starts)[order]
        states, lengths = np.zeros(len(tokens), np.int32), np.zeros(len(tokens), np.int32)
        now, long = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -step, "left"))  # pieces longer than step
            where = starts[:active] + step
            token = tokens[where]
            todo = np.arange(active)
            while len(todo):
                key = now[todo] * self.tokens + token[todo]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[at] == key
                moved = todo[found]
                now[moved] = self.targets[at[found]]
                long[moved] += 1
                todo = todo[~found]
                todo, lost = todo[now[todo] > 0], todo[now[todo] == 0]
                long[lost] = 0
                now[todo] = self.link[now[todo]]
                long[todo] = self.length[now[todo]]
            states[where], lengths[where] = now[:active], long[:active]
        return states, lengths

    def shortened(self, states: np.ndarray, size: int) -> np.ndarray:
        """The states of the last ``size`` words, for states that match at least so many."""
        states = states.copy()
        todo = np.arange(len(states))
        while len(todo):
            todo = todo[self.length[self.link[states[todo]]] >= size]
            states[todo] = self.link[states[todo]]
        return states


@dataclass
class Part:
    """An automaton and, for each window size, its states sorted, with the items that have the window."""

    automaton: Automaton
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, sequences: list[np.ndarray], items: list[int], tokens: int, window: int) -> Part:
        automaton = Automaton.of(sequences, tokens)
        sizes = np.array([len(s) for s in sequences])
        ends = np.cumsum(sizes)
        states, _ = automaton.walk(np.concatenate(sequences), ends - sizes, ends)
        item, size = np.repeat(np.array(items), sizes), np.repeat(np.minimum(sizes, window), sizes)
        last = np.arange(len(item)) - np.repeat(ends - sizes, sizes) + 1 >= size  # a window ends here
        windows = {}
        for m in np.unique(size).tolist():
            some = last & (size == m)
            pairs = np.unique(np.stack([automaton.shortened(states[some], m), item[some]]), axis=1)
            known, at = np.unique(pairs[0], return_index=True)
            windows[m] = known, np.append(at, pairs.shape[1]), pairs[1]
        return cls(automaton, windows)


@dataclass
class Battery:
    """The items of one scan: known words, the runs of ``seed`` words, and automata in parts."""

    vocabulary: np.ndarray
    seed: int
    seeds: np.ndarray
    shortest: int
    longest: int
    parts: list[Part]
    names: list[str | None]

    @classmethod
    def of(cls, sequences: list[np.ndarray], names: list[str | None], window: int, part_words: int = PART_WORDS) -> Battery:
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *sequences]))
        shortest = min([window, *map(len, sequences)])
        seed = min(SEED, shortest)
        tokens = [np.searchsorted(vocabulary, s) for s in sequences]
        seeds = np.unique(np.concatenate([np.zeros(0, np.int64), *(packed(t, seed) for t in tokens)]))
        distinct = list(dict.fromkeys(names))
        number = {name: i for i, name in enumerate(distinct)}
        parts, low, held = [], 0, 0
        for i, t in enumerate(tokens):
            held += len(t)
            if held >= part_words or i + 1 == len(tokens):
                parts.append(Part.of(tokens[low : i + 1], [number[n] for n in names[low : i + 1]], len(vocabulary), window))
                low, held = i + 1, 0
        return cls(vocabulary, seed, seeds, shortest, max([0, *map(len, sequences)]), parts, distinct)

    def stretches(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, starts, ends): stretches of a row's words all of whose short runs are in the items, long enough for a window."""
        n = len(hashes) - self.seed + 1
        if n <= 0 or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        tokens, known = found_in(self.vocabulary, hashes)
        whole = row[self.seed - 1 :] == row[:n]
        for k in range(self.seed):
            whole &= known[k : k + n]
        at = np.flatnonzero(whole)
        at = at[found_in(self.seeds, packed(tokens, self.seed)[at])[1]]
        # seeds that follow each other within a row
        new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (row[at] != row[np.maximum(at - 1, 0)]))
        starts, ends = at[new], at[np.append(new[1:], len(at)) - 1] + self.seed if len(at) else at
        long = ends - starts >= self.shortest
        return tokens, starts[long], ends[long]

    def match(self, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hit, longest match, unique (row, item) pairs) over the words of a block."""
        hit, longest = np.zeros(len(hashes) + 1, np.int64), np.zeros(len(hashes), np.int32)
        pairs = [np.zeros((2, 0), np.int64)]
        tokens, starts, ends = self.stretches(hashes, row)
        if len(starts):
            # long stretches are cut; a piece begins with as many words of the one before as a match may have
            lead = max(self.longest - 1, 0)
            stride = max(PIECE, 3 * lead)
            count = np.maximum(1, -(-(ends - starts) // stride))
            which = np.repeat(np.arange(len(starts)), count)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            own = starts[which] + nth * stride
            low, high = np.maximum(own - lead, starts[which]), np.minimum(own + stride, ends[which])
            sizes = high - low
            flat = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())  # the word of each place
            begin = np.cumsum(sizes) - sizes
            real = flat >= np.repeat(own, sizes)
            for part in self.parts:
                states, lengths = part.automaton.walk(tokens[flat], begin, begin + sizes)
                np.maximum.at(longest, flat[real], lengths[real])
                for m, (known, offsets, items) in part.windows.items():
                    some = np.flatnonzero(real & (lengths >= m))
                    at, there = found_in(known, part.automaton.shortened(states[some], m))
                    at, last = at[there], flat[some[there]]
                    np.add.at(hit, last - m + 1, 1)
                    np.add.at(hit, last + 1, -1)
                    distinct = np.unique(np.stack([row[last], at]), axis=1)
                    many = np.diff(offsets)[distinct[1]]
                    each = np.repeat(offsets[distinct[1]] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    pairs.append(np.stack([np.repeat(distinct[0], many), items[each]]))
        return np.cumsum(hit)[:-1] > 0, longest, np.unique(np.concatenate(pairs, axis=1), axis=1)


def packed(tokens: np.ndarray, size: int) -> np.ndarray:
    """The runs of ``size`` tokens (3 at most, each below 2**21) as one number each."""
    n = max(0, len(tokens) - size + 1)
    out = np.zeros(n, np.int64)
    for k in range(size):
        out = out << SEED_BITS | tokens[k : k + n]
    return out


def found_in(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted table, whether it is there) for each value."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def batteries(items: DataFrame, id: str = "item_id", text: str = "text", window: int = WINDOW, send_words: int = SEND_WORDS, part_words: int = PART_WORDS) -> Iterator[Battery]:
    """The items in batteries of about ``send_words`` words; they pass the driver one after the other, as word hashes."""
    if not 0 < send_words <= 1 << SEED_BITS:
        raise ValueError(f"send_words must be 1 to {1 << SEED_BITS}")
    piece = max(2 * window, min(ITEM_PIECE, send_words))
    sequences: list[np.ndarray] = []
    names: list[str | None] = []
    held = 0
    for name, body in items.select(F.col(f"`{id}`").cast("string"), F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull()).toLocalIterator():
        for _, _, _, _, _, hashes in word_hashes(pa.array([body])):
            for low in range(0, max(1, len(hashes) - window + 1), piece - window + 1):
                part = hashes[low : low + piece]
                if not len(part):
                    continue
                if held and held + len(part) > send_words:
                    yield Battery.of(sequences, names, window, part_words)
                    sequences, names, held = [], [], 0
                sequences.append(part)
                names.append(name)
                held += len(part)
    yield Battery.of(sequences, names, window, part_words)


FOUND = "n_words long, longest int, starts array<int>, ends array<int>, items array<string>"


def _scan(df: DataFrame, battery: Battery, text: str, with_text: bool) -> DataFrame:
    """``df`` with what the battery finds added to the columns of FOUND that it has; the kept text in place of the text if ``with_text``."""
    shared = df.sparkSession.sparkContext.broadcast(battery)
    later = "n_words" in df.columns
    plain = [f for f in df.schema.fields if f.name not in ("n_words", "longest", "starts", "ends", "items")]
    at = [f.name for f in plain].index(text)

    def run(batches: Iterator[pa.RecordBatch]):
        battery = shared.value
        for batch in batches:
            for low, buf, starts, ends, first, hashes in word_hashes(batch.column(at)):
                rows = len(first) - 1
                part = batch.slice(low, rows)
                row = np.repeat(np.arange(rows), np.diff(first))
                hit, long, pairs = battery.match(hashes, row)
                longest = np.zeros(rows, np.int32)
                np.maximum.at(longest, row, np.where(long >= battery.shortest, long, 0))
                items: list[set[str]] = [set() for _ in range(rows)]
                for r, i in pairs.T.tolist():
                    if battery.names[i] is not None:
                        items[r].add(battery.names[i])
                if later:  # what the scans before have found
                    longest = np.maximum(longest, np.asarray(part.column("longest")))
                    for r, (a, b, names) in enumerate(zip(*(part.column(c).to_pylist() for c in ("starts", "ends", "items")), strict=True)):
                        items[r].update(names)
                        for x, y in zip(a, b, strict=True):
                            hit[first[r] + x : first[r] + y] = True
                edge = np.append(np.diff(row) != 0, True) if len(row) else np.zeros(0, bool)
                fresh = np.append(True, edge[:-1]) if len(row) else edge
                opens = np.flatnonzero(hit & (fresh | ~np.append(False, hit[:-1]))) if len(row) else np.zeros(0, np.int64)
                closes = np.flatnonzero(hit & (edge | ~np.append(hit[1:], False))) if len(row) else np.zeros(0, np.int64)
                n = np.bincount(row[opens], minlength=rows)
                columns = part.columns[: len(plain)]
                if with_text:
                    texts = columns[at].to_pylist()
                    spans = np.append(0, np.cumsum(n))
                    for r in np.flatnonzero(n).tolist():
                        raw, own = texts[r].encode(), slice(spans[r], spans[r + 1])
                        begin = offsets_of(part.column(at), r)
                        cuts = [0, *np.stack([starts[opens[own]], ends[closes[own]]], 1).ravel() - begin, len(raw)]
                        texts[r] = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)).decode()
                    columns[at] = pa.array(texts, pa.string())
                found = [pa.array(np.diff(first)), pa.array(longest), lists((opens - first[row[opens]]).astype(np.int32), n, pa.int32()), lists((closes + 1 - first[row[closes]]).astype(np.int32), n, pa.int32()), pa.array([sorted(s) for s in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, *found], [*(f.name for f in plain), "n_words", "longest", "starts", "ends", "items"])

    def offsets_of(column: pa.Array, r: int) -> int:
        """The first byte of row r within its block."""
        width = np.int64 if pa.types.is_large_string(column.type) else np.int32
        offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + r + 1]
        return int(offsets[r]) - int(offsets[0])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain)
    return df.mapInArrow(lean(run), f"{kinds}, {FOUND}")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    coverage: float = COVERAGE,
    with_text: bool = True,
    keep: tuple[str, ...] = (),
    send_words: int = SEND_WORDS,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, longest, starts, ends, items, dropped, ``text`` if ``with_text``, and ``keep``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z as a-z.  A window is ``window`` words of an item that follow each
    other, or the whole of an item that has fewer; a document's word inside any occurrence of a
    window is hit.  ``starts`` and ``ends`` are the hit spans in words, ``items`` the ids of the items with occurring
    windows, as strings in order, and ``longest`` the longest run of words that is in an item (0 below the
    shortest window).  ``text`` is what is left without the bytes of the spans; ``dropped`` marks
    documents of which more than ``coverage`` is hit.

    Null or empty text has no words (null stays null).  An item without words has no window.
    Items that share an id are one; an item without an id hits, but is not named.  No items: no
    hits.  Rows that repeat an id, or have a null one, are judged each on its own.  Texts of any
    length are taken whole, in a block of their own.  Other columns are ignored.
    """
    own = docs.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{text}`").alias("_text"), *(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)))
    out, held = own, None
    for battery in batteries(items, item_id, item_text, window, send_words, part_words):
        if held is not None:
            out = stored(_scan(out, held, "_text", False), "decontaminated")
        held = battery
    out = _scan(out, held, "_text", with_text)
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    out = out.withColumn("n_hit", n_hit)
    return out.select(
        F.col("_id").alias(id), "n_words", "n_hit", "longest", "starts", "ends", "items", (F.col("n_hit") > coverage * F.col("n_words")).alias("dropped"),
        *([F.col("_text").alias(text)] if with_text else []), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)),
    )
