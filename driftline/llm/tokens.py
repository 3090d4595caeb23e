"""Token ids of whole texts with the tokenizers library, each distinct word encoded once a worker.

Holds for tokenizers that drop white space and never join words across it (checked on the
loaded file by ``word_safe``): a text's ids are then those of its words in order, so words
are hashed and looked up in numpy and only new ones go to the library.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from driftline.llm.textblocks import span_hashes, words

#: Words remembered by a worker before it forgets all and starts anew.
CACHE_WORDS = 2_000_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordEncoder:
    """Encodes blocks of texts; keeps a table from word hashes to ids."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        self.tokenizer, self.limit = tokenizer(path), limit
        if not self.word_safe():
            raise ValueError(f"{path}: its ids of words depend on the words around them")
        self.clear()

    def word_safe(self) -> bool:
        """Ids of texts with all kinds of white space are those of their words; no added token has or takes white space."""
        t = self.tokenizer
        probe = ["a b", " It's  the\tend. ", "x\n\ny", "é́ ́z 12 3", "don 't", "!? ?!", "A\x0b\x0cB\r\nC"]
        ids = lambda s: t.encode(s, add_special_tokens=False).ids
        if any(a.lstrip or a.rstrip or a.single_word or a.content.split() != [a.content] for a in t.get_added_tokens_decoder().values()):
            return False
        return all(ids(s) == [i for w in s.encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w for i in ids(w.decode())] for s in probe)

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        got = []
        for i in range(0, len(texts), 4096):
            got += [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        total = int(size.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + total] = np.fromiter((i for x in got for i in x), np.uint32, total)
        at = self.used + np.cumsum(size) - size
        self.used += total
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.size, where, size)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, row offsets into them)."""
        starts, ends, first = words(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes = span_hashes(buf, starts, ends)
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        distinct, sample = ranked[new], order[new]
        group = np.empty(len(ranked), np.int64)
        group[order] = np.cumsum(new) - 1
        if len(self.keys) > self.limit:
            self.clear()
        where = np.searchsorted(self.keys, distinct)
        missing = np.ones(len(distinct), bool)
        inside = where < len(self.keys)
        missing[inside] = self.keys[where[inside]] != distinct[inside]
        if missing.any():
            raw = buf.tobytes()
            self._learn(distinct[missing], [raw[a:b].decode() for a, b in zip(starts[sample[missing]].tolist(), ends[sample[missing]].tolist(), strict=True)])
            where = np.searchsorted(self.keys, distinct)
        at, size = (x[where][group].astype(np.int64) for x in (self.at, self.size))
        ends_at = np.cumsum(size)
        total = int(ends_at[-1])
        # flat gather: each word's ids are a run in self.ids
        step = np.ones(total, np.int64)
        some = np.flatnonzero(size)
        begin = (ends_at - size)[some]
        step[begin[0]] = at[some[0]]
        step[begin[1:]] = at[some[1:]] - (at[some[:-1]] + size[some[:-1]] - 1)
        ids = self.ids[np.cumsum(step)] if total else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], ends_at])[first]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
