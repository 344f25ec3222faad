"""Encoding with a public byte-level BPE vocabulary: speculate with longest matches, verify every adjacent pair.

A token sequence is the encoding of its word exactly if each pair of neighbours is the encoding of their joined
bytes: merging anything across a boundary would have shown in one of the pairs. So greedy longest matches are
proposed for all new words of a batch, the distinct adjacent pairs are checked together with NumPy on the merge
table, and only words with a failing pair are merged one by one. Words are remembered per worker.

Defined results: empty and null texts get the empty list; strings that look like special tokens are ordinary text.
The vocabulary file is read on the driver (its path is a parameter) and broadcast; it has a fixed size.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words that a worker remembers before it starts anew.
REMEMBERED = 400_000


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        n = max(ranks.values()) + 1
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        self.sound = set()
        merged: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self.merge(token, below=rank)
                if len(parts) != 2:  # never made by merging
                    continue
                self.left[rank], self.right[rank] = parts
                merged[parts[0], parts[1]] = rank
            self.sound.add(token)
        keys = np.array([a << 32 | b for a, b in merged], np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(merged.values()), np.int64)[order]
        self.longest: dict[bytes, int] = {}
        for token in self.sound:
            self.longest[token[:2]] = max(self.longest.get(token[:2], 0), len(token))
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}

    @classmethod
    def parse(cls, data: bytes) -> Bpe:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a})

    @cached_property
    def pattern(self):
        import regex

        return regex.compile(PATTERN)

    def merge(self, word: bytes, below: int | None = None) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals, with a heap over a linked list."""
        n = len(word)
        start, nxt, prev = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1))
        end = [i + 1 for i in range(n)]
        alive = [True] * n
        get = self.ranks.get
        limit = below if below is not None else 1 << 60
        heap = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n and (r := get(word[start[i] : end[j]])) is not None and r < limit:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := nxt[i]) >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], nxt[i] = stop, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return [self.ranks[word[start[i] : end[i]]] for i in range(n) if alive[i]]

    def propose(self, word: bytes) -> list[int]:
        out, i, n = [], 0, len(word)
        ranks, sound = self.ranks, self.sound
        while i < n:
            k = min(self.longest.get(word[i : i + 2], 1), n - i)
            while k > 1 and word[i : i + k] not in sound:
                k -= 1
            out.append(ranks[word[i : i + k]])
            i += k
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is the encoding of its joined bytes.

        Undoes the later of the two tokens' last merges, again and again: if at some point the facing parts could
        have merged before the merge that was undone, the boundary would not have survived.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), 1 << 40, np.int64)
        while len(at):
            x, y = a[at], b[at]
            key = x << 32 | y
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            bad = (self.keys[k] == key) & (self.values[k] < limit[at])
            ok[at[bad]] = False
            whole_x, whole_y = self.right[x] == x, self.left[y] == y  # single bytes
            split_x = np.where(whole_x, False, np.where(whole_y, True, x > y))
            going = ~bad & ~(whole_x & whole_y)
            px, py = going & split_x, going & ~split_x
            limit[at[px]], a[at[px]] = x[px], self.right[x[px]]
            # of equal ranks the leftmost merges first: a merge across the boundary goes before the one undone to its right
            limit[at[py]], b[at[py]] = y[py] + 1, self.left[y[py]]
            at = at[going]
        return ok

    def learn(self, words: set[str]) -> int:
        """Encodes new words; returns how many needed exact merging."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.pairs) > 4 * REMEMBERED:
            self.pairs.clear()
        names = list(words)
        raw = [w.encode() for w in names]
        proposed = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(names)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        keys = flat[inner] << 32 | flat[inner + 1]
        distinct, back = np.unique(keys, return_inverse=True)
        new = np.array([k for k in distinct.tolist() if k not in self.pairs], np.int64)
        self.pairs.update(zip(new.tolist(), self.compatible(new >> 32, new & 0xFFFFFFFF).tolist(), strict=True))
        good = np.array([self.pairs[k] for k in distinct.tolist()], bool)
        failing = np.zeros(len(names), bool)
        if len(inner):
            failing[owner[inner[~good[back]]]] = True
        for i, w in enumerate(names):
            self.known[w] = tuple(self.merge(raw[i])) if failing[i] else tuple(proposed[i])
        return int(failing.sum())

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = self.pattern.findall
        words = [split(t) if t else [] for t in texts]
        new = set(chain.from_iterable(words)).difference(self.known)
        if new:
            if len(self.known) > REMEMBERED:
                new = set(chain.from_iterable(words))
            self.learn(new)
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, w))) for w in words]


_MADE: dict[int, Bpe] = {}


def shared(vocabulary) -> Bpe:
    """The vocabulary's tables, made once per worker."""
    data = vocabulary.value
    key = hash(data)
    if key not in _MADE:
        _MADE[key] = Bpe.parse(data)
    return _MADE[key]


def _broadcast(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encoded(df: DataFrame, key: str, text_col: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every row's whole text."""
    vocabulary = _broadcast(df, path)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .textkit import pieces

        bpe = shared(vocabulary)
        for batch in batches:
            for part in pieces(batch, "t"):
                ids = bpe.encode_batch(part.column("t").to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    return df.select(F.col(key).alias("k"), F.col(text_col).alias("t")).mapInArrow(run, f"`{key}` {key_type}, ids array<int>")
