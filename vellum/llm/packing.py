"""Filling containers of fixed capacity with documents, neighbours along a space-filling curve together.

Each document's words are hashed to vectors, summed and projected to three dimensions; the Hilbert key of that
point orders the documents, a range partitioning sorts them along the curve, and each partition packs its stretch:
windows of neighbours are placed, largest first, into the fullest open container that still has room.

Defined results: documents without tokens are left out; an item above the capacity is cut into full containers and a
rest that is packed like any item; no other item is split. Each container is as full as its stretch allows; only
the last ones of a partition can stay open. Ties of size and key go by document id.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .textkit import LETTER, TextBatch, mix

DIMS, GRID = 3, 10
#: Documents that are placed together, largest first.
WINDOW = 4096
#: Containers that are kept open for later windows.
OPEN = 512


def hilbert(points: np.ndarray, bits: int = GRID) -> np.ndarray:
    """Position along the Hilbert curve of integer points (one row each) in a grid of 2^bits per dimension.

    Goes through the bits from the highest down: reflects and exchanges axes so that the rest of the curve has its
    standard orientation, turns the result from Gray code to binary, and interleaves the bits.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << np.arange(bits - 1, 0, -1)).tolist():
        low = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(hit, x[i], x[i] ^ swap) if i else x[0]
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << np.arange(bits - 1, 0, -1)).tolist():
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: list[str | None]) -> np.ndarray:
    b = TextBatch(texts)
    ws, we = b.runs(LETTER)
    row, h = b.rows_of(ws), mix(b.hashes(ws, we))
    n = np.bincount(row, minlength=b.size)
    points = np.zeros((b.size, DIMS), np.int64)
    for d in range(DIMS):
        value = ((h >> np.uint64(21 * d)) & np.uint64((1 << 21) - 1)).astype(np.float64) / (1 << 20) - 1  # of variance 1/3
        z = np.bincount(row, weights=value, minlength=b.size) / np.sqrt(np.maximum(n, 1) / 3)
        points[:, d] = np.clip((z / 8 + 0.5) * (1 << GRID), 0, (1 << GRID) - 1).astype(np.int64)
    return hilbert(points)


def _measured(df: DataFrame, key: str, text_col: str, path: str) -> DataFrame:
    """(doc, size, curve) of every document with tokens."""
    vocabulary = tokens._broadcast(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .textkit import pieces

        bpe = tokens.shared(vocabulary)
        for batch in batches:
            for part in pieces(batch, "t"):
                texts = part.column("t").to_pylist()
                size = np.array([len(x) for x in bpe.encode_batch(texts)], np.int64)
                some = pa.array(size > 0)
                yield pa.RecordBatch.from_arrays([part.column("doc").filter(some), pa.array(size).filter(some), pa.array(curve_keys(texts)).filter(some)], names=["doc", "size", "curve"])

    return df.select(F.col(key).cast("long").alias("doc"), F.col(text_col).alias("t")).where("doc is not null").mapInArrow(run, "doc long, size long, curve long")


class Packer:
    """Containers of one partition; ``place`` puts items into the fullest open container with room."""

    def __init__(self, capacity: int, first: int, keep: int = OPEN):
        self.capacity, self.next, self.keep = capacity, first, keep
        self.open: list[tuple[int, int]] = []  # (free, container), sorted

    def place(self, size: int) -> int:
        i = bisect_left(self.open, (size, -1))
        if i < len(self.open):
            free, container = self.open.pop(i)
        else:
            free, container = self.capacity, self.next
            self.next += 1
        if free > size:
            insort(self.open, (free - size, container))
        return container

    def settle(self) -> None:
        """Closes the fullest containers beyond those that are kept."""
        if len(self.open) > self.keep:
            del self.open[: len(self.open) - self.keep]


def packed(df: DataFrame, key: str = "doc_id", text_col: str = "text", capacity: int = 2048, path: str = tokens.VOCABULARY, rows_per_range: int = 50_000) -> DataFrame:
    """(key, piece, start, n_tokens, container): where each document, or piece of one above the capacity, went."""
    from ..plans.durable import cut

    measured = cut(_measured(df, key, text_col, path).dropDuplicates(["doc"]))
    ranges = max(1, -(-measured.count() // rows_per_range))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Packer(capacity, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for begin in range(0, batch.num_rows, WINDOW):
                part = batch.slice(begin, WINDOW)
                doc, size = (np.asarray(part.column(c)) for c in ("doc", "size"))
                parts = -(-size // capacity)
                owner = np.repeat(np.arange(len(doc)), parts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
                length = np.minimum(capacity, size[owner] - piece * capacity)
                container = np.zeros(len(owner), np.int64)
                for i in np.lexsort((piece, doc[owner], -length)).tolist():
                    container[i] = p.place(int(length[i]))
                p.settle()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[owner], piece.astype(np.int32), piece * capacity, length, container)], names=[key, "piece", "start", "n_tokens", "container"])

    ordered = measured.repartitionByRange(ranges, "curve", "doc").sortWithinPartitions("curve", "doc")
    return ordered.mapInArrow(run, f"`{key}` long, piece int, start long, n_tokens long, container long")
