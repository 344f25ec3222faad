"""Count sketches over all rows: built per task, merged by block, of a size that is bounded whatever the corpus.

A task counts in 16 bits; the finished table has one byte a counter, the logarithm of the count (``code``), so that
counters keep telling rare from frequent when many values share one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 16
MOST = 65_535


def code(count: np.ndarray) -> np.ndarray:
    """Eight steps for each doubling; small counts keep codes of their own."""
    return np.round(8 * np.log2(count.astype(np.float64) + 1)).astype(np.uint8)


def bits_for(n: float, least: int = 18, most: int = 26) -> int:
    """Bits of a table that gives n values about a counter each, within bounds."""
    return min(most, max(least, int(n).bit_length()))


def empty(bits: int) -> np.ndarray:
    return np.zeros(1 << bits, np.uint16)


def add(table: np.ndarray, at: np.ndarray) -> None:
    """Adds one at each position, saturating."""
    u, n = np.unique(at, return_counts=True)
    table[u] = np.minimum(table[u].astype(np.int64) + n, MOST).astype(np.uint16)


def blocks(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The blocks that aren't empty, compressed."""
    for i, part in enumerate(table.reshape(-1, 1 << BLOCK_BITS)):
        if part.any():
            yield i, zlib.compress(part.tobytes(), 1)


def _merge(group: pa.Table) -> pa.Table:
    total = np.zeros(1 << BLOCK_BITS, np.int64)
    for data in group.column("data"):
        total += np.frombuffer(zlib.decompress(data.as_py()), np.uint16)
    packed = zlib.compress(np.minimum(total, MOST).astype(np.uint16).tobytes(), 1)
    return pa.table({"block": group.column("block").slice(0, 1), "data": pa.array([packed], pa.binary())})


class Packed:
    """A table that is compressed wherever it is written, as a broadcast is by the driver and by every executor."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def __getstate__(self) -> bytes:
        return zlib.compress(self.table.tobytes(), 1)

    def __setstate__(self, data: bytes) -> None:
        self.table = np.frombuffer(zlib.decompress(data), np.uint8)


def merged(parts: DataFrame) -> DataFrame:
    """One row (block, data) of each block from rows (block, data); in two rounds."""
    salted = parts.select("block", "data", F.pmod(F.xxhash64("data"), F.lit(16)).alias("salt"))
    once = salted.groupBy("block", "salt").applyInArrow(_merge, "block int, data binary")
    return once.groupBy("block").applyInArrow(_merge, "block int, data binary")


def gathered(blocks: DataFrame, bits: int) -> np.ndarray:
    """The table of 2^bits codes from merged blocks; one byte a counter is held by the driver."""
    table = np.zeros(1 << bits, np.uint8)
    for row in blocks.toLocalIterator():
        table[row.block << BLOCK_BITS : (row.block + 1) << BLOCK_BITS] = code(np.frombuffer(zlib.decompress(row.data), np.uint16))
    return table


def collect(parts: DataFrame, bits: int) -> np.ndarray:
    """The table of 2^bits codes from rows (block, data)."""
    return gathered(merged(parts), bits)
