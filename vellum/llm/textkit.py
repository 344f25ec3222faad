"""Vectorised text scanning over Arrow batches: one NumPy array of code points for a whole batch.

Built-in regular expressions cost some 15 ns a character and pattern in the JVM and are interpreted in
higher-order functions; the operators here need a dozen counts or all word sequences of every text, so they
scan each batch once with table lookups and prefix sums instead (about 1 ns a character and pass).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, DIGIT, BLANK, BREAK, UPPER, LOWER, STOP, CLOSE = (1 << i for i in range(8))
_PRIME = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and the lower-case code point of each code point of the basic plane."""
    cls, low = np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if 0xD800 <= i < 0xE000:
            continue
        kind = unicodedata.category(c)
        b = 0
        if kind[0] == "L":
            b |= LETTER
        elif kind[0] == "N":
            b |= DIGIT
        elif c == "\n":
            b |= BREAK
        elif c.isspace() or kind[0] == "Z":
            b |= BLANK
        if kind in ("Lu", "Lt"):
            b |= UPPER
        elif kind == "Ll":
            b |= LOWER
        if c in ".!?":
            b |= STOP
        if c in "\"'”’»)]}":
            b |= CLOSE
        cls[i] = b
        one = c.lower()
        if len(one) == 1 and ord(one) < 1 << 16:
            low[i] = ord(one)
    return cls, low


@lru_cache(64)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64."""
    base = 0xD6E8FEB86659FD93
    inv = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up, down = np.full(n, base, np.uint64), np.full(n, inv, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


class Spans:
    """Hashes of any stretches of an array of code points, by prefix sums."""

    def __init__(self, codes: np.ndarray):
        self._room = 1 << max(16, len(codes).bit_length())
        up, _ = _powers(self._room)
        self._sums = np.zeros(len(codes) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((codes.astype(np.uint64) + np.uint64(12345)) * _PRIME * up[: len(codes)], out=self._sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = _powers(self._room)
        with np.errstate(over="ignore"):
            return mix((self._sums[ends] - self._sums[starts]) * down[starts])


class TextBatch:
    """Texts as one array of code points; a line feed is put behind each, so that runs end with their text."""

    def __init__(self, texts: Iterable[str | None]):
        texts = ["" if t is None else t for t in texts]
        self.size = len(texts)
        joined = "\n".join(texts) + "\n" if texts else ""
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.off = np.zeros(self.size + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.off[1:])
        cls, low = _tables()
        wide = codes >= 1 << 16
        self.codes = codes
        small = np.where(wide, 0, codes) if wide.any() else codes
        self.cls = cls[small]
        self.low = low[small]
        if wide.any():  # letters beyond the basic plane are rare: classed one by one
            at = np.flatnonzero(wide)
            self.low[at] = codes[at]
            kinds = {int(c): {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], 0) for c in np.unique(codes[at])}
            self.cls[at] = [kinds[int(c)] for c in codes[at]]

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of the flags within each text."""
        s = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=s[1:])
        return s[self.off[1:]] - s[self.off[:-1]]

    def rows_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, starts, side="right") - 1

    def runs(self, bits: int, within: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of characters that have (or lack) any of the bits."""
        m = (self.cls & bits) != 0
        if not within:
            m = ~m
        d = np.diff(np.concatenate([[0], m.view(np.int8), [0]]))
        return np.flatnonzero(d == 1), np.flatnonzero(d == -1)

    @cached_property
    def _spans(self) -> Spans:
        return Spans(self.low)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the lower-cased stretches of text."""
        return self._spans.hashes(starts, ends)


def word_hash(words: Iterable[str]) -> np.ndarray:
    """The hashes that ``TextBatch.hashes`` gives for these words, sorted."""
    b = TextBatch(words)
    return np.sort(b.hashes(b.off[:-1], b.off[1:] - 1))


def member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def pieces(batch: pa.RecordBatch, text_col: str, chars: int = 2_000_000, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batch in slices of a bounded number of rows and characters (a longer text is a slice of its own)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0))
    begin = total = 0
    for i, n in enumerate(size):
        if i > begin and (total + n > chars or i - begin >= rows):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(size):
        yield batch.slice(begin)


def map_texts(text_col: str, f: Callable[[pa.RecordBatch, TextBatch], pa.RecordBatch | None], rows: int = 4096):
    """A function for ``mapInArrow`` that applies ``f`` to slices of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_col, rows=rows):
                out = f(part, TextBatch(part.column(text_col).to_pylist()))
                if out is not None and out.num_rows:
                    yield out

    return run
