"""Cutting oversized texts at natural boundaries, with overlap.

A hierarchy of separators, coarse to fine: section and paragraph ends (blank lines), sentence ends, words, and
single characters for "words" above ``max_word_chars``. Each piece takes as many words as fit and backs up to the
last boundary of the coarsest level found within the limit; from the second piece on it repeats the last
``overlap`` words before its new text, which count towards the limit.

Defined results: a null, blank or fitting text has no pieces unless ``keep_small``; then a fitting text with
words is one piece. Offsets count characters from 0, ends are exclusive; pieces start and end with a word.
The whole text is scanned once with NumPy, the cuts are made per piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import UPPER, TextBatch, pieces

# Abbreviations whose dot ends no sentence.
ABBREVIATIONS = (
    "e.g. i.e. cf. approx. fig. figs. sec. sect. no. nos. rev. ref. refs. ch. chap. app. eq. vol. pp. p. vs. etc. resp. incl. excl. "
    "max. min. dept. inc. ltd. co. dr. mr. mrs. ms. prof. st. jr. sr. al. ed. eds. ca. tab. art. par. "
    "bzw. z.b. d.h. u.a. ggf. evtl. nr. abb. vgl. usw. "
    "jan. feb. mar. apr. jun. jul. aug. sep. sept. oct. nov. dec."
).split()

_CLOSERS = "\"'”’»)]}"


def _cut(b: TextBatch, row: int, words: tuple[np.ndarray, np.ndarray], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces of one text as absolute (start, end) pairs."""
    starts, ends = words
    n = len(starts)
    base = b.off[row]
    text_codes = b.codes
    # feeds between word i and word i + 1
    feeds = np.concatenate([[0], np.cumsum(text_codes[base : b.off[row + 1]] == 10)])
    paragraph = np.flatnonzero(feeds[starts[1:] - base] - feeds[ends[:-1] - base] >= 2) + 1  # counts of words up to the boundary
    last = ends - 1
    closing = np.array([ord(c) for c in _CLOSERS], np.uint32)
    for _ in range(3):
        back = np.isin(text_codes[last], closing) & (last > starts)
        if not back.any():
            break
        last = np.where(back, last - 1, last)
    stop = np.isin(text_codes[last], [ord("."), ord("!"), ord("?")])
    sentence = np.flatnonzero(stop[:-1] & ((b.cls[starts[1:]] & UPPER) != 0)) + 1
    if len(sentence):
        word = lambda i: b.codes[starts[i] : last[i] + 1].tobytes().decode("utf-32-le", "replace").lower().lstrip("([{\"'“‘«")
        sentence = np.array([i for i in sentence if word(i - 1) not in _ABBREVIATIONS], np.int64)
    out, done = [], 0
    while done < n:
        first = max(0, done - overlap) if done else 0
        reach = first + limit
        if reach >= n:
            out.append((starts[first], ends[n - 1]))
            break
        for bounds in (paragraph, sentence):
            k = np.searchsorted(bounds, reach, side="right") - 1
            if k >= 0 and bounds[k] > done:
                reach = int(bounds[k])
                break
        out.append((starts[first], ends[reach - 1]))
        done = reach
    return [(int(s - base), int(e - base)) for s, e in out]


_ABBREVIATIONS = frozenset(ABBREVIATIONS)


def split_batch(texts: list[str | None], limit: int, overlap: int, keep_small: bool = False, max_word_chars: int | None = None) -> list[list[tuple[int, int]]]:
    b = TextBatch(texts)
    blank = np.isin(b.codes, [32, 9, 13, 10])
    d = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(d == -1), np.flatnonzero(d == 1)
    if max_word_chars and len(starts) and (ends - starts).max() > max_word_chars:
        parts = -(-(ends - starts) // max_word_chars)
        again = np.repeat(np.arange(len(starts)), parts)
        k = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends = starts[again] + k * max_word_chars, np.minimum(starts[again] + (k + 1) * max_word_chars, ends[again])
    at = np.searchsorted(starts, b.off)
    out = []
    for row in range(b.size):
        i, j = at[row], at[row + 1]
        if j - i > limit:
            out.append(_cut(b, row, (starts[i:j], ends[i:j]), limit, overlap))
        else:
            out.append([(int(starts[i] - b.off[row]), int(ends[j - 1] - b.off[row]))] if keep_small and j > i else [])
    return out


def split_oversized(
    df: DataFrame, key: str, text_col: str, limit: int = 256, overlap: int = 30, keep_small: bool = False, max_word_chars: int | None = None
) -> DataFrame:
    """(key, start_char, end_char) of the pieces of each text with more than ``limit`` words, once for redelivered rows."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t"):
                cuts = split_batch(part.column("t").to_pylist(), limit, overlap, keep_small, max_word_chars)
                rows = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
                flat = np.array([p for c in cuts for p in c], np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k").take(pa.array(rows)), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=[key, "start_char", "end_char"]
                )

    rows = df.select(F.col(key).alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null")
    return rows.mapInArrow(run, f"`{key}` {key_type}, start_char int, end_char int").distinct()
