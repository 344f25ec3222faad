"""Recursive chunks with overlap of whole pieces, parents and children with stable ids."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
_WORD = re.compile(r"\S+")
#: Characters of a chunk by which its place in the text is looked up.
PROBE = 80

PIECE = "array<struct<content: string, start_char: int, end_char: int>>"


def _count(text: str) -> int:
    return len(text.split())


def _windows(text: str, limit: int, overlap: int) -> Iterator[str]:
    w = text.split()
    at = 0
    while True:
        yield " ".join(w[at : at + limit])
        if at + limit >= len(w):
            return
        at += limit - overlap


def _groups(text: str, limit: int, overlap: int, separators: tuple[str, ...]) -> Iterator[str]:
    """Pieces at the first separator packed up to the limit; a group that is still too large goes to the next one.

    A new group starts with the longest run of whole trailing pieces that stays within the overlap. Empty pieces
    count no words.
    """
    if _count(text) <= limit:
        yield text
        return
    if not separators or separators[0] == "":
        yield from _windows(text, limit, overlap)
        return
    sep, rest = separators[0], separators[1:]
    pieces = text.split(sep)
    sizes = [_count(p) for p in pieces]
    first, total = 0, 0  # the open group is pieces[first:i]
    bounds = []
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            bounds.append((first, i))
            tail, j = 0, i
            while j > first and tail + sizes[j - 1] <= overlap:
                j -= 1
                tail += sizes[j]
            first, total = j, tail
        total += size
    bounds.append((first, len(pieces)))
    for a, b in bounds:
        group = sep.join(pieces[a:b])
        if _count(group) > limit:
            yield from _groups(group, limit, overlap, rest)
        else:
            yield group


def chunk_text(text: str | None, limit: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[str, int, int]]:
    """(content, start, end) of the chunks of the stripped text; places are found by a forward search of each chunk's start."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    t = (text or "").strip()
    if not t:
        return []
    out, cursor = [], 0
    for c in _groups(t, limit, overlap, tuple(separators)):
        at = t.find(c[:PROBE], cursor)
        at = cursor if at < 0 else at
        out.append((c, at, at + len(c)))
        cursor = at + max(1, len(c) - 6 * overlap)
    return out


def chunk_udf(limit: int, overlap: int, separators: tuple[str, ...] = SEPARATORS):
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")

    @F.pandas_udf(PIECE)
    def chunks(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"content": c, "start_char": a, "end_char": b} for c, a, b in chunk_text(t, limit, overlap, separators)])

    return chunks


def recursive_chunks(df: DataFrame, text_col: str = "text", limit: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """One row per chunk: the input's other columns with ord, content, start_char and end_char."""
    keep = [c for c in df.columns if c not in (text_col, "ord", "content", "start_char", "end_char")]
    got = df.select(*keep, F.posexplode(chunk_udf(limit, overlap, separators)(F.col(text_col))).alias("ord", "c"))
    return got.select(*keep, "ord", "c.content", "c.start_char", "c.end_char")


def parent_child(pages: DataFrame, parent: tuple[int, int] = (1024, 100), child: tuple[int, int] = (256, 30)) -> tuple[DataFrame, DataFrame]:
    """(parents, children) of (doc_id, page_num, text). A parent's id is made of document, page and place, so runs agree."""
    p = recursive_chunks(pages.select("doc_id", F.col("page_num").alias("page"), "text"), "text", *parent).withColumnRenamed("ord", "parent_ord")
    p = p.withColumn("parent_id", F.substring(F.sha2(F.concat_ws("|", "doc_id", "page", "parent_ord"), 256), 1, 12))
    parents = p.select("doc_id", "page", "parent_ord", "parent_id", "content", "start_char", "end_char", F.lit(True).alias("is_parent"), F.lit("parent").alias("chunk_level"))
    base = p.select("doc_id", "page", "parent_ord", "parent_id", F.col("start_char").alias("base"), F.col("content").alias("text"))
    c = recursive_chunks(base, "text", *child)
    children = c.select(
        "doc_id", "page", "parent_ord", "ord", "parent_id", "content", (F.col("start_char") + F.col("base")).alias("start_char"), (F.col("end_char") + F.col("base")).alias("end_char"),
        F.lit(False).alias("is_parent"), F.lit("child").alias("chunk_level"),
    )
    return parents, children


def flat_chunks(pages: DataFrame, limit: int = 256, overlap: int = 30) -> DataFrame:
    return recursive_chunks(pages.select("doc_id", F.col("page_num").alias("page"), "text"), "text", limit, overlap)
