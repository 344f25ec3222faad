"""Text expressions: cleaning, tokens, shingles. All are built-in columns; only NFKC needs Python, and only for non-ASCII text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}]"

# Characters that cleaning replaces one for one, and those it expands or drops.
ONE_FOR_ONE = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "}
DROPPED = "​‌‍﻿­"
BULLETS = "•●○▪‣·"
LONGER = {"…": "...", "ﬃ": "ffi", "ﬄ": "ffl", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff"}
WATERMARKS = ("DRAFT", "CONFIDENTIAL", "DO NOT DISTRIBUTE", "INTERNAL USE ONLY", "SAMPLE", "UNCONTROLLED COPY")

# Words that are no search terms in documents (the first list holds for questions, too).
QUERY_STOP_WORDS = (
    "the a an is are was were be been have has had do does did will would could should to of in for on with at by from as "
    "and but or not so this that these those it its they them we us you your i my me he she"
).split()
CORPUS_STOP_WORDS = QUERY_STOP_WORDS + (
    "being may might shall can into through during before after above below between yet both either neither each every all any few "
    "more most other some such no only own same than too very their our"
).split()


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfkc(c)).otherwise(c)


def replace_characters(c: Column) -> Column:
    c = F.translate(c, "".join(ONE_FOR_ONE) + DROPPED, "".join(ONE_FOR_ONE.values()))
    for old, new in LONGER.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.regexp_replace(c, f"[{BULLETS}]", "- ")


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def rejoin_hyphenated(c: Column) -> Column:
    return F.regexp_replace(c, rf"({WORD})-{SPACE}*\n{SPACE}*({WORD})", "$1$2")


def collapse_blanks(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")


def strip_page_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)(?:^|\n)\s*(?:Page\s+)?\d{1,4}\s*(?:of\s+\d{1,4})?\s*(?:\n|$)", "\n")


def strip_watermarks(c: Column) -> Column:
    return F.regexp_replace(c, f"(?i)(?:{'|'.join(WATERMARKS)})", "")


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def clean_steps(c: Column) -> Column:
    """Everything of ``clean_text`` but the NFKC form."""
    for step in (replace_characters, strip_controls, rejoin_hyphenated, collapse_blanks, strip_page_numbers, strip_watermarks, strip):
        c = step(c)
    return c


def clean_text(c: Column) -> Column:
    """Cleaned text; null and empty texts give the empty string."""
    return F.coalesce(clean_steps(nfkc(c)), F.lit(""))


def header_form(line: Column) -> Column:
    """Form of a line under which repetitions are counted: numbers of up to four digits as #, blanks collapsed."""
    return F.regexp_replace(F.regexp_replace(strip(line), rf"(?<!{WORD})\d{{1,4}}(?!{WORD})", "#"), rf"{SPACE}+", " ")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"{WORD}+"), F.lit(0))


def _terms(c: Column, stop: list[str]) -> Column:
    return F.filter(words(c), lambda w: ~w.isin(stop) & (F.length(w) > 1))


def corpus_terms(c: Column) -> Column:
    return _terms(c, CORPUS_STOP_WORDS)


def query_terms(c: Column) -> Column:
    return _terms(c, QUERY_STOP_WORDS)


def split_words(c: Column) -> Column:
    """Runs without blanks; an empty array for null and blank text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), rf"{SPACE}+"), lambda w: w != "")


def token_len(c: Column) -> Column:
    return F.size(split_words(c))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, even if f uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def shingles(tokens: Column, k: int = 3) -> Column:
    """Distinct sequences of k tokens; fewer tokens give one joined sequence, none an empty array."""

    def of(t: Column) -> Column:
        n = F.size(t)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(F.array_join(t, " "))).otherwise(F.array_distinct(runs))

    return bind(tokens, of)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets: 1 if both are empty, 0 if one is."""
    common = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when(total == 0, 1.0).otherwise(common / total)


def word_windows(tokens: Column, limit: int, overlap: int) -> Column:
    """Windows of ``limit`` tokens that advance by limit - overlap until the end is reached."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    step = limit - overlap

    def of(t: Column) -> Column:
        n = F.size(t)
        last = F.when(n <= limit, 0).otherwise(F.ceil((n - limit) / step) * step).cast("int")
        windows = F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.array_join(F.slice(t, i + 1, limit), " "))
        return F.when(n > 0, windows).otherwise(F.array().cast("array<string>"))

    return bind(tokens, of)
