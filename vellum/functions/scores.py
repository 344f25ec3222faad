"""Quality dimensions of a chunk and vector arithmetic, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD, split_words, strip, words

# Texts that are boilerplate as a whole or from their start.
BOILERPLATE = (
    r"^(page\s+)?\d{1,4}(\s+of\s+\d{1,4})?$", r"^table of contents$", r"^\s*\.{3,}\s*\d+\s*$",
    r"^(copyright|©|all rights reserved)", r"^(this page intentionally left blank)", r"^(draft|confidential|internal use only)$",
)
# Weights of the dimensions.
WEIGHTS = {"length_score": 0.15, "entropy_score": 0.20, "alpha_ratio": 0.15, "uniqueness_score": 0.15, "coherence_score": 0.10, "boilerplate_score": 0.25}


# The steps of the score by number of words.
def length_score(n: Column) -> Column:
    return F.when(n < 10, 0.0).when(n <= 50, 0.5 + 0.5 * n / 50).when(n <= 500, 1.0).when(n <= 2000, 1.0 - 0.3 * (n - 500) / 1500).otherwise(0.3)


def char_entropy(text: Column) -> Column:
    """Bits per character of the lower-cased text.

    The characters are sorted once; each run of equal ones adds n log n.
    """
    chars = F.array_sort(F.filter(F.split(F.lower(text), ""), lambda c: c != ""))
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    done = lambda a: F.when(a["n"] > 0, a["n"] * F.log2(F.greatest(a["n"], F.lit(1.0)))).otherwise(0.0)
    step = lambda a, c: F.struct(
        c.alias("c"), F.when(c == a["c"], a["n"] + 1.0).otherwise(F.lit(1.0)).alias("n"), F.when(c == a["c"], a["s"]).otherwise(a["s"] + done(a)).alias("s")
    )
    total = F.length(text).cast("double")
    return F.when(total > 0, F.aggregate(chars, start, step, lambda a: F.log2(total) - (a["s"] + done(a)) / total)).otherwise(0.0)


def quality(text: Column, kind: Column) -> Column:
    """Struct of the six dimensions and the composite, each with three decimals; null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    tokens = split_words(t)
    n = F.size(tokens)
    length = F.length(t)
    w = words(t)
    letters = F.length(F.regexp_replace(t, rf"[^{WORD[1:-1]}]", "")).cast("double")
    mean = F.when(F.size(w) > 0, letters / F.size(w)).otherwise(0.0)
    lower = F.transform(tokens, F.lower)
    dims = {
        "length_score": length_score(n),
        "entropy_score": F.least(char_entropy(t) / 5, F.lit(1.0)),
        "alpha_ratio": F.when(length > 0, F.length(F.regexp_replace(t, r"[^\p{L}\p{N}\s\p{Z}]", "")) / length).otherwise(0.0),
        "uniqueness_score": F.when(n > 0, F.size(F.array_distinct(lower)) / n).otherwise(0.0),
        "coherence_score": F.when(mean.between(2.5, 12.0), 1.0).otherwise(0.5),
        "boilerplate_score": F.when(is_boilerplate(t), 0.0).otherwise(1.0),
    }
    total = sum(F.lit(weight) * dims[name] for name, weight in WEIGHTS.items())
    total = F.when(kind.isin("table", "image"), F.greatest(total, F.lit(0.60))).otherwise(total)
    return F.struct(*(F.round(v, 3).alias(k) for k, v in dims.items()), F.round(total, 3).alias("quality_score"))


def is_boilerplate(text: Column) -> Column:
    t = strip(text)
    hit = F.lit(False)
    for pattern in BOILERPLATE:
        hit = hit | t.rlike(f"(?iu){pattern}")
    return hit


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))
