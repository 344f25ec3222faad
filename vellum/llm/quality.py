"""Per-document text statistics and a learned rule list that tells prose from lists, tables and junk.

The statistics come from one vectorised scan of each Arrow batch (see ``textkit``; as built-in regular
expressions they took 25 times the CPU). The rule list is induced by incremental reduced-error pruning (grow on
two thirds of the labels, prune on the rest, keep the rule while it helps) over several splits, of which the shortest
description of the labels wins, and exported as one SQL ``CASE``, so that applying it stays inside whole-stage code
generation.

Defined results: null, empty and blank texts get null statistics and are no case of ``found``; labels that
are null or contradict each other for one key are left out of the fit; without any usable label of either
kind the rule list is empty and every document counts as prose. Input columns of any name pass through, only
``stats`` (and ``is_prose``) are reserved.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import BLANK, BREAK, CLOSE, DIGIT, LETTER, LOWER, STOP, UPPER, TextBatch, member, pieces, word_hash

# Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "a an the of and or to in on at by for from with without as is are was were be been has have had not no "
    "this that these those it its which who where when while after before until once than if because since "
    "may must shall should can could will would into under between both any each more most only first then "
    "der die das den dem des ein eine und oder zu zum zur im am auf bei mit von vom vor nach wird werden wurde ist sind "
    "nicht dass sobald wenn muss darf für über "
    "le la les un une du et ou à au aux en dans sur par pour avec est sont été doit que qui où si après avant "
    "el los las lo y o del al con por para se ha ser sido fue debe según cómo también antes después"
).split()

#: Bound on the labelled rows that are collected for the fit.
MAX_LABELS = 20_000

FEATURES = (
    "word_count", "mean_word_length", "symbol_ratio", "odd_char_ratio", "digit_ratio", "single_char_share", "line_count", "words_per_line",
    "punct_line_share", "entry_line_share", "number_line_share", "delimiter_rate", "common_share", "sentence_rate",
    "distinct_share", "plain_word_share",
)


STATS_TYPE = T.StructType([T.StructField(k, T.DoubleType()) for k in FEATURES])


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def measure(b: TextBatch) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The features of each text, and whether it has any character besides blanks."""
    cls, codes = b.cls, b.codes
    solid = (cls & (BLANK | BREAK)) == 0
    letter, digit = (cls & LETTER) != 0, (cls & DIGIT) != 0
    chars, letters, digits = b.per_text(solid), b.per_text(letter), b.per_text(digit)
    known = member(codes, np.array(sorted(map(ord, "\n !\"#%&'()*+,-./:;<=>?[]_|°‐‑–—‘’“”•…")), np.uint32))

    ts, te = b.runs(BLANK | BREAK, within=False)  # tokens: runs without blanks
    trow = b.rows_of(ts)
    tokens = np.bincount(trow, minlength=b.size)
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    token_letters = sums(letter)
    inner = token_letters[te] - token_letters[ts]
    plain = (inner >= 2) & (inner >= te - ts - 1)
    last = te - 1
    last = np.where(((cls[last] & CLOSE) != 0) & (last > ts), last - 1, last)
    before = np.maximum(last - 1, 0)
    ends = ((cls[last] & STOP) != 0) & (last - ts >= 2) & ((cls[before] & (LETTER | DIGIT | CLOSE)) != 0)
    leader = (inner == 0) & (codes[ts] == ord(".")) | np.isin(codes[ts], [ord("…"), ord("|")]) & (inner == 0)

    ws, we = b.runs(LETTER)
    wrow = b.rows_of(ws)
    words, hashes = np.bincount(wrow, minlength=b.size), b.hashes(ws, we)
    common = np.bincount(wrow[member(hashes, _common())], minlength=b.size)
    key = np.sort((wrow.astype(np.uint64) << np.uint64(52)) | (hashes >> np.uint64(12)))
    first = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    distinct = np.bincount((first >> np.uint64(52)).astype(np.int64), minlength=b.size)

    # a line counts if it has a token; its first and last tokens tell what kind of line it is
    line = np.cumsum(codes == 10)
    tl = line[ts]
    opens = np.concatenate([[True], tl[1:] != tl[:-1]]) if len(tl) else np.zeros(0, bool)
    closes = np.concatenate([opens[1:], [True]]) if len(tl) else opens
    lines = np.bincount(trow[opens], minlength=b.size)
    length = te - ts
    first_code, last_code = codes[ts], codes[te - 1]
    mark = np.isin(first_code, list(map(ord, "-*•–▪◦·"))) & (length == 1)
    mark |= (first_code == ord("[")) & ((length == 3) & (last_code == ord("]")) | (length == 1))
    mark |= (length <= 5) & np.isin(last_code, [ord("."), ord(")")]) & (((cls[ts] & DIGIT) != 0) | (first_code == ord("(")) | (length == 2))
    mark |= ((cls[ts] & DIGIT) != 0) & ((cls[te - 1] & DIGIT) != 0) & (inner == 0) & (length >= 3) & (length <= 9)
    tab = np.isin(codes, [9, ord("|"), ord(";")])
    gap = ((cls & BLANK) != 0) & solid_shift(cls)
    case_break = np.zeros(len(codes), bool)  # a capital within a word, as misread encodings leave it
    case_break[1:] = ((cls[1:] & UPPER) != 0) & ((cls[:-1] & LOWER) != 0)
    n, t, ln = words.astype(float), tokens.astype(float), lines.astype(float)
    return {
        "word_count": t,
        "mean_word_length": _share(letters, n),
        "symbol_ratio": _share(chars - letters - digits, chars),
        "odd_char_ratio": _share(b.per_text(solid & ~known & ~digit & (~letter | case_break)), chars),
        "digit_ratio": _share(digits, chars),
        "single_char_share": _share(np.bincount(trow[length == 1], minlength=b.size), t),
        "line_count": ln,
        "words_per_line": _share(t, ln),
        "punct_line_share": _share(np.bincount(trow[closes & ends], minlength=b.size), ln),
        "entry_line_share": _share(np.bincount(trow[opens & mark], minlength=b.size), ln),
        "number_line_share": _share(np.bincount(trow[closes & ((cls[te - 1] & DIGIT) != 0)], minlength=b.size), ln),
        "delimiter_rate": _share(b.per_text(tab) + b.per_text(gap) + np.bincount(trow[leader], minlength=b.size), t),
        "common_share": _share(common, n),
        "sentence_rate": _share(np.bincount(trow[ends], minlength=b.size), t),
        "distinct_share": _share(distinct, n),
        "plain_word_share": _share(np.bincount(trow[plain], minlength=b.size), t),
    }, chars > 0


def solid_shift(cls: np.ndarray) -> np.ndarray:
    """Marks a blank that ends a gap of three or more blanks within a line."""
    blank = (cls & BLANK) != 0
    out = np.zeros(len(cls), bool)
    if len(cls) > 3:
        out[2:-1] = blank[2:-1] & blank[1:-2] & blank[:-3] & ((cls[3:] & (BLANK | BREAK)) == 0)
    return out


@lru_cache(1)
def _common() -> np.ndarray:
    return word_hash(COMMON_WORDS)


@F.arrow_udf(STATS_TYPE)
def text_stats(texts: pa.Array) -> pa.Array:
    """``struct`` of doubles in the order of ``FEATURES``; null for null and blank text."""

    done = [_arrow_stats(p) for p in pieces(pa.RecordBatch.from_arrays([texts], ["t"]), "t")]
    return pa.concat_arrays(done) if done else pa.array([], pa.struct([(k, pa.float64()) for k in FEATURES]))


def _arrow_stats(part: pa.RecordBatch) -> pa.Array:
    values, some = measure(TextBatch(part.column(0).to_pylist()))
    return pa.StructArray.from_arrays([pa.array(values[k].astype(float)) for k in FEATURES], names=list(FEATURES), mask=pa.array(~some))


def with_text_stats(df: DataFrame, text_col: str = "content", out: str = "stats") -> DataFrame:
    return df.withColumn(out, text_stats(F.col(text_col)))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.at_least else v < self.threshold

    def sql(self, stats: str) -> str:
        return f"{stats}.{self.feature} {'>=' if self.at_least else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class RuleList:
    """Ordered rules; the first that holds says "not prose", otherwise the document is prose."""

    rules: tuple[tuple[Condition, ...], ...]

    def case_sql(self, stats: str = "stats") -> str:
        whens = " ".join(f"WHEN {' AND '.join(c.sql(stats) for c in r)} THEN 0" for r in self.rules)
        return f"CASE WHEN {stats} IS NULL THEN NULL {whens} ELSE 1 END"

    def predict(self, x: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(x), bool)
        for r in self.rules:
            hit |= np.logical_and.reduce([c.holds(x) for c in r])
        return ~hit


def _best_condition(x: np.ndarray, y: np.ndarray, bins: int, scale: np.ndarray) -> Condition | None:
    """The condition of most information gain over the rows that the rule still covers; of equal gains that of the widest gap."""
    p0, n0 = y.sum(), (~y).sum()
    best, found = (1e-9, 0.0), None
    base = math.log2(p0 / (p0 + n0))
    for j, name in enumerate(FEATURES):
        v = x[:, j]
        distinct = np.unique(v)
        if len(distinct) < 2:
            continue
        at = np.arange(len(distinct) - 1)
        if len(at) > bins:
            at = at[np.linspace(0, len(at) - 1, bins).astype(int)]
        cuts, gaps = (distinct[at + 1] + distinct[at]) / 2, (distinct[at + 1] - distinct[at]) / scale[j]
        order = np.argsort(v, kind="stable")
        below = np.searchsorted(v[order], cuts)
        cum = np.concatenate([[0], np.cumsum(y[order])])
        for at_least, p, total in ((False, cum[below], below), (True, p0 - cum[below], len(v) - below)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / total) - base), -1.0)
            top = np.flatnonzero(gain >= gain.max() - 1e-9)
            k = top[gaps[top].argmax()]
            score = (round(float(gain[k]), 9), float(gaps[k]))
            if score > best:
                best, found = score, Condition(name, at_least, float(np.round(cuts[k], 6)))
    return found


def _holds(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule])


def _grown(x: np.ndarray, y: np.ndarray, rows: np.ndarray, bins: int, scale: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    covered = rows.copy()
    while (~y[covered]).any() and y[covered].any() and len(rule) < 6:
        condition = _best_condition(x[covered], y[covered], bins, scale)
        if condition is None:
            break
        rule.append(condition)
        covered &= condition.holds(x)
    return rule


def _one_list(x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None, bins: int, max_rules: int, tries: int = 3) -> list[list[Condition]]:
    """One run of incremental reduced-error pruning; without ``rng`` rules are grown on all rows and not pruned."""
    scale = np.maximum(x.std(axis=0), 1e-12)
    rules: list[list[Condition]] = []
    left, failed = np.ones(len(y), bool), 0
    while y[left].any() and (~y[left]).any() and len(rules) < max_rules and failed < tries:
        grow = prune = left
        if rng is not None:
            at = rng.permutation(np.flatnonzero(left))
            held = np.zeros(len(y), bool)
            for kind in (True, False):  # both classes are divided in the same proportion
                own = at[y[at] == kind]
                held[own[: len(own) // 3]] = True
            grow, prune = left & ~held, left & held
            if not y[prune].any():
                prune = left
        rule = _grown(x, y, grow, bins, scale)
        if not rule:
            failed += 1
            continue

        def worth(r: list[Condition], rows: np.ndarray) -> tuple[float, int, int]:
            m = rows & _holds(r, x)
            p, n = int(y[m].sum()), int((~y[m]).sum())
            return ((p - n) / (p + n) if p + n else -1.0), p, n

        while len(rule) > 1 and worth(rule[:-1], prune)[0] >= worth(rule, prune)[0]:
            rule.pop()
        _, p, n = worth(rule, prune)
        if n >= p:  # wrong on half of what it covers: another split may do better
            failed += 1
            if rng is None:
                break
            continue
        rules.append(rule)
        left &= ~_holds(rule, x)
    return rules


def _merged(rule: list[Condition]) -> tuple[Condition, ...]:
    """Of several conditions on one statistic in one direction only the narrowest."""
    out: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        had = out.get((c.feature, c.at_least))
        if had is None or (c.threshold > had.threshold) == c.at_least:
            out[c.feature, c.at_least] = c
    return tuple(out.values())


def description_bits(rules: list[list[Condition]], x: np.ndarray, y: np.ndarray, bins: int) -> float:
    """Bits that state the rules and then name the labels they get wrong."""
    choose = lambda n, k: (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / math.log(2)
    hit = np.zeros(len(y), bool)
    for r in rules:
        hit |= _holds(r, x)
    covered = int(hit.sum())
    theory = sum(len(r) * (math.log2(len(FEATURES)) + 1 + math.log2(max(2, min(bins, len(y))))) for r in rules)
    return theory / 2 + choose(covered, int((hit & ~y).sum())) + choose(len(y) - covered, int((~hit & y).sum()))


def induce_rules(x: np.ndarray, is_prose: np.ndarray, seeds: int = 10, bins: int = 256, max_rules: int = 24) -> RuleList:
    """Incremental reduced-error pruning with "not prose" as the class that the rules cover.

    A rule is grown by information gain on two thirds of the remaining rows until it covers no prose, its
    trailing conditions are dropped while (p - n) / (p + n) on the other third doesn't fall, and the list ends
    when pruned rules are wrong on half of what they cover there. That is done on ``seeds`` random splits and once
    unpruned on all rows; the list of the shortest description of the labels is taken. It has a rule as long as both
    classes occur and differ in any statistic.
    """
    x, y = np.nan_to_num(np.asarray(x, float)), ~np.asarray(is_prose, bool)
    lists = [_one_list(x, y, None if i is None else np.random.default_rng(i), bins, max_rules) for i in (*range(seeds), None)]
    best = min((r for r in lists if r), key=lambda r: description_bits(r, x, y, bins), default=[])
    return RuleList(tuple(_merged(r) for r in best))


def fit_rules(docs: DataFrame, labels: DataFrame, key: str, text_col: str, label_col: str = "is_prose", max_labels: int = MAX_LABELS) -> RuleList:
    """Fit on the labelled documents, at most ``max_labels`` of them, chosen by the hash of the key.

    The label sample is the only data that reaches the driver; its size is bound by ``max_labels``.
    """
    sample = (
        labels.select(F.col(key).alias("k"), F.col(label_col).alias("y")).where("k is not null and y is not null")
        .groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("k", "y")
        .orderBy(F.xxhash64("k"), "k").limit(max_labels)
    )
    got = (
        docs.select(F.col(key).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(sample), "k")
        .select("k", "y", text_stats(F.col("t")).alias("s")).select("k", "y", "s.*").toPandas()
    )
    # blank texts are dropped here: as a filter, Spark would measure all documents before the join
    got = got.dropna().drop_duplicates("k").sort_values("k")
    if got.empty or got.y.nunique() < 2:
        return RuleList(())
    return induce_rules(got[list(FEATURES)].to_numpy(), got.y.to_numpy() == 1)


def classify_prose(docs: DataFrame, rules: RuleList, text_col: str = "content") -> DataFrame:
    """Adds ``stats`` and ``is_prose`` (1, 0; null for null and blank texts)."""
    return with_text_stats(docs, text_col).withColumn("is_prose", F.expr(rules.case_sql()))


def not_prose(docs: DataFrame, rules: RuleList, key: str = "chunk_ord", text_col: str = "content") -> DataFrame:
    """Keys of the documents that are lists, tables or junk, one row each."""
    rows = docs.select(F.col(key), F.col(text_col).alias("__text"))
    return classify_prose(rows, rules, "__text").where("is_prose = 0").select(key).distinct()
