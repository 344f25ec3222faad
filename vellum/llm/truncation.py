"""Texts that were cut off, found by values that are strict prefixes of longer copies elsewhere.

The self-join by prefix is made at four grains, by hashes of fixed-length prefixes or by sorting. *Windows*: the last
three, two or one tokens of a text, with the kind of line they stand in, are looked up among all token runs of the
corpus; runs that go on after them are longer copies of the same value, runs that end a line or a sentence there are
whole ones. *Words*: the last word is looked up among the prefixes of all words; one that hardly occurs whole but
begins longer words was cut, and a word with a dot that hardly ever ends a line or text and never occurs without the
dot is an abbreviation, behind which a sentence goes on. *Rows*: the delimiters of a last table row that are a strict
prefix of those of the rows above. *Texts*: distinct texts are range-sorted, so a text that begins a longer one
stands right before such a text.

Only two things are no prefix evidence: marks of omission behind the end, and the lengths at which a source's cut
texts crowd (its field limits), which decide where the windows leave an end open to doubt. An end without any support
counts as cut in running text and as whole in lists. The longest window with at least two occurrences decides; the
texts' own ends count as whole only where texts end more often than not behind their context, so stumps don't.

Tokens are folded (case, runs of digits, codes of capitals and digits). All counts are over all documents; equal
texts count once among the ends. Defined results: null, empty and blank texts are never cut; repeated ids are judged
per id (cut if any row of it is); rows with null ids are ignored. A null source is a source of its own in the rates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import cut
from . import sketch
from .splitting import ABBREVIATIONS
from .textkit import BLANK, BREAK, CLOSE, DIGIT, LETTER, LOWER, STOP, UPPER, Spans, TextBatch, member, mix, pieces, word_hash

# Marks that stand for what was left out, and blanks behind an end.
_MARK = re.compile(r"(?:…|\.{3,}|�|\[\.\.\.\]|\[…\]|\(\.\.\.\)|\[(?:truncated|cut|more)\])+[\s​‍﻿]*$", re.I)
_BLANKS = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　​‌‍﻿\x00"
_HIDDEN = np.array([0xAD, 0x200B, 0x200C, 0x200D, 0xFEFF], np.uint32)
_OPENERS = np.array(sorted(map(ord, "([{\"'“‘«")), np.uint32)
_PAUSES = np.array(sorted(map(ord, ",;:")), np.uint32)
#: Salts of the key spaces.
W3, W2, W1, C3, C2, WORD, PREFIX, DOTTED = range(1, 9)
#: Characters that are scanned at once; a longer text is scanned as a whole.
SLICE = 500_000
#: Tokens of the line above up to which a line without a bullet counts as a list's.
SHORT_LINE = 8


def _key(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def body_of(text: str) -> tuple[str, int]:
    """The text without blanks and marks of omission at its end; 1 if there was a mark, 2 if the mark says by itself that more came."""
    body = text.rstrip(_BLANKS)
    m = _MARK.search(body, max(0, len(body) - 200))
    if not m:
        return body, 0
    return body[: m.start()].rstrip(_BLANKS), 2 if m.group(0).startswith(("…", "�")) else 1


def last_lines(body: str) -> str:
    """From the start of the last line that isn't blank above the last one: all that the end's windows depend on."""
    at = len(body)
    for _ in range(2):
        at = body.rfind("\n", 0, at)
        while at >= 0 and not body[body.rfind("\n", 0, at) + 1 : at].strip():
            at = body.rfind("\n", 0, at)
        if at < 0:
            return body
    return body[at + 1 :]


def row_verdict(body: str) -> int:
    """1: the last row's delimiters are a strict prefix of those of the fullest of three rows above; 2: they are all there, or
    columns are set by blanks, where cells may be missing; 0: no table."""
    lines = [x for x in re.split(r"[\r\n]+", body[body.rfind("\n", 0, max(0, len(body) - 4000)) + 1 :]) if x.strip()][-4:]
    marks = [re.sub(r"[^|;\t]+", "", x) for x in lines]
    best = max(marks[:-1], key=len, default="")
    if len(best) < 2 or not marks[-1] or not best.startswith(marks[-1]):
        return 2 if any(re.search(r"\S {3,}\S", x) for x in lines[-2:-1]) else 0
    return 1 if len(marks[-1]) < len(best) else 2


@lru_cache(1)
def _abbreviations() -> np.ndarray:
    return word_hash(ABBREVIATIONS)


@dataclass
class Units:
    """The tokens of a batch of bodies with the keys of their windows."""

    row: np.ndarray
    final: np.ndarray
    closes: np.ndarray
    ends: np.ndarray
    stop: np.ndarray
    dotted: np.ndarray
    prose: np.ndarray
    open_word: np.ndarray
    stem: np.ndarray
    span: tuple[np.ndarray, np.ndarray]
    spans: Spans
    keys: dict[int, np.ndarray]


def units(b: TextBatch) -> Units | None:
    """Tokens are runs without blanks. Codes (tokens with digits or of capitals only) are folded to A and 9, others to lower case."""
    cls, codes = b.cls, b.codes
    ts, te = b.runs(BLANK | BREAK, within=False)
    if not len(ts):
        return None
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    upper, digit, letter = (cls & UPPER) != 0, (cls & DIGIT) != 0, (cls & LETTER) != 0
    n_letter, n_upper, n_digit = (s[te] - s[ts] for s in (sums(letter), sums(upper), sums(digit)))
    coded = (n_digit > 0) | (n_letter == n_upper) & (n_letter >= 2)
    inside = np.zeros(len(codes), bool)
    which = np.zeros(len(codes) + 1, np.int64)
    which[ts] = 1
    which = np.cumsum(which)[:-1] - 1  # the token that a character belongs to (or follows)
    inside = (cls & (BLANK | BREAK)) == 0
    code = inside & coded[np.maximum(which, 0)]
    back = lambda flags, k: np.concatenate([np.zeros(k, bool), flags[:-k]])
    point = np.isin(codes, [ord("."), ord(",")])
    between = point & back(digit, 1) & np.concatenate([digit[1:], [False]])
    drop = between | digit & (back(digit, 1) | back(between, 1)) | code & upper & back(upper, 1) | np.isin(codes, _HIDDEN)
    keep = inside & ~drop
    values = np.where(digit, ord("9"), np.where(code & upper, ord("A"), b.low))[keep].astype(np.uint32)
    kept = cls[keep]
    at = sums(keep)
    s, e = at[ts], at[te]
    spans = Spans(values)
    values, kept = np.append(values, 0), np.append(kept, 0)

    row = b.rows_of(ts)
    line = np.cumsum(codes == 10)[ts]
    first = np.concatenate([[True], (line[1:] != line[:-1])])
    closes = np.concatenate([first[1:], [True]])
    final = np.concatenate([row[1:] != row[:-1], [True]])
    lead = s.copy()
    for _ in range(3):
        lead += (lead < e - 1) & np.isin(values[lead], _OPENERS)
    tail = e.copy()
    for _ in range(3):
        tail -= (tail > lead + 1) & ((kept[tail - 1] & CLOSE) != 0)
    stop = (tail > lead) & ((kept[tail - 1] & STOP) != 0)
    dotted = stop & (values[tail - 1] == ord("."))
    known = member(spans.hashes(lead, tail), _abbreviations())
    number = dotted & (tail - lead == 2) & (values[lead] == ord("9"))
    stop &= ~known & ~number
    bare = tail.copy()
    for _ in range(3):
        last = np.maximum(bare - 1, 0)
        bare -= (bare > lead + 1) & (((kept[last] & (STOP | CLOSE)) != 0) | np.isin(values[last], _PAUSES))
    stem = spans.hashes(lead, bare)
    last = np.maximum(e - 1, 0)
    open_word = (e > s) & (bare == e) & (((kept[last] & LETTER) != 0) | (values[last] == ord("-")))
    follows = codes[np.append(ts[1:], ts[-1])]
    capital = (cls[np.append(ts[1:], ts[-1])] & (UPPER | LETTER | DIGIT)) & ~np.uint8(LETTER)
    opens_sentence = ((capital & UPPER) != 0) | np.isin(follows, _OPENERS)
    ends = closes | stop & opens_sentence

    # the kind of a line: its bullet, or the ground of lines that open with a word
    opening = np.flatnonzero(first)
    n_line = np.diff(np.append(opening, len(ts)))
    above = opening - 1
    has_above = (opening > 0) & (row[above] == row[opening])
    lower = sums((kept[:-1] & LOWER) != 0)
    n_lower = lower[e] - lower[s]
    bullet = (n_lower[opening] <= 1) & (e[opening] - s[opening] <= 6) & (n_letter[opening] < te[opening] - ts[opening])
    own_end = np.append(opening[1:], len(ts)) - 1
    after_stop = np.where(has_above, stop[above], stop[own_end] | final[own_end])
    short = has_above & (np.concatenate([[0], n_line[:-1]]) <= SHORT_LINE)
    wide = ~first & (ts - np.append(0, te[:-1]) >= 3)  # behind a gap, as between the columns of a table
    wide_line = np.bincount(np.cumsum(first)[wide] - 1, minlength=len(opening)) > 0
    shape = spans.hashes(s[opening], e[opening])
    for i in np.flatnonzero(bullet & (n_lower[opening] == 1)):  # (a), (b), ... are one kind
        j = opening[i]
        shape[i] = Spans(np.where((kept[s[j] : e[j]] & LOWER) != 0, ord("a"), values[s[j] : e[j]])).hashes(np.array([0]), np.array([e[j] - s[j]]))[0]
    ground = np.where(wide_line, 4, np.where(after_stop, 1, np.where(short, 2, 3))).astype(np.uint64)
    of = np.cumsum(first) - 1
    kind = np.where(bullet, shape ^ ground, ground)[of]
    prose = (~bullet & ((ground & np.uint64(1)) == 1))[of]

    t = spans.hashes(s, e)
    prev = lambda x, k: np.where(np.concatenate([np.zeros(k, bool), line[k:] == line[:-k]]) if len(x) > k else np.zeros(len(x), bool), np.concatenate([np.zeros(k, np.uint64), x[:-k]])[: len(x)] if len(x) > k else np.uint64(0), np.uint64(0))
    c2 = _key(_key(kind, C2) ^ prev(t, 1), C2)
    c3 = _key(_key(c2, C3) ^ prev(t, 2), C3)
    keys = {W1: _key(_key(kind, W1) ^ t, W1), W2: _key(c2 ^ t, W2), W3: _key(c3 ^ t, W3), C2: c2, C3: c3, WORD: _key(stem, WORD), PREFIX: _key(stem, PREFIX), DOTTED: _key(stem, DOTTED)}
    return Units(row, final, closes, ends, stop, dotted, prose, open_word, stem, (lead, bare), spans, keys)


ENDS = "doc long, source string, n long, octets long, same long, mark int, tabular int, stop boolean, dotted boolean, prose boolean, open_word boolean, w3 long, w2 long, w1 long, c3 long, c2 long, word long, prefix long, dot long"
SLOTS = (("w3", W3), ("w2", W2), ("w1", W1), ("c3", C3), ("c2", C2), ("word", WORD), ("prefix", PREFIX), ("dot", DOTTED))


def _bodies(part: pa.RecordBatch) -> tuple[list[str], list[str], list[int]]:
    texts = part.column("t").to_pylist()
    found = [body_of(t) for t in texts]
    return texts, [x.replace("\r\n", "\n").replace("\r", "\n") for x, _ in found], [m for _, m in found]


def text_ends(docs: DataFrame) -> DataFrame:
    """One row for each document that has a token: its length, what stands at its end, and the keys of its end."""
    names = [x.split()[0] for x in ENDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t", SLICE):
                texts, bodies, marks = _bodies(part)
                u = units(TextBatch([last_lines(x) for x in bodies]))
                if u is None:
                    continue
                at = np.flatnonzero(u.final)
                rows = u.row[at]
                own = pa.array(rows)
                pick = [bodies[i] for i in rows]
                hashed = word_hashes(pick)
                columns = [
                    part.column("doc").take(own), part.column("source").take(own), pa.array([len(texts[i]) for i in rows], pa.int64()), pa.array([len(texts[i].encode("utf-8", "surrogatepass")) for i in rows], pa.int64()),
                    pa.array(hashed), pa.array([marks[i] for i in rows], pa.int32()), pa.array([row_verdict(x) for x in pick], pa.int32()),
                    *(pa.array(x[at]) for x in (u.stop, u.dotted, u.prose, u.open_word)), *(pa.array(u.keys[k][at].view(np.int64)) for _, k in SLOTS),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, ENDS)


def word_hashes(texts: list[str]) -> np.ndarray:
    b = TextBatch(texts)
    return b.hashes(b.off[:-1], b.off[1:] - 1).view(np.int64)


def _filter(ends: DataFrame):
    """A broadcast table of 2^bits bytes that marks the keys of the ends; a collision only lets a needless key through."""
    bits = sketch.bits_for(8 * len(SLOTS) * ends.count())
    mask = np.uint64((1 << bits) - 1)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sketch.empty(bits)
        for batch in batches:
            for column in batch.columns:
                table[(np.asarray(column).view(np.uint64) & mask).astype(np.int64)] = 1
        for i, data in sketch.blocks(table):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([data], pa.binary())], names=["block", "data"])

    parts = ends.select(*(k for k, _ in SLOTS)).mapInArrow(build, "block int, data binary")
    return ends.sparkSession.sparkContext.broadcast(sketch.collect(parts, bits)), mask


def _occurrences(docs: DataFrame, ends: DataFrame) -> DataFrame:
    """(key, a, b) of every window, context, word and word prefix that is an end's: how often it goes on (a) and is whole (b).

    Counted per slice with NumPy, then by Spark's partial aggregation; a task holds one slice's counts at a time.
    """
    present, mask = _filter(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = present.value
        for batch in batches:
            for part in pieces(batch, "t", SLICE):
                u = units(TextBatch(_bodies(part)[1]))
                if u is None:
                    continue
                inner = ~u.final
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

                def add(key: np.ndarray, a: np.ndarray, b: np.ndarray, found=found) -> None:
                    hit = table[(key & mask).astype(np.int64)] > 0
                    found.append((key[hit], a[hit].astype(np.int64), b[hit].astype(np.int64)))

                for k in (W1, W2, W3):
                    add(u.keys[k][inner], ~u.ends[inner], u.ends[inner])
                for k in (C2, C3):
                    add(u.keys[k], np.ones(len(inner), bool), np.zeros(len(inner), bool))
                for k, m in ((DOTTED, inner & u.dotted), (WORD, inner & ~u.dotted)):
                    add(u.keys[k][m], ~u.closes[m], u.closes[m] | (k == WORD))
                stems, at, n = np.unique(u.stem[inner], return_index=True, return_counts=True)
                if len(stems):
                    lead, bare = (x[inner][at] for x in u.span)
                    lengths = np.maximum(bare - lead - 1, 0)  # proper prefixes of a stem
                    starts = np.repeat(lead, lengths)
                    size = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
                    weight = np.repeat(n, lengths)
                    add(_key(u.spans.hashes(starts, starts + size), PREFIX), weight, np.zeros(len(weight), np.int64))
                keys, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(keys):
                    distinct, back = np.unique(keys, return_inverse=True)
                    total = lambda x: pa.array(np.bincount(back, x, len(distinct)).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), total(a), total(b)], names=["key", "a", "b"])

    return docs.mapInArrow(run, "key long, a long, b long")


def strict_prefixes(docs: DataFrame) -> DataFrame:
    """Hashes (h1, h2) of the texts that begin a longer text elsewhere, marks of omission aside.

    Distinct texts are range-partitioned and sorted; only the first and last text of each partition are compared
    across partitions.
    """
    bare = F.rtrim(F.col("t"), F.lit("…� \t\r\n"))
    texts = docs.select(bare.alias("t"), F.xxhash64("t").alias("h1"), F.hash("t").alias("h2")).where("t <> ''").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        names = ["part", "first", "last", "h1", "h2"]
        types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32()]
        held: list[tuple[int, int]] = []
        text = first = None
        for batch in batches:
            out = []
            for t, h1, h2 in zip(*(batch.column(c).to_pylist() for c in ("t", "h1", "h2")), strict=True):
                if t != text:
                    if text is None:
                        first = t
                    elif t.startswith(text):
                        out += held
                    text, held = t, []
                held.append((h1, h2))
            if out:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.string()), pa.nulls(len(out), pa.string()), *(pa.array(x, y) for x, y in zip(zip(*out, strict=True), types[3:], strict=True))], names=names)
        if text is not None:
            for h1, h2 in held:
                yield pa.RecordBatch.from_arrays([pa.array([x], y) for x, y in zip((pid, first, text, h1, h2), types, strict=True)], names=names)

    got = cut(texts.repartitionByRange("t").sortWithinPartitions("t", "h1", "h2").mapInArrow(run, "part int, first string, last string, h1 long, h2 int"))
    # one row per partition: their number is bounded by the number of partitions
    edges = got.where("part is not null").select("part", "first").distinct().withColumn("next", F.lead("first").over(Window.orderBy("part")))
    across = got.where("part is not null").join(edges.select("part", "next"), "part").where(F.col("next").startswith(F.col("last"))).select("h1", "h2")
    return got.where("part is null").select("h1", "h2").unionByName(across).distinct()


def _window_sql() -> str:
    """Which way the longest supported window points: fin, end, mix, cont, word, or none."""
    # in running text the longest window with two occurrences decides, the last word alone only by long odds
    counts = lambda k, odds: f"WHEN prose AND a_w{k} + b_w{k} >= 2 THEN CASE WHEN a_w{k} >= {odds} * b_w{k} THEN 'cont' WHEN b_w{k} >= a_w{k} THEN 'end' ELSE 'mix' END"
    fin = lambda k: f"WHEN f_c{k} >= 3 AND 2 * f_c{k} >= a_c{k} AND f_w{k} >= a_w{k} THEN 'fin'"
    # in lists entries end without a full stop and few texts are cut, so no window may contradict and the word must hardly ever end one
    # a word that begins others, but is never seen behind a word that is seen often
    unseen = "WHEN open_word AND a_c2 >= 300 AND a_w2 + b_w2 = 0 AND a_prefix >= 20 THEN 'word'"
    listed = "WHEN a_w3 >= 20 * b_w3 + 20 THEN 'cont' WHEN a_w1 >= 100 * b_w1 + 10 AND a_w2 >= 20 * b_w2 AND a_w3 >= 20 * b_w3 THEN 'cont' WHEN a_w1 + b_w1 > 0 THEN 'mix'"
    last = "WHEN a_prefix = 0 AND a_w1 = 0 AND f_word >= 3 AND b_word <= f_word THEN 'fin'"
    return f"CASE {fin(3)} {counts(3, 4)} {fin(2)} WHEN fragment THEN 'word' {last} {unseen} {counts(2, 4)} {counts(1, 20)} {listed} ELSE 'none' END"


def _first_verdicts(docs: DataFrame) -> DataFrame:
    """The ends with the counts of their windows, and ``first``: what decides, or whole, or doubt."""
    ends = cut(text_ends(docs))
    names = [k for k, _ in SLOTS]

    # ends that look alike are judged once; only ends without a full stop need the windows
    looked = F.when(F.col("stop"), F.array("word", "dot")).otherwise(F.array(*names))
    pattern = F.xxhash64("stop", "prose", "open_word", "dotted", *names)
    slots = F.when(F.col("stop"), F.array(F.lit("word"), F.lit("dot"))).otherwise(F.array(*map(F.lit, names)))
    asked = ends.select(pattern.alias("pattern"), F.explode(F.arrays_zip(looked.alias("key"), slots.alias("slot"))).alias("x")).select("pattern", "x.key", "x.slot").distinct()
    own = ends.select("same", F.explode(F.when(F.col("stop"), F.array("dot")).otherwise(F.array("c3", "c2", "w3", "w2", "dot", "word"))).alias("key")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    zero = F.lit(0).cast("long")
    counted = _occurrences(docs, ends).select("key", "a", "b", zero.alias("f")).unionByName(own.select("key", zero.alias("a"), zero.alias("b"), "f")).groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("f").alias("f"))
    value = lambda c, k: F.coalesce(F.max(F.when(F.col("slot") == k, F.col(c))), zero).alias(f"{c}_{k}")
    needed = [("a", "w3"), ("b", "w3"), ("f", "w3"), ("a", "w2"), ("b", "w2"), ("f", "w2"), ("a", "w1"), ("b", "w1"), ("a", "c3"), ("f", "c3"), ("a", "c2"), ("f", "c2"), ("b", "word"), ("f", "word"), ("a", "prefix"), ("a", "dot"), ("b", "dot"), ("f", "dot")]
    facts = asked.join(counted, "key", "left").groupBy("pattern").agg(*(value(*x) for x in needed))

    dots = "(a_dot + b_dot + f_dot)"
    return (
        ends.withColumn("pattern", pattern).drop(*names).join(facts, "pattern")
        .withColumn("abbreviation", F.expr(f"dotted AND 100 * b_word <= {dots} AND 33 * (b_dot + f_dot) <= {dots}"))
        .withColumn("fragment", F.expr("open_word AND a_prefix >= 5 * b_word AND a_prefix > 1 AND b_word <= 1 + a_prefix / 200"))
        .withColumn("window", F.expr(_window_sql()))
        .withColumn("first", F.expr("""CASE WHEN mark = 2 OR mark = 1 AND NOT (stop AND NOT abbreviation) THEN 'mark' WHEN stop AND abbreviation THEN 'word' WHEN stop THEN 'whole'
            WHEN tabular = 1 THEN 'row' WHEN tabular = 2 THEN if(fragment, 'word', 'doubt') WHEN window = 'cont' THEN 'window' WHEN window = 'word' THEN 'word' WHEN window = 'fin' THEN 'whole'
            WHEN window = 'none' AND prose THEN 'unsupported' ELSE 'doubt' END"""))
    )


def judged(df: DataFrame, key: str = "doc_id", text_col: str = "text", source_col: str = "source", least_spike: int = 3) -> DataFrame:
    """(doc, source, n, truncated, evidence, at_limit) of every document with text.

    ``evidence`` is what decided: window, word, row and copy are joins by prefix; limit, mark and unsupported are not;
    null for whole texts.
    """
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(source_col).alias("source"), F.col(text_col).alias("t")).where("doc is not null and t rlike '[^\\\\s\\\\p{Z}]'")
    seen = cut(_first_verdicts(docs).select("doc", "source", "n", "octets", "first"))

    # lengths in characters and in bytes at which a source's texts were cut far more often than at those around
    sizes = F.explode(F.array(F.struct(F.lit("n").alias("unit"), F.col("n").alias("size")), F.struct(F.lit("octets").alias("unit"), F.col("octets").alias("size"))))
    openly = seen.where("first not in ('whole', 'doubt')").select("source", sizes.alias("s")).groupBy("source", "s.unit", "s.size").agg(F.count(F.lit(1)).alias("c"))
    near = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-10, 10)
    spikes = openly.withColumn("around", F.sum("c").over(near) - F.col("c")).where(f"c >= {least_spike} and c >= around")
    limit = lambda unit: spikes.where(F.col("unit") == unit).select(F.coalesce("source", F.lit("")).alias("of"), F.col("size").alias(unit), F.lit(True).alias(f"limit_{unit}"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    copies = docs.select("doc", F.xxhash64("t").alias("h1"), F.hash("t").alias("h2")).join(strict_prefixes(docs), ["h1", "h2"]).select("doc", F.lit(True).alias("copy")).distinct()
    e = seen.withColumn("of", F.coalesce("source", F.lit(""))).join(limit("n"), ["of", "n"], "left").join(limit("octets"), ["of", "octets"], "left").join(copies, "doc", "left").withColumn("at_limit", flag("limit_n") | flag("limit_octets"))
    evidence = F.when(~F.col("first").isin("whole", "doubt"), F.col("first")).when(F.col("first") == "doubt", F.when(flag("copy"), "copy").when(F.col("at_limit"), "limit"))
    return e.select("doc", "source", "n", evidence.isNotNull().alias("truncated"), evidence.alias("evidence"), (F.col("at_limit") & (F.col("first") != "whole")).alias("at_limit"))


def truncated_ids(df: DataFrame, key: str = "doc_id", **columns: str) -> DataFrame:
    return judged(df, key, **columns).where("truncated").select(F.col("doc").alias(key)).distinct()


def source_rates(df: DataFrame, **columns: str) -> DataFrame:
    """(source, n_docs, n_truncated, share): how often each source cuts its texts; all its documents count."""
    key, source = columns.get("key", "doc_id"), columns.get("source_col", "source")
    cases = truncated_ids(df, **columns).withColumn("cut", F.lit(1))
    rows = df.groupBy(F.col(key)).agg(F.min(source).alias("source"))
    n, c = F.count(F.lit(1)), F.coalesce(F.sum("cut"), F.lit(0))
    return rows.join(cases, key, "left").groupBy("source").agg(n.alias("n_docs"), c.alias("n_truncated"), F.round(c / n, 4).alias("share"))
