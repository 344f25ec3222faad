"""Repair of text from scanned pages: page furniture, words broken over lines, misrecognised words.

Edge lines: a line's letters are folded over the usual confusions, numbers left out; foldings that come up in a good
share of a document's scanned chunks are its running heads and feet, bare numbers in their usual dress are page
numbers. Hyphens: a word broken over lines is joined, with or without its hyphen, by which form the corpus has
more often. Misrecognitions: every word of the corpus has an anagram hash (the sum of fifth powers of its
characters); a word that native text hardly has is joined with frequent words whose hash differs by that of a known
confusion, once or twice; the candidates are verified by edit distance and ranked by frequency.

The lexicon and the line counts cover all chunks and are aggregated per task before the shuffle; the corrections are
broadcast only below a row bound, otherwise joined by shuffle.

Defined results: chunks that are null, blank, not scanned or no prose have no rows; rows are distinct, so redelivered
chunks count once; a null document id is a document of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import cut
from . import quality
from .textkit import DIGIT, LETTER, TextBatch, mix, pieces

# What recognition makes of characters, as (seen, meant).
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("o", "a"), ("a", "o"), ("f", "t"), ("t", "f"), ("0", "o"), ("5", "s"), ("l", "i"), ("i", "l"), ("1", "i"), ("1", "l"),
    ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("ii", "n"), ("ii", "u"),
    ("v", "u"), ("u", "v"), ("v", "y"), ("y", "v"), ("b", "h"), ("h", "b"), ("q", "g"), ("g", "q"), ("6", "b"), ("8", "b"), ("9", "g"), ("2", "z"), ("4", "a"), ("3", "e"), ("7", "t"),
)
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Share of a document's scanned chunks in which a line must come up to be a running head or foot.
FURNITURE_SHARE = 0.05
#: Rows below which a table is broadcast.
BROADCAST_ROWS = 200_000

_LIGATURES = str.maketrans(LIGATURES)
_FOLD = str.maketrans({"1": "i", "l": "i", "|": "i", "0": "o", "a": "o", "4": "o", "5": "s", "e": "c", "t": "f", "6": "b", "h": "b", "v": "u", "y": "u", "q": "g", "2": "z", "8": "b", "9": "g"})
_TOKEN = re.compile(r"[^\W_]+")
_PAGE = re.compile(r"\W*(?:p(?:age|\.|g\.)?\s*)?(?:\d{1,4}|[ivxlc]{1,6})(?:\s*(?:-|–|/|of)\s*\d{1,4})?\W*", re.I)
_DIGIT_LIKE = str.maketrans("lI|iOoSsBZz", "11110055822")
_BREAK = re.compile(r"([^\W_]+(?:[-‐'’][^\W_]+)*)[-‐‑¬\xad]\s*$")
_FIRST = re.compile(r"\s*[\"'“‘(\[]?([^\W_]+(?:[-‐'’][^\W_]+)*)")
_WORD = re.compile(r"[^\W_]+(?:[-‐‑][^\W_]+)*")
_CODE = re.compile(r"[A-Za-z]{1,3}[-‐‑][\dOoIlSsBb.]+|[A-Z]?\d[\d.,]*[A-Z]?|[A-Z]{1,2}\d+")


def folded(line: str) -> str:
    """The letters of a line over classes of characters that recognition confuses, without numbers."""
    out = []
    for t in _TOKEN.findall(line.lower().translate(_LIGATURES)):
        if not t.isdigit():
            out.append(t.replace("rn", "m").replace("cl", "d").replace("ri", "n").replace("vv", "w").translate(_FOLD))
    return " ".join(out)


def is_page_number(line: str) -> bool:
    """A number in the usual dress alone on its line; letters that pass for digits are read as such beside a digit."""
    t = line.strip()
    if _PAGE.fullmatch(t):
        return True
    return any(map(str.isdigit, t)) and _PAGE.fullmatch(t.translate(_DIGIT_LIKE)) is not None


def _line_hash(keys: list[str]) -> list[int]:
    b = TextBatch(keys)
    return mix(b.hashes(b.off[:-1], b.off[1:] - 1)).view(np.int64).tolist()


def scanned(source: Column) -> Column:
    return F.lower(F.trim(source)).contains("ocr")


def _survey(chunks: DataFrame) -> DataFrame:
    """One pass over (doc, t, scan): word counts, folded line counts and chunk counts of each task."""
    names = ["kind", "word", "doc", "line", "native", "scan"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[int, list] = {}
        lines: Counter[tuple[str, int]] = Counter()
        docs: Counter[str] = Counter()

        def count(b: TextBatch, starts: np.ndarray, ends: np.ndarray, scan: np.ndarray) -> None:
            h, row = b.hashes(starts, ends), b.rows_of(starts)
            for flag in (False, True):
                at = np.flatnonzero(scan[row] == flag)
                u, first, n = np.unique(h[at], return_index=True, return_counts=True)
                for key, i, c in zip(u.tolist(), at[first].tolist(), n.tolist(), strict=True):
                    got = words.get(key)
                    if got is None:
                        text = b.codes[starts[i] : ends[i]].tobytes().decode("utf-32-le", "replace").lower()
                        got = words[key] = [text, 0, 0]
                    got[1 + flag] += c

        for batch in batches:
            for part in pieces(batch, "t"):
                texts, scan = part.column("t").to_pylist(), np.asarray(part.column("scan"))
                b = TextBatch(texts)
                alnum = (b.cls & (LETTER | DIGIT)) != 0
                s, e = b.runs(LETTER | DIGIT)
                letters = np.concatenate([[0], np.cumsum((b.cls & LETTER) != 0)])
                keep = letters[e] > letters[s]
                count(b, s[keep], e[keep], scan)
                hyphen = (b.codes == 0x2D) | (b.codes == 0x2010) | (b.codes == 0x2011)
                inner = np.zeros(len(alnum), bool)
                inner[1:-1] = hyphen[1:-1] & alnum[:-2] & alnum[2:]
                d = np.diff(np.concatenate([[0], (alnum | inner).view(np.int8), [0]]))
                s, e = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
                hyphens = np.concatenate([[0], np.cumsum(inner)])
                digits = np.concatenate([[0], np.cumsum((b.cls & DIGIT) != 0)])
                keep = (hyphens[e] > hyphens[s]) & (digits[e] == digits[s])
                count(b, s[keep], e[keep], scan)
                found = []
                for t, is_scan, doc in zip(texts, scan.tolist(), part.column("doc").to_pylist(), strict=True):
                    if is_scan and t:
                        docs[doc] += 1
                        found += [(doc, k) for k in {folded(x) for x in t.split("\n")} if k]
                for (doc, _), h in zip(found, _line_hash([k for _, k in found]), strict=True):
                    lines[doc, h] += 1
        rows = [("word", w.replace("‐", "-").replace("‑", "-"), None, None, n, c) for w, n, c in words.values()]
        rows += [("line", None, d, h, None, n) for (d, h), n in lines.items()]
        rows += [("doc", None, d, None, None, n) for d, n in docs.items()]
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*rows[i : i + 20_000], strict=True), types, strict=True)], names=names)

    return chunks.mapInArrow(run, "kind string, word string, doc string, line long, native long, scan long")


def lexicon(survey: DataFrame) -> DataFrame:
    return survey.where("kind = 'word'").groupBy("word").agg(F.sum("native").alias("native"), F.sum("scan").alias("scan"))


def furniture(survey: DataFrame, share: float = FURNITURE_SHARE, least: int = 3) -> DataFrame:
    """(doc, lines): hashes of the foldings that are running heads or feet of the document."""
    n = survey.where("kind = 'doc'").groupBy("doc").agg(F.sum("scan").alias("chunks"))
    lines = survey.where("kind = 'line'").groupBy("doc", "line").agg(F.sum("scan").alias("n")).where(F.col("n") >= least)
    return lines.join(n, "doc").where(F.col("n") >= share * F.col("chunks")).groupBy("doc").agg(F.collect_list("line").alias("lines"))


def anagram_sql(word: str) -> str:
    """Sum of the fifth powers of the characters' codes."""
    return f"aggregate(split({word}, ''), 0L, (s, c) -> s + if(c = '', 0L, cast(ascii(c) as bigint) * ascii(c) * ascii(c) * ascii(c) * ascii(c)))"


def corrections(lex: DataFrame, ratio: int = 300, least: int = 3) -> DataFrame:
    """(word, fix): the best frequent word that a rare word is a misrecognition of.

    Rare means that native text has at most one of it for ``ratio`` of the frequent word; ligature characters are
    written out first.
    """
    plain = F.col("word")
    for a, b in LIGATURES.items():
        plain = F.replace(plain, F.lit(a), F.lit(b))
    words = lex.where("not contains(word, '-')").withColumn("plain", plain)
    good = words.where(f"native >= {least} and word rlike '^[\\\\p{{L}}]+$' and word = plain").select(F.col("word").alias("fix"), F.col("native").alias("n"))
    power = lambda s: sum(ord(c) ** 5 for c in s)
    diffs: dict[int, int] = {0: 0}
    for seen, meant in CONFUSIONS:
        for times in (1, 2):
            diffs.setdefault((power(meant) - power(seen)) * times, times * max(len(seen), len(meant)))
    known = F.array(*(F.struct(F.lit(d).cast("long").alias("d"), F.lit(edits).alias("edits")) for d, edits in diffs.items()))
    # words of native text that no misrecognition could be are left out before the differences are applied
    rare = words.where("scan > 0 or word <> plain").select("word", "plain", "native", F.explode(known).alias("k"))
    rare = rare.select("word", "plain", "native", (F.expr(anagram_sql("plain")) + F.col("k.d")).alias("h"), F.col("k.edits").alias("edits"), (F.col("k.d") == 0).alias("same"))
    pairs = rare.join(good.withColumn("h", F.expr(anagram_sql("fix"))), "h")
    ok = pairs.where(f"fix <> word and native * {ratio} <= n and if(same, fix = plain, levenshtein(plain, fix, 5) between 1 and edits + 1)")
    # levenshtein of a two-for-one confusion is 2; an anagram of equal letters in other places isn't a confusion
    near = ok.where("same or levenshtein(plain, fix, 5) <= edits")
    best = F.struct(F.when(F.col("same"), 0).otherwise(F.col("edits")).alias("e"), (-F.col("n")).alias("n"), F.col("fix").alias("f"))
    return near.groupBy("word").agg(F.min(best).alias("b")).select("word", F.col("b.f").alias("fix"))


def _sites(pages: DataFrame, suspects) -> DataFrame:
    """(id, line_no, kind, word, hyphened) of (id, t, lines): furniture, words broken over lines, words to correct.

    ``suspects`` is a broadcast set of the words that have a correction, or None if they are too many; then all words
    come out and the join with the corrections decides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong = suspects.value if suspects else None
        for batch in batches:
            rows: list[tuple] = []
            for key, text, known in zip(*(batch.column(c).to_pylist() for c in ("id", "t", "lines")), strict=True):
                lines = text.split("\n")
                hashes = _line_hash([folded(x) for x in lines])
                heads = set(known or ())
                body = []
                for i, (line, h) in enumerate(zip(lines, hashes, strict=True), 1):
                    if not line.strip():
                        continue
                    if h in heads or is_page_number(line):
                        rows.append((key, i, "edge", "", None))
                    else:
                        body.append((i, line))
                skip = 0
                for k, (i, line) in enumerate(body):
                    end, follow = len(line), None
                    if k + 1 < len(body) and (m := _BREAK.search(line)) and (f := _FIRST.match(body[k + 1][1])) and f.group(1)[0].isalpha() and any(map(str.isalpha, m.group(1))):
                        a, b = m.group(1).lower().replace("‐", "-"), f.group(1).lower().replace("‐", "-")
                        rows.append((key, i, "broken", a + b, f"{a}-{b}"))
                        end, follow = m.start(1), f.end(1)
                    for w in set(_WORD.findall(line[skip:end])):
                        if not w.isdigit() and not _CODE.fullmatch(w):
                            low = w.lower().replace("‐", "-").replace("‑", "-")
                            if wrong is None or low in wrong or "-" in low and not wrong.isdisjoint(low.split("-")):
                                rows.append((key, i, "word", low, None))
                    skip = follow or 0
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.string()) for x in c[2:])], names=["id", "line_no", "kind", "word", "hyphened"])

    return pages.mapInArrow(run, "id long, line_no int, kind string, word string, hyphened string")


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast if small, by a count."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def repairs(chunks: DataFrame, rules: quality.RuleList, key: str = "chunk_ord", text_col: str = "content", source_col: str = "source", doc_col: str = "doc_id") -> DataFrame:
    """(key, line_no, fix): lines to drop (empty fix) and words to put right in scanned prose."""
    rows = chunks.select(
        F.col(key).cast("long").alias("id"), F.coalesce(F.col(doc_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).alias("t"), F.coalesce(scanned(F.col(source_col)), F.lit(False)).alias("scan")
    ).where("id is not null and t is not null")
    survey = cut(_survey(rows.select("doc", "t", "scan")))
    lex = lexicon(survey)
    fixes = cut(corrections(lex))
    prose = quality.classify_prose(rows.where("scan"), rules, "t").where("is_prose = 1").select("id", "doc", "t")
    pages = prose.join(_sized(furniture(survey)), "doc", "left").select("id", "t", "lines")
    few = fixes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    suspects = chunks.sparkSession.sparkContext.broadcast(frozenset(r.word for r in fixes.select("word").toLocalIterator())) if few else None
    sites = cut(_sites(pages, suspects).distinct())
    edge = sites.where("kind = 'edge'").select("id", "line_no", F.lit("").alias("fix"))

    # a compound is put right part by part
    parts = sites.where("kind = 'word'").select("id", "line_no", "word", F.posexplode(F.split("word", "-")).alias("i", "part"))
    fixed = parts.join(_sized(fixes.withColumnRenamed("word", "part")), "part", "left")
    simple = fixed.where("not contains(word, '-') and fix is not null").select("id", "line_no", "fix")
    compound = (
        fixed.where("contains(word, '-')").groupBy("id", "line_no", "word")
        .agg(F.expr("array_join(transform(array_sort(collect_list(struct(i, coalesce(fix, part) as p))), x -> x.p), '-')").alias("fix"), F.max(F.col("fix").isNotNull()).alias("any"))
        .where("any").select("id", "line_no", "fix")
    )

    broken = sites.where("kind = 'broken'").select("id", "line_no", "word", "hyphened")
    forms = broken.select(F.explode(F.array("word", "hyphened")).alias("form")).distinct()
    seen = cut(forms.join(lex.withColumnRenamed("word", "form"), "form", "left").join(fixes.withColumnRenamed("word", "form"), "form", "left").select("form", (F.coalesce("native", F.lit(0)) + F.coalesce("scan", F.lit(0))).alias("n"), "fix"))
    # a whole word that occurs only broken is checked against the frequent words as well
    unseen = corrections(seen.where("n = 0 and not contains(form, '-')").select(F.col("form").alias("word"), F.lit(0).cast("long").alias("native"), F.lit(1).cast("long").alias("scan")).unionByName(lex.where("native >= 3").select("word", "native", F.lit(0).cast("long").alias("scan"))))
    seen = seen.join(unseen.select(F.col("word").alias("form"), F.col("fix").alias("found")), "form", "left").select("form", "n", F.coalesce("fix", "found").alias("fix"))
    one = seen.select(F.col("form").alias("word"), F.col("n").alias("n1"), F.col("fix").alias("fix1"))
    two = seen.select(F.col("form").alias("hyphened"), F.col("n").alias("n2"))
    joined = broken.join(one, "word").join(two, "hyphened")
    whole = joined.select("id", "line_no", F.when(F.col("fix1").isNotNull() & (F.col("n2") <= 1), F.col("fix1")).when(F.col("n2") > F.col("n1"), F.col("hyphened")).otherwise(F.col("word")).alias("fix"))
    out = edge.unionByName(simple).unionByName(compound).unionByName(whole)
    return out.distinct().select(F.col("id").alias(key), "line_no", "fix")
