import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellum.functions import scores, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (text.rejoin_hyphenated, "sys-\n tem", "system"),
        (text.strip_page_numbers, "a\n12\n13\n14\nb", "a\n13\nb"),
        (text.strip_page_numbers, "intro\n2020\nx", "intro\nx"),
        (text.strip_watermarks, "drafting samples", "ing s"),
        (text.clean_text, None, ""),
        (text.clean_text, "  ﬁn​ • “x”… ", 'fin - "x"...'),
        (text.header_form, "  Page  12 of 297 ", "Page # of #"),
        (text.corpus_terms, "The Pump's 2 valves", ["pump", "valves"]),
        (text.query_terms, "other pump", ["other", "pump"]),
        (text.corpus_terms, "other pump", ["pump"]),
        (text.token_len, "   ", 0),
    ],
)
def test_functions(spark, f, given, wanted):
    assert one(spark, given, f) == wanted


def test_shingles(spark):
    of = lambda t: sorted(one(spark, t, lambda c: text.shingles(text.words(c))))
    assert of("A b c b") == ["a b c", "b c b"]
    assert of("a b") == ["a b"]
    assert of("") == []


def test_jaccard(spark):
    row = spark.sql("select array('a','b','c','d') a, array('a','b','c','e') b, cast(array() as array<string>) e").select(
        text.jaccard(F.col("a"), F.col("b")).alias("x"), text.jaccard(F.col("e"), F.col("e")).alias("y"), text.jaccard(F.col("a"), F.col("e")).alias("z")
    ).first()
    assert (row.x, row.y, row.z) == (0.6, 1.0, 0.0)


@pytest.mark.parametrize(("n", "limit", "overlap", "wanted"), [(10, 4, 1, [(0, 4), (3, 7), (6, 10)]), (10, 4, 0, [(0, 4), (4, 8), (8, 10)]), (4, 4, 1, [(0, 4)]), (0, 4, 1, [])])
def test_word_windows(spark, n, limit, overlap, wanted):
    t = " ".join(f"w{i}" for i in range(n))
    got = one(spark, t, lambda c: text.word_windows(text.split_words(c), limit, overlap))
    assert got == [" ".join(f"w{i}" for i in range(a, b)) for a, b in wanted]


def test_word_windows_refuse_endless_overlap():
    with pytest.raises(ValueError):
        text.word_windows(F.col("t"), 4, 4)


@pytest.mark.parametrize(("n", "wanted"), [(9, 0), (10, 0.6), (50, 1), (51, 1), (500, 1), (2000, 0.7), (2001, 0.3)])
def test_length_score(spark, n, wanted):
    assert spark.range(1).select(scores.length_score(F.lit(n)).alias("x")).first().x == pytest.approx(wanted)


@pytest.mark.parametrize(("t", "wanted"), [("Page 42 of 297", 0.533), ("42", 0.390), ("..... 42", 0.318), ("", 0.300), (None, 0.300)])
def test_quality(spark, t, wanted):
    df = spark.createDataFrame([(t, "text")], "t string, k string")
    assert df.select(scores.quality(F.col("t"), F.col("k")).alias("q")).first().q.quality_score == pytest.approx(wanted)


def test_entropy(spark):
    t = "Hello, wörld! " * 3
    counts = Counter(t.lower())
    wanted = -sum(c / len(t) * math.log2(c / len(t)) for c in counts.values())
    assert one(spark, t, scores.char_entropy) == pytest.approx(wanted)
