import pytest
from pyspark.sql import functions as F

from vellum.operators import answer, retrieve

QUERY = "query_id long, question string, query_vec array<double>, top_k int, alpha double"


def bm25(spark, docs, question):
    c = spark.createDataFrame(list(enumerate(docs)), "chunk_ord long, content string")
    q = spark.createDataFrame([(1, question, None, None, None)], QUERY)
    return {r.chunk_ord: (r.score, r.norm) for r in retrieve.bm25_scores(q, retrieve.TermIndex.build(c)).collect()}


def test_bm25(spark):
    docs = ["aa bb cc dd ee", "ff gg hh ii", "jj kk ll mm", "ff nn oo pp"]
    got = bm25(spark, docs, "gg")
    assert got[1][0] == pytest.approx(0.870336, abs=1e-6) and got[1][1] == 1.0
    assert bm25(spark, docs, "ff")[1] == (0.0, 0.0)
    assert bm25(spark, docs, "gg gg")[1][0] == pytest.approx(2 * 0.870336, abs=2e-6)
    assert bm25(spark, [None, ""], "gg") == {}


def fused(spark, alpha, k, dense, norm):
    q = spark.createDataFrame([(1, "q", None, k, alpha)], QUERY)
    d = spark.createDataFrame([(1, c, s) for c, s in dense], "query_id long, chunk_ord long, dense double")
    b = spark.createDataFrame([(1, c, s, s) for c, s in norm], "query_id long, chunk_ord long, score double, norm double")
    return [(r.chunk_ord, r.score) for r in retrieve.fused(q, retrieve.ranked(d, "dense", 50), b).orderBy("rank").collect()]


def test_fusion(spark):
    assert fused(spark, 0.7, None, [(1, 0.5)], [(1, 1.0), (2, 1.0)]) == [(1, 0.65), (2, 0.3)]
    assert fused(spark, 0.0, None, [(1, 0.5)], [(2, 1.0)]) == [(2, 1.0), (1, 0.0)]
    assert len(fused(spark, None, 0, [(i, 0.5) for i in range(20)], [])) == 10
    assert fused(spark, 0.7, 3, [], []) == []


def test_dense_skips_unusable_vectors(spark):
    v = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 1.0])], "chunk_ord long, embedding array<double>")
    q = spark.createDataFrame([(1, "q", [1.0, 0.0], None, None), (2, "q", None, None, None)], QUERY)
    got = [(r.query_id, r.chunk_ord, round(r.dense, 4)) for r in retrieve.dense_topk(q, v, 5).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (1, 6, 0.7071)]
    assert retrieve.dense_topk(q.limit(0), v, 5).count() == 0


def test_dense_only_without_a_term_index(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "chunk_ord long, embedding array<double>")
    q = spark.createDataFrame([(1, "q", [1.0, 0.0], 2, 0.1)], QUERY)
    got = retrieve.hybrid_search(q, v, None).orderBy("rank").collect()
    assert [(r.chunk_ord, r.score) for r in got] == [(0, 1.0), (1, 0.7071)]


def test_parents(spark):
    hits = spark.createDataFrame([(1, i, p, f"c{i}") for i, p in enumerate(["p1", "p1", None, "x", "x"], 1)], "query_id long, rank int, parent_id string, content string")
    parents = spark.createDataFrame([("p1", "P")], "parent_id string, content string")
    got = [r.resolved for r in retrieve.resolve_parents(hits, parents).orderBy("rank").collect()]
    assert got == ["P", "c3", "c4", "c5"]
    assert retrieve.resolve_parents(hits, parents, once=False).count() == 5


def test_labels_and_context(spark):
    h = spark.createDataFrame([(1, 1, 5, None, "table", "T 1", " a "), (1, 2, None, "S", None, "", "b")], "query_id long, rank int, page int, section_heading string, chunk_type string, caption string, content string")
    c = answer.citations(h)
    assert [r.citation for r in c.orderBy("rank").collect()] == ["Page 5, table, T 1", "Page ?, S, text"]
    assert answer.contexts(c).first().context == "[Source 1: Page 5, table, T 1]\na\n\n---\n\n[Source 2: Page ?, S, text]\nb"


@pytest.mark.parametrize(("age", "wanted"), [(0, "today"), (86_400_000, "previous 7 days"), (7 * 86_400_000, "older")])
def test_chat_bucket(spark, age, wanted):
    assert spark.range(1).select(answer.chat_bucket(F.lit(10**12), F.lit(10**12 - age)).alias("x")).first().x == wanted
