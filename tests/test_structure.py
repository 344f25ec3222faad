import pytest
from pyspark.sql import functions as F

from vellum.operators import structure as s
from vellum.operators import tables

PAGE = "doc_id string, page_num int, raw_text string"


def test_page_classes(spark):
    body = "x" * 600
    rows = [("d", 1, "x" * 49), ("d", 1, "x" * 200), ("d", 9, body + " prepared by"), ("d", 9, body), ("d", 9, body + "\nAPPENDIX B\n"), ("d", 9, body + "\nContents\n"), ("d", 9, None)]
    got = [r.category for r in s.classified(spark.createDataFrame(rows, PAGE)).collect()]
    assert got == ["blank", "title_page", "title_page", "body", "appendix", "toc", "blank"]


def test_starts(spark):
    p = spark.createDataFrame([("d", 1, "blank"), ("d", 3, "body"), ("d", 9, "appendix"), ("e", 1, "toc")], "doc_id string, page_num int, category string")
    got = {r.doc_id: (r.total_pages, r.body_start, r.appendix_start) for r in s.document_starts(p).collect()}
    assert got == {"d": (3, 3, 9), "e": (1, 1, None)}


def test_toc(spark):
    rows = [("d", 2, "2.3 Section Title ........ 42\nPreface    7\nno entry")]
    got = [(r.number, r.title, r.target_page, r.level) for r in s.toc_entries(spark.createDataFrame(rows, PAGE)).collect()]
    assert got == [("2.3", "Section Title", 42, 2), ("", "Preface", 7, 0)]


def test_headings():
    t = "1.2 Scope\nChapter 3: Design\nAppendix A - Data\nxx\nRISK MANAGEMENT PLAN"
    assert [(n, x) for _, n, x in s.find_headings(t)] == [("1.2", "Scope"), ("", "Chapter 3 Design"), ("", "Appendix A Data"), ("", "Risk Management Plan")]
    assert s.find_headings(None) == []


def test_captions():
    assert s.find_captions("x\nFigure 2.3-1: Engine View.\nFig. 5: Overview of it") == [(1, "figure", "2.3-1", "Engine View"), (28, "figure", "5", "Overview of it")]


def test_references(spark):
    df = spark.createDataFrame([("[1], [2-4] and [1] (Smith, 2020), (Smith & Jones, 2019b), (Smith et al., 2021)\n12 Note",), (None,)], "t string")
    got = [[(x.pattern, x.match) for x in r.r] for r in df.select(s.references(F.col("t")).alias("r")).collect()]
    assert got == [[("bracket_numeric", "1"), ("bracket_numeric", "2-4"), ("author_year", "Smith, 2020"), ("author_year", "Smith & Jones, 2019b"), ("footnote", "12")], []]


@pytest.mark.parametrize(("page", "offset", "use", "wanted"), [(3, 0, False, "first"), (4, 0, False, "second"), (3, 50, True, "second"), (3, 50, False, "first"), (1, 0, False, "")])
def test_heading_as_of(spark, page, offset, use, wanted):
    heads = spark.createDataFrame([("d", 2, 0, 5, "first"), ("d", 3, 0, 40, "second")], "doc_id string, page int, ord int, char_offset int, label string")
    c = spark.createDataFrame([("d", page, offset, "old")], "doc_id string, page int, start_char int, section_heading string")
    assert s.heading_as_of(c, heads, use).first().section_heading == wanted


def test_nearest_captions(spark):
    items = spark.createDataFrame([("d", "i", 5), ("d", "far", 9)], "doc_id string, item_id string, page int")
    caps = spark.createDataFrame([("d", k, p, o, i, k + str(p)) for i, (k, p, o) in enumerate([("figure", 4, 90), ("figure", 6, 10), ("table", 4, 90), ("table", 6, 10)])], "doc_id string, kind string, page int, char_offset int, ord int, label string")
    caps = caps.withColumns({"number": F.lit("1"), "text": F.lit("t")})
    of = lambda kind, by: {r.item_id: r.label for r in s.nearest_caption(items, caps, kind, by_offset=by).collect()}
    assert of("figure", True) == {"i": "figure6", "far": None}
    assert of("table", False) == {"i": "table4", "far": None}


def test_edge_lines(spark):
    rows = [("d", i, f"Manual X\nPage {i} of 9\nbody {i}a\nbody b{i}\nc{i}\nfoot line") for i in range(1, 9)] + [("e", 1, None)]
    pages = spark.createDataFrame(rows, PAGE)
    edges = s.edge_lines(pages)
    assert {(r.side, r.line, r.n) for r in edges.collect()} == {("header", "Manual X", 8), ("header", "Page # of #", 8), ("footer", "foot line", 8)}
    assert s.strip_edge_lines(pages, edges).where("page_num = 1 and doc_id = 'd'").first().text == "body 1a\nbody b1\nc1"


def test_boxes(spark):
    df = spark.sql("select named_struct('x0',0,'y0',0,'x1',2,'y1',2) a, named_struct('x0',2,'y0',2,'x1',3,'y1',3) b, named_struct('x0',3,'y0',0,'x1',4,'y1',1) c, cast(null as struct<x0:int,y0:int,x1:int,y1:int>) n")
    r = df.select(s.boxes_overlap(F.col("a"), F.col("b")).alias("x"), s.boxes_overlap(F.col("a"), F.col("c")).alias("y"), s.boxes_overlap(F.col("n"), F.col("c")).alias("z")).first()
    assert (r.x, r.y, r.z) == (True, False, True)


def test_bands(spark):
    df = spark.sql("select array(named_struct('top', 100.0, 'bottom', 200.0), named_struct('top', 202.0, 'bottom', 300.0)) b, 800.0 h")
    assert [(x.top, x.bottom) for x in df.select(tables.page_bands(F.col("b"), F.col("h")).alias("x")).first().x] == [(0.0, 100.0), (300.0, 800.0)]


def test_table_expressions(spark):
    df = spark.sql("select array(72.04D, 75D, 85D, 315.2D) x, array(0D,10D,20D) a, array(10D) b, array('a','b') h, array(array('1','2')) r, array(array(' x  y ', null), array('p','q')) c")
    r = df.select(
        tables.column_signature(F.col("x")).alias("s"), tables.column_match(F.col("a"), F.col("b")).alias("m"), tables.column_match(F.col("b"), F.col("a")).alias("n"),
        tables.table_text(F.col("h"), F.col("r")).alias("t"), tables.clean_rows(F.col("c")).alias("c"),
    ).first()
    assert r.s == [70.0, 80.0, 80.0, 320.0]
    assert (r.m, round(r.n, 3)) == (1.0, 0.333)
    assert r.t == "a | b\n-----\n1 | 2" and r.c == [["p", "q"]]


def test_stitching(spark):
    rows = [("d", p, 0, 10.0, 90.0, [72.0, 200.0], [["h", "k"], ["1", str(p)], ["2", "x"]]) for p in (1, 2)] + [("d", 5, 0, 10.0, 90.0, [72.0, 200.0], [["h", "k"], ["3", "y"]])]
    f = spark.createDataFrame(rows, "doc_id string, page int, table_ord int, top double, bottom double, col_xs array<double>, rows array<array<string>>")
    got = sorted((r.table_id, r.pages, len(r.rows)) for r in tables.stitch(f).collect())
    assert got == [("p1_t1", [1, 2], 4), ("p5_t2", [5], 1)]  # tables are counted through the document
    assert tables.table_chunks(tables.stitch(f)).count() == 2 + 5


def test_links_meet_chunks_by_the_first_of_each_page(spark):
    links = spark.createDataFrame([("d", p, i, f"u{p}-{i}") for p in (1, 2) for i in range(20)] + [("d", 3, 0, "x"), ("d", 3, 0, "x")], "doc_id string, page int, ord int, uri string")
    chunks = spark.createDataFrame([("d", 1, [2, 1]), ("d", 2, [3, 3, 2]), ("d", 3, [4]), ("d", 4, None)], "doc_id string, chunk_id long, pages array<int>")
    got = s.links_by_page(chunks, links)
    assert {r.chunk_id: r.links for r in got.collect()} == {1: [f"u1-{i}" for i in range(5)], 2: [f"u2-{i}" for i in range(5)], 3: [], 4: []}
    assert "row_number" in got._jdf.queryExecution().optimizedPlan().toString()  # not all links of a page with all its chunks
