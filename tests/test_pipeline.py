import shutil
import time

import pytest
from pyspark.sql import functions as F

from vellum.config import Settings
from vellum.plans.pipeline import IngestPipeline, QnAPipeline, assembled, health
from vellum.operators import tables
from vellum.sources import providers, uploads
from vellum.sources.artefacts import Artefacts
from vellum.streaming import ingest

BODY = "The pump housing is bolted to the frame and sealed with a gasket before the test. " * 8


def pages(spark):
    rows = [("a", i, f"{i}.1 Scope of part {i}\n{BODY} Item number {'x' * i} is stored in hall {i}.") for i in range(3, 9)] + [("b", 3, "Valves are opened slowly when the pressure settles. " * 10), ("b", 4, None)]
    return spark.createDataFrame(rows, "doc_id string, page_num int, raw_text string")


TABLE_ROWS = [["size", "kind"], ["3", "gate"], ["4", "ball"], ["", "x"]]


def inputs(spark):
    tables = spark.createDataFrame([("a", 4, 0, 10.0, 90.0, [72.0, 200.0], TABLE_ROWS), ("a", 5, 0, 10.0, 90.0, [72.0, 201.0], [["size", "kind"], ["9", "cone"]]), ("b", 1, 0, 1.0, 9.0, [72.0], TABLE_ROWS)], "doc_id string, page int, table_ord int, top double, bottom double, col_xs array<double>, rows array<array<string>>")
    images = spark.createDataFrame([("a", 6, 1, 300, 200, bytearray(b"png"), False), ("a", 6, 2, 10, 10, bytearray(b"x"), False), ("a", 7, 3, 300, 200, bytearray(b""), True)], "doc_id string, page int, xref int, width int, height int, data binary, is_vector boolean")
    links = spark.createDataFrame([("a", 4, i, f"u{i}") for i in range(7)], "doc_id string, page int, ord int, uri string")
    return {"tables": tables, "images": images, "links": links, "describe": lambda d: f"A pump, {len(d)} bytes." if d else ""}


def captioned(spark):
    extra = {4: "\nTable 4-1: Kinds of valves.", 6: "\nFigure 6.2: View of the pump.\nFigure 9: Another view of it."}
    rows = [(r.doc_id, r.page_num, r.raw_text and r.raw_text + extra.get(r.page_num, "") if r.doc_id == "a" else r.raw_text) for r in pages(spark).collect()]
    rows.append(("s", 1, ""))
    df = spark.createDataFrame(rows, "doc_id string, page_num int, raw_text string")
    return df.withColumn("images", F.when(F.col("doc_id") == "s", 1).otherwise(0)).withColumn("ocr_text", F.when(F.col("doc_id") == "s", F.lit("Read from a scanned page of the manual. " * 4)))


def test_chunks_of_all_kinds(spark):
    made = assembled(captioned(spark), Settings(header_share=2.0), **inputs(spark))  # no line is a running head
    got = {}
    for r in made["chunks"].orderBy("chunk_ord").collect():
        got.setdefault((r.doc_id, r.chunk_type), []).append(r)
    table = got["a", "table"]
    assert [(r.row, r.page, r.pages) for r in table] == [(-1, 4, [4, 5]), (0, 4, [4, 5]), (1, 4, [4, 5]), (2, 4, [4, 5])]
    assert table[0].content == "Table 4-1\n\nsize | kind\n-----------\n3 | gate\n4 | ball\n9 | cone" and table[1].content == "Table 4-1\nsize | kind\n3 | gate"
    assert (table[0].caption, table[0].caption_label, table[0].number) == ("Kinds of valves", "Table 4-1", "4-1")
    assert table[0].links == ["u0", "u1", "u2", "u3", "u4"] and table[1].links == [] and table[0].section_heading == "§4.1 Scope of part 4"
    (image,) = got["a", "image"]
    assert image.content == "Figure 6.2\n\nA pump, 3 bytes." and image.source == "vision_llm" and image.image_b64 == "cG5n" and image.pages == [6]
    (scan,) = got["s", "ocr_text"]
    assert scan.source == "ocr" and scan.content.startswith("Read from") and scan.doc_region == "blank"
    text = got["a", "text"]
    assert [r.page for r in text] == sorted(r.page for r in text) and {len(r.links) for r in text if r.page == 4} == {5} and {len(r.links) for r in text if r.page == 5} == {0}
    assert ("b", "table") not in got  # its page is no content page
    order = [r.doc_id + r.chunk_type for r in made["chunks"].orderBy("chunk_ord").collect()]
    assert order == sorted(order, key=lambda x: (x[0], {"table": 0, "text": 1, "ocr_text": 1, "image": 2}[x[1:]]))


def test_settings_act(spark):
    off = {f"enable_{x}": False for x in ("ocr", "vision", "captions", "structure", "parent_child", "cleaning")}
    made = assembled(captioned(spark), Settings(min_cells=1, **off), **inputs(spark))
    rows = made["chunks"].collect()
    assert {r.chunk_type for r in rows} == {"text", "table"} and {r.doc_region for r in rows} == {"body"}
    assert not any(r.caption or r.parent_id for r in rows) and made["parents"] is None and made["edges"] is None
    assert sum(r.chunk_type == "table" and r.row >= 0 for r in rows) == 3 + 1  # a row with one filled cell counts now


def test_ingest_and_ask(spark, tmp_path):
    store = Artefacts(spark, str(tmp_path / "index"))
    assert not store.ready and health(store, "0")["index_loaded"] is False
    steps = []
    p = captioned(spark)
    again = p.where("doc_id = 'a' and page_num = 5").withColumn("page_num", F.lit(9))  # an exact copy of a page, but for its heading's place
    got = IngestPipeline(store, on_step=lambda i, name: steps.append(i)).run(p.union(again), **inputs(spark))
    assert steps == [1, 2, 3, 4, 5] and got["n_chunks"] == store.load("chunks").count() > 0 and store.ready
    stats = got["stats"].first().asDict()
    assert stats["total_chunks"] == got["n_chunks"] and stats["total_before_dedup"] - stats["low_quality_removed"] - stats["exact_dupes_removed"] - stats["near_dupes_removed"] == stats["total_chunks"]
    assert stats["exact_dupes_removed"] >= 1 and (stats["ocr_pages"], stats["tables_detected"], stats["tables_with_captions"], stats["figures_with_captions"], stats["links_found"]) == (1, 3, 1, 2, 7)
    assert (got["n_tables"], got["embedding_dim"]) == (1, 64) and got["n_parents"] == store.load("parents").count()
    qa = QnAPipeline(store)
    said = qa.ask("When are valves opened?", top_k=2)
    assert said["citations"][0]["pdf_name"] == "b" and "[Source 1]" in said["answer"] and len(said["scores"]) == 2
    kinds = [e["type"] for e in qa.stream("When are valves opened?")]
    assert kinds[-2:] == ["citations", "done"] and kinds[0] == "token"
    shutil.rmtree(store.path("postings"))  # without a term index dense search alone answers
    assert len(qa.ask("When are valves opened?", top_k=3)["citations"]) == 3


def test_failing_model(spark, tmp_path):
    store = Artefacts(spark, str(tmp_path / "index"))
    IngestPipeline(store).run(pages(spark))

    class Failing:
        def generate(self, *_, **__):
            raise OSError("gone")

        def stream(self, *_, **__):
            yield "one "
            raise OSError("gone")

    qa = QnAPipeline(store, model=Failing())
    assert qa.ask("When are valves opened?")["answer"] == "Error: gone"
    assert list(qa.stream("When are valves opened?"))[-1] == {"type": "error", "data": "gone"}


def test_documents_are_replaced(spark, tmp_path):
    store = Artefacts(spark, str(tmp_path / "index"), buckets=2)
    p = pages(spark)
    IngestPipeline(store).run(p)
    before = {r.chunk_ord for r in store.load("chunks").where("doc_id = 'b'").collect()}
    IngestPipeline(store).run(p.where("doc_id = 'a' and page_num < 5"))
    assert {r.page for r in store.load("chunks").where("doc_id = 'a'").collect()} == {3, 4}
    assert {r.chunk_ord for r in store.load("chunks").where("doc_id = 'b'").collect()} == before


def test_no_chunks(spark, tmp_path):
    store = Artefacts(spark, str(tmp_path / "none"))
    assert "error" in IngestPipeline(store).run(pages(spark).limit(0))


def test_stream_takes_each_text_once(spark, tmp_path):
    p = pages(spark)
    p.union(p).repartition(3).write.parquet(str(tmp_path / "landing"))
    store = Artefacts(spark, str(tmp_path / "s"))
    listener = ingest.JobRegistry()
    spark.streams.addListener(listener)
    step = ingest.append_new(store)
    for _ in range(2):  # a restart finds nothing new
        q = ingest.ingest_stream(ingest.landing(spark, str(tmp_path / "landing"), files_per_trigger=1), step, str(tmp_path / "check"))
        q.awaitTermination()
    rows = lambda: sorted((r.doc_id, r.page_num) for r in spark.read.parquet(store.path("pages")).collect())
    assert rows() == sorted((r.doc_id, r.page_num) for r in p.collect())
    before = rows()
    first = spark.createDataFrame([tuple(r) for r in spark.read.parquet(store.path("pages")).where("batch = 0").select(*ingest.PAGE_COLUMNS).collect()], ingest.PAGES)
    step(first, 0)  # a batch that is run again replaces its rows
    assert rows() == before
    for _ in range(100):  # events arrive later than the query ends
        if any(j["status"] == "completed" for j in listener.jobs.values()):
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert [j["error"] for j in listener.jobs.values() if j["status"] == "completed"] in ([None], [None, None])


def test_streamed_index_equals_the_batch(spark, tmp_path):
    p = pages(spark)
    p.repartition(2).write.parquet(str(tmp_path / "landing"))
    streamed, batch = Artefacts(spark, str(tmp_path / "s")), Artefacts(spark, str(tmp_path / "b"))
    step = ingest.into_index(IngestPipeline(streamed, enable_dedup=False))
    ingest.ingest_stream(ingest.landing(spark, str(tmp_path / "landing"), files_per_trigger=1), step, str(tmp_path / "check")).awaitTermination()
    IngestPipeline(batch, enable_dedup=False).run(p)
    for name in ("chunks", "vectors", "postings", "parents"):
        a, b = (sorted(map(str, s.load(name).select(*sorted(batch.load(name).columns)).collect())) for s in (streamed, batch))
        assert a == b, name


def test_providers(spark, tmp_path):
    (tmp_path / "x.txt").write_text("page one\fpage two")
    got = providers.read_pages(spark.read.format("binaryFile").load(str(tmp_path / "x.txt"))).collect()
    assert [(r.doc_id, r.page_num, r.raw_text) for r in got] == [("x.txt", 1, "page one"), ("x.txt", 2, "page two")]
    tries = []

    def fails(*_):
        tries.append(1)
        raise OSError

    assert providers.Retrying(fails)("x") == "" and len(tries) == 3
    assert providers.in_request_order([{"index": 1, "embedding": "b"}, {"index": 0, "embedding": "a"}]) == ["a", "b"]


def test_uploads(spark, tmp_path):
    path = uploads.land(spark, str(tmp_path), b"%PDF \xff\x00", "application/pdf")
    assert path.rsplit("/", 1)[-1].startswith("ingest_") and uploads.stored(spark, path) == b"%PDF \xff\x00"
    with pytest.raises(uploads.UnsupportedMediaType):
        uploads.land(spark, str(tmp_path), b"x", "text/plain")
    assert len([p for p in tmp_path.iterdir() if p.suffix == ".pdf"]) == 1


def test_plain_rows(spark):
    t = spark.createDataFrame([("d", 0, "p1_t1", [1], [["a", "b"], ["c", "d"]])], "doc_id string, table_ord int, table_id string, pages array<int>, rows array<array<string>>")
    assert [(r.row, r.content) for r in tables.plain_row_chunks(t).orderBy("row").collect()] == [(0, "a | b"), (1, "c | d")]
