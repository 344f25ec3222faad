"""The two pipelines: pages to an index, questions to cited answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import clean_text, strip
from ..operators import answer, chunking, dedup, retrieve, structure, tables as tabular
from ..sources import providers
from ..sources.artefacts import Artefacts
from .durable import cut

STEPS = ("parse", "embed", "dense index", "term index", "save")
#: Columns of a chunk, whatever it was made of.
CHUNK = (
    "doc_id string, chunk_ord string, chunk_type string, page int, pages array<int>, content string, section_heading string, doc_region string, source string, parent_id string, is_parent boolean, "
    "chunk_level string, start_char int, end_char int, links array<string>, references array<struct<pattern: string, match: string>>, caption string, caption_label string, number string, "
    "table_id string, row int, header array<string>, image_b64 string, width int, height int, is_vector boolean"
)


def _order(kind: int, *places: str) -> Column:
    """A key that sorts like the pipeline makes chunks: by document, tables, text, images, and the place within."""
    padded = [F.lpad((F.col(p) + 1).cast("string"), 9, "0") for p in places]
    return F.concat_ws("/", F.col("doc_id"), F.lit(str(kind)), *padded)


def _as_chunks(df: DataFrame) -> DataFrame:
    """All columns of a chunk; those that its kind has not are null, links and references empty."""
    empty = {"links": "array()", "references": "array()", "caption": "''", "caption_label": "''", "is_parent": "false"}
    out = []
    for part in CHUNK.replace("struct<pattern: string, match: string>", "struct<pattern:string;match:string>").split(", "):
        name, kind = part.split(" ", 1)
        kind = kind.replace(";", ",")
        value = F.col(name) if name in df.columns else F.lit(None)
        if name in empty:
            value = F.coalesce(value.cast(kind), F.expr(empty[name]).cast(kind))
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def _placed(df: DataFrame, heads: DataFrame, classed: DataFrame, use_offset: bool = False) -> DataFrame:
    """With section_heading and doc_region by the chunk's page."""
    rows = df if "start_char" in df.columns else df.withColumn("start_char", F.lit(None).cast("int"))
    return structure.regions(structure.heading_as_of(rows, heads, use_offset=use_offset), classed)


def _linked(df: DataFrame, links: DataFrame | None, key: list[str]) -> DataFrame:
    """With the first links on the pages of each row."""
    if links is None:
        return df.withColumn("links", F.array().cast("array<string>"))
    named = df.withColumn("chunk_id", F.struct(*key))
    return structure.links_by_page(named, links.select("doc_id", "page", "ord", "uri")).drop("chunk_id")


def assembled(pages: DataFrame, settings: Settings, tables: DataFrame | None = None, images: DataFrame | None = None, links: DataFrame | None = None, describe: Callable[[bytes], str] | None = None) -> dict[str, DataFrame | None]:
    """Chunks of all kinds, parents and structure of the pages (doc_id, page_num, raw_text; images, ocr_text if known).

    ``tables`` are fragments (doc_id, page, table_ord, top, bottom, col_xs, rows), ``images`` image references (doc_id, page,
    xref, width, height, data, is_vector) or ones with a ``description``, ``links`` (doc_id, page, ord, uri). Captions are linked
    before chunks are built. The order of chunks is that of the key ``chunk_ord``.
    """
    s = settings
    has = set(pages.columns)
    p = pages.withColumn("images", F.col("images") if "images" in has else F.lit(0)).withColumn("ocr_text", F.col("ocr_text") if "ocr_text" in has else F.lit(None).cast("string"))
    p = p.withColumn("scanned", structure.is_scanned(F.col("raw_text"), F.col("images"), s.min_page_chars) & F.lit(s.enable_ocr))
    classed = structure.classified(p, s.blank_page_chars)
    if s.keep_pages_with_images:
        classed = classed.withColumn("is_content", F.col("is_content") | (F.col("category") == "blank") & (F.col("images") > 0))
    if not s.enable_structure:
        classed = classed.withColumn("is_content", F.lit(True)).withColumn("category", F.lit("body"))
    content = classed.where("is_content")
    cleaned = content.withColumn("raw_text", F.when(F.col("scanned"), F.col("ocr_text")).otherwise(F.col("raw_text")))
    if s.enable_cleaning:
        edges = structure.edge_lines(pages, s.header_lines, s.header_share)
        cleaned = structure.strip_edge_lines(cleaned.withColumn("raw_text", clean_text(F.col("raw_text"))), edges)
    else:
        edges, cleaned = None, cleaned.withColumn("text", F.coalesce("raw_text", F.lit("")))
    # pages are classed and cleaned once, though text, tables, images, headings and captions all read them
    cleaned = cut(cleaned.select("doc_id", "page_num", strip("text").alias("text"), F.when(F.col("scanned"), "ocr").otherwise("native").alias("source")))
    classed = cut(classed.drop("raw_text", "ocr_text", "data"))
    body = cleaned.where(structure.enough_text(F.col("text"), s.min_page_chars))
    scan = cleaned.select("doc_id", "page_num", F.col("text").alias("raw_text"))
    heads, captions = cut(structure.headings(scan)), cut(structure.captions(scan))
    native = classed.where("is_content and not scanned").select("doc_id", F.col("page_num").alias("page"))

    # text
    by_page = body.select("doc_id", F.col("page_num").alias("page"), "source", F.slice(structure.references(F.col("text")), 1, 10).alias("references"), F.array("page_num").alias("pages"))
    by_page = _linked(by_page, links, ["page"])
    if s.enable_parent_child:
        parents, text = chunking.parent_child(body.select("doc_id", "page_num", "text"), (s.parent_tokens, s.parent_overlap), (s.child_tokens, s.child_overlap))
        parents = _placed(parents, heads, classed).join(by_page.select("doc_id", "page", "source"), ["doc_id", "page"])
    else:
        parents, text = None, chunking.flat_chunks(body, s.child_tokens, s.child_overlap).withColumn("parent_ord", F.lit(0))
    text = _placed(text, heads, classed, use_offset=not s.enable_parent_child).join(by_page, ["doc_id", "page"])
    text = text.withColumn("chunk_type", F.when(F.col("source") == "ocr", "ocr_text").otherwise("text")).withColumn("chunk_ord", _order(1, "page", "parent_ord", "ord"))
    kinds = [_as_chunks(text)]

    # tables
    whole = None
    if tables is not None:
        rows = tables.join(native, ["doc_id", "page"], "left_semi").withColumn("rows", tabular.valid_rows(F.col("rows"), s.min_cells))
        whole = tabular.stitch(rows, s.column_overlap, s.column_snap).withColumn("page", F.col("pages")[0])
        if s.enable_captions:
            whole = structure.nearest_caption(whole.withColumn("item_id", F.col("table_ord")), captions, "table", by_offset=False).drop("item_id").withColumnsRenamed({"text": "caption", "label": "caption_label"})
        made = tabular.table_chunks(_linked(whole, links, ["table_ord"]), keep=("links", *(c for c in ("caption", "caption_label", "number") if s.enable_captions)))
        made = made.withColumn("links", F.when(F.col("row") == -1, F.col("links"))).withColumn("source", F.lit("native")).withColumn("chunk_ord", _order(0, "table_ord", "row"))
        kinds.append(_as_chunks(_placed(made, heads, classed)))

    # images
    shown = None
    if images is not None and s.enable_vision:
        shown = images.join(native, ["doc_id", "page"], "left_semi")
        if "is_vector" not in shown.columns:
            shown = shown.withColumn("is_vector", F.lit(False))
        raster = providers.usable_images(shown.where("not is_vector"))
        shown = raster.unionByName(shown.where("is_vector")) if s.enable_vector else raster
        if "description" not in shown.columns:
            shown = cut(providers.described(shown, describe or providers.offline_description))  # descriptions are paid for once
        if s.enable_captions:
            shown = structure.nearest_caption(shown.withColumn("item_id", F.struct("page", "xref")), captions, "figure").drop("item_id").withColumnsRenamed({"text": "caption", "label": "caption_label"})
        label = F.col("caption_label") if s.enable_captions else F.lit(None).cast("string")
        made = shown.where("length(description) > 0").withColumn("content", answer.image_content(label, F.col("description"))).withColumn("pages", F.array("page"))
        made = made.withColumn("chunk_type", F.lit("image")).withColumn("source", F.lit("vision_llm")).withColumn("chunk_ord", _order(2, "page", "xref"))
        if "data" in made.columns:
            made = made.withColumn("image_b64", F.base64("data"))
        kinds.append(_as_chunks(_placed(made, heads, classed)))

    return {"chunks": reduce(DataFrame.unionByName, kinds), "parents": parents, "headings": heads, "captions": captions, "pages": classed, "tables": whole, "images": shown, "links": links, "edges": edges, "fragments": tables}


def run_stats(chunks: DataFrame, kept: DataFrame, pages: DataFrame) -> DataFrame:
    """One row of counters of a run."""
    p = pages.agg(F.count(F.lit(1)).alias("total_pages"), F.count_if(~F.col("is_content")).alias("skipped_pages"), F.count_if(F.col("category") == "blank").alias("blank_pages"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("chunk_type") == "table").alias("table_chunks"), F.count_if(F.col("chunk_type") == "text").alias("text_chunks"))
    k = kept.agg(F.count(F.lit(1)).alias("final_chunks"))
    one = lambda df: [df.select(n).scalar().alias(n) for n in df.columns]
    return pages.sparkSession.range(1).select(*one(p), *one(c), *one(k))


def parse_stats(made: dict, after_quality: DataFrame, after_exact: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of all counters of a run, each frame aggregated once."""
    count = F.count(F.lit(1))
    kind = lambda *names: F.count_if(F.col("chunk_type").isin(*names))
    some = lambda c: F.count_if(F.coalesce(F.length(F.col(c)) > 0, F.lit(False)))
    captioned = lambda df: some("caption") if df is not None and "caption" in df.columns else F.lit(0).cast("long")
    asked = {
        "pages": [count.alias("total_pages"), F.count_if(F.col("is_content") & ~F.col("scanned")).alias("native_text_pages"), F.count_if(F.col("is_content") & F.col("scanned")).alias("ocr_pages"), F.count_if(~F.col("is_content")).alias("skipped_pages")],
        "chunks": [count.alias("total_before_dedup"), kind("text").alias("text_chunks"), kind("table").alias("table_chunks"), kind("image").alias("image_chunks"), kind("ocr_text").alias("ocr_chunks"), F.count_if(F.col("chunk_level") == "child").alias("child_chunks")],
        "fragments": [count.alias("tables_detected")],
        "tables": [count.alias("n_tables"), captioned(made["tables"]).alias("tables_with_captions")],
        "images": [F.count_if(~F.col("is_vector")).alias("images_extracted"), some("description").alias("images_described"), F.count_if(F.col("is_vector")).alias("vector_diagrams_detected"), captioned(made["images"]).alias("figures_with_captions")],
        "links": [count.alias("links_found")],
        "captions": [count.alias("captions_found")],
        "edges": [count.alias("headers_removed")],
        "parents": [count.alias("parent_chunks")],
    }
    zero = F.lit(0).cast("long")
    columns = []
    for name, aggregates in asked.items():
        frame = made.get(name)
        if frame is None:
            columns += [zero.alias(n) for n in (a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggregates)]
            continue
        one = frame.agg(*aggregates)
        columns += [one.select(c).scalar().alias(c) for c in one.columns]
    total = lambda df: df.agg(count.alias("n")).scalar()
    before, good, exact, last = total(made["chunks"]), total(after_quality), total(after_exact), total(kept)
    columns += [(before - good).alias("low_quality_removed"), (good - exact).alias("exact_dupes_removed"), (exact - last).alias("near_dupes_removed"), last.alias("total_chunks")]
    return made["pages"].sparkSession.range(1).select(*columns)


class IngestPipeline:
    """Pages of documents to the tables of the index. Keyword arguments override settings; callbacks get the step and its number.

    Documents that are ingested again replace their own rows; the rest of the index stays.
    """

    def __init__(self, store: Artefacts, settings: Settings = Settings(), on_step: Callable[[int, str], None] | None = None, **overrides):
        self.store, self.settings, self.on_step = store, replace(settings, **overrides), on_step or (lambda i, name: None)

    def run(self, pages: DataFrame, **inputs) -> dict:
        """``inputs``: tables, images, links, describe, as for ``assembled``."""
        s = self.settings
        self.on_step(1, STEPS[0])
        made = assembled(pages, s, **inputs)
        chunks = made["chunks"] = cut(made["chunks"])
        good, rejected = dedup.split_by_quality(chunks, s.min_quality) if s.enable_quality else (chunks, chunks.limit(0))
        exact = dedup.exact_dedup(good) if s.enable_dedup else good
        kept = cut(dedup.near_dedup(exact, s.dedup_threshold, n=s.minhash_slots, k=s.shingle) if s.enable_dedup else exact)
        self.on_step(2, STEPS[1])
        vectors = providers.embedded(kept.select("doc_id", "chunk_ord", "content"), "content", embedder=providers.get_embedder(s.embedding_provider, s.dim)).drop("content")
        self.on_step(3, STEPS[2])
        self.on_step(4, STEPS[3])
        post = retrieve.postings(kept).join(kept.select("chunk_ord", "doc_id"), "chunk_ord")
        self.on_step(5, STEPS[4])
        n = kept.count()
        stats = cut(parse_stats(made, good, exact, kept))
        if not n:
            return {"error": "no chunks", "stats": stats}
        docs = pages.select("doc_id").distinct()
        for name, df in (("chunks", kept), ("vectors", vectors), ("postings", post), ("parents", made["parents"]), ("headings", made["headings"]), ("links", made["links"])):
            if df is not None:
                self.store.save(name, df, docs)
        counts = {"n_chunks": n, "n_parents": made["parents"].count() if made["parents"] is not None else 0, "n_tables": made["tables"].count() if made["tables"] is not None else 0, "embedding_dim": s.dim}
        return {**made, "chunks": kept, **counts, "stats": stats, "rejected": rejected}


class QnAPipeline:
    """Questions answered from the stored index."""

    def __init__(self, store: Artefacts, settings: Settings = Settings(), embedder: providers.HashedEmbedder | None = None, model=None):
        self.store, self.settings = store, settings
        self.embedder = embedder or providers.get_embedder(settings.embedding_provider, settings.dim)
        self.model = model or providers.get_model(settings.llm_provider)

    @property
    def is_ready(self) -> bool:
        return self.store.ready

    def search(self, question: str, top_k: int | None = None, alpha: float | None = None, use_parent: bool | None = None) -> DataFrame:
        """(rank, score, chunk columns, parent_content) of one question. The stored postings are the term index; without them dense search alone answers."""
        spark, s = self.store.spark, self.settings
        vec = [float(x) for x in self.embedder.embed([question])[0]]
        q = spark.createDataFrame([(0, question, vec, top_k, alpha)], "query_id long, question string, query_vec array<double>, top_k int, alpha double")
        chunks = self.store.load("chunks")
        post = self.store.load("postings")
        index = retrieve.TermIndex.of(post, chunks.count()) if post is not None else None
        hits = retrieve.hybrid_search(q, self.store.load("vectors"), index, s.pool, k1=s.k1, b=s.b, default_k=s.top_k, default_alpha=s.alpha).join(chunks, "chunk_ord")
        parents = self.store.load("parents")
        if (s.use_parent if use_parent is None else use_parent) and parents is not None:
            return retrieve.with_parents(hits, parents)
        return hits.withColumn("parent_content", F.lit(None).cast("string"))

    def _prepared(self, question: str, options: dict) -> tuple[list, str]:
        """The cited hits, at most top_k rows, and the prompt made of them."""
        hits = self.search(question, **options).withColumn("content", F.coalesce("parent_content", "content"))
        cited = cut(answer.citations(hits.withColumn("caption", F.col("caption_label"))))
        rows = cited.orderBy("rank").select("index", "citation", "score", "page", F.col("doc_id").alias("pdf_name"), "content").collect()
        return rows, answer.contexts(cited).select(answer.prompt(F.lit(question), F.col("context"))).first()[0] if rows else ""

    def ask(self, question: str, **options) -> dict:
        rows, text = self._prepared(question, options)
        if not rows:
            return {"question": question, "answer": answer.NOTHING_FOUND, "citations": [], "source_chunks": [], "scores": []}
        try:
            said = self.model.generate(text, max_tokens=self.settings.max_answer_tokens, temperature=self.settings.temperature)
        except Exception as e:  # noqa: BLE001 - a failing model becomes the answer
            said = f"Error: {e}"
        return {"question": question, "answer": said, "citations": [r.asDict() for r in rows], "source_chunks": [r.content for r in rows], "scores": [r.score for r in rows]}

    def stream(self, question: str, **options) -> Iterator[dict]:
        """Events: token*, citations, done; without hits one token and done; a failure at any point ends with error."""
        try:
            rows, text = self._prepared(question, options)
            if not rows:
                yield {"type": "token", "data": answer.NOTHING_FOUND}
                yield {"type": "done"}
                return
            for t in self.model.stream(text, max_tokens=self.settings.max_answer_tokens, temperature=self.settings.temperature):
                yield {"type": "token", "data": t}
            yield {"type": "citations", "data": [r.asDict() for r in rows]}
            yield {"type": "done"}
        except Exception as e:  # noqa: BLE001
            yield {"type": "error", "data": str(e)}


def public_settings(settings: Settings) -> dict:
    return asdict(settings)


def health(store: Artefacts, version: str) -> dict:
    ready = store.ready
    return {"status": "ok", "index_loaded": ready, "n_chunks": store.load("chunks").count() if ready else 0, "version": version}
