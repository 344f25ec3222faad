"""Structure of page-wise documents: classes, heads and feet, headings, captions, contents, references, links."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import header_form, strip

# Patterns of the page classes, in the order in which they are tried.
PAGE_CLASSES = (
    ("cover", (r"(?im)(?:^|\n)\s*(?:cover\s*page|front\s*cover)\s*$",)),
    ("title_page", (r"(?i)(?:prepared\s+(?:by|for)|published\s+by|issued\s+by|national\s+aeronautics|nasa\s+sp-|revision\s+\d)",)),
    ("toc", (r"(?i)(?:^|\n)\s*(?:TABLE OF CONTENTS|CONTENTS)\s*(?:\n|$)", r"(?:\.{4,}\s*\d+\s*\n){3,}")),
    ("front_matter", (r"(?i)(?:^|\n)\s*(?:PREFACE|FOREWORD|ACKNOWLEDGMENT|EXECUTIVE SUMMARY)\s*(?:\n|$)", r"(?i)(?:^|\n)\s*(?:LIST OF FIGURES|LIST OF TABLES)\s*(?:\n|$)", r"(?i)(?:^|\n)\s*(?:ABBREVIATIONS|ACRONYMS)\s*(?:\n|$)")),
    ("appendix", (r"(?i)(?:^|\n)\s*APPENDIX\s+[A-Z]\b",)),
    ("glossary", (r"(?i)(?:^|\n)\s*(?:GLOSSARY|DEFINITIONS)\s*(?:\n|$)",)),
    ("index_page", (r"(?i)(?:^|\n)\s*(?:INDEX|SUBJECT INDEX)\s*(?:\n|$)",)),
    ("references", (r"(?i)(?:^|\n)\s*(?:REFERENCES|BIBLIOGRAPHY|WORKS CITED)\s*(?:\n|$)",)),
)
NO_CONTENT = ("cover", "title_page", "toc", "blank")
# A line of a table of contents.
TOC_LINE = r"^(?:(\d+(?:\.\d+)*)\s+)?(.+?)\s*[.\s]{3,}\s*(\d{1,4})\s*$"
# Patterns of headings, in the order in which they are tried.
HEADINGS = (
    ("numbered", r"^(\d+(?:\.\d+)*)\s+([A-Z][^\n]{2,80})$", re.M),
    ("label", r"^(Chapter\s+\d+)[:\s\-–—]*(.{0,80})$", re.M | re.I),
    ("label", r"^(Appendix\s+[A-Z0-9]+)[:\s\-–—]*(.{0,80})$", re.M | re.I),
    ("capitals", r"^([A-Z][A-Z\s,&\-]{8,80})$", re.M),
)
# Patterns of captions.
CAPTIONS = (
    ("figure", r"(?:^|\n)\s*(?:Figure|Fig\.?)\s+(\d+(?:[.\-]\d+)*)[:\.\s\-–—]+([^\n]{5,200})"),
    ("table", r"(?:^|\n)\s*(?:Table|Tbl\.?)\s+(\d+(?:[.\-]\d+)*)[:\.\s\-–—]+([^\n]{5,200})"),
    ("exhibit", r"(?:^|\n)\s*(?:Exhibit)\s+([A-Z]?\d+(?:[.\-]\d+)*)[:\.\s\-–—]+([^\n]{5,200})"),
)
# Patterns of references.
REFERENCES = (
    ("bracket_numeric", r"\[(\d+(?:[,\-–]\s*\d+)*)\]"),
    ("author_year", r"\(([A-Z][a-z]+(?:\s(?:&|and|et\s+al\.?)\s+[A-Z][a-z]+)?,\s*\d{4}[a-z]?)\)"),
    ("footnote", r"(?:^|\s)(\d{1,3})\s+(?=[A-Z])"),
)
# Kinds of links by their code.
LINK_KINDS = {0: "none", 1: "goto", 2: "uri", 3: "launch", 5: "named"}


def page_class(text: Column, page: Column, blank_chars: int = 50) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    any_of = lambda patterns: F.greatest(*(t.rlike(p) for p in patterns)) if len(patterns) > 1 else t.rlike(patterns[0])
    early = (page <= 2) & (F.length(t) < 500)
    out = F.when(F.length(t) < blank_chars, "blank").when(early & any_of(PAGE_CLASSES[0][1]), "cover").when(early & (page == 1), "title_page")
    for name, patterns in PAGE_CLASSES:
        out = out.when(any_of(patterns), name)
    return out.otherwise("body")


def classified(pages: DataFrame, blank_chars: int = 50) -> DataFrame:
    """Adds category, is_content and text_length to (doc_id, page_num, raw_text)."""
    c = pages.withColumn("category", page_class(F.col("raw_text"), F.col("page_num"), blank_chars))
    return c.withColumn("is_content", ~F.col("category").isin(*NO_CONTENT)).withColumn("text_length", F.length(strip(F.coalesce("raw_text", F.lit("")))))


def category_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"))


def document_starts(pages: DataFrame) -> DataFrame:
    first = lambda c: F.min(F.when(F.col("category") == c, F.col("page_num")))
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_pages"), F.coalesce(first("body"), F.lit(1)).alias("body_start"), first("appendix").alias("appendix_start"))


def regions(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_region of each chunk by its page, "body" where the page is unknown."""
    p = pages.select("doc_id", F.col("page_num").alias("page"), F.col("category").alias("doc_region"))
    return chunks.join(p, ["doc_id", "page"], "left").withColumn("doc_region", F.coalesce("doc_region", F.lit("body")))


def edge_lines(pages: DataFrame, n_lines: int = 3, share: float = 0.3) -> DataFrame:
    """(doc_id, side, line, n): forms of first and last lines that come up on enough pages of their document.

    Counted per line, so twice on a page counts twice; last lines only of pages with more than ``n_lines`` lines.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("raw_text", F.lit("")), "\n"), strip), lambda x: x != "")
    p = pages.select("doc_id", lines.alias("l"))
    top = p.select("doc_id", F.lit("header").alias("side"), F.explode(F.slice("l", 1, n_lines)).alias("x"))
    low = p.where(F.size("l") > n_lines).select("doc_id", F.lit("footer").alias("side"), F.explode(F.slice("l", -n_lines, n_lines)).alias("x"))
    counted = top.unionByName(low).select("doc_id", "side", header_form(F.col("x")).alias("line")).where(F.length("line") > 3).groupBy("doc_id", "side", "line").agg(F.count(F.lit(1)).alias("n"))
    least = pages.groupBy("doc_id").agg(F.greatest(F.lit(3), F.floor(F.count(F.lit(1)) * share).cast("int")).alias("least"))
    return counted.join(least, "doc_id").where("n >= least").select("doc_id", "side", "line", "n")


def strip_edge_lines(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """raw_text without the lines whose form is in either set of its document."""
    known = edges.groupBy("doc_id").agg(F.collect_set("line").alias("known"))
    kept = F.filter(F.split("raw_text", "\n"), lambda x: ~F.coalesce(F.array_contains("known", header_form(x)), F.lit(False)))
    return pages.join(known, "doc_id", "left").withColumn("text", F.array_join(kept, "\n")).drop("known")


def references(text: Column) -> Column:
    """array<struct<pattern, match>>, distinct, pattern by pattern."""
    named = lambda name: lambda m: F.struct(F.lit(name).alias("pattern"), m.alias("match"))
    found = [F.transform(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1))), named(name)) for name, p in REFERENCES]
    return F.flatten(F.array(*found))


def toc_entries(pages: DataFrame) -> DataFrame:
    """(doc_id, toc_page, number, title, target_page, level), line by line."""
    line = pages.select("doc_id", F.col("page_num").alias("toc_page"), F.explode(F.split("raw_text", "\n")).alias("x")).where(F.col("x").rlike(TOC_LINE))
    part = lambda i: F.regexp_extract("x", TOC_LINE, i)
    number = part(1)
    level = F.when(number == "", 0).otherwise(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
    rows = line.select("doc_id", "toc_page", number.alias("number"), strip(part(2)).alias("title"), part(3).cast("int").alias("target_page"), level.cast("int").alias("level"))
    return rows.where(F.length("title") > 2)


def find_headings(text: str | None) -> list[tuple[int, str, str]]:
    """(offset, number, title) in order of offset; an earlier pattern keeps its offset."""
    found: dict[int, tuple[str, str]] = {}
    for kind, pattern, flags in HEADINGS:
        for m in re.finditer(pattern, text or "", flags):
            if kind == "capitals":
                item = ("", m.group(1).strip().title())
            elif kind == "numbered":
                item = (m.group(1).strip(), m.group(2).strip())
            else:
                item = ("", " ".join(x for x in (m.group(1), m.group(2)) if x.strip()).strip())
            found.setdefault(m.start(), item)
    return [(offset, *found[offset]) for offset in sorted(found)]


def find_captions(text: str | None) -> list[tuple[int, str, str, str]]:
    """(offset, kind, number, text) in order of offset."""
    found: dict[int, tuple[str, str, str]] = {}
    for kind, pattern in CAPTIONS:
        for m in re.finditer(pattern, text or "", re.I | re.M):
            found.setdefault(m.start(), (kind, m.group(1).strip(), re.sub(r"[.\s]+$", "", m.group(2).strip())))
    return [(offset, *found[offset]) for offset in sorted(found)]


def _scan(pages: DataFrame, find, names: list[str], types: str) -> DataFrame:
    """Rows of a scan with offsets, which has no built-in counterpart; one pandas batch at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, p, i, *x) for d, p, t in zip(f.doc_id, f.page_num, f.raw_text, strict=True) for i, x in enumerate(find(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "ord", *names])

    return pages.select("doc_id", "page_num", "raw_text").mapInPandas(run, f"doc_id string, page int, ord int, {types}")


def headings(pages: DataFrame) -> DataFrame:
    h = _scan(pages, find_headings, ["char_offset", "number", "title"], "char_offset int, number string, title string")
    return h.withColumn("label", F.when(F.col("number") != "", F.concat(F.lit("§"), "number", F.lit(" "), "title")).otherwise(F.col("title")))


def captions(pages: DataFrame) -> DataFrame:
    c = _scan(pages, find_captions, ["char_offset", "kind", "number", "text"], "char_offset int, kind string, number string, text string")
    label = F.concat(F.initcap("kind"), F.lit(" "), "number")
    return c.withColumn("label", label).withColumn("full_label", F.concat(label, F.lit(": "), "text"))


def heading_as_of(chunks: DataFrame, heads: DataFrame, use_offset: bool = False) -> DataFrame:
    """section_heading of (doc_id, page, start_char, ...): the last heading before the page, or on it up to the offset.

    The window runs over a document's pages, not its chunks; chunks then meet their page in an equi-join, so a document
    that holds most of the chunks is no single task. ``use_offset`` takes the chunk's own offset instead of 0.
    """
    rest = chunks.drop("section_heading")
    on = ["doc_id", "page"]
    marks = heads.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("char_offset", "ord", "label"))).alias("__heads"))
    pages = rest.select(*on).union(marks.select(*on)).distinct().join(marks, on, "left")
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.element_at("__heads", -1)["label"], ignorenulls=True).over(w)
    at = F.coalesce("start_char", F.lit(0)) if use_offset else F.lit(0)
    here = F.filter("__heads", lambda h: h["char_offset"] <= at)
    label = F.when(F.size(here) > 0, F.element_at(here, -1)["label"])
    got = rest.join(pages.select(*on, "__heads", before.alias("__before")), on, "left")
    return got.select(*rest.columns, F.coalesce(label, "__before", F.lit("")).alias("section_heading"))


def nearest_caption(items: DataFrame, caps: DataFrame, kind: str, reach: int = 1, by_offset: bool = True) -> DataFrame:
    """The caption of this kind nearest to each item's page, at most ``reach`` pages off; items keep null without one.

    Ties: the smaller offset (images) or the first listed (tables).
    """
    pages = F.sequence(F.col("page") - reach, F.col("page") + reach)
    near = items.select("doc_id", "item_id", "page", F.explode(pages).alias("on"))
    c = caps.where(F.col("kind") == kind).select("doc_id", F.col("page").alias("on"), "char_offset", "ord", "number", "label", "text")
    order = [F.abs(F.col("page") - F.col("on")), *([F.col("char_offset")] if by_offset else []), F.col("on"), F.col("ord")]
    w = Window.partitionBy("doc_id", "item_id").orderBy(*order)
    best = near.join(c, ["doc_id", "on"]).withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "item_id", "number", "label", "text")
    return items.join(best, ["doc_id", "item_id"], "left")


def links_in_markup(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    uris = F.regexp_extract_all(html_col, F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select(id_col, F.posexplode(uris).alias("ord", "uri")).withColumn("kind", F.lit("uri"))


def link_kind(code: Column) -> Column:
    out = F.lit("unknown")
    for k, name in LINK_KINDS.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def links_by_page(chunks: DataFrame, links: DataFrame, most: int = 5) -> DataFrame:
    """The first links on the pages of each chunk (doc_id, chunk_id, pages).

    Of each page only its first ``most`` links meet the chunks, since no other can be among the first of several pages.
    """
    on = chunks.select("doc_id", "chunk_id", F.explode("pages").alias("page"))
    order = F.struct("page", "ord", "uri")
    w = Window.partitionBy("doc_id", "page").orderBy("ord", "uri")
    first = links.select("doc_id", "page", "ord", "uri").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    of_page = first.groupBy("doc_id", "page").agg(F.collect_list(order).alias("l"))
    got = on.join(of_page, ["doc_id", "page"]).groupBy("doc_id", "chunk_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("l")))).alias("l"))
    return chunks.join(got, ["doc_id", "chunk_id"], "left").withColumn("links", F.coalesce(F.slice(F.transform("l", lambda x: x["uri"]), 1, most), F.array().cast("array<string>"))).drop("l")


def boxes_overlap(a: Column, b: Column) -> Column:
    """Closed rectangles (x0, y0, x1, y1) meet; a null box meets everything."""
    meet = (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"]) & (a["y0"] <= b["y1"]) & (a["y1"] >= b["y0"])
    return F.coalesce(meet, F.lit(True))


def is_scanned(text: Column, images: Column, min_chars: int = 20) -> Column:
    return (F.length(strip(F.coalesce(text, F.lit("")))) < min_chars) & (images > 0)


def enough_text(text: Column, least: int = 20) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) >= least


