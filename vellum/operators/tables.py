"""Tables taken from page layouts: cells, signatures, stitching over pages, chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, strip

TABLE = "doc_id string, table_ord int, table_id string, pages array<int>, header array<string>, rows array<array<string>>, col_xs array<double>, bottom double"


def clean_cell(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{SPACE}+", " "))


def clean_rows(rows: Column, least: int = 2) -> Column:
    """Cells with single blanks; rows with fewer than ``least`` filled cells are dropped."""
    cleaned = F.transform(rows, lambda r: F.transform(r, clean_cell))
    return F.filter(cleaned, lambda r: F.size(F.filter(r, lambda c: c != "")) >= least)


def valid_rows(rows: Column, least: int = 2) -> Column:
    """The header as it is, with single blanks, and the rows below it with at least ``least`` filled cells."""
    header = F.transform(F.slice(rows, 1, 1), lambda r: F.transform(r, clean_cell))
    return F.when(F.size(rows) > 0, F.concat(header, clean_rows(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), least))).otherwise(rows)


def page_bands(boxes: Column, height: Column, least: float = 4.0) -> Column:
    """Horizontal bands (top, bottom) of a page outside its tables; bands below ``least`` points are dropped."""
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), height.cast("double")), F.flatten(F.transform(boxes, lambda b: F.array(b["top"].cast("double"), b["bottom"].cast("double")))))))
    bands = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.struct(F.element_at(cuts, i).alias("top"), F.element_at(cuts, i + 1).alias("bottom")))
    inside = lambda d: F.exists(boxes, lambda b: (b["top"] <= d["top"]) & (b["bottom"] >= d["bottom"]))
    return F.filter(F.when(F.size(cuts) > 1, bands), lambda d: (d["bottom"] - d["top"] >= least) & ~inside(d))


def column_signature(xs: Column, snap: int = 10) -> Column:
    """Left edges rounded half to even to the snap."""
    return F.transform(xs, lambda x: F.bround(x / snap) * snap)


def left_edges(cells: Column) -> Column:
    """Left edges, one decimal, of the cells in the first cell's row."""
    return F.when(F.size(cells) > 0, F.transform(F.filter(cells, lambda c: c["top"] == cells[0]["top"]), lambda c: F.round(c["x0"], 1))).otherwise(F.array().cast("array<double>"))


def column_match(a: Column, b: Column, snap: int = 10) -> Column:
    """Share of distinct left signatures that have a right one within the snap, over the larger number of them."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    hits = F.size(F.filter(x, lambda v: F.exists(y, lambda w: F.abs(v - w) <= snap)))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most > 0, hits / most).otherwise(0.0)


def table_text(header: Column, rows: Column) -> Column:
    head = F.array_join(header, " | ")
    lines = F.transform(rows, lambda r: F.array_join(r, " | "))
    return F.array_join(F.concat(F.array(head, F.repeat(F.lit("-"), F.length(head))), lines), "\n")


def stitch(fragments: DataFrame, overlap: float = 0.60, snap: int = 10) -> DataFrame:
    """Tables out of fragments (doc_id, page, table_ord, top, bottom, col_xs, rows) in order of page and top.

    A fragment goes on from the latest table that ends on this page or the one before and whose columns match; its
    first row then is a repeated header. The order within a document matters, so each document is one group of
    small rows; documents are independent.
    """

    def signature(xs) -> set[float]:
        return {round(x / snap) * snap for x in xs}

    def share(a: set[float], b: set[float]) -> float:
        most = max(len(a), len(b))
        return sum(any(abs(x - y) <= snap for y in b) for x in a) / most if most else 0.0

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tables: list[dict] = []
        for f in frame.sort_values(["page", "top", "table_ord"]).itertuples():
            rows = [list(r) for r in f.rows]
            if len(rows) < 2:
                continue
            into = None
            for t in reversed(tables):
                if t["pages"][-1] < f.page - 1:
                    break
                if share(signature(t["col_xs"]), signature(f.col_xs)) >= overlap:
                    into = t
                    break
            if into is None:
                tables.append({"doc_id": f.doc_id, "table_ord": len(tables), "table_id": f"p{f.page}_t{len(tables) + 1}", "pages": [f.page], "header": rows[0], "rows": rows[1:], "col_xs": list(f.col_xs), "bottom": f.bottom})
            else:
                into["rows"] += rows[1:]
                into["bottom"] = f.bottom
                if f.page not in into["pages"]:
                    into["pages"].append(f.page)
        return pd.DataFrame(tables, columns=["doc_id", "table_ord", "table_id", "pages", "header", "rows", "col_xs", "bottom"])

    return fragments.groupBy("doc_id").applyInPandas(run, TABLE)


def table_chunks(tables: DataFrame, caption_col: str = "caption_label", keep: tuple[str, ...] = ()) -> DataFrame:
    """One chunk for each whole table (row -1) and one per row, each with the header and the caption label if there is one; ``keep`` are columns of the table to carry over."""
    t = tables if caption_col in tables.columns else tables.withColumn(caption_col, F.lit(None).cast("string"))
    label = F.when(F.col(caption_col) != "", F.col(caption_col))
    base = ["doc_id", "table_ord", "table_id", F.col("pages")[0].alias("page"), "pages", "header", *keep]
    names = ["doc_id", "table_ord", "table_id", "page", "pages", "header", *keep]
    whole = t.select(*base, F.lit(-1).alias("row"), F.concat_ws("\n\n", label, table_text(F.col("header"), F.col("rows"))).alias("content"))
    each = t.select(*base, label.alias("__label"), F.posexplode("rows").alias("row", "cells"))
    lines = each.select(*names, "row", F.concat_ws("\n", "__label", F.array_join("header", " | "), F.array_join("cells", " | ")).alias("content"))
    return whole.unionByName(lines).withColumn("chunk_type", F.lit("table"))


def plain_row_chunks(tables: DataFrame) -> DataFrame:
    """The older, simple form: one chunk per row of a table, its cells alone."""
    each = tables.select("doc_id", "table_ord", "table_id", F.col("pages")[0].alias("page"), "pages", F.posexplode("rows").alias("row", "cells"))
    return each.withColumn("content", F.array_join("cells", " | ")).drop("cells").withColumn("chunk_type", F.lit("table"))
