"""One query per operator over the given tables, and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import answer, chunking, dedup, retrieve, structure, tables
from ..sources import providers
from ..config import Settings
from ..sources.artefacts import Artefacts
from ..streaming import ingest
from .durable import ensure_checkpoint_dir
from .pipeline import assembled, run_stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


# --- stand-ins: the pages of a source are its documents in order; structured pages are rendered from part ---

PAGES_SQL = "SELECT source AS doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page_num, text AS raw_text FROM documents"
RENDER = (
    "SELECT p_brand AS doc_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS page_num, "
    "concat(p_size, '.', p_partkey % 9 + 1, ' Section of ', p_name, chr(10), 'Body of the part [', p_partkey % 7 + 1, '] and [', p_size, '-', p_size + 2, '].', chr(10), "
    "'Figure ', p_size, '.1: View of ', p_name, '.', chr(10), 'Table ', p_size, '-2: Data of ', p_type, chr(10), 'see (Smith, ', 1990 + p_size % 30, ').') AS raw_text, p_size, p_partkey, p_name, p_type FROM part"
)
CHUNKS_SQL = "SELECT chunk_ord, any_value(content) AS content, any_value(chunk_type) AS chunk_type, any_value(section_heading) AS section_heading, any_value(page) AS page, any_value(parent_id) AS parent_id, any_value(caption) AS caption FROM chunks GROUP BY chunk_ord"


def doc_pages(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "documents").createOrReplaceTempView("documents")
    return spark.sql(PAGES_SQL)


def structured_pages(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("part")
    return spark.sql(RENDER.replace("chr(10)", "'\\n'"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, redelivered rows once; the narrow columns only."""
    c = table(spark, d, "chunks").select("chunk_ord", "doc_id", "content", "chunk_type", "section_heading", "page", "parent_id", "caption")
    return c.dropDuplicates(["chunk_ord"])


# --- cleaning and tokens ---

W, SP = text.WORD, text.SPACE
_STRIP = lambda x: f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def _clean_sql(x: str) -> str:
    kept = [c for c in text.ONE_FOR_ONE]
    x = f"translate({x}, {' || '.join(f'chr({ord(c)})' for c in [*kept, *text.DROPPED])}, {' || '.join(f'chr({ord(v)})' for v in text.ONE_FOR_ONE.values())})"
    for a, b in text.LONGER.items():
        x = f"replace({x}, '{a}', '{b}')"
    for pattern, new in (
        (f"[{text.BULLETS}]", "'- '"), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "''"), (rf"({W})-{SP}*\n{SP}*({W})", r"'\1\2'"), (r"[ \t]{2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)"),
        (r"(?i)(?:^|\n)\s*(?:Page\s+)?\d{1,4}\s*(?:of\s+\d{1,4})?\s*(?:\n|$)", "chr(10)"), (f"(?i)(?:{'|'.join(text.WATERMARKS)})", "''"),
    ):
        x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    return _STRIP(x)


@query(f"SELECT doc_id, {_clean_sql('text')} AS cleaned FROM documents")
def clean_steps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean_steps(F.col("text")).alias("cleaned"))


@query()
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


_TERMS = lambda col, stop: f"list_filter(regexp_extract_all(lower(coalesce({col}, '')), '{W}+'), lambda w: length(w) > 1 AND w NOT IN ({quoted(stop)}))"


@query(f"SELECT doc_id, array_to_string({_TERMS('text', text.CORPUS_STOP_WORDS)}, ' ') AS terms FROM documents")
def tokens_corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(text.corpus_terms(F.col("text")), " ").alias("terms"))


@query(f"SELECT query_id, array_to_string({_TERMS('question', text.QUERY_STOP_WORDS)}, ' ') AS terms FROM queries")
def tokens_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").select("query_id", F.array_join(text.query_terms(F.col("question")), " ").alias("terms"))


_SPLIT = lambda x: f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{SP}+'), lambda w: w <> '')"


@query(f"""WITH t AS (SELECT doc_id, {_SPLIT('text')} AS t FROM documents), n AS (SELECT *, len(t) AS n FROM t WHERE len(t) > 0)
SELECT doc_id, CAST(i AS INT) AS ord, array_to_string(list_slice(t, i * 226 + 1, i * 226 + 256), ' ') AS content
FROM (SELECT doc_id, t, unnest(range(0, CASE WHEN n <= 256 THEN 1 ELSE 1 + CAST(ceil((n - 256) / 226.0) AS BIGINT) END)) AS i FROM n)""")
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.word_windows(text.split_words(F.col("text")), 256, 30)).alias("ord", "content"))


# --- page structure ---


def _class_sql() -> str:
    t = _STRIP("coalesce(raw_text, '')")
    hit = lambda ps: "(" + " OR ".join(f"regexp_matches(t, '{p}')" for p in ps) + ")"
    fixed = [(n, [p.replace("(?im)", "(?i)").replace("$", "(?:$|\\n)") if "(?im)" in p else p for p in ps]) for n, ps in structure.PAGE_CLASSES]
    whens = " ".join(f"WHEN {hit(ps)} THEN '{n}'" for n, ps in fixed)
    early = "page_num <= 2 AND length(t) < 500"
    return f"SELECT doc_id, page_num, CASE WHEN length(t) < 50 THEN 'blank' WHEN {early} AND {hit(fixed[0][1])} THEN 'cover' WHEN {early} AND page_num = 1 THEN 'title_page' {whens} ELSE 'body' END AS category FROM (SELECT doc_id, page_num, {t} AS t FROM ({PAGES_SQL}))"


CLASSIFIED_SQL = _class_sql()


@query(f"SELECT *, category NOT IN ({quoted(list(structure.NO_CONTENT))}) AS is_content FROM ({CLASSIFIED_SQL})")
def classify_pages(spark: SparkSession, d: str) -> DataFrame:
    return structure.classified(doc_pages(spark, d)).select("doc_id", "page_num", "category", "is_content")


@query(f"SELECT doc_id, category, count(*) AS n FROM ({CLASSIFIED_SQL}) GROUP BY ALL")
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return structure.category_counts(structure.classified(doc_pages(spark, d)))


@query(f"SELECT doc_id, count(*) AS total_pages, coalesce(min(CASE WHEN category = 'body' THEN page_num END), 1) AS body_start, min(CASE WHEN category = 'appendix' THEN page_num END) AS appendix_start FROM ({CLASSIFIED_SQL}) GROUP BY doc_id")
def body_start(spark: SparkSession, d: str) -> DataFrame:
    return structure.document_starts(structure.classified(doc_pages(spark, d)))


_FORM = lambda x: f"regexp_replace(regexp_replace({_STRIP(x)}, '\\b\\d{{1,4}}\\b', '#', 'g'), '{SP}+', ' ', 'g')"
EDGES_SQL = f"""SELECT doc_id, side, line, count(*) AS n FROM (
  SELECT doc_id, 'header' AS side, unnest(list_slice(l, 1, 3)) AS x FROM p UNION ALL SELECT doc_id, 'footer', unnest(list_slice(l, greatest(len(l) - 2, 1), len(l))) FROM p WHERE len(l) > 3
) s, LATERAL (SELECT {_FORM('s.x')} AS line) WHERE length(line) > 3 GROUP BY doc_id, side, line"""


_LINES = lambda x: f"list_transform(string_split(coalesce({x}, ''), chr(10)), lambda x: {_STRIP('x')})"
HEADS_SQL = f"""pages AS (SELECT doc_id, page_num, raw_text FROM ({RENDER})), p AS (SELECT doc_id, list_filter({_LINES('raw_text')}, lambda x: x <> '') AS l FROM pages),
edges AS (SELECT e.* FROM ({EDGES_SQL}) e JOIN (SELECT doc_id, greatest(3, CAST(floor(count(*) * 0.3) AS INT)) AS least FROM pages GROUP BY doc_id) USING (doc_id) WHERE n >= least)"""


@query(f"WITH {HEADS_SQL} SELECT * FROM edges")
def header_footer_lines(spark: SparkSession, d: str) -> DataFrame:
    return structure.edge_lines(structured_pages(spark, d))


@query(f"""WITH {HEADS_SQL}, x AS (SELECT doc_id, page_num, unnest(string_split(raw_text, chr(10))) AS x, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM pages),
k AS (SELECT x.*, e.line IS NULL AS kept FROM x LEFT JOIN (SELECT DISTINCT doc_id, line FROM edges) e ON e.doc_id = x.doc_id AND e.line = {_FORM('x.x')})
SELECT doc_id, page_num, coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (kept), '') AS text FROM k GROUP BY doc_id, page_num""")
def strip_headers(spark: SparkSession, d: str) -> DataFrame:
    p = structured_pages(spark, d)
    return structure.strip_edge_lines(p, structure.edge_lines(p)).select("doc_id", "page_num", "text")


TOC_SQL = structure.TOC_LINE.replace("'", "''")


@query(f"""SELECT chunk_ord, number, title, target_page, CASE WHEN number = '' THEN 0 ELSE length(number) - length(replace(number, '.', '')) + 1 END::INT AS level FROM (
  SELECT chunk_ord, regexp_extract(x, '{TOC_SQL}', 1) AS number, {_STRIP(f"regexp_extract(x, '{TOC_SQL}', 2)")} AS title, regexp_extract(x, '{TOC_SQL}', 3)::INT AS target_page
  FROM (SELECT chunk_ord, unnest(string_split(content, chr(10))) AS x FROM ({CHUNKS_SQL})) WHERE regexp_matches(x, '{TOC_SQL}')) WHERE length(title) > 2""")
def toc_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).select(F.col("chunk_ord").alias("doc_id"), F.lit(0).alias("page_num"), F.col("content").alias("raw_text"))
    return structure.toc_entries(rows).withColumnRenamed("doc_id", "chunk_ord").drop("toc_page")


@query(f"SELECT doc_id, page_num AS page, 0 AS char_offset, concat('§', p_size, '.', p_partkey % 9 + 1, ' Section of ', p_name) AS label FROM ({RENDER}) WHERE length(p_name) < 60")
def headings(spark: SparkSession, d: str) -> DataFrame:
    return structure.headings(structured_pages(spark, d)).select("doc_id", "page", "char_offset", "label")


@query()
def headings_of_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).select(F.col("chunk_ord").cast("string").alias("doc_id"), F.lit(1).alias("page_num"), F.col("content").alias("raw_text"))
    return structure.headings(rows).select("doc_id", "ord", "char_offset", "number", "title", "label")


CAPTIONS_SQL = f"""SELECT doc_id, page_num AS page, 'figure' AS kind, concat('Figure ', p_size, '.1') AS label, concat('View of ', p_name) AS text FROM ({RENDER})
UNION ALL SELECT doc_id, page_num, 'table', concat('Table ', p_size, '-2'), concat('Data of ', p_type) FROM ({RENDER})"""


@query(CAPTIONS_SQL)
def captions(spark: SparkSession, d: str) -> DataFrame:
    return structure.captions(structured_pages(spark, d)).select("doc_id", "page", "kind", "label", "text")


@query("""SELECT DISTINCT p_partkey, unnest(['bracket_numeric', 'bracket_numeric', 'author_year', 'footnote']) AS pattern,
unnest([concat(p_partkey % 7 + 1), concat(p_size, '-', p_size + 2), concat('Smith, ', 1990 + p_size % 30), concat(p_size)]) AS match FROM part""")
def references(spark: SparkSession, d: str) -> DataFrame:
    noted = F.concat("raw_text", F.lit("\n"), "p_size", F.lit(" Note of the maker."))
    return structured_pages(spark, d).select("p_partkey", F.explode(structure.references(noted)).alias("r")).select("p_partkey", "r.*")


@query()
def references_of_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(structure.references(F.col("text"))).alias("r")).select("doc_id", "r.*")


# chunks on the rendered pages: one in the middle of each page; headings are at offset 0
@query(f"""SELECT c.doc_id, c.page, h.label AS section_heading FROM (SELECT p_brand AS doc_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + p_partkey % 3 AS INT) AS page, p_partkey FROM part) c
ASOF JOIN (SELECT doc_id, page_num AS page, concat('§', p_size, '.', p_partkey % 9 + 1, ' Section of ', p_name) AS label FROM ({RENDER})) h ON c.doc_id = h.doc_id AND c.page >= h.page""")
def heading_asof(spark: SparkSession, d: str) -> DataFrame:
    pages = structured_pages(spark, d)
    c = spark.sql("SELECT p_brand AS doc_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + p_partkey % 3 AS INT) AS page, 0 AS start_char FROM part")
    return structure.heading_as_of(c, structure.headings(pages)).select("doc_id", "page", "section_heading")


ITEMS = "SELECT p_brand AS doc_id, p_partkey AS item_id, CAST(p_partkey % 40 + 1 AS INT) AS page FROM part"


def _nearest_sql(kind: str) -> str:
    return f"""SELECT doc_id, item_id, label FROM ({ITEMS}) i LEFT JOIN (
  SELECT doc_id, item_id, label, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY abs(i.page - c.page), c.off, c.page) AS r
  FROM ({ITEMS}) i JOIN (SELECT c.*, {'strpos(p.raw_text, chr(10) || ' + "'Figure'" + ')' if kind == 'figure' else '0'} AS off FROM ({CAPTIONS_SQL}) c JOIN ({RENDER}) p ON p.doc_id = c.doc_id AND p.page_num = c.page WHERE kind = '{kind}') c USING (doc_id) WHERE abs(i.page - c.page) <= 1
) b USING (doc_id, item_id) WHERE r = 1 OR r IS NULL"""


@query(_nearest_sql("figure"))
def caption_nearest_image(spark: SparkSession, d: str) -> DataFrame:
    caps = structure.captions(structured_pages(spark, d))
    return structure.nearest_caption(spark.sql(ITEMS), caps, "figure").select("doc_id", "item_id", "label")


@query(_nearest_sql("table"))
def caption_nearest_table(spark: SparkSession, d: str) -> DataFrame:
    caps = structure.captions(structured_pages(spark, d))
    return structure.nearest_caption(spark.sql(ITEMS), caps, "table", by_offset=False).select("doc_id", "item_id", "label")


@query("SELECT p_partkey, 0 AS ord, concat('https://parts.example/', p_partkey) AS uri, 'uri' AS kind FROM part UNION ALL SELECT p_partkey, 1, concat('#', p_brand), 'uri' FROM part")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit('<p><a href="https://parts.example/'), "p_partkey", F.lit('">x</a> <a class="y" href="#'), "p_brand", F.lit('">z</a></p>'))
    return structure.links_in_markup(table(spark, d, "part").withColumn("html", html), "p_partkey", "html")


@query("""WITH l AS (SELECT p_brand AS doc_id, CAST(p_size AS INT) AS page, CAST(p_partkey AS INT) AS ord, concat('u', p_partkey) AS uri FROM part),
c AS (SELECT p_brand AS doc_id, p_partkey AS chunk_id, [CAST(p_size AS INT), CAST(p_size + 1 AS INT)] AS pages FROM part)
SELECT c.doc_id, c.chunk_id, coalesce(array_to_string(list_slice(list(l.uri ORDER BY l.page, l.ord) FILTER (l.uri IS NOT NULL), 1, 5), ','), '') AS links
FROM c LEFT JOIN l ON l.doc_id = c.doc_id AND list_contains(c.pages, l.page) GROUP BY c.doc_id, c.chunk_id""")
def links_by_page(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    links = p.select(F.col("p_brand").alias("doc_id"), F.col("p_size").cast("int").alias("page"), F.col("p_partkey").cast("int").alias("ord"), F.concat(F.lit("u"), "p_partkey").alias("uri"))
    c = p.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("chunk_id"), F.array(F.col("p_size").cast("int"), (F.col("p_size") + 1).cast("int")).alias("pages"))
    return structure.links_by_page(c, links).select("doc_id", "chunk_id", F.array_join("links", ",").alias("links"))


@query(f"""WITH c AS ({CLASSIFIED_SQL}) SELECT d.doc_id AS id, coalesce(c.category, 'body') AS doc_region FROM documents d JOIN ({PAGES_SQL.replace(' FROM', ', doc_id AS id FROM')}) p ON p.id = d.doc_id
LEFT JOIN c ON c.doc_id = p.doc_id AND c.page_num = p.page_num + d.doc_id % 2""")
def doc_regions(spark: SparkSession, d: str) -> DataFrame:
    p = doc_pages(spark, d)
    c = spark.sql(PAGES_SQL.replace(" FROM", ", doc_id AS id FROM")).select("doc_id", "id", (F.col("page_num") + F.col("id") % 2).cast("int").alias("page"))
    return structure.regions(c, structure.classified(p)).select("id", "doc_region")


# --- quality and duplicates ---


def _quality_sql() -> str:
    ent = "CASE WHEN length(t) > 0 THEN coalesce((SELECT log2(length(t)) - sum(c * log2(c)) / length(t) FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split(lower(t), '')) AS ch) GROUP BY ch)), 0) ELSE 0 END"
    bp = " OR ".join(f"regexp_matches({_STRIP('t')}, '(?i){p}')" for p in scores.BOILERPLATE)
    return f"""WITH d AS (SELECT chunk_ord, chunk_type, coalesce(content, '') AS t FROM ({CHUNKS_SQL})), w AS (SELECT *, {_SPLIT('t')} AS k, regexp_extract_all(lower(t), '{W}+') AS w FROM d),
e AS (SELECT chunk_ord, -- character counts of each text
        log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM (SELECT chunk_ord, ch, count(*) AS c FROM (SELECT chunk_ord, unnest(regexp_extract_all(lower(t), '(?s).')) AS ch FROM d) GROUP BY ALL) GROUP BY chunk_ord),
s AS (SELECT w.chunk_ord, chunk_type, t, CASE WHEN len(k) < 10 THEN 0.0 WHEN len(k) <= 50 THEN 0.5 + 0.5 * len(k) / 50.0 WHEN len(k) <= 500 THEN 1.0 WHEN len(k) <= 2000 THEN 1.0 - 0.3 * (len(k) - 500) / 1500.0 ELSE 0.3 END::DOUBLE AS length_score,
  least(coalesce(h, 0) / 5, 1.0)::DOUBLE AS entropy_score, CASE WHEN length(t) > 0 THEN length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\s\\p{{Z}}]', '', 'g'))::DOUBLE / length(t) ELSE 0 END AS alpha_ratio,
  CASE WHEN len(k) > 0 THEN len(list_distinct(list_transform(k, lambda x: lower(x))))::DOUBLE / len(k) ELSE 0 END AS uniqueness_score,
  CASE WHEN len(w) > 0 AND length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))::DOUBLE / len(w) BETWEEN 2.5 AND 12 THEN 1.0 ELSE 0.5 END::DOUBLE AS coherence_score, CASE WHEN {bp} THEN 0.0 ELSE 1.0 END::DOUBLE AS boilerplate_score FROM w LEFT JOIN e ON e.chunk_ord = w.chunk_ord),
q AS (SELECT *, {' + '.join(f'{v}::DOUBLE * {k}' for k, v in scores.WEIGHTS.items())} AS total FROM s)
SELECT chunk_ord, round(entropy_score, 3) AS entropy_score, round(uniqueness_score, 3) AS uniqueness_score, round(alpha_ratio, 3) AS alpha_ratio, round(length_score, 3) AS length_score, coherence_score, boilerplate_score, round(CASE WHEN chunk_type IN ('table', 'image') THEN greatest(total, 0.6) ELSE total END, 3) AS quality_score FROM q"""


QUALITY_SQL = _quality_sql()


@query(QUALITY_SQL)
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    return dedup.with_quality(chunks(spark, d)).select("chunk_ord", "quality.*")


@query(f"SELECT chunk_ord, quality_score >= 0.9 AS kept FROM ({QUALITY_SQL})")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    kept, rejected = dedup.split_by_quality(chunks(spark, d), 0.9)
    return kept.select("chunk_ord", F.lit(True).alias("kept")).unionByName(rejected.select("chunk_ord", F.lit(False).alias("kept")))


@query(f"SELECT min(chunk_ord) AS chunk_ord FROM (SELECT chunk_ord, {_STRIP("coalesce(content, '')")} AS k FROM chunks) GROUP BY k")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_dedup(chunks(spark, d)).select("chunk_ord")


SHINGLES_SQL = f"CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END"


@query(f"SELECT doc_id, len(g) AS n_shingles FROM (SELECT doc_id, {SHINGLES_SQL} AS g FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{W}+') AS w FROM documents))")
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.shingles(text.words(F.col("text")))).cast("long").alias("n_shingles"))


@query(f"""WITH s AS (SELECT DISTINCT doc_id, unnest(g) AS s, len(g) AS n FROM (SELECT doc_id, {SHINGLES_SQL} AS g FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{W}+') AS w FROM documents)))
SELECT a.doc_id AS a, b.doc_id AS b, round(count(*)::DOUBLE / (a.n + b.n - count(*)), 6) AS similarity FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.85""")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.shingle_pairs(table(spark, d, "documents"), 0.85, "text", "doc_id").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH g AS (SELECT doc_id, {SHINGLES_SQL} AS g FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{W}+') AS w FROM documents)),
h AS (SELECT doc_id, i, min(CAST('0x' || md5(encode(s) || unhex(printf('%04X', i)))[1:8] AS BIGINT)) AS v FROM (SELECT doc_id, unnest(g) AS s FROM g), (SELECT unnest(range(128)) AS i) GROUP BY ALL)
SELECT doc_id, i::INT AS slot, v FROM h UNION ALL SELECT doc_id, unnest(range(128))::INT, 0 FROM g WHERE len(g) = 0""")
def minhash_md5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(dedup.minhash_md5(text.words(F.col("text")))).alias("slot", "v"))


@query()
def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", text.words(F.col("text")).alias("tokens"))
    return dedup.with_minhash(docs, F.col("tokens")).select("doc_id", "signature")


@query()
def near_dup_edges(spark: SparkSession, d: str) -> DataFrame:
    return dedup.duplicate_edges(dedup.exact_dedup(chunks(spark, d)))


@query()
def near_dup_survivors(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_dedup(dedup.exact_dedup(chunks(spark, d))).select("chunk_ord")


# --- chunks and tables ---


@query()
def recursive_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, d, "documents").select("doc_id", "text"), "text", 256, 30)


@query()
def parent_child(spark: SparkSession, d: str) -> DataFrame:
    pages = doc_pages(spark, d).withColumnRenamed("raw_text", "text")
    parents, children = chunking.parent_child(pages)
    return children.join(parents.select("parent_id", F.length("content").alias("parent_chars")), "parent_id")


BRAND_ROWS = "SELECT p_brand, list([concat(p_partkey), p_name] ORDER BY p_partkey) AS rows FROM part GROUP BY p_brand"


@query(f"""WITH t AS ({BRAND_ROWS}), x AS (SELECT p_brand, 'key | name' AS head, list_transform(rows, lambda r: array_to_string(r, ' | ')) AS lines FROM t)
SELECT p_brand AS doc_id, -1 AS row, concat('Table of ', p_brand, chr(10), chr(10), head, chr(10), '----------', chr(10), array_to_string(lines, chr(10))) AS content FROM x
UNION ALL SELECT p_brand, CAST(i - 1 AS INT), concat('Table of ', p_brand, chr(10), head, chr(10), lines[i]) FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM x)""")
def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda r: F.array(r["p_partkey"].cast("string"), r["p_name"]))
    t = table(spark, d, "part").groupBy("p_brand").agg(rows.alias("rows")).select(
        F.col("p_brand").alias("doc_id"), F.lit(0).alias("table_ord"), F.lit("p1_t1").alias("table_id"), F.array(F.lit(1)).alias("pages"), F.array(F.lit("key"), F.lit("name")).alias("header"),
        tables.clean_rows(F.col("rows")).alias("rows"), F.concat(F.lit("Table of "), "p_brand").alias("caption_label"),
    )
    return tables.table_chunks(t).select("doc_id", "row", "content")


@query("""WITH s AS (SELECT s_suppkey, [round_even((s_suppkey % 50) * 1.3 / 10, 0) * 10, round_even((72 + s_suppkey % 7 * 40) / 10.0, 0) * 10, round_even((s_acctbal + 1000) / 100.0, 0) * 10] AS a,
 [round_even((s_suppkey % 50) * 1.3 / 10, 0) * 10, 120.0::DOUBLE] AS b FROM supplier)
SELECT s_suppkey, round(len(list_filter(list_distinct(a), lambda v: len(list_filter(b, lambda w: abs(v - w) <= 10)) > 0))::DOUBLE / greatest(len(list_distinct(a)), len(list_distinct(b))), 6) AS overlap FROM s""")
def column_match(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 50
    xs = F.array(k * 1.3, (72 + F.col("s_suppkey") % 7 * 40).cast("double"), (F.col("s_acctbal") + 1000) / 10.0)
    ys = F.array(k * 1.3, F.lit(120.0))
    return table(spark, d, "supplier").select("s_suppkey", F.round(tables.column_match(tables.column_signature(xs), tables.column_signature(ys)), 6).alias("overlap"))


# a fragment per brand and every third size, as page; a page that is missing in between ends a table
FRAGMENTS = "SELECT p_brand AS doc_id, CAST(p_size / 3 AS INT) AS page, list([concat(p_partkey), p_name] ORDER BY p_partkey) AS cells FROM part WHERE p_size % 3 = 0 AND p_size % 15 <> 0 GROUP BY ALL"


@query(f"""WITH f AS ({FRAGMENTS}), g AS (SELECT *, CASE WHEN page - lag(page) OVER w <= 1 THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page) AS island FROM g)
SELECT doc_id, concat('p', min(page), '_t', island) AS table_id, CAST(count(*) AS INT) AS n_pages, CAST(sum(len(cells)) AS INT) AS n_rows FROM i GROUP BY doc_id, island""")
def stitched_tables(spark: SparkSession, d: str) -> DataFrame:
    cells = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda r: F.array(r["p_partkey"].cast("string"), r["p_name"]))
    f = table(spark, d, "part").where("p_size % 3 = 0 and p_size % 15 <> 0").groupBy(F.col("p_brand").alias("doc_id"), (F.col("p_size") / 3).cast("int").alias("page")).agg(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), cells).alias("rows"))
    f = f.select("doc_id", "page", F.lit(0).alias("table_ord"), F.lit(10.0).alias("top"), F.lit(90.0).alias("bottom"), F.array(F.lit(72.0), F.lit(200.0)).alias("col_xs"), "rows")
    return tables.stitch(f).select("doc_id", "table_id", F.size("pages").alias("n_pages"), F.size("rows").alias("n_rows"))


# --- search ---

TOP_SQL = f"""
docs AS (SELECT doc_id, {_TERMS('text', text.CORPUS_STOP_WORDS)} AS t FROM documents),
post AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM docs) GROUP BY term, doc_id),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM docs),
raw AS (SELECT term, count(*) AS df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT DISTINCT query_id, question, top_k, alpha, query_vec FROM queries),
ask AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TERMS('question', text.QUERY_STOP_WORDS)}) AS term FROM q) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM ask JOIN idf USING (term) JOIN post USING (term), st GROUP BY ALL),
bm AS (SELECT query_id, doc_id, score, score / greatest(max(score) OVER (PARTITION BY query_id), 1e-6) AS norm FROM sc)"""


@query(f"WITH {TOP_SQL} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return retrieve.TermIndex.build(docs, "doc_id", "text").inverse_frequencies().select("term", "df", F.round("idf", 6).alias("idf"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries").dropDuplicates(["query_id"])


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    s = retrieve.bm25_scores(_asked(spark, d), retrieve.TermIndex.build(table(spark, d, "documents"), "doc_id", "text"), "doc_id")
    return s.withColumn("score", F.round("score", 8)).withColumn("norm", F.round("norm", 8))


BM_SQL = "bmr AS (SELECT query_id, doc_id, round(score, 8) AS score, round(norm, 8) AS norm FROM bm), bm50 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS bm25_rank FROM bmr QUALIFY bm25_rank <= 50)"
DENSE_SQL = """dense AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(query_vec::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_inner_product(query_vec::DOUBLE[], query_vec::DOUBLE[]) * list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS dense
  FROM q, embeddings WHERE query_vec IS NOT NULL), d50 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) AS dense_rank FROM dense QUALIFY dense_rank <= 50)"""


@query(f"WITH {TOP_SQL}, {BM_SQL} SELECT query_id, doc_id, round(score, 5) AS score, bm25_rank AS rank FROM bm50")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.ranked(_bm25(spark, d), "score", 50, "doc_id").select("query_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.dense_topk(_asked(spark, d), table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), 50, "doc_id")


@query(f"WITH q AS (SELECT DISTINCT query_id, query_vec FROM queries), {DENSE_SQL} SELECT query_id, doc_id, round(dense, 6) AS dense, dense_rank AS rank FROM d50")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).select("query_id", "doc_id", F.round("dense", 6).alias("dense"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {TOP_SQL}, {BM_SQL}, {DENSE_SQL},
c AS (SELECT d.query_id, d.doc_id, d.dense, d.dense_rank, b.norm, NULL AS bm25_rank FROM d50 d LEFT JOIN bmr b USING (query_id, doc_id)
  UNION ALL SELECT b.query_id, b.doc_id, NULL, NULL, b.norm, b.bm25_rank FROM bm50 b ANTI JOIN d50 USING (query_id, doc_id)),
f AS (SELECT c.*, CASE WHEN coalesce(top_k, 0) = 0 THEN 10 ELSE top_k END AS k, round(coalesce(alpha, 0.7) * coalesce(dense, 0) + (1 - coalesce(alpha, 0.7)) * coalesce(norm, 0), 9) AS fused FROM c JOIN q USING (query_id))
SELECT query_id, doc_id, round(fused, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, dense_rank NULLS LAST, bm25_rank NULLS LAST, doc_id) AS rank FROM f QUALIFY rank <= k""")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieve.fused(_asked(spark, d), _dense(spark, d), _bm25(spark, d), 50, "doc_id")
    return hits.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


HITS = "SELECT query_id, chunk_ord, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_ord) AS rank FROM (SELECT query_id, chunk_ord, max(score) AS score FROM citations WHERE scorer = 'dense' AND score IS NOT NULL AND NOT isnan(score) GROUP BY query_id, chunk_ord)"
PARENTS_SQL = "SELECT parent_id, any_value(content) AS parent FROM parent_chunks WHERE content IS NOT NULL GROUP BY parent_id"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "citations").createOrReplaceTempView("citations")
    return spark.sql(HITS).join(chunks(spark, d), "chunk_ord")


@query(f"""WITH x AS (SELECT h.query_id, h.chunk_ord, h.rank, c.parent_id, p.parent FROM ({HITS}) h JOIN ({CHUNKS_SQL}) c USING (chunk_ord) LEFT JOIN ({PARENTS_SQL}) p ON p.parent_id = c.parent_id)
SELECT query_id, chunk_ord, parent IS NOT NULL AS is_parent FROM x QUALIFY parent IS NULL OR row_number() OVER (PARTITION BY query_id, parent_id, parent IS NOT NULL ORDER BY rank) = 1""")
def parent_resolution(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "parent_chunks").where("content is not null").dropDuplicates(["parent_id"])
    return retrieve.resolve_parents(_hits(spark, d), parents).select("query_id", "chunk_ord", "is_parent")


CITED_SQL = f"""SELECT h.query_id, h.rank AS "index", concat_ws(', ', 'Page ' || coalesce(CAST(c.page AS VARCHAR), '?'), CASE WHEN c.section_heading <> '' THEN c.section_heading END, coalesce(c.chunk_type, 'text'), CASE WHEN c.caption <> '' THEN c.caption END) AS citation, c.content
FROM ({HITS}) h JOIN ({CHUNKS_SQL}) c USING (chunk_ord)"""


@query(f'SELECT query_id, CAST("index" AS BIGINT) AS "index", citation FROM ({CITED_SQL})')
def citation_labels(spark: SparkSession, d: str) -> DataFrame:
    return answer.citations(_hits(spark, d)).select("query_id", F.col("index").cast("long").alias("index"), "citation")


@query(f"""WITH b AS (SELECT query_id, array_to_string(list('[Source ' || "index" || ': ' || citation || ']' || chr(10) || trim(coalesce(content, ''), ' ') ORDER BY "index"), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS context FROM ({CITED_SQL}) GROUP BY query_id)
SELECT query_id, 'Context (retrieved from the document):' || chr(10) || chr(10) || context || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Instructions: Answer the question using the context above. Cite your sources using [Source N] format. If multiple sources support your answer, cite all of them.' AS prompt
FROM b JOIN (SELECT DISTINCT query_id, question FROM queries) USING (query_id)""")
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    c = answer.contexts(answer.citations(_hits(spark, d)))
    return c.join(_asked(spark, d).select("query_id", "question"), "query_id").select("query_id", answer.prompt(F.col("question"), F.col("context")).alias("prompt"))


@query("SELECT query_id, CASE WHEN NOT length(coalesce(question, '')) BETWEEN 1 AND 2000 THEN 'question' WHEN NOT coalesce(top_k, 10) BETWEEN 1 AND 50 THEN 'top_k' WHEN NOT coalesce(alpha, 0.7) BETWEEN 0 AND 1 THEN 'alpha' END AS bad FROM queries")
def request_validation(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries")
    return q.select("query_id", retrieve.bad_requests(q).alias("bad"))


# --- runs, chats, streams, providers ---


@query(f"""SELECT (SELECT count(*) FROM documents) AS total_pages, (SELECT count(*) FROM ({CLASSIFIED_SQL}) WHERE category IN ({quoted(list(structure.NO_CONTENT))})) AS skipped_pages, (SELECT count(*) FROM ({CLASSIFIED_SQL}) WHERE category = 'blank') AS blank_pages,
(SELECT count(DISTINCT chunk_ord) FROM chunks) AS chunks, (SELECT count(*) FROM ({CHUNKS_SQL}) WHERE chunk_type = 'table') AS table_chunks, (SELECT count(*) FROM ({CHUNKS_SQL}) WHERE chunk_type = 'text') AS text_chunks,
(SELECT count(DISTINCT {_STRIP("coalesce(content, '')")}) FROM chunks) AS final_chunks""")
def ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return run_stats(c, dedup.exact_dedup(c), structure.classified(doc_pages(spark, d)))


@query()
def ingested_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = assembled(doc_pages(spark, d), Settings(header_share=0.1))
    return made["chunks"].select("doc_id", "page", "parent_id", "content", "start_char", "end_char", "section_heading", "doc_region")


# chunks of all three kinds of the rendered pages, but for the first page of a document, which is a title page
_MADE = f"SELECT *, concat('§', p_size, '.', p_partkey % 9 + 1, ' Section of ', p_name) AS heading FROM ({RENDER}) WHERE page_num > 1"
_URIS = "[concat('https://parts.example/', p_partkey), concat('#', p_partkey)]"


@query(f"""SELECT doc_id, page_num AS page, 'text' AS chunk_type, concat_ws(chr(10), concat(p_size, '.', p_partkey % 9 + 1, ' Section of ', p_name), concat('Figure ', p_size, '.1: View of ', p_name, '.'), concat('Table ', p_size, '-2: Data of ', p_type)) AS content,
  heading AS section_heading, '' AS caption, array_to_string({_URIS}, ' ') AS links FROM ({_MADE})
UNION ALL SELECT doc_id, page_num, 'table', concat('Table ', p_size, '-2', chr(10), chr(10), 'size | type', chr(10), '-----------', chr(10), p_size, ' | ', p_type), heading, concat('Data of ', p_type), array_to_string({_URIS}, ' ') FROM ({_MADE}) WHERE p_partkey % 5 = 0
UNION ALL SELECT doc_id, page_num, 'table', concat('Table ', p_size, '-2', chr(10), 'size | type', chr(10), p_size, ' | ', p_type), heading, concat('Data of ', p_type), '' FROM ({_MADE}) WHERE p_partkey % 5 = 0
UNION ALL SELECT doc_id, page_num, 'image', concat('Figure ', p_size, '.1', chr(10), chr(10), 'Drawing of ', p_name), heading, concat('View of ', p_name), '' FROM ({_MADE}) WHERE p_partkey % 4 = 0""")
def assembled_chunks(spark: SparkSession, d: str) -> DataFrame:
    p = structured_pages(spark, d)
    at = p.select("doc_id", F.col("page_num").alias("page"), "p_partkey", "p_size", "p_name", "p_type")
    edges = F.array(F.lit(72.0), F.when(F.col("page") % 2 == 0, 200.0).otherwise(400.0))  # tables of pages that follow each other don't match
    rows = F.array(F.array(F.lit("size"), F.lit("type")), F.array(F.col("p_size").cast("string"), "p_type"))
    fragments = at.where("p_partkey % 5 = 0").select("doc_id", "page", F.lit(0).alias("table_ord"), F.lit(10.0).alias("top"), F.lit(90.0).alias("bottom"), edges.alias("col_xs"), rows.alias("rows"))
    images = at.where("p_partkey % 4 = 0").select("doc_id", "page", F.lit(1).alias("xref"), F.lit(300).alias("width"), F.lit(200).alias("height"), F.concat(F.lit("Drawing of "), "p_name").alias("description"))
    links = at.select("doc_id", "page", F.posexplode(F.array(F.concat(F.lit("https://parts.example/"), "p_partkey"), F.concat(F.lit("#"), "p_partkey"))).alias("ord", "uri"))
    made = assembled(p.select("doc_id", "page_num", "raw_text"), Settings(header_share=0.9), fragments, images, links)
    return made["chunks"].select("doc_id", "page", "chunk_type", "content", "section_heading", "caption", F.array_join("links", " ").alias("links"))


# the events of a user stand in for the messages of a chat
@query("""SELECT user_id AS chat_id, substr(arg_min(concat(event_type, ': ', props), (ts, event_id)), 1, 50) AS title, count(*) AS n_messages, min(ts) AS created, max(ts) AS updated,
  row_number() OVER (ORDER BY max(ts) DESC, user_id) AS place FROM events GROUP BY user_id""")
def chat_list(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("chat_id"), F.struct("ts", "event_id").alias("at"), "ts", F.concat("event_type", F.lit(": "), "props").alias("content"))
    return answer.chats(e).withColumn("place", F.col("place").cast("long"))


@query("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN epoch_ms(m) - epoch_ms(ts) < 86400000 THEN 'today' WHEN epoch_ms(m) - epoch_ms(ts) < 604800000 THEN 'previous 7 days' ELSE 'older' END AS bucket FROM events, (SELECT max(ts) AS m FROM events)) GROUP BY bucket")
def chat_buckets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    newest = e.agg(F.max("ms")).scalar()
    return e.select(answer.chat_bucket(newest, F.col("ms")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query()
def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    return providers.embedded(chunks(spark, d).select("chunk_ord", "content"), "content").drop("content")


@query(f"SELECT DISTINCT sha256({_STRIP("coalesce(text, '')")}) AS text_hash FROM documents")
def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents as landed page files, taken in batches; each distinct text once."""
    root = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}"
    table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_num"), F.col("text").alias("raw_text")).repartition(4).write.parquet(f"{root}/landing")
    store = Artefacts(spark, root)
    ingest.ingest_stream(ingest.landing(spark, f"{root}/landing", files_per_trigger=2), ingest.append_new(store), f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(store.path("pages")).select(F.sha2(text.strip(F.coalesce("raw_text", F.lit(""))), 256).alias("text_hash"))
