"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from . import fusion, neardup, packing, quality, scans, splitting, tokens, truncation, vectors

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks")
    rules = quality.fit_rules(chunks, table(spark, sf_dir, "chunk_labels"), "chunk_ord", "content")
    return quality.not_prose(chunks, rules)


def p1_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics beside the given quality_scores; redelivered rows once."""
    rows = quality.with_text_stats(table(spark, sf_dir, "chunks").select("chunk_ord", "content", "quality_scores"))
    return rows.where("stats is not null").select("chunk_ord", "quality_scores.quality_score", "stats.*").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fused_ranking(table(spark, sf_dir, "citations"), table(spark, sf_dir, "queries")).select("query_id", "chunk_ord")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "parent_chunks"), "parent_id", "content")


RECORD = ["section_heading", "content"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs, those among exact copies of one text, too; ``p4_groups`` is the form in which copies are not expanded."""
    link, members = neardup.links(table(spark, sf_dir, "chunks"), "chunk_ord", RECORD)
    return neardup.expanded(link, members, copies="pairs").select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per chunk with its class of equal records, the number of links of that class, and its group."""
    link, members = neardup.links(table(spark, sf_dir, "chunks"), "chunk_ord", RECORD)
    group = components(link).select(F.col("id").alias("sig"), F.col("component").alias("group_id"))
    n = link.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(n, "sig", "left").join(group, "sig", "left").select(F.col("id").alias("chunk_ord"), F.col("sig").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "sig").alias("group_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.nearest(table(spark, sf_dir, "chunk_vectors"))
    return vectors.neighbour_pairs(near).select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks")
    rules = quality.fit_rules(chunks, table(spark, sf_dir, "chunk_labels"), "chunk_ord", "content")
    return scans.repairs(chunks, rules)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated_ids(table(spark, sf_dir, "documents"))


def p9_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.source_rates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_text_stats, p2_found, p3_found, p4_found, p4_groups, p5_found, p6_found, p7_ids, p8_packed, p9_found, p9_source_rates)}

# Coefficients of the rational approximations AS 241 (PPND16) of the inverse normal distribution, of the middle
# and of the tails; the operator uses another approximation, so one checks the other.
_MIDDLE = (
    ("2509.0809287301226727", "33430.575583588128105", "67265.770927008700853", "45921.953931549871457", "13731.693765509461125", "1971.5909503065514427", "133.14166789178437745", "3.3871328727963666080"),
    ("5226.4952788528545610", "28729.085735721942674", "39307.895800092710610", "21213.794301586595867", "5394.1960214247511077", "687.18700749205790830", "42.313330701600911252", "1.0"),
)
_TAIL = (
    ("7.74545014278341407640e-4", "0.0227238449892691845833", "0.241780725177450611770", "1.27045825245236838258", "3.64784832476320460504", "5.76949722146069140550", "4.63033784615654529590", "1.42343711074968357734"),
    ("1.05075007164441684324e-9", "5.475938084995344946e-4", "0.0151986665636164571966", "0.148103976427480074590", "0.689767334985100004550", "1.67638483018380384940", "2.05319162663775882187", "1.0"),
)


def _polynomial(coefficients: tuple[str, ...], x: str) -> str:
    return reduce(lambda total, c: f"({total} * {x} + {c}::DOUBLE)", coefficients[1:], f"{coefficients[0]}::DOUBLE")


def inverse_normal_sql(p: str) -> str:
    """For DuckDB; probabilities down to exp(-25)."""
    middle, tail = f"(0.180625::DOUBLE - ({p} - 0.5) * ({p} - 0.5))", f"(sqrt(-ln(least({p}, 1 - {p}))) - 1.6::DOUBLE)"
    ratio = lambda c, x: f"{_polynomial(c[0], x)} / {_polynomial(c[1], x)}"
    return f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(_MIDDLE, middle)} ELSE sign({p} - 0.5) * {ratio(_TAIL, tail)} END"


P2_SQL = f"""
WITH h AS (
  SELECT query_id, chunk_ord,
         max(CASE WHEN scorer = 'dense' AND NOT isnan(score) THEN score END) AS dense,
         max(CASE WHEN scorer = 'bm25' AND NOT isnan(score) THEN score END) AS bm25,
         max(CASE WHEN scorer = 'feedback' AND NOT isnan(score) THEN score END) AS feedback
  FROM citations WHERE query_id IS NOT NULL AND chunk_ord IS NOT NULL GROUP BY ALL
), l AS (
  SELECT query_id, chunk_ord, unnest(['dense', 'bm25', 'feedback']) AS scorer, unnest([dense, bm25, feedback]) AS score FROM h
), r AS (
  SELECT *, rank() OVER (PARTITION BY query_id, scorer ORDER BY score ASC NULLS FIRST) AS r,
         count(*) OVER (PARTITION BY query_id, scorer, score) AS peers, count(*) OVER (PARTITION BY query_id, scorer) AS n FROM l
), p AS (SELECT *, (r + (peers - 1) / 2.0::DOUBLE - 0.5::DOUBLE) / n AS p FROM r
), z AS (
  SELECT query_id, chunk_ord, scorer, {inverse_normal_sql('p')} AS z FROM p
), w AS (
  SELECT query_id, chunk_ord, max(z) FILTER (scorer = 'dense') AS d, max(z) FILTER (scorer = 'bm25') AS b, max(z) FILTER (scorer = 'feedback') AS f FROM z GROUP BY ALL
), q AS (SELECT query_id, coalesce(max(top_k), 10) AS k, coalesce(max(alpha) FILTER (NOT isnan(alpha)), 0.7) AS alpha FROM queries GROUP BY ALL
), s AS (
  SELECT query_id, chunk_ord, k, row_number() OVER (PARTITION BY query_id ORDER BY round(alpha * d + (1 - alpha) / 2 * (b + f), 9) DESC, chunk_ord) AS pos FROM w JOIN q USING (query_id)
) SELECT query_id, chunk_ord FROM s WHERE pos <= k
"""

ORACLE: dict[str, str] = {"p2_found": P2_SQL}
