"""One ranking from scores on unlike scales: percentile, inverse normal, weighted mean.

Each score becomes its empirical percentile among the query's hits for that scorer, (mean rank - 1/2) / n with
averaged ties, is mapped through the inverse normal distribution and weighted; hits are ordered by the sum.

Defined results: a hit is any (query, item) with a row of any scorer; a missing, null or NaN score stands lowest
for its scorer, tied with the others like it. Redelivered rows count once (of unlike scores under one key the
highest counts). Null keys are no hits; unknown scorers only make a hit. Ties of the fused score go to the lower item.

No window holds a whole hot query: each (query, scorer) is divided at approximate quantiles into ranges of about
``rows_per_range`` rows, ranks within a range are offset by the sizes of the ranges below. The split only moves
work, the ranks are exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORERS = ("dense", "bm25", "feedback")
#: Rows that one window partition should hold, roughly.
ROWS_PER_RANGE = 200_000
#: Copies of the per-query parameters, so that a hot query's rows meet them in as many tasks.
SALTS = 16

# Coefficients of Acklam's rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def probit_sql(p: str) -> str:
    """Inverse normal distribution as SQL over a column of probabilities between 0 and 1 (relative error about 1e-9)."""
    horner = lambda c, x: reduce(lambda acc, v: f"({acc}) * {x} + ({v!r})", c[1:], f"({c[0]!r})")
    tail = lambda q: f"({horner(_C, q)}) / (({horner(_D, q)}) * {q} + 1.0)"
    low, high = f"sqrt(-2.0 * ln({p}))", f"sqrt(-2.0 * ln(1.0 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 0.97575 THEN -({tail(high)}) ELSE ({horner(_A, r)}) * {q} / (({horner(_B, r)}) * {r} + 1.0) END"


def hits(citations: DataFrame) -> DataFrame:
    """One row per (query, item) with the best valid score of each scorer; aggregates partially before the shuffle."""
    score = F.when(~F.isnan("score"), F.col("score").cast("double"))
    return (
        citations.where("query_id is not null and chunk_ord is not null").groupBy("query_id", "chunk_ord")
        .agg(*(F.max(F.when(F.col("scorer") == s, score)).alias(s) for s in SCORERS))
    )


def percentile_scores(h: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(query_id, chunk_ord, scorer, z): ``z`` is the inverse normal of the percentile with averaged ties."""
    pairs = ", ".join(f"'{s}', {s}" for s in SCORERS)
    long = h.selectExpr("query_id", "chunk_ord", f"stack({len(SCORERS)}, {pairs}) as (scorer, score)")
    by = ["query_id", "scorer"]
    # partial aggregation: one row per query and scorer leaves a task, however hot the query is
    cuts = long.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_percentile(score, array({', '.join(f'{i}/64D' for i in range(1, 64))}), 1000)").alias("c"))
    cuts = cuts.select(*by, "n", F.when(F.col("n") > rows_per_range, F.array_distinct("c")).alias("c"))
    salt = F.pmod(F.xxhash64("chunk_ord"), F.lit(SALTS))
    spread = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    ranged = long.withColumn("salt", salt).join(spread, [*by, "salt"]).select(
        *by, "chunk_ord", "score", "n",
        F.when(F.col("score").isNull(), -1).otherwise(F.coalesce(F.size(F.filter("c", lambda x: x <= F.col("score"))), F.lit(0))).alias("range"),
    )
    below = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*by, "range").agg(F.count(F.lit(1)).alias("own"))
    sizes = sizes.select(*by, "range", "own", F.coalesce(F.sum("own").over(below), F.lit(0)).alias("lower"))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    valued = ranged.where("range >= 0")
    order = Window.partitionBy(*by, "range").orderBy("score")
    ranked = valued.select(
        *by, "range", "chunk_ord", "n", F.rank().over(order).alias("r"),
        F.count(F.lit(1)).over(order.rangeBetween(Window.currentRow, Window.currentRow)).alias("peers"),
    )
    missing = ranged.where("range < 0").select(*by, "range", "chunk_ord", "n", F.lit(1).alias("r"), F.lit(None).cast("long").alias("peers"))
    placed = ranked.unionByName(missing).withColumn("salt", salt).join(sizes, [*by, "range", "salt"])
    mean_rank = F.col("lower") + F.col("r") + (F.coalesce("peers", "own") - 1) / F.lit(2.0)
    return placed.withColumn("p", (mean_rank - 0.5) / F.col("n")).select(*by, "chunk_ord", F.expr(probit_sql("p")).alias("z"))


def fused_ranking(
    citations: DataFrame, queries: DataFrame, default_k: int = 10, default_alpha: float = 0.7, rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """(query_id, chunk_ord, fused, rank) of the first ``top_k`` hits of each known query."""
    h = hits(citations)
    asked = (
        queries.where("query_id is not null").groupBy("query_id")
        .agg(F.max("top_k").alias("top_k"), F.max(F.when(~F.isnan("alpha"), F.col("alpha"))).alias("alpha"))
        .select("query_id", F.coalesce("top_k", F.lit(default_k)).alias("k"), F.coalesce("alpha", F.lit(default_alpha)).alias("alpha"))
    )
    total = lambda s: F.max(F.when(F.col("scorer") == s, F.col("z")))
    wide = percentile_scores(h, rows_per_range).groupBy("query_id", "chunk_ord").agg(*(total(s).alias(s) for s in SCORERS))
    salt = F.pmod(F.xxhash64("chunk_ord"), F.lit(SALTS))
    spread = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    rest = (1 - F.col("alpha")) / 2
    fused: Column = F.round(F.col("alpha") * F.col("dense") + rest * (F.col("bm25") + F.col("feedback")), 9)
    scored = wide.withColumn("salt", salt).join(spread, ["query_id", "salt"]).select("query_id", "chunk_ord", "salt", "k", fused.alias("fused"))
    best = [F.desc("fused"), F.asc("chunk_ord")]
    # the first k of each salt hold the first k of all, so a hot query is cut down in several tasks first
    part = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*best))).where("rank <= k")
    return (
        part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where("rank <= k")
        .select("query_id", "chunk_ord", "fused", "rank")
    )
