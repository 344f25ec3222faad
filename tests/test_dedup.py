import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.functions.text import words
from vellum.operators import dedup
from vellum.operators.graph import components


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    ends = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in ends}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(3, " x "), (1, "x"), (2, "y"), (4, None), (5, "")], "chunk_ord long, content string")
    assert sorted(r.chunk_ord for r in dedup.exact_dedup(df).collect()) == [1, 2, 4]


def greedy(rows, sim, threshold):
    """The sequential elimination over all pairs."""
    dead = set()
    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            i, j = rows[x][0], rows[y][0]
            if i in dead:
                break
            if j not in dead and sim.get((i, j), 0) >= threshold:
                dead.add(i if rows[y][2] > rows[x][2] else j)
    return {r[0] for r in rows} - dead


def test_near_dedup_equals_the_greedy_loop(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(rng.randint(1, 5)):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(60)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(t), rng.choice(["", "h"])))
    df = spark.createDataFrame(rows, "chunk_ord long, content string, section_heading string")
    sig = {r.chunk_ord: r.s for r in dedup.with_minhash(df.select("chunk_ord", words(F.col("content")).alias("t")), F.col("t"), "s").collect()}
    sim = {(i, j): sum(a == b for a, b in zip(sig[i], sig[j], strict=True)) / 128 for i in sig for j in sig if i < j}
    edges = {(r.a, r.b) for r in dedup.duplicate_edges(df).collect()}
    assert edges == {k for k, v in sim.items() if v >= 0.85}
    rich = [(i, t, len(t) + (200 if h else 0)) for i, t, h in rows]
    assert {r.chunk_ord for r in dedup.near_dedup(df).collect()} == greedy(rich, sim, 0.85)
    # all components in rounds of joins
    assert {r.chunk_ord for r in dedup.near_dedup(df, most=0).collect()} == greedy(rich, sim, 0.85)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    n = 60
    edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(90)} | {(0, i) for i in range(1, 25)})
    rows = [(i, "", rng.randrange(5)) for i in range(n)]
    e = spark.createDataFrame(edges, "a long, b long")
    got = {r.i for r in dedup._rounds(e, spark.createDataFrame([(i, r) for i, _, r in rows], "i long, rich long")).collect()}
    assert set(range(n)) - got == greedy(rows, dict.fromkeys(edges, 1.0), 0.85)


def test_bands_miss_nothing():
    assert dedup.bands_for(0.85) == 20 and dedup.bands_for(1.0) == 1


def test_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "")], "chunk_ord long, content string")
    assert dedup.near_dedup(df).count() == 3
    assert dedup.near_dedup(df.limit(0)).count() == 0
    kept, rejected = dedup.split_by_quality(df.withColumn("chunk_type", F.lit("text")), 0.3)
    assert kept.count() == 3 and rejected.count() == 0


def test_shingle_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    long = " ".join(f"t{i}" for i in range(102))
    texts = [None, "", "a b", "A b", "a", long, " ".join(long.split()[:57]), *(" ".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_ord long, content string")
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set())
    sim = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b}
    for threshold in (0.55, 0.85):  # 0.55 * 100 is a little above 55 in floats, which must not lose the pair of 55 and 100 shingles
        got = dedup.shingle_pairs(df, threshold)
        assert {(r.a, r.b): r.similarity for r in got.collect()} == {k: v for k, v in sim.items() if v >= threshold}
        assert "Generate" not in got._jdf.queryExecution().toString()  # no exchange of a row per shingle
    assert dedup.shingle_pairs(df.limit(0), 0.85).count() == 0


def test_md5_minima_of_whole_batches():
    rng = random.Random(2)
    tokens = [[], ["a"], ["é", "b"], *([rng.choice(["a", "bé", "c" * rng.randint(1, 40)]) for _ in range(rng.randint(1, 30))] for _ in range(20))]

    def slow(t, n, k=3):
        grams = {" ".join(t[i : i + k]) for i in range(max(len(t) - k + 1, 1))} if t else set()
        return [min((int.from_bytes(hashlib.md5(g.encode() + i.to_bytes(2, "big")).digest()[:4], "big") for g in grams), default=0) for i in range(n)]

    grams = dedup._grams(pa.array(["\x00".join(t) for t in tokens] + [None]), 3)
    for most in (7, 1_000_000):  # in many groups, and in one
        assert dedup._md5_minima(grams, 40, most).to_pylist() == [slow(t, 40) for t in [*tokens, []]]
