"""The k most similar vectors of every vector by multi-index hashing.

A rotation is learned on a bounded sample (principal axes, then iterative quantisation); the signs of the rotated
vector are its code of four substrings, each about as many bits wide as the number of vectors has, so that a bucket
holds about one vector whatever their number. Two codes within Hamming distance 4 (r + 1) - 1 differ in at most r bits
of one of the substrings, so probing each substring at that radius finds every code within it. Only codes move for
that: halves of substrings are the keys of the exchange (with r flips in a substring, one half has at most r / 2), the
flips of the other half are looked up within a task. Queries that have found fewer than k codes within the distance so
covered probe again with radius 2; what is still open is searched exactly, in blocks of queries against all rows.

The pairs found are reranked by the cosine of the floats. For that vectors go to the two nearest of some hundreds of
centroids, and a pair meets in a cell that both have; pairs without one, or of an overfull cell, are joined by id.
No pair is dropped by a cap.

Defined results: vectors that are null, of another length, all zero, or hold null, NaN or infinite values take no
part. Rows with one id count once (the one of the lowest hash). Equal vectors form one class: any of them can only
have the k + 1 lowest ids of a class among its k best, ties going to the lower id, so no class is written out in
pairs. With fewer than k others, all are neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import cut

#: Substrings of a code; each has a lane of 32 bits in the two longs of a code.
M = 4
#: Vectors of a cell beyond which its pairs are joined by id instead.
MAX_CELL = 200_000
#: Rows below which a side is broadcast.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    rotation: np.ndarray
    centroids: np.ndarray

    @property
    def width(self) -> int:
        return self.rotation.shape[1] // M

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The four substrings of each code, two to a long."""
        bits = (x - self.mean) @ self.rotation > 0
        lanes = np.zeros((len(x), M, 32), bool)
        lanes[:, :, : self.width] = bits.reshape(len(x), M, self.width)
        packed = np.packbits(lanes.reshape(len(x), -1), axis=1, bitorder="little").view(np.int64)
        return packed[:, 0], packed[:, 1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The two nearest centroids."""
        near = x @ self.centroids.T
        first = near.argmax(axis=1)
        near[np.arange(len(x)), first] = -np.inf
        second = near.argmax(axis=1) if near.shape[1] > 1 else first
        return np.stack([first, second], axis=1)


def width_for(n: int) -> int:
    """Bits of a substring: about log2 of the number of vectors, even, since it has two halves, and enough to tell vectors apart."""
    return min(32, max(16, 2 * ((int(n).bit_length() + 1) // 2)))


def fit_coder(x: np.ndarray, bits: int = 64, rounds: int = 20, seed: int = 11, cells: int = 1) -> Coder:
    """Iterative quantisation: alternate the nearest sign vectors and the rotation that best maps onto them."""
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    v = x - mean
    dim = x.shape[1]
    rng = np.random.default_rng(seed)
    _, axes = np.linalg.eigh(v.T @ v + 1e-9 * np.eye(dim))
    basis = axes[:, ::-1][:, :bits]
    if bits > dim:  # more bits than axes: random directions for the rest
        basis = np.concatenate([basis, rng.standard_normal((dim, bits - dim)) / np.sqrt(dim)], axis=1)
    p = v @ basis
    r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(p @ r > 0, 1.0, -1.0).T @ p)
        r = (u @ w).T
    centroids = x[rng.permutation(len(x))[:cells]] if len(x) else np.zeros((1, dim))
    for _ in range(6 if len(x) > cells else 0):
        at = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return Coder(mean.astype(np.float32), (basis @ r).astype(np.float32), centroids.astype(np.float32))


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the usable rows, and which rows those are."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    whole = lengths == dim
    flat = pc.list_flatten(column.filter(pa.array(whole)))
    x = np.asarray(pc.fill_null(flat, float("nan")).cast(pa.float64())).reshape(-1, dim)
    norm = np.sqrt((x * x).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    ok = np.flatnonzero(whole)[good]
    return (x[good] / norm[good, None]).astype(np.float32), ok


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of a float32 matrix as bytes."""
    offsets = pa.py_buffer((np.arange(len(x) + 1) * x.shape[1] * 4).astype(np.int32).tobytes())
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def unit_vectors(df: DataFrame, key: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec): usable rows scaled to length 1, as float32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = _unit(batch.column("v"), dim)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ok)), _binary(x)], names=["id", "vec"])

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    return rows.mapInArrow(run, "id long, vec binary")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _sized(df: DataFrame) -> DataFrame:
    """Broadcast if small, by a count."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _coded(vectors: DataFrame, coder, dim: int) -> DataFrame:
    """(id, lo, hi, c1, c2): the code and the two cells of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vec"), dim)
                lo, hi = coder.value.codes(x)
                cells = coder.value.cells(x).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lo), pa.array(hi), pa.array(cells[:, 0]), pa.array(cells[:, 1])], names=["id", "lo", "hi", "c1", "c2"])

    return vectors.select("id", "vec").mapInArrow(run, "id long, lo long, hi long, c1 int, c2 int")


def _flips(bits: int, most: int) -> list[int]:
    """All differences of a value of this many bits in up to ``most`` of them."""
    return [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(bits), n)]


def _substring(lo: np.ndarray, hi: np.ndarray, s: int) -> np.ndarray:
    return ((lo if s < 2 else hi) >> np.uint64(32 * (s & 1))) & np.uint64(0xFFFFFFFF)


def _ways(width: int, radius: int) -> list[tuple[int, int, list[int]]]:
    """(half, flips of the exchange key, flips to look up in the other half): each difference of up to ``radius`` bits once.

    A half has at most half of the flips, rounded down; a difference that either half could carry goes by the lower one.
    """
    half = width // 2
    out = []
    for used in range(radius // 2 + 1):
        for key in (x for x in _flips(half, used) if x.bit_count() == used):
            out.append((0, key, _flips(half, radius - used)))
            out.append((1, key, [x for x in _flips(half, radius - used) if x.bit_count() > radius // 2]))
    return out


def _probe(queries: DataFrame, index: DataFrame, width: int, radius: int, reach: int, symmetric: bool, n: int = 0) -> DataFrame:
    """(cell, a, b, h) with a < b: codes that differ in at most ``radius`` bits of some substring and ``reach`` in all; cell -1: none in common.

    Exchanged are (key, id, code, cells): per substring and half the half's value, for queries with its flips. If the
    queries are the index itself, one set of rows serves as both.
    """
    half = width // 2
    ways = _ways(width, radius)
    low = np.uint64((1 << half) - 1)
    keys = sorted({(h, k) for h, k, _ in ways}) if not symmetric else [(0, 0), (1, 0)]
    assert not symmetric or all(k == 0 for _, k, _ in ways)
    part = lambda s, h: f"(shiftrightunsigned({'lo' if s < 2 else 'hi'}, {32 * (s & 1) + half * h}) & {(1 << half) - 1})"
    slot = lambda s, h, flip: f"named_struct('g', ({part(s, h)} ^ {flip}L) * {2 * M} + {2 * s + h}, 'flip', {flip}L)"
    rows = lambda df, which, asks: df.select("id", "lo", "hi", "c1", "c2", F.lit(asks).alias("asks"), F.explode(F.array(*(F.expr(slot(s, h, k)) for s in range(M) for h, k in which))).alias("k")).select("id", "lo", "hi", "c1", "c2", "asks", "k.g", "k.flip")
    sent = rows(index, [(0, 0), (1, 0)], symmetric)
    if not symmetric:
        sent = sent.unionByName(rows(queries, keys, True))
    names = ["cell", "a", "b", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        col = lambda c: np.asarray(t.column(c).combine_chunks())
        ids, c1, c2, g, flip = (col(c) for c in ("id", "c1", "c2", "g", "flip"))
        lo, hi = (col(c).view(np.uint64) for c in ("lo", "hi"))
        asks = np.asarray(t.column("asks").combine_chunks().cast(pa.int8())).astype(bool)
        is_index = ~asks if not symmetric else np.ones(len(ids), bool)
        for sh in range(2 * M):
            s, h = divmod(sh, 2)
            mine = (g % (2 * M)) == sh
            i = np.flatnonzero(mine & is_index)
            if not len(i):
                continue
            other = lambda at, s=s, h=h: (_substring(lo[at], hi[at], s) >> np.uint64(half * (1 - h))) & low
            place = (g[i].astype(np.uint64) // np.uint64(2 * M) << np.uint64(half)) | other(i)
            order = np.argsort(place, kind="stable")
            place, i = place[order], i[order]
            for way, key, looks in ways:
                if way != h:
                    continue
                q = np.flatnonzero(mine & asks & (flip == key))
                base = (g[q].astype(np.uint64) // np.uint64(2 * M) << np.uint64(half)) | other(q)
                for look in looks:
                    want = base ^ np.uint64(look)
                    first = np.searchsorted(place, want)
                    n = np.searchsorted(place, want, side="right") - first
                    some = np.flatnonzero(n)
                    # in steps of bounded size, however many share a bucket
                    step = np.cumsum(n[some]) // 1_000_000
                    for piece in np.split(some, np.flatnonzero(np.diff(step)) + 1) if len(some) else []:
                        m = n[piece]
                        a = np.repeat(q[piece], m)
                        b = i[np.repeat(first[piece] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
                        keep = ids[a] < ids[b] if symmetric else ids[a] != ids[b]
                        a, b = a[keep], b[keep]
                        x, y = lo[a] ^ lo[b], hi[a] ^ hi[b]
                        far = np.bitwise_count(x).astype(np.int32) + np.bitwise_count(y).astype(np.int32)
                        new = far <= reach
                        for earlier in range(s):  # found at an earlier substring already
                            new &= np.bitwise_count(_substring(x, y, earlier)) > radius
                        a, b, far = a[new], b[new], far[new]
                        cell = np.where((c1[a] == c1[b]) | (c1[a] == c2[b]), c1[a], np.where(c2[a] == c1[b], c1[b], np.where(c2[a] == c2[b], c2[a], -1)))
                        u, v = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
                        if len(u):
                            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(u), pa.array(v), pa.array(far)], names=names)

    return _exchanged(sent, n // 65_536, "g").mapInArrow(run, "cell int, a long, b long, h int")


def _best(ids: np.ndarray, other: np.ndarray, cosine: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each id, ties to the lower other id."""
    order = np.lexsort((other, -cosine, ids))
    ids, other, cosine = ids[order], other[order], cosine[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0)) if len(ids) else first
    keep = np.arange(len(ids)) - start < k
    return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(other[keep]), pa.array(cosine[keep])], names=NEAR_NAMES)


NEAR, NEAR_NAMES = "id long, other long, cosine double", ["id", "other", "cosine"]


def _in_cells(pairs: DataFrame, vectors: DataFrame, coder, dim: int, k: int, n: int) -> DataFrame:
    """The k best of each id in each task, of the pairs that meet in a cell; ``n`` is the number of vectors."""
    asked = pairs.select("cell", "a", "b")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = coder.value.cells(_matrix(batch.column("vec"), dim)).astype(np.int32)
                for j in range(2):
                    use = pa.array((cells[:, j] != cells[:, 0]) | (j == 0))
                    yield pa.RecordBatch.from_arrays([pa.array(cells[:, j]).filter(use), batch.column("id").filter(use), batch.column("vec").filter(use)], names=["cell", "id", "vec"])

    placed = vectors.select("id", "vec").mapInArrow(spread, "cell int, id long, vec binary")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        is_pair = pc.is_valid(t.column("b"))
        right, left = t.filter(pc.invert(is_pair)), t.filter(is_pair)
        ids, at = np.unique(np.asarray(right.column("a").combine_chunks()), return_index=True)  # a redelivered row counts once
        a, b = (np.searchsorted(ids, np.asarray(left.column(c).combine_chunks())) for c in ("a", "b"))
        place = np.unique(a * len(ids) + b)  # both probings may have found a pair
        if not len(place):
            return
        i, j = place // len(ids), place % len(ids)
        x = _matrix(right.column("vec"), dim)[at]
        cosine = np.empty(len(i))
        for p in range(0, len(i), 50_000):
            s = slice(p, p + 50_000)
            cosine[s] = np.einsum("ij,ij->i", x[i[s]].astype(np.float64), x[j[s]].astype(np.float64))
        yield _best(np.concatenate([ids[i], ids[j]]), np.concatenate([ids[j], ids[i]]), np.concatenate([cosine, cosine]), k)

    none = lambda t: F.lit(None).cast(t)
    rows = asked.select("cell", "a", "b", none("binary").alias("vec")).unionByName(placed.select("cell", F.col("id").alias("a"), none("long").alias("b"), "vec"))
    return _exchanged(rows, n // 16_384, "cell").mapInArrow(rank, NEAR)


def _exchanged(df: DataFrame, parts: int, by: str) -> DataFrame:
    """By hash of a column, in the session's number of partitions or in more where that many rows need them."""
    return df.repartition(parts, by) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(by)


def _by_id(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Both directions of the pairs with their cosines, by joins on the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_matrix(batch.column(c), dim).astype(np.float64) for c in ("x", "y"))
                a, b = (np.asarray(batch.column(c)) for c in ("a", "b"))
                cosine = np.einsum("ij,ij->i", x, y)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a])), pa.array(np.concatenate([cosine, cosine]))], names=NEAR_NAMES)

    v = vectors.select("id", "vec")
    asked = pairs.select("a", "b").distinct()
    small = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    both = v.select(F.col("id").alias("a"), F.col("vec").alias("x")).join(hint(asked), "a")
    both = v.select(F.col("id").alias("b"), F.col("vec").alias("y")).join(hint(both), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, NEAR)


def _packed(vectors: DataFrame, dim: int, rows: int) -> DataFrame:
    """Blocks (ids, vecs) of at most ``rows`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(part.column("id")).tobytes()], pa.binary()), pa.array([_matrix(part.column("vec"), dim).tobytes()], pa.binary())], names=["ids", "vecs"])

    return vectors.select("id", "vec").mapInArrow(run, "ids binary, vecs binary")


def _exact(open_: DataFrame, vectors: DataFrame, k: int, dim: int, block: int = 4096) -> DataFrame:
    """Neighbours of the remaining queries: blocks of at most ``block`` queries against blocks of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qi, qv, oi, ov in zip(*(batch.column(c).to_pylist() for c in ("qids", "qvecs", "ids", "vecs")), strict=True):
                ids, own = np.frombuffer(qi, np.int64), np.frombuffer(oi, np.int64)
                own, first = np.unique(own, return_index=True)
                q, x = (np.frombuffer(v, np.float32).reshape(-1, dim).astype(np.float64) for v in (qv, ov))
                sim = q @ x[first].T
                sim[ids[:, None] == own[None, :]] = -np.inf
                n = min(k, sim.shape[1])
                cutoff = -np.partition(-sim, n - 1, axis=1)[:, n - 1]
                i, j = np.nonzero((sim >= cutoff[:, None]) & np.isfinite(sim))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[j]), pa.array(sim[i, j])], names=NEAR_NAMES)

    queries = _packed(open_, dim, block).select(F.col("ids").alias("qids"), F.col("vecs").alias("qvecs"))
    return _packed(vectors, dim, 4 * block).crossJoin(queries).mapInArrow(run, NEAR)


def nearest(df: DataFrame, key: str = "vec_id", vec_col: str = "embedding", k: int = 5, dim: int = 64, sample: int = 20_000, radii: tuple[int, ...] = (1, 2), width: int | None = None) -> DataFrame:
    """(id, other, cosine, rank): the k most similar vectors of every usable vector.

    ``sample`` bounds the vectors that the rotation and the centroids are learned on (those of the lowest hash of the id).
    """
    spark = df.sparkSession
    units = unit_vectors(df, key, vec_col, dim)
    same = ["h1", "h2"]
    hashed = units.select("id", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"))
    of_id = hashed.groupBy("id").agg(F.min(F.struct(*same)).alias("v"), F.max(F.struct(*same)).alias("w")).select("id", "v.*", (F.col("v") != F.col("w")).alias("several"))
    low = of_id.groupBy(*same).agg(F.min("id").alias("rep"))
    member = cut(of_id.join(low, same).select("id", "rep", "several", *same))
    # one physical vector stands for each class: rows of other members, and other vectors of an id, are left out
    copies = member.where("id <> rep").select("id")
    odd = member.where("several and id = rep").select("id", *same)
    vectors = units.join(_sized(copies), "id", "left_anti")
    if not odd.isEmpty():
        vectors = vectors.join(_sized(odd.select("id", F.col("h1").alias("g1"), F.col("h2").alias("g2"))), "id", "left").where("g1 is null or (g1 = xxhash64(vec) and g2 = hash(vec))").select("id", "vec")
    n = member.where("id = rep").count()
    width = width or width_for(n)
    got = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toPandas()
    x = np.unique(np.frombuffer(b"".join(map(bytes, got.vec)), np.float32).reshape(-1, dim), axis=0)
    coder = spark.sparkContext.broadcast(fit_coder(x, M * width, cells=min(4096, max(1, n // 256))))
    coded = cut(_coded(vectors, coder, dim).dropDuplicates(["id"]))
    crowded = [r.c for r in coded.select(F.explode(F.array("c1", "c2")).alias("c")).groupBy("c").count().where(F.col("count") > MAX_CELL).collect()]  # of at most 4096 cells
    pairs, asking, reach = [], coded, M * (radii[-1] + 1) - 1
    for i, radius in enumerate(radii):
        pairs.append(cut(_probe(asking, coded, width, radius, reach, i == 0, n)))
        sure = M * (radius + 1) - 1  # every code within this distance has been found
        near = pairs[-1].where(F.col("h") <= sure).select("a", "b").distinct() if i else pairs[-1].where(F.col("h") <= sure)
        found = near.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        asking = cut(asking.join(found, "id", "left").where(F.coalesce("n", F.lit(0)) < k).select(*coded.columns))
    every = reduce(DataFrame.unionByName, pairs)
    apart = F.col("cell").isin([-1, *crowded])
    both = _in_cells(every.where(~apart), vectors, coder, dim, k, n).unionByName(_by_id(every.where(apart), vectors, dim))
    if not asking.isEmpty():
        both = both.unionByName(_exact(vectors.join(_sized(asking.select("id")), "id", "left_semi"), vectors, k, dim))
    by = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    best = cut(both.distinct().withColumn("r", F.row_number().over(by)).where(F.col("r") <= k))
    # from classes to vectors: of each class only its k + 1 lowest ids can be among a vector's k best
    several = member.join(_sized(copies.join(member, "id").select("rep").distinct()), "rep", "left_semi").select("rep", "id")
    first = several.withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("i") <= k + 1).groupBy("rep").agg(F.collect_list("id").alias("ids"))
    own = first.select(F.col("rep").alias("id"), F.col("rep").alias("other"), F.lit(1.0).alias("cosine"))
    targets = best.select("id", "other", "cosine").unionByName(own).join(_sized(first.withColumnRenamed("rep", "other")), "other", "left").select("id", F.explode(F.coalesce("ids", F.array("other"))).alias("other"), "cosine")
    short = targets.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).drop("r")
    asked = short.join(_sized(several.select(F.col("rep").alias("id"), F.col("id").alias("asked"))), "id", "left").select(F.coalesce("asked", "id").alias("id"), "other", "cosine")
    return asked.where("id <> other").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("id", "other", "cosine", "rank")


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """Unordered pairs (a < b) of which one is among the other's k best."""
    return neighbours.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
