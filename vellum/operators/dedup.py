"""Quality split, exact and near duplicates of chunks.

Near duplicates replay the sequential greedy elimination exactly: MinHash bands find every pair at or above the
threshold, the pairs' connected components are independent, and the replay runs within each of them. The default hash family of
the signatures is multiply-shift; the md5 family of the original behaviour is an option.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import quality
from ..functions.text import jaccard, shingles, strip, words
from ..plans.durable import cut, moved, release
from .graph import components


def with_quality(chunks: DataFrame, text_col: str = "content", type_col: str = "chunk_type") -> DataFrame:
    return chunks.withColumn("quality", quality(F.col(text_col), F.col(type_col)))


def split_by_quality(chunks: DataFrame, least: float = 0.30, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected), both with their scores."""
    scored = with_quality(chunks, **columns)
    ok = F.col("quality.quality_score") >= least
    return scored.where(ok), scored.where(~ok)


def exact_dedup(chunks: DataFrame, text_col: str = "content", order_col: str = "chunk_ord") -> DataFrame:
    """The first chunk, by order, of each stripped content; null counts as empty.

    The first order of each content hash is a partial aggregate, so copies of one text never meet in a window.
    """
    key = F.sha2(strip(F.coalesce(F.col(text_col), F.lit(""))), 256)
    first = chunks.groupBy(key.alias("__key")).agg(F.min(order_col).alias("__first"))
    return chunks.join(first.select(F.col("__first").alias(order_col)), order_col, "left_semi")


#: MD5's constants, rotations and order of message words.
_MD5_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_R = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_MD5_G = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_MD5_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]


def _md5_block(texts: np.ndarray, slots: range) -> np.ndarray:
    """[slot, text]: the first four digest bytes of md5(text, slot as two bytes) for texts of one length up to 53 bytes, rows of ``texts``.

    Both fit one block of MD5. Steps before the slot's word depend on the text alone, those after the last change of
    the first digest word are left out.
    """
    n, length = texts.shape
    block = np.zeros((n, 64), np.uint8)
    block[:, :length] = texts
    block[:, length + 2], block[:, 56], block[:, 57] = 0x80, (length + 2) * 8 & 255, (length + 2) * 8 >> 8
    own = np.ascontiguousarray(block.view("<u4").T).astype(np.uint32)
    salt = np.zeros((len(slots), 64), np.uint8)
    salt[:, length], salt[:, length + 1] = np.asarray(slots) >> 8, np.asarray(slots) & 255
    salts = salt.view("<u4").astype(np.uint32)
    salted = {length // 4, (length + 1) // 4}
    constant = {w for w in range(16) if w * 4 > length + 2}  # but for the block's length, zeros
    message = [int(own[w, 0]) if w in constant else salts[:, w, None] + own[w] if w in salted else own[w] for w in range(16)]
    shape = (len(slots), n)
    spare = [np.empty(shape, np.uint32) for _ in range(4)]
    t, u = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    a, b, c, d = (np.full(n, x, np.uint32) for x in _MD5_START)
    for i in range(61):
        m = message[_MD5_G[i]]
        flat = i < length // 4  # alike for all slots
        f, v = (np.empty(n, np.uint32), np.empty(n, np.uint32)) if flat else (t, u)
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        if isinstance(m, int):
            f += np.uint32((m + _MD5_K[i]) & 0xFFFFFFFF)
        elif m.ndim == 1:
            f += m + np.uint32(_MD5_K[i])
        else:
            f += m
            f += np.uint32(_MD5_K[i])
        np.right_shift(f, np.uint32(32 - _MD5_R[i]), out=v)
        np.left_shift(f, np.uint32(_MD5_R[i]), out=f)
        f |= v
        out = np.empty(n, np.uint32) if flat else a if a.shape == shape and a.ndim == 2 else spare.pop()
        np.add(f, b, out=out)
        a, b, c, d = d, out, b, c
    return (b + np.uint32(_MD5_START[0])).byteswap()


def _md5_heads(texts: pa.Array, slots: range) -> np.ndarray:
    """[slot, text]: the first four digest bytes of md5(text, slot as two bytes)."""
    texts = texts.cast(pa.string())
    size = np.asarray(pc.binary_length(texts)).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts)].astype(np.int64)
    out = np.empty((len(slots), len(texts)), np.uint32)
    order = np.argsort(size, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        length = size[same[0]]
        for i in range(0, len(same), 512):  # arrays that stay in cache
            part = same[i : i + 512]
            own = data[start[part][:, None] + np.arange(length)]
            if length <= 53:
                out[:, part] = _md5_block(own, slots)
                continue
            for k, x in zip(part, own, strict=True):
                state = hashlib.md5(x.tobytes())
                for j, slot in enumerate(slots):
                    h = state.copy()
                    h.update(slot.to_bytes(2, "big"))
                    out[j, k] = int.from_bytes(h.digest()[:4], "big")
    return out


def _grams(joined: pa.Array, k: int) -> pa.Array:
    """Lists of the k-shingles of tokens joined by zero characters, repeated ones included; fewer tokens give one, none an empty list."""
    joined = pc.fill_null(joined, "")
    split = pc.split_pattern(joined, "\x00")
    n = np.where(np.asarray(pc.binary_length(joined)) > 0, np.asarray(pc.list_value_length(split)), 0)
    t = pc.list_flatten(split.filter(pa.array(n > 0)))
    row = np.repeat(np.arange(len(n)), n)
    m = max(len(t) - k + 1, 0)
    inside = row[:m] == row[k - 1 : k - 1 + m]
    runs = pc.binary_join_element_wise(*(t.slice(i, m) for i in range(k)), " ").filter(pa.array(inside))
    short = (n > 0) & (n < k)
    rows = np.concatenate([row[:m][inside], np.flatnonzero(short)])
    flat = pa.concat_arrays([runs, pc.replace_substring(joined.filter(pa.array(short)), "\x00", " ")]).take(pa.array(np.argsort(rows, kind="stable")))
    ends = np.cumsum(np.bincount(rows, minlength=len(n)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat)


def _md5_minima(grams: pa.Array, n: int, most: int = 1_000_000) -> pa.Array:
    """For each list of shingles the n minima; zeros for an empty list. A shingle of several lists is hashed once.

    Lists are taken in groups of about ``most`` shingles, and slots by 32, so what is held has a bound.
    """
    size = np.asarray(pc.fill_null(pc.list_value_length(grams), 0)).astype(np.int64)
    flat = pc.list_flatten(grams)
    out = np.zeros((len(size), n), np.int64)
    ends = np.cumsum(size)
    some = np.flatnonzero(size)
    for group in np.split(some, np.flatnonzero(np.diff(ends[some] // most)) + 1) if len(some) else []:
        first = ends[group[0]] - size[group[0]]
        coded = flat.slice(first, ends[group[-1]] - first).dictionary_encode()
        at, starts = np.asarray(coded.indices), ends[group] - size[group] - first
        for low in range(0, n, 32):
            slots = range(low, min(low + 32, n))
            for j, row in zip(slots, _md5_heads(coded.dictionary, slots), strict=True):
                out[group, j] = np.minimum.reduceat(row[at], starts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * n), pa.array(out.reshape(-1)))


def _affine_minima(hashes: pa.Array, n: int) -> pa.Array:
    """For each list of 64-bit hashes the least upper half of a * h + b for n fixed pairs (a, b); zeros for an empty list."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, 1 << 62, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 62, n, np.uint64)
    size = np.asarray(pc.fill_null(pc.list_value_length(hashes), 0))
    h = np.asarray(pc.list_flatten(hashes)).view(np.uint64)
    out = np.zeros((len(size), n), np.int64)
    ends = np.cumsum(size)
    some = np.flatnonzero(size)
    step = ends[some] // 65_536  # lists in groups of bounded size, so the products stay in cache
    for group in np.split(some, np.flatnonzero(np.diff(step)) + 1) if len(some) else []:
        first = ends[group[0]] - size[group[0]]
        part = h[first : ends[group[-1]]]
        starts = ends[group] - size[group] - first
        with np.errstate(over="ignore"):
            for i in range(n):
                out[group, i] = (np.minimum.reduceat(part * a[i] + b[i], starts) >> np.uint64(32)).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * n), pa.array(out.reshape(-1)))


def minhash_md5(tokens: Column, n: int = 128, k: int = 3) -> Column:
    """n slots of 32 bits: minima over the k-shingles of md5(shingle, slot number); zeros for no tokens.

    The hashes of a batch's distinct shingles are computed together, in NumPy.
    """

    @F.arrow_udf("array<bigint>")
    def signature(joined: pa.Array) -> pa.Array:
        return _md5_minima(_grams(joined, k), n)

    return signature(F.array_join(tokens, "\x00"))


def with_minhash(df: DataFrame, tokens: Column, out: str = "signature", n: int = 128, k: int = 3) -> DataFrame:
    """Adds n slots of 32 bits: minima over the k-shingles of multiply-shift hashes; zeros for no tokens.

    Each shingle is hashed once, in the JVM; the minima are taken over whole Arrow batches.
    """
    df = df.withColumn(out, F.transform(shingles(tokens, k), lambda g: F.xxhash64(g)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(out)
            yield b.set_column(at, out, _affine_minima(b.column(at), n))

    return df.mapInArrow(run, df.schema)


def bands_for(threshold: float, n: int = 128) -> int:
    """Number of bands that no pair at or above the threshold can miss: one more than the slots it may differ in."""
    return n - int(np.ceil(threshold * n - 1e-9)) + 1


def richness(chunks: DataFrame, text_col: str = "content") -> Column:
    has = lambda c: F.coalesce(F.length(F.col(c)) > 0, F.lit(False)) if c in chunks.columns else F.lit(False)
    count = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)) if c in chunks.columns else F.lit(0)
    bonus = lambda c, v: F.when(c, v).otherwise(0)
    return (
        F.length(F.coalesce(F.col(text_col), F.lit(""))) + bonus(has("caption"), 500) + bonus(has("caption_label"), 300) + bonus(count("references") > 0, 100)
        + 50 * count("links") + bonus(has("section_heading"), 200) + bonus(has("parent_id"), 100)
    )


def duplicate_edges(chunks: DataFrame, threshold: float = 0.85, n: int = 128, md5: bool = False, exact: bool = False, text_col: str = "content", order_col: str = "chunk_ord", k: int = 3) -> DataFrame:
    """(a, b, similarity) with a < b: pairs at or above the threshold whose token counts are within a factor of two.

    The bands' pairs are complete for the MinHash similarity. The replay needs every edge, so exact copies should be
    removed first (``exact_dedup``): they are what makes buckets hot.
    """
    base = chunks.select(F.col(order_col).alias("i"), words(F.col(text_col)).alias("tokens")).where(F.size("tokens") > 0)
    kept = base.select("i", "tokens", F.size("tokens").alias("n"))
    signed = kept.withColumn("sig", minhash_md5(F.col("tokens"), n, k)) if md5 else with_minhash(kept, F.col("tokens"), "sig", n, k)
    s = cut(signed if exact else signed.drop("tokens"))
    bands = bands_for(threshold, n)
    edges = [n * j // bands for j in range(bands + 1)]
    key = F.array(*(F.struct(F.lit(j).alias("band"), F.xxhash64(F.slice("sig", edges[j] + 1, edges[j + 1] - edges[j])).alias("h")) for j in range(bands)))
    banded = s.select("i", "n", F.explode(key).alias("k")).select("i", "n", "k.*")
    a, b = banded.alias("a"), banded.alias("b")
    near = F.expr("a.band = b.band and a.h = b.h and a.i < b.i and least(a.n, b.n) * 2 >= greatest(a.n, b.n)")
    pairs = a.join(b, near).select(F.col("a.i").alias("a"), F.col("b.i").alias("b")).distinct()
    side = lambda x: s.select(F.col("i").alias(x), F.col("sig").alias(f"s{x}"), *([F.col("tokens").alias(f"t{x}")] if exact else []))
    left, right = side("a"), side("b")
    both = pairs.join(left, "a").join(right, "b")
    if exact:
        sim = jaccard(shingles(F.col("ta"), k), shingles(F.col("tb"), k))
    else:
        sim = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e)) / F.lit(float(n))
    return both.select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= threshold)


def _replay(group: pa.Table) -> pa.Table:
    """Survivors of one component: rows (i, rich, others) in order of i; the poorer of each living pair goes, ties drop the later."""
    d = group.sort_by("i").to_pydict()
    rich = dict(zip(d["i"], d["rich"], strict=True))
    dead: set[int] = set()
    for i, others in zip(d["i"], d["others"], strict=True):
        for j in sorted(others or []):
            if i in dead:
                break
            if j not in dead:
                dead.add(i if rich[j] > rich[i] else j)
    return pa.table({"i": pa.array([i for i in d["i"] if i in dead], group.schema.field("i").type)})


def _rounds(edges: DataFrame, rich: DataFrame) -> DataFrame:
    """(i) of the items that the greedy elimination drops, by joins only, whatever the size of a component.

    The elimination takes pairs (a, b) in order. In a round every pair acts that comes first of the living pairs of both
    its ends: no earlier pair can change what it does. Beyond it, an item all of whose pairs come first for their other
    ends acts on them at once, up to the one that is richer than itself. Both drop the poorer end, and its pairs.
    """
    e = cut(edges.select("a", "b").join(rich.select(F.col("i").alias("a"), F.col("rich").alias("ra")), "a").join(rich.select(F.col("i").alias("b"), F.col("rich").alias("rb")), "b"))
    gone: DataFrame | None = None
    while not e.isEmpty():  # the first of all pairs acts in every round
        pair = F.struct("a", "b")
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("i"), pair.alias("p")), F.struct(F.col("b").alias("i"), pair.alias("p")))).alias("x")).select("x.*")
        first = ends.groupBy("i").agg(F.min("p").alias("p"))
        marked = e.join(first.select(F.col("i").alias("a"), F.col("p").alias("pa")), "a").join(first.select(F.col("i").alias("b"), F.col("p").alias("pb")), "b")
        marked = marked.withColumn("mine", F.col("pb") == pair)
        # of an item that no earlier pair waits for, the pairs up to the first that another item has first, or that beats it
        stop = marked.where(~F.col("mine") | (F.col("rb") > F.col("ra"))).groupBy("a").agg(F.min("b").alias("stop"))
        act = marked.where(F.col("pa.a") == F.col("a")).join(stop, "a", "left").where("mine and (stop is null or b <= stop)")
        act = cut(act.select("a", "b", F.when(F.col("rb") > F.col("ra"), F.col("a")).otherwise(F.col("b")).alias("i")))
        dead = act.select("i").distinct()
        left = e.join(act.select("a", "b"), ["a", "b"], "left_anti")
        left = cut(left.join(dead.select(F.col("i").alias("a")), "a", "left_anti").join(dead.select(F.col("i").alias("b")), "b", "left_anti"))
        gone = dead if gone is None else gone.unionByName(dead)
        release(e)
        e = left
    return gone if gone is not None else edges.select(F.col("a").alias("i")).limit(0)


def near_dedup(chunks: DataFrame, threshold: float = 0.85, text_col: str = "content", order_col: str = "chunk_ord", most: int = 100_000, **options) -> DataFrame:
    """The chunks that the greedy elimination keeps.

    Components are replayed one by one within tasks; those with more than ``most`` members, which a task should not
    hold, in rounds of joins. Both give the same chunks.
    """
    e = cut(duplicate_edges(chunks, threshold, text_col=text_col, order_col=order_col, **options))
    comp = cut(components(e))
    rich = chunks.select(F.col(order_col).alias("i"), richness(chunks, text_col).cast("long").alias("rich"))
    large = cut(comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("component"))
    own = comp.select(F.col("id").alias("i"), "component")
    others = e.groupBy(F.col("a").alias("i")).agg(F.collect_list("b").alias("others"))
    members = own.join(large, "component", "left_anti").join(rich, "i").join(others, "i", "left")
    dead = members.groupBy("component").applyInArrow(_replay, f"i {chunks.schema[order_col].dataType.simpleString()}")
    if not large.isEmpty():
        hot = own.join(large, "component").select("i")
        dead = dead.unionByName(_rounds(e.join(hot.withColumnRenamed("i", "a"), "a"), rich.join(hot, "i")))
    return chunks.join(dead.select(F.col("i").alias(order_col)), order_col, "left_anti")


#: Documents in pairs below which their ids are broadcast.
BROADCAST_ROWS = 200_000
#: Counters of the frequency sketch, as a power of two, and of a block in which they travel.
SKETCH_BITS, BLOCK_BITS = (16, 25), 16


def _shingle_sets(joined: pa.Array, k: int, hashed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle): the distinct k-shingles of each row's tokens, joined by zero characters, sorted by row.

    They are told apart by their tokens; what is returned are hashes of 64 bits or, not ``hashed``, numbers that equal
    shingles of this array share.
    """
    joined = pc.fill_null(joined, "")
    split = pc.split_pattern(joined, "\x00")
    n = np.where(np.asarray(pc.binary_length(joined)) > 0, np.asarray(pc.list_value_length(split)), 0)
    coded = pc.list_flatten(split.filter(pa.array(n > 0))).dictionary_encode()
    padded = np.where(n > 0, np.maximum(n, k), 0)  # fewer than k tokens are filled up by zeros
    row = np.repeat(np.arange(len(n)), padded)
    place = np.arange(len(row)) - (np.cumsum(padded) - padded)[row]
    codes = np.zeros(len(row), np.int64)
    codes[place < n[row]] = np.asarray(coded.indices) + 1
    at = np.flatnonzero(place <= padded[row] - k)
    base = len(coded.dictionary) + 1
    key, top = codes[at], base
    for j in range(1, k):
        if top * base >= 1 << 63:
            values, key = np.unique(key, return_inverse=True)
            top = len(values)
        key, top = key * base + codes[at + j], top * base
    order = np.lexsort((key, row[at]))
    at, key = at[order], key[order]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[at[1:]] != row[at[:-1]])
    at, key = at[new], key[new]
    if not hashed:
        return row[at], key
    words = np.array([0, *(int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest()) for w in coded.dictionary.to_pylist())], np.uint64)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ (h >> np.uint64(29)) ^ words[codes[at + j]]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return row[at], h


def _frequencies(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """2^bits counters of the shingles of ``docs`` (t: joined tokens) by their hashes, as 0, 1 or the logarithm of the count."""
    block = 1 << min(bits, BLOCK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint32)
        for b in batches:
            at, n = np.unique(_shingle_sets(b.column("t"), k)[1] >> np.uint64(64 - bits), return_counts=True)
            table[at] += n.astype(np.uint32)
        for i, part in enumerate(table.reshape(-1, block)):
            if part.any():
                part = np.minimum(part, 65_535).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "data"])

    def total(group: pa.Table) -> pa.Table:
        n = np.zeros(block, np.uint32)
        for data in group.column("data"):
            n += np.frombuffer(zlib.decompress(data.as_py()), np.uint16)
        code = np.where(n > 1, 1 + np.ceil(4 * np.log2(np.maximum(n, 1))), n).astype(np.uint8)
        return pa.table({"block": group.column("block").slice(0, 1), "data": pa.array([zlib.compress(code.tobytes(), 1)], pa.binary())})

    out = np.zeros((1 << bits) // block * block, np.uint8).reshape(-1, block)
    for r in docs.select("t").mapInArrow(count, "block int, data binary").groupBy("block").applyInArrow(total, "block int, data binary").toLocalIterator():
        out[r.block] = np.frombuffer(zlib.decompress(r.data), np.uint8)
    return out.reshape(-1)


def _prefixes(docs: DataFrame, k: int, threshold: float, bits: int) -> DataFrame:
    """(h, i, n, pos): hashes of the rarest n - ceil(t n) + 1 shingles of each row (i, t: joined tokens), but for those that occur once."""
    sent = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, k, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, h = _shingle_sets(b.column("t"), k)
            n = np.bincount(row, minlength=b.num_rows)
            often = sent.value[h >> np.uint64(64 - bits)]
            order = np.lexsort((h, often, row))
            pos = np.arange(len(order)) - (np.cumsum(n) - n)[row]
            keep = (pos <= (n - np.ceil(threshold * n - 1e-9).astype(np.int64))[row]) & (often[order] > 1)
            order, r = order[keep], row[keep]
            yield pa.RecordBatch.from_arrays([pa.array(h[order].view(np.int64)), b.column("i").take(pa.array(r)), pa.array(n[r].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], names=["h", "i", "n", "pos"])

    return docs.mapInArrow(run, f"h long, i {docs.schema['i'].dataType.simpleString()}, n int, pos int")


def _similarities(pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, similarity): Jaccard of the shingles of both joined token lists, ta and tb, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                b = batch.slice(at, 2_000)
                row, key = _shingle_sets(pa.concat_arrays([b.column("ta"), b.column("tb")]), k, hashed=False)
                size = np.bincount(row, minlength=2 * b.num_rows).reshape(2, -1).sum(0)
                row %= b.num_rows
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                common = np.bincount(row[1:][(row[1:] == row[:-1]) & (key[1:] == key[:-1])], minlength=b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(common / (size - common))], names=["a", "b", "similarity"])

    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def shingle_pairs(chunks: DataFrame, threshold: float, text_col: str = "content", order_col: str = "chunk_ord", k: int = 3) -> DataFrame:
    """(a, b, similarity) by exact Jaccard of k-shingles over all chunks, through an inverted index with prefix filter.

    Shingles are ordered by frequency; sets that reach the threshold share one among the rarest n - ceil(t n) + 1. Only
    the hashes of these are exchanged, and the texts of chunks in a candidate pair, whose shingles are then compared as
    they are. The frequencies come from a sketch that every task reads; shingles that share a counter or a hash are
    ordered otherwise or give more candidates, but no pair is lost.
    """
    rows = chunks.select(F.col(order_col).alias("i"), F.col(text_col).alias("t")).where("i is not null")
    docs = rows.withColumn("t", F.array_join(words(F.col("t")), "\x00"))
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(size / 6, 1))), *SKETCH_BITS))  # about a counter for each word
    posts = _prefixes(docs, k, threshold, bits)
    a, b = posts.alias("a"), posts.alias("b")
    need = f"ceil({threshold / (1 + threshold)!r}D * (a.n + b.n) - 1e-6)"
    near = f"a.h = b.h and a.i < b.i and least(a.n, b.n) >= {threshold!r}D * greatest(a.n, b.n) - 1e-6 and a.pos <= a.n - {need} and b.pos <= b.n - {need}"
    pairs = moved(a.join(b, F.expr(near)).select(F.col("a.i").alias("a"), F.col("b.i").alias("b")).distinct())
    ids = cut(pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct())
    few = F.broadcast(ids) if ids.count() < BROADCAST_ROWS else ids
    own = rows.join(few, "i", "left_semi").withColumn("t", F.array_join(words(F.col("t")), "\x00"))
    x, y = own.select(F.col("i").alias("a"), F.col("t").alias("ta")), own.select(F.col("i").alias("b"), F.col("t").alias("tb"))
    return _similarities(pairs.join(x, "a").join(y, "b"), k).where(F.col("similarity") >= threshold)
