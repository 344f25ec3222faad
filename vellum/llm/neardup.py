"""Near-duplicate records by prefix filters under several global token orders.

A record is the set of hashes of its sequences of three successive words. If two sets are similar enough, then
under any global order of the tokens their prefixes share a token. The first order puts rare tokens first; each
class of equal sets posts the tokens of its prefix that occur elsewhere, a join on the token with length,
position and 128-bit parity filters gives candidates, which 512-bit parities thin out. The second order (magnitude of the frequency, then another
hash) is indexed over the classes that are still candidates, and only pairs that both orders give are verified on
the full sets.

The frequencies come from a sketch over all records with about a counter per token up to 2^26 counters of one byte,
the logarithm of the count: beyond that several tokens share a counter, whose sum still tells common phrases from the
rest, and a token only moves within the order, which any order survives. The postings are exchanged in as many
partitions as they fill at ``POSTINGS`` rows each. Nothing is capped: every pair of classes at or above the threshold
comes out, equal sets form one class with a membership table.

Defined results: records below ``min_words`` words (null and empty ones too) take no part; redelivered rows
count once; ties don't arise. Token hashes have 52 bits (44 in postings), sets are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import drop_shuffles, moved, release
from . import sketch
from .textkit import DIGIT, LETTER, TextBatch, map_texts, mix

ONCE = int(sketch.code(np.array([1]))[0])
#: Words of 64 bits of the parities that thin out the candidates.
PARITY = 8
#: Rows below which a side is broadcast.
BROADCAST_ROWS = 200_000
#: Postings of a partition of their exchange, and characters of text for one token.
POSTINGS, CHARS_PER_TOKEN = 750_000, 6


@dataclass(frozen=True)
class Spec:
    threshold: float = 0.7
    shingle: int = 3
    min_words: int = 30

    @property
    def per_mille(self) -> int:
        return round(self.threshold * 1000)

    def overlap_sql(self, a: str, b: str) -> str:
        """Least number of common tokens of sets of these sizes."""
        t = self.per_mille
        return f"(({t} * ({a} + {b}) + {999 + t}) div {1000 + t})"


def token_sets(b: TextBatch, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens as (row, 52-bit hash), sorted, and the number of tokens of each row (0: takes no part)."""
    ws, we = b.runs(LETTER | DIGIT)
    row = b.rows_of(ws)
    h = b.hashes(ws, we)
    k = spec.shingle
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(b.size, np.int64)
    many = np.bincount(row, minlength=b.size) >= max(spec.min_words, k)
    m = len(h) - k + 1
    s = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m]
    s = mix(s) >> np.uint64(12)
    ok = (row[:m] == row[k - 1 :]) & many[row[:m]]
    key = np.sort((row[:m][ok].astype(np.uint64) << np.uint64(52)) | s[ok])
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    r = (key >> np.uint64(52)).astype(np.int64)
    return r, key & np.uint64((1 << 52) - 1), np.bincount(r, minlength=b.size)


def _reduce(op: np.ufunc, values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``op`` over the values of each row that has any."""
    starts = np.cumsum(n) - n
    out = np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        out[some] = op.reduceat(values, starts[some])
    return out


def signatures(tokens: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each row's set."""
    with np.errstate(over="ignore"):
        return mix(_reduce(np.add, mix(tokens + np.uint64(1)), n) + n.astype(np.uint64)).view(np.int64)


def parities(row: np.ndarray, tokens: np.ndarray, rows: int, words: int) -> np.ndarray:
    """Per row the parity of its tokens in each of 64 * ``words`` classes; two sets differ in at least as many tokens as bits."""
    bit = (mix(tokens) & np.uint64(64 * words - 1)).astype(np.int64)
    out = np.zeros(rows * words, np.uint64)
    np.bitwise_xor.at(out, row * words + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out.reshape(rows, words)


def _prefix(row: np.ndarray, tokens: np.ndarray, n: np.ndarray, rank: np.ndarray, salt: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens in each row's prefix under the order (rank, salted hash), and their positions."""
    with np.errstate(over="ignore"):
        tie = mix(tokens * np.uint64(2 * salt + 1) + np.uint64(salt)) >> np.uint64(20)
    order = np.argsort((row.astype(np.uint64) << np.uint64(52)) | (rank.astype(np.uint64) << np.uint64(44)) | tie)
    position = np.arange(len(order)) - (np.cumsum(n) - n)[row]
    inside = position < (n - (t * n + 999) // 1000 + 1)[row]
    return order[inside], position[inside]


def _words(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    record = F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in texts))
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), record.alias("t"))


def _survey(rows: DataFrame, spec: Spec, bits: int) -> DataFrame:
    """One pass: (sig, id, n, parity, text hash) of every record, and the blocks of the frequency sketch of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sketch.empty(bits)
        mask = np.uint64((1 << bits) - 1)

        def one(part: pa.RecordBatch, b: TextBatch) -> pa.RecordBatch:
            row, tokens, n = token_sets(b, spec)
            sketch.add(table, (tokens & mask).astype(np.int64))
            some = n > 0
            ids = part.column("id").filter(pa.array(some))
            parity = pa.array([x.tobytes() for x in parities(row, tokens, b.size, PARITY)[some]], pa.binary())
            return pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int32()), parity, pa.array(signatures(tokens, n)[some]), ids, pa.array(n[some].astype(np.int32)), part.column("exact").filter(pa.array(some))], names=names)

        yield from map_texts("t", one)(batches)
        for i, data in sketch.blocks(table):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([data], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())], names=names)

    names = ["block", "data", "sig", "id", "n", "exact"]
    return rows.withColumn("exact", F.xxhash64("t")).mapInArrow(run, "block int, data binary, sig long, id long, n int, exact long")


def _postings(rows: DataFrame, spec: Spec, frequencies) -> DataFrame:
    """(token, sig, n, pos, b0, b1) of each class's prefix (its id as sig) under the first order, without tokens that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequencies.value.table
        mask = np.uint64(len(table) - 1)
        seen: set[int] = set()

        def one(part: pa.RecordBatch, b: TextBatch) -> pa.RecordBatch:
            row, tokens, n = token_sets(b, spec)
            sig = signatures(tokens, n)
            new = np.zeros(b.size, bool)
            for i in np.flatnonzero(n):
                if (s := int(sig[i])) not in seen:
                    seen.add(s)
                    new[i] = True
            often = table[(tokens & mask).astype(np.int64)]
            at, pos = _prefix(row, tokens, n, often, 0, spec.per_mille)
            keep = (often[at] > ONCE) & new[row[at]]
            at, pos = at[keep], pos[keep]
            low, high = parities(row, tokens, b.size, 2).view(np.int64).T
            r = row[at]
            ids = np.asarray(part.column("id")).astype(np.int64)
            token = (tokens[at] >> np.uint64(8)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (token, ids[r], n[r].astype(np.int32), pos.astype(np.int32), low[r], high[r])], names=["token", "sig", "n", "pos", "b0", "b1"])

        yield from map_texts("t", one)(batches)

    return rows.mapInArrow(run, "token long, sig long, n int, pos int, b0 long, b1 long")


def _candidates(postings: DataFrame, spec: Spec, parity: bool) -> DataFrame:
    """Pairs of classes (a < b) that share a prefix token at positions which still allow the overlap."""
    need = spec.overlap_sql("x.n", "y.n")
    where = f"x.sig < y.sig AND x.pos <= x.n - {need} AND y.pos <= y.n - {need}"
    if parity:
        where += f" AND bit_count(x.b0 ^ y.b0) + bit_count(x.b1 ^ y.b1) <= x.n + y.n - 2 * {need}"
    x, y = postings.alias("x"), postings.alias("y")
    return x.join(y, F.expr(f"x.token = y.token AND {where}")).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).distinct()


def _thinned(pairs: DataFrame, classes: DataFrame, spec: Spec) -> DataFrame:
    """The pairs whose long parities differ in no more bits than the threshold leaves tokens to differ in."""
    t = spec.per_mille

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, PARITY) for c in ("x", "y"))
                total = np.asarray(batch.column("n")).astype(np.int64)
                keep = pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= total - 2 * ((t * total + 999 + t) // (1000 + t)))
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    c = classes.select("sig", "n", "parity")
    x = pairs.join(c.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("parity").alias("x")), "a")
    both = x.join(c.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("y")), "b")
    return both.select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "x", "y").mapInArrow(run, "a long, b long")


def _records(rows: DataFrame, ids: DataFrame, spec: Spec, frequencies) -> DataFrame:
    """(sig, tokens, prefix, pos) of the named records; ``prefix`` is that under the second order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequencies.value.table
        mask = np.uint64(len(table) - 1)

        def one(part: pa.RecordBatch, b: TextBatch) -> pa.RecordBatch:
            row, tokens, n = token_sets(b, spec)
            often = table[(tokens & mask).astype(np.int64)]
            at, pos = _prefix(row, tokens, n, often // 27, 1, spec.per_mille)  # 27 steps of the codes are a factor of ten
            keep = often[at] > ONCE
            at, pos = at[keep], pos[keep]
            token = (tokens[at] >> np.uint64(20)).astype(np.uint32).view(np.int32)
            offsets = lambda c: pa.array(np.concatenate([[0], np.cumsum(c)]).astype(np.int32))
            o = offsets(np.bincount(row[at], minlength=b.size))
            starts = np.concatenate([[0], np.cumsum(n)]) * 8
            raw = tokens.tobytes()
            sets = pa.array([raw[starts[i] : starts[i + 1]] for i in range(b.size)], pa.binary())
            return pa.RecordBatch.from_arrays(
                [part.column("sig"), pa.array(n.astype(np.int32)), sets, pa.ListArray.from_arrays(o, pa.array(token)), pa.ListArray.from_arrays(o, pa.array(pos.astype(np.int32)))],
                names=["sig", "n", "tokens", "prefix", "pos"],
            )

        yield from map_texts("t", one)(batches)

    named = rows.join(ids, "id").select("sig", "t")
    return named.mapInArrow(run, "sig long, n int, tokens binary, prefix array<int>, pos array<int>").dropDuplicates(["sig"])


def _verify(pairs: DataFrame, records: DataFrame, spec: Spec) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            sim = np.zeros(len(x))
            for i, (p, q) in enumerate(zip(x, y, strict=True)):
                u = np.sort(np.concatenate([np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)]))
                common = int((u[1:] == u[:-1]).sum())
                # the threshold is held exactly, in integers
                if common * 1000 >= spec.per_mille * (len(u) - common):
                    sim[i] = common / (len(u) - common)
            keep = pa.array(sim > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(sim).filter(keep)], names=["a", "b", "similarity"])

    r = records.select("sig", "tokens")
    both = pairs.join(r.select(F.col("sig").alias("a"), F.col("tokens").alias("x")), "a").join(r.select(F.col("sig").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double")


def links(df: DataFrame, key: str, texts: list[str], spec: Spec = Spec(), sketch_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between classes of equal records (a, b, similarity), and the membership (sig, id, exact) of all that take part.

    A class is named by its lowest id; ``exact`` is a hash of the text, which tells equal texts from equal sets.
    ``sketch_bits`` sets the size of the sketch instead of the amount of text.
    """
    rows = _words(df, key, texts)
    tokens = (rows.agg(F.sum(F.length("t")).alias("c")).first().c or 0) // CHARS_PER_TOKEN
    bits = sketch_bits or sketch.bits_for(tokens)
    survey = moved(_survey(rows, spec, bits))
    spark = df.sparkSession
    blocks = sketch.merged(survey.where("block is not null"))
    frequencies = spark.sparkContext.broadcast(sketch.Packed(sketch.gathered(blocks, bits)))
    drop_shuffles(blocks)
    # a class of equal sets goes by its lowest id from here on
    equal = survey.where("sig is not null").groupBy(F.col("sig").alias("same"), "id").agg(F.min("exact").alias("exact"))
    low = equal.groupBy("same").agg(F.min("id").alias("sig"))
    members = moved(equal.join(low, "same").select("sig", "id", "exact"))
    classes = survey.where("sig is not null").groupBy("sig").agg(F.min("id").alias("id"), F.min("data").alias("parity"), F.min("n").alias("n")).select(F.col("id").alias("sig"), "parity", "n")
    classes = moved(classes)
    release(survey)
    copies = members.where("id <> sig").select("id")
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    singles = rows.join(F.broadcast(copies) if few else copies, "id", "left_anti")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(tokens * (1 - spec.threshold)) // POSTINGS)
    found = moved(_candidates(_postings(singles, spec, frequencies).repartition(parts, "token"), spec, parity=True))
    pairs = moved(_thinned(found, classes, spec))
    release(found, classes)
    left = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().select(F.col("sig").alias("id"), "sig")
    records = moved(_records(_only(rows, left), left, spec, frequencies))
    frequencies.destroy(blocking=True)
    second = records.select("sig", "n", F.explode(F.arrays_zip("prefix", "pos")).alias("p")).select(F.col("p.prefix").alias("token"), "sig", "n", F.col("p.pos").alias("pos"))
    both = moved(pairs.join(_candidates(second, spec, parity=False), ["a", "b"]))
    release(pairs)
    return _verify(both, records, spec), members


def _only(rows: DataFrame, ids: DataFrame, bits: int = 22) -> DataFrame:
    """A superset of the rows with these ids, by a filter of 2^bits counters; keeps other texts out of the join that follows."""
    mask = np.uint64((1 << bits) - 1)
    slot = lambda column: (mix(np.asarray(column).astype(np.int64).view(np.uint64)) & mask).astype(np.int64)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sketch.empty(bits)
        for batch in batches:
            table[slot(batch.column("id"))] = 1
        for i, data in sketch.blocks(table):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([data], pa.binary())], names=["block", "data"])

    blocks = sketch.merged(ids.select("id").mapInArrow(build, "block int, data binary"))
    present = ids.sparkSession.sparkContext.broadcast(sketch.Packed(sketch.gathered(blocks, bits)))
    drop_shuffles(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(present.value.table[slot(batch.column("id"))] > 0))

    return rows.mapInArrow(run, "id long, t string")


def expanded(link: DataFrame, members: DataFrame, copies: str = "pairs") -> DataFrame:
    """Pairs of ids (a < b): links between all members of linked classes, and between the members of a class.

    ``copies`` says what is written for exact copies of one text: all pairs among them, or with "star" one pair of each
    copy with the lowest id, through which the rest follows. Pairs of different texts are all written either way.
    """
    text = ["sig", "exact"]
    pair = lambda df: df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    member = lambda sig, id_, *more: members.select(F.col("sig").alias(sig), F.col("id").alias(id_), *more)
    across = pair(link.join(member("a", "x"), "a").join(member("b", "y"), "b"))
    groups = members.groupBy(*text).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("lowest"))
    # texts meet as groups first, so that exact copies are compared with each other nowhere
    g = groups.select("sig", F.col("exact").alias("e")).join(groups.select("sig", F.col("exact").alias("f")), "sig").where("e < f")
    within = pair(g.join(member("sig", "x", F.col("exact").alias("e")), ["sig", "e"]).join(member("sig", "y", F.col("exact").alias("f")), ["sig", "f"]))
    several = members.join(groups.where("copies > 1"), text)
    if copies == "star":
        return across.unionByName(within).unionByName(several.where("id <> lowest").select(F.col("lowest").alias("a"), F.col("id").alias("b")))
    x, y = several.select(*text, F.col("id").alias("a")), several.select(*text, F.col("id").alias("b"))
    return across.unionByName(within).unionByName(x.join(y, text).where("a < b").select("a", "b"))
