import os
import random
import re
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vellum.llm import fusion, neardup, packing, quality, queries, scans, splitting, tokens, truncation, vectors

VOCABULARY = tokens.VOCABULARY
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files here")

PROSE = "The pump in the hall must be cleaned by the welder. After the test the valve is opened and the line is drained slowly."
LIST = "1. pump\n2. valve\n3. rotor shaft\n4. gasket\n5. cage filter"


# --- 1: text statistics and rules ---


def test_rules_tell_lists_from_prose(spark):
    rng = random.Random(1)
    docs = [(i, (PROSE if i % 3 else LIST) + f" {rng.randrange(99)}") for i in range(90)]
    df = spark.createDataFrame([*docs, (200, None), (201, "  \n"), (202, ""), (203, LIST + "\n6. box"), (203, LIST + "\n6. box"), (204, PROSE * 3000)], "chunk_ord long, content string").withColumn("is_prose", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(61, None), (None, 1)], "chunk_ord long, is_prose int")
    rules = quality.fit_rules(df, labels, "chunk_ord", "content")
    assert rules.rules and "CASE WHEN stats IS NULL" in rules.case_sql()
    assert sorted(r.chunk_ord for r in quality.not_prose(df, rules).collect()) == [i for i in range(90) if i % 3 == 0] + [203]
    stats = {r.chunk_ord: r.stats for r in quality.with_text_stats(df).collect()}
    assert stats[200] is None and stats[201] is None and stats[202] is None
    assert stats[203].line_count == 6 and stats[203].entry_line_share == 1.0 and stats[203].sentence_rate == 0


@pytest.mark.parametrize(("n", "negative", "least"), [(4, 1, 0.5), (48, 5, 0.9), (480, 60, 0.97)])
def test_few_labels_still_give_rules(n, negative, least):
    rng = np.random.default_rng(n)

    def draw(size, prose):
        x = rng.random((size, len(quality.FEATURES)))
        at = quality.FEATURES.index("sentence_rate")
        x[:, at] = x[:, at] * 0.03 + (0.05 if prose else 0)
        return x

    x, y = np.concatenate([draw(n - negative, True), draw(negative, False)]), np.arange(n) < n - negative
    rules = quality.induce_rules(x, y)
    assert rules.rules
    right = (rules.predict(draw(500, True)).mean() + (~rules.predict(draw(500, False))).mean()) / 2
    assert right >= least


def test_no_labels_means_no_rules(spark):
    df = spark.createDataFrame([(1, "x")], "chunk_ord long, content string")
    none = spark.createDataFrame([], "chunk_ord long, is_prose int")
    rules = quality.fit_rules(df, none, "chunk_ord", "content")
    assert rules.rules == () and quality.not_prose(df, rules).count() == 0
    assert quality.not_prose(df.limit(0), rules).count() == 0


# --- 2: fusion ---


def brute_fusion(rows, k, alpha):
    hits = sorted({c for c, _, _ in rows})
    total = dict.fromkeys(hits, 0.0)
    for s in fusion.SCORERS:
        score = {c: max((v for x, y, v in rows if x == c and y == s and v is not None and v == v), default=float("-inf")) for c in hits}
        for c in hits:
            rank = sum(v < score[c] for v in score.values()) + (sum(v == score[c] for v in score.values()) + 1) / 2
            weight = alpha if s == "dense" else (1 - alpha) / 2
            total[c] += weight * NormalDist().inv_cdf((rank - 0.5) / len(hits))
    return sorted(hits, key=lambda c: (-round(total[c], 7), c))[:k]


@pytest.mark.parametrize("rows_per_range", [5, 100_000])
def test_fusion_equals_brute_force(spark, rows_per_range):
    rng = random.Random(2)
    data, asked = [], []
    for q in range(4):
        n = 60 if q == 0 else 9
        for c in range(n):
            for s in fusion.SCORERS:
                if rng.random() < 0.8:
                    data.append((q, c, s, rng.choice([None, float("nan"), round(rng.random(), 1), rng.random() * 100])))
        asked.append((q, rng.choice([None, 3, 5]), rng.choice([None, 0.0, 1.0, 0.4])))
    df = spark.createDataFrame(data + data[:20] + [(None, 1, "dense", 1.0), (9, 1, "dense", 1.0)], "query_id long, chunk_ord long, scorer string, score double").withColumn("fused", F.lit("clash"))
    queries = spark.createDataFrame([*asked, asked[0]], "query_id long, top_k int, alpha double")
    got = {}
    for r in fusion.fused_ranking(df, queries, rows_per_range=rows_per_range).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_ord)
    for q, k, alpha in asked:
        assert got[q] == brute_fusion([x[1:] for x in data if x[0] == q], k or 10, 0.7 if alpha is None else alpha)
    assert 9 not in got
    assert fusion.fused_ranking(df.limit(0), queries).count() == 0


def test_probit(spark):
    for p in (1e-9, 0.01, 0.3, 0.5, 0.9, 0.999):
        assert spark.range(1).select(F.expr(fusion.probit_sql(f"{p!r}D")).alias("z")).first().z == pytest.approx(NormalDist().inv_cdf(p), rel=1e-7, abs=1e-8)


def test_inverse_normal_of_the_oracle():
    duckdb = pytest.importorskip("duckdb")
    for p in (1e-9, 0.01, 0.074, 0.3, 0.5, 0.93, 0.999):
        assert duckdb.sql(f"SELECT {queries.inverse_normal_sql('p')} FROM (SELECT {p!r}::DOUBLE AS p)").fetchall()[0][0] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-13, abs=1e-14)


# --- 3: splitting ---


def brute_split(t, limit, overlap):
    w = [m.span() for m in re.finditer(r"[^ \t\r\n]+", t)]
    if len(w) <= limit:
        return []
    out, done = [], 0

    def sentence(i):
        m = re.match(r"^(.*[.!?])[\"'”’»)\]}]{0,3}$", t[w[i - 1][0] : w[i - 1][1]])
        return m and t[w[i][0]].isupper() and re.sub(r"^[(\[{\"'“‘«]+", "", m.group(1)).lower() not in splitting.ABBREVIATIONS

    while True:
        first = max(0, done - overlap) if done else 0
        if first + limit >= len(w):
            return [*out, (w[first][0], w[-1][1])]
        end = first + limit
        for test in (lambda i: t[w[i - 1][1] : w[i][0]].count("\n") >= 2, sentence):
            if found := [i for i in range(done + 1, end + 1) if test(i)]:
                end = found[-1]
                break
        out.append((w[first][0], w[end - 1][1]))
        done = end


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a ", "B ", "c. ", "cf. ", "D!) ", "e\r\n\r\n", "F\n \n", "g.\n", "  h\t", "é ", "“I.” "]), max_size=90).map("".join), st.integers(2, 15), st.integers(0, 6))
def test_splitting_equals_brute_force(t, limit, overlap):
    if overlap < limit:
        assert splitting.split_batch([t, None, t], limit, overlap) == [brute_split(t, limit, overlap), [], brute_split(t, limit, overlap)]


def test_split_cases(spark):
    long = " ".join(f"w{i}" for i in range(9))
    df = spark.createDataFrame([("a", long, 1), ("a", long, 2), ("b", None, 3), ("c", "", 4), (None, long, 5), ("d", "x" * 30, 6)], "parent_id string, content string, start_char int")
    got = sorted((r.parent_id, r.start_char, r.end_char) for r in splitting.split_oversized(df, "parent_id", "content", 4, 1).collect())
    assert got == [("a", 0, 11), ("a", 9, 20), ("a", 18, 26)]
    assert splitting.split_batch(["x" * 30], 2, 0, max_word_chars=10) == [[(0, 20), (20, 30)]]
    assert splitting.split_oversized(df.limit(0), "parent_id", "content").count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "parent_id", "content", 4, 4)


# --- 4: near duplicates ---


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(60)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([29, 32, 60, 150]))]
        for _ in range(rng.randint(1, 4)):
            t = list(base)
            for _ in range(rng.choice([0, 1, 3, 8])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([None, "Head"]), " ".join(t)))
    rows += [(900, None, None), (901, "x", ""), (902, None, "word0 " * 40), (903, None, "WORD0, " * 40)]
    spec = neardup.Spec()

    def tokens_of(h, t):
        w = re.findall(r"[^\W_]+", f"{h or ''}\n{t or ''}".lower())
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 30 else set()

    sets = {i: tokens_of(h, t) for i, h, t in rows}
    wanted = {(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 7 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(rows + rows[:7], "chunk_ord long, section_heading string, content string").withColumn("sig", F.lit("clash"))
    link, members = neardup.links(df, "chunk_ord", ["section_heading", "content"], spec)
    assert {(r.a, r.b) for r in neardup.expanded(link, members).collect()} == wanted
    star = {(r.a, r.b) for r in neardup.expanded(link, members, "star").collect()}
    assert star <= wanted and (902, 903) in star
    # a sketch in which all tokens share a few counters changes the order, never the pairs
    link, members = neardup.links(df, "chunk_ord", ["section_heading", "content"], spec, sketch_bits=16)
    assert {(r.a, r.b) for r in neardup.expanded(link, members).collect()} == wanted
    link, members = neardup.links(df.limit(0), "chunk_ord", ["section_heading", "content"], spec)
    assert neardup.expanded(link, members).count() == 0


def test_near_duplicates_keep_no_files_of_finished_steps(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(300)]
    df = spark.createDataFrame([(i, None, f"{t} tail{i}") for i, t in enumerate(texts * 2)], "chunk_ord long, section_heading string, content string")

    def shuffled():
        files, sizes = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator(), {}
        while files.hasNext():
            f = files.next()
            if f.getName().startswith("shuffle_"):
                sizes[f.getName()] = f.length()
        return sizes

    before, left, tables, octets = shuffled(), [], [], []
    thinned, broadcast = neardup._thinned, spark.sparkContext.broadcast

    def at_thinned(*args):
        left.append(sum(n for name, n in shuffled().items() if name not in before))
        return thinned(*args)

    def at_broadcast(value):
        tables.append(broadcast(value))
        octets.append(os.path.getsize(tables[-1]._path))
        return tables[-1]

    monkeypatch.setattr(neardup, "_thinned", at_thinned)
    monkeypatch.setattr(spark.sparkContext, "broadcast", at_broadcast)
    link, members = neardup.links(df, "chunk_ord", ["section_heading", "content"])
    assert left[0] < 20_000  # 312,859 bytes while they waited for the garbage collector
    assert octets[0] < 2**17 and not os.path.exists(tables[0]._path)  # the sketch has 2^18 counters
    assert {(r.a, r.b) for r in neardup.expanded(link, members).collect()} == {(i, i + 300) for i in range(300)}


@pytest.mark.parametrize("copies", ["pairs", "star"])
def test_only_exact_copies_are_folded(spark, copies):
    # class 1: texts x (ids 1, 2, 3) and y (4, 5) of equal sets; class 10: two copies of another text
    members = spark.createDataFrame([(1, 1, 7), (1, 2, 7), (1, 3, 7), (1, 4, 8), (1, 5, 8), (10, 10, 9), (10, 11, 9)], "sig long, id long, exact long")
    link = spark.createDataFrame([(1, 10, 0.8)], "a long, b long, similarity double")
    got = sorted((r.a, r.b) for r in neardup.expanded(link, members, copies).collect())
    across = [(x, y) for x in range(1, 6) for y in (10, 11)]
    within = [(x, y) for x in (1, 2, 3) for y in (4, 5)]
    among = [(1, 2), (1, 3), (4, 5), (10, 11)] + ([(2, 3)] if copies == "pairs" else [])
    assert got == sorted(across + within + among)


# --- 5: vectors ---


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 64))
    x = np.concatenate([c + 0.2 * rng.standard_normal((8, 64)) for c in centres] + [rng.standard_normal((3, 64))])
    rows = [(i, [float(v) for v in np.float32(r * rng.uniform(0.5, 2))]) for i, r in enumerate(x)]
    rows += [(1000 + i, rows[0][1]) for i in range(9)]  # equal vectors
    bad = [(2000, None), (2001, [0.0] * 64), (2002, [1.0] * 3), (2003, [float("nan")] * 64)]
    df = spark.createDataFrame(rows + bad + rows[:5], "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = {}
    for r in vectors.nearest(df).collect():
        got.setdefault(r.id, []).append((r.rank, r.other))
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = [i for i, _ in rows]
    right = 0
    for a in range(len(rows)):
        s = np.round(v @ v[a], 6)
        best = sorted((b for b in range(len(rows)) if b != a), key=lambda b: (-s[b], ids[b]))[:5]
        mine = [o for _, o in sorted(got[ids[a]])]
        assert len(mine) == 5
        right += len({ids[b] for b in best} & set(mine))
    assert right >= 0.97 * 5 * len(rows) and not set(got) & {2000, 2001, 2002, 2003}
    assert [o for _, o in sorted(got[1008])] == [0, 1000, 1001, 1002, 1003]
    assert vectors.nearest(df.where("vec_id >= 2000")).count() == 0
    assert vectors.neighbour_pairs(vectors.nearest(df.where("vec_id in (1, 2)"))).count() == 1


@pytest.mark.parametrize(("radii", "width"), [((1,), 20), ((1, 2), 16)])
def test_open_queries_are_searched_exactly(spark, radii, width):
    rng = np.random.default_rng(6)
    x = np.float32(rng.standard_normal((150, 64)))  # no near ones: hardly a query is settled by its codes
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.id, r.other) for r in vectors.nearest(df, radii=radii, width=width).collect()}
    s = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(s, -9)
    best = {(a, int(b)) for a in range(len(x)) for b in np.argsort(-s[a])[:5]}
    assert got >= best


def test_probing_finds_each_pair_once(spark):
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 1 << 8, (300, 4))
    lanes = lambda i, j: [int(a) | int(b) << 32 for a, b in zip(codes[:, i], codes[:, j], strict=True)]
    df = spark.createDataFrame([(i, a, b, 0, 1) for i, (a, b) in enumerate(zip(lanes(0, 1), lanes(2, 3), strict=True))], "id long, lo long, hi long, c1 int, c2 int")
    far = np.bitwise_count(codes[:, None] ^ codes[None])
    for radius, symmetric in ((1, True), (2, False)):
        rows = vectors._probe(df, df, 8, radius, 11, symmetric).collect()
        got = {(r.a, r.b): r.h for r in rows}
        assert len(rows) == len(got) * (1 if symmetric else 2)
        assert got == {(i, j): far[i, j].sum() for i in range(300) for j in range(i + 1, 300) if (far[i, j] <= radius).any() and far[i, j].sum() <= 11}


# --- 6: scans ---


def test_repairs(spark):
    words = ["governor", "temperature", "maintenance", "gas-tight", "bolted", "sealed"]
    native = [(100 + i, "d", " ".join(words) + ". The pump is sealed by the welder and it is safe.", "native") for i in range(400)]
    page = "Pump Manual - Issue A\nThe governor is bolted and sea1ed by the main-\ntenance welder. It is gas-\ntight and at ternperature.\n  l2\n2.1 Sealed governor\nIt is sealed by the welder in the end."
    # lines are furniture if a twentieth of the document's scanned chunks has them
    other = [(600 + i, "d", f"Pump Manual - Issue A\nThe welder {chr(97 + i % 26) * (3 + i // 26)} is safe.", "ocr") for i in range(120)]
    scan = [(i, "d", page, "OCR ") for i in range(2)] + [(9, "d", None, "ocr"), (10, None, "  ", "ocr"), (11, "d", page, None)]
    df = spark.createDataFrame(native + other + scan + scan[:2], "chunk_ord long, doc_id string, content string, source string").withColumn("line_no", F.lit("clash"))
    got = {(r.chunk_ord, r.line_no, r.fix) for r in scans.repairs(df, quality.RuleList(())).collect()}
    assert {x for x in got if x[0] >= 600} == {(i, 1, "") for i, *_ in other}
    wanted = {(1, ""), (2, "sealed"), (2, "maintenance"), (3, "gas-tight"), (4, "temperature"), (5, "")}
    assert {x for x in got if x[0] < 600} == {(i, *w) for i in range(2) for w in wanted}
    assert scans.repairs(df.limit(0), quality.RuleList(())).count() == 0


@pytest.mark.parametrize(("line", "wanted"), [("12", True), ("  - 12 -", True), ("[30]", True), ("Page 67 of 337", True), ("xii", True), ("4-27", True), ("l39", True), ("12 bolts", False), ("mix", False), ("Pump", False)])
def test_page_numbers(line, wanted):
    assert scans.is_page_number(line) is wanted


# --- 7: tokens ---


@needs_vocabulary
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_encoding_equals_the_library(texts):
    tiktoken = pytest.importorskip("tiktoken")
    with open(VOCABULARY, "rb") as f:
        bpe = tokens.Bpe.parse(f.read()) if not hasattr(test_encoding_equals_the_library, "bpe") else test_encoding_equals_the_library.bpe
    test_encoding_equals_the_library.bpe = bpe
    if not hasattr(bpe, "other"):
        bpe.other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["7888 <|endoftext|> aaaaaaaa 111111", None, ""]
    assert bpe.encode_batch(texts) == [bpe.other.encode_ordinary(t or "") for t in texts]


@needs_vocabulary
def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "x" * 200_000)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = [(r.doc_id, len(r.ids)) for r in tokens.encoded(df, "doc_id", "text").collect()]
    assert got[:4] == [(1, 0), (2, 0), (3, 2), (3, 2)] and got[4][1] > 0
    assert tokens.encoded(df.limit(0), "doc_id", "text").count() == 0


# --- 8: packing ---


@needs_vocabulary
def test_packing(spark):
    rng = random.Random(8)
    rows = [(i, " word" * rng.randint(1, 60)) for i in range(400)] + [(900, " word" * 205), (901, None), (902, ""), (3, " word" * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("container", F.lit("clash"))
    got = packing.packed(df, capacity=100).toPandas()
    filled = got.groupby("container").n_tokens.sum()
    assert filled.max() <= 100 and filled.sum() / (100 * len(filled)) > 0.98
    assert set(got.doc_id) == {*range(400), 900}
    big = got[got.doc_id == 900].sort_values("piece")
    assert list(big.n_tokens) == [100, 100, 5] and list(big.start) == [0, 100, 200]
    assert (got[got.doc_id != 900].groupby("doc_id").size() == 1).all()
    assert packing.packed(df.limit(0)).count() == 0


def test_hilbert_curve_is_one_path():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert(points, 3)
    assert sorted(keys) == list(range(512))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# --- 9: truncation ---


def test_truncation(spark):
    rng = random.Random(9)
    verbs = ["opened", "cleaned", "replaced"]
    sentence = lambda: f"The {rng.choice(['valve', 'governor', 'separator'])} in hall {rng.randrange(9)} must be {rng.choice(verbs)} by the welder."
    rows = [(i, "a", " ".join(sentence() for _ in range(4))) for i in range(60)]
    rows += [(100 + i, "b", (" ".join(sentence() for _ in range(9)))[:150]) for i in range(8)]
    rows += [(200, "a", "- valve\n- separator\n- governor"), (201, "a", "- valve\n- separator\n- gover"), (202, "a", "12:01 valve AB-1 opened\n12:05 governor AB-2 cleaned"), (203, "a", "12:01 valve AB-1 opened\n12:05 gov")]
    rows += [(204, "a", "The valve is opened by the wel…"), (205, None, None), (206, None, ""), (207, "a", rows[0][2] + "\nChecked by shift D"), (208, "a", rows[0][2][:60])]
    rows += [(300 + i, "a", f"{sentence()}\nChecked by shift {c}") for i, c in enumerate("ABCDE")]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, source string, text string").withColumn("truncated", F.lit("clash"))
    got = {r.doc_id for r in truncation.truncated_ids(df).collect()}
    cut = {i for i, _, t in rows if 100 <= i < 108 and not t.rstrip().endswith(".")}
    assert got == cut | {201, 203, 204, 208}
    rates = {r.source: (r.n_docs, r.n_truncated) for r in truncation.source_rates(df).collect()}
    assert rates["b"] == (8, len(cut)) and rates[None] == (2, 0)
    assert truncation.truncated_ids(df.limit(0)).count() == 0


def test_stumps_of_last_lines_are_no_sign_offs(spark):
    body = "The valve in the hall must be opened by the welder before the governor is cleaned"
    rows = [(i, "a", f"{body} {i} times.\nThe") for i in range(40, 60)]  # stumps alone: they come last as often as a sign-off
    rows += [(100 + i, "a", f"{body} {i} times.\nSigned: the auditor on duty") for i in range(40)]
    long = f"{body} and before the separator is replaced by the auditor on duty."
    rows += [(200 + i, "b", f"{body} {i} and the {'x' * 40} and the {'y' * 60} and the"[:160] + " and the") for i in range(6)]
    for i, last in ((300, "Signed: the auditor on"), (301, "Signed: the auditor on duty")):
        rows.append((i, "b", f"{long[: 168 - len(last) - 3].rstrip('.')}.".ljust(168 - len(last) - 1) + f"\n{last}"))
    assert {len(t) for _, s, t in rows if s == "b"} == {168}
    got = {r.doc_id for r in truncation.truncated_ids(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got >= set(range(40, 60)) and 300 in got
    assert not got & {301, *range(100, 140)}


def test_strict_prefixes(spark):
    base = "x" * 50
    rows = [(1, base), (2, base + "y"), (3, base + "y" * 30), (4, "z" * 60), (5, base), (6, "short"), (7, "z" * 45 + "…")]
    got = truncation.strict_prefixes(spark.createDataFrame(rows, "doc long, t string")).join(spark.createDataFrame(rows, "doc long, t string").select("doc", F.xxhash64("t").alias("h1")), "h1")
    assert {r.doc for r in got.collect()} == {1, 2, 5, 7}
