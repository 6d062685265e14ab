"""Operators with exact results against brute force, edge cases included."""

import base64
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("lumentext.llm")
from lumentext.llm import frequencies, leakage, neardup, neighbours, rankagg, spans, tokens  # noqa: E402


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# 3: frequencies


def test_frequencies(spark):
    data = [("f", "a", "s1", 2), ("f", "a", "s1", 3), ("f", "a", "s2", None), ("f", "b", None, 4), ("f", None, "s1", 9), ("f", "  ", "s1", 9), ("f", "", "s1", 1), ("g", "a", "s1", 1)]
    df = spark.createDataFrame(data, "field string, val string, scope string, w int")
    assert rows(frequencies.value_frequencies(df), "field", "val", "total", "scopes") == [("f", "a", 5, 2), ("f", "b", 4, 0), ("g", "a", 1, 1)]
    assert frequencies.value_frequencies(df.limit(0)).count() == 0


def test_frequencies_hot_value_over_many_ranges(spark):
    df = spark.range(20000).select(F.lit("f").alias("field"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 97)).alias("val"), F.col("id").cast("string").alias("scope"), F.lit(1).alias("w"))
    got = {r.val: (r.total, r.scopes) for r in frequencies.value_frequencies(df).collect()}
    assert got["hot"] == (6667, 6667) and sum(t for t, _ in got.values()) == 20000 and len(got) == 98


def test_marks(spark):
    f = spark.createDataFrame([("f", "c", 9, 3), ("f", "r", 2, 1), ("f", "n", 3, 1), ("f", "m", 1, 2)], "field string, val string, total long, scopes long")
    n = spark.createDataFrame([("f", 10)], "field string, n long")
    assert rows(frequencies.mark_frequencies(f, n, {"f": (0.25, 2)}), "val", "mark") == [("c", "common"), ("r", "rare")]


# 5: rank aggregation


def brute_rho(scores):
    from math import comb

    n, m = scores.shape
    s = np.where(np.isnan(scores), np.nan, scores)
    low = [np.nanmin(c) if not np.all(np.isnan(c)) else 0 for c in s.T]
    s = np.where(np.isnan(s), low, s)
    r = np.array([[(np.sum(s[:, j] > v) + (np.sum(s[:, j] == v) + 1) / 2) / n for j, v in enumerate(row)] for row in s])
    out = []
    for row in np.sort(r, axis=1):
        ps = [sum(comb(m, j) * x**j * (1 - x) ** (m - j) for j in range(k, m + 1)) for k, x in enumerate(row, 1)]
        out.append(min(1, min(ps) * m))
    return out


def test_robust_ranks(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.normal(size=(30, 4)), 1) * [1, 100, 1e6, 0.01]
    s[rng.random((30, 4)) < 0.1] = np.nan
    data = [("q", f"i{i:02d}", *(None if np.isnan(v) else float(v) for v in row), 5) for i, row in enumerate(s)]
    data += [("q", "i00", 9e9, 9e9, 9e9, 9e9, 1), data[3], ("q", None, 1.0, 1.0, 1.0, 1.0, 1), (None, "x", 1.0, 1.0, 1.0, 1.0, 1), ("one", "x", None, float("nan"), None, None, None)]
    df = spark.createDataFrame(data, "g string, i string, a double, b double, c double, d double, t int")
    got = {(r.g, r.i): r.rho for r in rankagg.robust_ranks(df, "g", "i", list("abcd"), "t").collect()}
    assert len(got) == 31
    for i, want in enumerate(brute_rho(s)):
        assert got["q", f"i{i:02d}"] == pytest.approx(want, abs=1e-9)
    assert rankagg.robust_ranks(df.limit(0), "g", "i", list("abcd"), "t").count() == 0


# 8: tokens


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.load_ranks(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("ab ' ", max_size=200))
def test_encoding_is_that_of_the_library(encoder, reference, text):
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text)
    by_id = {i: b for b, i in encoder.transducer.ranks.items()}
    assert "".join(tokens.decode_stream(ids, by_id)) == text


def test_long_pieces_stream(encoder, reference):
    for text in ("a" * 5000, "abc" * 3000, "日本語" * 900, "=-" * 2000, " " * 3000 + "x", "<|endoftext|>" * 20, "xyzzy" * 1000):
        assert encoder.encode(text) == reference.encode_ordinary(text)
    t = encoder.transducer
    got = t.stream(iter([b"na" * 700, b"", b"nan"]))
    assert list(got) == [t.ranks[p] for p in t.merged(b"na" * 700 + b"nan")]


def test_encode_corpus(spark, reference):
    df = spark.createDataFrame([(1, "Hello <s> world", "x"), (2, None, "y"), (3, "", None), (4, "é​\x00", "z")], "doc_id long, text string, ids string")
    got = dict(rows(tokens.encode_corpus(df, "doc_id", "text", f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"), "doc_id", "ids"))
    assert got == {1: reference.encode_ordinary("Hello <s> world"), 2: [], 3: [], 4: reference.encode_ordinary("é​\x00")}


# 9: leakage


def test_leaks(spark):
    w = [f"w{i}" for i in range(60)]
    item = " ".join(w[:40])
    docs = [(1, "x " + " ".join(w[5:18]).upper() + " y"), (2, " ".join(w[5:17])), (3, None), (4, ""), (5, item), (6, "; ".join(w[20:45])), (5, item), (7, " ".join(w[45:60]))]
    items = [(10, item), (11, "too short to leak"), (12, None), (10, item), (13, " ".join(w[30:50]))]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, h int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = leakage.leaks(d, i)
    grams = lambda t: {tuple(re.findall(r"[^\W_]+", t.lower())[k : k + 13]) for k in range(len(re.findall(r"[^\W_]+", t.lower())) - 12)} if t else set()
    want = sorted({(a, b) for a, s in docs for b, t in items if grams(s) & grams(t)}, key=repr)
    assert rows(got, "doc_id", "item_id") == want and (1, 10) in want and (6, 13) in want
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


# 10: spans


def brute_spans(docs, size):
    where = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - size + 1):
            where[t[i : i + size]].add(d)
    out = set()
    for d, t in docs:
        on = np.zeros(len(t or "") + 1, bool)
        for i in range(len(t or "") - size + 1):
            if len(where[t[i : i + size]]) > 1:
                on[i : i + size] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(int)])))
        out |= {(d, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])}
    return sorted(out, key=repr)


def test_shared_spans(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rand = lambda n: "".join(rng.choice(list("abcde éß😀"), n))
    a, b = rand(80), rand(33)
    docs = [(1, rand(50) + a + rand(20)), (2, a[5:60] + rand(9) + b), (3, b + rand(40)), (4, rand(100)), (5, None), (6, ""), (7, a + b), (8, a + b), (9, "z" * 90), (10, "short"), (11, b[:29] + rand(5) + b[4:]), (12, "z" * 45)]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, pos int")
    want = brute_spans(docs, 30)
    assert rows(spans.shared_spans(df, 30, 10), "doc_id", "start_pos", "end_pos") == want
    assert rows(spans.shared_spans(df, 30, 3), "doc_id", "start_pos", "end_pos") == want  # many ranges of anchors
    assert rows(spans.shared_spans(df, 30, 3, held=0), "doc_id", "start_pos", "end_pos") == want  # sketches too large to be held
    monkeypatch.setattr(spans.shared_windows, "__defaults__", (2, 3))
    assert rows(spans.shared_spans(df, 30, 10), "doc_id", "start_pos", "end_pos") == want  # hot anchors
    assert spans.shared_spans(df.limit(0), 30, 10).count() == 0


def test_full_sketches_lose_nothing(spark):
    rng = np.random.default_rng(8)
    a = "".join(rng.choice(list("abcd"), 60))
    df = spark.createDataFrame([(i, "".join(rng.choice(list("abcd"), 40)) + a[i : i + 40]) for i in range(12)], "doc_id long, text string")
    want = brute_spans([(r.doc_id, r.text) for r in df.collect()], 30)
    reps = df.withColumnRenamed("doc_id", "rep")
    got = spans.shared_windows(spans.repeated_runs(reps, 30, 3, 1, 1 << 20), 30)
    cover = {r: set() for r, _, _ in want}
    for r in got.collect():
        cover[r.rep] |= set(range(r.lo, r.hi))
    assert {r: len(c) for r, c in cover.items()} == {d: sum(e - s for x, s, e in want if x == d) for d, _, _ in want}


def test_pieces_of_long_texts_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(spans, "HELD", 50)
    texts = ["".join(map(chr, range(100, 400))), "ab", "x" * 120]
    got = []
    for chars, n, row, off in spans._pieces(texts, 30):
        at, owner = spans.starts_inside(n, 30)
        got += [(int(row[owner[p]]), int(p - (np.cumsum(n) - n)[owner[p]] + off[owner[p]])) for p in at]
    assert sorted(got) == [(0, i) for i in range(271)] + [(2, i) for i in range(91)]


# 4: near duplicates


def test_near_duplicates(spark):
    rng = np.random.default_rng(1)
    base = [list(rng.choice(5000, 120)) for _ in range(12)]
    docs = []
    for i, b in enumerate(base):
        for k in range(4):
            e = list(b)
            for _ in range(k * 3):
                e[rng.integers(len(e))] = int(rng.integers(5000))
            docs.append((i * 10 + k, " ".join(f"w{x}" for x in e)))
    docs += [(500, docs[0][1].upper() + " "), (501, None), (502, ""), (503, "two words"), (504, "two words"), docs[0]]
    df = spark.createDataFrame([(*r, 0.5) for r in docs], "id long, text string, level double")
    pairs, member = neardup.near_duplicates(df, neardup.word_units, 3, 0.6, 64, 3)
    got = rows(neardup.expanded(pairs, member), "id_a", "id_b")
    s = {i: {tuple(t.lower().split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in docs if t}
    want = sorted(((a, b) for a in s for b in s if a < b and s[a] and s[b] and len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])), key=repr)
    assert got == want and (0, 500) in want and len(want) > 20
    none = neardup.near_duplicates(df.limit(0))
    assert neardup.expanded(*none).count() == 0


def test_probminhash_estimates_weighted_similarity():
    e = np.arange(1, 7, dtype=np.uint64)
    w1, w2 = np.array([5.0, 1, 1, 1]), np.array([5.0, 1, 3, 1])
    sig = neardup.probminhash(np.repeat([0, 1], 4), np.concatenate([e[:4], e[[0, 1, 4, 5]]]), np.concatenate([w1, w2]), 2, 4096)
    p, q = {1: 5 / 8, 2: 1 / 8, 3: 1 / 8, 4: 1 / 8}, {1: 0.5, 2: 0.1, 5: 0.3, 6: 0.1}
    keys = set(p) | set(q)
    want = sum(1 / sum(max(p.get(y, 0) / p[x], q.get(y, 0) / q[x]) for y in keys) for x in set(p) & set(q))
    assert np.mean(sig[0] == sig[1]) == pytest.approx(want, abs=0.04)


# 6: neighbours


def test_nearest_pairs_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 8)).round(3)
    x[7], x[8], x[9] = x[6], x[6] * 2, x[6]
    data = [(f"c{i:02d}", [float(v) for v in r]) for i, r in enumerate(x)]
    data += [("null", None), ("zero", [0.0] * 8), ("long", [1.0] * 9), (None, [1.0] * 8), ("part", [1.0] * 7 + [None]), ("nan", [float("nan")] * 8), data[3]]
    df = spark.createDataFrame([(*r, "q") for r in data], "chunk_id string, v array<double>, cls string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    want = {tuple(sorted((f"c{i:02d}", f"c{j:02d}"))) for i in range(40) for j in np.argsort(-s[i], kind="stable")[:5]}
    got = set(rows(neighbours.nearest_pairs(df, "chunk_id", "v", 8), "a", "b"))
    assert got == want
    assert neighbours.nearest_pairs(df.limit(0), "chunk_id", "v", 8).count() == 0
    assert neighbours.nearest_pairs(df.filter("chunk_id = 'c01'"), "chunk_id", "v", 8).count() == 0


def test_neighbour_recall_and_many_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 16))[rng.integers(60, size=1500)] + rng.normal(size=(1500, 16)) * 0.5
    x[:500] = x[0]  # a third of all rows is one vector
    ids = [f"c{i:04d}" for i in range(1500)]
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "id string, v array<double>")
    got = set(rows(neighbours.nearest_pairs(df, "id", "v", 16, leaf=200), "a", "b"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(1500) for j in np.argsort(-s[i], kind="stable")[:5]}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_neighbours_beyond_the_deepest_fitted_level(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "DEPTH", 1, raising=False)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 16))[rng.integers(150, size=3000)] + rng.normal(size=(3000, 16)) * 0.3
    ids = [f"c{i:04d}" for i in range(3000)]
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "id string, v array<double>")
    got = set(rows(neighbours.nearest_pairs(df, "id", "v", 16, leaf=200), "a", "b"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(3000) for j in np.argsort(-s[i], kind="stable")[:5]}
    assert len(got & want) >= 0.9 * len(want)
    parts = neighbours.divided(u, 100, 1)
    assert sorted(np.concatenate(parts)) == list(range(3000)) and max(map(len, parts)) <= 100


def test_graph_search_reaches_every_component(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 16))[np.arange(3000) % 150] * 3 + rng.normal(size=(3000, 16)) * 0.2  # 150 groups of 20
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    q = np.round(u * neighbours.SCALE).astype(np.int16)
    vectors = neighbours.materialize(spark.createDataFrame([(2 * i, bytearray(q[i].tobytes())) for i in range(3000)], "cls long, q binary"), "vectors")
    asked = spark.createDataFrame([(f"q{i}", bytearray(q[i].tobytes())) for i in range(0, 3000, 10)], "qid string, q binary")
    found = neighbours.graph_search(neighbours.neighbour_graph(vectors, leaf=200), vectors, asked, 6, leaf=200)
    got = {(r.qid, r.cls // 2) for r in found.collect()}
    want = {(f"q{i}", j) for i in range(0, 3000, 10) for j in np.argsort(-(u[i] @ u.T), kind="stable")[:6]}
    assert len(got & want) >= 0.9 * len(want)
    assert neighbours.graph_search(neighbours.neighbour_graph(vectors, leaf=200), vectors, asked.limit(0), 6).count() == 0


def test_counters_do_not_overflow():
    for n in (1, 2, 255, 256, 512):
        assert list(spans.capped(np.zeros(n, np.int64), 2)) == [min(2, n), 0]
        assert list(spans.add_capped(np.array([2, 0, 1], np.uint8), np.array([2, 1, 1], np.uint8))) == [2, 1, 2]
