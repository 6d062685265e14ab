"""Operators against worked examples and plain Python."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumentext.functions import text as T
from lumentext.operators import audit, embed, evaluate, graph, layout, ner, pages, qa, retrieve, stats
from lumentext.operators.components import connected_components

SKY = [(1, "the sky is blue"), (2, "the sun is bright"), (3, "the sun in the sky")]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_tfidf_rank(spark):
    docs = spark.createDataFrame(SKY, "doc_id int, text string")
    q = spark.createDataFrame([(1, "the bright sun"), (2, "blue sky"), (4, "green mountain"), (5, None)], "q int, query string")
    got = {(r.q, r.doc_id): r.score for r in retrieve.tfidf_rank(docs, "doc_id", "text", q, "q", "query").collect()}
    assert {k[0] for k in got} == {1, 2}
    i = {"sky": math.log10(3 / 2), "blue": math.log10(3), "sun": math.log10(3 / 2), "bright": math.log10(3)}
    d1, d3 = [i["sky"] / 2, i["blue"] / 2], [i["sun"] / 2, i["sky"] / 2]
    want = (i["sky"] / 2 * d3[1]) / (math.hypot(*d1) * math.hypot(*d3))
    assert got[2, 1] == pytest.approx(1) and got[2, 3] == pytest.approx(want)


def test_bm25(spark):
    docs = spark.createDataFrame([*SKY, (4, None), (5, "")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "sky sky blue")], "q int, query string")
    got = {r.doc_id: r.score for r in retrieve.bm25_scores(retrieve.bm25_terms(docs, "doc_id", "text"), "doc_id", q, "q", "query").collect()}
    toks = {i: t.split() for i, t in SKY} | {4: [], 5: []}
    n, avg = 5, sum(map(len, toks.values())) / 5
    df = Counter(w for t in toks.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    for i in (1, 3):
        want = sum(idf[w] * toks[i].count(w) * 2.5 / (toks[i].count(w) + 1.5 * (0.25 + 0.75 * len(toks[i]) / avg)) for w in ["sky", "sky", "blue"])
        assert got[i] == pytest.approx(want)
    assert set(got) == {1, 3}


def test_dense_and_hybrid(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0, 0.0])], "id int, v array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (8, None)], "q int, qv array<double>")
    s = retrieve.dense_scores(v, "id", "v", q, "q", "qv")
    assert rows(s, "q", "id", "score") == [(9, 1, pytest.approx(1)), (9, 2, pytest.approx(0.6))]
    assert retrieve.dense_scores(v, "id", "v", q.filter("q = 8"), "q", "qv").count() == 0
    two = retrieve.dense_scores(v, "id", "v", spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "q int, qv array<double>"), "q", "qv", block=2)
    assert two.count() == 10
    b = spark.createDataFrame([(9, 2, 3.0)], "q int, id int, score double")
    for alpha, best in ((0.0, 2), (1.0, 1)):
        h = retrieve.hybrid_scores(b, s, "q", "id", alpha)
        assert max((r.score, r.id) for r in h.collect()) == (1.0, best)
    flat = retrieve.hybrid_scores(b.filter("q = 0"), s.filter("id = 1"), "q", "id").first()
    assert flat.score == 0


def test_type_filter_does_not_change_scores(spark):
    s = spark.createDataFrame([(1, i, float(i), "a" if i % 2 else "b") for i in range(6)], "q int, id int, score double, type string")
    none = spark.createDataFrame([], "q int, id int, score double")
    scaled = retrieve.hybrid_scores(none, s, "q", "id", 1.0).withColumnRenamed("score", "m").join(s.select("id", "type"), "id")
    assert rows(scaled.filter("type = 'a'"), "id", "m") == [(1, 0.2), (3, 0.6), (5, 1.0)]


def test_unique_docs_and_confidence(spark):
    h = spark.createDataFrame([(1, "a", 3, 0.9), (1, "a", 2, 0.8), (1, "b", 1, 0.88), (2, "c", 4, 0.2), (3, "d", 5, 0.7)], "q int, doc string, id int, score double")
    u = retrieve.best_per_doc(h, "q", "doc", F.col("score"), F.col("id"))
    assert rows(u, "q", "rank", "doc") == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d")]
    assert rows(retrieve.confidence(u, "q"), "q", "flag") == [(1, "ambiguous"), (2, "low"), (3, "ok")]


def test_language_model(spark):
    data = [("s", 1, "a b c"), ("s", 2, "a b"), ("s", 3, "a"), ("s", 4, None), ("t", 5, "a b c")]
    df = spark.createDataFrame(data, "src string, id int, t string")
    got = {r.id: r.score for r in stats.sentence_lm(df, "id", T.tokens_a(F.col("t")), "src").collect()}
    v = 2  # first words: a, b
    ab, bc = math.log(3 / (2 + v)), math.log(2 / (1 + v))
    assert got[2] == pytest.approx(ab)
    assert got[1] == pytest.approx(0.6 * (ab + bc) / 2 + 0.4 * math.log(2 / (1 + v)))
    assert set(got) == {1, 2, 5}


def test_greedy_diverse(spark):
    data = [("s", 1, "red green blue", 3.0), ("s", 2, "red green blue black", 2.5), ("s", 3, "one two three", 2.0), ("s", 4, "four", 1.0), ("t", 9, "x", None)]
    df = spark.createDataFrame(data, "src string, id int, text string, score double")
    assert rows(stats.greedy_diverse(df.filter("src = 's'"), "src", "id", "text", "score"), "place", "id") == [(1, 1), (2, 3), (3, 4)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=6), min_size=1, max_size=5))
def test_ngram_counts_add_up(spark, sents):
    df = spark.createDataFrame([(" ".join(s),) for s in sents], "t string")
    got = stats.ngram_counts(df, T.words(F.col("t")), 2).agg(F.sum("freq")).first()[0] or 0
    assert got == sum(max(0, len(s) - 1) for s in sents)


def test_graph(spark):
    s = spark.createDataFrame([(1, "Ana Lima saw Rui."), (2, "Rui, Ana and Zé"), (3, ""), (4, None)], "sid int, text string")
    gaz = spark.createDataFrame([("Ana Lima", "Ana Lima"), ("Ana", "Ana"), ("Rui", "Rui"), ("Zé", "Zé")], "phrase string, name string")
    m = graph.mentions(s, ["sid"], "text", gaz)
    assert rows(m, "sid", "name") == [(1, "Ana Lima"), (1, "Rui"), (2, "Ana"), (2, "Rui"), (2, "Zé")]
    al = spark.createDataFrame([("Ana", "Ana Lima")], "name string, alias_of string")
    c = graph.canonical(m, al, spark.createDataFrame([("Zé",)], "name string"))
    n, e = graph.cooccurrence(c, ["sid"])
    assert rows(n, "name", "freq") == [("Ana Lima", 2), ("Rui", 2)]
    assert rows(e, "source", "target", "weight") == [("Ana Lima", "Rui", 2)]
    assert graph.subgraph(e, n.filter("name = 'Rui'")).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7), (200, 200), (None, 3), (101, 100)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a int, b int")), "node", "label"))
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_iob(spark):
    tags = ["B-A", "I-A", "O", "I-B", "B-B", "I-A"]
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate(tags)], "sent_id int, pos int, tag string")
    g = ner.iob_spans(t)
    assert rows(g, "start", "end", "label") == [(0, 2, "A"), (3, 4, "B"), (4, 5, "B"), (5, 6, "A")]
    m = {r.label: r for r in ner.span_metrics(g, g.filter("start > 0")).collect()}
    assert m[None].precision == 1 and m[None].recall == 0.75 and m["A"].f1 == pytest.approx(2 / 3)


def test_entities(spark):
    e = [("s", "PERSON", "Mars", 9), ("s", "ORG", "acme", 2), ("s", "ORG", "Acme", 5), ("s", "CARDINAL", "one", 3), ("s", "ORG", "Agency", 3), ("s", "ORG", None, 3), ("s", "ORG", "b", None)]
    got = ner.filtered_entities(spark.createDataFrame(e, "source_id string, label string, text string, count int"))
    assert rows(got, "label", "text", "count", "place") == [("LOC", "Mars", 9, 1), ("ORG", "Acme", 5, 1)]


def test_audit_and_repair(spark):
    d = spark.createDataFrame([(1, "Tea", "All about tea"), (2, "X", None), (3, None, "all"), (4, "z", "all"), (5, "Tea", "x" * 30 + "tea")], "id int, title string, text string")
    a = audit.audit(d, "id", "title", "text", 20)
    assert rows(a, "id", "warnings") == [(1, "short_text"), (2, "short_text, title_not_in_text"), (3, "short_text, duplicate_text, title_not_in_text"), (4, "short_text, duplicate_text, title_not_in_text"), (5, "")]
    new = spark.createDataFrame([(1, "n" * 50), (3, "n")], "id int, new_text string")
    r = audit.repaired(d, "id", "text", audit.flagged(a, "id"), new, 10)
    assert rows(r, "id", "state") == [(1, "replaced"), (2, "failed"), (3, "failed"), (4, "failed"), (5, "kept")]
    assert audit.consistency(d, new, "id").first()[:] == (3, 0)


def test_metrics(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 4)], "q int, doc string, rank int")
    rel = spark.createDataFrame([(1, "b"), (2, "c"), (3, "x")], "q int, doc string")
    per, mean = evaluate.retrieval_metrics(hits, rel, rel, "q", "doc")
    assert rows(per, "q", "mrr", "p1", "hit") == [(1, 0.5, 0.0, 1.0), (2, 0.25, 0.0, 0.0), (3, 0.0, 0.0, 0.0)]
    assert mean.first().mrr == 0.25
    p = spark.createDataFrame([(1, "the cat sat", "Cat sat sat!"), (2, "", ""), (3, None, "x"), (4, "a b b", "b")], "id int, p string, t string")
    got = {r.id: (r.em, r.f1) for r in evaluate.answer_metrics(p, "id", "p", "t").collect()}
    assert got[1] == (0, pytest.approx(0.8)) and got[2] == (1, 0.0) and got[3] == (0, 0.0) and got[4][1] == pytest.approx(2 / 3)


def test_answers(spark):
    d = spark.createDataFrame([("Who released it?", "album", "T", "A"), ("Which album?", "album", "T", None), ("What genre?", "artist", "T", "A")], "q string, k string, t string, a string")
    assert [r.r for r in d.select(qa.metadata_answer(F.col("q"), F.col("k"), F.col("t"), F.col("a")).alias("r")).collect()] == ["A", "T", None]
    c = spark.createDataFrame([(1, "Blue.", 0.9, 0.1, 1), (1, "blue", 0.8, 0.1, 2), (1, "Red", 0.1, 0.9, 3), (1, " ", 1.0, 1.0, 4), (1, None, 1.0, 1.0, 5)], "q int, a string, s double, r double, id int")
    assert rows(qa.ranked_answers(c, "q", "a", "s", "r", "id"), "place", "answer") == [(1, "Blue"), (2, "Red")]
    h = spark.createDataFrame([(1, "Why is Blue important?", "Blue", 1, "Blue is a critical landmark of the whole decade, they say. It sold a great many copies in that one country! Short one.")], "q int, question string, title string, rank int, text string")
    e = qa.evidence_sentences(h, "q", "question", "title", "text")
    assert [(r.place, r.points) for r in e.collect()] == [(1, 2 + 3 + 1)]
    assert qa.explanations(e, h, "q", "question").first().answer.startswith("Based on the retrieved documents: Title: Blue. Evidence: Blue is")


def test_span_search(spark):
    d = spark.createDataFrame([(1, [0.0, 5.0, 1.0], [4.0, 0.0, 3.0]), (2, [], []), (3, None, None)], "id int, s array<double>, e array<double>")
    r = qa.best_span(d, "id", "s", "e").collect()
    assert [(x.id, x.span_start, x.span_end) for x in r] == [(1, 1, 2)]


def test_layout(spark):
    f = [("d", 1, 100, 10, "12", True, False), ("d", 1, 101, 30, "abdome m", True, False), ("d", 1, 103, 10, "Anatomia", False, True), ("d", 1, 50, 10, "crop", False, False),
         ("d", 1, 120, 10, "SIN.- ventre; barriga", False, False), ("d", 1, 130, 10, "[Br.]; pança", False, False), ("d", 1, 140, 10, "en abdomen; belly", False, False), ("d", 1, 150, 10, "Vid.- tórax", False, False),
         ("d", 1, 160, 10, "13 ácido", True, False), ("d", 1, 170, 10, "úrico m", False, False), ("d", 1, 180, 10, "Nota.- Forma pura.", False, False), ("d", 1, 100, 400, "next column", False, False)]
    frag = spark.createDataFrame(f, "doc_id string, page int, top int, left int, txt string, bold boolean, italic boolean")
    lines = layout.reconstruct_lines(frag)
    got = [(r.col, r.text) for r in sorted(lines.collect(), key=lambda r: (r.col, r.line_no))]
    assert got[:2] == [(0, "12 abdome m"), (0, "Anatomia")] and got[-1] == (1, "next column")
    e, refs = layout.entries(lines.filter("col = 0"))
    by = {r.id: r for r in e.collect()}
    assert (by["12"].ga, by["12"].pos, by["12"].dom, by["12"].sin, by["12"].see) == ("abdome", "m", ["Anatomia"], ["ventre", "barriga [Br.]", "pança"], ["tórax"])
    assert by["12"].trad == {"en": ["abdomen", "belly"]}
    assert (by["13"].ga, by["13"].pos, by["13"].nota, by["13"].sin) == ("ácido úrico", "m", "Forma pura.", None)
    loose = spark.createDataFrame([("d", 1, 0, i, 100 + i, t, False, False) for i, t in enumerate(["*termo Vid.- outro", "12 x m"])], "doc_id string, page int, col int, line_no int, top int, text string, bold boolean, italic boolean")
    assert rows(layout.entries(loose)[1], "source", "target") == [("*termo", "outro")]


def test_pages(spark):
    html = "<h1>Site</h1><h1>Flu</h1><!-- <p>no</p> --><script>var p='<p>x</p>'</script><p>A &amp; b<p>Second<h2>Sintomas</h2><ul><li>Fever</li><li>Fever</li><li>Cough</li></ul><h2>Outro</h2><p>End</p>"
    e = pages.elements(spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string"), "id", "html")
    assert pages.title(e, "id", ["site"]).first().title == "Flu"
    r = pages.records(pages.sections(e, "id"), "id").first()
    assert (r.descricao, r.sintomas, r.causas) == ("A & b Second End", ["Fever", "Cough"], [])
    idx = spark.createDataFrame([("a", "u", "N", "x"), ("a", "u", "N", "x"), ("b", "w", "M", "y")], "letra string, url string, nome string, descricao string")
    art = spark.createDataFrame([("u", "Name", " ")], "url string, nome string, descricao string")
    assert rows(pages.with_articles(idx, art, "url", ["nome", "descricao"]), "letra", "nome", "descricao") == [("a", "Name", "x"), ("b", "M", "y")]


def test_vectors(spark):
    v = spark.createDataFrame([(1, "g", [1.0, 0.0]), (2, "g", [0.9, 0.1]), (3, "g", [0.0, 1.0]), (4, "h", [1.0, 1.0])], "id int, g string, v array<double>")
    assert rows(embed.odd_one_out(v, "g", "id", "v"), "g", "id") == [("g", 3)]
    assert rows(embed.centroids(v, "g", "v"), "g", "vec")[1] == ("h", [1.0, 1.0])
    q = spark.createDataFrame([(7, 1, 1.0), (7, 3, -1.0), (7, 99, 1.0)], "q int, id int, sign double")
    assert embed.analogy_vectors(v, "id", "v", q, "q").first().vec == [0.5, -0.5]
    p = embed.projected(v, "id", "v", 1)
    assert p.count() == 4
    h = embed.hashed_vectors(spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, t array<string>"), "id", "t", 8)
    assert [(r.id, len(r.vec)) for r in h.collect()] == [(1, 8)]


def test_group_counts_and_totals(spark):
    d = spark.createDataFrame([("a", None), ("a", "x"), ("b", "x")], "p string, q string")
    got = sorted(map(tuple, stats.group_counts(d, ["p", "q"]).collect()), key=repr)
    assert got == sorted([("p", "a", 2), ("p", "b", 1), ("q", None, 1), ("q", "x", 2)], key=repr)


def test_skew_join_keeps_all_rows(spark):
    from lumentext.session import skew_join

    rows_ = spark.range(3000).select(F.when(F.col("id") < 2500, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    keyed = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    counts = rows_.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = skew_join(rows_, keyed, "k", counts, hot=100, salts=8)
    assert out.count() == 3000 and out.filter("w <> 2 * k").count() == 0
