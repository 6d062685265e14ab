"""Answers, features, seams, search, sinks: edge cases and small goldens."""

import json

import pytest

from lumentext.functions import text as T
from lumentext.operators import answering, audit, embed, evaluate, features, graph, models, stats
from lumentext.operators.search import Searcher
from lumentext.sources import sinks
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


HITS = "question_id long, question string, rank int, chunk_id string, title string, type string, artist string, source string, url string, text string, score double, answer string"


def hits(spark, data):
    return spark.createDataFrame(data, HITS)


def reader(asked):
    return asked.select("question_id", "chunk_id", F.upper(F.substring("context", 1, 3)).alias("answer"), F.lit(0.5).alias("qa_score"))


def test_extractive_answers(spark):
    h = hits(spark, [
        (1, "Who released X?", 1, "a", "X", "album", "Ana", "s", None, "text", 0.2, "clash"),
        (1, "Who released X?", 2, "b", "Y", "album", None, "s", None, "text", 0.9, None),
        (1, "Who released X?", 3, "c", "Z", "artist", None, "s", None, None, 0.9, None),
        (2, None, 1, "d", None, None, None, None, None, None, None, None),
    ])
    got = rows(answering.extractive_answers(h, "question_id", "question", reader), "question_id", "place", "answer", "answer_method", "chunk_id")
    # rules first; the second passage has no artist, so it is read; what the third has is the same answer; a passage without text gives none
    assert got == [(1, 1, "Ana", "metadata", "a"), (1, 2, "THE", "model", "b")]
    assert answering.extractive_answers(h.limit(0), "question_id", "question", reader).count() == 0


def test_logit_reader_masks_what_is_outside(spark):
    df = spark.createDataFrame([(1, "a")], "question_id long, chunk_id string")

    def logits(asked):
        one = lambda xs, t: F.array(*(F.lit(x) for x in xs)).cast(t)
        return asked.select("question_id", "chunk_id", one(["q", "x", "y", "z"], "array<string>").alias("tokens"), one([9.0, 1.0, 5.0, 0.0], "array<double>").alias("starts"), one([9.0, 0.0, 1.0, 4.0], "array<double>").alias("ends"), one([False, True, True, True], "array<boolean>").alias("inside"))

    assert rows(answering.logit_reader(logits, ["question_id", "chunk_id"])(df), "chunk_id", "answer") == [("a", "y z")]


def test_abstractive_answers(spark):
    long = "The album was met with critical acclaim and it won a grammy award in that very year."
    h = hits(spark, [
        (1, "Who released X?", 1, "a", "X", "album", "Ana", "s", None, "text", 0.2, None),
        (2, "Explain why X is considered important.", 1, "b", "X", "album", "Ana", "s", None, long, 0.2, None),
        (3, "When was it?", 1, "c", "X", "artist", None, "s", None, "text", 0.2, None),
        (4, "Why is Q important?", 1, "d", "Q", "artist", None, "s", None, None, 0.2, None),
    ])
    got = {r.question_id: (r.answer, r.answer_method) for r in answering.abstractive_answers(h, "question_id", "question", lambda: lambda ps: ['"' + p[:5] + '"' if "Why" not in p else None for p in ps]).collect()}
    assert got[1] == ("Ana", "metadata") and got[3] == ("You a", "generative")
    assert got[2] == ("X is considered important due to widespread critical acclaim, Grammy recognition and award recognition, as supported by the retrieved documents.", "evidence_synthesis")
    assert got[4] == ("The retrieved documents do not contain enough information to answer this question.", "evidence_synthesis")
    assert rows(answering.answer_methods(answering.abstractive_answers(h.limit(0), "question_id", "question", lambda: list)), "n") == []


def test_filled_puts_nothing_within_what_was_put_in(spark):
    df = spark.createDataFrame([("{b}", "x"), (None, "y")], "a string, b string")
    assert rows(df.select(answering.filled("1 {a} 2 {b} 3", a=F.col("a"), b=F.col("b")).alias("t")), "t") == [("1  2 y 3",), ("1 {b} 2 x 3",)]


def test_example_questions(spark):
    demo = spark.createDataFrame([("A?", "album", "Both")], "question string, filter_type string, mode string")
    extra = spark.createDataFrame([("A?", None), ("Why b?", None), ("C?", "x")], "question string, filter_type string")
    assert rows(answering.example_questions(demo, extra), "question", "filter_type", "mode") == [("A?", "album", "Both"), ("C?", "x", "Both"), ("Why b?", "(all types)", "Abstractive")]


def brute_features(nq, ts, a, b, max_length, stride):
    room, out, first = max(max_length - nq - 3, stride + 1), [], 0
    while True:
        part = ts[first : first + room]
        s = e = 0
        if a is not None and part and part[0][0] <= a and part[-1][1] >= b:
            s = max(i for i, t in enumerate(part) if t[0] <= a) + nq + 2
            e = min(i for i, t in enumerate(part) if t[1] >= b) + nq + 2
        out.append((first, len(part), s, e))
        if first + room >= len(ts):
            return out
        first += room - stride


def test_qa_features(spark):
    import re

    text = " ".join(f"word{i}" for i in range(23))
    cases = [(1, "is it", f"  {text} ", "word7"), (2, "is it", text, "word21 word22"), (3, None, "a b", "b"), (4, "q", "", None), (5, "q", None, None), (6, "q q", text, None)]
    data = [(k, q, c, c.index(a) if a else None, a, 0) for k, q, c, a in cases]
    df = spark.createDataFrame(data, "id long, q string, c string, at int, a string, window int")
    got = rows(features.qa_features(df, "id", "q", "c", "at", "a", max_length=14, stride=3), "id", "first", "n", "start_position", "end_position")
    want = []
    for k, q, c, at, a, _ in data:
        if c is not None and q is not None:
            ts = [m.span() for m in re.finditer(r"\S+", c)]
            want += [(k, *f) for f in brute_features(len(q.split()), ts, at, at + len(a) if a else None, 14, 3)]
    assert [g for g in got if g[0] not in (3,)] == sorted(want, key=repr)
    assert features.qa_features(df.limit(0), "id", "q", "c", "at", "a").count() == 0


def test_spans_labels_and_pieces(spark):
    df = spark.createDataFrame([(1, [0.0, 3.0, 3.0], [5.0, 1.0, 0.0]), (2, [1.0], [2.0]), (3, None, None)], "id long, s array<double>, e array<double>")
    assert rows(features.argmax_span(df, "id", "s", "e"), "id", "span_start", "span_end") == [(1, 1, 1), (2, 0, 0), (3, None, None)]
    t = spark.createDataFrame([("O",), ("B-X",), (None,), ("O",)], "tag string")
    assert rows(features.label_ids(t, "tag"), "label", "id") == [("B-X", 0), ("O", 1)]
    w = spark.createDataFrame([(1, ["ab", "c"], [7, 8]), (2, [], []), (3, None, None)], "id long, w array<string>, l array<int>")
    e = features.encoded_words(w, "id", "w", "l", lambda x: F.filter(F.split(x, ""), lambda c: c != ""), 2)
    assert rows(e, "id", "pieces", "labels") == [(1, ["a", "b"], [7, -100]), (2, [], []), (3, None, None)]


def test_metrics(spark):
    p = spark.createDataFrame([(1, "the cat", ["a dog", "Cat!"]), (2, "x y", ["x z", ""]), (3, "q", []), (4, None, [None, "r"])], "id long, p string, t array<string>")
    r = evaluate.mean_answers(p, "id", "p", "t").first()
    assert (r.exact_match, r.f1, r.samples) == (pytest.approx(66.67), pytest.approx(50.0), 3)  # nothing equals nothing
    assert evaluate.mean_answers(p.limit(0), "id", "p", "t").first().samples == 0
    g = spark.createDataFrame([(1, 0, "O"), (1, 1, "B-X"), (1, 2, "#")], "sent_id long, pos int, tag string")
    q = spark.createDataFrame([(1, 0, "O")], "sent_id long, pos int, tag string")
    assert tuple(evaluate.token_accuracy(g, q, ignored="#").first()) == (2, 1, 0.5)
    assert tuple(evaluate.token_accuracy(g.limit(0), q).first()) == (0, 0, 0.0)
    m = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "k string, f1 double")
    assert rows(evaluate.metric_deltas(m, m.filter("k = 'a'").withColumn("f1", F.lit(0.5)), ["k"], ["f1"]), "k", "f1") == [("a", 1.5)]


def test_model_seams(spark):
    df = spark.createDataFrame([(1, "aab", 9), (2, None, 9), (3, "", 9)], "id long, text string, vec int")
    v = models.encoded(df, "id", "text", lambda: lambda ts: [[float(t.count("a")), float(t.count("b"))] for t in ts])
    got = dict(rows(v, "id", "vec"))
    assert got[1] == pytest.approx([0.894427, 0.447214], abs=1e-5) and got[2] == got[3] == [0.0, 0.0]
    t = models.tagged(spark.createDataFrame([(1, ["A", "b"]), (2, [])], "id long, w array<string>"), "id", "w", lambda: lambda ws: [["B-X" if x[0].isupper() else "O" for x in w] for w in ws])
    assert rows(t, "id", "pos", "token", "tag") == [(1, 0, "A", "B-X"), (1, 1, "b", "O")]
    assert models.encoded(df.limit(0), "id", "text", lambda: list).count() == 0
    assert models.first_present("/nowhere", "/tmp", "/") == "/tmp" and models.first_present() is None


def test_searcher(spark):
    c = spark.createDataFrame([("a1", "a", "album", "blue sky", [1.0, 0.0]), ("a2", "a", "album", "blue blue sea", [0.8, 0.6]), ("b1", "b", "artist", "red sea", [0.0, 1.0]), ("z", "z", None, None, None), *((f"y{i}", "y", "genre", "green tree", None) for i in range(4))], "chunk_id string, doc_id string, type string, text string, embedding array<double>")
    q = spark.createDataFrame([(1, "blue sea", [0.0, 1.0])], "query_id int, query string, qv array<double>")
    best = lambda m, **k: [r.chunk_id for r in Searcher(c, m).search(q, **k).orderBy("rank").collect()]
    assert best("dense", top_k=2) == ["b1", "a2"] and best("bm25", top_k=1) == ["a2"]
    assert best("hybrid", unique_docs=True) == ["a2", "b1"] or best("hybrid", unique_docs=True) == ["b1", "a2"]
    assert best("hybrid", filter_type="artist") == ["b1"] and best("dense", filter_type="none") == []
    with pytest.raises(ValueError):
        Searcher(c, "other").search(q)


def test_text_functions(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one(T.clean_book, "x\r\n— CAPÍTULO UM —\r\r\nEra") == "— capítulo um —\nera"
    assert one(T.book_sentences, "um “dia” (frio). e\nágua-viva!? ñ") == ["um dia frio", "e água viva"]
    assert one(T.clean_sentence, "2 Introduction In 2014, it began.") == "In 2014, it began."
    assert [one(T.clean_lang_trailing, t) for t in ("casa  PT ", "pt", "casa fr", None)] == ["casa", "pt", "casa fr", None]
    for f in (T.clean_book, T.book_sentences, T.clean_sentence):
        assert one(f, None) is None and one(f, "") in ("", [])


def test_sources_graph_and_reports(spark, tmp_path):
    ext = spark.createDataFrame([("d", 2, "http://b.org/x", "y" * 50), ("d", 1, "http://www.a.org/x", "short [1]"), ("d", 3, "http://c.org", "z" * 50), ("e", 1, None, None)], "k string, place int, url string, text string")
    wiki = spark.createDataFrame([("d", "w", "w" * 40), ("e", "v", "v" * 40), ("f", "u", "u")], "k string, url string, text string")
    assert rows(audit.first_usable(ext, wiki, "k", 20, 20), "k", "source_type", "source", "url") == [("d", "external", "b.org", "http://b.org/x"), ("e", "wikipedia", "Wikipedia", "v")]
    n = spark.createDataFrame([("l", "Ana"), ("l", "Rui")], "by string, name string")
    f = spark.createDataFrame([("l", "Ana", 4)], "by string, name string, freq int")
    g = spark.createDataFrame([("Ana", "aliados")], "name string, grp string")
    assert rows(graph.drawn_nodes(n, f, g, ["by"]), "name", "size", "colour") == [("Ana", 12, "#2ECC71"), ("Rui", 30, "#95A5A6")]
    gaz = spark.createDataFrame([("a b c d", "long"), ("b", "short")], "phrase string, name string")
    s = spark.createDataFrame([(1, "x a b c d y b")], "k long, t string")
    assert rows(graph.mentions(s, ["k"], "t", gaz), "name") == [("long",), ("short",)]
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.0, 1.0])], "word string, vector array<double>")
    lines = [r.line for r in embed.experiment_lines(v, spark.createDataFrame([("a", 3), ("b", 3), ("c", 1)], "word string, n long"), ["a", "zz"], [("a", "b"), ("a", "zz")], [["a", "b", "c"], ["zz"]], [(["a", "c"], ["b"]), (["zz"], [])], top=1).orderBy("line_no").collect()]
    assert lines == ["Most frequent words", "a b c", "Most similar", "[a]", "b: 0.8000", "[zz]", "not in the vocabulary", "Similarity", "a ~ b: 0.8000", "a ~ zz: not in the vocabulary", "Odd one out", "a b c: c", "zz: not in the vocabulary", "Analogies", "a + c - b", "not in the vocabulary", "zz - ", "not in the vocabulary"]
    assert rows(embed.pair_similarity(v, "word", "vector", spark.createDataFrame([("a", "b"), ("a", "zz")], "a string, b string")), "a", "b", "similarity") == [("a", "b", 0.8), ("a", "zz", None)]
    assert rows(stats.dense_vectors(spark.createDataFrame([(1, "y", 0.5), (2, "q", 1.0)], "k long, term string, w double"), "k", ["y", "x"]), "k", "vec") == [(1, [0.0, 0.5]), (2, [0.0, 0.0])]
    assert rows(stats.ngram_keys(spark.createDataFrame([(["a", "b"], 2)], "bigram array<string>, n long"), "bigram", 2), "w1", "w2", "n") == [("a", "b", 2)]
    sinks.write_json_file(n, str(tmp_path / "r.json"))
    assert json.load(open(tmp_path / "r.json")) == [{"by": "l", "name": "Ana"}, {"by": "l", "name": "Rui"}]
    p = str(tmp_path / "corpus")
    assert sinks.swapped_in(n, p) == ""
    back = sinks.swapped_in(spark.read.parquet(p).filter("name = 'Ana'"), p)
    assert spark.read.parquet(p).count() == 1 and spark.read.parquet(back).count() == 2
    sinks.write_vectors_with_config(v, str(tmp_path / "v"), "m", 2, True)
    assert spark.read.json(str(tmp_path / "v" / "config")).first().embedding_dim == 2
    x = spark.createDataFrame([("T_1", None, None, None, None), (None, "A", "2024", "http://u", "p")], "t string, a string, y string, u string, p string")
    assert rows(x.select(sinks.latex_source(*map(F.col, "tayup")).alias("e")), "e") == [("A. \\textit{Untitled source} 2024. Disponível em: \\url{http://u}.",), ("Unknown author. \\textit{T\\_1}. Ficheiro PDF: .",)]


def test_command_line(spark, data, capsys):
    from lumentext.__main__ import main

    main(["run", "vocab_size", "--data", data])
    main(["search", "blue garden", "--data", data, "--top-k", "2"])
    main(["check", "--data", data])
    out = capsys.readouterr().out
    assert "source_id" in out and "chunk_id" in out and "other_length" in out


def test_paged_seeds_and_question_sets(spark, tmp_path):
    from lumentext.sources import files

    def make():
        pages = {("a", None): (["x", "y"], "2"), ("a", "2"): (["z"], None), ("b", None): ([], None), ("e", None): (["v"], "1"), ("l", None): (["i"], None)}
        return lambda k, t: pages[k, t]

    k = spark.createDataFrame([("a", 1), ("b", 1), (None, 1), ("e", 1), ("l", 1)], "k string, item int")
    assert rows(files.paged(k, "k", make), "k", "item") == [("a", "x"), ("a", "y"), ("a", "z"), ("e", "v"), ("e", None), ("l", "i")]
    assert rows(files.paged(k, "k", make).filter("error is not null"), "k") == [("e",)]
    assert files.paged(k.limit(0), "k", make).count() == 0
    s = files.seeds_yaml(spark, "albums:\n  - {name: A, wiki_title: A (album), type: album, artist: R}\nartists:\n  B: {type: artist}\n  C:\n")
    assert rows(s, "name", "wiki_title", "type", "section") == [("A", "A (album)", "album", "albums"), ("B", "B", "artist", "artists"), ("C", "C", None, "artists")]
    p = tmp_path / "q.json"
    p.write_text(json.dumps({"data": [{"title": "T", "paragraphs": [{"context": "c d", "qas": [{"id": "1", "question": "q", "answers": [{"text": "d", "answer_start": 2}]}, {"id": "2", "question": "r", "answers": []}]}]}]}))
    assert rows(files.question_sets(spark, str(p)), "id", "title", "context", "question", "answer_starts", "answers") == [("1", "T", "c d", "q", [2], ["d"]), ("2", "T", "c d", "r", [], [])]
