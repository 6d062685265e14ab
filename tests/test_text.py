"""Text functions on single values, edge cases included."""

import pytest
from pyspark.sql import functions as F

from lumentext.functions import text as T


def run(spark, f, *values, schema="a string"):
    df = spark.createDataFrame([values], schema)
    return df.select(f(*(F.col(c) for c in df.columns)).alias("r")).first().r


@pytest.mark.parametrize(
    "f, given, wanted",
    [
        (T.norm_spaces, " a  b\n c ", "a b c"),
        (T.norm_spaces, None, None),
        (T.norm_spaces, "", ""),
        (T.words, "  ", []),
        (T.split_semicolons, "a ; ;b  c;", ["a", "b c"]),
        (T.extract_date, "em 24/10/2017 - 19:10 h", "24/10/2017 - 19:10"),
        (T.extract_date, "nunca", None),
        (T.normalize_basic, "a\r\nb 5% [12] [note 3]x漢é", "a\nb 5  xé"),
        (T.remove_common_noise, "x\nPage 3/9\n\nFigure 2\n- item\n end ", "x\n\nend"),
        (T.remove_contents, "Intro ..... 4\n1.2 Our strategy\nbody", "body"),
        (T.fix_hyphenation, "explora-\ntion e ação-\nzinha", "exploration e açãozinha"),
        (T.join_broken_lines, "one\ntwo.\nThree\n\nfour", "one two.\nThree\n four"),
        (T.join_broken_lines, "a b\n- c\nd\nMain Title\ne", "a b\n- c d\nMain Title e"),
        (T.remove_corrupted_lines, "ok line\nhttp://x.y\na b c d e f g h i\n3 ESA/x", "ok line"),
        (T.collapse_blank_lines, "a \t b\n\n\n\nc ", "a b\n\nc\n"),
        (T.slugify, "AC/DC & Friends!", "ac_dc_and_friends"),
        (T.clean_for_chunks, "; Text [3]\nWhat is the meaning of this?  end", "Text end"),
        (T.split_sentences, "Short. This sentence is long enough to be kept here! And this one, too, is long enough?", ["This sentence is long enough to be kept here!", "And this one, too, is long enough?"]),
        (T.tokens_a, "Don't stop 42é", ["don't", "stop", "42"]),
        (T.tokens_b, "A1-b", ["a1", "b"]),
        (T.tokens_c, "The sun in the Sky", ["sun", "sky"]),
        (T.is_title, "O'Brien And Sons", True),
        (T.is_title, "Apollo of", False),
        (T.is_title, "ABC", False),
        (T.is_title, "", False),
        (T.domain_of, "https://www.Example.org:80/a?b", "example.org:80"),
        (T.domain_of, "nothing", ""),
        (T.normalize_answer, "The  Dark-Side, of a Moon", "darkside of moon"),
        (T.postprocess_answer, ' "Blonde Type." ', "Blonde"),
        (T.clean_generated, "\"'x'\"", "x"),
        (T.latex_escape, "\\a_b", "\\textbackslash\\{\\}a\\_b"),
        (T.entity_text, "the  Red Planet", "Red Planet"),
        (T.is_clean_entity, "C o m p l x", False),
        (T.is_clean_entity, "São Tomé", True),
        (T.is_clean_entity, "a|b", False),
        (T.shortened, "abcdefghijklmnopqrst", "abcdefghijklmnopq…"),
        (T.subject_of, "Why is Kind of Blue important?", "Kind of Blue"),
        (T.is_explanation, "What is the impact?", True),
    ],
)
def test_value(spark, f, given, wanted):
    assert run(spark, f, given) == wanted


def test_chunks_cover_all_words(spark):
    for n in (0, 39, 40, 170, 171, 305, 306, 640):
        text = " ".join(f"w{i}" for i in range(n))
        got = run(spark, T.chunk_words, text)
        want = [] if n < 40 else [text] if n <= 170 else [" ".join(text.split()[s : s + 170]) for s in range(0, n, 135) if n - s >= 40]
        assert got == want, n


def test_ngrams(spark):
    assert run(spark, lambda c: T.ngrams(T.words(c), 2), "a b c") == [["a", "b"], ["b", "c"]]
    assert run(spark, lambda c: T.ngrams(T.words(c), 3), "a b") == []
    assert run(spark, lambda c: T.ngrams(T.words(c), 2), None) == []


def test_sentence_rules(spark):
    ok = "The mission reached the outer moon after seven long years of quiet flight."
    assert run(spark, T.is_valid_sentence, ok) and run(spark, T.is_candidate_sentence, ok)
    for bad in ("Too short here.", "introduction to the plan we have today", "a b c d e f g h", "", None):
        assert not run(spark, T.is_valid_sentence, bad)
    for bad in ("it starts with a small letter and goes on for long", "It is short but has nine words in all.", "Why would anyone end a sentence of this length so?", "2.1 The heading of a section that is quite long", "See figure 3 for the shape of the whole thing."):
        assert not run(spark, T.is_candidate_sentence, bad)


def test_cut_back_matter_takes_list_order(spark):
    body = "x" * 600
    assert run(spark, T.cut_back_matter, f"{body} See also y External links z") == f"{body} See also y"
    assert run(spark, T.cut_back_matter, "References first " + body) == "References first " + body


def test_link_score(spark):
    f = lambda u, k: run(spark, T.link_score, u, k, schema="u string, k string")
    assert f("https://www.grammy.com/a", "artist") == 28
    assert f("https://pitchfork.com/a.pdf", "album") == -100
    assert f("https://vox.com/a", "album") == -100  # contains x.com
    assert f("https://a.example", "genre") == 0


def test_align_labels(spark):
    df = spark.createDataFrame([([7, 8], [None, 0, 0, 1, None])], "l array<int>, w array<int>")
    assert df.select(T.align_labels(F.col("l"), F.col("w")).alias("r")).first().r == [-100, 7, -100, 8, -100]


def test_explanation(spark):
    f = lambda q, e: spark.createDataFrame([(q, e)], "q string, e array<string>").select(T.explanation(F.col("q"), F.col("e")).alias("r")).first().r
    assert f("Why is X important?", ["It won a Grammy and is influential."]) == "X is considered important due to Grammy recognition and lasting influence on the genre, as supported by the retrieved documents."
    assert f("Why?", []).startswith("The retrieved documents do not contain")
    assert f("Why?", ["A sentence with nothing of note in it."]).startswith("Based on the retrieved documents: A sentence")


def test_date_and_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], "2024-03-09")], "a array<double>, z array<double>, d string")
    r = df.select(T.date_pt(F.to_date("d")).alias("d"), T.unit(F.col("a")).alias("u"), T.cosine(F.col("a"), F.col("z")).alias("c"), T.softmax(F.col("z")).alias("s")).first()
    assert r.d == "9 de março de 2024" and r.u == [0.6, 0.8] and r.c == 0 and r.s == [0.5, 0.5]
