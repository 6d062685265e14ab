"""Readers, writers and streams."""

import json

from pyspark.sql import functions as F

from lumentext.sources import files, sinks
from lumentext.streaming import ingest


def test_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doc_id": "a", "text": "x", "more": 1}\n{"doc_id": "b"}\n', encoding="utf-8")
    got = files.json_lines(spark, str(tmp_path / "c.jsonl"), files.CORPUS)
    assert [(r.doc_id, r.text, r.artist) for r in got.orderBy("doc_id").collect()] == [("a", "x", None), ("b", None, None)]
    (tmp_path / "s.json").write_text(json.dumps([{"id": "1", "tipo": "web", "url": "u"}, {"id": "2", "tipo": "ftp"}, {"id": "3", "tipo": "pdf"}]))
    got = files.checked_sources(files.json_file(spark, str(tmp_path / "s.json"), files.SOURCES))
    assert [r.error for r in got.orderBy("id").collect()] == [None, "unknown kind", "no path"]
    (tmp_path / "x.iob").write_text("Rui\tB-Pessoa\nviu\tO\n\nAna\tB-Pessoa\n\n", encoding="utf-8")
    got = files.iob(spark, str(tmp_path / "x.iob"))
    assert [(r.sent_id, r.pos, r.token, r.tag) for r in got.orderBy("sent_id", "pos").collect()] == [(0, 0, "Rui", "B-Pessoa"), (0, 1, "viu", "O"), (1, 0, "Ana", "B-Pessoa")]
    (tmp_path / "l.xml").write_text('<pdf><page number="2"><text top="100" left="5" font="0"><b>12 x</b> &amp; <i>y</i></text><text top="110" left="5"> </text></page></pdf>')
    r = files.layout_xml(spark, str(tmp_path / "l.xml")).filter("top = 100").first()
    assert (r.page, r.left, r.txt, r.bold, r.italic) == (2, 5, "12 x & y", True, True)
    y = files.seeds_yaml(spark, "artists:\n- {name: A, wiki_title: W, type: artist}\nalbums:\n- {name: B, wiki_title: V, type: album, artist: A}\n")
    assert [(r.section, r.name, r.artist) for r in y.orderBy("name").collect()] == [("artists", "A", None), ("albums", "B", "A")]


def test_pages_joined(spark):
    p = spark.createDataFrame([("d", 2, "b"), ("d", 1, " a "), ("e", 1, " "), ("e", 2, None)], "id string, page int, text string")
    got = {r.id: (r.text, r.error) for r in files.joined_pages(p, "id", "page", "text").collect()}
    assert got == {"d": ("a\n\nb", None), "e": ("", "no text")}


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x, "y"', 3, True, "")], "doc_id string, title string, text_chars int, title_in_text boolean, warnings string")
    full = df.select("doc_id", "title", *(F.lit("k").alias(c) for c in ("type", "section", "source_type", "source", "url")), "text_chars", "title_in_text", "warnings")
    sinks.write_csv(full, str(tmp_path / "a"))
    r = files.csv_table(spark, str(tmp_path / "a"), files.AUDIT).first()
    assert (r.title, r.text_chars, r.title_in_text) == ('x, "y"', 3, True)
    sinks.write_json_lines(full, str(tmp_path / "j"))
    assert files.json_lines(spark, str(tmp_path / "j"), files.AUDIT).count() == 1


def test_reports(spark):
    e = spark.createDataFrame([("s", "ORG", "A", 3, 1), ("s", "ORG", "B", 1, 2), ("s", "LOC", "M", 2, 1)], "source_id string, label string, text string, count int, place int")
    r = sinks.entity_report(e).first().report
    assert [x.text for x in r["ORG"]] == ["A", "B"] and list(r) == ["LOC", "ORG"]
    m = sinks.metrics_markdown(spark.createDataFrame([("bm25", 0.5)], "n string, mrr double"), "n", ["mrr"])
    assert [x.line for x in m.collect()] == ["| | mrr |", "|---|---|", "| bm25 | 0.5000 |"]
    d = spark.createDataFrame([("T & U", "x_1", "one two three four five six\n\nshort")], "t string, a string, b string")
    tex = d.select(sinks.latex_document(F.col("t"), F.col("a"), F.col("b")).alias("x")).first().x
    assert "T \\& U" in tex and "x\\_1" in tex and "short" not in tex and "five six" in tex


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 10:00:00"), (3, "c", "2024-02-01 00:00:00")], "id int, text string, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    s = ingest.arriving(spark, str(tmp_path / "in"), df.schema)
    ingest.run_once(ingest.counted_terms(s, "text", "t"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.term, r.n) for r in got.collect()) == [("a", 2), ("b", 2)]
    ingest.run_once(ingest.flagged_rows(ingest.arriving(spark, str(tmp_path / "in"), df.schema), "id", "text", 3), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert sorted((r.id, r.warnings) for r in spark.read.parquet(str(tmp_path / "o2")).collect()) == [(1, ""), (2, "short_text"), (3, "short_text")]
