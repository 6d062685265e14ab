"""The best hits found where documents are read, against all scores ranked."""

import random

import pytest
from pyspark.sql import functions as F

from lumentext.operators import best, retrieve


@pytest.fixture
def small_blocks(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    monkeypatch.setattr(best, "ROWS", 100)
    monkeypatch.setattr(best, "CELLS", 16)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(900):
        text = " ".join(r.choice(words[: r.choice([3, 20, 60])]) for _ in range(r.randint(1, 30))) + (f" rare{i}" if i % 40 == 0 else "")
        vec = [r.gauss(0, 1) for _ in range(3 if i % 17 == 0 else 4)]
        rows.append((f"c{i:04d}", f"d{r.randint(0, 250)}" if i % 90 else None, None if i % 101 == 0 else text, None if i % 31 == 0 else [0.0] * 4 if i % 37 == 0 else vec, r.choice(["album", "song", None])))
    rows += [(f"x{i:03d}", f"y{i % 30}", "w1 w2 same", [1.0, 0.0, 0.0, 0.5], "album") for i in range(200)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, embedding array<float>, type string").repartition(3).cache()


QUESTIONS = [(1, "w1 w1 w59"), (2, "rare40 w3"), (3, "same"), (4, "unknown"), (5, "rare80"), (6, "w0 w1 w2"), (7, None), (8, "w5 w40 w41 w42")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUESTIONS, "question_id int, question string")


def rows(df):
    return sorted(tuple(x) for x in df.collect())


@pytest.mark.parametrize("block", [65536, 3])
def test_bm25_best_per_doc(spark, small_blocks, chunks, asked, block):
    score, tie = F.round("score", 6), F.col("chunk_id").desc()
    ranked = lambda h: rows(retrieve.best_per_doc(h, "question_id", "doc_id", score, tie).filter("rank <= 10").select("question_id", "rank", "chunk_id", score))
    every = retrieve.bm25_search(chunks, "chunk_id", "text", asked, "question_id", "question").join(chunks.select("chunk_id", "doc_id"), "chunk_id")
    few = best.bm25_best(chunks, "chunk_id", "text", asked, "question_id", "question", 10, "doc_id", block=block)
    assert ranked(few) == ranked(every)
    # what leaves the tasks is bounded by queries and tasks, not by pairs, though 200 documents are alike
    assert few.count() <= len(QUESTIONS) * chunks.rdd.getNumPartitions() * 80 and few.filter("question_id = 6").count() < every.filter("question_id = 6").count() / 3


def test_every_question_is_answered(spark, data):
    from lumentext.plans.queries import queries

    ids = {r[0] for r in spark.read.parquet(f"{data}/answer_question.parquet").filter("question is not null").select("question_id").distinct().collect()}
    assert {r[0] for r in queries()["bm25_unique_docs"](spark, data).select("question_id").distinct().collect()} == ids


def test_bm25_best(spark, small_blocks, chunks, asked):
    ranked = lambda h: rows(retrieve.top_k(h, "question_id", F.round("score", 6), F.col("chunk_id").desc(), 10).select("question_id", "rank", "chunk_id", F.round("score", 6)))
    every = retrieve.bm25_search(chunks, "chunk_id", "text", asked, "question_id", "question")
    few = best.bm25_best(chunks, "chunk_id", "text", asked, "question_id", "question", 10)
    assert ranked(few) == ranked(every)
    assert few.count() < every.count() / 2


@pytest.mark.parametrize("block", [65536, 3])
def test_hybrid_best(spark, small_blocks, chunks, asked, block):
    r = random.Random(3)
    vecs = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(3 if i == 3 else 4)]) for i in (1, 2, 3, 4, 6, 7, 9)] + [(8, None)], "question_id int, qv array<float>")
    score, tie = F.round("score", 6), F.col("chunk_id").desc()
    sparse = retrieve.bm25_search(chunks, "chunk_id", "text", asked, "question_id", "question")
    every = retrieve.hybrid_scores(sparse, retrieve.dense_scores(chunks, "chunk_id", "embedding", vecs, "question_id", "qv"), "question_id", "chunk_id")
    few = lambda k, **more: best.hybrid_best(chunks, "chunk_id", "text", "embedding", asked, "question_id", "question", vecs, "qv", k, block=block, **more)
    ranked = lambda h: rows(retrieve.top_k(h, "question_id", score, tie, 10).select("question_id", "rank", "chunk_id", score))
    assert ranked(few(10)) == ranked(every)
    albums = every.join(chunks.select("chunk_id", "doc_id", "type"), "chunk_id").filter("type = 'album'")
    by_doc = lambda h: rows(retrieve.best_per_doc(h, "question_id", "doc_id", score, tie).filter("rank <= 5").select("question_id", "rank", "chunk_id", score))
    f = few(5, per="doc_id", where=F.col("type") == "album")
    assert by_doc(f) == by_doc(albums)
    assert f.count() < albums.count() / 2
