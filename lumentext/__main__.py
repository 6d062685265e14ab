"""Commands over a folder of Parquet tables: python -m lumentext COMMAND --data FOLDER."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import audit, qa
from .operators.search import Searcher
from .plans import queries
from .session import build_session, table


def _found(spark, a) -> "DataFrame":  # noqa: F821
    q = spark.createDataFrame([(1, a.query)], "query_id int, query string")
    return Searcher(table(spark, a.data, "chunks"), "bm25").search(q, a.top_k, a.unique_docs, a.filter_type)


def check(spark, a) -> None:
    dim = table(spark, a.data, "sbert_config").first().embedding_dim
    audit.project_status(table(spark, a.data, "corpus"), table(spark, a.data, "chunks"), "embedding", dim).show()
    audit.consistency(table(spark, a.data, "corpus"), table(spark, a.data, "chunks"), "doc_id").show()


def search(spark, a) -> None:
    _found(spark, a).join(table(spark, a.data, "chunks").select("chunk_id", "title", "url"), "chunk_id").orderBy("rank").select("rank", "score", "title", "chunk_id", "url").show(a.top_k, False)


def ask(spark, a) -> None:
    """The evidence for a question; generators and readers are given in Python."""
    hits = _found(spark, a).join(table(spark, a.data, "chunks").select("chunk_id", "title", "text"), "chunk_id").withColumn("question", F.lit(a.query))
    qa.evidence_sentences(hits, "query_id", "question", "title", "text").orderBy("place").show(8, False)


def evaluated(spark, a) -> None:
    queries.eval_retrieval(spark, a.data).show()


def run(spark, a) -> None:
    """Any query by its name."""
    queries.queries()[a.query](spark, a.data).show(a.top_k, False)


COMMANDS = {"check": check, "search": search, "ask": ask, "evaluate": evaluated, "run": run}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lumentext", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("query", nargs="?", default="")
    p.add_argument("--data", required=True)
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--unique-docs", action="store_true")
    p.add_argument("--filter-type")
    a = p.parse_args(argv)
    COMMANDS[a.command](build_session(), a)


if __name__ == "__main__":
    main()
