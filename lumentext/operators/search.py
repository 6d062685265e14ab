"""One interface over the rankings: sparse, dense and mixed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import retrieve


@dataclass
class Searcher:
    """Searches ``chunks`` (chunk_id, doc_id, type, text and, for vectors, embedding) by ``method``: bm25, dense or hybrid.

    Queries are a table (query_id, query) with a vector qv for the dense part. All queries are answered by one job.
    """

    chunks: DataFrame
    method: str = "hybrid"
    alpha: float = 0.6
    digits: int = 6

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score, bm25_score, dense_score) of all chunks that the method scores."""
        sparse = dense = None
        if self.method != "dense":
            sparse = retrieve.bm25_search(self.chunks, "chunk_id", "text", queries, "query_id", "query")
        if self.method != "bm25":
            dense = retrieve.dense_scores(self.chunks, "chunk_id", "embedding", queries, "query_id", "qv")
        if self.method == "bm25":
            return sparse.withColumn("bm25_score", F.col("score")).withColumn("dense_score", F.lit(0.0))
        if self.method == "dense":
            return dense.withColumn("bm25_score", F.lit(0.0)).withColumn("dense_score", F.col("score"))
        if self.method == "hybrid":
            return retrieve.hybrid_scores(sparse, dense, "query_id", "chunk_id", self.alpha)
        raise ValueError(f"unknown method {self.method}")

    def search(self, queries: DataFrame, top_k: int = 5, unique_docs: bool = False, filter_type: str | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, doc_id, score, bm25_score, dense_score): the best ``top_k``; of each document only its best chunk if
        ``unique_docs``, of one type only if ``filter_type``, both after scores were set to scale. Ties: the greater chunk_id."""
        hits = self.scores(queries).join(self.chunks.select("chunk_id", "doc_id", "type"), "chunk_id")
        if filter_type is not None:
            hits = hits.filter(F.col("type") == filter_type)
        score, tie = F.round("score", self.digits), F.col("chunk_id").desc()
        best = retrieve.best_per_doc(hits, "query_id", "doc_id", score, tie).filter(F.col("rank") <= top_k) if unique_docs else retrieve.top_k(hits, "query_id", score, tie, top_k)
        return best.select("query_id", "rank", "chunk_id", "doc_id", "score", "bm25_score", "dense_score")
