"""Ranking: TF-IDF cosine, BM25, dense vectors and their mixture.

Queries are a table, so one job answers all of them. Terms meet in equi-joins; only ids and scores travel, and texts are joined to the few
rows that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..functions import values as V
from ..session import materialize, small
from .stats import document_frequency, term_counts, with_totals


def tfidf_rank(docs: DataFrame, key: str, text: str, queries: DataFrame, qkey: str, query: str, tokens=T.tokens_c) -> DataFrame:
    """(qkey, key, score): documents with a positive cosine; ``ranked`` or ``top_k`` puts them in order.

    A query's term frequency counts its unknown words in the length, though they weigh nothing. Term counts are written once; from them come
    the document frequencies, the norms, each an aggregate with map-side combining, and the dots, for which only the terms of the queries are read.
    """
    counts = materialize(term_counts(docs, key, tokens(F.col(text))), "terms")
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    idf = materialize(with_totals(document_frequency(counts), n).select("term", F.log10(F.col("n_docs") / F.col("df")).alias("idf")), "idf")
    w = F.col("n") / F.col("len") * F.col("idf")
    q = term_counts(queries, qkey, tokens(F.col(query))).join(idf, "term").select(qkey, "term", "idf", w.alias("wq"))
    q = materialize(q, "asked")
    qn = q.groupBy(qkey).agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("qn"))
    dots = counts.join(small(q), "term").groupBy(qkey, key).agg(F.sum(w * F.col("wq")).alias("dot"))
    norms = counts.join(idf, "term").groupBy(key).agg(F.sqrt(F.sum(w * w)).alias("dn"))
    scored = dots.filter("dot > 0").join(norms, key).join(qn, qkey)
    return scored.select(qkey, key, F.when(F.col("dn") * F.col("qn") == 0, F.lit(0.0)).otherwise(F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score")).filter("score > 0")


def ranked(df: DataFrame, qkey: str, score: Column, tie: Column, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(qkey).orderBy(score.desc(), tie)))


def bm25_terms(docs: DataFrame, key: str, text: str, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, tokens=T.tokens_b, only: DataFrame | None = None) -> DataFrame:
    """(term, key, s): what each term adds to each document's score: an index that can be kept; of the terms of ``only`` (term), if given.

    idf = ln(N - df + 0.5) - ln(df + 0.5); negative ones become epsilon times the mean idf of all terms.
    """
    # read four times below, each time with other columns, so an exchange could not be shared
    counts = materialize(term_counts(docs, key, tokens(F.col(text))), "terms")
    lens = counts.groupBy(key).agg(F.first("len").alias("len"))
    totals = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    length = lens.agg(F.sum("len").alias("all_len"))
    df = with_totals(document_frequency(counts), totals).withColumn("idf", F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = df.agg(F.avg("idf").alias("mean_idf"))
    terms = with_totals(df, mean).withColumn("idf", F.when(F.col("idf") < 0, F.col("mean_idf") * epsilon).otherwise(F.col("idf"))).select("term", "idf", "n_docs")
    if only is not None:
        terms = small(materialize(terms.join(small(only), "term", "left_semi"), "asked"))
    parts = with_totals(counts.join(terms, "term"), length)
    avg = F.col("all_len") / F.col("n_docs")
    s = F.col("idf") * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("len") / avg))
    return parts.select("term", key, s.alias("s"))


def bm25_scores(index: DataFrame, key: str, queries: DataFrame, qkey: str, query: str, tokens=T.tokens_b) -> DataFrame:
    """(qkey, key, score) of all documents that share a term; repeated query words count again. Only the postings of the queries' terms are summed."""
    return _summed(index, key, materialize(_asked(queries, qkey, query, tokens), "asked"), qkey)


def bm25_search(docs: DataFrame, key: str, text: str, queries: DataFrame, qkey: str, query: str, tokens=T.tokens_b) -> DataFrame:
    """The same without a kept index: statistics of all terms, but postings only of the queries' terms."""
    q = materialize(_asked(queries, qkey, query, tokens), "asked")
    return _summed(bm25_terms(docs, key, text, tokens=tokens, only=q.select("term").distinct()), key, q, qkey)


def _asked(queries: DataFrame, qkey: str, query: str, tokens) -> DataFrame:
    return term_counts(queries, qkey, tokens(F.col(query))).select(qkey, "term", F.col("n").alias("times"))


def _summed(index: DataFrame, key: str, asked: DataFrame, qkey: str) -> DataFrame:
    return index.join(small(asked), "term").groupBy(qkey, key).agg(F.sum(F.col("s") * F.col("times")).alias("score"))


def dense_scores(vectors: DataFrame, key: str, vec: str, queries: DataFrame, qkey: str, qvec: str, k: int | None = None, block: int = 65536) -> DataFrame:
    """(qkey, key, score): cosine of every query with every vector, or at least of the k best of each query.

    The queries are taken in blocks of about ``block``, each sent to all tasks, a bounded size; for each block the vectors are read once and not
    shuffled, and each batch of them sends on only what may be among the best k. Vectors of another length than the query's and
    NULL or zero vectors score nothing; no queries or no vectors give no rows.
    """
    ok = lambda c: F.col(c).isNotNull() & F.exists(c, lambda x: x != 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x))
    q = queries.filter(ok(qvec)).select(F.col(qkey).alias("qid"), F.col(qvec).cast("array<double>").alias("qv"))
    v = vectors.filter(ok(vec)).select(F.col(key).alias("vid"), F.col(vec).cast("array<double>").alias("vv"))
    schema = f"{qkey} {dict(queries.dtypes)[qkey]}, {key} {dict(vectors.dtypes)[key]}, score double"
    kind = to_arrow_type(queries.schema[qkey].dataType)
    turns = -(-q.count() // block)
    out = vectors.sparkSession.createDataFrame([], schema)
    for i in range(turns):
        rows = (q.filter(F.pmod(F.xxhash64("qid"), F.lit(turns)) == i) if turns > 1 else q).collect()
        held = []
        for dim in {len(r.qv) for r in rows}:
            same = [r for r in rows if len(r.qv) == dim]
            m = np.array([r.qv for r in same])
            held.append((pa.array([r.qid for r in same], kind), m / np.linalg.norm(m, axis=1, keepdims=True)))
        kept = vectors.sparkSession.sparkContext.broadcast(held)

        def go(it: Iterator[pa.RecordBatch], kept=kept) -> Iterator[pa.RecordBatch]:
            for b in it:
                lens = np.asarray(b.column(1).value_lengths()) if b.num_rows else np.zeros(0, int)
                for ids, m in kept.value:
                    rows = np.flatnonzero(lens == m.shape[1])
                    if not len(rows):
                        continue
                    x = np.asarray(b.column(1).take(pa.array(rows)).flatten()).reshape(len(rows), -1)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    for at in range(0, len(m), 1024):
                        s = m[at : at + 1024] @ x.T
                        if k is not None and len(rows) > k:
                            least = np.partition(s, len(rows) - k, axis=1)[:, len(rows) - k, None]
                            u, w = np.nonzero(s >= least - 1e-9)
                        else:
                            u, w = (z.reshape(-1) for z in np.indices(s.shape))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(u + at)), b.column(0).take(pa.array(rows[w])), pa.array(s[u, w])], names=[qkey, key, "score"])

        out = out.unionByName(v.mapInArrow(go, schema))
    return out


def scaled(score: Column, low: Column, high: Column) -> Column:
    """A score from 0 to 1 between the lowest and the highest of its query; all equal scores become 0."""
    return F.when(high == low, F.lit(0.0)).otherwise((score - low) / (high - low))


def hybrid_scores(bm25: DataFrame, dense: DataFrame, qkey: str, key: str, alpha: float = 0.6) -> DataFrame:
    """(qkey, key, bm25_score, dense_score, score): (1 - alpha) of the one and alpha of the other, each from 0 to 1 over all documents of the query.

    Documents without a common term have a BM25 score of 0. Filters by type belong after this step: before it they would change the scores. The bounds of each
    query are aggregates with map-side combining, one row a query, so no task holds a query's documents.
    """
    both = dense.select(qkey, key, F.col("score").alias("dense_score")).join(bm25.select(qkey, key, F.col("score").alias("bm25_score")), [qkey, key], "left")
    both = materialize(both.withColumn("bm25_score", F.coalesce("bm25_score", F.lit(0.0))), "both")
    ends = both.groupBy(qkey).agg(*(f(c).alias(f"_{n}_{c}") for c in ("bm25_score", "dense_score") for n, f in (("low", F.min), ("high", F.max))))
    x = both.join(small(ends), qkey)
    part = lambda c: scaled(F.col(c), F.col(f"_low_{c}"), F.col(f"_high_{c}"))
    return x.select(qkey, key, "bm25_score", "dense_score", ((1 - alpha) * part("bm25_score") + alpha * part("dense_score")).alias("score"))


def best_per_doc(hits: DataFrame, qkey: str, doc: str, score: Column, tie: Column) -> DataFrame:
    """The best hit of each document, ranked again."""
    w = Window.partitionBy(qkey, doc).orderBy(score.desc(), tie)
    return ranked(hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n"), qkey, score, tie)


def top_k(hits: DataFrame, qkey: str, score: Column, tie: Column, k: int) -> DataFrame:
    """The first ``k`` of each query, ranked. Spark keeps the first k of each query in every task before it shuffles (a window group limit), so no task holds a query's hits."""
    return ranked(hits, qkey, score, tie).filter(F.col("rank") <= k)


def confidence(hits: DataFrame, qkey: str, score: str = "score", low: float = V.LOW_SCORE, margin: float = V.LOW_MARGIN) -> DataFrame:
    """(qkey, flag): low or ambiguous or ok, by the first hit's score and its distance from the second, 1 where there is none."""
    w = Window.partitionBy(qkey).orderBy("rank")
    top = hits.withColumn("next", F.lead(score).over(w)).filter("rank = 1")
    m = F.coalesce(F.col(score) - F.col("next"), F.lit(1.0))
    return top.select(qkey, F.when(F.col(score) < low, "low").when(m < margin, "ambiguous").otherwise("ok").alias("flag"))
