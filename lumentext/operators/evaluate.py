"""Retrieval and answer metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .stats import with_totals


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, queries: DataFrame, qkey: str, doc: str, hit_k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Per query (qkey, mrr, p1, hit) and the means over all of ``queries``: hits have ranks, relevant is (qkey, doc); without a hit all are 0."""
    good = hits.join(relevant.select(qkey, doc).distinct(), [qkey, doc], "left_semi").groupBy(qkey).agg(F.min("rank").alias("first"))
    per = queries.select(qkey).distinct().join(good, qkey, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = per.select(qkey, zero(1.0 / F.col("first")).alias("mrr"), zero((F.col("first") == 1).cast("double")).alias("p1"), zero((F.col("first") <= hit_k).cast("double")).alias("hit"))
    means = per.agg(F.round(F.avg("mrr"), 4).alias("mrr"), F.round(F.avg("p1"), 4).alias("p1"), F.round(F.avg("hit"), 4).alias("hit"), F.count(F.lit(1)).alias("queries"))
    return per, means


def answer_metrics(pairs: DataFrame, key: str, predicted: str, truth: str) -> DataFrame:
    """(key, em, f1) of normalised answers: exact match, and F1 of their bags of words, 0 where none is common.

    Bags are compared within the row: for each distinct common word the smaller of its two counts.
    """
    p, t = (T.words(T.normalize_answer(F.coalesce(F.col(c), F.lit("")))) for c in (predicted, truth))
    times = lambda a, w: F.size(F.filter(a, lambda y: y == w))
    common = T.let(p, lambda a: T.let(t, lambda b: F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, w: s + F.least(times(a, w), times(b, w)))))
    x = pairs.select(key, p.alias("_p"), t.alias("_t"), common.alias("same"))
    precision, recall = F.col("same") / F.greatest(F.size("_p"), F.lit(1)), F.col("same") / F.greatest(F.size("_t"), F.lit(1))
    f1 = F.when(F.col("same") == 0, F.lit(0.0)).otherwise(F.try_divide(2 * precision * recall, precision + recall))
    return x.select(key, (F.array_join("_p", " ") == F.array_join("_t", " ")).cast("int").alias("em"), f1.alias("f1"))


def mean_answers(pairs: DataFrame, key: str, predicted: str, truths: str) -> DataFrame:
    """(exact_match, f1, samples), one row: the best of each answer over its references, in per cent, rounded to two places. Answers without references are left out."""
    one = pairs.select(key, F.col(predicted).alias("answer"), F.posexplode(truths).alias("_i", "truth"))
    scored = answer_metrics(one.withColumn("_k", F.struct(key, "_i")), "_k", "answer", "truth").select(F.col(f"_k.{key}").alias(key), "em", "f1")
    best = scored.groupBy(key).agg(F.max("em").alias("em"), F.max("f1").alias("f1"))
    mean = lambda c: F.round(100 * F.coalesce(F.avg(c), F.lit(0.0)), 2)
    return best.agg(mean("em").alias("exact_match"), mean("f1").alias("f1"), F.count(F.lit(1)).alias("samples"))


def token_accuracy(gold: DataFrame, predicted: DataFrame, sent: str = "sent_id", pos: str = "pos", tag: str = "tag", ignored: str | None = None) -> DataFrame:
    """(tokens, same, accuracy), one row: the share of tokens with the same tag; those whose gold tag is ``ignored`` are left out, a missing prediction is wrong."""
    g = gold.select(sent, pos, F.col(tag).alias("_g"))
    g = g if ignored is None else g.filter(F.col("_g") != ignored)
    both = g.join(predicted.select(sent, pos, F.col(tag).alias("_p")), [sent, pos], "left")
    x = both.agg(F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("_g") == F.col("_p")).alias("same"))
    return x.select("tokens", "same", F.coalesce(F.try_divide("same", "tokens"), F.lit(0.0)).alias("accuracy"))


def metric_deltas(now: DataFrame, before: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by..., delta of each metric): what changed, rounded to two places; rows that only one side has are left out."""
    old = before.select(*by, *(F.col(m).alias(f"_{m}") for m in metrics))
    joined = now.select(*by, *metrics).join(old, by) if by else with_totals(now.select(*metrics), old)
    return joined.select(*by, *(F.round(F.col(m) - F.col(f"_{m}"), 2).alias(m) for m in metrics))
