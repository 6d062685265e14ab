"""One ranking from several differently scaled scores: robust rank aggregation."""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, table


def beta_order_p(r: Column, k: int, n: int) -> Column:
    """Probability that the k-th smallest of n uniform ranks is at most r: the Beta(k, n - k + 1) distribution."""
    terms = [F.lit(float(comb(n, j))) * F.pow(r, F.lit(j)) * F.pow(F.lit(1.0) - r, F.lit(n - j)) for j in range(k, n + 1)]
    return reduce(lambda a, b: a + b, terms)


def normalised_ranks(long: DataFrame, group: str) -> DataFrame:
    """(group, metric, score) to (group, metric, score, r): the mean rank of the score, best first, over the group's size.

    Ranks come from a range-partitioned sort: equal scores are counted first, each range sums its own counts, and the
    sums of the ranges before it are added, so that a group of any size is spread over all tasks.
    """
    counted = long.groupBy(group, "metric", "score").agg(F.count(F.lit(1)).alias("n"))
    ranged = materialize(
        counted.repartitionByRange(group, "metric", F.col("score").desc()).withColumn("part", F.spark_partition_id()), "ranks"
    )
    by_part = ranged.groupBy(group, "metric", "part").agg(F.sum("n").alias("in_part"))
    w = Window.partitionBy(group, "metric")
    before = w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select(group, "metric", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("off"), F.sum("in_part").over(w).alias("size"))
    upto = Window.partitionBy(group, "metric", "part").orderBy(F.col("score").desc())
    return (
        ranged.withColumn("upto", F.sum("n").over(upto))
        .join(offsets, [group, "metric", "part"])
        .select(group, "metric", "score", ((F.col("off") + F.col("upto") - (F.col("n") - 1) / 2.0) / F.col("size")).alias("r"))
    )


def latest_rows(df: DataFrame, keys: list[str], scores: list[str], at: str) -> DataFrame:
    """For each key the row with the latest ``at``; among equal times the one with the higher scores, in their order."""
    order = F.struct(F.col(at), *scores)
    return df.groupBy(*keys).agg(F.max(order).alias("_m")).select(*keys, *(F.col(f"_m.{s}").alias(s) for s in scores))


def robust_ranks(df: DataFrame, group: str, item: str, scores: list[str], at: str) -> DataFrame:
    """(group, item, rho, place): items of each group by their corrected smallest order-statistic probability.

    A NULL or NaN score counts as the group's lowest of that score; where a group has none at all, the score says nothing
    and all its items tie. Ties in rho fall to the mean rank, then the smaller item. Rows with a NULL group or item are
    left out; repeated rows count once. No rows give no rows.
    """
    clean = df.select(group, item, at, *(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")).alias(s) for s in scores))
    rows = materialize(latest_rows(clean.filter(F.col(group).isNotNull() & F.col(item).isNotNull()), [group, item], scores, at), "latest")
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("metric"), F.col(s).alias("score")) for i, s in enumerate(scores)))).alias("x")
    long = rows.select(group, item, pairs).select(group, item, "x.metric", "x.score")
    lowest = long.groupBy(group, "metric").agg(F.coalesce(F.min("score"), F.lit(0.0)).alias("low"))
    long = long.join(lowest, [group, "metric"]).select(group, item, "metric", F.coalesce("score", "low").alias("score"))
    ranks = long.join(normalised_ranks(long, group), [group, "metric", "score"])
    n = len(scores)
    by_item = ranks.groupBy(group, item).agg(F.array_sort(F.collect_list("r")).alias("r"))
    ps = [beta_order_p(F.col("r")[k - 1], k, n) for k in range(1, n + 1)]
    rho = F.round(F.least(F.lit(1.0), F.least(*ps) * n), 12)
    mean = F.round(F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / n, 12)
    return by_item.select(group, item, rho.alias("rho"), mean.alias("mean_rank"))


SCORES = ["bm25_score", "sbert_score", "qa_score", "retrieval_score"]


def p5_ranks(spark, d: str) -> DataFrame:
    """Every candidate of every question with its significance and mean normalised rank."""
    return robust_ranks(table(spark, d, "answer_question"), "question_id", "chunk_id", SCORES, "scored_at")


def p5_found(spark, d: str, top: int = 3) -> DataFrame:
    w = Window.partitionBy("question_id").orderBy("rho", "mean_rank", "chunk_id")
    return p5_ranks(spark, d).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("question_id", "chunk_id")
