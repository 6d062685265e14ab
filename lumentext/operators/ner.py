"""Tagged tokens, spans, their metrics, and entity lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def iob_spans(tagged: DataFrame, sent: str = "sent_id", pos: str = "pos", tag: str = "tag") -> DataFrame:
    """(sent, start, end, label) of IOB tags: a span starts at a B-, or at an I- that continues no span of its label; end exclusive."""
    w = Window.partitionBy(sent).orderBy(pos)
    label = F.when(F.col(tag) != "O", F.substring(F.col(tag), 3, 1 << 20))
    before = F.lag(label).over(w)
    start = label.isNotNull() & (F.col(tag).startswith("B-") | ~F.equal_null(label, before))
    t = tagged.select(sent, pos, tag).withColumn("label", label).withColumn("new", start.cast("int"))
    t = t.withColumn("span", F.sum("new").over(w)).filter("label is not null")
    return t.groupBy(sent, "span").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.first("label").alias("label")).drop("span")


def span_metrics(gold: DataFrame, predicted: DataFrame, sent: str = "sent_id") -> DataFrame:
    """(label, n_gold, n_predicted, n_same, precision, recall, f1) of each label and, as NULL, of all; 0 where nothing can be divided."""
    on = [sent, "start", "end", "label"]
    parts = [gold.select("label", F.lit(1).alias("g"), F.lit(0).alias("p"), F.lit(0).alias("s")), predicted.select("label", F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("s")), gold.join(predicted.select(*on), on, "left_semi").select("label", F.lit(0).alias("g"), F.lit(0).alias("p"), F.lit(1).alias("s"))]
    n = parts[0].unionByName(parts[1]).unionByName(parts[2]).rollup("label").agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_predicted"), F.sum("s").alias("n_same"))
    p = F.coalesce(F.try_divide("n_same", "n_predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("n_same", "n_gold"), F.lit(0.0))
    return n.select("label", "n_gold", "n_predicted", "n_same", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def filtered_entities(entities: DataFrame, source: str = "source_id", label: str = "label", text: str = "text", count: str = "count", order: str | None = None, top: int = 15) -> DataFrame:
    """(source, label, text, count, place): clean entities of the allowed labels, one for each spelling without case, the first ``top`` of each label.

    Which of several spellings stays: the first by ``order`` (a column), else the highest count, then the smaller label and text. Counts aren't added.
    """
    e = entities.select(source, F.col(label).alias("old_label"), T.entity_text(F.col(text)).alias("text"), F.col(count).alias("count"), *([F.col(order).alias("_o")] if order else []))
    e = e.filter(T.is_clean_entity(F.col("text")) & ~F.col("text").isin(V.ENTITY_STOP)).withColumn("label", T.entity_label(F.col("old_label"), F.col("text"))).filter(F.col("label").isin(V.ENTITY_LABELS))
    first = [F.col("_o")] if order else [F.col("count").desc_nulls_last(), "old_label", "text"]
    w = Window.partitionBy(source, "label", F.lower("text")).orderBy(*first)
    e = e.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    best = Window.partitionBy(source, "label").orderBy(F.col("count").desc_nulls_last(), F.lower("text"))
    return e.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top).select(source, "label", "text", "count", "place")
