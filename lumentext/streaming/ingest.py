"""The same transforms over files as they arrive. Delivery only: results equal those of a batch over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def arriving(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """Parquet files of a folder, at most ``files`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def counted_terms(stream: DataFrame, text: str, at: str, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(window, term, n): terms by time window; rows later than the watermark are left out."""
    rows = stream.withWatermark(at, late).select(at, F.explode(T.tokens_b(F.col(text))).alias("term"))
    return rows.groupBy(F.window(at, window), "term").agg(F.count(F.lit(1)).alias("n"))


def flagged_rows(stream: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(key, text_chars, warnings): the audit's flags that need no other rows."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    return stream.select(key, n.alias("text_chars"), F.when(n < least, "short_text").otherwise("").alias("warnings"))


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that has arrived, once, to Parquet; exactly once by the checkpoint, which lies in a shared folder."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
