"""Training features of token models: windows with answer positions, subword labels, and decoding. The tokenizer is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def token_offsets(c: Column) -> Column:
    """Words of a text, split at white space, with their first character and the one after their last: the tokenizer where none is given."""
    tokens = F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))
    blanks = F.regexp_extract_all(c, F.lit(r"(?:^\s*|\s+)(?=\S)"), F.lit(0))
    lengths = F.zip_with(tokens, blanks, lambda t, x: F.length(t) + F.length(x))
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    token = lambda t, end: F.struct(t.alias("token"), (end - F.length(t)).alias("start"), end.alias("end"))
    return F.zip_with(tokens, F.slice(ends, 2, F.size(ends)), token)


def qa_features(df: DataFrame, key: str, question: str, context: str, answer_start: str, answer: str, tokens=token_offsets, max_length: int = 384, stride: int = 128) -> DataFrame:
    """(key, window, first, n, start_position, end_position): overlapping windows of context tokens after the question, and the answer's tokens in each.

    A window has what ``max_length`` leaves after the question's tokens and three special ones; the next begins ``stride`` tokens before its end.
    Positions count from the special token before the question, which is also the position of an answer that is not wholly in the window, or of none
    (NULL). NULL contexts have no windows. tokens: text to (token, start, end) with ends exclusive.
    """
    x = df.select(key, F.size(tokens(F.trim(question))).alias("nq"), tokens(F.col(context)).alias("ts"), F.col(answer_start).cast("int").alias("a"), (F.col(answer_start) + F.length(answer)).cast("int").alias("b")).filter("ts is not null")
    room = F.greatest(F.lit(max_length) - F.col("nq") - 3, F.lit(stride + 1))
    x = x.withColumn("room", room).withColumn("steps", F.greatest(F.ceil((F.size("ts") - F.col("room")) / (F.col("room") - stride)), F.lit(0)).cast("int"))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.col("steps"))).alias("window"))
    x = x.withColumn("first", (F.col("window") * (F.col("room") - stride)).cast("int")).withColumn("part", F.slice("ts", F.col("first") + 1, F.col("room")))
    inside = (F.element_at("part", 1)["start"] <= F.col("a")) & (F.element_at("part", -1)["end"] >= F.col("b"))
    # the last token that begins no later than the answer, and the first that ends no sooner
    begin = F.size(F.filter("part", lambda t: t["start"] <= F.col("a"))) - 1
    end = F.size(F.filter("part", lambda t: t["end"] < F.col("b")))
    at = lambda p: F.when((F.size("part") > 0) & F.coalesce(inside, F.lit(False)), p + F.col("nq") + 2).otherwise(0)
    return x.select(key, "window", "first", F.size("part").alias("n"), at(begin).cast("int").alias("start_position"), at(end).cast("int").alias("end_position"))


def argmax_span(df: DataFrame, key: str, starts: str, ends: str) -> DataFrame:
    """(key, span_start, span_end): the highest start and end, the end moved to the start if it is before it. Ties: the first. Empty arrays give NULL."""
    top = lambda c: (F.array_position(c, F.array_max(c)) - 1).cast("int")
    return df.select(key, top(starts).alias("span_start"), F.greatest(top(starts), top(ends)).alias("span_end"))


def label_ids(tags: DataFrame, tag: str) -> DataFrame:
    """(label, id): the distinct labels numbered in their order; there are few."""
    labels = tags.filter(F.col(tag).isNotNull()).agg(F.array_sort(F.collect_set(tag)).alias("ls"))
    return labels.select(F.posexplode("ls").alias("id", "label")).select("label", "id")


def encoded_words(df: DataFrame, key: str, words: str, labels: str, pieces, most: int = 512) -> DataFrame:
    """(key, pieces, labels): words cut into pieces by ``pieces`` (a word to its list), the first ``most`` of them, and a label for each: the word's first piece has its label."""
    cut = F.transform(F.col(words), pieces)
    ids = F.flatten(F.transform(cut, lambda p, i: F.array_repeat(i, F.size(p))))
    x = df.select(key, F.slice(F.flatten(cut), 1, most).alias("pieces"), F.slice(ids, 1, most).alias("_ids"), F.col(labels).alias("_labels"))
    return x.select(key, "pieces", T.align_labels(F.col("_labels"), F.col("_ids")).alias("labels"))
