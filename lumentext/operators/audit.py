"""Audit and repair of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .stats import with_totals


def exact_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, n, first): texts that several records share."""
    return docs.filter(F.col(text).isNotNull()).groupBy(F.md5(text).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).filter("n > 1")


def audit(docs: DataFrame, key: str, title: str, text: str, least: int = V.SHORT_TEXT_CHARS) -> DataFrame:
    """(key, text_chars, title_in_text, warnings): warnings joined by a comma, '' for none. A NULL text counts as empty, a NULL title is in no text.

    Copies are found by an aggregate of digests, joined back: a text that a third of all records share is no hot group, as it is summed before.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    inside = F.coalesce(F.lower(t).contains(F.lower(F.col(title))), F.lit(False))
    d = docs.select(key, F.md5(t).alias("digest"), F.length(t).alias("text_chars"), inside.alias("title_in_text"))
    twice = d.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", F.lit(True).alias("twice"))
    d = d.join(twice, "digest", "left")
    flags = F.array_compact(F.array(F.when(F.col("text_chars") < least, "short_text"), F.when(F.col("twice"), "duplicate_text"), F.when(~F.col("title_in_text"), "title_not_in_text")))
    return d.select(key, "text_chars", "title_in_text", F.array_join(flags, ", ").alias("warnings"))


def flagged(audited: DataFrame, key: str) -> DataFrame:
    return audited.filter(F.col("warnings").isNotNull() & (T.strip(F.col("warnings")) != "")).select(key)


def repaired(docs: DataFrame, key: str, text: str, flagged_keys: DataFrame, replacement: DataFrame, least: int = V.MIN_WIKI_CHARS) -> DataFrame:
    """docs with the text of (key, new_text) where the key is flagged and the new text long enough; state: kept, replaced or failed."""
    f = flagged_keys.select(key).distinct().withColumn("_flag", F.lit(True))
    d = docs.join(f, key, "left").join(replacement.select(key, "new_text"), key, "left")
    good = F.coalesce(F.col("_flag") & (F.length("new_text") >= least), F.lit(False))
    state = F.when(good, "replaced").when(F.col("_flag"), "failed").otherwise("kept")
    return d.withColumn("state", state).withColumn(text, F.when(good, F.col("new_text")).otherwise(F.col(text))).drop("_flag", "new_text")


def consistency(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(only_left, only_right): how many keys of each side the other lacks; one row."""
    sides = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    return sides.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


def one_link_per_domain(links: DataFrame, key: str, url: str, kind: str, most: int = 8) -> DataFrame:
    """(key, url, link_score, place): scored links, the best of each domain, at most ``most`` of each record."""
    from pyspark.sql import Window

    s = links.select(key, F.col(url).alias("url"), T.domain_of(F.col(url)).alias("domain"), T.link_score(F.col(url), F.col(kind)).alias("link_score")).filter("link_score > 0").distinct()
    w = Window.partitionBy(key, "domain").orderBy(F.col("link_score").desc(), "url")
    s = s.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    p = Window.partitionBy(key).orderBy(F.col("link_score").desc(), "url")
    return s.withColumn("place", F.row_number().over(p)).filter(F.col("place") <= most).select(key, "url", "link_score", "place")


def first_usable(external: DataFrame, wiki: DataFrame, key: str, least: int = V.MIN_EXTERNAL_CHARS, least_wiki: int = V.MIN_WIKI_CHARS) -> DataFrame:
    """(key, source_type, source, url, text) of each record: the first external text that is long enough when clean, else the encyclopaedia's, else no row.

    external: (key, place, url, text), tried by place; wiki: (key, url, text), one row a key. Only lengths and places are compared by key, and the text of the chosen row travels with them.
    """
    e = external.select(key, "place", "url", T.clean_citations(F.col("text")).alias("text")).filter(F.length("text") >= least)
    e = e.groupBy(key).agg(F.min_by(F.struct("url", "text"), "place").alias("x"))
    w = wiki.select(key, F.col("url").alias("_url"), F.col("text").alias("_text")).filter(F.length("_text") >= least_wiki)
    both = e.join(w, key, "full")
    out = F.col("x").isNotNull()
    return both.select(
        key, F.when(out, "external").otherwise("wikipedia").alias("source_type"), F.when(out, T.domain_of(F.col("x.url"))).otherwise("Wikipedia").alias("source"),
        F.when(out, F.col("x.url")).otherwise(F.col("_url")).alias("url"), F.when(out, F.col("x.text")).otherwise(F.col("_text")).alias("text"),
    )


def project_status(docs: DataFrame, chunks: DataFrame, vec: str, dim: int) -> DataFrame:
    """(documents, chunks, vectors, other_length), one row: the sizes, and how many vectors are missing or not of length ``dim``."""
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count(vec).alias("vectors"), F.count_if(F.coalesce(F.size(vec), F.lit(-1)) != dim).alias("other_length"))
    return with_totals(docs.agg(F.count(F.lit(1)).alias("documents")), c)
