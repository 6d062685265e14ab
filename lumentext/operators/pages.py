"""Sections of pages: of HTML by its tags, of plain text by its headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TAGS = r"(?is)<(h1|h2|p|li)\b[^>]*>(.*?)(?=</\1\s*>|<(?:h1|h2|p|li|/ul|/div|/body)\b|$)"
# What a heading says -> its section.
SECTIONS = {"causa": "causas", "sintoma": "sintomas", "tratamento": "tratamento"}


def bare_html(html: Column) -> Column:
    """Without scripts, styles and comments."""
    return T.sub(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->")


def plain(html: Column) -> Column:
    c = T.sub(html, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return T.norm_spaces(c)


def elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, no, tag, text) of headings, paragraphs and list items, in order, blank ones left out."""
    h = bare_html(F.col(html))
    both = F.arrays_zip(F.regexp_extract_all(h, F.lit(TAGS), F.lit(1)).alias("tag"), F.regexp_extract_all(h, F.lit(TAGS), F.lit(2)).alias("inner"))
    return pages.select(key, F.posexplode(both).alias("no", "x")).select(key, "no", F.lower("x.tag").alias("tag"), plain(F.col("x.inner")).alias("text")).filter("text <> ''")


def section_of(heading: Column) -> Column:
    out = F.lit("descricao")
    for part, name in reversed(SECTIONS.items()):
        out = F.when(F.lower(heading).contains(part), F.lit(name)).otherwise(out)
    return out


def sections(rows: DataFrame, key: str, no: str = "no", text: str = "text", is_heading: Column | None = None) -> DataFrame:
    """(key, no, section, text): each row but the headings with the section of the heading before it; unknown headings mean descricao.

    Rows equal to the one before them in their page are dropped. A page's rows are read in order, which its length bounds.
    """
    h = F.col("tag").isin("h1", "h2") if is_heading is None else is_heading
    w = Window.partitionBy(key).orderBy(no)
    r = rows.withColumn("_h", h)
    r = r.withColumn("section", F.coalesce(F.last(F.when(F.col("_h"), section_of(F.col(text))), ignorenulls=True).over(w), F.lit("descricao")))
    r = r.filter("not _h").withColumn("_b", F.lag(text).over(w))
    return r.filter(~F.equal_null(F.col("_b"), F.col(text))).select(key, no, "section", text)


def records(sectioned: DataFrame, key: str, no: str = "no", text: str = "text") -> DataFrame:
    """(key, descricao, causas, sintomas, tratamento): paragraphs of the description joined, the others as lists."""
    items = F.array_sort(F.collect_list(F.struct(F.col(no).alias("n"), F.col("section").alias("s"), F.col(text).alias("t"))))
    g = sectioned.groupBy(key).agg(items.alias("x"))
    of = lambda name: F.transform(F.filter("x", lambda r: r["s"] == name), lambda r: r["t"])
    return g.select(key, F.array_join(of("descricao"), " ").alias("descricao"), *(of(n).alias(n) for n in ("causas", "sintomas", "tratamento")))


def title(rows: DataFrame, key: str, site: list[str]) -> DataFrame:
    """(key, title): the first h1 that is not the site's own name."""
    h = rows.filter((F.col("tag") == "h1") & ~F.lower("text").isin([s.lower() for s in site]))
    return h.groupBy(key).agg(F.min_by("text", "no").alias("title"))


def with_articles(index: DataFrame, articles: DataFrame, url: str, fallback: list[str]) -> DataFrame:
    """Index rows, one for each letter and URL, with the columns of their article; where it lacks, or is blank, those of the index stay."""
    i = index.dropDuplicates(["letra", url])
    a = articles.select(url, *(F.col(c).alias(f"_{c}") for c in fallback))
    return i.join(a, url, "left").select(*(c for c in i.columns if c not in fallback), *(F.coalesce(F.nullif(T.strip(F.col(f"_{c}")), F.lit("")), F.col(c)).alias(c) for c in fallback))
