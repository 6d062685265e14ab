"""Main content of pages: templates of their site are found by the elements that recur on its pages, and removed.

The elements of a line, hashed, are its head and, for menus, its parts, with numbers, names and the site's own name
made alike. For each element Spark counts the pages of its host, and of all hosts, that hold it, and on how many of them
before or after the article. Recurring elements that stand there often enough belong to the template. Headings recur, too, but
within the article; sentences recur, but more often within its paragraphs. All bounds are shares, as values recur by chance
on more pages the more pages there are; names are not counted over hosts.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, skew_join, small, spread, table

PARTS = regex.compile(r"\s*(?:[>»|·/•→]+|\s{2,})\s*")
SENTENCE_END = regex.compile(r"(?<!(?<!\d)\d{1,2}\.)(?<=[.!?…][\"”»“]?)\s+(?=\S)")
ENDS = regex.compile(r"[.!?…][\"”»“)]*$")
NUMBER = regex.compile(r"\d+(?:[.,:]\d+)*")
#: Lines from this many characters on that end as a sentence does are taken as the article's unless they recur on its host.
LONG = 110
SHORT_LINE, LONG_LINE, WITHIN = 0, 1, 2


#: A person's or other full name, with a label before it or not.
NAME = regex.compile(r"(?:[^:]{1,30}:\s*)?\p{Lu}[\p{Ll}'’-]+(?:\s+(?:\p{Lu}\.|(?:\p{Lu}\p{Ll}*['’-]?)?\p{Lu}[\p{Ll}'’-]+|d[aeo]s?|v[ao]n|de[lr]?)){0,3}\s+(?:\p{Lu}\p{Ll}*['’-]?)?\p{Lu}[\p{Ll}'’-]+")


def _plain(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c))


def _hash(kind: str, what: str) -> int:
    """An odd number if kind is of names."""
    return _digest(kind, what) & ~1 | kind.endswith("name")


def _digest(kind: str, what: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind}\0{what}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _masked(words: list[str], host: str, first: bool) -> list[str]:
    out = []
    for i, w in enumerate(words):
        core = w.strip(".,:;!?\"“”«»()")
        if any(c.isdigit() for c in w):
            out.append(NUMBER.sub("#", w))
        elif core and (core.lower() == host or (core[0].isupper() or "." in core) and _plain(core).split(".")[0] == host.split(".")[0]):
            out.append("@")
        elif core[:1].isupper() and not (first and i == 0):
            out.append("N" + w[-1:] if w[-1:] in ".:," else "N")
        else:
            out.append(w.lower())
    return out


def head(words: list[str], host: str) -> str:
    """The first three words, or less up to a colon."""
    m = _masked(words[:4], host, True)
    for i, w in enumerate(m):
        if w.endswith(":"):
            return " ".join(m[: i + 1])
    return " ".join(m[:3])


def elements(line: str, words: list[str], host: str) -> tuple[int, list[int]]:
    """(head, parts): a line is of the template if its head is, or half of its parts."""
    parts = [p for p in PARTS.split(line) if p]
    if len(parts) < 2:
        parts = words if len(words) > 2 and not ENDS.search(line) and all(w.isalpha() for w in words) else []
    named = [bool(NAME.fullmatch(p)) for p in (parts if len(parts) > 1 else line.split(","))]
    kind = "head of a name" if len(named) > 1 and all(named) else "head"
    return _hash(kind, head(words, host)), [_hash("name" if NAME.fullmatch(p) else "part", NUMBER.sub("#", p.lower())) for p in parts]


def line_elements(pages: DataFrame) -> DataFrame:
    """(page, host) and, of each line: kind, no, head, parts, and whole if it ends as a sentence does; for sentences within long lines: head and how many.

    pages: (page long, host string, text string).
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page, host_id, kind, no, heads, parts, whole = [], [], [], [], [], [], []
            within: Counter = Counter()
            for p, host, text in zip(*(c.to_pylist() for c in b.columns)):
                hid = _hash("host", host)
                for i, raw in enumerate((text or "").split("\n")):
                    line = raw.strip()
                    if not line:
                        continue
                    if len(line) >= LONG and ENDS.search(line):
                        k, h, q = LONG_LINE, _hash("line", line), []
                        for x in SENTENCE_END.split(line):
                            within[_hash("head", head(x.split(None, 4)[:4], host))] += 1
                    else:
                        k, (h, q) = SHORT_LINE, elements(line, line.split(), host)
                    page.append(p), host_id.append(hid), kind.append(k), no.append(i), heads.append(h), parts.append(q)
                    whole.append(_hash("line", line) if k == SHORT_LINE and ENDS.search(line) else None)
            n = len(within)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(page + [0] * n, pa.int64()), pa.array(host_id + [0] * n, pa.int64()), pa.array(kind + [WITHIN] * n, pa.int32()), pa.array(no + list(within.values()), pa.int32()),
                    pa.array(heads + list(within), pa.int64()), pa.array(parts + [[]] * n, pa.list_(pa.int64())), pa.array(whole + [None] * n, pa.int64()),
                ],
                names=["page", "host", "kind", "no", "head", "parts", "whole"],
            )

    return pages.select("page", "host", "text").mapInArrow(go, "page long, host long, kind int, no int, head long, parts array<long>, whole long")


def recurring_long(lines: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    """(host, head): long lines on ``least_share`` of the pages of their host, and on ``least_pages``, whose articles differ.

    Copies of an article share its other long lines, too, so a page counts as the mean of 1 / pages of its other long lines.
    """
    per = lines.filter(F.col("kind") == LONG_LINE).select("page", "host", "head").distinct()
    sizes = lines.filter(F.col("kind") != WITHIN).select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    counts = materialize(per.groupBy("host", "head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "long")
    often = lambda c: (F.col(c) >= least_pages) & (F.col(c) >= least_share * F.col("size"))
    some = counts.join(sizes, "host").filter(often("n")).select("host", "head", "size")
    pages = per.join(some.select("host", "head"), ["host", "head"], "left_semi").select("page").distinct()
    near = per.join(pages, "page", "left_semi").join(counts, ["host", "head"], "left").withColumn("w", 1 / F.coalesce("n", F.lit(1)))
    of_page = near.groupBy("page").agg(F.sum("w").alias("all"), F.count(F.lit(1)).alias("k"))
    own = near.join(some, ["host", "head"]).join(of_page.filter("k > 1"), "page")
    return own.groupBy("host", "head").agg(F.sum((F.col("all") - F.col("w")) / (F.col("k") - 1)).alias("articles"), F.max("size").alias("size")).filter(often("articles")).select("host", "head")


def with_marks(rows: DataFrame, keyed: DataFrame, key: str, counts: DataFrame, how: str = "inner", most: int = 1_000_000) -> DataFrame:
    """``rows`` joined with ``keyed``, one row a key and written: broadcast if it has at most ``most`` rows, else shuffled with the hot keys of ``counts`` (key, n) dealt to several tasks."""
    held = small(keyed, most)
    return rows.join(held, key, how) if held is not keyed else skew_join(rows, keyed, key, counts, how=how)


def template_lines(pages: DataFrame, least_pages: int = 3, least_share: float = 0.02, pooled_share: float = 0.002, edge: float = 0.5, least_varied: int = 8) -> DataFrame:
    """(page, no): the non-blank lines of each page that belong to the template of its site.

    An element is of the template if it is on ``least_share`` of the pages of its host, or recurs on ``pooled_share`` of those of
    all hosts that have it (the first page of each host is no recurrence), on ``least_pages`` in any case, and on at least ``edge``
    of those pages before or after the article. Where it is not so over all hosts, its own host must show it beyond chance, by two
    standard errors. A line that ends as a sentence does is known by all of it, too; by its head alone only from ``least_varied`` pages on, as
    articles may begin or end alike. A long line is held to twice ``least_pages`` and ``least_share``, on pages of different articles. NULL and blank texts have no lines; a page
    without an article is judged by the elements that others show to be of the template. Repeated pages are joined: their
    lines come once. No rows give no rows. A hot host costs nothing: counts are summed by element before they are shuffled.
    """
    lines = materialize(line_elements(pages), "lines")
    short, within = F.col("kind") == SHORT_LINE, F.col("kind") == WITHIN
    heads = lines.filter(F.col("kind") != LONG_LINE).groupBy("head").agg(F.sum(F.when(within, F.col("no")).otherwise(0)).alias("inside"), F.sum(short.cast("int")).alias("alone"))
    heads = materialize(heads, "heads")
    prose = heads.filter("inside > alone").select("head", F.lit(True).alias("prose"))
    notices = recurring_long(lines, 2 * least_pages, 2 * least_share).withColumn("notice", F.lit(True))
    flat = with_marks(lines.filter(~within), prose, "head", heads.select("head", F.col("alone").alias("n")), "left").join(notices, ["host", "head"], "left")
    flat = flat.withColumn("article", ((F.col("kind") == LONG_LINE) & F.col("notice").isNull()) | F.coalesce("prose", F.lit(False)))
    zone = flat.filter("article").groupBy("page").agg(F.min("no").alias("first"), F.max("no").alias("last"))
    todo = flat.filter("not article").join(zone, "page", "left")
    at_edge = (F.col("no") < F.col("first")) | (F.col("no") > F.col("last"))
    todo = todo.select("page", "host", "no", "head", F.array_distinct("parts").alias("parts"), "whole", at_edge.alias("edge"))
    own = F.array_compact(F.array("head", "whole"))
    seen = todo.select("page", "host", "edge", (F.col("whole").isNotNull()).alias("sentence"), "head", F.explode(F.concat(own, "parts")).alias("elem"))
    by_page = seen.groupBy("page", "host", "elem").agg(F.max("edge").alias("edge"), F.max(F.col("sentence") & (F.col("elem") == F.col("head"))).alias("varied"))
    by_host = by_page.groupBy("host", "elem").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.col("edge").cast("int")).alias("edges"), F.count("edge").alias("known"), F.sum(F.col("varied").cast("int")).alias("varied"))
    by_host = materialize(by_host, "elements")
    sizes = zone.join(flat.select("page", "host").distinct(), "page").groupBy("host").agg(F.count(F.lit(1)).alias("size"))
    by_host = by_host.join(sizes, "host", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    at_edges = (F.col("edges") >= edge * F.col("known")) & (F.col("known") > 0)
    pooled = by_host.groupBy("elem").agg(*(F.sum(c).alias(c) for c in ("pages", "edges", "known", "size", "varied")), F.count(F.lit(1)).alias("hosts"))
    enough = F.when(2 * F.col("varied") > F.col("pages"), least_varied).otherwise(least_pages)
    pooled = pooled.filter((F.col("pages") >= enough) & at_edges)
    by_chance = edge * F.col("known") + 2 * F.sqrt(edge * (1 - edge) * F.col("known"))
    here = by_host.filter((F.col("pages") >= enough) & (F.col("pages") >= least_share * F.col("size")) & at_edges)
    here = here.join(pooled.select("elem", F.lit(True).alias("_all")), "elem", "left").filter(F.col("_all") | (F.col("edges") >= by_chance))
    recurs = F.col("pages") - F.col("hosts")
    named = F.pmod("elem", F.lit(2)) == 1
    there = by_host.join(pooled.filter((recurs > 0) & (recurs >= pooled_share * F.col("size")) & ~named).select("elem"), "elem", "left_semi")
    mark = F.xxhash64("host", "elem").alias("mark")
    flagged = materialize(here.select(mark).unionByName(there.select(mark)).distinct(), "flagged")
    marks = todo.select("page", "host", "no", F.size("parts").alias("n"), F.explode(F.concat(F.transform(own, lambda x: F.struct(x.alias("elem"), F.lit(True).alias("one"))), F.transform("parts", lambda x: F.struct(x.alias("elem"), F.lit(False).alias("one"))))).alias("x"))
    marks = marks.select("page", "host", "no", "n", "x.elem", "x.one").select("page", "no", "n", "one", mark)
    marks = with_marks(marks, flagged, "mark", by_host.select(mark, F.col("pages").alias("n")))
    found = marks.groupBy("page", "no").agg(F.max("one").alias("one"), F.max("n").alias("n"), F.sum((~F.col("one")).cast("int")).alias("k"))
    return found.filter("one or (n > 1 and 2 * k >= n)").select("page", "no")


#: field -> table, id, text
FIELDS = {"corpus.text": ("corpus", "crawl_id", "text"), "scrapper.descricao": ("scrapper", "rec_id", "descricao")}


def _pages(spark, d: str) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^\w+://(?:www\.)?([^/:?#]+)", 1)), F.lit(""))
    pages = None
    for i, (t, key, text) in enumerate(FIELDS.values()):
        df = spread(table(spark, d, t).select((F.col(key) * len(FIELDS) + i).alias("page"), host.alias("host"), F.col(text).alias("text")).filter("text is not null"))
        pages = df if pages is None else pages.unionByName(df)
    return pages


def _named(df: DataFrame, *cols) -> DataFrame:
    """(field, rec_id, cols...) of rows by page."""
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.pmod("page", F.lit(len(FIELDS))) + 1).cast("int"))
    return df.select(field.alias("field"), F.floor(F.col("page") / len(FIELDS)).cast("long").alias("rec_id"), *cols)


def p2_found(spark, d: str) -> DataFrame:
    return _named(template_lines(_pages(spark, d)), F.col("no").alias("line_no"))


def main_content(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, text) without the lines (page, no), and without the blank lines that are left at the ends."""
    drop = lines.groupBy("page").agg(F.collect_set("no").alias("drop"))
    p = pages.select("page", "text").join(drop, "page", "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.array_contains("drop", i), F.lit(False)))
    return p.select("page", F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "").alias("text"))


def p2_main(spark, d: str) -> DataFrame:
    """The article of every page."""
    pages = _pages(spark, d)
    return _named(main_content(pages, template_lines(pages)), "text")
