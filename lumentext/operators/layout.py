"""Positional text fragments to lines, and lines to the entries of a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The crop, the middle of the page, and how far fragments of one line may differ.
TOP_MIN, TOP_MAX, COLUMN_AT, SAME_LINE, HEADER_REACH = 90, 840, 330, 2, 30
# Word classes, languages, and marks that belong to the item before them.
CLASSES, LANGUAGES = "m f a s loc pl sb sg".split(), "es en pt la".split()
MARKS = r"^(?:\[(?:Br\.|Pt\.|Am\.|EUA|pop\.|fig\.|pej\.|cult\.|arc\.|col\.)\]|\((?:sg|pl|sb|sg\.)\))$"
CONNECTIVES = r"(?i)^(?:de|do|da|dos|das|e|em|en|a|o|as|os)\b"


def reconstruct_lines(fragments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, page, col, line_no, top, left, text, bold, italic) of fragments (doc, page, top, left, txt, bold, italic).

    In each half of a page fragments are taken by top, then left; one more than SAME_LINE below its line's first starts a line. As each
    line depends on where the one before began, a fold over the sorted fragments of one column decides; a page bounds it.
    Fragments outside the crop and blank ones are left out; a NULL position counts as outside.
    """
    f = fragments.filter(F.col("top").between(TOP_MIN, TOP_MAX) & (T.norm_spaces(F.col("txt")) != ""))
    f = f.withColumn("col", (F.col("left") >= COLUMN_AT).cast("int"))
    frag = F.struct("top", "left", F.col("txt").alias("txt"), "bold", "italic")
    pages = f.groupBy(doc, "page", "col").agg(F.array_sort(F.collect_list(frag)).alias("fs"))
    empty = F.array().cast("array<struct<top:int,left:int,parts:array<string>,bold:boolean,italic:boolean>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        fresh = F.struct(x["top"].cast("int").alias("top"), x["left"].cast("int").alias("left"), F.array(x["txt"]).alias("parts"), F.coalesce(x["bold"], F.lit(False)).alias("bold"), F.coalesce(x["italic"], F.lit(False)).alias("italic"))
        more = F.struct(last["top"].alias("top"), last["left"].alias("left"), F.concat(last["parts"], F.array(x["txt"])).alias("parts"), (last["bold"] | F.coalesce(x["bold"], F.lit(False))).alias("bold"), (last["italic"] | F.coalesce(x["italic"], F.lit(False))).alias("italic"))
        new = (F.size(acc) == 0) | (F.abs(x["top"] - last["top"]) > SAME_LINE)
        return F.when(new, F.concat(acc, F.array(fresh))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more)))

    rows = pages.select(doc, "page", "col", F.posexplode(F.aggregate("fs", empty, step)).alias("line_no", "l"))
    return rows.select(doc, "page", "col", "line_no", "l.top", "l.left", T.norm_spaces(T.smart_join(F.transform("l.parts", T.norm_spaces))).alias("text"), "l.bold", "l.italic")


def header(line: Column) -> Column:
    """struct(id, ga, pos) of '12 term m'; NULL for another line, pos NULL without a class."""
    rest = T.norm_spaces(F.regexp_extract(line, r"^\s*\d+\s+(.*)$", 1))
    last = F.element_at(F.split(rest, " "), -1)
    named = last.isin(CLASSES)
    ga = F.when(named, T.strip(F.regexp_replace(rest, r"\S+$", ""))).otherwise(rest)
    made = F.struct(F.regexp_extract(line, r"^\s*(\d+)", 1).alias("id"), ga.alias("ga"), F.when(named, last).alias("pos"))
    return F.when(T.has(line, r"^\s*\d+\s+.*$"), made)


def looks_like_header(line: Column) -> Column:
    return T.has(T.norm_spaces(line), rf"^\d+\s+.+\s+(?:{'|'.join(CLASSES)})$")


def vid_targets(line: Column) -> Column:
    """Targets of every Vid. up to the next semicolon."""
    return F.filter(F.transform(F.regexp_extract_all(line, F.lit(r"(?i)\bVid\.?-?\s*([^;]+)"), F.lit(1)), T.norm_spaces), lambda x: x != "")


def without_vid(line: Column) -> Column:
    return T.norm_spaces(T.sub(line, r"(?i)\bVid\.?-?\s*[^;]+", " "))


def is_continuation(line: Column) -> Column:
    s = T.norm_spaces(line)
    return (s != "") & (T.has(s, MARKS) | T.has(s, r"^[\[(,.:]") | T.has(s, CONNECTIVES) | (T.has(s, r"^\p{Ll}") & (F.length(s) <= 40)))


def glued(items: Column) -> Column:
    """Items with marks such as [Br.] or (sg) joined to the item before."""
    step = lambda a, x: F.when(T.has(x, MARKS) & (F.size(a) > 0), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(F.element_at(a, -1), F.lit(" "), x)))).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(items, F.array().cast("array<string>"), step)


def entries(lines: DataFrame, doc: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Entries (doc, id, ga, pos, dom, sin, var, nota, trad, see), absent parts NULL, and cross-references (doc, source, target).

    lines: (doc, page, col, line_no, text, bold, italic). A numbered bold line, or one that ends with a class, starts an entry; a line within
    HEADER_REACH below it that is a class, or ends with one, completes it. Each other line belongs to the field last begun: a marked one, a language's, or the
    domain for italics. Of entries with one id the last stays.
    """
    order = ["page", "col", "line_no"]
    w = Window.partitionBy(doc).orderBy(*order)
    s = T.norm_spaces(F.col("text"))
    lang = F.regexp_extract(s, rf"^({'|'.join(LANGUAGES)})\s+\S", 1)
    lines = lines.withColumn("s", s).filter("s <> ''").withColumn("h", F.when(F.coalesce("bold", F.lit(False)) | looks_like_header(F.col("text")), header(s)))
    lines = lines.withColumn("entry", F.sum(F.col("h").isNotNull().cast("int")).over(w))
    mine = Window.partitionBy(doc, "entry").orderBy(*order)
    field = (
        F.when(F.col("h").isNotNull(), "head").when(F.col("s").startswith("SIN.-"), "sin").when(F.col("s").startswith("VAR.-"), "var").when(F.col("s").startswith("Nota.-"), "nota")
        .when(lang != "", F.concat(F.lit("trad "), lang)).when(F.coalesce("italic", F.lit(False)), "dom")
    )
    top = F.first(F.when(F.col("h").isNotNull(), F.col("top")), ignorenulls=True).over(mine.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if "top" in lines.columns else F.lit(0)
    close = (F.coalesce(F.col("top"), F.lit(0)) - top <= HEADER_REACH) if "top" in lines.columns else F.lit(True)
    ends = T.has(F.col("s"), rf"^(?:(?!\d).+\s+)?(?:{'|'.join(CLASSES)})$")
    lines = lines.withColumn("f", F.when(field.isNull() & (F.lag("h").over(mine).isNotNull()) & F.lag("h.pos").over(mine).isNull() & close & ends, "head").otherwise(field))
    lines = lines.withColumn("field", F.last("f", ignorenulls=True).over(mine))
    bare = T.norm_spaces(F.regexp_replace("s", rf"^(?:SIN\.-|VAR\.-|Nota\.-|(?:{'|'.join(LANGUAGES)})\s+)", ""))
    lines = lines.withColumn("see", vid_targets(F.col("s"))).withColumn("bare", F.when(F.col("field") == "nota", bare).otherwise(without_vid(bare)))
    by = lines.filter("entry > 0").groupBy(doc, "entry").agg(F.array_sort(F.collect_list(F.struct(*order, "field", "h", "bare", "see", F.col("f").isNotNull().alias("new")))).alias("ls"))
    part = lambda name: F.filter("ls", lambda x: x["field"] == name)
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: x["bare"]), " ")
    items = lambda xs: F.nullif(glued(T.split_semicolons(joined(xs))), F.array().cast("array<string>"))
    extra = joined(F.filter("ls", lambda x: (x["field"] == "head") & x["h"].isNull()))
    hd = F.get(F.filter("ls", lambda x: x["h"].isNotNull()), F.lit(0))["h"]
    full = T.norm_spaces(F.concat_ws(" ", hd["ga"], extra))
    last = F.element_at(F.split(full, " "), -1)
    pos = F.coalesce(hd["pos"], F.when(last.isin(CLASSES), last))
    ga = F.when(hd["pos"].isNull() & last.isin(CLASSES), T.strip(F.regexp_replace(full, r"\S+$", ""))).otherwise(full)
    trad = F.map_from_arrays(F.array(*map(F.lit, LANGUAGES)), F.array(*(F.coalesce(items(part(f"trad {x}")), F.array().cast("array<string>")) for x in LANGUAGES)))
    trad = F.map_filter(trad, lambda k, v: F.size(v) > 0)
    dom = F.nullif(T.dedup_list(F.flatten(F.transform(part("dom"), lambda x: F.split(x["bare"], r"\s{2,}")))), F.array().cast("array<string>"))
    see = F.nullif(T.dedup_list(F.flatten(F.transform("ls", lambda x: x["see"]))), F.array().cast("array<string>"))
    out = by.select(doc, "entry", hd["id"].alias("id"), ga.alias("ga"), pos.alias("pos"), dom.alias("dom"), items(part("sin")).alias("sin"), items(part("var")).alias("var"), F.nullif(joined(part("nota")), F.lit("")).alias("nota"), F.when(F.size(trad) > 0, trad).alias("trad"), see.alias("see"))
    out = out.withColumn("_n", F.row_number().over(Window.partitionBy(doc, "id").orderBy(F.col("entry").desc()))).filter("_n = 1").drop("_n", "entry")
    refs = lines.filter("entry = 0 and size(see) > 0 and bare <> ''").select(doc, F.col("bare").alias("source"), F.element_at("see", -1).alias("target"), F.struct(*order).alias("o"))
    return out, refs.groupBy(doc, "source").agg(F.max_by("target", "o").alias("target"))
