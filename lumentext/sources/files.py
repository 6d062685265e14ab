"""Readers: each with an explicit schema, so nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

_S = S.StringType()


def _struct(**cols) -> S.StructType:
    return S.StructType([S.StructField(k, v) for k, v in cols.items()])


SOURCES = _struct(id=_S, tipo=_S, url=_S, path=_S, titulo=_S, autor=_S, ano=_S)
SEEDS = _struct(name=_S, wiki_title=_S, type=_S, artist=_S, section=_S)
CORPUS = _struct(doc_id=_S, title=_S, type=_S, section=_S, source_type=_S, source=_S, url=_S, wikipedia_url=_S, text=_S, artist=_S)
CHUNKS = _struct(chunk_id=_S, doc_id=_S, title=_S, type=_S, section=_S, source_type=_S, source=_S, url=_S, chunk_index=S.IntegerType(), text=_S, word_count=S.IntegerType(), artist=_S)
QUERIES = _struct(id=_S, question=_S, filter_type=_S, relevant_doc_ids=S.ArrayType(_S), expected_answer=_S)
FRAGMENTS = _struct(doc_id=_S, page=S.IntegerType(), top=S.IntegerType(), left=S.IntegerType(), txt=_S, bold=S.BooleanType(), italic=S.BooleanType())
ARTICLE = _struct(nome=_S, data=_S, descricao=_S, causas=S.ArrayType(_S), sintomas=S.ArrayType(_S), tratamento=S.ArrayType(_S), url=_S, letra=_S, descricao_pequena=_S)
AUDIT = _struct(doc_id=_S, title=_S, type=_S, section=_S, source_type=_S, source=_S, url=_S, text_chars=S.IntegerType(), title_in_text=S.BooleanType(), warnings=_S)


def json_lines(spark: SparkSession, path: str, schema: S.StructType) -> DataFrame:
    """One object a line; lines that are none give rows of NULL."""
    return spark.read.schema(schema).json(path)


def json_file(spark: SparkSession, path: str, schema: S.StructType) -> DataFrame:
    """A file that is one array or object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_table(spark: SparkSession, path: str, schema: S.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; missing ones are passed over."""
    return spark.read.option("ignoreMissingFiles", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def binary_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files such as PDFs, for a reader given by the caller through mapInArrow."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def joined_pages(pages: DataFrame, key: str, page: str, text: str, by: str = "\n\n") -> DataFrame:
    """(key, text, error): non-blank pages of a document in order; error where all are blank."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    g = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), t.alias("t")))).alias("ps"))
    joined = F.array_join(F.transform(F.filter("ps", lambda x: x["t"] != ""), lambda x: x["t"]), by)
    return g.select(key, joined.alias("text"), F.when(joined == "", "no text").alias("error"))


def iob(spark: SparkSession, path: str) -> DataFrame:
    """(path, sent_id, pos, token, tag) of word and tag, a tab between, and blank lines between sentences."""
    t = whole_texts(spark, path)
    s = t.select("path", F.posexplode(F.filter(F.split(F.trim(F.replace("text", F.lit("\r"), F.lit(""))), r"\n[ \t]*\n\s*"), lambda x: F.trim(x) != "")).alias("sent_id", "s"))
    rows = s.select("path", "sent_id", F.posexplode(F.filter(F.split("s", "\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    parts = F.split("line", "\t")
    return rows.select("path", "sent_id", "pos", F.get(parts, F.lit(0)).alias("token"), F.trim(F.get(parts, F.lit(1))).alias("tag"))


def layout_xml(spark: SparkSession, path: str) -> DataFrame:
    """Fragments of <page number><text top left>..</text></page>: the text with all that is nested, bold or italic by its direct <b> or <i>.

    The order of nested parts matters, so pages are read as text and their elements taken by pattern, not by a row tag.
    """
    t = whole_texts(spark, path)
    page = r"(?s)<page\b([^>]*)>(.*?)</page>"
    p = t.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(page), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(page), F.lit(2)).alias("b"))).alias("p"))
    item = r"(?s)<text\b([^>]*)>(.*?)</text>"
    f = p.select("path", F.regexp_extract("p.a", r'number="(\d+)"', 1).cast("int").alias("page"), F.explode(F.arrays_zip(F.regexp_extract_all("p.b", F.lit(item), F.lit(1)).alias("a"), F.regexp_extract_all("p.b", F.lit(item), F.lit(2)).alias("b"))).alias("t"))
    inner = F.regexp_replace("t.b", r"<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        inner = F.replace(inner, F.lit(a), F.lit(b))
    at = lambda name: F.regexp_extract("t.a", rf'\b{name}="(-?\d+)"', 1).cast("int")
    return f.select(F.col("path").alias("doc_id"), "page", at("top").alias("top"), at("left").alias("left"), inner.alias("txt"), F.col("t.b").contains("<b>").alias("bold"), F.col("t.b").contains("<i>").alias("italic"))


def seeds_yaml(spark: SparkSession, text: str) -> DataFrame:
    """Seeds of a small YAML file: sections of lists of flat mappings, or of mappings by title; a configuration, parsed on the driver."""
    import yaml

    listed = lambda seeds: [{"name": k, "wiki_title": k, **(v or {})} for k, v in seeds.items()] if isinstance(seeds, dict) else seeds or ()
    rows = [{**{k: None for k in SEEDS.names}, **seed, "section": section} for section, seeds in (yaml.safe_load(text) or {}).items() for seed in listed(seeds)]
    return spark.createDataFrame([tuple(r.get(k) for k in SEEDS.names) for r in rows], SEEDS)


def checked_sources(df: DataFrame) -> DataFrame:
    """Source descriptors with an error: an unknown kind, or no url or path where the kind wants one."""
    return df.withColumn("error", F.when(~F.coalesce(F.col("tipo").isin("web", "pdf"), F.lit(False)), "unknown kind").when((F.col("tipo") == "web") & F.col("url").isNull(), "no url").when((F.col("tipo") == "pdf") & F.col("path").isNull(), "no path"))


def paged(keys: DataFrame, key: str, make: Callable[[], Callable[[str, str | None], tuple[list[str], str | None]]], most: int = 100) -> DataFrame:
    """(key, item, error): what a service lists page by page for each key, in its order. make gives, on the worker, a function of (key, token) to (items, next token), None on the last page.

    A NULL key lists nothing. A key whose pages fail keeps what came before and has a row with the error; more than ``most`` pages are an error, too.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = None
        for b in batches:
            rows = []
            for k in b.column(0).to_pylist():
                fetch, token, pages = fetch or make(), None, 0
                try:
                    while True:
                        items, token = fetch(k, token)
                        rows += [(k, x, None) for x in items]
                        pages += 1
                        if token is None:
                            break
                        if pages == most:
                            raise RuntimeError(f"more than {most} pages")
                except Exception as e:  # noqa: BLE001
                    rows.append((k, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=[key, "item", "error"])

    return keys.select(F.col(key).cast("string").alias(key)).filter(F.col(key).isNotNull()).mapInArrow(go, f"{key} string, item string, error string")


def question_sets(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, context, question, answer_starts, answers) of question-answer files in the nested JSON of data, paragraphs and qas."""
    answer = "array<struct<text:string,answer_start:int>>"
    schema = f"data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:{answer}>>>>>>"
    d = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("data").alias("d"))
    p = d.select("d.title", F.explode("d.paragraphs").alias("p")).select("title", "p.context", F.explode("p.qas").alias("q"))
    return p.select("q.id", "title", "context", "q.question", F.col("q.answers.answer_start").alias("answer_starts"), F.col("q.answers.text").alias("answers"))
