"""Writers, and rows rendered as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True, escape='"')


def write_text(df: DataFrame, text: str, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col(text).cast("string")).write.mode(mode).text(path)


def write_vectors(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Vectors keyed by id; nothing is aligned by position."""
    df.write.mode(mode).parquet(path)


def as_json(df: DataFrame, *keep: str) -> DataFrame:
    """(keep..., json): each row as one object."""
    return df.select(*keep, F.to_json(F.struct("*")).alias("json"))


def entity_report(entities: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, report): label -> list of (text, count), in their order."""
    g = entities.groupBy(source, "label").agg(F.array_sort(F.collect_list(F.struct("place", "text", "count"))).alias("es"))
    g = g.select(source, F.struct("label", F.transform("es", lambda e: F.struct(e["text"].alias("text"), e["count"].alias("count"))).alias("es")).alias("kv"))
    return g.groupBy(source).agg(F.map_from_entries(F.array_sort(F.collect_list("kv"))).alias("report"))


def metrics_markdown(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
    """(line): rows of a Markdown table, the heading first; for a table of metrics, a few rows."""
    line = F.format_string("| %s |" + " %.4f |" * len(cols), F.col(name), *(F.col(c).cast("double") for c in cols))
    head = ["| | " + " | ".join(cols) + " |", "|---" * (len(cols) + 1) + "|"]
    rows = df.select(F.lit(1).alias("o"), F.col(name).alias("n"), line.alias("line"))
    top = df.sparkSession.createDataFrame([(0, str(i), h) for i, h in enumerate(head)], "o int, n string, line string")
    return top.unionByName(rows.withColumn("n", F.col("n").cast("string"))).orderBy("o", "n").select("line")


def latex_document(title: Column, abstract: Column, body: Column, least: int = 6) -> Column:
    """A LaTeX article of a title, an abstract and the body's paragraphs of ``least`` words and more."""
    paragraphs = F.filter(F.transform(F.split(body, r"\n\s*\n"), T.norm_spaces), lambda p: T.n_words(p) >= least)
    text = F.array_join(F.transform(paragraphs, T.latex_escape), "\n\n")
    parts = [F.lit("\\documentclass{article}\n\\begin{document}\n\\title{"), T.latex_escape(title), F.lit("}\n\\maketitle\n\\begin{abstract}\n"), T.latex_escape(abstract), F.lit("\n\\end{abstract}\n"), text, F.lit("\n\\end{document}\n")]
    return F.concat(*parts)


def latex_items(sentences: Column) -> Column:
    """Sentences as the items of a list."""
    return F.array_join(F.transform(sentences, lambda s: F.concat(F.lit("\\item "), T.latex_escape(s))), "\n")


def latex_entities(entities: DataFrame, source: str = "source_id") -> DataFrame:
    """(source, latex) of (source, label, text, count, place): a list for each label, in the order of labels and places."""
    item = F.concat(F.lit("\\item "), T.latex_escape(F.col("text")), F.lit(" ("), F.coalesce(F.col("count").cast("string"), F.lit("0")), F.lit(")"))
    g = entities.groupBy(source, "label").agg(F.array_sort(F.collect_list(F.struct("place", item.alias("i")))).alias("is"))
    section = F.concat(F.lit("\\subsection*{"), T.latex_escape(F.col("label")), F.lit("}\n\\begin{itemize}\n"), F.array_join(F.transform("is", lambda x: x["i"]), "\n"), F.lit("\n\\end{itemize}\n"))
    g = g.groupBy(source).agg(F.array_sort(F.collect_list(F.struct("label", section.alias("s")))).alias("ss"))
    return g.select(source, F.array_join(F.transform("ss", lambda x: x["s"]), "\n").alias("latex"))


def latex_source(title: Column, author: Column, year: Column, url: Column, path: Column) -> Column:
    """A source's entry in the bibliography: by its link, else by its file."""
    given = lambda c, other: T.latex_escape(F.coalesce(c, F.lit(other)))
    head = F.concat(given(author, "Unknown author"), F.lit(". \\textit{"), given(title, "Untitled source"), F.lit("}"), F.when(F.coalesce(year, F.lit("")) != "", F.concat(F.lit(" "), T.latex_escape(year), F.lit("."))).otherwise("."))
    return F.when(F.coalesce(url, F.lit("")) != "", F.concat(head, F.lit(" Disponível em: \\url{"), url, F.lit("}."))).otherwise(F.concat(head, F.lit(" Ficheiro PDF: "), given(path, ""), F.lit(".")))


def write_json_file(df: DataFrame, path: str, indent: int = 2) -> None:
    """A small table as one indented JSON file on the driver, for a report; rows come one at a time."""
    import json

    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(df.toJSON().toLocalIterator()):
            f.write(("," if i else "") + "\n" + json.dumps(json.loads(row), indent=indent, ensure_ascii=False))
        f.write("\n]\n")


def write_vectors_with_config(df: DataFrame, path: str, name: str, dim: int, normalized: bool, mode: str = "errorifexists") -> None:
    """Vectors in ``path``/vectors and their description in ``path``/config, as one JSON row."""
    df.write.mode(mode).parquet(f"{path}/vectors")
    df.sparkSession.createDataFrame([(name, dim, normalized)], "model_name string, embedding_dim int, normalized boolean").write.mode(mode).json(f"{path}/config")


def swapped_in(df: DataFrame, path: str) -> str:
    """Write ``df``, which may read ``path``, to it as Parquet; what stood there is kept beside it, and its place returned ("" if there was none)."""
    import time

    spark = df.sparkSession
    jvm = spark._jvm
    p = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    mark = time.strftime("%Y%m%d%H%M%S")
    df.write.parquet(f"{path}-new-{mark}")
    backup = f"{path}-before-{mark}" if fs.exists(p(path)) else ""
    if backup and not fs.rename(p(path), p(backup)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(p(f"{path}-new-{mark}"), p(path)):
        raise OSError(f"cannot put the new table at {path}")
    return backup
