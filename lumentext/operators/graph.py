"""Mentions of a gazetteer and the co-occurrence graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def mentions(sents: DataFrame, keys: list[str], text: str, gazetteer: DataFrame) -> DataFrame:
    """(keys..., name) of the phrases of (phrase, name) in each sentence, the longest first: a shorter one within a longer is none.

    Each word meets the phrases that begin with it, an equi-join; the few that do are compared with the words that follow. Spark broadcasts the
    gazetteer where it is small.
    """
    w = F.filter(F.split(F.col(text), r"[^\p{L}\p{M}\p{N}_'\-]+"), lambda x: x != "")
    p = F.split("phrase", " ")
    phrases = gazetteer.select(F.get(p, F.lit(0)).alias("word"), p.alias("_p"), F.size(p).alias("n"), "phrase", "name")
    words = sents.select(*keys, F.posexplode(w).alias("at", "word"))
    begun = words.join(phrases, "word").select(*keys, (F.col("at") + 1).alias("at"), "n", "phrase", "name")
    rest = begun.filter("n > 1").join(sents.select(*keys, w.alias("_w")), keys).filter(F.array_join(F.slice("_w", F.col("at"), F.col("n")), " ") == F.col("phrase"))
    hits = begun.filter("n = 1").unionByName(rest.drop("_w"))
    spans = F.collect_list(F.struct("at", "n", "name"))
    by = hits.groupBy(*keys).agg(spans.alias("s"))
    inside = lambda x, y: (y["at"] <= x["at"]) & (y["at"] + y["n"] >= x["at"] + x["n"]) & (y["n"] > x["n"])
    kept = F.filter("s", lambda x: ~F.exists("s", lambda y: inside(x, y)))
    return by.select(*keys, F.explode(kept).alias("m")).select(*keys, F.col("m.name").alias("name"))


def canonical(mention: DataFrame, aliases: DataFrame, rejected: DataFrame) -> DataFrame:
    """Names through a (name, alias_of) table, without the rejected ones and those of one character."""
    m = mention.withColumn("name", T.strip(F.col("name"))).join(aliases.select("name", "alias_of"), "name", "left")
    m = m.withColumn("name", F.coalesce("alias_of", "name")).drop("alias_of").join(rejected.select("name"), "name", "left_anti")
    return m.filter(F.length("name") > 1)


def cooccurrence(mention: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, freq): sentences that name it; edges (source, target, weight), source < target: sentences that name both.

    The pairs are made from each sentence's own distinct names, which its length bounds.
    """
    d = mention.select(*keys, "name").distinct()
    nodes = d.groupBy("name").agg(F.count(F.lit(1)).alias("freq"))
    per = d.groupBy(*keys).agg(F.array_sort(F.collect_list("name")).alias("ns")).filter(F.size("ns") > 1)
    pairs = F.flatten(F.transform("ns", lambda a, i: F.transform(F.slice("ns", i + 2, F.size("ns")), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    edges = per.select(F.explode(pairs).alias("p")).groupBy("p.source", "p.target").agg(F.count(F.lit(1)).alias("weight"))
    return nodes, edges


def subgraph(edges: DataFrame, nodes: DataFrame, by: list[str] | None = None, source: str = "source", target: str = "target", name: str = "name") -> DataFrame:
    """Edges both of whose ends are among ``nodes``."""
    by = by or []
    return edges.join(nodes.select(*by, F.col(name).alias(source)), [*by, source], "left_semi").join(nodes.select(*by, F.col(name).alias(target)), [*by, target], "left_semi")


def drawn_nodes(names: DataFrame, freq: DataFrame, groups: DataFrame, by: list[str], colours: dict[str, str] = V.GROUP_COLOURS) -> DataFrame:
    """(by..., name, size, colour): names with their size by (by..., name, freq) and the colour of their group by (name, grp)."""
    table = F.create_map(*(F.lit(x) for kv in colours.items() for x in kv))
    n = names.join(freq.select(*by, "name", "freq"), [*by, "name"], "left").join(groups.select("name", "grp"), "name", "left")
    return n.select(*by, "name", (F.coalesce("freq", F.lit(V.NO_SIZE)) * V.SIZE_FACTOR).alias("size"), F.coalesce(F.try_element_at(table, F.coalesce("grp", F.lit(V.NO_GROUP))), F.lit(colours[V.NO_GROUP])).alias("colour"))


def drawn_edges(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """``edges`` with their width."""
    return edges.withColumn("width", F.col(weight) * V.WIDTH_FACTOR)
