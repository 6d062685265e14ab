"""Word and document vectors: means, neighbours, odd one out, analogies, projection, training."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieve


def centroids(df: DataFrame, group: str, vec: str, renormalise: bool = False) -> DataFrame:
    """(group, vec): mean of each group's vectors by position; a norm of 0 counts as 1."""
    cells = df.select(group, F.posexplode(vec).alias("at", "x")).groupBy(group, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    m = cells.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select(group, F.transform("v", lambda c: c["x"]).alias("vec"))
    if renormalise:
        m = m.withColumn("vec", T.unit(F.col("vec")))
    return m


def unit(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn(vec, T.unit(F.col(vec)))


def odd_one_out(df: DataFrame, group: str, key: str, vec: str, least: int = 3) -> DataFrame:
    """(group, key, score): the member of each group farthest from the mean of its unit vectors, of groups of ``least`` members at least."""
    u = unit(df.select(group, key, vec), vec)
    mean = centroids(u, group, vec).withColumnRenamed("vec", "_m")
    s = u.join(mean, group).withColumn("score", F.round(T.dot(F.col(vec), F.col("_m")), 9))
    return s.groupBy(group).agg(F.min(F.struct("score", F.col(key).alias("k"))).alias("m"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select(group, F.col("m.k").alias(key), F.col("m.score").alias("score"))


def analogy_vectors(df: DataFrame, key: str, vec: str, questions: DataFrame, qkey: str) -> DataFrame:
    """(qkey, vec): for (qkey, key, sign) the mean of signed unit vectors; unknown keys are left out."""
    u = unit(df.select(key, vec), vec)
    signed = questions.join(u, key).withColumn(vec, F.transform(vec, lambda x: x * F.col("sign")))
    return centroids(signed, qkey, vec)


def projected(df: DataFrame, key: str, vec: str, k: int = 2) -> DataFrame:
    """(key, xy): the first k principal components, of centred vectors. A component's sign says nothing."""
    mean = centroids(df.withColumn("_g", F.lit(0)), "_g", vec).select("_g", F.col("vec").alias("_m"))
    c = df.withColumn("_g", F.lit(0)).join(F.broadcast(mean), "_g").select(key, F.zip_with(vec, "_m", lambda a, b: a.cast("double") - b).alias("c"))
    v = c.select(key, array_to_vector("c").alias("c"))
    return PCA(k=k, inputCol="c", outputCol="p").fit(v).transform(v).select(key, vector_to_array("p").alias("xy"))


def word_vectors(sents: DataFrame, tokens: str, size: int = 120, window: int = 5, least: int = 2, rounds: int = 30, seed: int = 42) -> DataFrame:
    """(word, vector) of a skip-gram model. Training differs in its objective from other libraries', so values aren't comparable to theirs."""
    m = Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, seed=seed, inputCol=tokens, outputCol="_v").fit(sents.filter(F.size(tokens) > 0))
    return m.getVectors().select("word", vector_to_array("vector").alias("vector"))


def hashed_vectors(docs: DataFrame, key: str, tokens: str, dim: int = 64, hashed=F.xxhash64) -> DataFrame:
    """(key, vec): the default encoder where no model is given: signed hashed term counts of unit length. hashed: a term to a 64-bit integer."""
    h = hashed(F.col("t"))
    cells = docs.select(key, F.explode(tokens).alias("t")).select(key, F.pmod(h, F.lit(dim)).cast("int").alias("at"), F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("x"))
    g = cells.groupBy(key, "at").agg(F.sum("x").alias("x")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
    v = g.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("vec"))
    return unit(v, "vec")


def pair_similarity(vectors: DataFrame, key: str, vec: str, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of keys: their cosine, NULL where a key is unknown."""
    side = lambda c: vectors.select(F.col(key).alias(c), F.col(vec).alias(f"_{c}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", T.cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def experiment_lines(vectors: DataFrame, counts: DataFrame, words: list[str], pairs: list[tuple[str, str]], groups: list[list[str]], analogies: list[tuple[list[str], list[str]]], top: int = 5) -> DataFrame:
    """(line_no, line) of a report over (word, vector) and (word, n): the most frequent words, neighbours, similarities, the odd word of each group, and analogies.

    The words asked for are lists of the caller's; their few vectors come to the driver, all others are ranked where they are. Unknown words get a line that says so.
    """
    spark = vectors.sparkSession
    asked = {w for w in words} | {w for p in pairs for w in p} | {w for g in groups for w in g} | {w for p, n in analogies for w in (*p, *n)}
    held = {r.word: np.array(r.vector) for r in vectors.filter(F.col("word").isin(sorted(asked))).collect()}
    unit = {w: v / (np.linalg.norm(v) or 1.0) for w, v in held.items()}
    near = {("word", w): (unit[w], {w}) for w in words if w in unit}
    for i, (plus, minus) in enumerate(analogies):
        if all(w in unit for w in (*plus, *minus)):
            v = sum(unit[w] for w in plus) - sum((unit[w] for w in minus), np.zeros(len(unit[plus[0]])))
            near["analogy", i] = (v, {*plus, *minus})
    found: dict = {}
    if near:
        keys, q = list(near), spark.createDataFrame([(j, [float(x) for x in v]) for j, (v, _) in enumerate(near.values())], "j int, qv array<double>")
        most = top + max(len(out) for _, out in near.values())
        s = retrieve.dense_scores(vectors, "word", "vector", q, "j", "qv", most)
        for r in retrieve.top_k(s, "j", F.round("score", 9), F.col("word"), most).orderBy("j", "rank").collect():
            if r.word not in near[keys[r.j]][1] and len(found.get(keys[r.j], ())) < top:
                found.setdefault(keys[r.j], []).append(f"{r.word}: {r.score:.4f}")
    unknown = "not in the vocabulary"
    lines = ["Most frequent words", " ".join(r.word for r in counts.orderBy(F.col("n").desc(), "word").limit(30).collect()), "Most similar"]
    for x in words:
        lines += [f"[{x}]", *(found.get(("word", x), []) if x in unit else [unknown])]
    lines.append("Similarity")
    lines += [f"{a} ~ {b}: " + (f"{float(unit[a] @ unit[b]):.4f}" if a in unit and b in unit else unknown) for a, b in pairs]
    lines.append("Odd one out")
    for g in groups:
        known = [x for x in g if x in unit]
        mean = sum(unit[x] for x in known) if known else 0
        lines.append(f"{' '.join(g)}: " + (min(known, key=lambda x: float(unit[x] @ mean)) if known else unknown))
    lines.append("Analogies")
    for i, (plus, minus) in enumerate(analogies):
        lines += [f"{' + '.join(plus)} - {' - '.join(minus)}", *(found.get(("analogy", i), [unknown]))]
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


def save_vectors_model(model, path: str) -> None:
    """A fitted model in the folder ``path``, in place of any other."""
    model.write().overwrite().save(path)


def load_vectors_model(path: str):
    from pyspark.ml.feature import Word2VecModel

    return Word2VecModel.load(path)
