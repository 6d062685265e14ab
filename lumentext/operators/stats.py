"""Term and n-gram statistics, and the smoothed n-gram language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize


def term_counts(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, n, len): how often each term occurs in each document, and the document's tokens. Documents without tokens have no rows.

    The length comes with the tokens, so one shuffle does.
    """
    # the size is taken from the array that is exploded, in one struct, so that the tokens are made once
    one = T.let(tokens, lambda t: F.struct(F.size(t).alias("len"), t.alias("terms")))
    rows = docs.select(key, F.inline(F.array(one))).select(key, "len", F.explode("terms").alias("term"))
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.first("len").alias("len"))


def document_frequency(counts: DataFrame) -> DataFrame:
    """(term, df): counts has one row for each document and term, so nothing need be made distinct."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(counts: DataFrame, n_docs: Column) -> DataFrame:
    """(term, df, idf): idf = log10(N / df)."""
    return document_frequency(counts).withColumn("idf", F.log10(n_docs / F.col("df")))


def one(df: DataFrame, *aggs: Column) -> DataFrame:
    """A one-row table of totals, broadcast: its size is fixed."""
    return F.broadcast(df.agg(*aggs))


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """df with the columns of a one-row table, joined on a constant."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").drop("_one")


def tfidf_weights(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, tf, idf, w): tf = count / tokens of the document. N counts all documents, those without tokens too."""
    counts = materialize(term_counts(docs, key, tokens), "terms")
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    terms = with_totals(document_frequency(counts), n).withColumn("idf", F.log10(F.col("n_docs") / F.col("df")))
    return counts.join(terms, "term").select(key, "term", (F.col("n") / F.col("len")).alias("tf"), "idf", (F.col("n") / F.col("len") * F.col("idf")).alias("w"))


def ngram_counts(sents: DataFrame, tokens: Column, n: int, by: list[str] | None = None) -> DataFrame:
    """(by..., w1..wn, freq) of the n-grams within sentences."""
    by = by or []
    rows = sents.select(*by, F.explode(T.ngrams(tokens, n)).alias("g"))
    return rows.groupBy(*by, *(F.get("g", F.lit(i)).alias(f"w{i + 1}") for i in range(n))).agg(F.count(F.lit(1)).alias("freq"))


def context_counts(ngrams: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """(by..., w1..w(n-1), ctx): how often the first n - 1 words are followed by any."""
    return ngrams.groupBy(*(by or []), *(f"w{i + 1}" for i in range(n - 1))).agg(F.sum("freq").alias("ctx"))


def sentence_lm(sents: DataFrame, key: str, tokens: Column, by: str, bigram_share: float = 0.6, long: int = 35, long_factor: float = 0.9) -> DataFrame:
    """(by, key, score): mean log probability of each sentence by bigrams and trigrams with add-one smoothing, of its own source.

    The vocabulary is that of first words of bigrams. A sentence without trigrams counts its bigrams alone, one without bigrams has no
    row. Sentences of more than ``long`` tokens have their score multiplied, which raises it, as it is negative.
    """
    toks = sents.select(by, key, tokens.alias("_t"))
    parts = []
    toks = materialize(toks, "tokens")
    counts = {n: ngram_counts(toks, F.col("_t"), n, [by]) for n in (2, 3)}
    vocab = context_counts(counts[2], 2, [by]).groupBy(by).agg(F.count(F.lit(1)).alias("v"))
    for n in (2, 3):
        ctx = context_counts(counts[n], n, [by])
        ws = [f"w{i + 1}" for i in range(n)]
        prob = counts[n].join(ctx, [by, *ws[:-1]]).join(vocab, by).select(by, *ws, F.ln((F.col("freq") + 1) / (F.col("ctx") + F.col("v"))).alias("lp"))
        rows = toks.select(by, key, F.size("_t").alias("len"), F.explode(T.ngrams(F.col("_t"), n)).alias("g"))
        rows = rows.select(by, key, "len", *(F.get("g", F.lit(i)).alias(f"w{i + 1}") for i in range(n)))
        parts.append(rows.join(prob, [by, *ws]).groupBy(by, key).agg(F.avg("lp").alias(f"lp{n}"), F.first("len").alias(f"len{n}")))
    both = parts[0].join(parts[1], [by, key], "left")
    score = bigram_share * F.col("lp2") + (1 - bigram_share) * F.coalesce("lp3", "lp2")
    return both.select(by, key, F.when(F.col("len2") > long, score * long_factor).otherwise(score).alias("score"))


def greedy_diverse(scored: DataFrame, by: str, key: str, sentence: str, score: str, k: int = 3, most: float = 0.2) -> DataFrame:
    """(by, place, key, sentence, score): the best k sentences of each source, each with a Jaccard similarity of at most ``most`` to those before it.

    Greedy, by rounded score, then key. Each of k rounds takes the best that is left of every source and drops what is too
    like it: an aggregate and a join, so no source is ever gathered in one place.
    """
    left = scored.select(by, key, sentence, F.round(score, 4).alias("score"), T.tokens_a(F.col(sentence)).alias("_t"))
    out = None
    for place in range(1, k + 1):
        best = left.groupBy(by).agg(F.max(F.struct("score", (-F.col(key)).alias("_k"), F.col(sentence).alias("_s"), F.col("_t").alias("_b"))).alias("m"))
        best = best.select(by, F.lit(place).alias("place"), (-F.col("m._k")).alias(key), F.col("m._s").alias(sentence), F.col("m.score").alias("score"), F.col("m._b").alias("_b"))
        out = best.drop("_b") if out is None else out.unionByName(best.drop("_b"))
        left = left.join(best.select(by, F.col(key).alias("_taken"), "_b"), by).filter((F.col(key) != F.col("_taken")) & (T.jaccard(F.col("_t"), F.col("_b")) <= most)).drop("_taken", "_b")
    return out


def group_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(what, value, n) of several columns at once, by grouping sets."""
    g = df.groupingSets([[c] for c in cols], *cols).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(c).alias(f"_{c}") for c in cols))
    what, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in cols:
        what, value = F.when(F.col(f"_{c}") == 0, F.lit(c)).otherwise(what), F.when(F.col(f"_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    return g.select(what.alias("what"), value.alias("value"), "n")


def top_by(df: DataFrame, by: list[str], order: list[Column], k: int, place: str = "place") -> DataFrame:
    """The first k rows of each group, numbered."""
    return df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(place) <= k)


def dense_vectors(weights: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, vec) of (key, term, w): a place for each of ``terms``, a vocabulary small enough to be a list, sorted by code point."""
    m = weights.filter(F.col("term").isin(terms)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("m"))
    vocab = F.array(*map(F.lit, sorted(terms)))
    rest = weights.select(key).distinct().join(m, key, "left")
    return rest.select(key, F.transform(vocab, lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0.0))).alias("vec"))


def most_common(counts: DataFrame, by: list[str], k: int, n: str = "freq") -> DataFrame:
    """The ``k`` most frequent rows of each group, with their place; ties by the other columns."""
    rest = [c for c in counts.columns if c not in (*by, n)]
    return top_by(counts, by, [F.col(n).desc(), *rest], k)


def ngram_keys(counts: DataFrame, ngram: str, n: int) -> DataFrame:
    """Counts whose n-gram is an array, as loaded from JSON, with one column a word: w1 to wn."""
    return counts.select(*(F.get(ngram, F.lit(i)).alias(f"w{i + 1}") for i in range(n)), *(c for c in counts.columns if c != ngram))


def file_counts(docs: DataFrame, by: str, sentences: Column, tokens) -> DataFrame:
    """(by, sentences, usable, tokens): sentences of each file, those that ``tokens`` takes (a list, or NULL), and their tokens."""
    s = docs.select(by, F.explode(sentences).alias("s")).select(by, tokens(F.col("s")).alias("t"))
    return s.groupBy(by).agg(F.count(F.lit(1)).alias("sentences"), F.count("t").alias("usable"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("tokens"))
