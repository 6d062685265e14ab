"""Question answering without a model: rules on metadata, evidence sentences, span search, answer ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V


def metadata_answer(question: Column, kind: Column, title: Column, artist: Column) -> Column:
    """The answer that a document's type, title and artist give; NULL if no rule applies."""
    q = F.lower(question)
    return (
        F.when(T.any_of(q, V.ASKS_ARTIST) & (kind == "album") & artist.isNotNull() & (artist != ""), artist)
        .when(T.any_of(q, V.ASKS_ALBUM) & (kind == "album"), title)
        .when(T.any_of(q, V.ASKS_GENRE) & (kind == "genre"), title)
    )


def question_terms(question: Column) -> Column:
    """Words of more than three characters, counted before their punctuation is taken off; lower case, distinct."""
    w = F.filter(T.words(question), lambda x: F.length(x) > 3)
    return F.array_distinct(F.transform(w, lambda x: F.btrim(F.lower(x), F.lit(".,:;!?()[]{}\"'"))))


def evidence_sentences(hits: DataFrame, qkey: str, question: str, title: str, text: str, rank: str = "rank", most: int = 8) -> DataFrame:
    """(qkey, place, title, sentence, points): sentences of the hits' texts that speak to the question, best first, no sentence twice.

    Two points for each question term, three for each term of importance, one for the title. Ties: rank of the hit, place in its text.
    """
    s = hits.select(qkey, F.col(rank).alias("_r"), F.col(title).alias("title"), question_terms(F.col(question)).alias("_q"), F.posexplode(T.split_sentences(F.col(text))).alias("_p", "sentence"))
    low = F.lower("sentence")
    s = s.filter((T.n_words(F.col("sentence")) >= 8) & T.has(F.col("sentence"), r'[.!?"]$') & ~T.any_of(low, V.NOISY_TERMS))
    n = lambda terms: F.size(F.filter(terms, lambda t: F.contains(low, t)))
    points = 2 * n(F.col("_q")) + 3 * n(F.array(*map(F.lit, V.IMPORTANCE_TERMS))) + F.coalesce(F.contains(low, F.lower("title")).cast("int"), F.lit(0))
    s = s.withColumn("points", points).filter("points > 0")
    order = [F.col("points").desc(), "_r", "_p"]
    s = s.withColumn("_n", F.row_number().over(Window.partitionBy(qkey, low).orderBy(*order))).filter("_n = 1")
    s = s.withColumn("place", F.row_number().over(Window.partitionBy(qkey).orderBy(*order))).filter(F.col("place") <= most)
    return s.select(qkey, "place", "title", "sentence", "points")


def explanations(evidence: DataFrame, questions: DataFrame, qkey: str, question: str) -> DataFrame:
    """(qkey, answer): each question's explanation from its evidence, in its order."""
    e = evidence.groupBy(qkey).agg(F.array_sort(F.collect_list(F.struct("place", "title", "sentence"))).alias("e"))
    listed = F.transform("e", lambda x: F.concat(F.lit("Title: "), x["title"], F.lit(". Evidence: "), x["sentence"]))
    q = questions.select(qkey, question).join(e, qkey, "left").withColumn("list", F.coalesce(listed, F.array().cast("array<string>")))
    return q.select(qkey, T.explanation(F.col(question), F.col("list")).alias("answer"))


def best_span(df: DataFrame, key: str, starts: str, ends: str, top: int = 10, longest: int = 30) -> DataFrame:
    """(key, span_start, span_end, score): the pair of likely start and end with the highest product, of arrays of logits; NULL logits are outside the context.

    Of the ``top`` starts and ends; the end not before the start, at most ``longest`` positions. Ties: smaller start, then end. No pair, no row.
    """
    def likely(c: str, at: str) -> DataFrame:
        x = df.select(key, F.posexplode(F.transform(c, lambda v: F.coalesce(v.cast("double"), F.lit(-1e9)))).alias(at, "x"))
        w = Window.partitionBy(key)
        x = x.withColumn("e", F.exp(F.col("x") - F.max("x").over(w))).withColumn("p", F.col("e") / F.sum("e").over(w))
        n = F.row_number().over(w.orderBy(F.col("x").desc(), at))
        return x.withColumn("n", n).filter(F.col("n") <= top).select(key, at, F.col("p").alias(f"p_{at}"))

    both = likely(starts, "span_start").join(likely(ends, "span_end"), key)
    both = both.filter((F.col("span_end") >= F.col("span_start")) & (F.col("span_end") - F.col("span_start") < longest))
    score = F.round(F.col("p_span_start") * F.col("p_span_end"), 12)
    best = both.groupBy(key).agg(F.max(F.struct(score.alias("score"), (-F.col("span_start")).alias("s"), (-F.col("span_end")).alias("e"))).alias("m"))
    return best.select(key, (-F.col("m.s")).alias("span_start"), (-F.col("m.e")).alias("span_end"), F.col("m.score").alias("score"))


def ranked_answers(cands: DataFrame, qkey: str, answer: str, qa: str, retrieval: str, tie: str, top: int = 5) -> DataFrame:
    """(qkey, place, answer, final_score): 0.7 of the one and 0.3 of the other score, no answer twice in another case or punctuation."""
    c = cands.select(qkey, T.postprocess_answer(F.col(answer)).alias("answer"), (0.7 * F.col(qa) + 0.3 * F.col(retrieval)).alias("final_score"), F.col(tie).alias("_t")).filter("answer <> '' and final_score is not null")
    order = [F.round("final_score", 9).desc(), "_t"]
    same = F.btrim(F.lower("answer"), F.lit(" .,:;!?\"'()[]{}"))
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy(qkey, same).orderBy(*order))).filter("_n = 1")
    return c.withColumn("place", F.row_number().over(Window.partitionBy(qkey).orderBy(*order))).filter(F.col("place") <= top).select(qkey, "place", "answer", "final_score")
