"""Answers to questions from retrieved passages: rules on metadata first, then a reader or a generator given by the caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from . import qa
from .models import Maker, apply_model

Reader = Callable[[DataFrame], DataFrame]


def logit_reader(logits: Callable[[DataFrame], DataFrame], key: list[str]) -> Reader:
    """A reader from a model of logits: ``logits`` adds tokens, starts, ends and inside, one entry a token, to (key..., question, context).

    Positions outside the context (inside false) take no part in an answer.
    """

    def read(asked: DataFrame) -> DataFrame:
        one = F.struct(*key).alias("_key")
        x = logits(asked)
        mask = lambda c: F.zip_with(c, "inside", lambda v, i: F.when(i, v.cast("double")))
        x = x.select(one, "tokens", mask("starts").alias("starts"), mask("ends").alias("ends"))
        best = qa.best_span(x, "_key", "starts", "ends").join(x.select("_key", "tokens"), "_key")
        words = F.array_join(F.slice("tokens", F.col("span_start") + 1, F.col("span_end") - F.col("span_start") + 1), " ")
        return best.select(*(F.col(f"_key.{k}").alias(k) for k in key), words.alias("answer"), F.col("score").alias("qa_score"))

    return read


def extractive_answers(hits: DataFrame, qkey: str, question: str, reader: Reader, top: int = 5) -> DataFrame:
    """(qkey, place, answer, final_score, qa_score, retrieval_score, answer_method, chunk_id): the best answers to each question.

    hits: ranked passages (qkey, question, rank, chunk_id, title, type, artist, source, text, score), at most a few for each question. Where a rule on the
    metadata applies, it answers with a score of 1; else the reader does, from (qkey, chunk_id, question, context) to
    (qkey, chunk_id, answer, qa_score). final_score: 0.7 and 0.3 of the two scores. No answer twice; passages without one are passed over.
    """
    meta = qa.metadata_answer(F.col(question), F.col("type"), F.col("title"), F.col("artist"))
    h = hits.withColumn("_meta", meta)
    context = T.qa_context(F.col("title"), F.col("type"), F.col("source"), F.col("artist"), F.col("text"))
    read = reader(h.filter("_meta is null").select(qkey, "chunk_id", F.col(question).alias("question"), context.alias("context")))
    base = h.select(qkey, "chunk_id", "rank", "_meta", F.col("score").alias("retrieval_score"))
    ruled = base.filter("_meta is not null").select("*", F.col("_meta").alias("answer"), F.lit(1.0).alias("qa_score"), F.lit("metadata").alias("answer_method"))
    found = base.filter("_meta is null").join(read.select(qkey, "chunk_id", "answer", "qa_score"), [qkey, "chunk_id"]).withColumn("answer_method", F.lit("model"))
    c = ruled.unionByName(found).withColumn("answer", T.postprocess_answer(F.col("answer"))).filter("answer <> ''")
    c = c.withColumn("final_score", 0.7 * F.coalesce("qa_score", F.lit(0.0)) + 0.3 * F.coalesce("retrieval_score", F.lit(0.0)))
    order = [F.round("final_score", 9).desc(), F.col("rank")]
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy(qkey, F.lower("answer")).orderBy(*order))).filter("_n = 1")
    c = c.withColumn("place", F.row_number().over(Window.partitionBy(qkey).orderBy(*order))).filter(F.col("place") <= top)
    return c.select(qkey, "place", "answer", "final_score", "qa_score", "retrieval_score", "answer_method", "chunk_id")


def filled(template: str, **parts: Column) -> Column:
    """A template with its {names} replaced by columns, each place once and nothing within what was put in."""
    out, rest = [], template
    for name in sorted(parts, key=lambda n: template.index("{" + n + "}")):
        before, rest = rest.split("{" + name + "}", 1)
        out += [F.lit(before), F.coalesce(parts[name], F.lit(""))]
    return F.concat(*out, F.lit(rest))


def prompts(hits: DataFrame, qkey: str, question: str, rank: str = "rank") -> DataFrame:
    """(qkey, question, prompt) for a generator: of evidence sentences for questions that ask for an explanation, else of the numbered passages."""
    who = F.when(F.col("artist").isNotNull() & (F.col("artist") != ""), F.concat(F.lit("\nArtist: "), "artist")).otherwise("")
    block = F.concat(F.lit("[Document "), F.col(rank).cast("string"), F.lit("]\nTitle: "), "title", F.lit("\nType: "), "type", who, F.lit("\nSource: "), "source", F.lit("\nText: "), "text")
    g = hits.groupBy(qkey, F.col(question).alias("question")).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b")))).alias("bs"))
    why = hits.filter(T.is_explanation(F.col(question)))
    e = qa.evidence_sentences(why, qkey, question, "title", "text", rank)
    e = e.groupBy(qkey).agg(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("- Title: "), "title", F.lit(". Evidence: "), "sentence").alias("s")))).alias("es"))
    evidence = F.array_join(F.transform("es", lambda x: x["s"]), "\n")
    context = F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n")
    q = F.col("question")
    text = F.when(T.is_explanation(q), filled(V.EXPLANATION_PROMPT, question=q, evidence=evidence)).otherwise(filled(V.CONTEXT_PROMPT, question=q, context=context))
    return g.join(e, qkey, "left").select(qkey, "question", text.alias("prompt"))


def abstractive_answers(hits: DataFrame, qkey: str, question: str, make: Maker) -> DataFrame:
    """(qkey, question, answer, answer_method): one answer a question: by a rule on the first passage's metadata, else generated from the prompt, else, where a
    generated explanation is none, put together from the evidence. make: as in ``models``, from prompts to texts."""
    first = hits.filter("rank = 1").select(qkey, qa.metadata_answer(F.col(question), F.col("type"), F.col("title"), F.col("artist")).alias("_meta"))
    p = prompts(hits, qkey, question).join(first, qkey, "left")
    ruled = p.filter("_meta is not null").select(qkey, "question", F.col("_meta").alias("answer"), F.lit("metadata").alias("answer_method"))
    made = apply_model(p.filter("_meta is null").select(qkey, "question", "prompt"), "prompt", make, "answer", "string").withColumn("answer", T.clean_generated(F.coalesce("answer", F.lit(""))))
    why = T.is_explanation(F.col("question"))
    bad = why & T.is_bad_explanation(F.col("answer"), F.col("question"))
    evidence = qa.evidence_sentences(hits.filter(T.is_explanation(F.col(question))), qkey, question, "title", "text")
    other = qa.explanations(evidence, made.select(qkey, "question"), qkey, "question").withColumnRenamed("answer", "_other")
    made = made.join(other, qkey, "left").select(qkey, "question", F.when(bad, F.col("_other")).otherwise(F.col("answer")).alias("answer"), F.when(bad, "evidence_synthesis").otherwise("generative").alias("answer_method"))
    return ruled.unionByName(made)


def answer_methods(answers: DataFrame) -> DataFrame:
    """(answer_method, n): how many answers each way gave."""
    return answers.groupBy("answer_method").agg(F.count(F.lit(1)).alias("n"))


def retrieved_texts(hits: DataFrame, qkey: str, most: int = 300) -> DataFrame:
    """(qkey, text): each question's passages in Markdown: rank, linked title, type, scores, source and the first ``most`` characters."""
    snippet = F.replace(F.substring("text", 1, most), F.lit("\n"), F.lit(" "))
    head = F.concat(F.lit("**#"), F.col("rank").cast("string"), F.lit(" "), T.md_link(F.col("title"), F.col("url")), F.lit("** ("), "type", F.lit(")\n"))
    body = F.concat(head, F.format_string("Final score: `%.4f`\n", F.round("score", 4)), F.lit("Source: "), F.coalesce("source", F.lit("unknown")), F.lit("\n\n> "), snippet, F.lit("…\n"))
    g = hits.groupBy(qkey).agg(F.array_sort(F.collect_list(F.struct("rank", body.alias("b")))).alias("bs"))
    return g.select(qkey, F.array_join(F.transform("bs", lambda x: x["b"]), "\n").alias("text"))


def example_questions(demo: DataFrame, extra: DataFrame) -> DataFrame:
    """(question, filter_type, mode): the demonstration's rows, then those of (question, filter_type) not seen there."""
    mode = F.when(T.starts_with_any(F.lower("question"), ["explain", "why", "what is"]), "Abstractive").otherwise("Both")
    rest = extra.join(demo.select("question"), "question", "left_anti").select("question", F.coalesce("filter_type", F.lit("(all types)")).alias("filter_type"), mode.alias("mode"))
    return demo.select("question", "filter_type", "mode").unionByName(rest)
