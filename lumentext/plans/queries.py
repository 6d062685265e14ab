"""Queries over the test tables, one or more for each operator. Each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import audit, best, embed, evaluate, graph, ner, pages, qa, retrieve, stats
from ..session import spread, table
from ..sources import sinks

#: Queries of the flagship ranking; the last has no known word.
QUERIES = ["the bright garden", "blue sky and silver letter", "final single", "zzz qqq"]
#: Stop words, names and tags of the examples: parameters, not part of any operator.
STOP_D = "the and que com uma não los las der die und".split()
GAZETTEER = {"Teresa": "Teresa", "Hugo": "Hugo", "Dana": "Dana", "Isabel": "Isabel", "Edward": "Edward", "Eduardo": "Edward", "Samuel": "Samuel", "Sam": "Samuel", "Ruth": "Ruth", "Lars": "Lars", "Priya": "Priya", "Marek": "Marek", "Monica": "Mónica", "Mónica": "Mónica", "Robert": "Robert"}
REJECTED = ["Lars"]
_R = lambda c, n=6: F.round(F.col(c) if isinstance(c, str) else c, n)


def _literal(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUERIES, 1)), "query_id int, query string")


def _docs(spark, d) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", "domain"))


def tfidf_idf(spark, d):
    docs = _docs(spark, d)
    counts = stats.term_counts(docs, "doc_id", T.tokens_c(F.col("text")))
    x = stats.with_totals(stats.document_frequency(counts), docs.agg(F.count(F.lit(1)).alias("n_docs")))
    return x.select("term", "df", _R(F.log10(F.col("n_docs") / F.col("df"))).alias("idf"))


def tfidf_weights(spark, d):
    return stats.tfidf_weights(_docs(spark, d), "doc_id", T.tokens_c(F.col("text"))).select("doc_id", "term", _R("tf").alias("tf"), _R("w").alias("w"))


def tfidf_rank(spark, d):
    return retrieve.tfidf_rank(_docs(spark, d), "doc_id", "text", _literal(spark), "query_id", "query").select("query_id", "doc_id", _R("score").alias("score"))


def _questions(spark, d) -> DataFrame:
    return table(spark, d, "answer_question").groupBy("question_id").agg(F.min("question").alias("question"))


def _some_questions(spark, d) -> DataFrame:
    """Every question whose id is divisible by 20."""
    return _questions(spark, d).filter("question_id % 20 = 0")


def _chunk_texts(spark, d, *more: str) -> DataFrame:
    return spread(table(spark, d, "chunks").select("chunk_id", "text", *more))


def bm25_rank(spark, d):
    hits = best.bm25_best(_chunk_texts(spark, d), "chunk_id", "text", _some_questions(spark, d), "question_id", "question", 10)
    return retrieve.top_k(hits, "question_id", _R("score"), F.col("chunk_id").desc(), 10).select("question_id", "rank", "chunk_id", _R("score").alias("score"))


def bm25_unique_docs(spark, d):
    """For all questions."""
    # dealt out by question, which serves both of the ranks
    hits = best.bm25_best(_chunk_texts(spark, d, "doc_id"), "chunk_id", "text", _questions(spark, d), "question_id", "question", 10, "doc_id").repartition("question_id")
    return retrieve.best_per_doc(hits, "question_id", "doc_id", _R("score"), F.col("chunk_id").desc()).filter("rank <= 10").select("question_id", "rank", "doc_id", "chunk_id", _R("score").alias("score"))


def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    s = retrieve.dense_scores(e, "vec_id", "embedding", q, "query_id", "qv", 10)
    return retrieve.top_k(s, "query_id", _R("score"), F.col("vec_id").desc(), 10).select("query_id", "rank", "vec_id", _R("score", 5).alias("score"))


def _hybrid(spark, d, k: int, **more) -> DataFrame:
    """Question texts with the vector of their candidate of the highest sbert_score, against all chunks."""
    chunks = table(spark, d, "chunks")
    first = table(spark, d, "answer_question").filter("question_id % 20 = 0 and sbert_score is not null").groupBy("question_id").agg(F.max(F.struct("sbert_score", "chunk_id")).alias("m")).select("question_id", F.col("m.chunk_id").alias("chunk_id"))
    q = first.join(chunks.select("chunk_id", "embedding"), "chunk_id").select("question_id", F.col("embedding").alias("qv"))
    return best.hybrid_best(_chunk_texts(spark, d, "doc_id", "type", "embedding"), "chunk_id", "text", "embedding", _some_questions(spark, d), "question_id", "question", q, "qv", k, 0.6, **more)


def hybrid_rank(spark, d):
    return retrieve.top_k(_hybrid(spark, d, 10), "question_id", _R("score"), F.col("chunk_id").desc(), 10).select("question_id", "rank", "chunk_id", _R("score", 4).alias("score"))


def hybrid_filtered(spark, d):
    """Albums only, after scores were set to scale over all chunks; one chunk a document."""
    hits = _hybrid(spark, d, 5, per="doc_id", where=F.col("type") == "album").repartition("question_id")
    return retrieve.best_per_doc(hits, "question_id", "doc_id", _R("score"), F.col("chunk_id").desc()).filter("rank <= 5").select("question_id", "rank", "doc_id", _R("score", 4).alias("score"))


def confidence_flag(spark, d):
    hits = retrieve.ranked(table(spark, d, "answer_question").filter("retrieval_score is not null and not isnan(retrieval_score)").groupBy("question_id", "chunk_id").agg(F.max("retrieval_score").alias("score")), "question_id", F.col("score"), F.col("chunk_id"))
    return retrieve.confidence(hits, "question_id")


def doc_centroid(spark, d):
    c = embed.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("vec").alias("pos", "x")).select("label", "pos", _R("x").alias("x"))


def chunk_documents(spark, d):
    c = spread(table(spark, d, "corpus").select("crawl_id", "text").filter("text is not null")).select("crawl_id", F.posexplode(T.chunk_words(F.col("text"))).alias("chunk_index", "text"))
    return c.select("crawl_id", "chunk_index", F.format_string("%d_chunk_%04d", "crawl_id", "chunk_index").alias("chunk_id"), "text", T.n_words(F.col("text")).alias("word_count"))


def chunk_counts(spark, d):
    return stats.group_counts(table(spark, d, "chunks"), ["type", "section", "source_type", "source"]).select("what", "value", "n")


def clean_citations(spark, d):
    return table(spark, d, "scrapper").filter("descricao is not null").select("rec_id", T.clean_citations(F.col("descricao")).alias("text"))


def clean_documents(spark, d):
    return spread(table(spark, d, "corpus").select("crawl_id", "text").filter("text is not null")).select("crawl_id", T.clean_document(F.col("text")).alias("text"))


def clean_for_chunks(spark, d):
    return spread(table(spark, d, "corpus").select("crawl_id", "text").filter("text is not null")).select("crawl_id", T.clean_for_chunks(F.col("text")).alias("text"))


def slugs(spark, d):
    return table(spark, d, "corpus_audit").filter("title is not null").select("crawl_id", T.slugify(F.col("title")).alias("slug"))


def url_domains(spark, d):
    return table(spark, d, "corpus").select(T.domain_of(F.col("url")).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def link_scores(spark, d):
    """Scores of every page's link, and of invented links to preferred and refused domains made of its slug."""
    c = table(spark, d, "corpus").select("crawl_id", "type", "url", T.slugify(F.coalesce("title", F.lit(""))).alias("slug"))
    host = F.get(F.array(*map(F.lit, V.GOOD_DOMAINS + V.BAD_URLS)), F.pmod("crawl_id", F.lit(len(V.GOOD_DOMAINS + V.BAD_URLS))).cast("int"))
    links = c.select("crawl_id", "type", F.explode(F.array("url", F.concat(F.lit("https://www."), host, F.lit("/"), "slug"))).alias("url"))
    return audit.one_link_per_domain(links, "crawl_id", "url", "type")


def sentences(spark, d):
    return spread(table(spark, d, "corpus").select("crawl_id", "text").filter("text is not null")).select("crawl_id", F.posexplode(T.split_sentences(F.col("text"))).alias("sent_no", "sentence"))


def valid_sentences(spark, d):
    return sentences(spark, d).filter(T.is_valid_sentence(T.norm_spaces(F.col("sentence")))).select("crawl_id", "sent_no")


def candidate_sentences(spark, d):
    return sentences(spark, d).filter(T.is_candidate_sentence(T.norm_spaces(F.col("sentence")))).select("crawl_id", "sent_no")


def _cells(spark, d) -> DataFrame:
    return table(spark, d, "wiki_space_exploration_top_sentences").filter("sentence is not null and source_id is not null").select("sent_id", "source_id", T.norm_spaces(F.col("sentence")).alias("sentence"))


def bigrams(spark, d):
    return stats.ngram_counts(_cells(spark, d), T.tokens_a(F.col("sentence")), 2, ["source_id"])


def trigrams(spark, d):
    return stats.ngram_counts(_cells(spark, d), T.tokens_a(F.col("sentence")), 3, ["source_id"])


def context_counts(spark, d):
    return stats.context_counts(bigrams(spark, d), 2, ["source_id"])


def vocab_size(spark, d):
    return context_counts(spark, d).groupBy("source_id").agg(F.count(F.lit(1)).alias("v"))


def sentence_lm_score(spark, d):
    return stats.sentence_lm(_cells(spark, d), "sent_id", T.tokens_a(F.col("sentence")), "source_id").select("source_id", "sent_id", _R("score", 5).alias("score"))


def diverse_top3(spark, d):
    s = stats.sentence_lm(_cells(spark, d), "sent_id", T.tokens_a(F.col("sentence")), "source_id")
    c = _cells(spark, d).filter(T.is_candidate_sentence(F.col("sentence"))).join(s.select("sent_id", "score"), "sent_id")
    return stats.greedy_diverse(c, "source_id", "sent_id", "sentence", "score").select("source_id", "place", "sent_id", "score")


def _mentions(spark, d) -> DataFrame:
    s = spread(table(spark, d, "documents").select("doc_id", "text").filter("text is not null")).select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("sent_no", "sentence"))
    gaz = spark.createDataFrame([(k, k) for k in GAZETTEER], "phrase string, name string")
    m = graph.mentions(s, ["doc_id", "sent_no"], "sentence", gaz)
    aliases = spark.createDataFrame(list(GAZETTEER.items()), "name string, alias_of string")
    return graph.canonical(m, aliases, spark.createDataFrame([(r,) for r in REJECTED], "name string"))


def cooccurrence_nodes(spark, d):
    return graph.cooccurrence(_mentions(spark, d), ["doc_id", "sent_no"])[0]


def cooccurrence_edges(spark, d):
    return graph.cooccurrence(_mentions(spark, d), ["doc_id", "sent_no"])[1]


def strong_edges(spark, d):
    r = table(spark, d, "relacoes_fortes").groupBy("livro_id", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.max("weight").alias("weight"))
    return r.filter("weight >= 3")


def top15_subgraph(spark, d):
    p = table(spark, d, "personagens_final").filter("personagem is not null").groupBy("livro_id", "personagem").agg(F.max("frequencia").alias("f"))
    top = stats.top_by(p, ["livro_id"], [F.col("f").desc_nulls_last(), F.col("personagem")], 15)
    return graph.subgraph(strong_edges(spark, d), top, ["livro_id"], name="personagem").select("livro_id", "source", "target", "weight")


def node_sizes(spark, d):
    """Every name on an edge with its size, three times its frequency, 10 where it has none."""
    e = table(spark, d, "relacoes_fortes")
    names = e.select("livro_id", F.col("source").alias("name")).union(e.select("livro_id", "target")).filter("name is not null").distinct()
    f = table(spark, d, "personagens_final").groupBy("livro_id", F.col("personagem").alias("name")).agg(F.max("frequencia").alias("f"))
    return names.join(f, ["livro_id", "name"], "left").select("livro_id", "name", F.coalesce(F.col("f") * 3, F.lit(10)).alias("size"))


def audit_flags(spark, d):
    return audit.audit(table(spark, d, "corpus"), "crawl_id", "title", "text")


def exact_duplicates(spark, d):
    return audit.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


def repair_docs(spark, d):
    """Flagged pages take the longest text of another crawl of their document, if it is long enough."""
    c = table(spark, d, "corpus").select("crawl_id", "doc_id", "text")
    bad = audit.flagged(audit.audit(table(spark, d, "corpus"), "crawl_id", "title", "text"), "crawl_id")
    best = c.filter("text is not null").groupBy("doc_id").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("m"))
    new = c.select("crawl_id", "doc_id").join(best, "doc_id").select("crawl_id", F.col("m.text").alias("new_text"))
    r = audit.repaired(c, "crawl_id", "text", bad, new)
    return r.select("crawl_id", "state", F.coalesce(F.length("text"), F.lit(-1)).alias("chars"))


def corpus_distribution(spark, d):
    return stats.group_counts(table(spark, d, "corpus"), ["type", "section", "source_type"])


def chunks_consistency(spark, d):
    return audit.consistency(table(spark, d, "corpus"), table(spark, d, "chunks"), "doc_id")


def eval_retrieval(spark, d):
    """MRR, precision at 1 and hits at 3 of the candidates by retrieval_score; relevant: the document of the highest qa_score."""
    a = table(spark, d, "answer_question").select("question_id", "chunk_id", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("qa_score", "retrieval_score")))
    a = a.groupBy("question_id", "chunk_id").agg(F.max("qa_score").alias("qa"), F.max("retrieval_score").alias("rs"))
    rel = a.filter("qa is not null").groupBy("question_id").agg(F.max(F.struct("qa", "chunk_id")).alias("m")).select("question_id", F.col("m.chunk_id").alias("chunk_id"))
    hits = retrieve.ranked(a.filter("rs is not null"), "question_id", F.col("rs"), F.col("chunk_id"))
    return evaluate.retrieval_metrics(hits, rel, a, "question_id", "chunk_id")[1]


def token_f1(spark, d):
    """The audited title against the crawled one."""
    t = table(spark, d, "corpus_audit").select("crawl_id", F.col("title").alias("p")).join(table(spark, d, "corpus").select("crawl_id", "title"), "crawl_id")
    return evaluate.answer_metrics(t, "crawl_id", "p", "title").select("crawl_id", "em", _R("f1").alias("f1"))


def entity_filter(spark, d):
    e = table(spark, d, "wiki_human_spaceflight_entities").filter("text is not null and source_id is not null").groupBy("source_id", "label", "text").agg(F.max("count").alias("count"))
    return ner.filtered_entities(e)


def entity_report(spark, d):
    return sinks.entity_report(entity_filter(spark, d)).select("source_id", F.to_json("report").alias("report"))


def entity_counts(spark, d):
    return table(spark, d, "wiki_human_spaceflight_entities").groupBy("source_id", "label", "text").agg(F.sum(F.coalesce("count", F.lit(0)).cast("long")).alias("n"))


def _tagged(spark, d) -> DataFrame:
    """Tokens of eval_items with a rule for tags: names of capitals are one span, numbers another."""
    t = table(spark, d, "eval_items").select(F.col("item_id").alias("sent_id"), F.posexplode(F.split(T.norm_spaces(F.col("text")), " ")).alias("pos", "token"))
    kind = F.when(T.has(F.col("token"), "^[A-Z]"), "Pessoa").when(T.has(F.col("token"), "^[0-9]"), "Data")
    from pyspark.sql import Window

    prev = F.lag(kind).over(Window.partitionBy("sent_id").orderBy("pos"))
    return t.withColumn("tag", F.when(kind.isNull(), "O").when(F.equal_null(prev, kind), F.concat(F.lit("I-"), kind)).otherwise(F.concat(F.lit("B-"), kind)))


def iob_spans(spark, d):
    return ner.iob_spans(_tagged(spark, d))


def span_f1(spark, d):
    """Against predictions that leave out every token of more than nine characters."""
    t = _tagged(spark, d)
    p = t.withColumn("tag", F.when(F.length("token") > 9, "O").otherwise(F.col("tag")))
    m = ner.span_metrics(ner.iob_spans(t), ner.iob_spans(p))
    return m.select(F.coalesce("label", F.lit("all")).alias("label"), "n_gold", "n_predicted", "n_same", _R("precision", 5).alias("precision"), _R("recall", 5).alias("recall"), _R("f1", 5).alias("f1"))


def page_sections(spark, d):
    """Lines of articles with the section of the heading before them, where a heading is a line that names one."""
    lines = table(spark, d, "scrapper").filter("descricao is not null").select("rec_id", F.posexplode(F.split("descricao", "\n")).alias("no", "text")).withColumn("text", F.trim("text")).filter("text <> ''")
    return pages.sections(lines, "rec_id", is_heading=F.lower("text").isin("sintomas", "causas", "tratamento", "prevenção")).select("rec_id", "no", "section", "text")


def page_dates(spark, d):
    return table(spark, d, "scrapper").select("rec_id", T.extract_date(F.col("data")).alias("date"))


def map_key_counts(spark, d):
    e = table(spark, d, "events").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("k"))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def list_counts(spark, d):
    s = table(spark, d, "scrapper").select(F.explode(F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("causas", "sintomas", "tratamento")))).alias("item"))
    return s.groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "item").limit(10)


def presence_counts(spark, d):
    s = table(spark, d, "scrapper")
    return s.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.size(c) > 0).alias(c) for c in ("causas", "sintomas", "tratamento")), F.count_if(F.col("descricao").isNotNull()).alias("descricao"))


def _hits(spark, d) -> DataFrame:
    a = table(spark, d, "answer_question").filter("retrieval_score is not null and not isnan(retrieval_score)").groupBy("question_id", "chunk_id").agg(F.min("question").alias("question"), F.max("retrieval_score").alias("score"), F.max("qa_score").alias("qa"))
    top = retrieve.top_k(a, "question_id", F.col("score"), F.col("chunk_id"), 8)
    return top.join(table(spark, d, "chunks").select("chunk_id", "doc_id", "title", "type", "artist", "source", "url", "text"), "chunk_id")


def metadata_answer(spark, d):
    """Three kinds of question about every page."""
    c = table(spark, d, "corpus").filter("title is not null").select("crawl_id", "title", "type", "artist", F.explode(F.array(F.concat(F.lit("Who released "), "title", F.lit("?")), F.lit("Which album was it?"), F.lit("What genre is it?"))).alias("question"))
    return c.select("crawl_id", "question", qa.metadata_answer(F.col("question"), F.col("type"), F.col("title"), F.col("artist")).alias("answer")).filter("answer is not null")


def evidence_sentences(spark, d):
    return qa.evidence_sentences(_hits(spark, d), "question_id", "question", "title", "text")


def explanations(spark, d):
    q = table(spark, d, "answer_question").groupBy("question_id").agg(F.min("question").alias("question"))
    return qa.explanations(evidence_sentences(spark, d), q, "question_id", "question")


def ranked_answers(spark, d):
    h = _hits(spark, d).withColumn("qa", F.when(~F.isnan("qa"), F.col("qa")))
    return qa.ranked_answers(h.withColumn("answer", F.coalesce("artist", "title")), "question_id", "answer", "qa", "score", "chunk_id").select("question_id", "place", "answer", _R("final_score").alias("final_score"))


def span_search(spark, d):
    """Vectors as logits: starts as they are, ends reversed."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("s"), F.reverse("embedding").alias("e"))
    return qa.best_span(e, "vec_id", "s", "e").select("vec_id", "span_start", "span_end", _R("score", 5).alias("score"))


def question_terms(spark, d):
    q = table(spark, d, "answer_question").groupBy("question_id").agg(F.min("question").alias("question"))
    return q.select("question_id", F.explode(qa.question_terms(F.col("question"))).alias("term"))


def word_neighbours(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    s = retrieve.dense_scores(e, "vec_id", "embedding", q, "query_id", "qv", 6).filter("query_id <> vec_id")
    return retrieve.top_k(s, "query_id", _R("score"), F.col("vec_id"), 5).select("query_id", "rank", "vec_id")


def odd_one_out(spark, d):
    return embed.odd_one_out(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", _R("score", 5).alias("score"))


def analogy(spark, d):
    """a - b + c for each vector with the two after it, for ids divisible by 20; the three left out of the answers."""
    e = table(spark, d, "embeddings")
    ids = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"))
    parts = ids.select("query_id", F.explode(F.array(*(F.struct((F.col("query_id") + i).alias("vec_id"), F.lit(sign).alias("sign")) for i, sign in ((0, 1.0), (1, -1.0), (2, 1.0))))).alias("p")).select("query_id", "p.vec_id", "p.sign")
    q = embed.analogy_vectors(e, "vec_id", "embedding", parts, "query_id")
    s = retrieve.dense_scores(e, "vec_id", "embedding", q, "query_id", "vec", 8).filter("vec_id < query_id or vec_id > query_id + 2")
    return retrieve.top_k(s, "query_id", _R("score"), F.col("vec_id"), 3).select("query_id", "rank", "vec_id", _R("score", 5).alias("score"))


def pca2(spark, d):
    return embed.projected(table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", _R(F.abs(F.get("xy", F.lit(0))), 4).alias("x"), _R(F.abs(F.get("xy", F.lit(1))), 4).alias("y"))


def hashed_vectors(spark, d):
    """Terms hashed by the first digits of their MD5, which SQL has, too."""
    by = lambda t: F.conv(F.substring(F.md5(t), 1, 12), 16, 10).cast("long")
    v = embed.hashed_vectors(_docs(spark, d).select("doc_id", T.tokens_b(F.col("text")).alias("t")), "doc_id", "t", hashed=by)
    return v.select("doc_id", F.posexplode("vec").alias("pos", "x")).filter("x <> 0").select("doc_id", "pos", _R("x", 5).alias("x"))


def token_counts(spark, d):
    """Tokens of each document by each of the tokenizers."""
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.size(T.tokens_a(t)).alias("a"), F.size(T.tokens_b(t)).alias("b"), F.size(T.tokens_c(t)).alias("c"), F.coalesce(F.size(T.tokens_d(t, STOP_D)), F.lit(-1)).alias("d"))


def top_words(spark, d):
    t = _docs(spark, d).select(F.explode(T.tokens_b(F.col("text"))).alias("word"))
    return t.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(30)


def back_matter(spark, d):
    """Every page with a back matter put after it, which is cut again where the page is long enough."""
    c = table(spark, d, "corpus").filter("text is not null").select("crawl_id", F.concat("text", F.lit(" See also these. References 1")).alias("t"))
    return c.select("crawl_id", F.length(T.cut_back_matter(F.col("t"))).alias("chars"))


def normalized_answers(spark, d):
    return table(spark, d, "eval_items").select("item_id", T.normalize_answer(F.col("text")).alias("answer"))


def latex_texts(spark, d):
    return table(spark, d, "corpus_audit").filter("title is not null").select("crawl_id", T.latex_escape(F.concat("title", F.lit(" 5% & {x}_\\"))).alias("latex"))


def aligned_labels(spark, d):
    """Words of eval_items cut into pieces of four characters; each word's first piece keeps its label."""
    w = T.words(F.col("text"))
    pieces = F.flatten(F.transform(w, lambda x, i: F.array_repeat(i, F.ceil(F.length(x) / 4.0).cast("int"))))
    labels = F.transform(w, lambda x: F.when(T.has(x, "^[A-Z]"), 1).otherwise(0))
    a = F.filter(T.align_labels(labels, pieces), lambda x: x != -100)
    return table(spark, d, "eval_items").select("item_id", F.size(a).alias("kept"), F.aggregate(a, F.lit(0), lambda s, x: s + x).alias("capitals"))


def index_articles(spark, d):
    """Index rows with their article, the fallback where it lacks."""
    s = table(spark, d, "scrapper")
    index = s.groupBy("letra", "url").agg(F.min("nome").alias("nome"), F.min("descricao_pequena").alias("descricao"))
    articles = s.groupBy("url").agg(F.max("descricao").alias("descricao"), F.max("nome").alias("nome"))
    return pages.with_articles(index, articles, "url", ["nome", "descricao"]).select("letra", "url", "nome", F.length("descricao").alias("chars"))


def text_lines_json(spark, d):
    """Every counted name as one JSON object; NULL fields are left out."""
    p = table(spark, d, "personagens_final").filter("livro_id is not null and personagem is not null")
    return sinks.as_json(p, "livro_id", "personagem")


_ALL = [
    tfidf_idf, tfidf_weights, tfidf_rank, bm25_rank, bm25_unique_docs, dense_topk, hybrid_rank, hybrid_filtered, confidence_flag, doc_centroid, chunk_documents, chunk_counts, clean_citations, clean_documents, clean_for_chunks,
    slugs, url_domains, link_scores, sentences, valid_sentences, candidate_sentences, bigrams, trigrams, context_counts, vocab_size, sentence_lm_score, diverse_top3, cooccurrence_nodes, cooccurrence_edges, strong_edges, top15_subgraph,
    node_sizes, audit_flags, exact_duplicates, repair_docs, corpus_distribution, chunks_consistency, eval_retrieval, token_f1, entity_filter, entity_report, entity_counts, iob_spans, span_f1, page_sections, page_dates, map_key_counts, list_counts,
    presence_counts, metadata_answer, evidence_sentences, explanations, ranked_answers, span_search, question_terms, word_neighbours, odd_one_out, analogy, pca2, hashed_vectors, token_counts, top_words, back_matter,
    normalized_answers, latex_texts, aligned_labels, index_articles, text_lines_json,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import answering

    return {f.__name__: f for f in [*_ALL, *answering.ALL]}
