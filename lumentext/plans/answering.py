"""Queries of answers, features, metrics and rendered texts over the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import answering, audit, embed, evaluate, features, graph, models, ner, stats
from ..operators.layout import reconstruct_lines
from ..session import spread, table
from ..sources import sinks
from . import oracles as O
from . import queries as Q

_R = Q._R
#: Groups of the drawn names: a parameter of the example.
GROUPS = {"Teresa": "protagonistas", "Hugo": "aliados", "Ruth": "antagonistas"}
DEMO = [("Who released Blonde?", "album", "Extractive"), ("What is a song?", "artist", "Both")]


# answers


def _reader():
    """Logits made of the words' lengths, the first six words outside the context: a stand-in for a model."""

    def logits(asked):
        w = T.words(F.col("context"))
        return asked.withColumn("tokens", w).select(
            "question_id", "chunk_id", "tokens", F.transform("tokens", lambda t: F.pmod(F.length(t), F.lit(7)).cast("double")).alias("starts"),
            F.transform("tokens", lambda t: F.pmod(F.length(t), F.lit(5)).cast("double")).alias("ends"), F.transform("tokens", lambda t, i: i >= 6).alias("inside"),
        )

    return answering.logit_reader(logits, ["question_id", "chunk_id"])


def extractive_answers(spark, d):
    a = answering.extractive_answers(Q._hits(spark, d), "question_id", "question", _reader())
    return a.select("question_id", "place", "answer", _R("final_score", 5).alias("final_score"), "answer_method", "chunk_id")


def _generator():
    """A stand-in for a model: the prompt's last two hundred characters, or nothing for every prompt of an even length."""
    return lambda prompts: [p[-200:].strip() if len(p) % 2 else "" for p in prompts]


def _asked(spark, d):
    """Hits whose question is, for every third question, one for an explanation."""
    why = F.concat(F.lit("Explain why "), F.coalesce("title", F.lit("it")), F.lit(" is considered important."))
    h = Q._hits(spark, d)
    first = h.filter("rank = 1").select("question_id", F.when(F.col("question_id") % 3 == 0, why).otherwise(F.col("question")).alias("q"))
    return h.join(first, "question_id").withColumn("question", F.coalesce("q", "question")).drop("q")


def abstractive_answers(spark, d):
    return answering.abstractive_answers(_asked(spark, d), "question_id", "question", _generator).select("question_id", "answer", "answer_method")


def answer_methods(spark, d):
    return answering.answer_methods(abstractive_answers(spark, d))


def generator_prompts(spark, d):
    return answering.prompts(_asked(spark, d), "question_id", "question").select("question_id", "prompt")


def retrieved_texts(spark, d):
    return answering.retrieved_texts(Q._hits(spark, d), "question_id")


def qa_contexts(spark, d):
    c = table(spark, d, "chunks")
    return c.select("chunk_id", T.qa_context(F.col("title"), F.col("type"), F.col("source"), F.col("artist"), F.col("text")).alias("context"))


def embedding_texts(spark, d):
    return table(spark, d, "chunks").select("chunk_id", T.embedding_text(F.col("title"), F.col("type"), F.col("text")).alias("text"))


def example_questions(spark, d):
    q = table(spark, d, "answer_question").groupBy("question").agg(F.min("question_id").alias("i")).select("question", F.when(F.col("i") % 2 == 0, "album").alias("filter_type"))
    return answering.example_questions(spark.createDataFrame(DEMO, "question string, filter_type string, mode string"), q.filter("question is not null"))


# metrics and features


def _predicted(spark, d):
    """The audited title as the answer, the crawled one and it in reverse order of words as references."""
    t = table(spark, d, "corpus_audit").select("crawl_id", F.col("title").alias("p")).join(table(spark, d, "corpus").select("crawl_id", "title"), "crawl_id")
    return t.withColumn("refs", F.array(F.coalesce("title", F.lit("")), F.array_join(F.reverse(T.words(F.coalesce("title", F.lit("")))), " ")))


def mean_answers(spark, d):
    return evaluate.mean_answers(_predicted(spark, d), "crawl_id", "p", "refs")


def metric_deltas(spark, d):
    """How far the second reference alone falls short of both."""
    p = _predicted(spark, d)
    one = evaluate.mean_answers(p.withColumn("refs", F.slice("refs", 2, 1)), "crawl_id", "p", "refs")
    return evaluate.metric_deltas(evaluate.mean_answers(p, "crawl_id", "p", "refs"), one, [], ["exact_match", "f1"])


def token_accuracy(spark, d):
    t = Q._tagged(spark, d)
    p = t.withColumn("tag", F.when(F.length("token") > 9, "O").otherwise(F.col("tag")))
    return evaluate.token_accuracy(t, p).select("tokens", "same", _R("accuracy", 5).alias("accuracy"))


def label_ids(spark, d):
    return features.label_ids(Q._tagged(spark, d), "tag")


def argmax_spans(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("s"), F.reverse("embedding").alias("e"))
    return features.argmax_span(e, "vec_id", "s", "e")


def qa_features(spark, d):
    """Every document as a context whose fifth word is the answer; short windows, so that long texts have several."""
    x = spread(table(spark, d, "documents").select("doc_id", T.norm_spaces(F.col("text")).alias("text"))).filter("text is not null")
    w = T.words(F.col("text"))
    x = x.select("doc_id", "text", F.lit("Which word is it ?").alias("q"), F.get(w, F.lit(4)).alias("answer"), F.length(F.array_join(F.slice(w, 1, 4), " ")).alias("before"))
    x = x.withColumn("at", F.when(F.col("answer").isNotNull(), F.col("before") + 1))
    return features.qa_features(x, "doc_id", "q", "text", "at", "answer", max_length=48, stride=10)


def encoded_words(spark, d):
    """Words of eval_items in pieces of four characters, at most 40 of them; capitals are labelled 1."""
    w = T.words(F.col("text"))
    x = table(spark, d, "eval_items").select("item_id", w.alias("w"), F.transform(w, lambda t: F.when(T.has(t, "^[A-Z]"), 1).otherwise(0)).alias("l"))
    e = features.encoded_words(x, "item_id", "w", "l", lambda t: F.regexp_extract_all(t, F.lit(r"(?s).{1,4}"), F.lit(0)), 40)
    return e.select("item_id", F.array_join("pieces", "|").alias("pieces"), F.array_join(F.transform("labels", lambda i: i.cast("string")), ",").alias("labels"))


def model_vectors(spark, d):
    """A stand-in for an encoder: counts of five vowels."""

    def make():
        return lambda texts: [[float(t.count(c)) for c in "aeiou"] for t in texts]

    v = models.encoded(table(spark, d, "eval_items"), "item_id", "text", make)
    return v.select("item_id", *(_R(F.get("vec", F.lit(i)), 5).alias(c) for i, c in enumerate("aeiou")))


# books, sentences, statistics


def book_sentences(spark, d):
    x = spread(table(spark, d, "documents").select("doc_id", "text").filter("text is not null"))
    return x.select("doc_id", F.posexplode(T.book_sentences(T.clean_book(F.concat(F.lit("Preface.\r\n"), F.when(F.col("doc_id") % 2 == 0, F.lit(V.BOOK_MARKER)).otherwise(""), F.lit("\n\n"), "text")))).alias("no", "sentence"))


def file_counts(spark, d):
    x = spread(table(spark, d, "documents").select("source", "text").filter("text is not null and source is not null"))
    return stats.file_counts(x, "source", T.book_sentences(T.clean_book(F.col("text"))), lambda s: T.tokens_d(s, Q.STOP_D))


def clean_sentences(spark, d):
    """Every cell behind one of the headings that run into sentences."""
    h = F.get(F.array(*map(F.lit, V.SENTENCE_ARTEFACTS)), F.pmod("sent_id", F.lit(len(V.SENTENCE_ARTEFACTS))).cast("int"))
    return Q._cells(spark, d).select("sent_id", T.clean_sentence(F.concat(h, F.lit(" "), "sentence")).alias("sentence"))


def joined_headings(spark, d):
    h = F.get(F.array(*map(F.lit, V.JOINED_HEADINGS)), F.pmod("sent_id", F.lit(len(V.JOINED_HEADINGS))).cast("int"))
    return Q._cells(spark, d).select("sent_id", T.replace_all(F.concat(h, F.lit(" "), "sentence"), V.JOINED_HEADINGS).alias("text"))


def lang_trailing(spark, d):
    code = F.get(F.array(*map(F.lit, ["es", "EN", "pt", "fr", ""])), F.pmod("rec_id", F.lit(5)).cast("int"))
    return table(spark, d, "scrapper").filter("nome is not null").select("rec_id", T.clean_lang_trailing(F.concat("nome", F.lit("  "), code)).alias("item"))


def most_common_bigrams(spark, d):
    return stats.most_common(Q.bigrams(spark, d), ["source_id"], 10)


def dense_tfidf(spark, d):
    """Weights of the thirty most frequent terms, a place for each."""
    counts = stats.term_counts(Q._docs(spark, d), "doc_id", T.tokens_c(F.col("text")))
    top = counts.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "term").limit(30)
    w = stats.tfidf_weights(Q._docs(spark, d), "doc_id", T.tokens_c(F.col("text")))
    v = stats.dense_vectors(w, "doc_id", [r.term for r in top.collect()])
    return v.select("doc_id", F.posexplode("vec").alias("pos", "x")).filter("x <> 0").select("doc_id", "pos", _R("x").alias("x"))


def pair_similarity(spark, d):
    e = table(spark, d, "embeddings")
    pairs = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))
    return embed.pair_similarity(e, "vec_id", "embedding", pairs).select("a", "b", _R("similarity", 5).alias("similarity"))


def word_experiments(spark, d):
    """A report on word vectors trained with the defaults: neighbours, similarities, odd words and analogies of frequent words."""
    t = Q._cells(spark, d).select(T.tokens_a(F.col("sentence")).alias("t"))
    counts = t.select(F.explode("t").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return embed.experiment_lines(embed.word_vectors(t, "t"), counts, ["the", "signal", "mission"], [("the", "signal"), ("the", "zzz")], [["signal", "mission", "the"]], [(["signal", "the"], ["mission"])])


# corpus, graph, texts


def first_usable_source(spark, d):
    """Crawls of a document as its external texts in their order, its last crawl as the encyclopaedia's."""
    c = table(spark, d, "corpus").filter("doc_id is not null").select("doc_id", "crawl_id", "url", "wikipedia_url", "text")
    wiki = c.groupBy("doc_id").agg(F.max_by(F.struct(F.col("wikipedia_url").alias("url"), "text"), "crawl_id").alias("x")).select("doc_id", "x.url", "x.text")
    r = audit.first_usable(c.withColumnRenamed("crawl_id", "place"), wiki, "doc_id")
    return r.select("doc_id", "source_type", "source", "url", F.length("text").alias("chars"))


def project_status(spark, d):
    dim = table(spark, d, "sbert_config").agg(F.max("embedding_dim")).first()[0]
    return audit.project_status(table(spark, d, "corpus"), table(spark, d, "chunks"), "embedding", dim)


def drawn_nodes(spark, d):
    n = Q.node_sizes(spark, d).select("livro_id", "name")
    f = table(spark, d, "personagens_final").groupBy("livro_id", F.col("personagem").alias("name")).agg(F.max("frequencia").alias("freq"))
    return graph.drawn_nodes(n, f, spark.createDataFrame(list(GROUPS.items()), "name string, grp string"), ["livro_id"])


def drawn_edges(spark, d):
    return graph.drawn_edges(Q.strong_edges(spark, d))


def latex_entities(spark, d):
    return sinks.latex_entities(Q.entity_filter(spark, d))


def latex_sources(spark, d):
    """A bibliography of the pages; every second one without its link."""
    c = table(spark, d, "corpus")
    url = F.when(F.col("crawl_id") % 2 == 0, F.col("url"))
    return c.select("crawl_id", sinks.latex_source(F.col("title"), F.col("artist"), F.when(F.col("crawl_id") % 3 == 0, F.lit("2024")), url, F.col("section")).alias("entry"))


def latex_sentences(spark, d):
    g = Q._cells(spark, d).groupBy("source_id").agg(F.array_sort(F.collect_list("sentence")).alias("s"))
    return g.select("source_id", sinks.latex_items(F.slice("s", 1, 3)).alias("items"))


def layout_lines(spark, d):
    """Lines of articles as fragments twenty units apart, each in two pieces at one height."""
    lines = table(spark, d, "scrapper").filter("descricao is not null").select("rec_id", F.posexplode(F.split("descricao", "\n")).alias("no", "line"))
    w = T.words(F.col("line"))
    cut = F.floor(F.size(w) / 2).cast("int")
    parts = F.array(F.struct(F.lit(0).alias("i"), F.array_join(F.slice(w, 1, cut), " ").alias("t")), F.struct(F.lit(1).alias("i"), F.array_join(F.slice(w, cut + 1, F.size(w)), " ").alias("t")))
    f = lines.select(F.col("rec_id").alias("doc_id"), "no", F.explode(parts).alias("p")).select("doc_id", F.lit(1).alias("page"), (100 + 20 * F.col("no")).alias("top"), (50 + 10 * F.col("p.i")).alias("left"), F.col("p.t").alias("txt"), F.lit(False).alias("bold"), F.lit(False).alias("italic"))
    return reconstruct_lines(f).select("doc_id", "line_no", "top", "text")


ALL = [
    extractive_answers, abstractive_answers, answer_methods, generator_prompts, retrieved_texts, qa_contexts, embedding_texts, example_questions, mean_answers, metric_deltas, token_accuracy, label_ids, argmax_spans,
    qa_features, encoded_words, model_vectors, book_sentences, file_counts, clean_sentences, joined_headings, lang_trailing, most_common_bigrams, dense_tfidf, pair_similarity, word_experiments, first_usable_source, project_status,
    drawn_nodes, drawn_edges, latex_entities, latex_sources, latex_sentences, layout_lines,
]


_ASKED = (
    O._HITS.replace("h AS (", "h0 AS (")
    + """, x0 AS (SELECT question_id, CASE WHEN question_id % 3 = 0 THEN 'Explain why ' || coalesce(title, 'it') || ' is considered important.' ELSE question END AS q FROM h0 WHERE rank = 1),
h AS (SELECT h0.* REPLACE (coalesce(q, question) AS question) FROM h0 JOIN x0 USING (question_id))"""
)


def _why(q: str) -> str:
    return f"(starts_with(lower({q}), 'why') OR starts_with(lower({q}), 'how') OR starts_with(lower({q}), 'explain') OR {O._any(f'lower({q})', ['important', 'significant', 'influence', 'impact'])})"


def _meta(q: str) -> str:
    return f"CASE WHEN contains(lower({q}), 'who released') AND type = 'album' AND artist <> '' THEN artist WHEN (contains(lower({q}), 'which album') OR contains(lower({q}), 'what album')) AND type = 'album' THEN title WHEN contains(lower({q}), 'what genre') AND type = 'genre' THEN title END"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CONTEXT = "'The document title is ' || title || '. The document type is ' || type || '. The source is ' || source || '.' || CASE WHEN artist <> '' THEN ' The artist associated with this document is ' || artist || '.' ELSE '' END || chr(10) || chr(10) || text"
_POST = f"trim(replace(replace(replace({O._strip('answer')}, ' Type', ''), ' Source', ''), ' Document', ''), ' .,:;!?\"\'\'()[]{{}}')"


def _explained(q: str, ev: str) -> str:
    """The explanation of a question from a list of evidence."""
    text = f"lower(array_to_string({ev}, ' '))"
    tests = [(O._any(text, some) if some else "(" + " AND ".join(f"contains({text}, '{x}')" for x in every) + ")", phrase) for every, some, phrase in V.SIGNALS]
    points = "list_filter([" + ", ".join(f"CASE WHEN {t} THEN {_q(phrase)} END" for t, phrase in tests) + "], lambda x: x IS NOT NULL)"
    subject = "coalesce(" + ", ".join(f"rtrim({O._strip(f'nullif(regexp_extract({q}, {_q(chr(40) + chr(63) + chr(105) + chr(41) + p)}, 1), {_q(str())})')}, '?.')" for p in V.SUBJECT_PATTERNS) + ", 'The subject of this question')"
    n = f"len({points})"
    listed = f"CASE WHEN {n} = 1 THEN ({points})[1] ELSE array_to_string(({points})[1:{n} - 1], ', ') || ' and ' || ({points})[{n}] END"
    top = O._strip(f"({ev})[1]")
    return f"""CASE WHEN coalesce(len({ev}), 0) = 0 THEN 'The retrieved documents do not contain enough information to answer this question.'
 WHEN {n} = 0 THEN CASE WHEN len({top}) > 20 THEN 'Based on the retrieved documents: ' || {top} ELSE 'The retrieved documents do not provide a clear explanation for this question.' END
 ELSE {subject} || ' is considered important due to ' || {listed} || ', as supported by the retrieved documents.' END"""


def _bad(a: str, q: str) -> str:
    low = O._strip(f"lower({a})")
    return f"({low} = '' OR len({O._words(low)}) < 8 OR ends_with({low}, '2016') OR ends_with({low}, '2015') OR contains({O._strip(f'lower({q})')}, {low}) OR {O._any(low, V.BAD_FRAGMENTS)})"


def _filled(template: str, **parts: str) -> str:
    out, rest = [], template
    for name, sql in parts.items():
        before, rest = rest.split("{" + name + "}", 1)
        out += [_q(before), f"coalesce({sql}, '')"]
    return " || ".join([*out, _q(rest)])


def _prompts(evidence: str) -> str:
    context = "string_agg('[Document ' || rank || ']' || chr(10) || 'Title: ' || title || chr(10) || 'Type: ' || type || CASE WHEN artist <> '' THEN chr(10) || 'Artist: ' || artist ELSE '' END || chr(10) || 'Source: ' || source || chr(10) || 'Text: ' || text, chr(10) || chr(10) ORDER BY rank)"
    return f"""WITH {_ASKED}, ev AS (SELECT question_id, string_agg('- Title: ' || title || '. Evidence: ' || sentence, chr(10) ORDER BY place) AS ev FROM ({evidence}) GROUP BY 1),
g AS (SELECT question_id, question, {context} AS ctx FROM h GROUP BY 1, 2),
pr AS (SELECT question_id, question, CASE WHEN {_why('question')} THEN {_filled(V.EXPLANATION_PROMPT, question='question', evidence='ev')} ELSE {_filled(V.CONTEXT_PROMPT, question='question', context='ctx')} END AS prompt FROM g LEFT JOIN ev USING (question_id))"""


def _latex(c: str) -> str:
    for a, b in (("\\", "\\textbackslash{}"), ("{", "\\{"), ("}", "\\}"), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}")):
        c = f"replace({c}, {_q(a)}, {_q(b)})"
    return c


def _replaced(c: str, pairs: dict[str, str]) -> str:
    for a, b in pairs.items():
        c = f"replace({c}, {_q(a)}, {_q(b)})"
    return c


def _cleaned() -> str:
    """The passes over a document, lines joined by islands: a line begins one unless it goes on with the line before."""
    word = "[\\p{L}\\p{M}\\p{N}_]"
    title = "regexp_matches(x, '^\\P{L}*\\p{Lu}\\p{Ll}*(?:\\P{L}+\\p{Lu}\\p{Ll}*)*\\P{L}*$')"
    keep = lambda x, bad: f"array_to_string(list_filter({x}, lambda x: {O._strip('x')} = '' OR NOT ({bad})), chr(10))"
    basic = "regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\x{A0}', ' ', 'g')"
    basic = f"regexp_replace(regexp_replace({basic}, '[%\\x{{FFFE}}]', '', 'g'), '[^\\x00-\\x7F\\x{{C0}}-\\x{{24F}}’‘“”–—]', '', 'g')"
    basic = f"regexp_replace({basic}, '\\[\\d+\\]|\\[update\\]|\\[note\\s*\\d*\\]', '', 'g')"
    noise = " OR ".join([f"x IN {O._in(V.NOISE_LINES)}", *(f"regexp_matches(x, {_q(p)})" for p in V.NOISE_PATTERNS)])
    contents = f"regexp_matches({O._strip('x')}, '\\.{{5,}}\\s*\\d+\\s*$') OR (regexp_matches({O._strip('x')}, '^\\d+(\\.\\d+)*\\s+.+$') AND contains(lower(x), 'strategy'))"
    blanks = f"(len({O._strip('x')}) - len(replace({O._strip('x')}, ' ', '')))"
    letters = f"len(regexp_replace({O._strip('x')}, '\\P{{L}}', '', 'g'))"
    corrupt = f"regexp_matches({O._strip('x')}, '^(?:https?://|\\(https://|\\d+\\s+ESA/|\\d+\\s+EL3)') OR regexp_matches({O._strip('x')}, '(?:\\b[A-Za-z]\\b\\s+){{8,}}') OR ({letters} > 20 AND {blanks} > {letters} * 0.7)"
    return f"""WITH a AS (SELECT crawl_id, {basic} AS t FROM corpus WHERE text IS NOT NULL),
b AS (SELECT crawl_id, {keep("list_transform(string_split(t, chr(10)), lambda y: " + O._strip('y') + ")", noise)} AS t FROM a),
c AS (SELECT crawl_id, regexp_replace({keep("string_split(t, chr(10))", contents)}, '({word})-\\n({word})', '\\1\\2', 'g') AS t FROM b),
l0 AS (SELECT crawl_id, list_transform(string_split(t, chr(10)), lambda y: {O._strip('y')}) AS ls FROM c),
l AS (SELECT crawl_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM l0),
n AS (SELECT *, CASE WHEN i = 0 OR x = '' OR regexp_matches(lag(x) OVER w, '[.!?:;]$') OR regexp_matches(x, '^[•\\-*]') OR (len({O._words('x')}) <= 5 AND {title}) THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY crawl_id ORDER BY i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY crawl_id ORDER BY i) AS g FROM n),
j AS (SELECT crawl_id, g, string_agg(x, ' ' ORDER BY i) AS x FROM g GROUP BY 1, 2),
d AS (SELECT crawl_id, {_replaced("string_agg(x, chr(10) ORDER BY g)", V.JOINED_HEADINGS)} AS t FROM j GROUP BY 1),
e AS (SELECT crawl_id, {keep("string_split(t, chr(10))", corrupt)} AS t FROM d)
SELECT crawl_id, {O._strip("regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} || chr(10) AS text FROM e"""


def _diverse(core: dict[str, str]) -> str:
    kept = core["candidate_sentences"].split(" FROM w WHERE ", 1)[1]
    jac = lambda a, b: f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"
    best = "SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, sent_id) = 1"
    left = "SELECT {0}.* FROM {0} JOIN {1} USING (source_id) WHERE {0}.sent_id <> {1}.sent_id AND " + jac("{0}.t", "{1}.t") + " <= 0.2"
    return (
        O._LM
        + f""", w AS (SELECT sent_id, source_id, s, len(string_split(s, ' ')) AS k, lower(s) AS l FROM cells), q0 AS (SELECT source_id, sent_id, round(score, 4) AS score, list_distinct(regexp_extract_all(l, '[a-z]+(?:''[a-z]+)?|\\d+')) AS t FROM w JOIN lm USING (source_id, sent_id) WHERE {kept}),
b1 AS ({best.format('q0')}), q1 AS ({left.format('q0', 'b1')}), b2 AS ({best.format('q1')}), q2 AS ({left.format('q1', 'b2')}), b3 AS ({best.format('q2')})
SELECT source_id, 1 AS place, sent_id, score FROM b1 UNION ALL SELECT source_id, 2, sent_id, score FROM b2 UNION ALL SELECT source_id, 3, sent_id, score FROM b3"""
    )


def sql() -> dict[str, str]:
    core = O.oracle_sql()
    asked = core["evidence_sentences"].replace(O._HITS, _ASKED)
    ev_list = "SELECT question_id, list('Title: ' || title || '. Evidence: ' || sentence ORDER BY place) AS ev FROM ({0}) GROUP BY 1"
    refs = f"""x AS (SELECT a.crawl_id, coalesce(a.title, '') AS p, unnest([coalesce(c.title, ''), array_to_string(list_reverse({O._words("coalesce(c.title, '')")}), ' ')]) AS t, unnest([1, 2]) AS i FROM corpus_audit a JOIN corpus c USING (crawl_id)),
n AS (SELECT crawl_id, i, {O._NA('p')} AS p, {O._NA('t')} AS t FROM x), l AS (SELECT *, list_filter(string_split(p, ' '), lambda w: w <> '') AS pl, list_filter(string_split(t, ' '), lambda w: w <> '') AS tl FROM n),
pc AS (SELECT crawl_id, i, w, count(*) AS n FROM (SELECT crawl_id, i, unnest(pl) AS w FROM l) GROUP BY 1, 2, 3), tc AS (SELECT crawl_id, i, w, count(*) AS n FROM (SELECT crawl_id, i, unnest(tl) AS w FROM l) GROUP BY 1, 2, 3),
s AS (SELECT crawl_id, i, sum(least(pc.n, tc.n)) AS s FROM pc JOIN tc USING (crawl_id, i, w) GROUP BY 1, 2),
f AS (SELECT crawl_id, i, (p = t)::INT AS em, CASE WHEN s IS NULL THEN 0.0::DOUBLE ELSE (2.0::DOUBLE * s) / (len(pl) + len(tl)) END AS f1 FROM l LEFT JOIN s USING (crawl_id, i))"""
    mean = "SELECT round(100 * avg(em), 2) AS exact_match, round(100 * avg(f1), 2) AS f1, count(*) AS samples FROM (SELECT crawl_id, max(em) AS em, max(f1) AS f1 FROM f {0} GROUP BY 1)"
    book = f"lower(CASE WHEN instr({{0}}, {_q(V.BOOK_MARKER)}) > 0 THEN {{0}}[instr({{0}}, {_q(V.BOOK_MARKER)}):] ELSE {{0}} END)"
    split = f"list_filter(list_transform(regexp_split_to_array(regexp_replace({{0}}, '[^{V.BOOK_LETTERS}.!?]+', ' ', 'g'), '[.!?]+'), lambda s: trim(s)), lambda s: s <> '')"
    raw = f"replace('Preface.' || chr(13) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN {_q(V.BOOK_MARKER)} ELSE '' END || chr(10) || chr(10) || text, chr(13) || chr(10), chr(10))"
    tok_d = f"list_filter({O._words('s')}, lambda w: len(w) > 2 AND w NOT IN {O._in(Q.STOP_D)})"
    heading = lambda pairs: f"{O._list(pairs)}[(sent_id % {len(pairs)}) + 1] || ' ' || s"
    spans = f"""WITH {O._HITS}, m AS (SELECT *, {_meta('question')} AS meta, {_CONTEXT} AS ctx FROM h),
x AS (SELECT question_id, chunk_id, {O._words('ctx')} AS w FROM m WHERE meta IS NULL), t AS (SELECT question_id, chunk_id, unnest(range(len(w))) AS i, unnest(w) AS tok FROM x),
e AS (SELECT question_id, chunk_id, i, CASE WHEN i >= 6 THEN (len(tok) % 7)::DOUBLE ELSE -1e9 END AS s, CASE WHEN i >= 6 THEN (len(tok) % 5)::DOUBLE ELSE -1e9 END AS e FROM t),
p AS (SELECT *, exp(s - max(s) OVER k) / sum(exp(s)) OVER k * exp(max(s) OVER k) AS ps, exp(e - max(e) OVER k) / sum(exp(e)) OVER k * exp(max(e) OVER k) AS pe FROM e WINDOW k AS (PARTITION BY question_id, chunk_id)),
a1 AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY s DESC, i) <= 10), b1 AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY e DESC, i) <= 10),
j AS (SELECT a1.question_id, a1.chunk_id, a1.i AS st, b1.i AS en, round(a1.ps * b1.pe, 12) AS score FROM a1 JOIN b1 USING (question_id, chunk_id) WHERE b1.i >= a1.i AND b1.i - a1.i < 30),
b AS (SELECT question_id, chunk_id, array_to_string(w[st + 1:en + 1], ' ') AS answer, score FROM j JOIN x USING (question_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY score DESC, st, en) = 1),
c AS (SELECT question_id, chunk_id, rank, meta AS answer, 1.0::DOUBLE AS qs, score AS rs, 'metadata' AS how FROM m WHERE meta IS NOT NULL UNION ALL SELECT question_id, chunk_id, rank, b.answer, b.score, m.score, 'model' FROM m JOIN b USING (question_id, chunk_id)),
d AS (SELECT question_id, chunk_id, rank, {_POST} AS answer, 0.7 * qs + 0.3 * rs AS f, how FROM c),
o AS (SELECT * FROM d WHERE answer <> '' QUALIFY row_number() OVER (PARTITION BY question_id, lower(answer) ORDER BY round(f, 9) DESC, rank) = 1)
SELECT question_id, place, answer, round(f, 5) AS final_score, how AS answer_method, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(f, 9) DESC, rank)::INT AS place FROM o) WHERE place <= 5"""
    answers = (
        _prompts(asked)
        + f""", m AS (SELECT question_id, {_meta('question')} AS meta FROM h WHERE rank = 1), el AS ({ev_list.format(asked)}),
raw AS (SELECT pr.*, meta, ev, CASE WHEN len(prompt) % 2 = 1 THEN {O._strip('prompt[-200:]')} ELSE '' END AS r FROM pr LEFT JOIN m USING (question_id) LEFT JOIN el USING (question_id)),
gen AS (SELECT *, {O._strip("trim(trim(r, chr(34)), chr(39))")} AS a FROM raw),
ans AS (SELECT question_id, CASE WHEN meta IS NOT NULL THEN meta WHEN {_why('question')} AND {_bad('a', 'question')} THEN {_explained('question', 'ev')} ELSE a END AS answer,
 CASE WHEN meta IS NOT NULL THEN 'metadata' WHEN {_why('question')} AND {_bad('a', 'question')} THEN 'evidence_synthesis' ELSE 'generative' END AS answer_method FROM gen)
"""
    )
    md = "CASE WHEN coalesce(url, '') = '' THEN title ELSE '[' || replace(replace(title, '[', '\\['), ']', '\\]') || '](' || url || ')' END"
    return {
        "extractive_answers": spans,
        "generator_prompts": _prompts(asked) + " SELECT question_id, prompt FROM pr",
        "abstractive_answers": answers + "SELECT * FROM ans",
        "answer_methods": answers + "SELECT answer_method, count(*) AS n FROM ans GROUP BY 1",
        "explanations": f"WITH q AS (SELECT question_id, min(question) AS question FROM answer_question GROUP BY 1), e AS ({ev_list.format(core['evidence_sentences'])}) SELECT question_id, {_explained('question', 'ev')} AS answer FROM q LEFT JOIN e USING (question_id)",
        "retrieved_texts": f"""WITH {O._HITS}, u AS (SELECT h.*, c.url FROM h JOIN chunks c USING (chunk_id)), b AS (SELECT question_id, rank, '**#' || rank || ' ' || {md} || '** (' || type || ')' || chr(10) || 'Final score: `' || printf('%.4f', round(score, 4)) || '`' || chr(10) || 'Source: ' || coalesce(source, 'unknown') || chr(10) || chr(10) || '> ' || replace(text[1:300], chr(10), ' ') || '…' || chr(10) AS b FROM u)
SELECT question_id, string_agg(b, chr(10) ORDER BY rank) AS text FROM b GROUP BY 1""",
        "qa_contexts": f"SELECT chunk_id, {_CONTEXT} AS context FROM chunks",
        "embedding_texts": "SELECT chunk_id, title || ' (' || type || '). ' || text AS text FROM chunks",
        "example_questions": f"""WITH q AS (SELECT question, min(question_id) AS i FROM answer_question WHERE question IS NOT NULL GROUP BY 1), d AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in DEMO)}) AS v(question, filter_type, mode))
SELECT * FROM d UNION ALL SELECT question, CASE WHEN i % 2 = 0 THEN 'album' ELSE '(all types)' END, CASE WHEN starts_with(lower(question), 'explain') OR starts_with(lower(question), 'why') OR starts_with(lower(question), 'what is') THEN 'Abstractive' ELSE 'Both' END FROM q ANTI JOIN d USING (question)""",
        "mean_answers": f"WITH {refs} " + mean.format(""),
        "metric_deltas": f"WITH {refs}, a AS ({mean.format('')}), b AS ({mean.format('WHERE i = 2')}) SELECT round(a.exact_match - b.exact_match, 2) AS exact_match, round(a.f1 - b.f1, 2) AS f1 FROM a, b",
        "token_accuracy": O._TAG + """ok AS (SELECT len(token) > 9 AND kind IS NOT NULL AS wrong FROM t2) SELECT count(*) AS tokens, count(*) FILTER (WHERE NOT wrong) AS same, round(count(*) FILTER (WHERE NOT wrong) / count(*)::DOUBLE, 5) AS accuracy FROM ok""",
        "label_ids": O._TAG + """l AS (SELECT DISTINCT CASE WHEN kind IS NULL THEN 'O' WHEN lag(kind) OVER (PARTITION BY sent_id ORDER BY pos) IS NOT DISTINCT FROM kind THEN 'I-' || kind ELSE 'B-' || kind END AS label FROM t2) SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS id FROM l""",
        "argmax_spans": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS span_start, greatest(list_position(embedding, list_max(embedding)) - 1, list_position(list_reverse(embedding), list_max(embedding)) - 1)::INT AS span_end FROM embeddings",
        "qa_features": f"""WITH d AS (SELECT doc_id, {O._words('text')} AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT *, greatest(ceil((len(w) - 40) / 30.0), 0)::INT AS k FROM d),
x AS (SELECT doc_id, w, unnest(range(k + 1))::INT AS "window" FROM s), y AS (SELECT doc_id, "window", ("window" * 30)::INT AS first, len(w[("window" * 30) + 1:("window" * 30) + 40])::INT AS n, len(w) AS nw FROM x)
SELECT doc_id, "window", first, n, CASE WHEN first <= 4 AND nw >= 5 THEN 4 - first + 7 ELSE 0 END::INT AS start_position, CASE WHEN first <= 4 AND nw >= 5 THEN 4 - first + 7 ELSE 0 END::INT AS end_position FROM y""",
        "encoded_words": f"""WITH w AS (SELECT item_id, {O._words('text')} AS w FROM eval_items), p AS (SELECT item_id, list_transform(w, lambda t: regexp_extract_all(t, '(?s).{{1,4}}')) AS ps, w FROM w),
f AS (SELECT item_id, flatten(ps)[:40] AS f, flatten(list_transform(ps, lambda x, i: list_transform(x, lambda y, j: CASE WHEN j > 1 THEN '-100' WHEN regexp_matches(w[i], '^[A-Z]') THEN '1' ELSE '0' END)))[:40] AS l FROM p)
SELECT item_id, array_to_string(f, '|') AS pieces, array_to_string(l, ',') AS labels FROM f""",
        "model_vectors": "WITH c AS (SELECT item_id, " + ", ".join(f"len(coalesce(text, '')) - len(replace(coalesce(text, ''), '{v}', '')) AS {v}" for v in "aeiou") + " FROM eval_items), n AS (SELECT *, sqrt(a * a + e * e + i * i + o * o + u * u) AS n FROM c) SELECT item_id, " + ", ".join(f"CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE round({v} / n, 5) END AS {v}" for v in "aeiou") + " FROM n",
        "book_sentences": f"WITH b AS (SELECT doc_id, {split.format(book.format('(' + raw + ')'))} AS ss FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(range(len(ss)))::INT AS no, unnest(ss) AS sentence FROM b",
        "file_counts": f"WITH b AS (SELECT source, unnest({split.format('lower(text)')}) AS s FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), t AS (SELECT source, {tok_d} AS t FROM b) SELECT source, count(*) AS sentences, count(*) FILTER (WHERE len(t) >= 3) AS usable, coalesce(sum(len(t)) FILTER (WHERE len(t) >= 3), 0)::BIGINT AS tokens FROM t GROUP BY 1",
        "clean_sentences": f"WITH {O._CELLS} SELECT sent_id, {O._strip(_replaced(heading(V.SENTENCE_ARTEFACTS), V.SENTENCE_ARTEFACTS))} AS sentence FROM cells",
        "joined_headings": f"WITH {O._CELLS} SELECT sent_id, {_replaced(heading(V.JOINED_HEADINGS), V.JOINED_HEADINGS)} AS text FROM cells",
        "lang_trailing": "SELECT rec_id, " + O._strip("regexp_replace(" + O._norm("nome || '  ' || ['es', 'EN', 'pt', 'fr', ''][rec_id % 5 + 1]") + ", '(?i) +(?:es|en|pt|la)$', '')") + " AS item FROM scrapper WHERE nome IS NOT NULL",
        "most_common_bigrams": O._GRAMS + "SELECT source_id, w1, w2, freq, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY freq DESC, w1, w2) AS place FROM f2) WHERE place <= 10",
        "dense_tfidf": O._TF + ", top AS (SELECT term FROM c GROUP BY 1 ORDER BY sum(k) DESC, term LIMIT 30), v AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::INT AS pos FROM top) SELECT doc_id, pos, round(w, 6) AS x FROM w JOIN v USING (term) WHERE w <> 0",
        "pair_similarity": f"SELECT p.vec_id AS a, p.vec_id + 1 AS b, round({O._COS.format('p.embedding', 'q.embedding')}, 5) AS similarity FROM embeddings p LEFT JOIN embeddings q ON q.vec_id = p.vec_id + 1",
        "first_usable_source": f"""WITH c AS (SELECT doc_id, crawl_id, url, {O._norm("regexp_replace(text, '\\[\\d+\\]', '', 'g')")} AS t FROM corpus WHERE doc_id IS NOT NULL AND text IS NOT NULL), e AS (SELECT * FROM c WHERE len(t) >= {V.MIN_EXTERNAL_CHARS} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY crawl_id) = 1),
w AS (SELECT * FROM (SELECT doc_id, wikipedia_url AS wu, text FROM corpus WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY crawl_id DESC) = 1) WHERE len(text) >= {V.MIN_WIKI_CHARS})
SELECT doc_id, CASE WHEN t IS NOT NULL THEN 'external' ELSE 'wikipedia' END AS source_type, CASE WHEN t IS NOT NULL THEN coalesce({O._DOMAIN.replace('url', 'e.url')}, '') ELSE 'Wikipedia' END AS source, CASE WHEN t IS NOT NULL THEN e.url ELSE wu END AS url, len(CASE WHEN t IS NOT NULL THEN t ELSE w.text END)::INT AS chars FROM e FULL JOIN w USING (doc_id)""",
        "project_status": "SELECT (SELECT count(*) FROM corpus) AS documents, count(*) AS chunks, count(embedding) AS vectors, count(*) FILTER (WHERE coalesce(len(embedding), -1) <> (SELECT max(embedding_dim) FROM sbert_config)) AS other_length FROM chunks",
        "drawn_nodes": f"""WITH n AS (SELECT livro_id, source AS name FROM relacoes_fortes UNION SELECT livro_id, target FROM relacoes_fortes), f AS (SELECT livro_id, personagem AS name, max(frequencia) AS f FROM personagens_final GROUP BY 1, 2)
SELECT livro_id, name, (coalesce(f, {V.NO_SIZE}) * {V.SIZE_FACTOR})::INT AS size, CASE name {' '.join(f"WHEN '{k}' THEN '{V.GROUP_COLOURS[g]}'" for k, g in GROUPS.items())} ELSE '{V.GROUP_COLOURS[V.NO_GROUP]}' END AS colour FROM n LEFT JOIN f USING (livro_id, name) WHERE name IS NOT NULL""",
        "drawn_edges": f"SELECT *, weight * {V.WIDTH_FACTOR}::DOUBLE AS width FROM ({core['strong_edges']})",
        "latex_entities": f"""WITH k AS ({core['entity_filter']}), g AS (SELECT source_id, label, {_q(chr(92) + 'subsection*{')} || {_latex('label')} || '}}' || chr(10) || {_q(chr(92) + 'begin{itemize}')} || chr(10) || string_agg({_q(chr(92) + 'item ')} || {_latex('text')} || ' (' || coalesce(count, 0) || ')', chr(10) ORDER BY place) || chr(10) || {_q(chr(92) + 'end{itemize}')} || chr(10) AS s FROM k GROUP BY 1, 2)
SELECT source_id, string_agg(s, chr(10) ORDER BY label) AS latex FROM g GROUP BY 1""".replace("'}}'", "'}'"),
        "latex_sources": f"""WITH c AS (SELECT crawl_id, coalesce(title, 'Untitled source') AS t, coalesce(artist, 'Unknown author') AS a, CASE WHEN crawl_id % 3 = 0 THEN ' 2024.' ELSE '.' END AS y, CASE WHEN crawl_id % 2 = 0 THEN url END AS u, coalesce(section, '') AS p FROM corpus)
SELECT crawl_id, {_latex('a')} || {_q('. ' + chr(92) + 'textit{')} || {_latex('t')} || '}}' || y || CASE WHEN coalesce(u, '') <> '' THEN {_q(' Disponível em: ' + chr(92) + 'url{')} || u || '}}.' ELSE ' Ficheiro PDF: ' || {_latex('p')} || '.' END AS entry FROM c""".replace("'}}'", "'}'").replace("'}}.'", "'}.'"),
        "latex_sentences": f"WITH {O._CELLS}, l AS (SELECT source_id, list_sort(list(s))[:3] AS l FROM cells GROUP BY 1) SELECT source_id, array_to_string(list_transform(l, lambda x: {_q(chr(92) + 'item ')} || {_latex('x')}), chr(10)) AS items FROM l",
        "layout_lines": f"""WITH l AS (SELECT rec_id, string_split(descricao, chr(10)) AS ls FROM scrapper WHERE descricao IS NOT NULL), n AS (SELECT rec_id, unnest(range(len(ls))) AS no, unnest(ls) AS line FROM l), w AS (SELECT rec_id, no, {O._words('line')} AS w FROM n),
k AS (SELECT rec_id, 100 + 20 * no AS top, array_to_string(w[:len(w) // 2], ' ') AS a, array_to_string(w[len(w) // 2 + 1:], ' ') AS b FROM w WHERE len(w) > 0 AND 100 + 20 * no <= 840)
SELECT rec_id AS doc_id, (row_number() OVER (PARTITION BY rec_id ORDER BY top) - 1)::INT AS line_no, top::INT AS top, CASE WHEN a = '' THEN b WHEN regexp_matches(b, '^[\\]).,;:]') OR regexp_matches(a, '[(\\[/]$') THEN a || b ELSE a || ' ' || b END AS text FROM k""",
        "clean_documents": _cleaned(),
        "hashed_vectors": """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents), h AS (SELECT doc_id, ('0x' || md5(t)[1:12])::BIGINT AS h FROM t),
c AS (SELECT doc_id, (h % 64)::INT AS pos, sum(CASE WHEN (h >> 32) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM c GROUP BY 1)
SELECT doc_id, pos, round(x / n, 5) AS x FROM c JOIN n USING (doc_id) WHERE x <> 0""",
        "diverse_top3": _diverse(core),
        "entity_report": f"""WITH k AS ({core['entity_filter']}), i AS (SELECT source_id, label, place, CASE WHEN count IS NULL THEN to_json({{'text': text}}) ELSE to_json({{'text': text, 'count': count}}) END::VARCHAR AS j FROM k),
g AS (SELECT source_id, label, '"' || label || '":[' || string_agg(j, ',' ORDER BY place) || ']' AS s FROM i GROUP BY 1, 2) SELECT source_id, '{{' || string_agg(s, ',' ORDER BY label) || '}}' AS report FROM g GROUP BY 1""",
        "text_lines_json": "SELECT livro_id, personagem, CASE WHEN frequencia IS NULL THEN to_json({'livro_id': livro_id, 'personagem': personagem}) ELSE to_json({'livro_id': livro_id, 'personagem': personagem, 'frequencia': frequencia}) END::VARCHAR AS json FROM personagens_final WHERE livro_id IS NOT NULL AND personagem IS NOT NULL",
    }
