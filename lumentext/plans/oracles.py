"""The queries in DuckDB's SQL. Written from what each query means, not from its plan."""

from __future__ import annotations

from ..functions import values as V
from .queries import GAZETTEER, QUERIES, REJECTED, STOP_D


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _in(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}\x{0B}]"


def _norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def _words(c: str) -> str:
    return f"list_filter(string_split({_norm(c)}, ' '), lambda w: w <> '')"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def _any(c: str, parts, how="contains") -> str:
    return "(" + " OR ".join(f"{how}({c}, '{p}')" for p in parts) + ")"


_STOP = _in(V.STOPWORDS)
_TOKC = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: w NOT IN {_STOP})"
_TF = f"""
WITH t AS (SELECT doc_id, {_TOKC} AS toks FROM documents),
x AS (SELECT doc_id, len(toks) AS n, unnest(toks) AS term FROM t),
c AS (SELECT doc_id, term, count(*) AS k, any_value(n) AS n FROM x GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
i AS (SELECT term, df, log10((SELECT count(*) FROM documents) / df) AS idf FROM df),
w AS (SELECT doc_id, term, k / n AS tf, idf, k / n * idf AS w FROM c JOIN i USING (term))
"""
_QUERIES = ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUERIES, 1))
_Q = "q AS (SELECT question_id, min(question) AS question FROM answer_question WHERE question_id % 20 = 0 GROUP BY 1)"
_BM25 = f"""
WITH {_Q},
x AS (SELECT chunk_id, doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM chunks),
c AS (SELECT chunk_id, any_value(doc_id) AS doc_id, term, count(*) AS k FROM x GROUP BY 1, 3),
l AS (SELECT chunk_id, sum(k) AS n FROM c GROUP BY 1),
s AS (SELECT (SELECT count(*) FROM chunks) AS nd, (SELECT sum(n) FROM l) / (SELECT count(*) FROM chunks) AS avg),
d AS (SELECT term, ln(nd - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM c, s GROUP BY term, nd),
i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM d) ELSE raw END AS idf FROM d),
t AS (SELECT question_id, term, count(*) AS times FROM (SELECT question_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM q) GROUP BY 1, 2),
b AS (SELECT question_id, chunk_id, any_value(doc_id) AS doc_id, sum(times * idf * k * 2.5 / (k + 1.5 * (0.25 + 0.75 * n / avg))) AS score FROM t JOIN c USING (term) JOIN i USING (term) JOIN l USING (chunk_id), s GROUP BY 1, 2)
"""
_SPLIT = rf"regexp_extract_all(regexp_replace(text, '([.!?]){WS}+', '\1' || chr(1), 'g'), '[^' || chr(1) || ']+')"
_SENT = f"""
WITH p AS (SELECT crawl_id, list_filter(list_transform({_SPLIT}, lambda x: {_strip('x')}), lambda x: len(x) > 30) AS ss FROM corpus WHERE text IS NOT NULL),
s AS (SELECT crawl_id, unnest(range(len(ss))) AS sent_no, unnest(ss) AS sentence FROM p)
"""
_CELLS = f"cells AS (SELECT sent_id, source_id, {_norm('sentence')} AS s FROM wiki_space_exploration_top_sentences WHERE sentence IS NOT NULL AND source_id IS NOT NULL)"
_GRAMS = f"""
WITH {_CELLS},
t AS (SELECT sent_id, source_id, regexp_extract_all(lower(s), '[a-z]+(?:''[a-z]+)?|\\d+') AS t FROM cells),
b0 AS (SELECT sent_id, source_id, len(t) AS n, t, unnest(range(1, len(t))) AS i FROM t),
b AS (SELECT sent_id, source_id, n, t[i] AS w1, t[i + 1] AS w2, t[i + 2] AS w3 FROM b0),
f2 AS (SELECT source_id, w1, w2, count(*) AS freq FROM b GROUP BY 1, 2, 3),
f3 AS (SELECT source_id, w1, w2, w3, count(*) AS freq FROM b WHERE w3 IS NOT NULL GROUP BY 1, 2, 3, 4),
c1 AS (SELECT source_id, w1, sum(freq) AS ctx FROM f2 GROUP BY 1, 2),
v AS (SELECT source_id, count(*) AS v FROM c1 GROUP BY 1),
c2 AS (SELECT source_id, w1, w2, sum(freq) AS ctx FROM f3 GROUP BY 1, 2, 3)
"""
_LM = (
    _GRAMS
    + """, l2 AS (SELECT source_id, sent_id, any_value(n) AS n, avg(ln((freq + 1) / (ctx + v))) AS lp FROM b JOIN f2 USING (source_id, w1, w2) JOIN c1 USING (source_id, w1) JOIN v USING (source_id) GROUP BY 1, 2),
l3 AS (SELECT source_id, sent_id, avg(ln((freq + 1) / (ctx + v))) AS lp FROM b JOIN f3 USING (source_id, w1, w2, w3) JOIN c2 USING (source_id, w1, w2) JOIN v USING (source_id) GROUP BY 1, 2),
lm AS (SELECT l2.source_id, l2.sent_id, (0.6 * l2.lp + 0.4 * coalesce(l3.lp, l2.lp)) * CASE WHEN n > 35 THEN 0.9 ELSE 1 END AS score FROM l2 LEFT JOIN l3 USING (source_id, sent_id))
"""
)
_AUDIT = f"""
WITH a AS (SELECT *, md5(coalesce(text, '')) AS dg, len(coalesce(text, '')) AS nc, coalesce(contains(lower(coalesce(text, '')), lower(title)), false) AS t FROM corpus),
f AS (SELECT *, list_filter([CASE WHEN nc < {V.SHORT_TEXT_CHARS} THEN 'short_text' END, CASE WHEN count(*) OVER (PARTITION BY dg) > 1 THEN 'duplicate_text' END, CASE WHEN NOT t THEN 'title_not_in_text' END], lambda x: x IS NOT NULL) AS w FROM a)
"""
_DOMAIN = "replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), 'www.', '')"
_ENT_MAP = "CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.ENTITY_TEXT.items()) + " ELSE s END"
_ENT = f"""
WITH g AS (SELECT source_id, label AS ol, text, max(count) AS c, {_norm('text')} AS s FROM wiki_human_spaceflight_entities WHERE text IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL),
m AS (SELECT *, {_ENT_MAP} AS t FROM g),
k AS (SELECT source_id, ol, t, c, CASE WHEN t IN {_in(V.ENTITY_AS_LOC)} THEN 'LOC' WHEN t IN {_in(V.ENTITY_AS_GPE)} THEN 'GPE' ELSE ol END AS label FROM m
  WHERE len(t) >= 2 AND NOT regexp_matches(t, '(?:\\b[A-Za-z]\\b\\s+){{4,}}') AND NOT regexp_matches(t, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\-+.''/&()]') AND t NOT IN {_in(V.ENTITY_STOP)}),
d AS (SELECT *, row_number() OVER (PARTITION BY source_id, label, lower(t) ORDER BY c DESC NULLS LAST, ol, t) AS n FROM k WHERE label IN {_in(V.ENTITY_LABELS)}),
e AS (SELECT source_id, label, t AS text, c AS count, row_number() OVER (PARTITION BY source_id, label ORDER BY c DESC NULLS LAST, lower(t)) AS place FROM d WHERE n = 1)
"""
_TAG = f"""
WITH t0 AS (SELECT item_id AS sent_id, string_split({_norm('text')}, ' ') AS ts FROM eval_items),
t1 AS (SELECT sent_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM t0),
t2 AS (SELECT *, CASE WHEN regexp_matches(token, '^[A-Z]') THEN 'Pessoa' WHEN regexp_matches(token, '^[0-9]') THEN 'Data' END AS kind FROM t1),
"""
_ISLANDS = """SELECT sent_id, min(pos) AS "start", max(pos) + 1 AS "end", label FROM (
  SELECT *, sum(new) OVER (PARTITION BY sent_id ORDER BY pos) AS span FROM (
    SELECT *, CASE WHEN label IS NOT NULL AND (lag(label) OVER (PARTITION BY sent_id ORDER BY pos) IS DISTINCT FROM label OR first) THEN 1 ELSE 0 END AS new FROM ({0})))
WHERE label IS NOT NULL GROUP BY sent_id, span, label"""
_GOLD = _ISLANDS.format("SELECT sent_id, pos, kind AS label, false AS first FROM t2")
_PRED = _ISLANDS.format("SELECT sent_id, pos, CASE WHEN len(token) > 9 THEN NULL ELSE kind END AS label, kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY sent_id ORDER BY pos) AS first FROM t2")
_HITS = """
a AS (SELECT question_id, chunk_id, min(question) AS question, max(retrieval_score) AS score, max(qa_score) AS qa FROM answer_question WHERE retrieval_score IS NOT NULL AND NOT isnan(retrieval_score) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM a),
h AS (SELECT r.*, c.title, c.type, c.artist, c.source, c.text FROM r JOIN chunks c USING (chunk_id) WHERE rank <= 8)"""
_EDGE = r"[^\p{L}\p{M}\p{N}_]"


def _no_articles(c: str) -> str:
    for _ in range(2):  # neighbours share a blank
        c = f"regexp_replace({c}, '(^|{_EDGE})(?:a|an|the)($|{_EDGE})', '\\1 \\2', 'g')"
    return c


def _NA(c: str) -> str:
    return _norm(f"regexp_replace({_no_articles(f'lower({c})')}, '[!-/:-@\\[-`{{-~]', '', 'g')")


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_UNIT = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"


_OK = "{0} IS NOT NULL AND len(list_filter({0}, lambda x: x <> 0)) > 0"
_COS = f"{_DOT.format('{0}', '{1}')} / sqrt({_DOT.format('{0}', '{0}')} * {_DOT.format('{1}', '{1}')})"
_HYBRID = (
    _BM25
    + f""", qc AS (SELECT question_id, chunk_id FROM answer_question WHERE question_id % 20 = 0 AND sbert_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY sbert_score DESC, chunk_id DESC) = 1),
qv AS (SELECT question_id, embedding AS e FROM qc JOIN chunks USING (chunk_id) WHERE {_OK.format('embedding')}),
cv AS (SELECT chunk_id, doc_id, type, embedding AS e FROM chunks WHERE {_OK.format('embedding')}),
dn AS (SELECT question_id, chunk_id, cv.doc_id, type, {_COS.format('qv.e', 'cv.e')} AS d FROM qv JOIN cv ON len(qv.e) = len(cv.e)),
hs AS (SELECT dn.*, coalesce(b.score, 0) AS s FROM dn LEFT JOIN b USING (question_id, chunk_id)),
hm AS (SELECT *, min(s) OVER w AS s0, max(s) OVER w AS s1, min(d) OVER w AS d0, max(d) OVER w AS d1 FROM hs WINDOW w AS (PARTITION BY question_id)),
hy AS (SELECT *, 0.4 * CASE WHEN s1 = s0 THEN 0 ELSE (s - s0) / (s1 - s0) END + 0.6 * CASE WHEN d1 = d0 THEN 0 ELSE (d - d0) / (d1 - d0) END AS h FROM hm)
"""
)


def _cut(t: str) -> str:
    """Before the first marker, in list order, whose first place is after 500 characters."""
    before = [f"regexp_extract({t}, '(?s)^(.*?)\\b{m}\\b', 1)" for m in V.BACK_MATTER]
    return "CASE " + " ".join(f"WHEN len({b}) > 500 THEN {_strip(b)}" for b in before) + f" ELSE {t} END"


def _domain_score(d: str) -> str:
    good = " + ".join(f"CASE WHEN contains({d}, '{g}') THEN 20 ELSE 0 END" for g in V.GOOD_DOMAINS)
    extra = " ".join(f"WHEN type = '{k}' AND {_any(d, ds)} THEN {n}" for k, (n, ds) in V.TYPE_DOMAINS.items())
    return f"({good} + CASE {extra} ELSE 0 END)"


def oracle_sql() -> dict[str, str]:
    n_hosts = len(V.GOOD_DOMAINS + V.BAD_URLS)
    slug = lambda c: f"trim(regexp_replace(replace(lower({c}), '&', 'and'), '[^a-z0-9]+', '_', 'g'), '_')"
    title = r"regexp_matches({0}, '^\P{{L}}*\p{{Lu}}\p{{Ll}}*(?:\P{{L}}+\p{{Lu}}\p{{Ll}}*)*\P{{L}}*$')"
    months = "|".join(V.MONTHS_EN)
    out = {
        "tfidf_idf": _TF + "SELECT term, df, round(idf, 6) AS idf FROM i",
        "tfidf_weights": _TF + "SELECT doc_id, term, round(tf, 6) AS tf, round(w, 6) AS w FROM w",
        "tfidf_rank": _TF
        + f""", q AS (SELECT * FROM (VALUES {_QUERIES}) AS v(query_id, query)),
qt AS (SELECT query_id, list_filter(regexp_extract_all(lower(query), '[a-z]+'), lambda w: w NOT IN {_STOP}) AS toks FROM q),
qw AS (SELECT query_id, term, count(*) / any_value(n) * any_value(idf) AS wq FROM (SELECT query_id, len(toks) AS n, unnest(toks) AS term FROM qt) JOIN i USING (term) GROUP BY 1, 2),
qn AS (SELECT query_id, sqrt(sum(wq * wq)) AS qn FROM qw GROUP BY 1), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM w GROUP BY 1)
SELECT query_id, doc_id, round(sum(w * wq) / (any_value(qn) * any_value(dn)), 6) AS score FROM w JOIN qw USING (term) JOIN qn USING (query_id) JOIN dn USING (doc_id) GROUP BY 1, 2 HAVING any_value(qn) * any_value(dn) > 0 AND sum(w * wq) > 0""",
        "bm25_rank": _BM25 + "SELECT question_id, rank, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, chunk_id DESC)::INT AS rank FROM b) WHERE rank <= 10",
        "bm25_unique_docs": _BM25.replace(_Q, _Q.replace(" WHERE question_id % 20 = 0", ""))
        + """, u AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY round(score, 6) DESC, chunk_id DESC) = 1)
SELECT question_id, rank, doc_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 6) DESC, chunk_id DESC)::INT AS rank FROM u) WHERE rank <= 10""",
        "dense_topk": f"""WITH u AS {_UNIT}, s AS (SELECT a.vec_id AS query_id, b.vec_id, {_DOT.format('a.v', 'b.v')} AS score FROM u a, u b WHERE a.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id DESC)::INT AS rank FROM s) WHERE rank <= 10""",
        "word_neighbours": f"""WITH u AS {_UNIT}, s AS (SELECT a.vec_id AS query_id, b.vec_id, {_DOT.format('a.v', 'b.v')} AS score FROM u a, u b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5""",
        "doc_centroid": "SELECT label, pos::INT AS pos, round(avg(x::DOUBLE), 6) AS x FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2",
        "odd_one_out": f"""WITH u AS {_UNIT}, c AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS pos, unnest(v) AS x FROM u) GROUP BY 1, 2), m AS (SELECT label, list(x ORDER BY pos) AS m FROM c GROUP BY 1),
s AS (SELECT label, vec_id, round({_DOT.format('v', 'm')}, 9) AS score FROM u JOIN m USING (label))
SELECT label, vec_id, round(score, 5) AS score FROM s WHERE (SELECT count(*) FROM s t WHERE t.label = s.label) >= 3 QUALIFY row_number() OVER (PARTITION BY label ORDER BY score, vec_id) = 1""",
        "hybrid_rank": _HYBRID + "SELECT question_id, rank, chunk_id, round(h, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(h, 6) DESC, chunk_id DESC)::INT AS rank FROM hy) WHERE rank <= 10",
        "hybrid_filtered": _HYBRID
        + """, al AS (SELECT * FROM hy WHERE type = 'album' QUALIFY row_number() OVER (PARTITION BY question_id, doc_id ORDER BY round(h, 6) DESC, chunk_id DESC) = 1)
SELECT question_id, rank, doc_id, round(h, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(h, 6) DESC, chunk_id DESC)::INT AS rank FROM al) WHERE rank <= 5""",
        "analogy": f"""WITH u AS {_UNIT}, p AS (SELECT q.vec_id AS query_id, unnest([0, 1, 2]) AS i, unnest([1.0, -1.0, 1.0]) AS sign FROM embeddings q WHERE q.vec_id % 20 = 0),
x AS (SELECT query_id, unnest(range(64)) AS pos, unnest(list_transform(u.v, lambda y: y * sign)) AS y FROM p JOIN u ON u.vec_id = query_id + i), c AS (SELECT query_id, pos, avg(y) AS y FROM x GROUP BY 1, 2), m AS (SELECT query_id, list(y ORDER BY pos) AS m FROM c GROUP BY 1),
s AS (SELECT query_id, vec_id, {_COS.format('m', 'v')} AS score FROM m JOIN u ON vec_id < query_id OR vec_id > query_id + 2)
SELECT query_id, rank, vec_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 3""",
        "back_matter": f"SELECT crawl_id, len({_cut('t')})::INT AS chars FROM (SELECT crawl_id, text || ' See also these. References 1' AS t FROM corpus WHERE text IS NOT NULL)",
        "clean_for_chunks": rf"""WITH a AS (SELECT crawl_id, replace(text, chr(10), ' ') AS t FROM corpus WHERE text IS NOT NULL),
b AS (SELECT crawl_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)While every effort has been made to follow citation style rules.*?if you have any questions\.', ' ', 'g'), '(?i)(What|How|Why|When|Where|Who)[^?]{{10,160}}\?', ' ', 'g'), '\[\d+\]', '', 'g') AS t FROM a)
SELECT crawl_id, {_strip("regexp_replace(regexp_replace(t, '" + WS + "+', ' ', 'g'), '^[,\\s;:.-]+', '')")} AS text FROM b""",
        "confidence_flag": """WITH a AS (SELECT question_id, chunk_id, max(retrieval_score) AS score FROM answer_question WHERE retrieval_score IS NOT NULL AND NOT isnan(retrieval_score) GROUP BY 1, 2),
r AS (SELECT *, lead(score) OVER w AS nx, row_number() OVER w AS n FROM a WINDOW w AS (PARTITION BY question_id ORDER BY score DESC, chunk_id))
SELECT question_id, CASE WHEN score < 0.35 THEN 'low' WHEN coalesce(score - nx, 1.0) < 0.04 THEN 'ambiguous' ELSE 'ok' END AS flag FROM r WHERE n = 1""",
        "chunk_documents": f"""WITH w AS (SELECT crawl_id, {_words('text')} AS w FROM corpus WHERE text IS NOT NULL),
s AS (SELECT crawl_id, w, unnest(CASE WHEN len(w) <= 170 THEN [0] ELSE range(0, len(w), 135) END) AS a FROM w),
c AS (SELECT crawl_id, (a // 135)::INT AS chunk_index, w[a + 1:a + 170] AS c FROM s)
SELECT crawl_id, chunk_index, printf('%d_chunk_%04d', crawl_id, chunk_index) AS chunk_id, array_to_string(c, ' ') AS text, len(c)::INT AS word_count FROM c WHERE len(c) >= 40""",
        "clean_citations": f"SELECT rec_id, {_norm(chr(10).join(['regexp_replace(descricao, ', chr(39) + r'\[\d+\]' + chr(39), ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')']))} AS text FROM scrapper WHERE descricao IS NOT NULL",
        "slugs": f"SELECT crawl_id, {slug('title')} AS slug FROM corpus_audit WHERE title IS NOT NULL",
        "url_domains": f"SELECT coalesce({_DOMAIN}, '') AS domain, count(*) AS n FROM corpus GROUP BY 1",
        "link_scores": f"""WITH l AS (SELECT crawl_id, type, unnest([url, 'https://www.' || {_list(V.GOOD_DOMAINS + V.BAD_URLS)}[crawl_id % {n_hosts} + 1] || '/' || {slug("coalesce(title, '')")}]) AS url FROM corpus),
d AS (SELECT DISTINCT crawl_id, type, url, {_DOMAIN} AS dm FROM l WHERE url IS NOT NULL), s AS (SELECT *, CASE WHEN {_any('lower(url)', V.BAD_URLS)} THEN -100 ELSE {_domain_score('dm')} END AS link_score FROM d),
o AS (SELECT * FROM s WHERE link_score > 0 QUALIFY row_number() OVER (PARTITION BY crawl_id, dm ORDER BY link_score DESC, url) = 1)
SELECT crawl_id, url, link_score::INT AS link_score, place FROM (SELECT *, row_number() OVER (PARTITION BY crawl_id ORDER BY link_score DESC, url)::INT AS place FROM o) WHERE place <= 8""",
        "sentences": _SENT + "SELECT crawl_id, sent_no::INT AS sent_no, sentence FROM s",
        "valid_sentences": _SENT
        + f""", n AS (SELECT crawl_id, sent_no, {_norm('sentence')} AS s FROM s), w AS (SELECT *, string_split(s, ' ') AS w, lower(s) AS l FROM n)
SELECT crawl_id, sent_no::INT AS sent_no FROM w WHERE NOT (len(w) < 6 OR (len(w) <= 8 AND {title.format('s')}) OR {_any('l', V.INVALID_PREFIXES, 'starts_with')} OR {_any('l', V.INVALID_FRAGMENTS)} OR ({_any('l', V.SHORT_PREFIXES, 'starts_with')} AND len(w) < 12)
OR (regexp_matches(s, '\\b\\d+\\.\\s') AND len(w) < 12) OR regexp_matches(s, '(?:\\b[A-Za-z]\\b\\s+){{6,}}') OR len(list_filter(w, lambda x: len(x) <= 2)) / len(w) > 0.45)""",
        "candidate_sentences": _SENT
        + f""", n AS (SELECT crawl_id, sent_no, {_norm('sentence')} AS s FROM s), w AS (SELECT *, len(string_split(s, ' ')) AS k, lower(s) AS l FROM n)
SELECT crawl_id, sent_no::INT AS sent_no FROM w WHERE NOT (k < 8 OR k > 45 OR {_any('l', V.CANDIDATE_PREFIXES, 'starts_with')} OR regexp_matches(s, '^\\p{{Ll}}') OR (regexp_matches(s, '^(?:{'|'.join(V.PRONOUNS)})\\b') AND k < 12) OR regexp_matches(s, '^\\d+(\\.\\d+)*\\s+')
OR contains(l, 'figure ') OR contains(l, 'table ') OR regexp_matches(s, '[:?]$') OR (regexp_matches(l, '\\b(?:{months})\\s+\\d{{4}}\\b') AND k < 12))""",
        "bigrams": _GRAMS + "SELECT * FROM f2",
        "trigrams": _GRAMS + "SELECT * FROM f3",
        "context_counts": _GRAMS + "SELECT source_id, w1, ctx::BIGINT AS ctx FROM c1",
        "vocab_size": _GRAMS + "SELECT * FROM v",
        "sentence_lm_score": _LM + "SELECT source_id, sent_id, round(score, 5) AS score FROM lm",
        "strong_edges": "SELECT livro_id, least(source, target) AS source, greatest(source, target) AS target, max(weight) AS weight FROM relacoes_fortes GROUP BY 1, 2, 3 HAVING max(weight) >= 3",
        "top15_subgraph": """WITH e AS (SELECT livro_id, least(source, target) AS source, greatest(source, target) AS target, max(weight) AS weight FROM relacoes_fortes GROUP BY 1, 2, 3 HAVING max(weight) >= 3),
p AS (SELECT livro_id, personagem AS p, max(frequencia) AS f FROM personagens_final WHERE personagem IS NOT NULL GROUP BY 1, 2), t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY livro_id ORDER BY f DESC NULLS LAST, p) <= 15)
SELECT e.* FROM e SEMI JOIN t a ON a.livro_id = e.livro_id AND a.p = e.source SEMI JOIN t b ON b.livro_id = e.livro_id AND b.p = e.target""",
        "node_sizes": """WITH n AS (SELECT livro_id, source AS name FROM relacoes_fortes UNION SELECT livro_id, target FROM relacoes_fortes), f AS (SELECT livro_id, personagem AS name, max(frequencia) AS f FROM personagens_final GROUP BY 1, 2)
SELECT livro_id, name, coalesce(f * 3, 10)::INT AS size FROM n LEFT JOIN f USING (livro_id, name) WHERE name IS NOT NULL""",
        "audit_flags": _AUDIT + "SELECT crawl_id, nc::INT AS text_chars, t AS title_in_text, coalesce(array_to_string(w, ', '), '') AS warnings FROM f",
        "exact_duplicates": "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "repair_docs": _AUDIT
        + f""", b AS (SELECT doc_id, max(len(text)) AS n FROM corpus WHERE text IS NOT NULL GROUP BY 1)
SELECT crawl_id, CASE WHEN len(w) = 0 THEN 'kept' WHEN n >= {V.MIN_WIKI_CHARS} THEN 'replaced' ELSE 'failed' END AS state, (CASE WHEN len(w) > 0 AND n >= {V.MIN_WIKI_CHARS} THEN n ELSE coalesce(len(text), -1) END)::INT AS chars FROM f LEFT JOIN b USING (doc_id)""",
        "chunks_consistency": "SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM corpus) ANTI JOIN chunks USING (doc_id)) AS only_left, (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM chunks) ANTI JOIN corpus USING (doc_id)) AS only_right",
        "eval_retrieval": """WITH a AS (SELECT question_id, chunk_id, max(CASE WHEN NOT isnan(qa_score) THEN qa_score END) AS qa, max(CASE WHEN NOT isnan(retrieval_score) THEN retrieval_score END) AS rs FROM answer_question GROUP BY 1, 2),
rel AS (SELECT question_id, chunk_id FROM a WHERE qa IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY qa DESC, chunk_id DESC) = 1),
h AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY rs DESC, chunk_id) AS rank FROM a WHERE rs IS NOT NULL),
f AS (SELECT question_id, min(rank) AS r FROM h SEMI JOIN rel USING (question_id, chunk_id) GROUP BY 1), p AS (SELECT DISTINCT question_id FROM a)
SELECT round(avg(coalesce(1.0::DOUBLE / r, 0)), 4) AS mrr, round(avg(CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS p1, round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit, count(*) AS queries FROM p LEFT JOIN f USING (question_id)""",
        "token_f1": f"""WITH x AS (SELECT a.crawl_id, {_NA("coalesce(a.title, '')")} AS p, {_NA("coalesce(c.title, '')")} AS t FROM corpus_audit a JOIN corpus c USING (crawl_id)),
l AS (SELECT *, list_filter(string_split(p, ' '), lambda w: w <> '') AS pl, list_filter(string_split(t, ' '), lambda w: w <> '') AS tl FROM x),
pc AS (SELECT crawl_id, w, count(*) AS n FROM (SELECT crawl_id, unnest(pl) AS w FROM l) GROUP BY 1, 2), tc AS (SELECT crawl_id, w, count(*) AS n FROM (SELECT crawl_id, unnest(tl) AS w FROM l) GROUP BY 1, 2),
s AS (SELECT crawl_id, sum(least(pc.n, tc.n)) AS s FROM pc JOIN tc USING (crawl_id, w) GROUP BY 1)
SELECT crawl_id, (p = t)::INT AS em, CASE WHEN s IS NULL THEN 0.0::DOUBLE ELSE round((2.0::DOUBLE * s) / (len(pl) + len(tl)), 6) END AS f1 FROM l LEFT JOIN s USING (crawl_id)""",
        "entity_filter": _ENT + "SELECT source_id, label, text, count, place::INT AS place FROM e WHERE place <= 15",
        "entity_counts": "SELECT source_id, label, text, sum(coalesce(count, 0))::BIGINT AS n FROM wiki_human_spaceflight_entities GROUP BY 1, 2, 3",
        "iob_spans": _TAG + f"""g AS ({_GOLD}) SELECT sent_id, "start"::INT AS "start", "end"::INT AS "end", label FROM g""",
        "span_f1": _TAG
        + f"""g AS ({_GOLD}), p AS ({_PRED}),
m AS (SELECT label, 1 AS g, 0 AS p, 0 AS s FROM g UNION ALL SELECT label, 0, 1, 0 FROM p UNION ALL SELECT label, 0, 0, 1 FROM g SEMI JOIN p USING (sent_id, "start", "end", label)),
n AS (SELECT label, sum(g) AS g, sum(p) AS p, sum(s) AS s FROM m GROUP BY ROLLUP (label))
SELECT coalesce(label, 'all') AS label, g::BIGINT AS n_gold, p::BIGINT AS n_predicted, s::BIGINT AS n_same, round(s::DOUBLE / p, 5) AS precision, round(s::DOUBLE / g, 5) AS recall, round(2.0::DOUBLE * s / (p + g), 5) AS f1 FROM n""",
        "page_sections": """WITH l AS (SELECT rec_id, unnest(range(len(x))) AS no, trim(unnest(x)) AS text FROM (SELECT rec_id, string_split(descricao, chr(10)) AS x FROM scrapper WHERE descricao IS NOT NULL)),
k AS (SELECT *, lower(text) IN ('sintomas', 'causas', 'tratamento', 'prevenção') AS h FROM l WHERE text <> ''),
s AS (SELECT *, coalesce(last_value(CASE WHEN h THEN CASE lower(text) WHEN 'sintomas' THEN 'sintomas' WHEN 'causas' THEN 'causas' WHEN 'tratamento' THEN 'tratamento' ELSE 'descricao' END END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY no ROWS UNBOUNDED PRECEDING), 'descricao') AS section FROM k),
b AS (SELECT *, lag(text) OVER (PARTITION BY rec_id ORDER BY no) AS b FROM s WHERE NOT h)
SELECT rec_id, no::INT AS no, section, text FROM b WHERE b IS DISTINCT FROM text""",
        "page_dates": r"SELECT rec_id, nullif(regexp_extract(data, '\d{2}/\d{2}/\d{4}(?:\s*-\s*\d{2}:\d{2})?'), '') AS date FROM scrapper",
        "map_key_counts": "SELECT k, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1",
        "list_counts": "SELECT item, count(*) AS n FROM (SELECT unnest(list_concat(list_concat(coalesce(causas, []), coalesce(sintomas, [])), coalesce(tratamento, []))) AS item FROM scrapper) GROUP BY 1 ORDER BY n DESC, item LIMIT 10",
        "presence_counts": "SELECT count(*) AS n, count(*) FILTER (len(causas) > 0) AS causas, count(*) FILTER (len(sintomas) > 0) AS sintomas, count(*) FILTER (len(tratamento) > 0) AS tratamento, count(descricao) AS descricao FROM scrapper",
        "metadata_answer": """WITH q AS (SELECT crawl_id, title, type, artist, unnest(['Who released ' || title || '?', 'Which album was it?', 'What genre is it?']) AS question FROM corpus WHERE title IS NOT NULL),
a AS (SELECT crawl_id, question, CASE WHEN contains(lower(question), 'who released') AND type = 'album' AND artist <> '' THEN artist WHEN (contains(lower(question), 'which album') OR contains(lower(question), 'what album')) AND type = 'album' THEN title WHEN contains(lower(question), 'what genre') AND type = 'genre' THEN title END AS answer FROM q)
SELECT * FROM a WHERE answer IS NOT NULL""",
        "ranked_answers": f"""WITH {_HITS},
c AS (SELECT question_id, trim(replace(replace(replace({_strip('coalesce(artist, title)')}, ' Type', ''), ' Source', ''), ' Document', ''), ' .,:;!?"''()[]{{}}') AS answer, 0.7 * CASE WHEN NOT isnan(qa) THEN qa END + 0.3 * score AS f, chunk_id FROM h),
d AS (SELECT * FROM c WHERE answer <> '' AND f IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id, lower(answer) ORDER BY round(f, 9) DESC, chunk_id) = 1)
SELECT question_id, place, answer, round(f, 6) AS final_score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(f, 9) DESC, chunk_id)::INT AS place FROM d) WHERE place <= 5""",
        "question_terms": f"""WITH q AS (SELECT question_id, min(question) AS question FROM answer_question GROUP BY 1)
SELECT DISTINCT question_id, trim(lower(w), '.,:;!?()[]{{}}"''') AS term FROM (SELECT question_id, unnest({_words('question')}) AS w FROM q) WHERE len(w) > 3""",
        "evidence_sentences": f"""WITH {_HITS},
p AS (SELECT question_id, question, rank, title, list_filter(list_transform({_SPLIT}, lambda x: {_strip('x')}), lambda x: len(x) > 30) AS ss FROM h),
s AS (SELECT question_id, question, rank, title, unnest(range(len(ss))) AS no, unnest(ss) AS sentence FROM p),
q AS (SELECT *, lower(sentence) AS l, list_distinct(list_transform(list_filter({_words('question')}, lambda w: len(w) > 3), lambda w: trim(lower(w), '.,:;!?()[]{{}}"'''))) AS qt FROM s),
k AS (SELECT *, 2 * len(list_filter(qt, lambda t: contains(l, t))) + 3 * len(list_filter({_list(V.IMPORTANCE_TERMS)}, lambda t: contains(l, t))) + coalesce(contains(l, lower(title))::INT, 0) AS points FROM q
 WHERE len({_words('sentence')}) >= 8 AND regexp_matches(sentence, '[.!?"]$') AND NOT {_any('l', V.NOISY_TERMS)}),
d AS (SELECT * FROM k WHERE points > 0 QUALIFY row_number() OVER (PARTITION BY question_id, l ORDER BY points DESC, rank, no) = 1)
SELECT question_id, place, title, sentence, points::INT AS points FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY points DESC, rank, no)::INT AS place FROM d) WHERE place <= 8""",
        "token_counts": rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), w AS (SELECT *, len(list_filter({_words('lower(text)')}, lambda w: len(w) > 2 AND w NOT IN {_in(STOP_D)})) AS k FROM d)
SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?|\d+'))::INT AS a, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INT AS b, len({_TOKC})::INT AS c, (CASE WHEN k >= 3 THEN k ELSE -1 END)::INT AS d FROM w""",
        "top_words": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 30",
        "normalized_answers": f"SELECT item_id, {_NA('text')} AS answer FROM eval_items",
        "latex_texts": r"""SELECT crawl_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(title || ' 5% & {x}_\', '\', '\textbackslash{}'), '{', '\{'), '}', '\}'), '&', '\&'), '%', '\%'), '$', '\$'), '#', '\#'), '_', '\_'), '~', '\textasciitilde{}'), '^', '\textasciicircum{}') AS latex FROM corpus_audit WHERE title IS NOT NULL""",
        "aligned_labels": f"SELECT item_id, len({_words('text')})::INT AS kept, len(list_filter({_words('text')}, lambda w: regexp_matches(w, '^[A-Z]')))::INT AS capitals FROM eval_items",
        "span_search": """WITH s AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), e AS (SELECT vec_id, 63 - i AS i, x FROM s),
ps AS (SELECT vec_id, i, x, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM s), pe AS (SELECT vec_id, i, x, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM e),
a AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) <= 10), b AS (SELECT * FROM pe QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) <= 10),
j AS (SELECT a.vec_id, a.i AS s, b.i AS e, round(a.p * b.p, 12) AS score FROM a JOIN b USING (vec_id) WHERE b.i >= a.i AND b.i - a.i < 30)
SELECT vec_id, s::INT AS span_start, e::INT AS span_end, round(score, 5) AS score FROM j QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, s, e) = 1""",
        "index_articles": f"""WITH i AS (SELECT letra, url, min(nome) AS nome, min(descricao_pequena) AS dp FROM scrapper GROUP BY 1, 2), a AS (SELECT url, max(descricao) AS d, max(nome) AS n FROM scrapper GROUP BY 1)
SELECT letra, url, coalesce(nullif({_strip('n')}, ''), nome) AS nome, len(coalesce(nullif({_strip('d')}, ''), dp))::INT AS chars FROM i LEFT JOIN a USING (url)""",
    }
    for name, t, cols in (("chunk_counts", "chunks", ["type", "section", "source_type", "source"]), ("corpus_distribution", "corpus", ["type", "section", "source_type"])):
        out[name] = " UNION ALL ".join(f"SELECT '{c}' AS what, {c} AS value, count(*) AS n FROM {t} GROUP BY {c}" for c in cols)
    gaz = ", ".join(f"('{k}', '{v}')" for k, v in GAZETTEER.items())
    mention = rf"""WITH g AS (SELECT * FROM (VALUES {gaz}) AS v(phrase, name)), p AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '[^' || chr(1) || ']+') AS ss FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(range(len(ss))) AS no, unnest(ss) AS sentence FROM p), w AS (SELECT doc_id, no, unnest(regexp_split_to_array(sentence, '[^\p{{L}}\p{{M}}\p{{N}}_''\-]+')) AS w FROM s),
m AS (SELECT DISTINCT doc_id, no, name FROM w JOIN g ON w.w = g.phrase WHERE name NOT IN {_in(REJECTED)})"""
    out["cooccurrence_nodes"] = mention + " SELECT name, count(*) AS freq FROM m GROUP BY 1"
    out["cooccurrence_edges"] = mention + " SELECT a.name AS source, b.name AS target, count(*) AS weight FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.no = b.no AND a.name < b.name GROUP BY 1, 2"
    return out
