"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from math import comb

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "frequencies": ["p3_found", "p3_frequencies"],
    "rankagg": ["p5_found", "p5_ranks"],
    "tokens": ["p8_ids"],
    "leakage": ["p9_found", "p9_leaks"],
    "neardup": ["p4_found", "p4_groups"],
    "neighbours": ["p6_found", "p6_search"],
    "sentences": ["p7_found"],
    "boilerplate": ["p2_found", "p2_main"],
    "names": ["p1_found", "p1_entities"],
    "spans": ["p10_found", "p10_shared"],
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"{__package__}.{m}"), name) for m, names in _MODULES.items() for name in names}


_FREQ = """
WITH r AS (
  SELECT 'personagens_final.personagem' AS field, personagem AS val, livro_id AS scope, frequencia AS w FROM (SELECT DISTINCT * FROM personagens_final)
  UNION ALL
  SELECT 'wiki_human_spaceflight_entities.text', text, source_id, count FROM (SELECT DISTINCT * FROM wiki_human_spaceflight_entities)
), f AS (
  SELECT field, val, CAST(sum(coalesce(w, 0)) AS BIGINT) AS total, count(DISTINCT scope) AS scopes
  FROM r WHERE val IS NOT NULL AND regexp_matches(val, '[^\\s\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]') GROUP BY 1, 2
)"""


_RANKS = """
WITH l AS (SELECT question_id, chunk_id, max({{'at': scored_at, 'a': CASE WHEN NOT isnan(bm25_score) THEN bm25_score END, 'b': CASE WHEN NOT isnan(sbert_score) THEN sbert_score END, 'c': CASE WHEN NOT isnan(qa_score) THEN qa_score END, 'd': CASE WHEN NOT isnan(retrieval_score) THEN retrieval_score END}}) AS m
  FROM answer_question WHERE question_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1, 2),
s AS (SELECT question_id, chunk_id, unnest([1, 2, 3, 4]) AS k, unnest([m.a, m.b, m.c, m.d]) AS v FROM l),
f AS (SELECT question_id, chunk_id, k, coalesce(v, min(v) OVER (PARTITION BY question_id, k), 0) AS v FROM s),
r AS (SELECT question_id, chunk_id, (rank() OVER w + (count(*) OVER (PARTITION BY question_id, k, v) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY question_id, k) AS r FROM f WINDOW w AS (PARTITION BY question_id, k ORDER BY v DESC)),
o AS (SELECT question_id, chunk_id, list(r ORDER BY r) AS r FROM r GROUP BY 1, 2),
p AS (SELECT *, 4 * least({0}) AS rho FROM o),
z AS (SELECT question_id, chunk_id, round(least(1, rho), 12) AS rho, round(list_sum(r) / 4, 12) AS mean_rank FROM p)
""".format(", ".join(" + ".join(f"{comb(4, j)} * power(r[{k}], {j}) * power(1 - r[{k}], {4 - j})" for j in range(k, 5)) for k in range(1, 5)))
_WORDS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda w: w <> '')"
_LEAKS = f"""
WITH iw AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM eval_items), dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM iw)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM dw)),
n AS (SELECT item_id, count(*) AS k FROM ig GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, any_value(k) AS "of" FROM dg JOIN ig USING (g) JOIN n USING (item_id) GROUP BY 1, 2"""
_SPANS = """
WITH w AS (SELECT doc_id, p, text[p + 1:p + 120] AS g FROM (SELECT doc_id, text, unnest(range(len(text) - 119)) AS p FROM documents WHERE len(text) >= 120)),
s AS (SELECT w.doc_id, w.p FROM w JOIN (SELECT g FROM w GROUP BY g HAVING count(DISTINCT doc_id) > 1) USING (g)),
b AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 120 THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM b),
x AS (SELECT doc_id, min(p)::INT AS start_pos, (max(p) + 120)::INT AS end_pos FROM r GROUP BY doc_id, run)
"""


_WS = r"[\s\x{A0}\x{85}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}\x{1C}-\x{1F}]"
_SIMILAR = """
SELECT '{0}' AS field, a.id AS id_a, b.id AS id_b FROM {1} a JOIN {1} b USING (g) JOIN {1}_n x ON x.id = a.id JOIN {1}_n y ON y.id = b.id WHERE a.id < b.id
GROUP BY a.id, b.id, x.n, y.n HAVING count(*) >= {2} * (x.n + y.n - count(*))"""
_NEAR_DUPLICATES = (
    rf"""
WITH w AS (SELECT crawl_id AS id, list_filter(regexp_split_to_array(lower(text), '{_WS}+'), lambda w: w <> '') AS w FROM corpus WHERE text IS NOT NULL),
tg AS (SELECT DISTINCT id, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)), tg_n AS (SELECT id, count(*) AS n FROM tg GROUP BY 1),
c AS (SELECT crawl_id AS id, trim(regexp_replace(lower(title), '{_WS}+', ' ', 'g')) AS t FROM corpus_audit WHERE title IS NOT NULL),
cg AS (SELECT DISTINCT id, t[i:i + 2] AS g FROM (SELECT id, t, unnest(range(1, len(t) - 1)) AS i FROM c)), cg_n AS (SELECT id, count(*) AS n FROM cg GROUP BY 1)
"""
    + _SIMILAR.format("corpus.text", "tg", 0.5)
    + " UNION ALL "
    + _SIMILAR.format("corpus_audit.title", "cg", 0.6)
)
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2]))"
_NEAREST = f"""
WITH v AS (SELECT chunk_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM chunks WHERE len(embedding) = (SELECT max(embedding_dim) FROM sbert_config) AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT id, list_transform(e, lambda x: x / sqrt({_DOT.format('e', 'e')})) AS u FROM v),
c AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round({_DOT.format('a.u', 'b.u')}, 6) DESC, b.id) <= 5)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM c"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _NEAR_DUPLICATES,
        "p6_found": _NEAREST,
        "p5_ranks": _RANKS + "SELECT question_id, chunk_id, rho, mean_rank FROM z",
        "p5_found": _RANKS + "SELECT question_id, chunk_id FROM z QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rho, mean_rank, chunk_id) <= 3",
        "p9_leaks": _LEAKS,
        "p9_found": f"SELECT doc_id, item_id FROM ({_LEAKS})",
        "p10_found": _SPANS + "SELECT doc_id, start_pos, end_pos FROM x",
        "p10_shared": _SPANS + """, t AS (SELECT doc_id, sum(end_pos - start_pos) AS n FROM x GROUP BY 1)
SELECT doc_id, coalesce(len(text), 0)::INT AS chars, coalesce(n, 0)::BIGINT AS shared, CASE WHEN coalesce(len(text), 0) = 0 THEN 0.0::DOUBLE ELSE round(coalesce(n, 0) / len(text), 6) END AS share FROM documents LEFT JOIN t USING (doc_id)""",
        "p3_frequencies": _FREQ + " SELECT field, val, total, scopes FROM f",
        "p3_found": _FREQ
        + """, n AS (
  SELECT 'personagens_final.personagem' AS field, count(DISTINCT livro_id) AS n, 0.10 AS share, 2 AS most FROM personagens_final
  UNION ALL SELECT 'wiki_human_spaceflight_entities.text', count(DISTINCT source_id), 0.25, 1 FROM wiki_human_spaceflight_entities
) SELECT field, val, CASE WHEN scopes >= 3 AND scopes > share * n THEN 'common' ELSE 'rare' END AS mark
FROM f JOIN n USING (field) WHERE (scopes >= 3 AND scopes > share * n) OR (scopes = 1 AND total <= most)""",
    }
