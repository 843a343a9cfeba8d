"""SQL statements of the queries of this subpackage that SQL can express whole."""

from __future__ import annotations

from probanza.llm import quality

_WORD = r"[^\x20\x09-\x0D]"

_TEXTS = f"""
d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, regexp_extract_all(text, '{_WORD}+') AS words FROM d),
w AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM s)"""


def _run(n: int) -> str:
    """The run of n words that begins at a word, as text; null near the end."""
    return " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, n))])


def _rates() -> dict[str, str]:
    return {
        "length": "floor(1000 * word_chars / greatest(n_words, 1))", "symbols": "floor(1000 * n_symbols / greatest(n_words, 1))",
        "marks": "floor(1000 * n_marks / greatest(n_words, 1))", "dup_lines": "floor(1000 * n_dup_lines / greatest(n_lines, 1))",
        "repeats": "floor(1000 * n_repeat_words / greatest(n_words, 1))",
    }


def _quality_rules() -> str:
    rates, slack = _rates(), quality.SLACK
    cells = " UNION ALL ".join(
        f"SELECT lang, source, '{k}' AS rate, {slack[k]} AS slack, CAST({v} AS BIGINT) AS x FROM m WHERE NOT base_failed" for k, v in rates.items()
    )
    inside = []
    for k, v in rates.items():
        low = f" AND {v} >= lo" if k == "length" else ""
        inside.append(f"(SELECT coalesce(bool_and({v} <= hi{low}), true) FROM fences f WHERE f.rate = '{k}' AND f.lang IS NOT DISTINCT FROM m.lang AND f.source IS NOT DISTINCT FROM m.source)")
    return f"""
WITH {_TEXTS},
runs AS (SELECT r, i, {_run(8)} AS run FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, run) AS n FROM runs WHERE run IS NOT NULL) WHERE n > 1),
steps AS (SELECT r, least(8, i - lag(i, 1, -8) OVER (PARTITION BY r ORDER BY i)) AS step FROM twice),
repeated AS (SELECT r, sum(step) AS n FROM steps GROUP BY r),
l AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}') GROUP BY r),
raw AS (SELECT d.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
    coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines, CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN s USING (r) LEFT JOIN l USING (r) LEFT JOIN repeated USING (r)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM raw),
cells AS (SELECT lang, source, rate, slack, CASE WHEN x < 64 THEN x ELSE (x >> (length(bin(x)) - 6)) << (length(bin(x)) - 6) END AS b FROM ({cells})),
q AS (SELECT lang, source, rate, slack, grouping(lang) + grouping(source) AS wide, count(*) AS n, list_sort(list(b)) AS bs FROM cells
  GROUP BY GROUPING SETS ((rate, slack, lang, source), (rate, slack, lang), (rate, slack))),
e AS (SELECT *, bs[(n + 3) // 4] - reach AS lo, bs[(3 * n + 3) // 4] + reach AS hi
  FROM (SELECT *, {quality.REACH} * (bs[(3 * n + 3) // 4] - bs[(n + 3) // 4]) + slack AS reach FROM q)),
fences AS (SELECT own.lang, own.source, own.rate,
    CASE WHEN own.n >= {quality.LEAST} THEN own.lo WHEN by_lang.n >= {quality.LEAST} THEN by_lang.lo ELSE every.lo END AS lo,
    CASE WHEN own.n >= {quality.LEAST} THEN own.hi WHEN by_lang.n >= {quality.LEAST} THEN by_lang.hi ELSE every.hi END AS hi
  FROM (SELECT * FROM e WHERE wide = 0) own
  JOIN (SELECT * FROM e WHERE wide = 1) by_lang ON own.rate = by_lang.rate AND own.lang IS NOT DISTINCT FROM by_lang.lang
  JOIN (SELECT * FROM e WHERE wide = 2) every ON own.rate = every.rate)
SELECT doc_id, n_words, word_chars, n_symbols, n_marks, n_lines, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(inside)} AS kept
FROM m"""


#: The join is exact: candidates share one of the rarest shingles, enough of them that no pair at 0.8 is missed.
_NGRAM_JACCARD_JOIN = f"""
WITH RECURSIVE {_TEXTS},
runs AS (SELECT r, {_run(5)} AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
grams AS (SELECT DISTINCT r, g FROM runs WHERE g IS NOT NULL
  UNION ALL SELECT r, array_to_string(words, ' ') FROM s WHERE len(words) BETWEEN 1 AND 4),
keys AS (SELECT r, md5(string_agg(g, chr(10) ORDER BY g)) AS key, count(*) AS size FROM grams GROUP BY r),
member AS (SELECT r, doc_id, coalesce(key, '') AS key, coalesce(size, 0) AS size FROM d LEFT JOIN keys USING (r)),
class AS (SELECT key, min(doc_id) AS class_id, count(*) AS n_copies, min(r) AS c, min(size) AS size FROM member GROUP BY key),
set_of AS (SELECT c, g, size, count(*) OVER (PARTITION BY g) AS f FROM grams JOIN class ON grams.r = class.c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY f, g) AS k FROM set_of),
rare AS (SELECT c, g, size FROM ranked WHERE f > 1 AND k <= size - (4 * size + 4) // 5 + 1),
near AS (SELECT DISTINCT a.c AS a, b.c AS b, a.size AS na, b.size AS nb FROM rare a JOIN rare b ON a.g = b.g AND a.c < b.c
  WHERE 5 * least(a.size, b.size) >= 4 * greatest(a.size, b.size)),
link AS (SELECT a, b FROM near JOIN set_of x ON x.c = near.a JOIN set_of y ON y.c = near.b AND y.g = x.g
  GROUP BY a, b, na, nb HAVING 9 * count(*) >= 4 * (na + nb)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a, a AS b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
grp AS (SELECT a AS c, min(class_id) AS group_id FROM reach JOIN class ON class.c = reach.b GROUP BY a),
links AS (SELECT a AS c, count(*) AS n FROM edge GROUP BY a)
SELECT doc_id, class_id, n_copies, coalesce(links.n, 0) AS n_links, coalesce(group_id, class_id) AS group_id
FROM member JOIN class USING (key) LEFT JOIN links ON links.c = class.c LEFT JOIN grp ON grp.c = class.c"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _share(n: str, total: str) -> str:
    return f"1 + (1000000000 * ({n} + 1)::HUGEINT) // ({total} + v)::HUGEINT"


_SOURCE_DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{_UPPER}', '{_LOWER}') AS term
  FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
lang_of AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, v, lang_total, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source) LEFT JOIN lang_of USING (lang)),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, {_share("coalesce(n, 0)", "total")} AS p,
    {_share("lang_n", "lang_total")} AS lang_p
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
met AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN met ON met.lang = a.lang AND met.source = a.source AND met.item = b.source),
own AS (SELECT lang, source, term AS item, (p - lang_p) * (p - lang_p) // lang_p AS value FROM p WHERE n > 0 AND p > lang_p),
ranked AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM own))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


#: Scores are sums of whole numbers below 2**53, so doubles hold them exactly.
_HARD_NEGATIVES = """
WITH x AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false))), true)),
scored AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM x a JOIN x b ON a.vec_id % 100 = 0 AND a.r <> b.r),
positive AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5),
slot AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM positive),
negative AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.k ORDER BY n.score DESC, n.vec_id) AS rank
  FROM slot p JOIN scored n ON n.r = p.r AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5"""


_EMBEDDING_NEAR_DEDUP = """
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, vec_id, embedding,
    list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false))) AND list_bool_or(list_transform(embedding, lambda c: c <> 0)) AS ok
  FROM embeddings),
x AS (SELECT r, vec_id, CASE WHEN ok THEN list_transform(embedding, lambda c: coalesce(c, 0)::DOUBLE) ELSE [] END AS v FROM t),
link AS (SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.r <> b.r
  AND CASE WHEN len(a.v) = len(b.v) AND len(a.v) > 0 THEN list_cosine_similarity(a.v, b.v) >= 0.95 ELSE false END),
reach AS (SELECT r AS a, r AS b FROM x UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
comp AS (SELECT a AS r, min(vec_id) AS component_id FROM reach JOIN x ON x.r = reach.b GROUP BY a),
degree AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM x JOIN comp USING (r) LEFT JOIN degree USING (r)"""


SQL: dict[str, str] = {
    "op4_quality_rules": _quality_rules(),
    "op9_ngram_jaccard_join": _NGRAM_JACCARD_JOIN,
    "op11_hard_negatives": _HARD_NEGATIVES,
    "op12_source_divergence": _SOURCE_DIVERGENCE,
    "op13_embedding_near_dedup": _EMBEDDING_NEAR_DEDUP,
}
