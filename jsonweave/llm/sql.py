"""DuckDB SQL with the results of the queries that SQL can express."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _quality() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    bound = {"mean_word_chars": "word_chars / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(n_words, 1)", "stop_ratio": "n_stop / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)"}
    tests = [f"{bound.get(r.measure, r.measure)} {op} {v}" for r in RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None]
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
w AS (SELECT rid, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
t AS (SELECT rid, i, x, lead(x) OVER s AS y, lead(x, 2) OVER s AS z FROM w WINDOW s AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS n FROM t WHERE z IS NOT NULL),
r AS (SELECT rid, count(DISTINCT k) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM c WHERE n > 1) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {" AND ".join(tests)}) AS kept
FROM b"""



#: Words of all documents; A-Z as a-z where ``fold`` is put in.
_LISTS = r"""d AS (SELECT doc_id, list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents)"""
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _near_duplicates() -> str:
    return rf"""
WITH RECURSIVE {_LISTS.format(_FOLD)},
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, e.b FROM r JOIN both_ways e ON r.other = e.a),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON node = doc_id"""


def _substrings() -> str:
    return rf"""
WITH {_LISTS.format("coalesce(text, '')")},
w AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM d),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY 1),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (g) WHERE first < doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM w ANTI JOIN h USING (doc_id, i) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_removed FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)"""


def oracles() -> dict[str, str]:
    return {"op1_ngram_join": _near_duplicates(), "op8_substring_dedup": _substrings(), "op10_quality_rules": _quality()}
