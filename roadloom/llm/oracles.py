"""DuckDB twins of operators over the documents table."""

from __future__ import annotations

#: ``quality_rules`` with its production limits.
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM p),
repeated AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM g, range(3) AS o(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, doc_id, source, x, trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line,
      len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS words
      FROM (SELECT r, doc_id, source, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM l GROUP BY r),
often AS (SELECT source, line FROM l GROUP BY source, line HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) > 5),
gone AS (SELECT r, count(*) AS n_removed_lines, sum(words)::BIGINT AS n_removed_words FROM l JOIN often ON often.source IS NOT DISTINCT FROM l.source AND often.line = l.line GROUP BY r),
c AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, list_sum(list_prepend(0, list_transform(w, lambda x: length(x))))::BIGINT AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(n_removed_words, 0) AS n_removed_words
      FROM d JOIN w USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lines USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 2e-1 * n_words AND n_words - n_removed_words >= 50 AS kept, n_removed_lines, n_removed_words FROM c"""

#: ``jaccard_join`` by comparing all pairs that share a shingle.
LINKS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2) UNION ALL SELECT DISTINCT doc_id, w FROM d WHERE len(w) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM b JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
