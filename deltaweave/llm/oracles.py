"""DuckDB counterparts of the queries that SQL can express; no Python is shared with the operators."""

from __future__ import annotations


def _components(links: str) -> str:
    """``reached(i, j)``: all ids that links ``(i, j)``, given in both directions, lead to."""
    return f"reached(i, j) AS (SELECT i, j FROM {links} UNION SELECT r.i, l.j FROM reached r JOIN {links} l ON l.i = r.j)"


EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v WHERE label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.98),
{_components("links")},
told AS (SELECT v.vec_id, (SELECT count(*) FROM links WHERE i = v.vec_id) AS n_links, least(v.vec_id, (SELECT min(j) FROM reached WHERE i = v.vec_id)) AS component_id FROM v)
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM told"""

#: Runs of characters other than ASCII white space.
_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: {{'s': i, 'h': md5_number(array_to_string(list_slice(w, i, i + 19), ' '))}})) AS u FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, u.s AS s, row_number() OVER (PARTITION BY u.h ORDER BY doc_id, u.s) AS r FROM s),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM k WHERE r > 1),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.p IS NULL GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
x AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM x),
links AS MATERIALIZED (SELECT a.doc_id AS i, b.doc_id AS j FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
{_components("links")}, m AS (SELECT i, min(j) AS j FROM reached GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, j) AS component_id FROM x LEFT JOIN m ON m.i = doc_id"""
