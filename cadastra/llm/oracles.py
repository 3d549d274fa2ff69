"""DuckDB SQL for the operators that SQL can state."""

from __future__ import annotations


def ngram_join(k: int, percent: int) -> str:
    """Rows of ngram_join.join over documents with distinct doc_ids."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS g FROM p),
s AS (SELECT DISTINCT doc_id, g FROM g WHERE i <= greatest(n - {k - 1}, 1)),
c AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS cls FROM s GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, cb.cls AS cls_b, ca.cls AS cls_a FROM x JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * shared >= {percent} * (ca.n + cb.n - shared)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, least(d.doc_id, m.least) AS component_id, coalesce(n.links, 0)::BIGINT AS n_links
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY 1) m USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(DISTINCT cls_b) AS links FROM l WHERE cls_a <> cls_b GROUP BY 1) n USING (doc_id)"""


def substring_dedup(window: int) -> str:
    """Rows of substrings.dedup, kept words hashed, over documents with distinct doc_ids."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
h AS (SELECT *, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)) AS h FROM p),
r AS (SELECT *, i <= n - {window - 1} AND count(*) FILTER (i <= n - {window - 1}) OVER (PARTITION BY h) > 1 AS again FROM h),
c AS (SELECT doc_id, word, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
