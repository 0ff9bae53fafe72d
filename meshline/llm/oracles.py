"""DuckDB SQL for the queries that SQL can express; each gives the operator's rows in its own way."""

from __future__ import annotations

from meshline.llm import lines

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c::BIGINT AS component_id, c = vec_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

NEAR_TEXTS = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c::BIGINT AS component_id, c = d.doc_id AS kept FROM d JOIN c ON a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SUBSTRINGS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, word, CASE WHEN count(*) OVER f = 20 THEN md5(string_agg(word, ' ') OVER f) END AS h FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
l AS (SELECT doc_id, i, word, (h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1)::INT AS later FROM g),
c AS (SELECT doc_id, i, word, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS cut FROM l),
s AS (SELECT doc_id, count(*) FILTER (WHERE cut) AS n, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT cut), '')) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, coalesce(kept, sha256('')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""

ORACLE_SQL = {"op1_embeddings": EMBEDDINGS, "op2_minhash": NEAR_TEXTS, "op3_lines": lines.ORACLE_SQL, "op10_substrings": SUBSTRINGS}
