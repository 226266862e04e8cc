"""DuckDB SQL of the queries whose operators SQL can express, over the same tables."""

from __future__ import annotations

_ASCII_SPACE = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x,
                  strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 400)) AS h
      FROM d, unnest(range(n - 199)) AS t(i) WHERE n >= 200),
r AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY h) > 1),
e AS (SELECT doc_id, i, i + 200 AS j,
             CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200
                  THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, i, j, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM e),
span AS (SELECT doc_id, k, min(i) AS a, max(j) AS b FROM g GROUP BY doc_id, k),
gap AS (SELECT doc_id, k, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM span
        WINDOW w AS (PARTITION BY doc_id ORDER BY k)
        UNION ALL
        SELECT d.doc_id, 1e9, coalesce(m.b, 0), d.n FROM d
        LEFT JOIN (SELECT doc_id, max(b) AS b FROM span GROUP BY doc_id) m
          ON m.doc_id = d.doc_id),
kept AS (SELECT gap.doc_id,
                string_agg(substr(x, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY k) AS x
         FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY gap.doc_id),
sums AS (SELECT doc_id, sum(b - a) AS lost, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(lost, 0)::BIGINT AS n_removed,
       coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN sums ON sums.doc_id = d.doc_id
"""

_NORMAL = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_OP4 = f"""
WITH bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '{_NORMAL}') AS w
            FROM benchmark),
win AS (SELECT DISTINCT item, len(w[i:i + 9]) AS n, w[i:i + 9] AS g
        FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_NORMAL}') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g
          FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, grams.n, item FROM grams JOIN win ON win.n = grams.n AND win.g = grams.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id
"""

_OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
         ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE a = e.vec_id)::BIGINT AS n_links,
       least(e.vec_id, (SELECT min(b) FROM reach WHERE a = e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, (SELECT min(b) FROM reach WHERE a = e.vec_id)) AS kept
FROM embeddings e
"""

_FRAME = r"regexp_replace(regexp_replace({0}, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?INST\])', '[\\\1', 'g')"
_OP7 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {_FRAME.format('role')} AS role_out, {_FRAME.format('text')} AS text_out FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
         AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(6 + length(role_out) + 7 + length(text_out) + 4))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ASCII_SPACE}') AS w
                     FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 4] AS g
      FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
           FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
         WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
root AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       least(w.doc_id, root.b) AS component_id, w.doc_id = least(w.doc_id, root.b) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN root ON root.a = w.doc_id
"""

_OP10 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_ASCII_SPACE}') AS w
           FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g
      FROM w, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35),
r AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY g) > 1),
kept AS (SELECT w.doc_id, string_agg(w.w[p], ' ' ORDER BY p) AS t, count(*) AS n
         FROM w, unnest(range(1, len(w.w) + 1)) AS u(p)
         WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND r.i BETWEEN p - 34 AND p)
         GROUP BY w.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_OP11 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_NORMAL}') AS w
                        FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
b AS (SELECT item_id, text, t, count(*) AS q
      FROM (SELECT item_id, text, unnest(regexp_extract_all({_LOWER}, '{_NORMAL}')) AS t
            FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (SELECT r, doc_id, n, t, count(*) AS tf
      FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d)
      WHERE t IN (SELECT t FROM b) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
      FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s),
x AS (SELECT item_id, text, r, doc_id, sum(q * weight * ((1000000000 * tf)
             // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))))::BIGINT AS score
      FROM p JOIN b USING (t) JOIN f USING (t), s GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text
                                   ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM x WHERE score > 0) WHERE rank <= 20
"""

ORACLE = {
    "op1_suffix_dedup": _OP1, "op4_decontaminate": _OP4, "op6_embedding_dedup": _OP6,
    "op7_chat_format": _OP7, "op8_minhash_dedup": _OP8, "op10_substring_dedup": _OP10,
    "op11_ranked_search": _OP11,
}
