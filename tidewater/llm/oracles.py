"""SQL that gives the same rows as the queries, where SQL can."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4 = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"

_ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '###', '\\#\\#\\#'), '</turn>', '\\</turn>')"
_TRICKY = "'\\### Assistant: </turn> ok'"
OP5 = f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_TRICKY} UNION ALL SELECT -7, 1, 'assistant', {_TRICKY})
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(replace({_ESCAPED.format('role')}, ':', '\\:')) + 2 + length({_ESCAPED.format('text')}) + 9) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

OP6 = f"""WITH d AS (SELECT doc_id, {_WORDS.replace('text', "coalesce(text, '')", 1)} AS ws FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(list_slice(ws, k, k + least(len(ws), 10) - 1), ' ') AS key
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS key
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM w))),
m AS (SELECT doc_id, k, dw.n AS n, item FROM dw JOIN w ON dw.n = w.n AND dw.key = w.key),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id"""

OP10 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, q.e AS qe, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM q, v c WHERE c.vec_id <> q.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, qe ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5"""
