"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from .chat import BUDGET, ESCAPES, HISTORY, ROLE_END, TURN_END, TURN_OPEN

OP2 = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP9 = r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT *, list_transform(range(8), lambda k: ('0x' || substr(h, 5 * k::INT + 1, 5))::BIGINT) AS parts,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a
  FROM p),
d AS (
  SELECT *, array_to_string(list_transform(parts, lambda x:
           substr(a, (x // 32768 + 1)::INT, 1) || substr(a, (x // 1024 % 32 + 1)::INT, 1)
           || substr(a, (x // 32 % 32 + 1)::INT, 1) || substr(a, (x % 32 + 1)::INT, 1)), '') AS payload_digest,
         max(page_id) OVER (PARTITION BY h) AS last
  FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""


def _escaped(text: str) -> str:
    for plain, code in ESCAPES:
        text = f"replace({text}, '{plain}', '{code}')"
    return text


OP8 = rf"""
WITH r AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         '{TURN_OPEN}' || {_escaped("coalesce(role, '')")} || '{ROLE_END}' || {_escaped("coalesce(text, '')")} || '{TURN_END.strip()}' || chr(10) AS chunk
  FROM r),
t AS (
  SELECT *, len(regexp_extract_all(chunk, '[^\x20\x09-\x0D]+')) AS tokens FROM c),
s AS (
  SELECT *, row_number() OVER w - 1 AS place, sum(tokens) OVER w - tokens AS before
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
n AS (
  SELECT *, (before // {BUDGET // 2}) * 2 + (tokens > {BUDGET // 2})::INT AS span FROM s),
e AS (
  SELECT conv_id, span, max(before + tokens) AS finish FROM n GROUP BY ALL),
f AS (
  SELECT *, lead(span) OVER (PARTITION BY conv_id ORDER BY span) AS next,
         count(*) OVER (PARTITION BY conv_id) AS windows FROM e),
x AS (
  SELECT n.*, length(chunk) * CASE
           WHEN place = 0 AND role = 'system' THEN f.windows
           WHEN f.next IS NOT NULL AND f.finish - before <= {HISTORY} THEN 2 ELSE 1 END AS chars
  FROM n JOIN f USING (conv_id, span)),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss,
         sum(chars)::BIGINT AS formatted_chars
  FROM x GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

OP11 = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 100 = 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM n WHERE rank <= 10
"""

OP12 = """
WITH RECURSIVE f AS (
  SELECT row_number() OVER () AS r, doc_id, lang, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
crc AS (  -- the checksum of a decimal id, bit by bit
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS t, 0 AS k, 4294967295::BIGINT AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, t, k + 1,
         list_reduce([xor(c, CASE WHEN k % 8 = 0 THEN ascii(t[k // 8 + 1])::BIGINT ELSE 0 END), 0],
                     lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
  FROM crc WHERE k < 8 * length(t)),
l AS (
  SELECT f.*, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen((n_chars + CASE WHEN xor(c, 4294967295) % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR) || ':'
           || (n_chars + CASE WHEN xor(c, 4294967295) % 7 = 0 THEN 1 ELSE 0 END), '-') || tail) AS tried
  FROM f LEFT JOIN crc ON f.doc_id = crc.doc_id AND crc.k = 8 * length(crc.t)),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM l),
low AS (
  SELECT g, 0 AS lv, i, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM p
  UNION ALL
  SELECT g, lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY g, lv, i // 2),
top AS (SELECT g, h AS subroot FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lv, g AS i, subroot AS h, count(*) OVER () AS n FROM top
  UNION ALL
  SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY lv, i // 2),
steps AS (  -- a sibling for each row and level, null where the run has one node
  SELECT p.r, a.lv, p.i // (1 << a.lv) % 2 AS side, b.h
  FROM p JOIN (SELECT DISTINCT g, lv FROM low WHERE n > 1) a USING (g)
  LEFT JOIN low b ON b.g = p.g AND b.lv = a.lv AND b.i = xor(p.i // (1 << a.lv), 1)
  UNION ALL
  SELECT p.r, 100 + a.lv, p.g // (1 << a.lv) % 2, b.h
  FROM p CROSS JOIN (SELECT DISTINCT lv FROM high WHERE n > 1) a
  LEFT JOIN high b ON b.lv = a.lv AND b.i = xor(p.g // (1 << a.lv), 1)),
path AS (
  SELECT r, list(struct_pack(side := side, h := h) ORDER BY lv) AS steps, string_agg(h, '' ORDER BY lv) AS siblings FROM steps GROUP BY r),
folded AS (
  SELECT p.r, 0 AS k, p.tried AS h, coalesce(path.steps, []) AS steps FROM p LEFT JOIN path USING (r)
  UNION ALL
  SELECT r, k + 1, sha256(CASE WHEN steps[k + 1].side = 1 THEN coalesce(steps[k + 1].h, '') || h ELSE h || coalesce(steps[k + 1].h, '') END), steps
  FROM folded WHERE k < len(steps))
SELECT p.doc_id, p.leaf, top.subroot, high.h AS root, sha256(coalesce(path.siblings, '')) AS proof_sha256,
       folded.h AS folded_root, folded.h = high.h AS verified
FROM p JOIN top USING (g) JOIN high ON high.n = 1 LEFT JOIN path USING (r) JOIN folded ON folded.r = p.r AND folded.k = len(folded.steps)
"""

ORACLES = {"op11_topk": OP11, "op12_merkle": OP12, "op2_exact_dedup": OP2, "op8_chat": OP8, "op9_warc": OP9}
