"""Queries of the llm operators, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from weftgraph.llm.chat import op6_chat
from weftgraph.llm.classifiers import op1_quality, op10_toxicity
from weftgraph.llm.decontaminate import op8_decontaminate
from weftgraph.llm.language import op2_language
from weftgraph.llm.lexical import op12_lexical
from weftgraph.llm.mixing import op4_mix
from weftgraph.llm.private_data import op13_private
from weftgraph.llm.repair import op11_repair
from weftgraph.llm.simhash import op5_simhash
from weftgraph.llm.suffix_dedup import op7_suffix_dedup
from weftgraph.llm.token_counts import op9_token_counts
from weftgraph.llm.topk import op3_topk

QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_topk": op3_topk,
    "op4_mix": op4_mix,
    "op5_simhash": op5_simhash,
    "op6_chat": op6_chat,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_repair": op11_repair,
    "op12_lexical": op12_lexical,
    "op13_private": op13_private,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Where each of the strings `found`, in order, ends in `text`: a match is the first place of its string behind the match before it.
_ENDS = """list_slice(list_reduce([[0]::BIGINT[]] || list_transform(range(1, len(found) + 1), lambda i: [i]),
  lambda a, x: a || [a[-1] + strpos(substr(text, a[-1] + 1), found[x[1]]) - 1 + length(found[x[1]])]), 2, len(found) + 1)"""

#: A state of op11's recursion that can't be reached.
_NONE = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"


def _edit(state: str, initial: str, role: str, inserted: str) -> str:
    """op11's recursion: a turn kept, or given `role`, behind `state`, with or without an inserted turn before it."""
    add, letter, line = (2, "I", f" || chr(10) || '{inserted}:'") if inserted else (0, "", "")
    keeps = f"e.l = '{initial}'"
    return (
        f"{{'c': {state}.c + {add} + e.t + CASE WHEN e.must THEN 1000000000 WHEN {keeps} THEN 0 ELSE 2 END, 'a': {state}.a || CASE WHEN {keeps} THEN '{letter}K' ELSE '{letter}R' END, "
        f"'t': {state}.t{line} || chr(10) || CASE WHEN {keeps} THEN e.role ELSE '{role}' END || ':' || e.text}}"
    )


ORACLES = {
    "op3_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
),
m AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
""",
    "op12_lexical": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
q AS (SELECT item, item_id, t, count(*) AS n FROM (SELECT item, item_id, unnest(w) AS t FROM i) GROUP BY 1, 2, 3),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY 1, 2, 3, 4),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), g),
s AS (
  SELECT item, item_id, r, doc_id, CAST(sum(q.n * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * p.n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN p ON q.t = p.t JOIN w ON q.t = w.t, g GROUP BY 1, 2, 3, 4
),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
""",
    # The spans that only anchors find (url, account) aren't in this SQL: a document that holds one would differ.
    "op13_private": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT r, text, 1 AS k, 'email' AS kind, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS found FROM d
  UNION ALL SELECT r, text, 2, 'ip', regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
  UNION ALL SELECT r, text, 3, 'card', regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+') FROM d
  UNION ALL SELECT r, text, 4, 'phone', regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]') FROM d
),
e AS (SELECT r, k, kind, found, {_ENDS} AS ends FROM m WHERE len(found) > 0),
f AS (SELECT r, k, kind, unnest(found) AS x, unnest(ends) AS stop FROM e),
g AS (SELECT r, k, kind, x, stop - length(x) AS start, stop, regexp_replace(x, '[^0-9]', '', 'g') AS digits FROM f),
o AS (
  SELECT * FROM g WHERE CASE kind WHEN 'email' THEN true WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS INTEGER), 999) > 255)) = 0
    ELSE length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 THEN CAST(digits[i] AS INTEGER)
      ELSE 2 * CAST(digits[i] AS INTEGER) - CASE WHEN digits[i] > '4' THEN 9 ELSE 0 END END)) % 10 = 0 END
),
s AS (
  SELECT r, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) AS spans,
    count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, count(*) FILTER (k = 3) AS n3, count(*) FILTER (k = 4) AS n4 FROM o GROUP BY r
)
SELECT doc_id, coalesce(n1, 0) AS n_email, coalesce(n2, 0) AS n_ip, coalesce(n3, 0) AS n_card, coalesce(n4, 0) AS n_phone,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s ON d.r = s.r
""",
    "op11_repair": f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (
  SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(key) + 1), lambda i: CAST(ord(key[i]) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS f FROM k
),
g AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT c.*, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) FROM c WHERE f <> 0)
),
o AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
b AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o
),
r AS (
  SELECT conv_id, turn, role, text, i, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS trunc,
    before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM b
),
ids AS (SELECT row_number() OVER () AS id, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
x AS (SELECT id, r.* FROM r JOIN ids ON r.conv_id IS NOT DISTINCT FROM ids.conv_id),
p AS (
  SELECT id, CAST(0 AS BIGINT) AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS n, {_NONE} AS s, {_NONE} AS u, {_NONE} AS v FROM ids
  UNION ALL
  SELECT p.id, e.i, {{'c': n.c + 3, 'a': n.a || 'D', 't': n.t}},
    list_min([{{'c': s.c + 3, 'a': s.a || 'D', 't': s.t}}, {{'c': n.c + e.t + (CASE WHEN e.must OR e.l <> 's' THEN 1000000000 ELSE 0 END), 'a': n.a || 'K', 't': n.t || chr(10) || e.role || ':' || e.text}}]),
    list_min([{{'c': u.c + 3, 'a': u.a || 'D', 't': u.t}}, {_edit("n", "u", "user", "")}, {_edit("s", "u", "user", "")}, {_edit("v", "u", "user", "")}, {_edit("u", "u", "user", "assistant")}]),
    list_min([{{'c': v.c + 3, 'a': v.a || 'D', 't': v.t}}, {_edit("n", "a", "assistant", "user")}, {_edit("s", "a", "assistant", "user")}, {_edit("u", "a", "assistant", "")}, {_edit("v", "a", "assistant", "user")}])
  FROM p JOIN (SELECT id, i, role, text, left(role, 1) AS l, blank OR dup AS must, CAST(trunc AS BIGINT) AS t FROM x) e ON e.id = p.id AND e.i = p.i + 1
),
z AS (
  SELECT id, i, list_min([n, {{'c': s.c + 4, 'a': s.a || 'II', 't': s.t || chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': u.c + 2, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}}, v]) AS best,
    row_number() OVER (PARTITION BY id ORDER BY i DESC) AS last FROM p
),
m AS (
  SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS dup, count(*) FILTER (trunc) AS trunc, count(*) FILTER (illegal) AS illegal FROM x GROUP BY id
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(dup, 0) AS duplicate, coalesce(trunc, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM ids JOIN z ON ids.id = z.id AND z.last = 1 LEFT JOIN m ON ids.id = m.id
""",
}
