"""DuckDB SQL of the queries whose results their contracts determine without a library or a model."""

from __future__ import annotations

from .license_scan import oracle

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(pattern: str, table: str = "documents", key: str = "doc_id", lower: bool = True) -> str:
    text = f"translate(text, '{UPPER}', '{LOWER}')" if lower else "text"
    return f"SELECT {key}, coalesce(regexp_extract_all({text}, '{pattern}'), []) AS words FROM {table}"


def _windows(words: str, key: str, size: str) -> str:
    """Windows of ``size`` words: key, size, first place (from 1) and print."""
    return f"""SELECT {key}, size, i AS head, md5(array_to_string(words[i:i + size - 1], ' ')) AS h
FROM (SELECT {key}, words, {size} AS size, unnest(range(1, len(words) - {size} + 2)) AS i FROM {words} WHERE len(words) >= {size})"""


SUBSTRINGS = f"""WITH w AS ({_words(SPACED, lower=False)}), win AS ({_windows("w", "doc_id", "20")}),
again AS (SELECT doc_id, head FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, head) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, head + k AS pos FROM again, (SELECT unnest(range(20)) AS k)),
tok AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM tok ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

NEAR = f"""WITH RECURSIVE w AS ({_words(SPACED)}),
sets AS (SELECT DISTINCT doc_id, h FROM ({_windows("w", "doc_id", "5")})
  UNION ALL SELECT doc_id, md5(array_to_string(words, ' ')) FROM w WHERE len(words) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ USING (doc_id)"""

CONTAMINATION = f"""WITH w AS ({_words(ALNUM)}), items AS ({_words(ALNUM, "benchmark", "item_id")}),
iwin AS ({_windows("items", "item_id", "13")} UNION ALL
  SELECT item_id, len(words), 1, md5(array_to_string(words, ' ')) FROM items WHERE len(words) BETWEEN 1 AND 12),
lens AS (SELECT DISTINCT size AS s FROM iwin),
dwin AS ({_windows("(SELECT doc_id, words, s FROM w, lens)", "doc_id", "s")}),
hits AS (SELECT DISTINCT doc_id, d.head, d.size, item_id, i.head AS item_head FROM dwin d JOIN iwin i ON d.h = i.h AND d.size = i.size),
runs AS (SELECT doc_id, item_id, min(item_head) - 1 AS item_start, min(head) - 1 AS doc_start, count(*) + size - 1 AS n FROM (
  SELECT *, head - row_number() OVER (PARTITION BY doc_id, item_id, size, head - item_head ORDER BY head) AS run FROM hits)
  GROUP BY doc_id, item_id, size, head - item_head, run),
longest AS (SELECT doc_id, n AS longest_words, item_id::VARCHAR AS longest_item, item_start, doc_start FROM runs
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id::VARCHAR, item_start, doc_start) = 1),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(head, head + size)) AS pos FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY 1)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n > 0 AND 20 * c.n >= len(words), false) AS contaminated,
  coalesce(longest_words, 0)::BIGINT AS longest_words, longest_item, item_start::BIGINT AS item_start, doc_start::BIGINT AS doc_start
FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id) LEFT JOIN longest l USING (doc_id)"""

_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b::BIGINT)) AS t)"""


def _crc32(text: str) -> str:
    """CRC-32 of a text of ASCII characters; needs ``crc_table``."""
    return f"""xor(4294967295, list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT),
  lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295))"""


_PRINT = "md5(length(role) || ':' || role || text)"

TRIE = f"""WITH {_TABLE},
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, {_PRINT} AS p, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_PRINT}) - 1 AS pos
  FROM turns),
cnt AS (SELECT conv_id, count(*) AS n FROM own GROUP BY 1),
c AS (SELECT conv_id, n, {_crc32("conv_id::VARCHAR")} % 6 AS h, conv_id - conv_id % 100 AS base FROM cnt, crc_table),
made AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS given FROM c LEFT JOIN cnt b ON b.conv_id = c.base),
rebuilt AS (SELECT conv_id, pos - h + given + 1 AS d, p, size FROM made JOIN own USING (conv_id) WHERE pos >= h
  UNION ALL SELECT m.conv_id, o.pos + 1, p, size FROM made m JOIN own o ON o.conv_id = m.base WHERE o.pos < m.given),
paths AS (SELECT conv_id, d, size, string_agg(p, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS k FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM made),
plain AS (SELECT d, k, left(k, greatest(length(k) - 32, 0)) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(size) AS size FROM paths GROUP BY d, k),
kids AS (SELECT up AS k, count(*) AS n FROM plain WHERE d > 0 GROUP BY 1),
nodes AS (SELECT plain.*, coalesce(n, 0) AS n_children FROM plain LEFT JOIN kids USING (k)),
sub AS (SELECT DISTINCT a.k AS top, b.k FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM sub JOIN nodes USING (k) GROUP BY 1),
ends AS (SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (
  SELECT conv_id, arg_max(k, d) AS k FROM paths GROUP BY 1) GROUP BY 1)
SELECT x.conv_id, x.d::BIGINT AS depth, CASE WHEN x.d > 0 THEN y.conv_id END AS parent_conv_id, x.n_convs, x.n_children, n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes x JOIN nodes y ON y.k = x.up LEFT JOIN sums ON sums.top = x.k LEFT JOIN ends ON ends.k = x.k"""


def _least(*options: str) -> str:
    return f"list_min(list_filter([{', '.join(options)}], lambda z: z IS NOT NULL))"


def _edit(letter: str, cost: str, line: str | None, after: str) -> str:
    """The best end of a conversation after one more edit: cost, audit, lines."""
    lines = f"{after}.t" if line is None else f"[{line}] || {after}.t"
    return f"{{'c': {cost} + {after}.c, 'a': '{letter}' || {after}.a, 't': {lines}}}"


def _step(state: int) -> str:
    """The best end before a row in one of the states start, after system, after user, after assistant."""
    nxt, role = (3, "assistant") if state == 2 else (2, "user")
    keeps = [("u", 2)] * (state != 2) + [("a", 3)] * (state == 2) + [("s", 1)] * (state == 0)
    own = [_edit("D", "2", None, f"s{state}"),
           f"CASE WHEN stays THEN {_edit('R', '1 + extra', repr(role + ':') + ' || text', f's{nxt}')} END"]
    own += [f"CASE WHEN stays AND left(role, 1) = '{i}' THEN {_edit('K', 'extra', "role || ':' || text", f's{to}')} END" for i, to in keeps]
    return f"{_least(*own)} AS s{state}"


def _inserted(state: int) -> str:
    nxt, role = (3, "assistant") if state == 2 else (2, "user")
    return f"{_least(f's{state}', _edit('I', '5', repr(role + ':'), f's{nxt}'))} AS s{state}"


_ALL = ", ".join(_inserted(s) for s in range(4))
_END = "{'c': 0, 'a': '', 't': []::VARCHAR[]}"
REPAIR = f"""WITH RECURSIVE {_TABLE},
drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS draw FROM conversations, crc_table),
broken AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
  CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_PRINT}, copy) AS i FROM broken),
known AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut_off,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
rows_ AS (SELECT *, NOT blank AND NOT again AS stays, CASE WHEN cut_off THEN 5 ELSE 0 END AS extra FROM known),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
  count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (stays AND cut_off) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY 1),
search AS (
  SELECT conv_id, n + 1 AS i, {_END} AS s0, {{'c': 10, 'a': 'II', 't': ['user:', 'assistant:']}} AS s1,
    {{'c': 5, 'a': 'I', 't': ['assistant:']}} AS s2, {_END} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, i, {_ALL} FROM (SELECT conv_id, i, {_ALL} FROM (
    SELECT r.conv_id, r.i - 1 AS i, {", ".join(_step(s) for s in range(4))}
    FROM search r JOIN rows_ x ON x.conv_id IS NOT DISTINCT FROM r.conv_id AND x.i = r.i - 1))),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit,
  sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256
FROM every e LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN (SELECT * FROM search WHERE i = 1) q ON q.conv_id IS NOT DISTINCT FROM e.conv_id"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": SUBSTRINGS, "op4_license_scan": oracle(), "op5_near_dedup": NEAR, "op10_decontaminate": CONTAMINATION,
    "op11_conversation_repair": REPAIR, "op13_conversation_trie": TRIE}
