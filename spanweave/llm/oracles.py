"""The operators' queries in DuckDB's SQL, where SQL can express them."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = f"translate({{}}, '{_UP}', '{_LOW}')"

LINES = f"""
WITH lines AS (
  SELECT doc_id, i, ls[i] AS line, {_LOWER.format(f"trim(ls[i], {_WHITE})")} AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) t(i)
), repeated AS (
  SELECT key, min(doc_id) AS keep FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (r.key IS NOT NULL AND l.doc_id <> r.keep) AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (r.key IS NULL OR l.doc_id = r.keep), '')) AS kept_sha256
FROM lines l LEFT JOIN repeated r ON r.key = l.key GROUP BY l.doc_id
"""

NEAR = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words
), each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN pairs l ON l.a = r.other)
SELECT s.doc_id, len(s.s) AS n_shingles, m.c AS component_id, m.c = s.doc_id AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) m USING (doc_id)
"""

_CONTROL = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>"]


def _added(x: str) -> str:
    """Length of a text with its control strings broken and its backslashes doubled."""
    s = f"replace({x}, '\\', '\\\\')"
    for c in _CONTROL:
        s = f"replace({s}, '{c}', '{c[0]}\\{c[1:]}')"
    return f"length({s})"


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len("<|turn|>") + len("<|text|>") + len("<|end|>")} + {_added("role")} + {_added("text")}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

SQL = {"op2_line_dedup": LINES, "op7_near_dedup": NEAR, "op10_chat_format": CHAT}
