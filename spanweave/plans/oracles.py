"""The registered queries in DuckDB's SQL, written apart from the DataFrame plans."""

from __future__ import annotations

from ..functions.text import ADJECTIVES, FUNCTION_WORDS, NOUNS, TO_PLURAL, TO_SINGULAR
from ..sources.tables import PROPERTIES


def _rules(x: str, rules: list[tuple[str, str]]) -> str:
    cases = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN regexp_replace({x}, '{p}', '{r.replace('$', chr(92))}')" for p, r in rules)
    return f"CASE WHEN {x} = '' THEN {x} {cases} ELSE {x} END"


def _soft(x: str) -> str:
    return f"lower(trim(translate(replace(replace(replace(replace({x}, '\'\'', ' '), ' s ', ' '), ' s', ' '), 's ', ' '), '!:,\'\'\"?', '')))"


def _tag(t: str) -> str:
    known = " ".join(f"WHEN {t} = '{w}' THEN '{k}'" for w, k in FUNCTION_WORDS.items())
    return f"CASE WHEN {t} IN {ADJECTIVES} THEN 'JJ' {known} WHEN regexp_matches({t}, '(ed|ing)$') THEN 'VB' WHEN regexp_matches({t}, '[^s]s$') THEN 'NNS' ELSE 'NN' END"


def _hard(x: str) -> str:
    nouns = " ".join(f"WHEN t = '{w}' THEN '{n}'" for w, n in NOUNS.items())
    fixed = f"CASE WHEN {_tag('t')} LIKE 'NN%' THEN {_rules('t', TO_SINGULAR)} WHEN {_tag('t')} IN ('JJ', 'VB') THEN CASE {nouns} ELSE t END ELSE t END"
    return f"lower(trim(array_to_string(list_transform(list_filter(string_split_regex({_soft(x)}, '\\s+'), lambda t: t <> ''), lambda t: {fixed}), ' ')))"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({x}), '[[:punct:]]', '', 'g'), '\\s+'), lambda t: t <> '')"


def _distance(a: str, b: str) -> str:
    """Edit distance by characters: the accented letters of the titles become capitals, which lower-cased text lacks."""
    plain = lambda x: f"translate({x}, 'ßäçèéêíñóöü', 'ABCDEFGHIJK')"
    return f"levenshtein({plain(a)}, {plain(b)})"


def _match(src: str) -> str:
    """Nearest title within two edits of ``text`` of ``src``, the smallest page of equals."""
    near = f"SELECT query_id, page_id, {_distance('text', 'key')} AS distance FROM ({src}) z, keys WHERE abs(length(text) - length(key)) <= 2"
    return f"SELECT query_id, page_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, page_id) AS r FROM ({near}) WHERE distance <= 2) WHERE r = 1"


def _inserted(a: str, b: str) -> str:
    step = f"{{'i': a.i + CASE WHEN substring({a}, a.i + 1, 1) = x.c THEN 1 ELSE 0 END, 'm': a.m + CASE WHEN substring({a}, a.i + 1, 1) = x.c THEN 0 ELSE 1 END, 'c': x.c}}"
    end = f"list_reduce(list_transform(string_split({b}, ''), lambda c: {{'i': 0, 'm': 0, 'c': c}}), lambda a, x: {step}, {{'i': 0, 'm': 0, 'c': ''}})"
    return f"CAST(CASE WHEN length({a}) > length({b}) THEN 1000 ELSE {end}.m + length({a}) - {end}.i END AS INTEGER)"


def _run(a: str, b: str) -> str:
    """Four characters in a row of ``a`` stand in ``b``."""
    return f"len(list_filter(range(1, length({a}) - 2), lambda k: contains({b}, substring({a}, k, 4)))) > 0"


def _resolved(cand: str, tag: str) -> dict[str, str]:
    """Overlap resolution of candidates ``cand`` and the first candidates of what is left."""
    return {
        f"fold{tag}(query_id, o, acc)": f"SELECT query_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(o BIGINT, pos INTEGER, n INTEGER, p DOUBLE)[]) FROM (SELECT DISTINCT query_id FROM {cand}) UNION ALL SELECT f.query_id, c.o, CASE WHEN len(list_filter(f.acc, lambda m: ((m.pos < c.position + c.word_count AND c.position + c.word_count < m.pos + m.n) OR (m.pos < c.position AND c.position < m.pos + m.n)) AND (c.word_count < m.n OR c.p0 < m.p))) > 0 THEN f.acc ELSE list_append(f.acc, struct_pack(o := c.o, pos := c.position, n := c.word_count, p := c.p0)) END FROM fold{tag} f JOIN {cand} c ON c.query_id = f.query_id AND c.o = f.o + 1",
        f"kept{tag}": f"SELECT query_id, unnest(acc) AS m FROM (SELECT query_id, acc, row_number() OVER (PARTITION BY query_id ORDER BY o DESC) AS r FROM fold{tag}) WHERE r = 1",
        f"listed{tag}": f"SELECT c.*, CAST(row_number() OVER (PARTITION BY c.query_id ORDER BY c.o) AS INTEGER) AS ord FROM kept{tag} k JOIN {cand} c ON c.query_id = k.query_id AND c.o = k.m.o",
        f"men{tag}": f"SELECT *, CASE WHEN EXISTS (SELECT 1 FROM listed{tag} b WHERE b.query_id = a.query_id AND b.word_count = a.word_count AND b.ord > a.ord AND b.position < a.position + a.word_count) THEN -1 ELSE 0 END AS chosen FROM listed{tag} a",
        f"prior{tag}": f"SELECT query_id, ord, position, word_count, surface, chosen, CASE WHEN chosen >= 0 THEN link0 END AS link, CASE WHEN chosen >= 0 THEN p0 END AS prob FROM men{tag}",
    }


def _valid(src: str) -> str:
    return f"SELECT p.* REPLACE (coalesce(c.canonical, p.link) AS link) FROM {src} p LEFT JOIN corr c ON c.link = p.link"


_CTES = {
    "names": "SELECT p_name AS surface, p_brand AS link FROM part UNION ALL SELECT unnest(string_split(p_name, ' ')), p_brand FROM part UNION ALL SELECT array_to_string(list_reverse(string_split(p_name, ' ')), ' '), p_brand FROM part WHERE p_partkey % 2 = 0",
    "counts": "SELECT surface, link, count(*) AS n FROM names GROUP BY ALL",
    "dict": "SELECT surface, link, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY surface) AS DOUBLE) AS prob, CAST(row_number() OVER (PARTITION BY surface ORDER BY n DESC, link) AS INTEGER) AS rank FROM counts",
    "items": "SELECT l_orderkey AS query_id, p_name, p_brand, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS INTEGER) AS i FROM lineitem JOIN part ON p_partkey = l_partkey",
    "q": "SELECT query_id, string_agg(p_name, ' ' ORDER BY i) AS text, string_split(string_agg(p_name, ' ' ORDER BY i), ' ') AS w FROM items GROUP BY query_id",
    "sess": "SELECT o_orderkey AS query_id, o_custkey AS session_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS query_ord FROM orders",
    "gold": "SELECT query_id, i AS gold_ord, 2 * i AS position, 2 AS word_count, p_name AS substring, p_brand AS link FROM items",
    "holds": "SELECT DISTINCT query_id, p_brand AS e FROM items",
    "per": "SELECT e, count(*) AS n FROM holds GROUP BY e",
    "rel": "SELECT a.e AS e1, b.e AS e2, CAST(count(*) AS DOUBLE) / CAST(any_value(x.n) + any_value(y.n) - count(*) AS DOUBLE) AS rel FROM holds a JOIN holds b USING (query_id) JOIN per x ON x.e = a.e JOIN per y ON y.e = b.e WHERE (CAST(string_split(a.e, '#')[2] AS INTEGER) + CAST(string_split(b.e, '#')[2] AS INTEGER)) % 7 <> 0 GROUP BY a.e, b.e",
    "grams": "SELECT query_id, CAST(p AS INTEGER) AS position, CAST(n AS INTEGER) AS word_count, array_to_string(w[p + 1 : p + n], ' ') AS surface FROM q, unnest(range(1, len(w) + 1)) t(n), unnest(range(0, len(w))) u(p) WHERE p + n <= len(w)",
    "grams3": "SELECT * FROM grams WHERE word_count <= 3",
    "cand": "SELECT query_id, position, word_count, surface, d.link AS link0, d.prob AS p0, n_cands, row_number() OVER (PARTITION BY query_id ORDER BY word_count DESC, position) AS o FROM grams3 JOIN (SELECT * FROM dict WHERE rank = 1) d USING (surface) JOIN (SELECT surface, CAST(count(*) AS INTEGER) AS n_cands FROM dict GROUP BY surface) USING (surface)",
    **_resolved("cand", ""),
    "sv": "SELECT surface, e1 AS target, sum(prob * rel) / count(*) AS vote FROM (SELECT * FROM dict WHERE prob >= 0.005 AND rank <= 50) d JOIN rel ON rel.e2 = d.link GROUP BY ALL",
    "voted": "SELECT m.query_id, m.ord, m.surface, d.rank, d.link, any_value(d.prob) AS prob, round(coalesce(sum(sv.vote), 0), 9) AS vote FROM men m JOIN (SELECT * FROM dict WHERE prob >= 0.005 AND rank <= 50) d ON d.surface = m.surface LEFT JOIN men o ON o.query_id = m.query_id AND o.ord <> m.ord LEFT JOIN sv ON sv.surface = o.surface AND sv.target = d.link GROUP BY m.query_id, m.ord, m.surface, d.rank, d.link",
    "eps": "SELECT query_id, ord, CAST(coalesce(arg_max(rank, [prob, -rank]) FILTER (vote >= 0.01 AND prob > 0), min(rank)) - 1 AS INTEGER) AS chosen FROM voted GROUP BY query_id, ord",
    "byvote": "SELECT m.query_id, m.ord, m.position, m.word_count, m.surface, coalesce(e.chosen, m.chosen) AS chosen, d.link, d.prob FROM men m LEFT JOIN eps e ON e.query_id = m.query_id AND e.ord = m.ord LEFT JOIN dict d ON d.surface = m.surface AND d.rank = coalesce(e.chosen, m.chosen) + 1",
}


def _coherent(src: str, theta: float, tag: str) -> dict[str, str]:
    """Coherence, pruning by the place among the chosen, and totals over ``src``."""
    return {
        f"act{tag}": f"SELECT query_id, ord, link, prob, count(*) OVER (PARTITION BY query_id) AS n FROM {src} WHERE chosen >= 0",
        f"coh{tag}": f"SELECT a.query_id, a.ord, any_value(a.n) AS n, round(CASE WHEN any_value(a.n) = 1 THEN 1.0 ELSE coalesce(sum(r.rel), 0) / (any_value(a.n) - 1) + any_value(a.prob) / 2 END, 9) AS coherence FROM act{tag} a LEFT JOIN act{tag} b ON b.query_id = a.query_id AND b.ord <> a.ord LEFT JOIN rel r ON r.e1 = a.link AND r.e2 = b.link GROUP BY a.query_id, a.ord",
        f"gone{tag}": f"SELECT query_id, ord, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS place, coherence <= {theta} AS bad FROM coh{tag}",
        f"total{tag}": f"SELECT query_id, sum(CASE WHEN coherence > {theta} THEN coherence ELSE 0 END) / count(*) AS total, count(*) AS n_chosen FROM coh{tag} GROUP BY query_id",
        f"kept{tag}": f"SELECT s.* REPLACE (CASE WHEN g.bad THEN -1 ELSE s.chosen END AS chosen, CASE WHEN g.bad THEN NULL ELSE s.link END AS link) FROM {src} s LEFT JOIN gone{tag} g ON g.query_id = s.query_id AND g.place = s.ord AND g.bad",
    }


_CTES |= {
    "corr": "SELECT link, 'Brand#' || (n - 1) AS canonical FROM (SELECT DISTINCT link, CAST(string_split(link, '#')[2] AS INTEGER) AS n FROM dict) WHERE n % 5 = 0",
    "goldc": _valid("gold"),
    "priorc": _valid("prior"),
    "byvotec": _valid("byvote"),
}
_CTES |= _coherent("prior", 0.12, "_p") | _coherent("priorc", 0.12, "_pc") | _coherent("byvotec", 0.12, "_v")
_CTES |= {
    "since": "SELECT session_id, link0 AS link, min(query_ord) AS since FROM men JOIN sess USING (query_id) WHERE chosen = 0 GROUP BY ALL",
    "dpc": "SELECT m.query_id, m.ord, d.rank - 1 AS e, d.link, d.prob * CASE WHEN s.link IS NOT NULL THEN 2.0 ELSE 1.0 END AS base, count(*) OVER (PARTITION BY m.query_id, m.ord) AS width FROM men m JOIN dict d ON d.surface = m.surface AND d.rank <= 8 JOIN sess ON sess.query_id = m.query_id LEFT JOIN since s ON s.session_id = sess.session_id AND s.link = d.link AND s.since <= sess.query_ord",
    "dp(query_id, ord, e, link, v, path)": "SELECT query_id, ord, e, link, base, [e] FROM dpc WHERE ord = 1 UNION ALL SELECT query_id, ord, e, link, CASE WHEN s > 0 THEN s ELSE 0.00001 END, list_append(path, e) FROM (SELECT c.query_id, c.ord, c.e, c.link, p.path, round(p.v * c.base * coalesce(r.rel, 0), 15) AS s, row_number() OVER (PARTITION BY c.query_id, c.ord, c.e ORDER BY round(p.v * c.base * coalesce(r.rel, 0), 15) DESC, p.e) AS k FROM dp p JOIN dpc c ON c.query_id = p.query_id AND c.ord = p.ord + 1 LEFT JOIN rel r ON r.e1 = c.link AND r.e2 = p.link) WHERE k = 1",
    "dpend": "SELECT query_id, path, ord AS m FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord DESC, v DESC, e) AS k FROM dp) WHERE k = 1",
    "dpsel": "SELECT query_id, CAST(o AS INTEGER) AS ord, CAST(path[o] AS INTEGER) AS chosen FROM dpend, unnest(range(1, m + 1)) t(o) WHERE o > 1 OR m = 1",
    "bydp": "SELECT m.query_id, m.ord, m.position, m.word_count, m.surface, coalesce(e.chosen, m.chosen) AS chosen, d.link, d.prob FROM men m LEFT JOIN dpsel e ON e.query_id = m.query_id AND e.ord = m.ord LEFT JOIN dict d ON d.surface = m.surface AND d.rank = coalesce(e.chosen, m.chosen) + 1",
}
_CTES |= {"bydpc": _valid("bydp")}
_CTES |= _coherent("bydp", 0.11, "_d") | _coherent("bydpc", 0.11, "_dc")
_CTES |= {"kept_dv": _valid("kept_d")}
for _t in ("p", "v", "dc"):
    _CTES[f"conf_{_t}"] = f"SELECT k.query_id, round(coalesce(any_value(t.total), 0) * 1.3 + count(*) FILTER (k.chosen >= 0) / CAST(any_value(len(q.w)) AS DOUBLE) / 2.3, 6) AS confidence FROM kept_{_t} k JOIN q ON q.query_id = k.query_id LEFT JOIN total_{_t} t ON t.query_id = k.query_id GROUP BY k.query_id"
_CTES |= {
    "wins": "SELECT v.query_id, CASE WHEN v.confidence >= d.confidence THEN 'voting' ELSE 'dynamic' END AS winner FROM conf_v v JOIN conf_dc d ON d.query_id = v.query_id",
    "comb": "SELECT k.* FROM kept_v k JOIN wins w ON w.query_id = k.query_id AND winner = 'voting' UNION ALL SELECT k.* FROM kept_dc k JOIN wins w ON w.query_id = k.query_id AND winner = 'dynamic'",
    "ttl": "SELECT page_id, replace(title, ' ', '_') AS title FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages) WHERE title <> ''",
    "rdr": "SELECT a.page_id AS rd_from, b.title AS rd_title FROM ttl a JOIN ttl b ON b.page_id = a.page_id + 1 WHERE a.page_id % 5 = 0",
    "tq": "SELECT page_id AS query_id, CASE page_id % 3 WHEN 0 THEN k WHEN 1 THEN k[1:length(k) - 1] ELSE k || 'xyz' END AS text FROM (SELECT page_id, lower(replace(title, '_', ' ')) AS k FROM ttl)",
    "keys": "SELECT page_id, lower(replace(title, '_', ' ')) AS key FROM ttl",
    "tw": f"SELECT query_id, text, {_words('text')} AS words FROM tq",
    "docw": f"SELECT page_id AS doc_id, {_words("replace(title, '_', ' ')")} AS w FROM ttl",
    "post": "SELECT doc_id, len, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS word FROM docw) GROUP BY ALL",
    "qw": "SELECT query_id, len(list_distinct(words)) AS n, unnest(list_distinct(words)) AS word FROM tw",
    "hits": "SELECT query_id, doc_id, n, count(*) AS found, round(sum(tf / (tf + 1.0::DOUBLE)) / (1 + ln(any_value(len))), 6) AS rank FROM qw JOIN post USING (word) GROUP BY query_id, doc_id, n",
    "prop(pid, break_word, ord)": "VALUES " + ", ".join(map(str, PROPERTIES)),
    "kt": "SELECT s_suppkey AS query_id, s_name AS subject, i, ['what', CASE s_suppkey % 3 WHEN 0 THEN 'nations' WHEN 1 THEN 'founded' ELSE 'numb' END, 'of', 'country'][i + 1] AS token FROM supplier, unnest([0, 1, 2, 3]) t(i)",
    "bw": "SELECT query_id, subject, i, token, break_word FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i, ord) AS r FROM kt JOIN prop ON length(token) > 3 AND abs(length(token) - length(break_word)) <= 2 AND (starts_with(token, break_word) OR starts_with(break_word, token))) WHERE r = 1",
    "claim": "SELECT s_name AS subject, 'P1' AS property, n_name AS object, 'item' AS datatype FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT s_name, 'P3', '+' || (s_suppkey % 28 + 1990), 'time' FROM supplier UNION ALL SELECT n_name, 'P2', r_name, 'item' FROM nation JOIN region ON r_regionkey = n_regionkey",
    "bt": "SELECT CAST(string_split(link, '#')[2] AS BIGINT) AS page_id, link AS title FROM (SELECT DISTINCT link FROM dict) WHERE CAST(string_split(link, '#')[2] AS BIGINT) % 11 <> 0",
    "br": "SELECT page_id AS rd_from, 'Brand#' || (page_id + 1) AS rd_title FROM bt WHERE page_id % 5 = 0",
    "fresh": "SELECT d.surface, d.rank, coalesce(rd_title, d.link) AS link, CASE WHEN page_id IS NULL THEN 'missing' WHEN rd_title IS NOT NULL THEN 'redirected' ELSE 'unchanged' END AS status FROM dict d LEFT JOIN bt ON bt.title = d.link LEFT JOIN br ON br.rd_from = bt.page_id",
    "d1": "SELECT surface, link, prob, n_cands FROM (SELECT * FROM dict WHERE rank = 1) JOIN (SELECT surface, CAST(count(*) AS INTEGER) AS n_cands FROM dict GROUP BY surface) USING (surface)",
    "typed": "SELECT query_id, list_transform(range(0, len(w)), lambda i: w[i + 1] || CASE (query_id + i) % 5 WHEN 0 THEN 's' WHEN 1 THEN '!' ELSE '' END) || CASE WHEN query_id % 3 = 0 THEN ['r'] ELSE [] END AS w FROM q",
    "tgrams": "SELECT query_id, CAST(p AS INTEGER) AS position, CAST(n AS INTEGER) AS word_count, array_to_string(w[p + 1 : p + n], ' ') AS surface FROM typed, unnest(range(1, len(w) + 1)) t(n), unnest(range(0, len(w))) u(p) WHERE p + n <= len(w)",
    "forms": f"SELECT surface, 0 AS turn, surface AS form FROM (SELECT DISTINCT surface FROM tgrams) UNION ALL SELECT surface, 1, {_rules('surface', TO_SINGULAR)} FROM (SELECT DISTINCT surface FROM tgrams) UNION ALL SELECT surface, 2, {_rules('surface', TO_PLURAL)} FROM (SELECT DISTINCT surface FROM tgrams) UNION ALL SELECT surface, 3, {_soft('surface')} FROM (SELECT DISTINCT surface FROM tgrams) UNION ALL SELECT surface, 4, {_hard('surface')} FROM (SELECT DISTINCT surface FROM tgrams)",
    "casc": "SELECT surface, matched, turn, link0, p0, n_cands FROM (SELECT f.surface, form AS matched, turn, link AS link0, prob AS p0, n_cands, row_number() OVER (PARTITION BY f.surface ORDER BY turn) AS r FROM forms f JOIN d1 ON d1.surface = form) WHERE r = 1",
    "ccand": "SELECT query_id, position, word_count, surface, matched, turn, link0, p0, n_cands, row_number() OVER (PARTITION BY query_id ORDER BY word_count DESC, position) AS o FROM tgrams JOIN casc USING (surface)",
    **_resolved("ccand", "2"),
    "few(query_id, o, acc)": "SELECT query_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(o BIGINT, pos INTEGER, n INTEGER, c INTEGER)[]) FROM (SELECT DISTINCT query_id FROM cand) UNION ALL SELECT f.query_id, c.o, CASE WHEN len(list_filter(f.acc, lambda m: ((m.pos < c.position + c.word_count AND c.position + c.word_count < m.pos + m.n) OR (m.pos < c.position AND c.position < m.pos + m.n)) AND m.c <= c.n_cands)) > 0 THEN f.acc ELSE list_append(list_filter(f.acc, lambda m: NOT ((m.pos < c.position + c.word_count AND c.position + c.word_count < m.pos + m.n) OR (m.pos < c.position AND c.position < m.pos + m.n))), struct_pack(o := c.o, pos := c.position, n := c.word_count, c := c.n_cands)) END FROM few f JOIN cand c ON c.query_id = f.query_id AND c.o = f.o + 1",
    "placed": "SELECT query_id, ord, position, position + word_count AS e, surface, row_number() OVER (PARTITION BY query_id ORDER BY position, ord) AS i FROM men",
    "lay(query_id, i, ends, layer)": "SELECT query_id, CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST(0 AS BIGINT) FROM (SELECT DISTINCT query_id FROM men) UNION ALL SELECT l.query_id, m.i, CASE WHEN f.at > len(l.ends) THEN list_append(l.ends, m.e) ELSE list_transform(l.ends, lambda x, k: CASE WHEN k = f.at THEN m.e ELSE x END) END, f.at FROM lay l JOIN placed m ON m.query_id = l.query_id AND m.i = l.i + 1, LATERAL (SELECT coalesce(list_position(list_transform(l.ends, lambda x: x <= m.position), true), len(l.ends) + 1) AS at) f",
    "top": "SELECT h.query_id, h.doc_id, h.rank, tw.words, tw.text, ttl.title, string_split(replace(lower(ttl.title), '_', ' '), ' ') AS tws FROM (SELECT *, max(rank) OVER (PARTITION BY query_id) AS best FROM hits) h JOIN tw ON tw.query_id = h.query_id JOIN ttl ON ttl.page_id = h.doc_id WHERE h.rank >= 0.9 * h.best",
    "fits": "SELECT query_id, doc_id, i, coalesce(list_filter(list_transform(range(length(words[i]), 0, -1), lambda n: coalesce(list_filter(list_transform(tws, lambda t: CASE WHEN t = substring(words[i], 1, n) THEN n + 1 WHEN starts_with(t, substring(words[i], 1, n)) THEN n WHEN n >= 3 AND contains(t, substring(words[i], 1, n)) THEN n - 2 END), lambda x: x IS NOT NULL)[1], -1)), lambda x: x > 0)[1], 0) AS fit FROM top, unnest(range(1, len(words) + 1)) u(i)",
    "scored": "SELECT t.query_id, t.doc_id, t.title, t.rank, CAST(f.score AS INTEGER) AS score FROM top t JOIN (SELECT query_id, doc_id, sum(CASE WHEN fit > 0 THEN fit + 1 + CASE WHEN before > 0 THEN 1 ELSE 0 END ELSE 0 END) AS score FROM (SELECT *, coalesce(lag(fit) OVER (PARTITION BY query_id, doc_id ORDER BY i), 0) AS before FROM fits) GROUP BY query_id, doc_id) f ON f.query_id = t.query_id AND f.doc_id = t.doc_id WHERE length(t.title) <= length(t.text) + 8",
    "resc": "SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, length(title), rank DESC, doc_id) AS r FROM scored) WHERE r = 1",
    "c1": _match("SELECT query_id, text FROM tq"),
    "c2": _match("SELECT query_id, words[-1] AS text FROM tw WHERE len(words) > 0 AND query_id NOT IN (SELECT query_id FROM c1)"),
    "c3": "SELECT query_id, doc_id AS page_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, doc_id) AS r FROM hits WHERE found = n AND query_id NOT IN (SELECT query_id FROM c1 UNION ALL SELECT query_id FROM c2)) WHERE r = 1",
    "c4": "SELECT query_id, doc_id AS page_id FROM resc WHERE query_id NOT IN (SELECT query_id FROM c1 UNION ALL SELECT query_id FROM c2 UNION ALL SELECT query_id FROM c3)",
    "vocab": "SELECT DISTINCT word FROM post",
    "lastfix": f"SELECT word, min(v) AS fixed FROM (SELECT l.word, v.word AS v FROM (SELECT DISTINCT words[-1] AS word FROM tw WHERE len(words) > 0) l JOIN vocab v ON length(l.word) > 3 AND {_distance('l.word', 'v.word')} <= 1 WHERE l.word NOT IN (SELECT word FROM vocab)) GROUP BY word HAVING count(*) = 1",
    "c5": _match("SELECT query_id, fixed AS text FROM tw JOIN lastfix ON word = words[-1] WHERE query_id NOT IN (SELECT query_id FROM c1 UNION ALL SELECT query_id FROM c2 UNION ALL SELECT query_id FROM c3 UNION ALL SELECT query_id FROM c4)"),
    "gr(query_id, round, page_id, open)": f"SELECT query_id, 0, CAST(NULL AS BIGINT), words FROM tw WHERE query_id NOT IN (SELECT query_id FROM c1) UNION ALL SELECT query_id, round + 1, doc_id, CASE WHEN len(rest) = len(open) THEN [] ELSE list_filter(rest, lambda t: length(t) > 3) END FROM (SELECT *, list_filter(open, lambda t: NOT (length(t) < 2 OR len(list_filter(tws, lambda w: w = t OR {_run('t', 'w')})) > 0)) AS rest FROM (SELECT g.query_id, g.round, g.open, h.doc_id, string_split(replace(lower(ttl.title), '_', ' '), ' ') AS tws, row_number() OVER (PARTITION BY g.query_id ORDER BY h.rank DESC, h.doc_id) AS r FROM gr g JOIN hits h ON h.query_id = g.query_id JOIN docw d ON d.doc_id = h.doc_id JOIN ttl ON ttl.page_id = h.doc_id WHERE list_has_any(g.open, d.w)) WHERE r = 1)",
    "greedy": "SELECT query_id, 0 AS round, page_id FROM c1 UNION ALL SELECT query_id, round, page_id FROM gr WHERE round > 0",
    "proj": f"SELECT g.query_id, g.round, ttl.title AS link, string_split(tq.text, ' ') AS w, list_filter(range(0, len(string_split(tq.text, ' '))), lambda i: {_run("string_split(tq.text, ' ')[i + 1]", 'lower(ttl.title)')}) AS hit FROM greedy g JOIN tq ON tq.query_id = g.query_id JOIN ttl ON ttl.page_id = g.page_id",
    "snap": "SELECT page_id, replace(t, ' ', '_') AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS summary, regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS content, len(string_split(t, ' ')) <= 4 AS amb FROM (SELECT page_id, html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages) WHERE t <> ''",
    "dq": "SELECT query_id, words[1] AS first, unnest(list_distinct(words[2:])) AS word FROM tw WHERE len(words) > 1",
    "opt": f"SELECT tw.query_id, page_id, title, amb FROM tw JOIN snap ON {_words("replace(title, '_', ' ')")}[1] = tw.words[1]",
    **{f"rank_{c}": f"SELECT query_id, page_id, round(sum(tf / (tf + 1.0::DOUBLE)) / (1 + ln(any_value(len))), 6) AS rank FROM dq JOIN (SELECT page_id, len, word, count(*) AS tf FROM (SELECT page_id, len(w) AS len, unnest(w) AS word FROM (SELECT page_id, {_words(c)} AS w FROM snap)) GROUP BY ALL) USING (word) GROUP BY query_id, page_id" for c in ("summary", "content")},
    "dl": "SELECT p_partkey AS line_no, string_split(p_name, ' ')[1] AS surface, CAST(printf('%.4f', 1 / (p_size + 1)::DOUBLE) AS DOUBLE) AS prob, p_brand AS link FROM part WHERE p_partkey % 10 <> 0",
    "dr": "SELECT *, sum(new) OVER (ORDER BY line_no) AS run FROM (SELECT *, CASE WHEN lag(surface) OVER (ORDER BY line_no) IS DISTINCT FROM surface THEN 1 ELSE 0 END AS new FROM dl)",
    "annot": "SELECT items.query_id, i + 1 AS ord, len(q.w) - 1 AS position, 2 AS word_count, p_name AS surface, 0 AS chosen, CASE WHEN (items.query_id + i) % 5 = 0 THEN 'Brand#11' ELSE p_brand END AS link FROM items JOIN q ON q.query_id = items.query_id WHERE i % 2 = 0",
    "bench": "SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark",
}


def _needed(sql: str) -> str:
    """``sql`` with the common tables that it reads, and that those read, before it."""
    import re

    named = {k.split("(")[0]: k for k in _CTES}
    want, todo = set(), [sql]
    while todo:
        for name in set(re.findall(r"\b\w+\b", re.sub(r"'[^']*'", "", todo.pop()))) & set(named):
            if name not in want:
                want.add(name)
                todo.append(_CTES[named[name]])
    ctes = [f"{named[k]} AS ({_CTES[named[k]]})" if "(" in named[k] or k not in ("dict", "men", "rel", "cand", "voted", "dpc", "items") else f"{k} AS MATERIALIZED ({_CTES[k]})" for k in named if k in want]
    return f"WITH RECURSIVE {', '.join(ctes)} {sql}" if ctes else sql


def _f1(src: str, gold: str = "goldc") -> str:
    first = f"(SELECT query_id, link, arg_min(substring, gold_ord) AS gs FROM {gold} GROUP BY ALL)"
    rated = f"(SELECT p.*, CASE WHEN g.gs IS NULL THEN 'FP' WHEN g.gs = p.surface THEN 'TP-strict' ELSE 'TP-relaxed' END AS rating FROM {src} p LEFT JOIN {first} g ON g.query_id = p.query_id AND g.link = p.link WHERE p.chosen >= 0)"
    counts = f"SELECT count(*) FILTER (rating = 'TP-strict') AS s, count(*) FILTER (rating = 'TP-relaxed') AS l, count(*) FILTER (rating = 'FP') AS fp FROM {rated}"
    miss = f"SELECT count(*) AS fn FROM {gold} g WHERE NOT EXISTS (SELECT 1 FROM {rated} r WHERE r.query_id = g.query_id AND r.link = g.link) AND NOT EXISTS (SELECT 1 FROM {rated} r WHERE r.query_id = g.query_id AND r.rating = 'FP' AND r.position <= g.position AND g.position + g.word_count <= r.position + r.word_count)"
    x = "SELECT s, l, fp, fn, s / (s + l + fp)::DOUBLE AS ps, s / (s + fn)::DOUBLE AS rs, (s + l) / (s + l + fp)::DOUBLE AS pl, (s + l) / (s + l + fn)::DOUBLE AS rl"
    return f"SELECT s AS tp_s, l AS tp_l, fp, fn, round(ps, 6) AS precision_strict, round(rs, 6) AS recall_strict, round(2 * ps * rs / (ps + rs), 6) AS f1_strict, round(pl, 6) AS precision_relaxed, round(rl, 6) AS recall_relaxed, round(2 * pl * rl / (pl + rl), 6) AS f1_relaxed FROM ({x} FROM ({counts}), ({miss}))"


_FIRST = "(SELECT query_id, link, arg_min(substring, gold_ord) AS gs FROM gold GROUP BY ALL)"
_TAG = "CASE WHEN t IN ('blue','cold','hot','large','new','old','red','small') THEN 'JJ' WHEN regexp_matches(t, '(ed|ing)$') THEN 'VB' WHEN regexp_matches(t, '[^s]s$') THEN 'NNS' ELSE 'NN' END"

_QUERIES = {
    "dict_build": "SELECT surface, rank, link, round(prob, 9) AS prob FROM dict",
    "ngrams": "SELECT query_id, position, word_count, surface FROM grams3",
    "ngrams_any_length": "SELECT word_count, count(*) AS n, CAST(sum(length(surface)) AS BIGINT) AS chars FROM grams GROUP BY word_count",
    "dict_lookup": "SELECT query_id, position, word_count, surface, link0, n_cands FROM cand",
    "overlap_resolve": "SELECT query_id, ord, position, word_count, surface, chosen FROM men",
    "overlap_first": "SELECT a.query_id, a.ord, min(b.ord) AS crosses FROM men a LEFT JOIN men b ON b.query_id = a.query_id AND b.ord < a.ord AND ((b.position < a.position AND a.position < b.position + b.word_count) OR (b.position < a.position + a.word_count AND a.position + a.word_count < b.position + b.word_count)) GROUP BY a.query_id, a.ord",
    "chosen_entities": "SELECT query_id, ord, link, round(prob, 9) AS prob FROM prior WHERE chosen >= 0",
    "score_ratings": f"SELECT p.query_id, p.ord, p.link, CASE WHEN g.gs IS NULL THEN 'FP' WHEN g.gs = p.surface THEN 'TP-strict' ELSE 'TP-relaxed' END AS rating FROM prior p LEFT JOIN {_FIRST} g ON g.query_id = p.query_id AND g.link = p.link WHERE p.chosen >= 0",
    "gold_ratings": f"SELECT g.query_id, g.gold_ord, g.link, CASE WHEN EXISTS (SELECT 1 FROM prior p WHERE p.query_id = g.query_id AND p.link = g.link) THEN 'matched' WHEN EXISTS (SELECT 1 FROM prior p LEFT JOIN {_FIRST} f ON f.query_id = p.query_id AND f.link = p.link WHERE p.query_id = g.query_id AND p.chosen >= 0 AND f.gs IS NULL AND p.position <= g.position AND g.position + g.word_count <= p.position + p.word_count) THEN 'FP-corresponding' ELSE 'FN' END AS rating FROM gold g",
    "baseline_f1": _f1("prior", "gold"),
    "lookup_cascade": "SELECT query_id, position, word_count, surface, matched, turn FROM ccand",
    "cascade_f1": _f1("prior2"),
    "annotator_f1": _f1("annot", "gold"),
    "clean_candidates": "SELECT m.query_id, m.ord, m.surface, CASE WHEN chosen >= 0 THEN 0 ELSE -1 END AS chosen, d.link, round(d.prob, 9) AS prob FROM men m JOIN (SELECT *, max(rank) OVER (PARTITION BY surface) AS last FROM dict) d ON d.surface = m.surface AND d.rank = CASE WHEN chosen >= 0 THEN chosen + 1 ELSE last END",
    "queries_with_gold": "SELECT query_id, text FROM q WHERE query_id IN (SELECT query_id FROM gold WHERE starts_with(substring, 'cold'))",
    "xml_sessions": "SELECT CAST(session_id AS VARCHAR) AS session_id, query_ord, text, CAST(i AS INTEGER) AS i, surface AS span, link FROM (SELECT * FROM q JOIN sess USING (query_id)) z LEFT JOIN (SELECT query_id, surface, link, row_number() OVER (PARTITION BY query_id ORDER BY position, ord) - 1 AS i FROM prior) p ON p.query_id = z.query_id",
    "fewest_candidates": "SELECT f.query_id, m.pos AS position, m.n AS word_count, m.c AS n_cands, c.surface FROM (SELECT query_id, unnest(acc) AS m FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o DESC) AS r FROM few) WHERE r = 1) f JOIN cand c ON c.query_id = f.query_id AND c.o = m.o",
    "candidate_limit": "SELECT surface, rank, link FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY rank) AS r FROM dict WHERE prob >= 0.042) WHERE r <= 5",
    "surface_vote": "SELECT surface, target, round(vote, 9) AS vote FROM sv",
    "vote": "SELECT query_id, ord, round(sum(vote), 9) AS votes, count(*) AS n FROM voted GROUP BY query_id, ord",
    "choose_epsilon": "SELECT query_id, ord, chosen FROM eps",
    "choose_topk": "SELECT query_id, ord, CAST(arg_max(rank, [prob, -rank]) - 1 AS INTEGER) AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ord ORDER BY round(vote, 7) DESC, rank) AS r FROM voted) WHERE r <= 10 GROUP BY query_id, ord",
    "relatedness": "SELECT e1, e2, round(rel, 9) AS rel FROM rel",
    "coherence": "SELECT query_id, ord, round(coherence, 9) AS coherence FROM coh_p",
    "prune": "SELECT query_id, ord, chosen FROM kept_p",
    "prune_clean": "SELECT p.query_id, p.ord, CASE WHEN c.coherence <= 0.12 THEN -1 ELSE p.chosen END AS chosen FROM prior p LEFT JOIN coh_p c ON c.query_id = p.query_id AND c.ord = p.ord",
    "query_coherence": "SELECT query_id, round(total, 12) AS total, n_chosen FROM total_p",
    "confidence": "SELECT query_id, confidence FROM conf_p",
    "improved_f1": _f1("kept_pc"),
    "voting_f1": _f1("kept_v"),
    "session_history": "SELECT s.query_id, s.session_id, s.query_ord, coalesce(string_agg(n.link, '|' ORDER BY n.link), '') AS history FROM sess s LEFT JOIN since n ON n.session_id = s.session_id AND n.since <= s.query_ord GROUP BY ALL",
    "query_diff": "SELECT query_id, session_id, query_ord, CASE WHEN p IS NULL THEN '' ELSE array_to_string(list_filter(w, lambda t: NOT list_contains(p, t)), '|') END AS new_words FROM (SELECT query_id, session_id, query_ord, w, lag(w) OVER (PARTITION BY session_id ORDER BY query_ord) AS p FROM q JOIN sess USING (query_id))",
    "dp_choice": "SELECT query_id, ord, chosen FROM dpsel",
    "dynamic_f1": _f1("kept_dv"),
    "combined_f1": _f1("comb"),
    "combined_winners": "SELECT winner, count(*) AS n FROM wins GROUP BY winner",
    "stopwords": "SELECT item_id, array_to_string(list_filter(string_split(lower(text), ' '), lambda t: t NOT IN ('the', 'of', 'de')), ' ') AS kept FROM bench",
    "acceptable_words": "SELECT item_id, CAST(i AS INTEGER) AS i, w[i + 1] AS word FROM bench, unnest(range(0, len(w))) t(i) WHERE length(w[i + 1]) BETWEEN 2 AND 40 AND lower(w[i + 1]) NOT IN ('a','the','of','in','with','to','for','by','and','or','is','was','be')",
    "soft_fix": "SELECT item_id, lower(trim(translate(replace(replace(replace(replace(text, '''', ' '), ' s ', ' '), ' s', ' '), 's ', ' '), '!:,''\"?', ''))) AS fixed FROM bench",
    "noun_phrases": f"""SELECT * FROM (
        WITH w AS (SELECT item_id, t, i, CASE WHEN t IN ('of','in','with','to','for','by') THEN 'I' WHEN t IN ('a','the') THEN 'D' WHEN t IN ('and','or','is','was','be') THEN 'O'
            WHEN {_TAG} = 'JJ' THEN 'J' WHEN {_TAG} LIKE 'NN%' THEN 'N' ELSE 'O' END AS k
          FROM (SELECT item_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[[:punct:]]', '', 'g'), '\\s+'), lambda x: x <> '') AS l FROM bench))),
        line AS (SELECT item_id, string_agg(t || '/' || k || ' ', '' ORDER BY i) AS s, string_agg(CASE WHEN k IN ('I', 'D') THEN chr(10) ELSE t END, ' ' ORDER BY i) AS c FROM w GROUP BY item_id)
        SELECT item_id, array_to_string(list_transform(regexp_extract_all(s, '(?:[^ /]+/[JN] )*[^ /]+/N (?:[^ /]+/I (?:[^ /]+/[JN] )*[^ /]+/N )?'), lambda p: trim(regexp_replace(p, '/[JNI] ', ' ', 'g'))), '|') AS phrases,
          array_to_string(list_filter(list_transform(string_split(c, chr(10)), lambda p: trim(p)), lambda p: p <> ''), '|') AS chunks FROM line)""",
    "homogeneity": f"SELECT query_id, greatest(1.5 - count(DISTINCT {_TAG}) / 2.0::DOUBLE, 0) AS homogeneity FROM (SELECT query_id, unnest(w) AS t FROM q) GROUP BY query_id",
    "singular_plural": f"SELECT surface, plural, {_rules('plural', TO_SINGULAR)} AS singular FROM (SELECT DISTINCT surface, {_rules('surface', TO_PLURAL)} AS plural FROM dict)",
    "hard_fix": f"SELECT DISTINCT surface, {_hard("('The ' || surface || '\'\'s!')")} AS fixed FROM dict",
    "segment_score": f"SELECT query_id, position, word_count, round(3.0::DOUBLE * word_count + 3.0::DOUBLE / n_cands + greatest(1.5 - len(list_distinct(list_transform(string_split(surface, ' '), lambda t: {_tag('t')}))) / 2.0::DOUBLE, 0) + 3.0::DOUBLE * p0, 6) AS score FROM cand",
    "segmentations": "SELECT query_id, array_to_string(list_transform(range(0, len(w)), lambda i: CASE WHEN i = 0 THEN w[1] ELSE (CASE WHEN (m >> (i - 1)) & 1 = 1 THEN '|' ELSE ' ' END) || w[i + 1] END), '') AS cut FROM (SELECT query_id, list_filter(string_split(text, ' '), lambda t: t <> '') AS w FROM tq), unnest(range(0, CAST(pow(2, len(w) - 1) AS BIGINT))) t(m) WHERE len(w) > 0",
    "word_subsets": "SELECT query_id, array_to_string(list_filter(list_transform(range(0, len(w)), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN w[i + 1] END), lambda x: x IS NOT NULL), ' ') AS words, count(*) AS n FROM (SELECT query_id, list_filter(string_split(text, ' '), lambda t: t <> '') AS w FROM tq), unnest(range(1, CAST(pow(2, len(w)) AS BIGINT))) t(m) GROUP BY ALL",
    "unquote": "SELECT p_partkey, replace(p_name, 'o', 'o+') AS name FROM part",
    "punctuation": "SELECT item_id, regexp_replace(text, '[[:punct:]]', '', 'g') AS plain, md5(text) AS key FROM bench",
    "accents": "SELECT item_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS plain FROM bench",
    "match_score": "SELECT surface, sub, CAST(coalesce(list_filter(list_transform(string_split(surface, ' '), lambda w: CASE WHEN w = sub THEN length(sub) + 1 WHEN starts_with(w, sub) THEN length(sub) WHEN length(sub) >= 3 AND contains(w, sub) THEN length(sub) - 2 END), lambda x: x IS NOT NULL)[1], -1) AS INTEGER) AS score FROM (SELECT DISTINCT surface FROM dict WHERE contains(surface, ' ')), unnest(['red', 're', 'in', 'gizm', 'ol', 'bolt']) t(sub)",
    "redirect_resolve": "SELECT page_id, title, coalesce(rd_title, title) AS resolved FROM ttl LEFT JOIN rdr ON rd_from = page_id",
    "redirect_words": "SELECT word, coalesce(rd_title, word) AS expanded FROM (SELECT title AS word FROM ttl UNION ALL SELECT text FROM tq) LEFT JOIN (SELECT title, min(page_id) AS p FROM ttl GROUP BY title) t ON t.title = word LEFT JOIN rdr ON rd_from = p",
    "title_match": "SELECT query_id, c1.page_id, CAST(distance AS INTEGER) AS distance, coalesce(rd_title, title) AS title FROM c1 JOIN ttl ON ttl.page_id = c1.page_id LEFT JOIN rdr ON rd_from = c1.page_id",
    "title_cascade": "SELECT query_id, page_id, 'title' AS method FROM c1 UNION ALL SELECT query_id, page_id, 'word' FROM c2 UNION ALL SELECT query_id, page_id, 'all' FROM c3 UNION ALL SELECT query_id, page_id, 'any' FROM c4 UNION ALL SELECT query_id, page_id, 'spell' FROM c5",
    "title_greedy": "SELECT query_id, round, page_id FROM greedy",
    "title_project": "SELECT query_id, round, CAST(a AS INTEGER) AS position, CAST(e - a AS INTEGER) AS word_count, array_to_string(w[a + 1 : e], ' ') AS substring, link FROM (SELECT query_id, round, w, link, coalesce(hit[1], 0) AS a, greatest(list_reduce(hit, lambda x, i: CASE WHEN x < i THEN i + 1 ELSE x END, 0), 1) AS e FROM proj)",
    "title_rescore": "SELECT query_id, doc_id, score FROM resc",
    "deabbreviate": f"SELECT query_id, page_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, page_id) AS r FROM (SELECT query_id, page_id, {_inserted('text', 'key')} AS score FROM tq, keys WHERE abs(length(text) - length(key)) <= 1 AND {_distance('text', 'key')} <= 1)) WHERE r <= 50",
    "spell": "SELECT word, coalesce(fixed, word) AS fixed FROM (SELECT DISTINCT word FROM (SELECT surface AS word FROM dict WHERE NOT contains(surface, ' ') UNION ALL SELECT substring(surface, 1, 2) || substring(surface, 4, 20) FROM dict WHERE NOT contains(surface, ' '))) LEFT JOIN (SELECT w AS word, min(v) AS fixed FROM (SELECT DISTINCT substring(a.surface, 1, 2) || substring(a.surface, 4, 20) AS w, b.surface AS v FROM dict a, dict b WHERE NOT contains(a.surface, ' ') AND NOT contains(b.surface, ' ')) WHERE length(w) > 3 AND w NOT IN (SELECT surface FROM dict) AND levenshtein(w, v) <= 1 GROUP BY w HAVING count(*) = 1) USING (word)",
    "dict_file": "SELECT surface, CAST(row_number() OVER (PARTITION BY surface ORDER BY line_no) AS INTEGER) AS rank, link, prob FROM dr JOIN (SELECT surface, min(run) AS run FROM dr WHERE run < (SELECT max(run) FROM dr) GROUP BY surface) USING (surface, run)",
    "token_position": "SELECT item_id, CAST(p AS INTEGER) AS start, CAST(len(list_filter(string_split_regex(text[1 : p + 1], '\\s+'), lambda t: t <> '')) - 1 AS INTEGER) AS token, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) - 1 AS INTEGER) AS last FROM bench, unnest(range(0, length(text))) t(p)",
    "insert_check": f"SELECT surface, {_inserted('short', 'surface')} AS dropped, {_inserted('surface', 'short')} AS longer, {_inserted('reverse(surface)', 'surface')} AS reversed FROM (SELECT DISTINCT surface, regexp_replace(surface, '[aeio]', '', 'g') AS short FROM dict)",
    "longest_common": "SELECT a, b, coalesce(arg_max(sub, [length(sub), -i]) FILTER (contains(b, sub)), '') AS common FROM (SELECT a, b, i, substring(a, i, k) AS sub FROM (SELECT DISTINCT surface AS a FROM dict WHERE NOT contains(surface, ' ')), unnest(['gadgets', 'ringlet', 'oldest', 'revolt']) t(b), unnest(range(1, length(a) + 1)) u(i), unnest(range(1, length(a) - i + 2)) v(k)) GROUP BY a, b",
    "disambiguation": "SELECT query_id, CASE WHEN sm > 0 THEN s ELSE c END AS title FROM (SELECT query_id, arg_max(title, [sr, -page_id]) FILTER (sr > 0) AS s, arg_max(title, [cr, -page_id]) FILTER (cr > 0) AS c, max(sr) AS sm, max(cr) AS cm FROM (SELECT o.*, coalesce(a.rank, 0) AS sr, coalesce(b.rank, 0) AS cr FROM opt o LEFT JOIN rank_summary a ON a.query_id = o.query_id AND a.page_id = o.page_id LEFT JOIN rank_content b ON b.query_id = o.query_id AND b.page_id = o.page_id WHERE NOT amb) GROUP BY query_id) WHERE sm > 0 OR cm > 0",
    "ft_and": "SELECT query_id, doc_id, rank FROM hits WHERE found = n",
    "ft_or": "SELECT query_id, doc_id, rank FROM hits",
    "ft_or_best": "SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, doc_id) AS r FROM hits) WHERE r = 1",
    "break_word": "SELECT query_id, CAST(i AS INTEGER) AS i, token, break_word FROM bw",
    "kb_lookup": "SELECT DISTINCT query_id, bw.subject, pid AS property, CASE datatype WHEN 'time' THEN object ELSE replace(object, ' ', '_') END AS value FROM bw JOIN prop USING (break_word) JOIN claim ON claim.subject = bw.subject AND claim.property = pid",
    "dict_refresh": "SELECT surface, rank, link, status FROM fresh",
    "dict_refresh_totals": "SELECT status, count(*) AS n FROM fresh GROUP BY status",
    "canonical_links": "SELECT l.link, coalesce(rd_title, l.link) AS canonical FROM (SELECT DISTINCT link FROM dict UNION ALL SELECT DISTINCT link || '_(disambiguation)' FROM dict) l LEFT JOIN br ON 'Brand#' || rd_from = replace(l.link, '_(disambiguation)', '')",
    "dict_export": "SELECT surface, rank, surface || chr(9) || printf('%.6f', prob) || ' ' || link AS line FROM dict",
    "export_rows": "SELECT q.query_id, q.text, coalesce(string_agg(p.surface || '=' || p.link, '|' ORDER BY p.position, p.ord), '') AS cells FROM q LEFT JOIN (SELECT * FROM prior WHERE chosen >= 0) p ON p.query_id = q.query_id GROUP BY q.query_id, q.text",
    "visualize": "SELECT l.query_id, CAST(l.layer AS INTEGER) AS layer, string_agg('[' || surface || ']', ' ' ORDER BY p.position, p.ord) AS line FROM lay l JOIN placed p ON p.query_id = l.query_id AND p.i = l.i GROUP BY l.query_id, l.layer",
    "run_diff": "SELECT p.query_id, p.ord, p.link AS old_link, k.link AS new_link FROM prior p JOIN kept_p k ON k.query_id = p.query_id AND k.ord = p.ord WHERE p.link IS DISTINCT FROM k.link",
    "segmentation_averages": "SELECT round(avg(w), 6) AS avg_words, round(avg(n), 6) AS avg_mentions FROM (SELECT avg(word_count) AS w, count(*) AS n FROM men GROUP BY query_id)",
    "word_frequency": "SELECT word, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 9) AS share FROM (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM q) GROUP BY word)",
}

SQL = {name: _needed(sql) for name, sql in _QUERIES.items()}
