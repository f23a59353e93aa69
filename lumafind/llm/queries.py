"""The training-data queries and, where SQL expresses them, their DuckDB statements."""

from __future__ import annotations

from .ann import op8_ann
from .bpe import op10_bpe
from .cap_filters import op13_near_duplicates
from .conversation_repair import op12_conversation_repair
from .language_id import op6_language_id
from .line_dedup import op1_line_dedup
from .lm_scoring import op5_lm_scoring
from .ngram_join import op4_ngram_join
from .packing import op2_packing
from .pii import op7_pii
from .prefix_trie import op11_prefix_trie
from .quality import RULES, STOP_WORDS, op3_quality_rules
from .token_files import op9_token_files

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_packing": op2_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_ngram_join": op4_ngram_join,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_language_id": op6_language_id,
    "op7_pii": op7_pii,
    "op8_ann": op8_ann,
    "op9_token_files": op9_token_files,
    "op10_bpe": op10_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_near_duplicates": op13_near_duplicates,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_VALUES = {"n_words": "n_words", "try_divide(word_chars, n_words)": "word_chars / n_words", "try_divide(n_symbols, n_words)": "n_symbols / n_words", "n_stop_words": "n_stop", "try_divide(n_stop_words, n_words)": "n_stop / n_words", "try_divide(n_dup_lines, n_lines)": "n_dup_lines / n_lines", "try_divide(n_letters, word_chars)": "n_letters / word_chars"}


def _failed() -> str:
    """The threshold table as SQL: the names of failed rules; a division by zero is null and passes."""
    tests = []
    for r in RULES:
        value = _VALUES[r.value]
        bounds = [f"{value} < {r.least}"] * (r.least is not None) + [f"{value} > {r.most}"] * (r.most is not None)
        tests.append(f"CASE WHEN {' OR '.join(bounds)} THEN '{r.name}' END")
    return f"concat_ws(',', {', '.join(tests)})"


def _crc(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    step = "list_reduce(list_concat([xor(a, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda ch: unicode(ch)::BIGINT)), lambda a, b: {step}), 4294967295::BIGINT)"


SQL: dict[str, str] = {
    "op1_line_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS text FROM d WHERE ls IS NOT NULL),
w AS (SELECT struct_pack(d := doc_id, l := line) AS p, list_sort(list_distinct(regexp_extract_all({_LOWER}, {_WORD}))) AS s FROM l),
c AS (SELECT s, min(p) AS p FROM w WHERE len(s) > 0 GROUP BY s),
t AS (SELECT p, len(s) AS n, unnest(s) AS tok FROM c),
f AS (SELECT tok, count(*) AS df FROM t GROUP BY tok),
o AS (SELECT p, n, tok, row_number() OVER (PARTITION BY p ORDER BY df, tok) AS r FROM t JOIN f USING (tok)),
x AS (SELECT * FROM o WHERE r <= n - (4 * n + 4) // 5 + 1),
q AS (SELECT DISTINCT a.p AS ap, b.p AS bp FROM x a JOIN x b ON a.tok = b.tok AND a.p < b.p AND a.n * 100 >= 80 * b.n AND b.n * 100 >= 80 * a.n),
bad AS (SELECT DISTINCT bp FROM q JOIN c a ON a.p = ap JOIN c b ON b.p = bp WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
k AS (SELECT p.d AS doc_id, count(*) AS n, string_agg(CAST(p.l AS VARCHAR), ',' ORDER BY p.l) AS kept FROM c WHERE p NOT IN (SELECT bp FROM bad) GROUP BY 1),
n AS (SELECT p.d AS doc_id, count(*) AS n FROM w WHERE len(s) > 0 GROUP BY 1)
SELECT d.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(n.n, 0) - coalesce(k.n, 0) AS n_removed, coalesce(kept, '') AS kept_lines
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
""",
    "op3_quality_rules": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda k: array_to_string(ws[k:k + 7], ' '))) AS x FROM w),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g) y, range(0, 8) k(j) WHERE c > 1 GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) z WHERE regexp_matches(x, {_WORD}) GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
 coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, len(list_filter(ws, lambda v: lower(v) IN ({', '.join(f"'{v}'" for v in STOP_WORDS)}))) AS n_stop, length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS n_letters FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_failed()} AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM v
""",
    "op4_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT e.v, r.seen FROM r JOIN e ON e.u = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS c FROM r GROUP BY node) k ON k.node = d.doc_id
""",
    "op11_prefix_trie": rf"""
WITH t AS (SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(m ORDER BY p) AS ms FROM t GROUP BY c),
h AS (SELECT c, ms, {_crc("CAST(c AS VARCHAR)")} % 4 AS h FROM l),
b AS (SELECT h.c, list_concat(coalesce(g.ms, [])[1:h.h], h.ms[h.h + 1:]) AS s FROM h LEFT JOIN h g ON g.c = h.c - h.c % 20),
n AS (SELECT s[1:d] AS k, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len(s)) AS ends FROM b, range(0, len(s) + 1) z(d) GROUP BY 1, 2),
v AS (SELECT *, CASE WHEN d > 0 THEN k[1:d - 1] END AS u, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(k[d].x, {_WORD})) ELSE 0 END AS saved FROM n),
q AS (SELECT u, count(*) AS n FROM v WHERE d > 0 GROUP BY u),
a AS (SELECT v.k[1:d2] AS k, sum(saved) AS saved_tokens, count(*) FILTER (q.n IS NULL) AS n_leaves FROM v LEFT JOIN q ON q.u = v.k, range(0, v.d + 1) z(d2) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(q.n, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN a ON a.k = v.k LEFT JOIN q ON q.u = v.k LEFT JOIN v p ON p.k = v.u AND v.d > 0
""",
    "op12_conversation_repair": rf"""
WITH RECURSIVE k AS (SELECT conv_id AS c, turn AS t, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS x0, {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS e FROM conversations),
w AS (SELECT c, t, r0, x0, CASE WHEN e = 4 THEN 'user' ELSE r0 END AS r, CASE e WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x0, '[.!?]', '', 'g') ELSE x0 END AS x, unnest(CASE WHEN e = 3 THEN [0, 1] ELSE [0] END) AS cp FROM k WHERE e <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, r0, x0, cp) AS i FROM w),
f AS (SELECT c, t, i, r, x, left(r, 1) AS f, lag(left(r, 1)) OVER (PARTITION BY c ORDER BY i) AS g,
 CASE WHEN NOT regexp_matches(x, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, r, x ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(x, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault FROM p),
o AS (SELECT * FROM (VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
 (2, 2, 0, '', []), (2, 3, 5, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 5, 'I', ['user:'])) v(a, b, cost, labels, lines)),
d AS (SELECT c, i, q AS a, q AS b, 2 AS cost, 'D' AS label, []::VARCHAR[] AS lines FROM f, range(4) z(q)
 UNION ALL SELECT c, i, a, b, CASE WHEN fault IS NULL THEN 0 ELSE 5 END, 'K', [r || ':' || x] FROM f JOIN (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) v(l, a, b) ON l = f WHERE fault IS NULL OR fault = 'truncated'
 UNION ALL SELECT c, i, a, b, CASE WHEN fault IS NULL THEN 1 ELSE 6 END, 'R', [CASE b WHEN 2 THEN 'user:' ELSE 'assistant:' END || x] FROM f, (VALUES (0, 2), (1, 2), (3, 2), (2, 3)) v(a, b) WHERE fault IS NULL OR fault = 'truncated'),
s AS (SELECT DISTINCT c, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'labels': '', 'lines': []::VARCHAR[]}} AS m FROM f
 UNION ALL SELECT s.c, s.i + 1, d.b, min({{'cost': CAST(m.cost + o.cost + d.cost AS INTEGER), 'labels': m.labels || o.labels || d.label, 'lines': list_concat(m.lines, o.lines, d.lines)}}) FROM s JOIN o ON o.a = s.q JOIN d ON d.c = s.c AND d.i = s.i + 1 AND d.a = o.b GROUP BY 1, 2, 3),
n AS (SELECT c, max(i) AS n, CAST(coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND g || f NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c),
e AS (SELECT s.c, min({{'cost': m.cost + o.cost, 'labels': m.labels || o.labels, 'lines': list_concat(m.lines, o.lines)}}) AS m FROM s JOIN n ON n.c = s.c AND n.n = s.i JOIN o ON o.a = s.q AND o.b IN (0, 3) GROUP BY 1)
SELECT a.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(m.cost, 0) AS BIGINT) AS cost, coalesce(m.labels, '') AS audit, sha256(coalesce(array_to_string(m.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS c FROM conversations) a LEFT JOIN n ON n.c = a.c LEFT JOIN e ON e.c = a.c
""",
    "op13_near_duplicates": """
WITH RECURSIVE g AS (SELECT vec_id AS i, label AS l, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.i AS u, b.i AS w FROM g a JOIN g b ON a.l = b.l AND a.i < b.i AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
e AS (SELECT u, w FROM p UNION ALL SELECT w, u FROM p),
n AS (SELECT u, count(*) AS n FROM e GROUP BY u),
r AS (SELECT i AS node, i AS seen FROM g UNION SELECT e.w, r.seen FROM r JOIN e ON e.u = r.node),
k AS (SELECT node, min(seen) AS c FROM r GROUP BY node)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(k.c, vec_id) AS component_id, coalesce(k.c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN k ON k.node = vec_id
""",
}
