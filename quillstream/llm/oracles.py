"""DuckDB SQL for the queries that SQL can express on whole tables.

Not among them: byte windows (op1) and edit distances (op7) are out of reach of its string functions; estimated
models (op4, op10), iterated rates with carried rounding (op8) and a tokenizer's merges (op9, op13) are no SQL.  Tests hold
those against brute force, the library or held-out labels.
"""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{_WORD}+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _covered(name: str, n: int, scope: str) -> str:
    """Positions of d(doc_id, w) covered by windows of n words that occur twice or more within the scope."""
    return f"""{name}_windows AS (SELECT doc_id, i, array_to_string(w[i : i + {n} - 1], ' ') AS window_ FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM d)),
{name}_twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY {scope}window_) AS n FROM {name}_windows) WHERE n > 1),
{name}_gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM {name}_twice)"""


OP3 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), {_covered('win', 35, '')},
marks AS (SELECT doc_id, list(i) AS gone FROM win_gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: gone IS NULL OR NOT list_contains(gone, x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM d LEFT JOIN marks ON d.doc_id = marks.doc_id"""

OP5 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS set_ FROM d),
e AS (SELECT doc_id, len(set_) AS n, unnest(set_) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS r FROM s UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.id)
SELECT s.doc_id, len(set_) AS n_shingles, c.r AS component_id, s.doc_id = c.r AS kept FROM s JOIN (SELECT id, min(r) AS r FROM reach GROUP BY id) c ON c.id = s.doc_id"""

_NORMAL = f"trim(regexp_replace(lower(x), '{_SPACE}+', ' ', 'g'))"
OP2 = f"""WITH d AS (SELECT doc_id, source, text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
{_covered('rep', 5, 'doc_id, ')}, repeated AS (SELECT doc_id, count(*) AS n FROM rep_gone GROUP BY doc_id),
c AS (SELECT d.*, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
FROM d LEFT JOIN repeated r ON r.doc_id = d.doc_id),
normal AS (SELECT doc_id, source, text, unnest(list_transform(lines, lambda x: {_NORMAL})) AS line FROM d),
most AS (SELECT source, greatest(10.0, 0.02 * count(DISTINCT coalesce(text, ''))) AS m FROM d GROUP BY source),
often AS (SELECT n.source, n.line FROM (SELECT source, line, count(DISTINCT text) AS n FROM normal GROUP BY source, line) n JOIN most m ON m.source IS NOT DISTINCT FROM n.source WHERE n.n > m.m),
boiler AS (SELECT doc_id, sum(len(string_split(n.line, ' '))) AS words, list(DISTINCT n.line) AS gone FROM normal n JOIN often o ON o.source IS NOT DISTINCT FROM n.source AND o.line = n.line GROUP BY doc_id)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND n_words - b >= 0.3 * n_words AS kept, b AS boiler_words,
CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, {_NORMAL})), chr(10)) END AS text
FROM (SELECT c.*, gone, CAST(coalesce(b.words, 0) AS BIGINT) AS b, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed FROM c LEFT JOIN boiler b ON b.doc_id = c.doc_id) c"""

OP6 = f"""WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
n AS (SELECT doc_id, list_filter(list_zip(list_transform(l, lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), range(1, len(l) + 1)), lambda x: x[1] <> '') AS a FROM d),
windows AS (SELECT doc_id, i, list_transform(a[i : i + 2], lambda x: x[1]) AS key, list_transform(a[i : i + 2], lambda x: x[2]) AS places FROM (SELECT doc_id, a, unnest(range(1, len(a) - 1)) AS i FROM n)),
later AS (SELECT doc_id, places FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
marks AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(places) AS i FROM later) GROUP BY doc_id)
SELECT d.doc_id, len(n.a) AS n_lines, coalesce(len(gone), 0) AS n_removed,
CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]), chr(10)) END AS text
FROM d JOIN n ON n.doc_id = d.doc_id LEFT JOIN marks m ON m.doc_id = d.doc_id"""

OP11 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, length(t) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || h[i : i + 7] AS BIGINT)) AS h FROM d),
c AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substring(t, 1, lo) AS a, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1) AS z FROM c),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || m ELSE t END AS out_ FROM p),
r AS (SELECT *, string_split_regex(out_, '<[PSM]>') AS s FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars, sha256(out_) AS output_sha256,
sha256(CASE form WHEN 'psm' THEN s[2] || s[4] || s[3] WHEN 'spm' THEN s[3] || s[4] || s[2] ELSE out_ END) AS restored_sha256 FROM r"""

# crc32 bit by bit over the digits: a byte joins at every eighth step
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(x) + 1), lambda i: [ascii(x[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
OP12 = f"""WITH t AS (SELECT conv_id, turn, sha256(length(r) || ':' || r || x) AS h, length(x) AS c FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, list({{'h': h, 'c': c}} ORDER BY turn NULLS FIRST, h) AS l FROM t GROUP BY conv_id),
b AS (SELECT o.conv_id, o.l, {_CRC} % 6 AS k, f.l AS f FROM (SELECT *, CAST(conv_id AS VARCHAR) AS x FROM own) o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % 100),
r AS (SELECT conv_id, list_concat(CASE WHEN k > 0 THEN list_slice(coalesce(f, []), 1, k) ELSE [] END, list_slice(l, k + 1, len(l))) AS l FROM b),
e AS (SELECT conv_id, list_transform(l, lambda y: y.h) AS s, list_transform(l, lambda y: y.c) AS c FROM r),
p AS (SELECT conv_id, d, CASE WHEN d = 0 THEN [] ELSE s[1:d] END AS path, CASE WHEN d = 0 THEN 0 ELSE c[d] END AS chars, len(s) = d AS ended FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM e)),
n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends FROM p GROUP BY path, d),
u AS (SELECT *, CASE WHEN d = 1 THEN [] WHEN d > 1 THEN path[1 : d - 1] END AS up FROM n),
kids AS (SELECT up, count(*) AS k FROM u WHERE d > 0 GROUP BY up),
g AS (SELECT u.*, coalesce(kids.k, 0) AS k FROM u LEFT JOIN kids ON kids.up = u.path),
sums AS (SELECT CASE WHEN a = 0 THEN [] ELSE path[1:a] END AS path, count(*) FILTER (WHERE k = 0) AS leaves, sum((n_convs - 1) * chars) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM g) GROUP BY 1)
SELECT g.conv_id, g.d AS depth, q.conv_id AS parent_conv_id, g.n_convs, g.k AS n_children, sums.leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, g.ends AS ends_sha256 FROM g JOIN sums ON sums.path = g.path LEFT JOIN g q ON q.path = g.up"""

SQL: dict[str, str] = {"op2_quality_rules": OP2, "op3_substring": OP3, "op5_minhash": OP5, "op6_line_dedup": OP6, "op11_fim": OP11, "op12_prefix_trie": OP12}
