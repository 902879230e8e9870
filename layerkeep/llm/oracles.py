"""SQL for DuckDB that the queries' rows must equal, written apart from the operators.

The operators' fixed values (templates, units, trimmed characters) are shared;
the logic is not.
"""

from __future__ import annotations

import re

from . import decontaminate, exact_dedup, license_scan, line_dedup

SUBSTRING = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
k AS (
  SELECT doc_id, unnest(range(1, len(words) - 48)) AS place, words FROM w WHERE len(words) >= 50),
h AS (SELECT doc_id, place, sha256(array_to_string(words[place:place + 49], ' ')) AS run FROM k),
m AS (SELECT run, min(doc_id) AS least FROM h GROUP BY run),
c AS (
  SELECT DISTINCT h.doc_id, h.place + o AS place FROM h JOIN m USING (run), range(50) t(o) WHERE h.doc_id > m.least),
e AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w),
r AS (
  SELECT e.doc_id, count(*) AS n_words, count(c.place) AS n_removed, string_agg(word, ' ' ORDER BY e.place) FILTER (WHERE c.place IS NULL) AS kept
  FROM e LEFT JOIN c ON c.doc_id = e.doc_id AND c.place = e.place GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id)
"""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[place:place + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS place FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, seen) AS (
  SELECT DISTINCT a, a FROM e
  UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""

_LICENSE = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
p(phrase, label) AS (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')),
t(pattern, label, score) AS (VALUES @T@),
v AS (SELECT doc_id, words, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM w),
f AS (
  SELECT doc_id, place - 1 AS place, label FROM v JOIN p ON string_split(phrase, ' ')[1] = v.word
  WHERE words[place:place + len(string_split(phrase, ' ')) - 1] = string_split(phrase, ' ')),
b AS (SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f GROUP BY doc_id),
a AS (
  SELECT doc_id, label, 0.75 AS score FROM f
  UNION ALL SELECT doc_id, label, score FROM w, t WHERE regexp_matches(' ' || array_to_string(words, ' ') || ' ', pattern)),
g AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM a GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(b.n, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(g.score, 0)::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN g USING (doc_id)
"""

_DECONTAMINATE = r"""
WITH x AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
v AS (
  SELECT side, id, unnest(string_split_regex(text, '[\x20\x09-\x0D]+')) AS raw, generate_subscripts(string_split_regex(text, '[\x20\x09-\x0D]+'), 1) AS place FROM x),
t AS (
  SELECT side, id, place, trim(raw, @TRIM@) AS tok, regexp_matches(substr(raw, len(rtrim(raw, @TRIM@)) + 1), '[.!?]') AS stops,
         count(*) FILTER (WHERE trim(raw, @TRIM@) <> '') OVER (PARTITION BY side, id ORDER BY place) AS n
  FROM v),
s AS (SELECT side, id, n + 1 AS n, bool_or(stops) AS starts FROM t GROUP BY ALL),
k AS (
  SELECT t.side, t.id, t.n - 1 AS i, lower(tok) AS tok,
    CASE WHEN regexp_full_match(tok, '[0-9][0-9.,:/-]*(@ALT@)?') THEN '<num>'
         WHEN NOT (t.n = 1 OR coalesce(s.starts, false)) AND lower(tok[1]) <> tok[1] AND tok <> upper(tok) THEN '<name>'
         WHEN lower(tok) IN (@UNITS@) THEN '<unit>' ELSE lower(tok) END AS form
  FROM t LEFT JOIN s ON s.side = t.side AND s.id = t.id AND s.n = t.n WHERE tok <> ''),
l AS (SELECT side, id, count(*) AS n, list(form ORDER BY i) AS forms FROM k GROUP BY ALL),
items AS (
  SELECT id AS item_id, n AS n_item, forms, least(n, 8) AS size FROM l
  WHERE side = 'b' AND n >= 4 AND 2 * len(list_filter(forms, lambda f: f NOT IN ('<num>', '<name>', '<unit>'))) >= n),
q AS (SELECT item_id, size, forms[j + 1:j + size] AS win, j FROM (SELECT *, unnest(range(0, n_item - size + 1)) AS j FROM items)),
p AS (
  SELECT id AS doc_id, z.size, forms[j + 1:j + z.size] AS win, j
  FROM (SELECT l.*, size, unnest(range(0, greatest(0, n - size + 1))) AS j FROM l, (SELECT DISTINCT size FROM items) WHERE side = 'd') z),
a AS (
  SELECT DISTINCT p.doc_id, q.item_id, p.j - q.j AS shift FROM p JOIN q ON p.size = q.size AND p.win = q.win
  WHERE 2 * len(list_filter(q.win, lambda f: f NOT IN ('<num>', '<name>', '<unit>'))) >= q.size),
h AS (
  SELECT a.*, b.form AS kind, b.tok AS theirs, d.tok AS ours
  FROM a JOIN k b ON b.side = 'b' AND b.id = a.item_id JOIN k d ON d.side = 'd' AND d.id = a.doc_id AND d.i = b.i + a.shift
  WHERE b.form = d.form OR b.tok = d.tok),
g AS (
  SELECT doc_id, item_id, shift, count(*) AS n_matched, count(*) FILTER (WHERE theirs = ours) AS n_same, count(*) FILTER (WHERE kind IN ('<num>', '<name>', '<unit>')) AS n_slots,
         count(DISTINCT (kind, theirs, ours)) FILTER (WHERE kind IN ('<num>', '<name>', '<unit>')) AS three,
         count(DISTINCT (kind, theirs)) FILTER (WHERE kind IN ('<num>', '<name>', '<unit>')) AS two, count(DISTINCT (kind, ours)) FILTER (WHERE kind IN ('<num>', '<name>', '<unit>')) AS other
  FROM h GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_matched, n_slots, n_same = n_item AS verbatim, shift AS first_token
FROM g JOIN items USING (item_id) WHERE three = two AND three = other AND n_matched >= 0.5 * n_item
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, n_same = n_item DESC, shift) = 1
"""


def template_pattern(template: str) -> str:
    """A template as a regular expression over words that each end in a space."""
    out = " "
    for part in re.split(r"(<<[^>]*>>)", template):
        if part.startswith("<<var"):
            low, high = part.strip("<>").split(";")[1:]
            out += f"([^ ]+ ){{{low},{high}}}"
        elif part.startswith("<<"):
            out += "(" if part == "<<optional>>" else ")?"
        else:
            out += "".join(f"{w} " for w in part.split())
    return out


def license_sql() -> str:
    rows = ", ".join(f"('{template_pattern(x)}', '{label}', {1.0 if label in license_scan.TEXTS else 0.9})" for label, x in license_scan.TEMPLATES.items())
    return _LICENSE.replace("@T@", rows)


def decontaminate_sql() -> str:
    trim = "'" + decontaminate.TRIM.replace("'", "''") + "'"
    units = ", ".join(f"'{u}'" for u in decontaminate.UNITS)
    return _DECONTAMINATE.replace("@TRIM@", trim).replace("@ALT@", "|".join(decontaminate.UNITS)).replace("@UNITS@", units)


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": SUBSTRING,
        "op2_exact_dedup": exact_dedup.ORACLE,
        "op4_decontaminate": decontaminate_sql(),
        "op8_line_dedup": line_dedup.ORACLE,
        "op9_license_scan": license_sql(),
        "op10_near_dedup": NEAR,
    }
