"""The truncation rule as plain SQL."""

from __future__ import annotations

from tidemark.llm import truncation as T


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _cleaned() -> str:
    out = "text"
    for pattern, to in T.STEPS:
        to = to.replace("$1", r"\1").replace("$2", r"\2").replace(T.NEXT, "' || chr(1) || '")
        out = f"regexp_replace({out}, {_quoted(pattern)}, '{to}', 'g')"
    return out


def _level(n: int, before: str) -> str:
    """What is known of the last n words: q{n} (before, word, here, cut)."""
    return f"""
f{n} AS (SELECT {before} AS before, word, sum(ends) AS ends FROM f GROUP BY ALL),
a{n} AS (SELECT {before} AS before, word, sum(c) AS c, sum(e) AS e FROM g GROUP BY ALL),
m{n} AS (SELECT f.before, f.word, any_value(ends) AS ends, coalesce(sum(a.c) FILTER (a.word = f.word), 0) AS c, coalesce(sum(a.e) FILTER (a.word = f.word), 0) AS e, coalesce(sum(a.c) FILTER (a.word <> f.word), 0) AS longer
 FROM f{n} f LEFT JOIN a{n} a ON a.before = f.before AND (a.word = f.word OR (length(f.word) <= {T.PART} AND starts_with(a.word, f.word))) GROUP BY ALL),
o{n} AS (SELECT *, CASE WHEN regexp_matches(word, {_quoted(T.CLOSED)}) THEN greatest(e, ends) ELSE e + ends END - 1 AS stop FROM m{n}),
q{n} AS (SELECT before, word, on_ + stop >= {T.FREQUENT} AS here, on_ >= {T.FREQUENT} AND stop <= {T.TERMINAL} * (on_ + stop) AS cut FROM (SELECT *, greatest(c - stop - 1, 0) + longer AS on_ FROM o{n})),"""


JUDGED = f"""WITH t AS (SELECT doc_id, source, {_cleaned()} AS x FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, source, list_filter(list_transform(string_split_regex(x, {_quoted(T.BREAK)}), lambda y: trim(y)), lambda y: y <> '') AS lines FROM t),
d AS (SELECT * FROM l WHERE len(lines) > 0), least AS (SELECT greatest(2, {T.KNOWN} * count(*)) AS least FROM d),
lc AS (SELECT line, count(*) AS c FROM (SELECT unnest(lines) AS line FROM d) GROUP BY ALL),
le AS (SELECT lines[-1] AS k, count(*) AS e FROM d GROUP BY ALL),
bh AS (SELECT coalesce(list(k), []) AS behind FROM le JOIN lc ON k = line CROSS JOIN least WHERE e >= least AND e >= {T.AT_ENDS} * c),
s0 AS (SELECT string_split_regex(line, ' ?\\x01') AS ss, c FROM lc),
s1 AS (SELECT unnest(ss) AS s, generate_subscripts(ss, 1) = len(ss) AS closes, c FROM s0),
sc AS (SELECT s, closes, sum(c) AS c FROM s1 GROUP BY ALL),
w AS (SELECT c, CASE WHEN closes AND regexp_matches(s, {_quoted(T.CLOSED)}) THEN c ELSE 0 END AS e, list_concat(['<s>', '<s>'], string_split_regex(s, ' +')) AS w FROM sc),
wj AS (SELECT *, unnest(range(3, len(w) + 1)) AS j FROM w),
g AS (SELECT w[j - 2] || ' ' || w[j - 1] || ' ' AS before, w[j] AS word, sum(c) AS c, sum(CASE WHEN j = len(w) THEN e ELSE 0 END) AS e FROM wj GROUP BY ALL),
b0 AS (SELECT doc_id, source, coalesce(list_filter(lines, lambda y: NOT list_contains(behind, y))[-1], lines[-1]) AS line FROM d CROSS JOIN bh),
b AS (SELECT doc_id, source, string_split_regex(regexp_replace(line, {_quoted(T.AT_WORD)}, ' \\1'), ' +') AS w FROM b0),
ml AS (SELECT replace(w[-1], chr(1), '') AS k, count(*) AS e FROM b GROUP BY ALL), mc AS (SELECT word, sum(c) AS c FROM g GROUP BY ALL),
mk AS (SELECT coalesce(list(k), []) AS marks FROM ml LEFT JOIN mc ON k = word CROSS JOIN least WHERE regexp_matches(k, {_quoted(T.SET_APART)}) AND e >= least AND e >= {T.MARK_AT_ENDS} * coalesce(c, 0)),
k0 AS (SELECT doc_id, source, w, list_max(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(marks, replace(w[i], chr(1), '')))) AS kept FROM b CROSS JOIN mk),
k1 AS (SELECT doc_id, source, string_split_regex(array_to_string(w[1:coalesce(kept, len(w))], ' '), ' ?\\x01')[-1] AS s FROM k0),
k2 AS (SELECT *, list_concat(['<s>', '<s>'], string_split_regex(s, ' +')) AS w FROM k1),
fin AS (SELECT doc_id, source, s, w[-3] || ' ' || w[-2] || ' ' AS before, w[-1] AS word FROM k2),
ks AS (SELECT s AS k, count(*) AS e FROM fin CROSS JOIN least GROUP BY s, least HAVING count(*) >= least),
kw AS (SELECT k, e, string_split(k, ' ')[-1] AS kw FROM ks), kb AS (SELECT *, left(k, length(k) - length(kw)) AS kb FROM kw),
hw AS (SELECT s, c, string_split_regex(s, ' +') AS w FROM sc), hi AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM hw),
hd AS (SELECT s, c, w[i] AS word, CASE WHEN i = 1 THEN '' ELSE array_to_string(w[1:i - 1], ' ') || ' ' END AS before FROM hi),
kk AS (SELECT k FROM hd JOIN kb ON before = kb AND starts_with(word, kw) GROUP BY k HAVING any_value(e) >= {T.AT_ENDS} * coalesce(sum(c) FILTER (s = k), 0) AND coalesce(sum(c) FILTER (s <> k), 0) < any_value(e)),
f AS (SELECT before, word, count(*) AS ends FROM fin GROUP BY ALL),
{_level(3, "before")}{_level(2, "split_part(before, ' ', 2) || ' '")}{_level(1, "''")}
z AS (SELECT fin.doc_id, fin.source, kk.k IS NULL AND coalesce(CASE WHEN q3.here THEN q3.cut WHEN q2.here THEN q2.cut ELSE q1.cut END, false) AS cut FROM fin LEFT JOIN kk ON fin.s = kk.k
 LEFT JOIN q3 ON q3.before = fin.before AND q3.word = fin.word LEFT JOIN q2 ON q2.before = split_part(fin.before, ' ', 2) || ' ' AND q2.word = fin.word LEFT JOIN q1 ON q1.word = fin.word)
"""
SQL = {
    "p9_found": JUDGED + "SELECT doc_id FROM z WHERE cut",
    "p9_report": JUDGED + "SELECT source, count(*) AS texts, count(*) FILTER (cut) AS cut, round(avg(cut::int), 6) AS share FROM z GROUP BY source",
}
