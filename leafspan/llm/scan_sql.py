"""SQL for the comparison engine: what language identification, the license scan and the substring deduplication return."""

from __future__ import annotations

from .langid import BLANK, PROFILE
from .license_scan import BASE, rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _wide(pattern: str) -> str:
    """A rule over a line whose words have a blank on either side each, as there is no looking around."""
    inner = pattern.removeprefix("(?<= )(?:").removesuffix(")(?= )")
    out, depth = "", 0
    for c in inner:  # blanks outside of classes part words
        depth += (c == "[") - (c == "]")
        out += "(?:  )" if c == " " and not depth else c
    return f" (?:{out}) "


def license_scan() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({i}, {text(label)}, {text('  ' + keyword.strip())}, {text(_wide(pattern))}, {priority})" for i, label, keyword, pattern, priority in rules())
    base = ", ".join(f"({text(label)}, {text(' ' + phrase.replace(' ', '  ') + ' ')}, {len(phrase.split())})" for phrase, label in BASE.items())
    places = "list_transform(range(len({f})), lambda j: list_sum(list_transform({g}[1:j + 1], lambda x: (length(x) - length(replace(x, ' ', ''))) // 2)) + coalesce(list_sum(list_transform({f}[1:j], lambda x: (length(x) - length(replace(x, ' ', ''))) // 2)), 0))"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS w FROM documents),
l AS (SELECT doc_id, len(w) AS n_words, CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, '  ') || ' ' ELSE '' END AS line FROM d),
br AS (SELECT * FROM (VALUES {base}) t(label, pattern, k)),
bs AS (SELECT doc_id, label, k, string_split(line, pattern) AS g FROM l JOIN br ON contains(line, pattern)),
bp AS (SELECT doc_id, label, unnest(list_transform(range(1, len(g)), lambda j: list_sum(list_transform(g[1:j], lambda x: (length(x) - length(replace(x, ' ', ''))) // 2)) + (j - 1) * k)) AS start FROM bs),
ba AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM bp GROUP BY 1),
r AS (SELECT * FROM (VALUES {table}) t(i, label, keyword, pattern, priority)),
h AS (SELECT doc_id, i, label, priority, regexp_extract_all(' ' || line, pattern) AS f, string_split_regex(line, pattern) AS g FROM l JOIN r ON contains(' ' || line, keyword) AND regexp_matches(line, pattern)),
p AS (SELECT doc_id, i, label, priority, unnest({places.format(f='f', g='g')}) AS s, unnest(list_transform(f, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2)) AS n FROM h),
q AS (SELECT *, s + n AS e FROM p),
k AS (SELECT * FROM q a WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.doc_id = a.doc_id AND o.s <= a.s AND o.e >= a.e AND o.priority >= a.priority AND (o.s < a.s OR o.e > a.e OR o.priority > a.priority OR o.i < a.i))),
ka AS (SELECT doc_id, list(label) AS own, max(priority) / 4.0::DOUBLE AS best FROM k GROUP BY 1),
bl AS (SELECT doc_id, list(label) AS base FROM bp GROUP BY 1)
SELECT l.doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels, greatest(coalesce(best, 0), CASE WHEN n_base > 0 THEN 0.75::DOUBLE ELSE 0 END) AS score
FROM l LEFT JOIN ba ON ba.doc_id = l.doc_id LEFT JOIN ka ON ka.doc_id = l.doc_id LEFT JOIN bl ON bl.doc_id = l.doc_id
"""


SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(length(h) // 2)) AS i, unnest(list_transform(range(length(h) // 2), lambda j: substring(h, 2 * j + 1, 2))) AS b,
  unnest(list_transform(range(length(h) // 2), lambda j: CASE WHEN 2 * j + 200 <= length(h) THEN substring(h, 2 * j + 1, 200) END)) AS g FROM d),
s AS (SELECT doc_id, i, b, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM p),
c AS (SELECT doc_id, i, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM s),
t AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS starts FROM c),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM t GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""


def language_id() -> str:
    crc = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT), lambda a, b: list_reduce(range(8)::BIGINT[], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT)"
    return rf"""
WITH d AS (SELECT doc_id, lang, {crc} % 4 = 2 AS held_out, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS ch FROM (SELECT doc_id, string_split(text, '') AS a FROM d WHERE text <> '')),
y AS (SELECT doc_id, i, CASE WHEN regexp_matches(ch, '^[\p{{L}}\p{{M}}]') AND bool_or(regexp_matches(ch, '^\p{{L}}')) OVER (PARTITION BY doc_id) THEN unicode(lower(ch))::BIGINT ELSE 0 END AS s FROM c),
k AS (SELECT doc_id, i, s FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM y) WHERE s > 0 OR before > 0),
n AS (SELECT doc_id, s, coalesce(lag(s) OVER w, 0) AS p, coalesce(lead(s) OVER w, 0) AS q, lead(s) OVER w IS NULL AS ends FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
z AS (SELECT doc_id, s, CASE p WHEN 0 THEN {BLANK} ELSE p END AS p, CASE q WHEN 0 THEN {BLANK} ELSE q END AS q, p AS before, ends FROM n),
g AS (SELECT doc_id, s AS code FROM z WHERE s > 0 UNION ALL SELECT doc_id, (p << 21) | CASE s WHEN 0 THEN {BLANK} ELSE s END FROM z WHERE before > 0 OR s > 0
  UNION ALL SELECT doc_id, (s << 21) | {BLANK} FROM z WHERE ends AND s > 0 UNION ALL SELECT doc_id, (p << 42) | (s << 21) | q FROM z WHERE s > 0),
f AS (SELECT doc_id, code, count(*) AS n FROM g GROUP BY 1, 2),
t AS (SELECT * FROM (SELECT doc_id, code, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) - 1 AS r FROM f) WHERE r < {PROFILE}),
l AS (SELECT lang, code, sum(n) AS n FROM f JOIN d ON d.doc_id = f.doc_id WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1, 2),
o AS (SELECT * FROM (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY n DESC, code) - 1 AS r FROM l) WHERE r < {PROFILE}),
a AS (SELECT t.doc_id, v.lang, sum(CASE WHEN o.r IS NULL THEN {PROFILE} ELSE abs(o.r - t.r) END) AS away, count(*) * {PROFILE} AS most FROM t CROSS JOIN (SELECT DISTINCT lang FROM o) v LEFT JOIN o ON o.lang = v.lang AND o.code = t.code GROUP BY 1, 2),
b AS (SELECT doc_id, lang, away::DOUBLE AS away, most::DOUBLE AS most, row_number() OVER w AS rn, lead(away) OVER w AS other FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY away, lang))
SELECT d.doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, CASE WHEN b.lang IS NULL THEN 0::DOUBLE ELSE 1 - away / most END AS score, CASE WHEN b.lang IS NULL THEN 0::DOUBLE WHEN other IS NULL THEN 1::DOUBLE ELSE (other - away) / most END AS margin
FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND rn = 1
"""
