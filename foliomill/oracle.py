"""The registered document queries in DuckDB SQL, over the same rendered views.

RE2 has no Unicode ``\\s`` or ``\\w`` and no look-around, so classes are spelt out and look-behind becomes a mark.
"""

from __future__ import annotations

import re

from .functions import regex as R
from .plans import rendered

S = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
D = r"\p{Nd}"
W = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"


def re2(pattern: str) -> str:
    """A pattern of ``functions.regex`` for RE2: flags, and classes outside and inside brackets."""
    flags, rest = pattern[2 : pattern.index(")")], pattern[pattern.index(")") + 1 :]
    out, inside, i = "", False, 0
    while i < len(rest):
        two = rest[i : i + 2]
        if two == r"\s":
            out += S[1:-1] if inside else S
        elif two == r"\d":
            out += D
        elif two == r"\w":
            out += W[1:-1] if inside else W
        elif two == r"\b":
            out += r"(?:^|$|[^\p{L}\p{Nd}_])"
        elif two[0] == "\\":
            out += two
        else:
            inside = rest[i] == "[" or (inside and rest[i] != "]")
            out += rest[i]
            i -= 1
        i += 2
    keep = "".join(f for f in flags if f in "ims")
    return f"(?{keep}){out}" if keep else out


def q(pattern: str) -> str:
    return "'" + re2(pattern).replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{S}+', ' ', 'g')"


def collapse(x: str) -> str:
    return strip(squeeze(x))


def normalize_line(x: str) -> str:
    p = q(R.BROKEN_NUMBER)
    return (
        f"CASE WHEN regexp_matches({x}, {p}) THEN regexp_replace(regexp_extract({x}, {p}, 1), '\\.{S}*', '.', 'g') || '.' || regexp_extract({x}, {p}, 2)"
        f" || substr({x}, length(regexp_extract({x}, {p}, 0)) + 1) ELSE {x} END"
    )


def normalize_number(x: str) -> str:
    return f"regexp_replace({strip(x)}, '\\.+$', '')"


def depth(x: str) -> str:
    return f"(length({x}) - length(replace({x}, '.', '')) + 1)"


def strip_dots(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(R.TRAILER_DOTS)}, '')")


def strip_page(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(R.TRAILER_PAGE)}, '')")


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def normal_heading(x: str) -> str:
    return f"regexp_replace(lower({squeeze(strip(x))}), '[^{W[1:-1]}{S[1:-1]}]', '', 'g')"


def topic(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN '{label}'" for label, p in R.TOPICS) + f" ELSE '{R.OTHER_TOPIC}' END"


def clean_item(x: str) -> str:
    return strip(f"regexp_replace({collapse(x)}, ';{S}*$', '')")


def clean_cell(x: str) -> str:
    return strip(f"regexp_replace(replace(coalesce({x}, ''), chr(10), ' '), '{S}{{2,}}', ' ', 'g')")


def with_(views: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",".join([rendered.duck(*views.split()), *more])


# headings ---------------------------------------------------------------------------------------------------------------------------------

def _title(x: str) -> str:
    rest = f"regexp_extract({x}, {q(R.TOC_ENTRY)}, 2)"
    return f"CASE WHEN fmt = 'A' THEN {strip_dots(rest)} ELSE {strip_page(rest)} END"


def _is_entry(x: str) -> str:
    return f"({has(x, R.TOC_ENTRY)} AND NOT {has(x, R.SKIPPED)} AND NOT {has(x, R.PAGE_NUMBER)} AND {_title(x)} <> '' AND NOT regexp_matches({_title(x)}, {q(R.PAGE_NUMBER)}))"


HEADINGS = f"""
h0 AS (SELECT doc_id, page_idx, line_no, text, {strip('text')} AS s FROM text_lines),
hp AS (
  SELECT doc_id, page_idx, CASE WHEN count(*) FILTER ({has('s', R.TOC_LEADER)}) >= 3 THEN 'A'
    WHEN bool_or(line_no < 5 AND {has('text', R.TOC_HEADER_OPEN)}) OR count(*) FILTER ({has('s', R.PLAIN_ENTRY)}) >= 3 THEN 'B' ELSE '' END AS fmt
  FROM h0 GROUP BY ALL
),
h1 AS (SELECT h0.*, fmt, {normalize_line('s')} AS n FROM h0 JOIN hp USING (doc_id, page_idx)),
h2 AS (
  SELECT *, {_is_entry('n')} AS entry, {normalize_number(f"regexp_extract(n, {q(R.TOC_ENTRY)}, 1)")} AS number, {_title('n')} AS title,
    fmt <> '' AND {has('s', R.APPENDIX)} AS appendix, {has('s', R.SKIPPED)} AS skipped, {has('s', R.TOC_LEADER)} AS leader,
    CASE WHEN fmt = 'A' THEN {strip_dots('s')} ELSE {strip_page('s')} END AS piece,
    s = '' OR {has('s', R.PAGE_NUMBER)} OR {has('s', R.SKIPPED)} OR (fmt <> '' AND {has('s', R.APPENDIX)}) OR {_is_entry('s')} AS stop
  FROM h1
),
h3 AS (SELECT *, sum(CAST(stop AS INT)) OVER (PARTITION BY doc_id, page_idx ORDER BY line_no) AS g FROM h2),
h4 AS (
  SELECT *, coalesce(max(CAST(leader AND NOT stop AS INT)) OVER (PARTITION BY doc_id, page_idx, g ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed
  FROM h3
),
h5 AS (
  SELECT doc_id, page_idx, g, min(line_no) AS line_no, bool_or(stop AND entry AND NOT appendix) AS opens,
    max(CASE WHEN stop THEN number END) AS number, max(CASE WHEN stop THEN title END) AS title, bool_or(appendix) AS appendix,
    bool_or(appendix AND NOT skipped) AS silent, bool_or(leader AND NOT stop) AS ended,
    string_agg(CASE WHEN NOT stop AND closed = 0 AND piece <> '' THEN piece END, ' ' ORDER BY line_no) AS pieces
  FROM h4 WHERE fmt <> '' AND g > 0 GROUP BY doc_id, page_idx, g
),
h6 AS (
  SELECT *, opens AND NOT (NOT ended AND coalesce(lead(silent) OVER (PARTITION BY doc_id, page_idx ORDER BY g), FALSE)) AS heading FROM h5
),
h7 AS (
  SELECT doc_id, min(CASE WHEN heading THEN page_idx END) AS first_page, min(CASE WHEN appendix THEN page_idx * 1000000 + line_no END) AS stop_at FROM h6 GROUP BY doc_id
),
h8 AS (
  SELECT doc_id, first_page, stop_at, min(CASE WHEN fmt = '' AND hp.page_idx > first_page THEN hp.page_idx END) AS gap FROM h7 JOIN hp USING (doc_id) GROUP BY ALL
),
headings AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, line_no) - 1 AS pos, {depth('number')} AS depth, number,
    {collapse("title || coalesce(' ' || pieces, '')")} AS text
  FROM h6 JOIN h8 USING (doc_id) WHERE heading AND (gap IS NULL OR page_idx < gap) AND (stop_at IS NULL OR page_idx * 1000000 + line_no < stop_at)
),
uniq AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, depth, number, text FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, number, text ORDER BY pos) AS k FROM headings) x WHERE k = 1
)"""

# sections ---------------------------------------------------------------------------------------------------------------------------------

TOC_PAGES = f"""
tp AS (
  SELECT doc_id, page_idx, count(*) FILTER ({has('text', R.BODY_LEADER)}) >= 3 OR bool_or(line_no < 5 AND regexp_matches({strip('text')}, {q(R.TOC_HEADER)}))
    OR count(*) FILTER (regexp_matches({strip('text')}, {q(R.PLAIN_ENTRY)})) >= 3 AS is_toc
  FROM text_lines GROUP BY ALL
)"""

#: keys and nums of each document's contents, then a recursion over its candidate lines.
TRACK = """
keys AS (
  SELECT doc_id, list({'num': number, 'norm': norm, 'pos': last, 'depth': depth} ORDER BY first) AS keys FROM (
    SELECT doc_id, number, min(pos) AS first, max(pos) AS last, arg_max(depth, pos) AS depth, arg_max(normal, pos) AS norm
    FROM toc_in GROUP BY doc_id, number) x GROUP BY doc_id
),
nums AS (SELECT doc_id, list(number ORDER BY pos) AS nums FROM toc_in GROUP BY doc_id),
cand AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS step FROM cand_in),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS cur, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS number
  FROM (SELECT DISTINCT doc_id FROM cand) d
  UNION ALL
  SELECT doc_id, step, CASE WHEN k = 'B' THEN hit.pos + 1 ELSE cur END, CASE WHEN k = 'B' THEN list_append(used, hit.num) ELSE used END, seq, k, CASE WHEN k = 'B' THEN hit.num END
  FROM (
    SELECT *, CASE WHEN hit IS NULL THEN NULL WHEN hit.depth = 1 AND hit.pos > cur AND len(list_filter(nums[cur + 1 : hit.pos], lambda n: NOT list_contains(used, n))) > 0 THEN 'R' ELSE 'B' END AS k
    FROM (
      SELECT c.doc_id, c.step, w.cur, w.used, c.seq, n.nums, coalesce(
        list_filter(y.keys, lambda k: k.num = c.num AND NOT list_contains(w.used, k.num))[1],
        CASE WHEN c.font AND length(c.norm) >= 5 THEN list_filter(y.keys, lambda k: NOT list_contains(w.used, k.num) AND k.norm <> '' AND (starts_with(c.norm, k.norm) OR starts_with(k.norm, c.norm)))[1] END) AS hit
      FROM walk w JOIN cand c ON c.doc_id = w.doc_id AND c.step = w.step + 1 JOIN keys y ON y.doc_id = c.doc_id JOIN nums n ON n.doc_id = c.doc_id
    ) a
  ) b
),
events AS (SELECT doc_id, seq, kind, number FROM walk WHERE kind IS NOT NULL)"""

FILTERED = f"""
b0 AS (SELECT doc_id, page_idx, line_no, bold, size, {normalize_line(strip('text'))} AS t FROM text_lines JOIN tp USING (doc_id, page_idx) WHERE NOT is_toc),
bl AS (
  SELECT doc_id, page_idx, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, line_no) AS seq, t AS text, bold OR size >= 13 AS font
  FROM b0 WHERE t <> '' AND NOT {has('t', R.PAGE_NUMBER)}
    AND NOT ({has('t', R.BODY_LEADER)} AND ({strip_dots('t')} = '' OR regexp_matches({strip_dots('t')}, {q(R.PAGE_NUMBER)})))
),
toc_in AS (SELECT doc_id, pos, depth, number, {normal_heading('text')} AS normal FROM uniq),
cand_in AS (
  SELECT doc_id, seq, num, {normal_heading('rest')} AS norm, font AND rest <> '' AS font FROM (
    SELECT doc_id, seq, font, {normalize_number(f"regexp_extract(text, {q(R.BODY_ENTRY)}, 1)")} AS num, {strip(f"regexp_extract(text, {q(R.BODY_ENTRY)}, 2)")} AS rest
    FROM bl WHERE {has('text', R.BODY_ENTRY)}) x
  WHERE (font AND rest <> '') OR (doc_id, num) IN (SELECT doc_id, number FROM uniq)
)"""

_FRAGMENT = f"lower({squeeze(strip_dots('text'))})"
SECTIONS = f"""
m0 AS (SELECT bl.*, kind, number, sum(CASE WHEN kind = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS sec_pos FROM bl LEFT JOIN events USING (doc_id, seq)),
title AS (SELECT doc_id, number, arg_max(text, pos) AS heading, arg_max(depth, pos) AS depth FROM uniq GROUP BY ALL),
opened AS (SELECT doc_id, sec_pos, number, heading, depth FROM m0 JOIN title USING (doc_id, number) WHERE kind = 'B'),
m1 AS (
  SELECT m0.doc_id, sec_pos, seq, text, kind, kind IS NULL AND font AND {_FRAGMENT} <> '' AND contains(lower({squeeze(strip('heading'))}), {_FRAGMENT}) AS wrap
  FROM m0 JOIN opened USING (doc_id, sec_pos)
),
m2 AS (
  SELECT *, coalesce(sum(CASE WHEN kind IS NULL AND NOT wrap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec_pos ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cleared FROM m1
),
secs AS (
  SELECT doc_id, sec_pos, o.number, o.heading, o.depth,
    coalesce({collapse("string_agg(CASE WHEN NOT (coalesce(kind, '') = 'B' OR (wrap AND cleared = 0)) THEN text END, ' ' ORDER BY seq)")}, '') AS content
  FROM m2 JOIN opened o USING (doc_id, sec_pos) GROUP BY ALL
)"""

# the page tracker is the same walk over other lines
PAGE_CAND = f"""
toc_in AS (SELECT doc_id, pos, {depth('number')} AS depth, number, '' AS normal FROM uniq),
pc AS (
  SELECT doc_id, page_idx, line_no, regexp_extract(t, {q(R.TABLE_ENTRY)}, 1) AS num FROM (
    SELECT doc_id, page_idx, line_no, {normalize_line('text')} AS t FROM text_lines JOIN tp USING (doc_id, page_idx) WHERE bold AND NOT is_toc) x
  WHERE {has('t', R.TABLE_ENTRY)}
),
pd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, line_no) AS seq FROM pc WHERE (doc_id, num) IN (SELECT doc_id, number FROM uniq)),
cand_in AS (SELECT doc_id, seq, num, '' AS norm, FALSE AS font FROM pd)"""
PAGES = """
pl AS (SELECT doc_id, page_idx, arg_max(e.number, e.seq) AS number FROM events e JOIN pd USING (doc_id, seq) WHERE kind = 'B' GROUP BY doc_id, page_idx),
page_map AS (
  SELECT doc_id, page_idx, last_value(number IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_idx) AS number
  FROM (SELECT DISTINCT doc_id, page_idx FROM text_lines) p LEFT JOIN pl USING (doc_id, page_idx)
)"""


def _renamed(sql: str) -> str:
    """The walk under other names, where both trackers stand in one statement."""
    for name in ("toc_in", "cand_in", "keys", "nums", "cand", "walk", "events"):
        sql = re.sub(rf"\b{name}\b(?!\s*:)(?!\.)", f"{name}2", sql)
    return sql


# words ------------------------------------------------------------------------------------------------------------------------------------

ROWS = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY round_even(top, 0), x0, word_idx) AS n FROM words),
anchors AS (
  SELECT doc_id, page_idx, list_reduce(list([top] ORDER BY n), lambda a, t: CASE WHEN abs(t[1] - a[1]) <= 2.0 THEN list_concat([a[1], a[2] + 1], a[3:]) ELSE list_append(list_concat([t[1], a[2] + 1], a[3:]), a[2] + 1) END, [-999.0, 0.0]::DOUBLE[])[3:] AS starts
  FROM ordered GROUP BY ALL
),
rows_ AS (SELECT o.*, len(list_filter(starts, lambda s: s <= n)) - 1 AS row_no FROM ordered o JOIN anchors USING (doc_id, page_idx))"""
BODY = f"""
chars AS (
  SELECT doc_id, page_idx, row_no, fontname, sum(length(text)) AS n, min(k) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx, row_no ORDER BY x0, round_even(top, 0), word_idx) AS k FROM rows_) x GROUP BY ALL
),
fonts AS (SELECT doc_id, page_idx, row_no, arg_max(fontname, n * 1000000 - k) AS font FROM chars GROUP BY ALL),
body AS (
  SELECT doc_id, page_idx, row_no, {strip("string_agg(text, ' ' ORDER BY x0, round_even(top, 0), word_idx)")} AS text, avg(size) AS size FROM rows_ GROUP BY ALL
)"""

# lists ------------------------------------------------------------------------------------------------------------------------------------

_LETTERS, _CYRILLIC = "А-ЯЁA-Zа-яёa-z", "А-ЯЁа-яё"
_BULLETS = f"string_split(regexp_replace(content, '(?m)(^|[{S[1:-1]};.]){S}*[•●○▪■►]{S}*', '\\1' || chr(1), 'g'), chr(1))[2:]"
_DASHES = f"string_split(regexp_replace(content, '(?m)(^|{S})[-–—]{S}+([{_LETTERS}])', '\\1' || chr(1) || '\\2', 'g'), chr(1))[2:]"
_NUMBERS = f"string_split(regexp_replace(content, '(?m)(^|{S})(?:{D}{{1,2}}[)]{S}+([{_LETTERS}])|{D}{{1,2}}[.]{S}+([{_CYRILLIC}]))', '\\1' || chr(1) || '\\2\\3', 'g'), chr(1))[2:]"
_ITEMS = lambda x: f"list_filter(list_transform({x}, lambda s: {clean_item('s')}), lambda s: length(s) >= 8)"
_GOOD = lambda x: f"len({x}) >= 2 AND len(list_filter({x}, lambda s: {has('s', R.CITATION)})) < len({x}) * 0.4::DOUBLE"
LISTS = f"""
l0 AS (SELECT doc_id, sec, heading, {topic('heading')} AS topic, {_BULLETS} AS rb, {_DASHES} AS rd, {_NUMBERS} AS rn FROM content WHERE {strip('content')} <> ''),
l1 AS (SELECT *, {_ITEMS('rb')} AS ib, {_ITEMS('rd')} AS id, {_ITEMS('rn')} AS n_ FROM l0),
l2 AS (
  SELECT doc_id, sec, heading, topic, 1 AS ord, 'bullet' AS kind, ib AS items FROM l1 WHERE {_GOOD('ib')}
  UNION ALL SELECT doc_id, sec, heading, topic, 2, 'bullet', id FROM l1
    WHERE len(rd) >= 2 AND len(list_filter(rd, lambda s: regexp_matches(s, ';{S}*$'))) >= greatest(1, len(rd) * 0.4::DOUBLE) AND {_GOOD('id')}
      AND (len(ib) = 0 OR list_sort(list_distinct(id)) <> list_sort(list_distinct(ib)))
  UNION ALL SELECT doc_id, sec, heading, topic, 3, 'numbered', n_ FROM l1 WHERE {_GOOD('n_')}
),
l3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sec ORDER BY ord) - 1 AS list_no FROM l2)"""

# tables -----------------------------------------------------------------------------------------------------------------------------------

_CELL = lambda c: strip(f"replace(coalesce({c}, ''), chr(10), ' ')")
_ANY = lambda *w: "(" + " OR ".join(f"contains(flat, '{x}')" for x in w) + ")"
FLAGS = f"""
t0 AS (
  SELECT k, rows, regexp_replace(lower(array_to_string(list_transform(flatten(rows), lambda c: {_CELL('c')}), ' ')), '-{S}+', '', 'g') AS flat,
    coalesce(lower(list_filter(list_transform(rows, lambda r: list_transform(r, lambda c: {_CELL('c')})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0)[1][1]), '') AS first,
    list_max(list_transform(rows, lambda r: len(r))) AS ncol, len(flatten(rows)) AS cells, len(list_filter(flatten(rows), lambda c: {strip("coalesce(c, '')")} <> '')) AS filled
  FROM grids
),
t1 AS (
  SELECT *, list_max(list_transform(range(1, ncol + 1), lambda j: len(list_filter(rows, lambda r: {strip("coalesce(r[j], '')")} <> '')))) AS dominant FROM t0
),
t2 AS (
  SELECT *, len(rows) <= 2 OR (cells > 0 AND filled / cells < 0.15) AS artifact,
    {_ANY('да/нет', 'да / нет')} OR ({_ANY('критерии качества')} AND {_ANY('убедительности', 'достоверности', 'уур', 'выполнения')})
      OR {_ANY('рабочей группы', 'рабочая группа', 'члены рабочей')} OR ({has('flat', R.CREDENTIALS)} AND {has('flat', R.INSTITUTION)}) AS checklist,
    first IN ('ууr', 'уур', 'удд') OR ({_ANY('сильная рекомендация')} AND {_ANY('уур')})
      OR {_ANY('уровень убедительности рекомендаций', 'несравнительные исследования', 'описание клинического случая', 'обоснование механизма действия')}
      OR (regexp_matches(first, '^[1-5]$') AND {_ANY('систематический обзор', 'рандомизированн')}) AS legend,
    ncol >= 2 AND (filled = 0 OR dominant / filled >= 0.70) AS wrapped,
    ncol >= 2 OR regexp_matches({clean_cell('rows[1][1]')}, {q(R.DIAGNOSTIC)}) AS wide
  FROM t1
),
flags AS (SELECT *, artifact OR checklist OR legend OR wrapped AS skipped FROM t2)"""


def _captions(tables: str) -> str:
    line = strip("string_agg(w.text, ' ' ORDER BY round_even(w.top, 0), x0, word_idx)")
    return f"""
caps AS (
  SELECT * FROM (
    SELECT t.doc_id, t.page_idx, t.table_idx, {line} AS caption
    FROM {tables} t JOIN words w ON w.doc_id = t.doc_id AND w.page_idx = t.page_idx AND w.top >= t.top - 22 AND w.top <= t.top AND w.bottom <= t.top + 4 GROUP BY ALL) x
  WHERE {has('caption', R.CAPTION)}
)"""


TABLES = f"""
kept AS (SELECT p.*, f.ncol FROM placed p JOIN flags f ON f.k = p.k WHERE NOT f.skipped AND f.wide),{_captions('kept')},
attached AS (
  SELECT kept.doc_id, s.sec_pos, s.number, kept.page_idx, kept.table_idx, caption, len(kept.rows) AS n_rows, len(flatten(kept.rows)) AS n_cells
  FROM kept JOIN page_map pm ON pm.doc_id = kept.doc_id AND pm.page_idx = kept.page_idx + 1000
  JOIN (SELECT doc_id, number, max(sec_pos) AS sec_pos FROM secs GROUP BY ALL) s ON s.doc_id = kept.doc_id AND s.number = pm.number
  LEFT JOIN caps ON caps.doc_id = kept.doc_id AND caps.page_idx = kept.page_idx AND caps.table_idx = kept.table_idx
)"""

KEY = "CAST(doc_id AS BIGINT) AS doc_id, CAST(page_idx AS BIGINT) AS page_idx, CAST(line_no AS BIGINT) AS line_no"
_B = lambda *n: ", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in n)
_INDENT = "repeat(' ', CAST(CASE WHEN depth <= 5 THEN 2 * (depth - 1) ELSE 10 END AS BIGINT))"
_TOC = with_("text_lines", HEADINGS)
_SECS = with_("text_lines", HEADINGS, TOC_PAGES, FILTERED, TRACK, SECTIONS, recursive=True)
_ENTRY_SECS = "es AS (SELECT doc_id, i AS sec_pos, number, title AS heading, CASE WHEN line <> '' AND i % 13 <> 7 THEN CASE WHEN i % 9 = 4 THEN ' ..... ' ELSE '' END || line END AS content FROM entries)"
_FULL = with_("text_lines words placed", HEADINGS, TOC_PAGES, FILTERED, TRACK, SECTIONS, _renamed(PAGE_CAND), _renamed(TRACK), _renamed(PAGES), FLAGS, TABLES, recursive=True)


def sql() -> dict[str, str]:
    from .queries import PREDICATES

    number = normalize_number(f"regexp_extract(line, {q(R.BODY_ENTRY)}, 1)")
    line = normalize_line(strip("text"))
    heading = "CAST(doc_id AS BIGINT) AS doc_id, CAST(pos AS BIGINT) AS pos, CAST(depth AS BIGINT) AS depth, 'H' || depth AS level, number, text"
    part = lambda p, k: f"regexp_extract(s, {q(p)}, {k})"
    return {
        "line_numbers": f"{with_('text_lines')} SELECT {_B('doc_id', 'page_idx', 'line_no')}, line, number, {depth('number')}::BIGINT AS depth, 'H' || {depth('number')} AS level FROM (SELECT *, {number} AS number FROM (SELECT *, {line} AS line FROM text_lines) x WHERE {has('line', R.BODY_ENTRY)}) y",
        "line_trailers": f"{with_('text_lines')} SELECT {KEY}, {strip_dots('text')} AS without_dots, {strip_page('text')} AS without_page, {collapse('text')} AS clean FROM text_lines",
        "line_predicates": f"{with_('text_lines')} SELECT {KEY}, " + ", ".join(f"CAST({has('s', p)} AS BIGINT) AS {n}" for n, p in PREDICATES.items()) + f" FROM (SELECT *, {strip('text')} AS s FROM text_lines) x",
        "heading_entries": f"{with_('text_lines')} SELECT {KEY}, {part(R.TOC_ENTRY, 1)} AS toc_number, {part(R.TOC_ENTRY, 2)} AS toc_rest, {part(R.BODY_ENTRY, 2)} AS body_rest, {part(R.TABLE_ENTRY, 1)} AS table_number, {part(R.TABLE_ENTRY, 2)} AS table_rest, {normal_heading(part(R.BODY_ENTRY, 2))} AS normal FROM (SELECT *, {strip('text')} AS s FROM text_lines) x WHERE regexp_matches(s, '^{D}')",
        "topics": f"{with_('content')} SELECT {_B('doc_id', 'sec')}, {topic('heading')} AS topic FROM content",
        "word_rows": f"{with_('words', ROWS)} SELECT {_B('doc_id', 'page_idx', 'word_idx', 'row_no')}, text FROM rows_",
        "body_lines": f"{with_('words', ROWS, BODY)} SELECT {_B('doc_id', 'page_idx')}, CAST(row_no AS BIGINT) AS line_no, text, CAST(contains(lower(font), 'bold') AS BIGINT) AS bold, size, font FROM body JOIN fonts USING (doc_id, page_idx, row_no) WHERE text <> ''",
        "page_classes": f"{with_('text_lines', HEADINGS, TOC_PAGES)} SELECT {_B('doc_id', 'page_idx')}, fmt, CAST(is_toc AS BIGINT) AS is_toc FROM hp JOIN tp USING (doc_id, page_idx)",
        "headings": f"{_TOC} SELECT {heading} FROM headings",
        "unique_headings": f"{_TOC} SELECT {heading} FROM uniq",
        "level_summary": f"{_TOC} SELECT CAST(doc_id AS BIGINT) AS doc_id, 'H' || depth AS level, count(*) AS n FROM headings GROUP BY ALL",
        "outline": f"{_TOC} SELECT {_B('doc_id', 'pos')}, {_INDENT} || '[H' || depth || ']  ' || number || '. ' || text AS line FROM uniq",
        "section_boundaries": f"{_SECS} SELECT {_B('doc_id', 'seq')}, kind, number FROM events",
        "section_contents": f"{_SECS} SELECT {_B('doc_id', 'sec_pos', 'depth')}, 'H' || depth AS level, number, heading, content FROM secs",
        "section_previews": f"{_SECS} SELECT {_B('doc_id', 'sec_pos')}, {_INDENT} || '[H' || depth || ']  ' || number || '. ' || heading AS line, {_INDENT} || '  ' || CASE WHEN length(content) > 120 THEN substr(content, 1, 120) || '…' ELSE content END AS preview FROM secs",
        "list_items": f"{with_('content', LISTS)} SELECT {_B('doc_id', 'sec', 'list_no')}, CAST(generate_subscripts(items, 1) - 1 AS BIGINT) AS item_no, kind, topic, unnest(items) AS item FROM l3",
        "list_totals": f"{with_('content', LISTS)} SELECT CAST(c.doc_id AS BIGINT) AS doc_id, CAST(count(l.doc_id) AS BIGINT) AS n_lists, CAST(coalesce(sum(len(items)), 0) AS BIGINT) AS n_items FROM (SELECT DISTINCT doc_id FROM content) c LEFT JOIN l2 l USING (doc_id) GROUP BY ALL",
        "table_classes": f"{with_('grids', FLAGS)} SELECT {_B('k', 'artifact', 'checklist', 'legend', 'wrapped', 'skipped')}, CAST(NOT skipped AND wide AS BIGINT) AS kept FROM flags",
        "table_cells": f"{with_('grids')} SELECT CAST(k AS BIGINT) AS k, CAST(r AS BIGINT) AS row, CAST(generate_subscripts(cells, 1) - 1 AS BIGINT) AS col, unnest(cells) AS cell FROM (SELECT k, generate_subscripts(rows, 1) - 1 AS r, list_transform(unnest(rows), lambda c: {clean_cell('c')}) AS cells FROM grids) x",
        "table_captions": f"{with_('words placed', _captions('placed'))} SELECT {_B('doc_id', 'page_idx', 'table_idx')}, caption FROM caps",
        "page_sections": f"{with_('text_lines', HEADINGS, TOC_PAGES, PAGE_CAND, TRACK, PAGES, recursive=True)} SELECT {_B('doc_id', 'page_idx')}, number FROM page_map",
        "section_tables": f"{_FULL} SELECT {_B('doc_id', 'sec_pos')}, CAST(row_number() OVER (PARTITION BY doc_id, sec_pos ORDER BY page_idx, table_idx) - 1 AS BIGINT) AS table_no, number, caption, {_B('n_rows', 'n_cells')} FROM attached",
        "table_totals": f"{_FULL} SELECT CAST(s.doc_id AS BIGINT) AS doc_id, CAST(count(a.doc_id) AS BIGINT) AS n_tables FROM secs s LEFT JOIN attached a ON a.doc_id = s.doc_id AND a.sec_pos = s.sec_pos GROUP BY ALL",
        "dq_duplicates": f"{_TOC} SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(pos AS BIGINT) AS sec_pos, number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY pos) AS n FROM headings) x WHERE n > 1",
        "dq_order": f"{_TOC}, pl AS (SELECT doc_id, number, max(pos) AS pos FROM headings GROUP BY ALL), od AS (SELECT h.doc_id, h.pos AS sec_pos, h.number, pl.pos, lag(pl.pos) OVER (PARTITION BY h.doc_id ORDER BY h.pos) AS ahead FROM (SELECT * REPLACE (CASE WHEN doc_id % 5 = 0 THEN -pos ELSE pos END AS pos) FROM headings) h JOIN pl ON pl.doc_id = h.doc_id AND pl.number = h.number) SELECT {_B('doc_id', 'sec_pos', 'pos', 'ahead')}, number FROM od WHERE pos < ahead",
        "dq_leaders": f"{with_('entries', _ENTRY_SECS)} SELECT {_B('doc_id', 'sec_pos')}, number FROM es WHERE {has('heading', R.BODY_LEADER)} OR regexp_matches(coalesce(content, ''), '^{S}*(?:{re2(R.BODY_LEADER)})')",
        "dq_null_contents": f"{with_('entries', _ENTRY_SECS)} SELECT {_B('doc_id', 'sec_pos')}, number FROM es WHERE content IS NULL",
        "dq_not_in_contents": f"{with_('text_lines', HEADINGS, _ENTRY_SECS)} SELECT {_B('doc_id', 'sec_pos')}, number FROM es WHERE (doc_id, number) NOT IN (SELECT doc_id, number FROM headings)",
        "dq_phrases": f"{with_('entries', _ENTRY_SECS)} SELECT CAST(c.doc_id AS BIGINT) AS doc_id, section, phrase, CAST(contains(lower(coalesce(string_agg(coalesce(content, ''), ' ' ORDER BY sec_pos), '')), lower(phrase)) AS BIGINT) AS found FROM (SELECT DISTINCT doc_id, CAST(ch AS VARCHAR) AS section, lead AS phrase FROM entries WHERE lead <> '') c LEFT JOIN es ON es.doc_id = c.doc_id AND (es.number = section OR starts_with(es.number, section || '.')) GROUP BY c.doc_id, section, phrase",
        "dq_leaked_tables": f"{with_('grids', FLAGS)} SELECT CAST(k AS BIGINT) AS doc_id, CAST(0 AS BIGINT) AS sec_pos, CAST(1 AS BIGINT) AS n FROM flags WHERE checklist OR legend",
        "dq_list_phrases": f"{with_('content', LISTS)} SELECT {_B('doc_id', 'sec')}, CAST(bool_or(len(list_filter(items, lambda s: contains(lower(s), lower(heading)))) > 0) AS BIGINT) AS found FROM l2 GROUP BY doc_id, sec",
        "dq_table_phrases": f"{with_('grids')} SELECT CAST(k AS BIGINT) AS k, CAST(len(list_filter(flatten(rows), lambda c: contains(lower({clean_cell('c')}), 'диагноз'))) > 0 AS BIGINT) AS found FROM grids",
    }
