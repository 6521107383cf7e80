"""Queries on lines of pages, with their SQL twins."""

from __future__ import annotations



from quire import tables
from quire.operators import lines as L

from .sqlkit import PAGES, re2, splitlines, strip


def _scanned(s, d):
    return tables.pages(s, d).where("pdf_type = 'scanned'")


def line_class(s, d):
    return L.classify_lines(_scanned(s, d))


def strip_furniture(s, d):
    p = _scanned(s, d)
    return L.strip_lines(p, L.classify_lines(p))


def strip_keep_notes(s, d):
    p = _scanned(s, d)
    return L.strip_lines(p, L.classify_lines(p), keep=("footnote",))


def footer_report(s, d):
    return L.footer_report(L.classify_lines(_scanned(s, d)))


def footer_counts(s, d):
    return L.footer_counts(L.classify_lines(_scanned(s, d)))


def header_words(s, d):
    return L.header_words(tables.pages(s, d))


def header_lines(s, d):
    return L.pages_without_headers(tables.pages(s, d))


def page_boundaries(s, d):
    return L.boundaries(tables.pages(s, d))


def blank_header(s, d):
    p = tables.pages(s, d)
    return L.blank_header(p, L.pages_without_headers(p).select("book_id", "page_no", "header"))


_D = "٠-٩۰-۹0-9"
_BIDI = re2("[\\u200b-\\u200f\\u202a-\\u202e\\u061c\\ufeff]")
_C = lambda x: f"regexp_replace({x}, '{_BIDI}', '', 'g')"
_M = f"regexp_matches(c, '{L.MARKER}')"
_R = f"regexp_matches(c, '{L.REVERSED}')"
_NOTE = f"""CASE WHEN {_M} THEN 0.95 WHEN {_R} THEN 0.90 WHEN regexp_matches(c, '^[*†‡§¶#+\\-–—―]') THEN 0.85 WHEN regexp_matches(c, '^[ء-ي]\\)') THEN 0.70
  WHEN length(c) < 50 AND regexp_matches(c, 'انظر|راجع|هامش') THEN 0.60 END"""
_NUM = f"""CASE WHEN regexp_matches(s, '^([٠-٩]+|[۰-۹]+)$') THEN 0.95 WHEN regexp_matches(s, '^[0-9]+$') THEN 0.90 WHEN regexp_matches(s, '^[-–—\\s]*[{_D}]+[-–—\\s]*$') THEN 0.85
  WHEN regexp_matches(s, 'صفحة?\\s*[{_D}]+') THEN 0.90 END"""
_SEP = f"CASE WHEN regexp_matches(s, '^[-_*=—–]+$') THEN 0.90 WHEN regexp_matches(s, '^[-_*=—–\\s]*[{_D}]+[-_*=—–\\s]*$') THEN 0.75 END"
_HEAD = f"CASE WHEN s <> '' AND length(s) < 60 AND NOT regexp_matches(s, '[.،:؛]') AND regexp_matches(s, 'مقدمة|فصل|كتاب|ذكريات|مذكرات|مدكرات|[{_D}]') THEN 0.80 END"
_NUMS = " || ".join(f"list_transform(regexp_extract_all(line, '[{a}]{{1,3}}'), lambda nn: {{'t': 'page_number', 'p': CAST({b} AS DOUBLE), 'x': nn}})" for a, b in (("٠-٩", 0.85), ("۰-۹", 0.85), ("0-9", 0.80)))
_ROW = "{{'t': {0}, 'p': CAST({1} AS DOUBLE), 'x': {2}}}"

_CLASSES = f"""
pg AS (SELECT book_id, page_no, string_split(raw_text, chr(10)) AS ls FROM {PAGES} WHERE pdf_type = 'scanned' AND raw_text IS NOT NULL),
ln AS (SELECT book_id, page_no, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM pg),
l1 AS (SELECT *, {strip('line')} AS s, {strip(_C('line'))} AS c FROM ln),
l2 AS (SELECT l1.*, v.pending, s = '' AS blank, i < greatest(1, CAST(trunc(n * CAST(0.15 AS DOUBLE)) AS INTEGER)) AS in_top, i >= least(n - 1, CAST(trunc(n * CAST(0.85 AS DOUBLE)) AS INTEGER)) AS in_bottom,
  regexp_matches({_C('s')}, '{L.NEW_MARKER}') AS is_new FROM l1 CROSS JOIN (VALUES (false), (true)) AS v(pending)),
l3 AS (SELECT *, min(CASE WHEN pending AND in_bottom AND regexp_matches(c, '^=|^[-–—―][ \\t]') THEN i END) OVER (PARTITION BY book_id, page_no, pending) AS ca FROM l2),
l4 AS (SELECT *, min(CASE WHEN i > ca AND (blank OR is_new) THEN i END) OVER (PARTITION BY book_id, page_no, pending) AS cs FROM l3),
l5 AS (SELECT *, coalesce(i >= ca AND i <= ca + 14 AND (cs IS NULL OR i < cs), false) AS crs FROM l4),
l6 AS (SELECT *, CASE WHEN NOT blank AND NOT crs AND in_bottom THEN CASE WHEN {_NOTE} IS NOT NULL THEN 'footnote' WHEN {_NUM} IS NOT NULL THEN 'page_number' WHEN {_SEP} IS NOT NULL THEN 'separator' END END AS lt,
  coalesce({_NOTE}, {_NUM}, {_SEP}) AS lp, CASE WHEN NOT blank AND NOT crs AND in_top THEN {_HEAD} END AS high FROM l5),
l7 AS (SELECT *, NOT (crs OR lt IS NOT NULL OR high IS NOT NULL) AND NOT blank AND ({_M} OR {_R}) AS mid FROM l6),
l8 AS (SELECT *, crs OR lt IS NOT NULL OR high IS NOT NULL OR mid AS already, crs OR mid OR coalesce(lt = 'footnote', false) AS note FROM l7),
l9 AS (SELECT *, max(CASE WHEN note THEN i END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mk,
  max(CASE WHEN blank OR (NOT already AND (is_new OR (length(s) >= 120 AND suffix(s, '.')))) THEN i END) OVER (w ROWS UNBOUNDED PRECEDING) AS st
  FROM l8 WINDOW w AS (PARTITION BY book_id, page_no, pending ORDER BY i)),
l10 AS (SELECT *, coalesce(NOT already AND i - mk <= 14 AND (st IS NULL OR st <= mk), false) AS cont FROM l9),
l11 AS (SELECT *, (note OR cont) AND regexp_matches(CASE WHEN crs AND i = ca THEN c ELSE s END, '=$| [-–—―]$') AS goes_on FROM l10),
ps AS (SELECT book_id, page_no, bool_or(NOT pending AND goes_on) AS off, bool_or(pending AND goes_on) AS onn FROM l11 GROUP BY ALL),
pn AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_no) AS rn FROM ps),
ch AS (WITH RECURSIVE r AS (SELECT book_id, page_no, rn, false AS pending, off AS nxt FROM pn WHERE rn = 1
  UNION ALL SELECT p.book_id, p.page_no, p.rn, r.nxt, CASE WHEN r.nxt THEN p.onn ELSE p.off END FROM r JOIN pn p ON p.book_id = r.book_id AND p.rn = r.rn + 1) SELECT * FROM r),
cl AS (SELECT l.book_id, l.page_no, CAST(i AS INTEGER) AS line_no, unnest(
  CASE WHEN crs THEN [{_ROW.format("'footnote'", 'CASE WHEN i = ca THEN 0.80 ELSE 0.70 END', 'CASE WHEN i = ca THEN c ELSE s END')}] ELSE [] END
  || CASE WHEN lt IS NOT NULL THEN [{_ROW.format('lt', 'lp', 's')}] ELSE [] END
  || CASE WHEN high IS NOT NULL THEN [{_ROW.format("'running_header'", 'high', 's')}] || {_NUMS} ELSE [] END
  || CASE WHEN mid THEN [{_ROW.format("'footnote'", '0.88', 's')}] ELSE [] END || CASE WHEN cont THEN [{_ROW.format("'footnote'", '0.60', 's')}] ELSE [] END) AS r
  FROM l11 l JOIN ch ON l.book_id = ch.book_id AND l.page_no = ch.page_no AND l.pending = ch.pending),
cls AS (SELECT book_id, page_no, line_no, r.t AS footer_type, r.p AS confidence, r.x AS text FROM cl)"""


def _stripped(where: str) -> str:
    return f"""WITH {_CLASSES},
gone AS (SELECT book_id, page_no, list(DISTINCT line_no) AS g FROM cls WHERE {where} GROUP BY ALL)
SELECT book_id, page_no, coalesce(array_to_string(list_filter(ls, lambda x, k: NOT list_contains(coalesce(g, []), CAST(k - 1 AS INTEGER))), chr(10)), '') AS text, CAST(coalesce(len(g), 0) AS INTEGER) AS n_stripped
FROM pg LEFT JOIN gone USING (book_id, page_no)"""


_FIRST = f"SELECT book_id, page_no, list_filter(list_transform(string_split(raw_text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')[1] AS s FROM {PAGES} WHERE raw_text IS NOT NULL"
_HW = f"""fl AS ({_FIRST}), wd AS (SELECT book_id, page_no, s, unnest(regexp_extract_all(s, '[\\x{{0600}}-\\x{{06FF}}]+')) AS word FROM fl WHERE length(s) <= 60),
hw AS (SELECT book_id, word, count(DISTINCT page_no) AS n_pages FROM wd GROUP BY ALL HAVING count(DISTINCT page_no) >= 2)"""
_HL = f"""{_HW}, kn AS (SELECT book_id, page_no, count(*) AS known FROM wd SEMI JOIN hw USING (book_id, word) GROUP BY ALL),
al AS (SELECT book_id, page_no, s AS header, count(*) AS n_words FROM wd GROUP BY ALL), hl AS (SELECT book_id, page_no, header, n_words FROM al JOIN kn USING (book_id, page_no) WHERE known = n_words)"""

ORACLE = {
    "line_class": f"WITH {_CLASSES} SELECT * FROM cls",
    "strip_furniture": _stripped("true"),
    "strip_keep_notes": _stripped("footer_type <> 'footnote'"),
    "footer_report": f"WITH {_CLASSES} SELECT book_id, page_no, line_no, printf('  [%s] (conf: %.2f) STRIPPED: %s', footer_type, confidence, text[:60]) AS entry FROM cls",
    "footer_counts": f"""WITH {_CLASSES} SELECT book_id, count(*) FILTER (footer_type = 'footnote') AS footnote, count(*) FILTER (footer_type = 'page_number') AS page_number,
  count(*) FILTER (footer_type = 'separator') AS separator, count(*) FILTER (footer_type = 'running_header') AS running_header, count(DISTINCT page_no) AS n_pages FROM cls GROUP BY book_id""",
    "header_words": f"WITH {_HW} SELECT book_id, word, n_pages FROM hw",
    "header_lines": f"WITH {_HL} SELECT * FROM hl",
    "page_boundaries": f"""
WITH p AS (SELECT book_id, page_no, list_filter({splitlines('raw_text')}, lambda x: {strip('x')} <> '') AS ls FROM {PAGES} WHERE pdf_type = 'scanned' AND {strip('raw_text')} <> ''),
q AS (SELECT book_id, page_no, array_to_string(ls[-2:], chr(10)) AS tail, lead(page_no) OVER w AS next_page, lead(array_to_string(ls[:3], chr(10))) OVER w AS head FROM p WINDOW w AS (PARTITION BY book_id ORDER BY page_no))
SELECT * FROM q WHERE next_page IS NOT NULL""",
    "blank_header": f"""WITH {_HL}, ll AS (SELECT book_id, page_no, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT book_id, page_no, string_split(raw_text, chr(10)) AS ls FROM {PAGES} WHERE raw_text IS NOT NULL)),
ht AS (SELECT l.book_id, l.page_no, i, line FROM (SELECT *, {strip('line')} AS s FROM ll) l JOIN hl USING (book_id, page_no) WHERE s <> '' AND (contains(s, header) OR contains(header, s)))
SELECT book_id, page_no, CAST(min(i) AS INTEGER) AS line_no, arg_min(line, i) AS line FROM ht GROUP BY ALL""",
}
QUERIES = {k: globals()[k] for k in ORACLE}
