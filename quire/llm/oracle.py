"""SQL twins (DuckDB) of the pN_ queries that SQL can express on whole tables."""

from __future__ import annotations

_MARKS = "[\\x{0610}-\\x{061A}\\x{0640}\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06DC}\\x{06DF}-\\x{06E8}\\x{06EA}-\\x{06ED}]"

_P1 = """
WITH src AS (SELECT book_id, arg_min(source_path, ingested_at) AS source FROM book WHERE book_id IS NOT NULL GROUP BY book_id),
pages AS (SELECT DISTINCT book_id, page_no, raw_text FROM page WHERE raw_text IS NOT NULL),
lines AS (SELECT book_id, page_no, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS line_no FROM pages),
keyed AS (SELECT book_id, page_no, CAST(line_no AS INTEGER) AS line_no, source, regexp_replace(lower(line), '[^\\p{L}]', '', 'g') AS k
          FROM lines JOIN src USING (book_id) WHERE source IS NOT NULL),
long AS (SELECT * FROM keyed WHERE length(k) >= 20),
often AS (SELECT source, k FROM long GROUP BY source, k HAVING count(DISTINCT book_id) >= 3)
SELECT DISTINCT book_id, page_no, line_no FROM long JOIN often USING (source, k)"""

_P3 = """
SELECT DISTINCT book_id, chunk_id FROM chunk
WHERE text IS NOT NULL AND trunc(len(regexp_extract_all(text, '[^\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+')) * CAST(1.4 AS DOUBLE)) > 1500"""

_P7 = """
WITH once AS (SELECT plan_id, shot_no, arg_min(struct_pack(s := start, v := visual, t := typography_text), created_at) AS r FROM shot GROUP BY plan_id, shot_no),
k AS (SELECT plan_id, shot_no, r.s AS s, lower(trim(r.v)) AS v,
        regexp_replace(regexp_replace(lower(coalesce(r.t, '')), '\\x{0640}', '', 'g'), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM once WHERE r.s IS NOT NULL),
l AS (SELECT *, lag(v) OVER w AS pv, lag(t) OVER w AS pt FROM k WINDOW w AS (PARTITION BY plan_id ORDER BY s, shot_no)),
f AS (SELECT *, CASE WHEN v = pv AND (t = pt OR (length(t) >= 12 AND length(pt) >= 12
        AND regexp_replace(t, '[^\\p{Nd}]', '', 'g') = regexp_replace(pt, '[^\\p{Nd}]', '', 'g')
        AND abs(length(t) - length(pt)) <= 1
        AND (CASE WHEN t = pt THEN true
              WHEN length(t) = length(pt) THEN len(list_filter(range(1, length(t) + 1), lambda i: substring(t, i, 1) <> substring(pt, i, 1))) = 1
              WHEN length(t) > length(pt) THEN len(list_filter(range(1, length(t) + 1), lambda i: substring(t, 1, i - 1) || substring(t, i + 1) = pt)) > 0
              ELSE len(list_filter(range(1, length(pt) + 1), lambda i: substring(pt, 1, i - 1) || substring(pt, i + 1) = t)) > 0 END))) THEN 0 ELSE 1 END AS cut FROM l),
g AS (SELECT *, sum(cut) OVER (PARTITION BY plan_id ORDER BY s, shot_no ROWS UNBOUNDED PRECEDING) AS grp FROM f)
SELECT plan_id, arg_min(shot_no, struct_pack(s := s, n := shot_no)) AS first_shot_no, arg_max(shot_no, struct_pack(s := s, n := shot_no)) AS last_shot_no
FROM g GROUP BY plan_id, grp HAVING count(*) >= 2"""

_WORDS = f"string_split(trim(regexp_replace(regexp_replace(lower(text), '{_MARKS}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
_P9 = f"""
WITH d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, hash(w[s : s + 11]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS s FROM d WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT item_id, hash(w[s : s + 11]) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS s FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""




def _class_of(chars) -> str:
    return "[" + "".join(f"\\x{{{ord(c):04x}}}" for c in sorted(set(chars))) + "]"


def _misread(byte: int, page: str) -> str:
    try:
        return bytes([byte]).decode(page)
    except UnicodeDecodeError:
        return chr(byte)


def _sequences() -> str:
    """What the letters and signs of Arabic and French become when their UTF-8 is read under another code page: told from the
    code pages themselves, by the first character the ones that may follow."""
    meant = [*map(chr, (*range(0x60C, 0x60D), 0x61B, 0x61F, *range(0x621, 0x63B), *range(0x640, 0x653), *range(0x660, 0x66A), *range(0xA0, 0x180), 0x152, 0x153, 0x178)), *"–—‘’“”…‚„†‡•€™ƒˆ˜‹›ŒœŠšŽžΑΒΓΔΕΚΛΟΣΤΩαβγδεικλνοπρστςόАБВГДЕКМНОПРСТУабвгдеиклмнорст"]
    out: dict[str, set[str]] = {}
    for c in meant:
        raw = c.encode()
        for page in ("cp1252", "latin-1", "cp1256", "mac_roman", "cp437", "cp850"):
            seen = [_misread(x, page) for x in raw]
            # under the Arabic page letters may follow each other, and signs that stand after a word or inside a misread one
            if page != "cp1256" or not (seen[1].isalpha() or seen[1] in "،؟«»¬£\u200c\u200d\xa0"):
                out.setdefault(seen[0], set()).add(seen[1])
    return "|".join(f"\\x{{{ord(k):04x}}}{_class_of(v)}" for k, v in sorted(out.items()))


_GARBLED = "regexp_matches(coalesce(raw_text, ''), '" + "|".join((
    "\\x{FFFD}", "[\\x{80}-\\x{9f}]", "ï»¿", _sequences(),
    "(?:^|[^A-Za-zÀ-ÿ])[À-ÿ][À-ÿ¡¿]+(?:[^A-Za-z]|$)",  # letters of another alphabet as accented ones
    "[A-Za-zÀ-ÿ]\\?[a-zà-ÿ]", "[A-Za-z][‚ƒ„†‡ˆ‰Š‹Œ•˜™š›žŸ…][a-z]", "(?:^|[^\\p{L}\\p{N}])[‚ƒˆŠ][a-z]", "[a-z][‚ƒˆŠ](?:[^\\p{L}\\p{N}]|$)",
)) + "')"
_P4 = f"SELECT DISTINCT book_id, page_no FROM page WHERE {_GARBLED}"
_UNSEEN = "\\x{061C}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{FEFF}"
_BETWEEN = f"[\\x{{0300}}-\\x{{036F}}]*[{_UNSEEN}]*"
_LATIN, _OTHER = "\\p{Latin}", "[\\p{Greek}\\p{Cyrillic}]"
# full-width, unseen, other spaces, presentation forms, letter forms of Persian and Urdu, letters side by side
_ODD = "|".join((
    "[\\x{FF01}-\\x{FF5E}\\x{FFE0}-\\x{FFE6}]", f"[{_UNSEEN}]", "[\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]", "[\\x{FB00}-\\x{FDFF}\\x{FE70}-\\x{FEFC}]",
    "[کڪیېےھہەۀۃ]", _LATIN + _BETWEEN + _OTHER, _OTHER + _BETWEEN + _LATIN,
))


def _variant(column: str) -> str:
    return f"(regexp_matches({column}, '{_ODD}') OR nfc_normalize({column}) <> {column})"


_P6 = f"""
SELECT DISTINCT 'page' AS record_type, book_id, page_no AS item_no FROM page WHERE raw_text IS NOT NULL AND {_variant('raw_text')} AND NOT ({_GARBLED})
UNION ALL SELECT DISTINCT 'chunk', book_id, chunk_id FROM chunk WHERE text IS NOT NULL AND {_variant('text')}"""

_SPACE = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
# A letter's closing line is short and begins as those of other letters do, or gives a year.
_P10 = f"""
WITH t AS (SELECT DISTINCT doc_id, kind, regexp_replace(text, '{_SPACE}+$', '') AS t FROM documents WHERE text IS NOT NULL),
l AS (SELECT *, trim(string_split(t, chr(10))[-1]) AS last FROM t WHERE t <> ''),
e AS (SELECT *, regexp_matches(t, '(\\.\\.\\.|…|\\x{{FFFD}})( ?\\])?$') AS mark, regexp_matches(t, '[.!?؟][^\\p{{L}}\\p{{N}}.!?؟,،;؛:]*$') AS ended, string_split_regex(last, '\\s+') AS w FROM l),
c AS (SELECT w[1] AS first FROM e WHERE kind = 'letter' AND NOT ended AND NOT mark AND len(w) <= 5 GROUP BY w[1] HAVING count(*) >= 2)
SELECT doc_id FROM e WHERE mark OR NOT (ended OR coalesce(kind IN ('heading', 'caption'), false)
  OR coalesce(kind = 'letter' AND (regexp_matches(last, '^\\p{{Nd}}+$') OR (len(w) <= 5 AND w[1] IN (SELECT first FROM c))), false))"""


# Twelve-word sequences that follow each other in both texts are one passage.
_PASSAGES = f"""
d AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, s - 1 AS a, hash(w[s : s + 11]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS s FROM d WHERE len(w) >= 12)),
ig AS (SELECT item_id, s - 1 AS b, hash(w[s : s + 11]) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS s FROM i WHERE len(w) >= 12)),
m AS (SELECT DISTINCT doc_id, item_id, a, b FROM dg JOIN ig USING (g)),
r AS (SELECT *, a - row_number() OVER (PARTITION BY doc_id, item_id, a - b ORDER BY a) AS run FROM m),
p AS (SELECT doc_id, item_id, count(*) + 11 AS n, min(a) AS a, min(b) AS b FROM r GROUP BY doc_id, item_id, a - b, run),
best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, a, b) = 1)"""
_P9_PASSAGES = f"WITH {_PASSAGES} SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_words, CAST(a AS INTEGER) AS doc_word, CAST(b AS INTEGER) AS item_word FROM best"
_P9_ITEMS = f"WITH {_PASSAGES} SELECT item_id, count(*) AS n_documents, CAST(max(n) AS INTEGER) AS longest FROM best GROUP BY item_id"
_P10_RATES = f"""
WITH cut AS ({_P10}), c AS (SELECT DISTINCT source, doc_id, length(text) AS n FROM documents JOIN cut USING (doc_id)),
l AS (SELECT source, n, count(*) AS k FROM c GROUP BY source, n), u AS (SELECT source, sum(k) AS n_cut, arg_min(n, struct_pack(k := -k, n := n)) AS usual_length FROM l GROUP BY source),
t AS (SELECT source, count(DISTINCT doc_id) AS n_texts FROM documents WHERE regexp_replace(text, '{_SPACE}+', '', 'g') <> '' GROUP BY source)
SELECT t.source, n_texts, CAST(coalesce(n_cut, 0) AS BIGINT) AS n_cut, round(coalesce(n_cut, 0) / n_texts, 6) AS share, usual_length FROM t LEFT JOIN u ON t.source IS NOT DISTINCT FROM u.source"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p3_found": _P3, "p4_found": _P4, "p6_found": _P6, "p7_found": _P7, "p9_found": _P9, "p9_passages": _P9_PASSAGES, "p9_items": _P9_ITEMS, "p10_found": _P10, "p10_rates": _P10_RATES}
