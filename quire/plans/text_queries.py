"""Queries on the text functions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import tables
from quire.functions import arabic as A
from quire.functions import text as T
from quire.session import table as t

from .sqlkit import CHUNKS, PAGES, SHOTS, WS, n_words, re2, rstrip, splitlines, strip, token_est, values, words

# ------------------------------------------------------------------------------------------------- queries


def arabic_decomposed(s, d):
    rows = ("ح\ufbb3مل", "\ufbb2\u06a1يل", "\u066e\ufbb5ت", "\ufbb4\u066eل\u06a1", "\ufbb2ع\ufbb6ا", "plain", "\u066eا\u06a1ل")
    cases = s.createDataFrame([(x,) for x in rows], "text string")
    pages = tables.pages(s, d).where("raw_text IS NOT NULL").select(F.col("raw_text").alias("text"))
    return cases.unionAll(pages).select("text", A.fix_decomposed(F.col("text")).alias("fixed"), T.is_decomposed(F.col("text")).alias("decomposed"))


ARTICLE_CASES = ("أل", "إلى", "ألي", "ألدوات", "امل", "اآلن", "ال", "واإلعالمية", "كامل", "وبالأسباب", "فوكامل", "ا", "", "االجندي", "إليها", "سامل", "وامل", "واال")


def fix_article(s, d):
    cases = s.createDataFrame([(x,) for x in ARTICLE_CASES], "word string")
    ws = t(s, d, "chunk").where("text IS NOT NULL").select(F.explode(F.split("text", r"[ \n]")).alias("word")).distinct()
    w = F.col("word")
    return cases.unionAll(ws).distinct().select("word", A.fix_article(w).alias("fixed"), A.double_alef(A.fix_article(w)).alias("final"))


def normalise_digital(s, d):
    p = tables.pages(s, d).where("pdf_type = 'digital' AND raw_text IS NOT NULL")
    return p.select("book_id", "page_no", A.normalise_digital(F.col("raw_text")).alias("text"))


def normalise_scanned(s, d):
    p = tables.pages(s, d).where("pdf_type = 'scanned' AND raw_text IS NOT NULL")
    return p.select("book_id", "page_no", A.normalise_scanned(F.col("raw_text")).alias("text"))


def paragraphs(s, d):
    p = tables.pages(s, d).where("raw_text IS NOT NULL").select("book_id", "page_no", F.posexplode(T.paragraphs(T.splitlines(F.col("raw_text")), 60)))
    return p.select("book_id", "page_no", (F.col("pos") + 1).alias("para_no"), F.col("col").alias("text"), T.n_words(F.col("col")).alias("n_words"))


def paragraphs_documents(s, d):
    p = t(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(T.paragraphs(T.splitlines(F.col("text")))))
    return p.select("doc_id", (F.col("pos") + 1).alias("para_no"), F.col("col").alias("text"))


def token_estimates(s, d):
    c, n = F.col("text"), F.col("n_words")
    return (
        tables.chunks(s, d).where("text IS NOT NULL").withColumn("n_words", T.n_words(c))
        .select("book_id", "chunk_id", "n_words", T.token_est(n).alias("token_est"), F.size(T.tokens(c)).alias("n_tokens"), (n < 8).alias("is_stub"),
                T.bare_arabic(c).alias("bare"), F.round(T.arabic_ratio(c), 6).alias("arabic_ratio"))
    )


def compatible_forms(s, d):
    """Pages in compatibility-composed form, as extracted spans are read."""
    return tables.pages(s, d).where("raw_text IS NOT NULL").select("book_id", "page_no", A.nfkc(F.col("raw_text")).alias("text"))


def reading_order(s, d):
    """Pages whose Arabic is stored in visual order, put into reading order."""
    return tables.pages(s, d).where("raw_text IS NOT NULL").select("book_id", "page_no", A.visual_lam_alef(F.col("raw_text")).alias("text"))


def font_routing(s, d):
    c = F.col("raw_text")
    return (
        tables.pages(s, d).where("raw_text IS NOT NULL")
        .select("book_id", "page_no", F.round(T.latin1_ratio(c), 6).alias("latin1_ratio"), T.is_corrupted_font(c).alias("corrupted"), T.is_decomposed(c).alias("decomposed"),
                F.when(F.length(T.strip(c)) < 100, "scanned").when(T.is_corrupted_font(c) | T.is_decomposed(c), "scanned").otherwise("digital").alias("route"))
    )


def ocr_garbage(s, d):
    lines = F.split("raw_text", "\n")
    kept = F.filter(lines, T.is_ocr_text)
    return tables.pages(s, d).where("raw_text IS NOT NULL").select("book_id", "page_no", F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("n_dropped"))


def bidi_strip(s, d):
    c = F.col("raw_text")
    return tables.pages(s, d).where("raw_text IS NOT NULL").select("book_id", "page_no", T.strip_bidi(c).alias("text"), (F.length(c) - F.length(T.strip_bidi(c))).alias("n_marks"))


def inline_numbers(s, d):
    line = F.get(F.split("raw_text", "\n"), F.lit(0))
    rows = tables.pages(s, d).where("raw_text IS NOT NULL").select("book_id", "page_no", F.posexplode(T.inline_numbers(line)))
    return rows.select("book_id", "page_no", F.col("pos").alias("ord"), "col.number", "col.confidence")


def captions(s, d):
    rows = t(s, d, "documents").where("kind = 'script' AND text IS NOT NULL").select("doc_id", F.posexplode(T.captions(F.col("text"))))
    return rows.select("doc_id", F.col("pos").alias("ord"), F.col("col").alias("caption"))


def sentence_chunks(s, d):
    rows = t(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(T.sentence_chunks(F.col("text"), 300)))
    return rows.select("doc_id", F.col("pos").alias("ord"), F.col("col").alias("piece"))


def script_clean(s, d):
    return t(s, d, "documents").where("kind IN ('script', 'brief') AND text IS NOT NULL").select("doc_id", T.clean_script(F.concat(F.lit("# نص\n--\n"), "text")).alias("script"))


def wrapped_lines(s, d):
    rows = tables.shots(s, d).where("typography_text IS NOT NULL").select("plan_id", "shot_no", F.posexplode(T.wrap(F.col("typography_text"), 24)))
    return rows.select("plan_id", "shot_no", F.col("pos").alias("line_no"), F.col("col").alias("line"))


def excerpts(s, d):
    x = tables.shots(s, d)
    return x.select("plan_id", "shot_no", T.excerpt(F.col("typography_text"), F.col("caption_text")).alias("excerpt"), T.ass_escape(F.col("caption_text")).alias("escaped"), T.ass_time(F.col("start")).alias("at"))


def query_keys(s, d):
    q = T.strip(F.col("search_query"))
    return tables.shots(s, d).where(q != "").select(q.alias("query")).distinct().select("query", T.query_hash(F.col("query")).alias("query_hash"), (T.n_words(F.col("query")) <= 2).alias("bare"), F.md5("query").alias("md5"))


def file_names(s, d):
    x = t(s, d, "book").select("book_id", "source_path", F.col("metadata")["title"].alias("title")).distinct()
    base = F.regexp_extract("source_path", r"([^/]*)$", 1)
    return x.select("book_id", "source_path", "title", T.file_stem(F.col("title")).alias("stem"), F.concat(F.regexp_replace(base, r"\.[^.]*$", ""), F.lit("_phase1.json")).alias("json_name"))


URLS = ("http://x.org/a/B.JPEG?w=1", "http://x.org/p.png", "https://x.org/a.webp#f", "http://x.org/none", "", "http://x.org/a.tif", "http://x.org/a.tiff?x=.png", "http://x.org/a.jpg/")


def ext_from_url(s, d):
    return s.createDataFrame([(x,) for x in URLS], "url string").select("url", T.ext_from_url(F.col("url")).alias("ext"))


LICENSES = (
    "CC-BY-4.0", "CC BY-NC 2.0", "PD", "", None, "No known restrictions", "All rights reserved", "Attribution and share", "Attribution", "cc0 1.0", " Public Domain ", "GFDL",
    "cc-by-nd", "Attribution only", "no restrictions", "Commons", "no deriv", "CC BY 2.0",
)


def license_filter(s, d):
    c = F.col("license")
    return s.createDataFrame([(x,) for x in LICENSES], "license string").select(
        "license", T.is_free_license(c).alias("free"), T.is_free_license_v1(c).alias("free_v1"), T.is_free_license_words(c).alias("free_words")
    )


ANSWERS = ('```json\n{"a": 1}\n```', 'Sure: {"a": 2, "b": "x"} ok', "none", '{"a": 3} and {"a": 4}', "```\n{\"b\": \"y\"}\n```", "{broken", "")


def lenient_json(s, d):
    c = F.col("answer")
    obj = T.json_object(c, greedy=False)
    parsed = F.from_json(obj, "a int, b string")
    return s.createDataFrame([(x,) for x in ANSWERS], "answer string").select("answer", obj.alias("object"), F.coalesce(parsed["a"], F.lit(5)).alias("a"), F.coalesce(parsed["b"], F.lit("")).alias("b"))


# --------------------------------------------------------------------------------------------------- SQL

_MARKS = re2(r"[\u064b-\u0652\u0670\u0640،.؟!:؛\"'`]")


def _decomposed(x: str) -> str:
    sql = x
    for a, b in A.PAIRS:
        sql = f"replace({sql}, '{a}', '{b}')"
    return f"regexp_replace(replace(replace({sql}, '\u06a1', 'ف'), '\u066e', 'ب'), '[\\x{{FBB2}}-\\x{{FBB6}}]', '', 'g')"


def _article(x: str) -> str:
    for a, b in A.ARTICLE_RULES:
        x = f"regexp_replace({x}, '{a}', '{b}')"
    return x


def _clean(x: str) -> str:
    x = f"regexp_replace({x}, '(?m)^{WS}*\\p{{Nd}}+{WS}*$', '', 'g')"
    x = f"regexp_replace({x}, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t]{{3,}}', '  ', 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"
    x = f"regexp_replace({x}, '{WS}+\\.({WS}|$)', '.\\1', 'g')"
    return f"regexp_replace({x}, '([\\x{{064B}}-\\x{{064D}}]){WS}+([اى])', '\\1\\2', 'g')"


def _fold_paragraphs(lines: str, cap: int) -> str:
    last = "acc[-1]"
    # an element is a list of one line; the accumulator is the list of paragraphs, its last one still open
    return f"""list_filter(list_reduce(list_transform({lines}, lambda ln: [{strip('ln')}]), lambda acc, x: CASE
      WHEN x[1] = '' AND {last} = '' THEN acc WHEN x[1] = '' THEN acc || ['']
      WHEN {last} = '' THEN acc[:-2] || x
      WHEN regexp_matches({last}, '[.؟!]{WS}*$') OR {n_words(last)} >= {cap} THEN acc || x
      ELSE acc[:-2] || [{last} || ' ' || x[1]] END, ['']), lambda pp: pp <> '')"""


_VARIANTS = lambda x: f"translate({x}, '\u06be\u06cc', 'هي')"


def _normal(x: str, digital: bool) -> str:
    if digital:
        x = f"regexp_replace({x}, '([\\x{{0600}}-\\x{{06FF}}\\x{{FBB2}}-\\x{{FBB6}}]) +([\\x{{066E}}\\x{{06A1}}])', '\\1\\2', 'g')"
    else:
        x = f"array_to_string({_fold_paragraphs(splitlines(x), 250)}, chr(10) || chr(10))"
        x = f"regexp_replace({x}, '([\\x{{0600}}-\\x{{06FF}}])»({WS})', '\\1،\\2', 'g')"
    return _VARIANTS(f"nfc_normalize({_decomposed(x)})")


def _captions(x: str) -> str:
    flat = f"regexp_replace({strip(x)}, '{WS}+', ' ', 'g')"
    sent = f"list_filter(string_split(regexp_replace({flat}, '([.؟!]) ', '\\1' || chr(1), 'g'), chr(1)), lambda se: se <> '')"
    blocks = f"flatten(list_transform({sent}, lambda se: list_transform(range(0, CAST(ceil(len(string_split(se, ' ')) / 10.0) AS BIGINT)), lambda bi: array_to_string(string_split(se, ' ')[bi * 10 + 1 : bi * 10 + 10], ' '))))"
    merged = f"""list_reduce(list_transform({blocks}, lambda bl: [bl]), lambda acc, b: CASE
      WHEN len(string_split(b[1], ' ')) < 4 AND len(string_split(acc[-1], ' ')) + len(string_split(b[1], ' ')) <= 10 THEN acc[:-2] || [acc[-1] || ' ' || b[1]] ELSE acc || b END)"""
    return f"(CASE WHEN len({blocks}) > 0 THEN {merged} ELSE [{flat}] END)"


def _sentence_chunks(x: str, most: int) -> str:
    sent = f"string_split(regexp_replace({x}, '([.؟!]){WS}+', '\\1' || chr(1), 'g'), chr(1))"
    fold = f"""list_reduce(list_transform({sent}, lambda se: [se]), lambda acc, b: CASE
      WHEN length(acc[-1]) + length(b[1]) > {most} AND acc[-1] <> '' THEN acc || b WHEN length(acc[-1]) + length(b[1]) > {most} THEN acc[:-2] || b
      ELSE acc[:-2] || [acc[-1] || ' ' || b[1]] END, [''])"""
    out = f"list_filter(list_transform({fold}, lambda pc: {strip('pc')}), lambda pc: pc <> '')"
    return f"(CASE WHEN len({out}) > 0 THEN {out} ELSE [{x}] END)"


def _ratio(num: str, seen: str) -> str:
    return f"(CASE WHEN {seen} > 0 THEN CAST({num} AS DOUBLE) / {seen} END)"


_LATIN1 = "coalesce(" + _ratio("length(regexp_replace(raw_text, '[^\\x{0080}-\\x{00FF}]', '', 'g'))", "length(regexp_replace(raw_text, '[\\x{00}-\\x{20}]', '', 'g'))") + ", 0.0)"
_IS_DEC = "regexp_matches({0}, '[\\x{{FBB2}}-\\x{{FBB6}}\\x{{066E}}\\x{{06A1}}]')"
_AR = lambda x: _ratio(f"length(regexp_replace({x}, '[^\\x{{0600}}-\\x{{06FF}}]', '', 'g'))", f"length(regexp_replace({x}, '[ \\t\\n]', '', 'g'))")
_BIDI = re2("[\\u200b-\\u200f\\u202a-\\u202e\\u061c\\ufeff]")


def _exploded(src: str, keys: str, arr: str, cols: str, where: str = "raw_text IS NOT NULL") -> str:
    return f"SELECT {cols} FROM (SELECT {keys}, unnest(a) AS col, generate_subscripts(a, 1) AS pos FROM (SELECT {keys}, {arr} AS a FROM {src} WHERE {where}))"


_LOW = "lower(" + strip("coalesce(license, '')") + ")"


def _clean_script() -> str:
    text = "'# نص' || chr(10) || '--' || chr(10) || text"
    end = lambda x: "regexp_replace(regexp_replace(regexp_replace(" + rstrip(x) + f", '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}]+$', ''), '\\.+$', ''), '{WS}+$', '') || '\u0652.'"
    return f"""
WITH l AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, {splitlines(f'({text})')} AS ls FROM documents WHERE kind IN ('script', 'brief') AND text IS NOT NULL)),
k AS (SELECT doc_id, i, {rstrip('raw')} AS s FROM l),
m AS (SELECT *, CASE WHEN regexp_matches(s, '^#{{1,3}}') THEN 'heading' WHEN regexp_matches(s, '^-{{2,}}$') THEN 'rule' ELSE 'body' END AS kind,
        CASE WHEN regexp_matches(s, '^#{{1,3}}') THEN {rstrip(f"regexp_replace(s, '^#{{1,3}}{WS}*', '')")} ELSE s END AS content FROM k),
b AS (SELECT *, lag(kind) OVER w AS pk, lag(content) OVER w AS pc FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
o AS (SELECT doc_id, i, CASE WHEN kind = 'heading' THEN {end('content')}
        WHEN (pk IS NULL OR pk = 'rule' OR (pk = 'body' AND pc = '')) AND length(content) BETWEEN 4 AND 60 AND NOT regexp_matches(content, '[.،؛؟!]')
          AND regexp_matches(content, '[\\x{{0600}}-\\x{{06FF}}]') THEN {end('content')} ELSE content END AS line
      FROM b WHERE kind <> 'rule' AND NOT (kind = 'heading' AND content = ''))
SELECT doc_id, {strip("regexp_replace(string_agg(line, chr(10) ORDER BY i), '\\n{3,}', chr(10) || chr(10), 'g')")} AS script FROM o GROUP BY doc_id"""


def _wrap(x: str, width: int) -> str:
    ws = words(x)
    return f"""(CASE WHEN len({ws}) = 0 THEN [] ELSE list_reduce(list_transform({ws}, lambda wd: [wd]), lambda acc, b: CASE
      WHEN length(acc[-1]) + 1 + length(b[1]) <= {width} THEN acc[:-2] || [acc[-1] || ' ' || b[1]] ELSE acc || b END) END)"""


def _excerpt() -> str:
    e = f"coalesce(nullif({strip('typography_text')}, ''), {strip('caption_text')}, '')"
    return f"CASE WHEN length({e}) > 120 THEN {e}[:117] || '…' ELSE {e} END"


_CS = "least(99, CAST(round_even((greatest(0.0, start) - floor(greatest(0.0, start))) * 100, 0) AS INTEGER))"
_SEC = "CAST(floor(greatest(0.0, start)) AS BIGINT)"
_NUM = "list_transform(regexp_extract_all(ln, '[{0}]{{1,3}}'), lambda nn: {{'number': nn, 'confidence': CAST({1} AS DOUBLE)}})"
_CASES = [(x,) for x in ("ح\ufbb3مل", "\ufbb2\u06a1يل", "\u066e\ufbb5ت", "\ufbb4\u066eل\u06a1", "\ufbb2ع\ufbb6ا", "plain", "\u066eا\u06a1ل")]


ORACLE = {
    "arabic_decomposed": f"""SELECT text, {_decomposed('text')} AS fixed, {_IS_DEC.format('text')} AS decomposed
FROM (SELECT text FROM {values(_CASES, 'text')} UNION ALL SELECT raw_text FROM {PAGES} WHERE raw_text IS NOT NULL)""",
    "fix_article": f"""
WITH w AS (SELECT word FROM {values([(x,) for x in ARTICLE_CASES], 'word')} UNION SELECT unnest(string_split_regex(text, '[ \\n]')) FROM chunk WHERE text IS NOT NULL),
f AS (SELECT word, {_article('word')} AS fixed FROM w)
SELECT word, fixed, replace(fixed, 'اال', 'الا') AS final FROM f""",
    "normalise_digital": f"""
WITH p AS (SELECT book_id, page_no, raw_text, {_normal('raw_text', True)} AS x FROM {PAGES} WHERE pdf_type = 'digital' AND raw_text IS NOT NULL),
w AS (SELECT book_id, page_no, raw_text, unnest(string_split(x, ' ')) AS word, generate_subscripts(string_split(x, ' '), 1) AS i FROM p),
v AS (SELECT DISTINCT word FROM w), f AS (SELECT word, replace({_article('word')}, 'اال', 'الا') AS f FROM v),
j AS (SELECT book_id, page_no, raw_text, string_agg(f, ' ' ORDER BY i) AS x FROM w JOIN f USING (word) GROUP BY ALL)
SELECT book_id, page_no, CASE WHEN {strip('raw_text')} = '' THEN '' ELSE {strip(_clean('x'))} END AS text FROM j""",
    "normalise_scanned": f"""
WITH p AS (SELECT book_id, page_no, raw_text, {_normal('raw_text', False)} AS x FROM {PAGES} WHERE pdf_type = 'scanned' AND raw_text IS NOT NULL)
SELECT book_id, page_no, CASE WHEN {strip('raw_text')} = '' THEN '' ELSE {strip(_clean('x'))} END AS text FROM p""",
    "paragraphs": _exploded(PAGES, "book_id, page_no", _fold_paragraphs(splitlines("raw_text"), 60), f"book_id, page_no, CAST(pos AS INTEGER) AS para_no, col AS text, {n_words('col')} AS n_words"),
    "paragraphs_documents": _exploded("documents", "doc_id", _fold_paragraphs(splitlines("text"), 250), "doc_id, CAST(pos AS INTEGER) AS para_no, col AS text", "text IS NOT NULL"),
    "token_estimates": f"""SELECT book_id, chunk_id, {n_words('text')} AS n_words, {token_est(n_words('text'))} AS token_est,
  CAST(len(regexp_extract_all(text, '{re2(T.TOKEN)}')) AS INTEGER) AS n_tokens, {n_words('text')} < 8 AS is_stub,
  {strip(f"regexp_replace(text, '{_MARKS}', '', 'g')")} AS bare, round({_AR('text')}, 6) AS arabic_ratio FROM {CHUNKS} WHERE text IS NOT NULL""",
    "font_routing": f"""SELECT book_id, page_no, round({_LATIN1}, 6) AS latin1_ratio, regexp_matches(raw_text, '[\\x{{063C}}-\\x{{063F}}]') OR {_LATIN1} >= 0.05 AS corrupted,
  {_IS_DEC.format('raw_text')} AS decomposed,
  CASE WHEN length({strip('raw_text')}) < 100 OR regexp_matches(raw_text, '[\\x{{063C}}-\\x{{063F}}]') OR {_LATIN1} >= 0.05 OR {_IS_DEC.format('raw_text')} THEN 'scanned' ELSE 'digital' END AS route
FROM {PAGES} WHERE raw_text IS NOT NULL""",
    "ocr_garbage": f"""
WITH l AS (SELECT book_id, page_no, string_split(raw_text, chr(10)) AS ls FROM {PAGES} WHERE raw_text IS NOT NULL),
k AS (SELECT *, list_filter(ls, lambda ln: {strip('ln')} = '' OR (regexp_matches(ln, '[\\x{{0600}}-\\x{{06FF}}]{{3,}}') AND coalesce({_AR('ln')}, 0) > 0.85)) AS kept FROM l)
SELECT book_id, page_no, coalesce(array_to_string(kept, chr(10)), '') AS text, CAST(len(ls) - len(kept) AS INTEGER) AS n_dropped FROM k""",
    "bidi_strip": f"""SELECT book_id, page_no, regexp_replace(raw_text, '{_BIDI}', '', 'g') AS text,
  CAST(length(raw_text) - length(regexp_replace(raw_text, '{_BIDI}', '', 'g')) AS INTEGER) AS n_marks FROM {PAGES} WHERE raw_text IS NOT NULL""",
    "inline_numbers": _exploded(
        f"(SELECT book_id, page_no, string_split(raw_text, chr(10))[1] AS ln FROM {PAGES} WHERE raw_text IS NOT NULL)", "book_id, page_no",
        " || ".join(_NUM.format(a, b) for a, b in (("٠-٩", 0.85), ("۰-۹", 0.85), ("0-9", 0.80))),
        "book_id, page_no, CAST(pos - 1 AS INTEGER) AS ord, col.number AS number, col.confidence AS confidence", "true",
    ),
    "captions": _exploded("documents", "doc_id", _captions("text"), "doc_id, CAST(pos - 1 AS INTEGER) AS ord, col AS caption", "kind = 'script' AND text IS NOT NULL"),
    "sentence_chunks": _exploded("documents", "doc_id", _sentence_chunks("text", 300), "doc_id, CAST(pos - 1 AS INTEGER) AS ord, col AS piece", "text IS NOT NULL"),
    "script_clean": _clean_script(),
    "wrapped_lines": _exploded(SHOTS, "plan_id, shot_no", _wrap("typography_text", 24), "plan_id, shot_no, CAST(pos - 1 AS INTEGER) AS line_no, col AS line", "typography_text IS NOT NULL"),
    "excerpts": f"""SELECT plan_id, shot_no, {_excerpt()} AS excerpt, replace(replace(replace(caption_text, chr(92), chr(92) || chr(92)), '{{', chr(92) || '{{'), chr(10), chr(92) || 'N') AS escaped,
  CASE WHEN start IS NOT NULL THEN printf('%d:%02d:%02d.%02d', {_SEC} // 3600, ({_SEC} // 60) % 60, {_SEC} % 60, {_CS}) END AS "at" FROM {SHOTS}""",
    "query_keys": f"""SELECT query, sha256(query)[:16] AS query_hash, {n_words('query')} <= 2 AS bare, md5(query) AS md5
FROM (SELECT DISTINCT {strip('search_query')} AS query FROM shot) WHERE query <> ''""",
    "file_names": r"""SELECT book_id, source_path, title, CASE WHEN stem = '' THEN 'book' ELSE stem END AS stem, regexp_replace(regexp_extract(source_path, '([^/]*)$', 1), '\.[^.]*$', '') || '_phase1.json' AS json_name
FROM (SELECT *, regexp_replace(coalesce(title, ''), '[^\p{L}\p{N}_\x{0600}-\x{06FF}\-]', '_', 'g')[:50] AS stem FROM (SELECT DISTINCT book_id, source_path, metadata['title'] AS title FROM book))""",
    "ext_from_url": f"""SELECT url, CASE WHEN e = '' THEN '.jpg' WHEN e = '.jpeg' THEN '.jpg' ELSE e END AS ext
FROM (SELECT url, regexp_extract(lower(regexp_extract(url, '^[^?#]*')), '(\\.(?:jpe?g|png|webp|tiff?))$', 1) AS e FROM {values([(x,) for x in URLS], 'url')})""",
    "license_filter": f"""SELECT license, NOT regexp_matches({_LOW}, 'nc|nd|no derivative|no-derivative|all rights reserved') AND ({_LOW} = '' OR regexp_matches({_LOW}, '^(cc-|cc0|pd|public domain|attribution|no known|no restrictions)')) AS free,
  NOT regexp_matches({_LOW}, 'nc|nd|no derivative|no deriv|non-commercial') AND ({_LOW} = '' OR regexp_matches({_LOW}, '^(cc-|cc0|pd|public domain|attribution)')) AS free_v1,
  NOT regexp_matches({_LOW}, '\\bnc\\b|\\bnd\\b|noncommercial|non-commercial|no derivative|no-derivative|all rights reserved') AND ({_LOW} = '' OR regexp_matches({_LOW}, '^(cc-|cc0|cc |pd|public domain|attribution|no known|no restrictions)')) AS free_words
FROM {values([(x,) for x in LICENSES], 'license')}""",
    "lenient_json": f"""SELECT answer, nullif(o, '') AS object, coalesce(CAST(TRY_CAST(o AS JSON)->>'a' AS INTEGER), 5) AS a, coalesce(TRY_CAST(o AS JSON)->>'b', '') AS b
FROM (SELECT answer, regexp_extract(answer, '(?s)\\{{.*?\\}}') AS o FROM {values([(x,) for x in ANSWERS], 'answer')})""",
}

QUERIES = {k: globals()[k] for k in (*ORACLE, "compatible_forms", "reading_order")}
