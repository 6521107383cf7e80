"""Further queries: PDF paragraphs, names and sizes, small joins, clips; with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.operators import chunking as K
from quire.operators import layout
from quire.operators import lines as L
from quire.operators import pdf_text as P
from quire.session import table as t
from quire.sources import readers

from .line_queries import _CLASSES
from .media_queries import _CAND, _candidates
from .sqlkit import CHUNKS, PAGES, SHOTS, n_words, re2, splitlines, strip, values

# Search words of a genre where no others are known.
FALLBACK = {
    "history": (["Arabic history photograph", "Ottoman Empire historical", "historical Arab leader"], ["history documentary", "ancient ruins"]),
    "biography": (["historical portrait photograph", "Arab leader 20th century"], ["biography", "person contemplating"]),
    "non-fiction": (["book library historical", "Arabic manuscript"], ["library reading", "knowledge"]),
    "philosophy": (["Islamic philosophy", "Arabic calligraphy art"], ["philosophy thinking", "meditation"]),
    "science": (["Islamic golden age science", "Arabic astronomy manuscript"], ["science discovery", "laboratory"]),
    "religion": (["Islamic art calligraphy", "mosque architecture"], ["mosque spiritual", "prayer"]),
    "novel": (["Arabic literature", "storytelling art"], ["storytelling dramatic", "narrative"]),
}
FALLBACK_DEFAULT = (["Arabic manuscript", "library historical"], ["library", "books"])
# Heights of quotations as shares of the frame's, by the number of words.
QUOTE_SIZES = ((8, "pull_quote_lg", 0.075), (13, "pull_quote_md", 0.058), (None, "pull_quote_sm", 0.044))


def pdf_paragraphs(s, d):
    return tables.pages(s, d).where("pdf_type = 'digital' AND raw_text IS NOT NULL").select("book_id", "page_no", P.page_paragraphs(F.col("raw_text")).alias("text"))


def pdf_headings(s, d):
    x = tables.pages(s, d).where("raw_text IS NOT NULL").select("book_id", "page_no", F.posexplode(F.split("raw_text", "\n")).alias("line_no", "line"))
    return x.where(P.is_heading(F.col("line"))).select("book_id", "page_no", "line_no", P.clean_punctuation(P.fix_comma(F.col("line"))).alias("line"))


_HEADS = ("نص آخر", "النقطة الأولى: بداية", "النقطة  الثانية", "النقطة الثالثة", "النقطة الرابعة", "النقطة الخامسة", "الخاتمة", "تقديم الكتاب")


def script_sections(s, d):
    """Scripts and memoirs with a heading put before each paragraph but the first."""
    heads = F.array(*map(F.lit, _HEADS))
    parts = F.transform(F.split("text", "\n\n"), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.element_at(heads, (i % 8 + 1).cast("int")), F.lit("\n"), p)))
    x = t(s, d, "documents").where("kind IN ('script', 'memoir') AND text IS NOT NULL").select("doc_id", F.array_join(parts, "\n").alias("text"))
    return K.script_sections(x, "doc_id")


def book_metadata(s, d):
    m = lambda k: F.coalesce(F.col("metadata")[k], F.lit("")).alias(k)
    return t(s, d, "book").select("book_id", m("title"), m("author"), m("subject"), m("creator"), F.coalesce(F.col("metadata")["pages"].cast("int"), F.lit(0)).alias("pages")).distinct()


def duration_estimate(s, d):
    return t(s, d, "documents").where("kind = 'script' AND text IS NOT NULL").select("doc_id", F.round(F.least(F.lit(360.0), F.greatest(F.lit(60.0), F.length("text") / 12)), 6).alias("seconds"))


def quote_sizes(s, d):
    n = T.n_words(F.col("typography_text"))
    pick = lambda i: F.when(n <= 8, QUOTE_SIZES[0][i]).when(n <= 13, QUOTE_SIZES[1][i]).otherwise(QUOTE_SIZES[2][i])
    return tables.shots(s, d).where("typography_text IS NOT NULL").select("plan_id", "shot_no", pick(1).alias("size"), F.greatest(F.lit(12), F.floor(1080 * pick(2)).cast("int")).alias("px"))


def scaled_boxes(s, d):
    """Pixels at 400 dpi as points, and a header strip of 20 mm in pixels."""
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_partkey") * 72.0 / 400, 6).alias("points"), F.floor(F.lit(20.0) / 25.4 * (F.col("l_suppkey") % 5 * 50 + 200)).cast("int").alias("strip_px"))


def bundle_estimate(s, d):
    x = tables.pages(s, d).groupBy("book_id").agg(F.count("*").alias("n"))
    mb = F.col("n") * 4 * F.pow(F.lit(300.0) / 400, 2)
    return x.select("book_id", F.round(mb, 4).alias("mb"), F.greatest(F.lit(1), F.ceil(mb / 20)).cast("int").alias("parts"))


def page_file_names(s, d):
    n = F.count("*").over(Window.partitionBy("book_id"))
    width = F.greatest(F.lit(3), F.length(n.cast("string")))
    return tables.pages(s, d).select("book_id", "page_no", F.concat(F.lit("page_"), F.lpad(F.col("page_no").cast("string"), 4, "0").substr(F.lit(5) - width, width), F.lit(".png")).alias("image"), F.format_string("page%02d_fig%02d_caption.png", "page_no", F.col("page_no") % 3).alias("figure"))


def section_keyword_join(s, d):
    """Sections with their keywords; a section without has an empty list."""
    sec = tables.shots(s, d).select("plan_id", "section_id").where("section_id IS NOT NULL").distinct()
    kw = tables.shots(s, d).where("search_query <> '' AND shot_no % 3 = 0").groupBy("plan_id", "section_id").agg(F.array_sort(F.collect_set("search_query")).alias("keywords"))
    j = sec.join(kw, ["plan_id", "section_id"], "left")
    return j.select("plan_id", "section_id", F.array_join(F.slice(F.coalesce("keywords", F.array().cast("array<string>")), 1, 4), "|").alias("keywords"))


def fallback_keywords(s, d):
    rows = [(g, w, p) for g, (w, p) in FALLBACK.items()]
    dim = F.broadcast(s.createDataFrame(rows, "genre string, w array<string>, p array<string>"))  # seven rows
    g = s.createDataFrame([(x,) for x in (*FALLBACK, "poetry", None)], "genre string").join(dim, "genre", "left")
    return g.select("genre", F.array_join(F.coalesce("w", F.array(*map(F.lit, FALLBACK_DEFAULT[0]))), " | ").alias("wikimedia"), F.array_join(F.coalesce("p", F.array(*map(F.lit, FALLBACK_DEFAULT[1]))), " | ").alias("pexels"))


def positional_zip(s, d):
    """The k-th chunk of a book beside the k-th shot of each of its plans."""
    a = tables.chunks(s, d).withColumn("k", F.row_number().over(Window.partitionBy("book_id").orderBy("chunk_id"))).select("book_id", "k", "chunk_id")
    b = tables.shots(s, d).withColumn("k", F.row_number().over(Window.partitionBy("plan_id").orderBy("shot_no"))).select("plan_id", "book_id", "k", "shot_no")
    return b.join(a, ["book_id", "k"]).select("plan_id", "shot_no", "chunk_id")


def corrected_strip(s, d):
    """Lines classified on the raw text are taken, by their numbers, out of the corrected one."""
    raw = tables.pages(s, d).where("pdf_type = 'scanned'")
    classes = L.classify_lines(raw)
    return L.strip_lines(raw.withColumn("raw_text", F.translate("raw_text", "ھی»", "هي،")), classes)


def line_confidence(s, d):
    x = t(s, d, "events").where("value IS NOT NULL").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list("value")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b)
    return x.select("user_id", "event_type", F.round(total / F.size("v"), 6).alias("confidence"))


def ocr_words(s, d):
    """Recognised words of enough confidence put back into lines."""
    x = t(s, d, "lineitem").where("l_quantity * 2 >= 65")
    return x.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda w: w["l_partkey"].cast("string")), " ").alias("line"), F.count("*").alias("n"))


def archive_filter(s, d):
    lic = F.element_at(F.array(*map(F.lit, ("CC-BY-4.0", "CC BY-NC 2.0", "PD", "All rights reserved", "", "Attribution"))), (F.col("ord") % 6 + 1).cast("int"))
    raw = _candidates(s, d).select(F.col("query_no").cast("string").alias("query"), "ord", "title", F.lit("http://x.org/a.jpg").alias("url"), lic.alias("license"), "mime", "width", "height")
    return readers.archive_hits(raw, "wikimedia", 5).select("query", "ord", "license", "source")


def video_pick(s, d):
    """Of each query's first clip of 15 to 90 seconds the file nearest to 1280 pixels wide."""
    x = _candidates(s, d).withColumn("seconds", (F.col("ord") % 120).cast("int")).where(F.col("seconds").between(15, 90))
    first = x.groupBy("shot_no").agg(F.min("ord").alias("clip"))
    f = _candidates(s, d).select("shot_no", F.col("ord").alias("file"), "width").join(first, "shot_no").where("file % 5 = clip % 5 AND width > 0")
    return f.groupBy("shot_no", "clip").agg(F.min_by("file", F.struct(F.abs(F.col("width") - 1280), "file")).alias("file"))


def download_filter(s, d):
    n = F.octet_length("text")
    return t(s, d, "documents").select("doc_id", F.when(n >= 1024, n).alias("bytes"))


def section_clips(s, d):
    """What each section shows: its images in turn, at least 8 seconds each, else a clip, else a plain frame."""
    x = tables.shots(s, d).where("start IS NOT NULL AND `end` > start").groupBy("plan_id", "section_id").agg(
        F.round(F.sum(F.col("end") - F.col("start")), 3).alias("seconds"), F.count_if(F.col("visual").isin(*C_IMAGES)).alias("n_images"), F.count_if(F.col("visual") == "map").alias("n_clips")
    )
    kind = F.when(F.col("n_images") > 0, "images").when(F.col("n_clips") > 0, "clip").otherwise("frame")
    return x.select("plan_id", "section_id", kind.alias("kind"), F.round(F.when(F.col("n_images") > 0, F.greatest(F.lit(8.0), F.col("seconds") / F.col("n_images"))).otherwise(F.col("seconds")), 9).alias("each"))


C_IMAGES = ("portrait", "location", "object", "archive", "broll")


def plan_round_trip(s, d):
    """Plans written as JSON and read again, missing fields with their defaults."""
    j = F.to_json(F.struct("start", "end", "visual", "search_query", "motion", "show_caption", "section_id"))
    doc = tables.shots(s, d).groupBy("plan_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("shot_no", j.alias("j")))), lambda x: x["j"]), ","), F.lit("]")).alias("document"))
    return readers.parse_plans(doc, "plan_id").select("plan_id", "shot_no", "start", "end", "visual", "search_query", "source_hint", "motion", "show_caption", "note", "section_id")


def span_lines(s, d):
    x = tables.shots(s, d).where("start IS NOT NULL AND visual IS NOT NULL").select(F.col("plan_id").alias("page"), F.col("shot_no").alias("span"), F.col("start").alias("y"), (1000.0 - F.col("shot_no") * 37 % 500).alias("x_right"), F.col("visual").alias("text"))
    return layout.visual_lines(x)


def host_letters(s, d):
    x = tables.shots(s, d).where("typography_text IS NOT NULL").select(F.concat_ws("/", "plan_id", F.col("shot_no").cast("string")).alias("page"), F.posexplode(F.split("typography_text", " ")).alias("span", "w"))
    c = x.select("page", "span", F.posexplode(F.split("w", "")).alias("i", "c")).where("c <> ''").withColumn("ox", 500.0 - F.col("i") * 7 + F.col("i") % 3)
    return layout.host_letters(c)


_ORIG = "regexp_replace(regexp_replace({0}, '([^\\s]+)\\s+،\\s*([^\\s]+)', '\\1 \\2،', 'g'), '^،\\s*([^\\s]+)', '\\1،')"
_COMMA = lambda x: _ORIG.replace("{0}", x)
_PUNCT = lambda x: f"regexp_replace(regexp_replace({x}, '،،+', '،', 'g'), '\\.{{2,}}', '.', 'g')"
_HEADING = lambda x: f"(length({strip(x)}) BETWEEN 4 AND 55 AND NOT regexp_matches({strip(x)}, '[.،؛؟!]') AND NOT regexp_matches({strip(x)}, '^[\\x{{064B}}-\\x{{065F}}\\x{{0670}}]') AND NOT regexp_matches({strip(x)}, '{re2(P.MARKS_ONLY)}'))"
_OWN = _PUNCT(_COMMA(strip("x[1]")))
_LINE = f"(CASE WHEN acc[-1] = '' THEN {_OWN} WHEN {_OWN} = '' THEN acc[-1] ELSE acc[-1] || ' ' || {_OWN} END)"
_PARTS = f"string_split(regexp_replace({_LINE}, '([.؟!])\\s+([\\x{{0600}}-\\x{{06FF}}])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
_GENRES = [(g, *(" | ".join(x) for x in v)) for g, v in FALLBACK.items()]

ORACLE = {
    "pdf_paragraphs": f"""
WITH p AS (SELECT book_id, page_no, string_split(raw_text, chr(10)) AS ls FROM {PAGES} WHERE pdf_type = 'digital' AND raw_text IS NOT NULL),
q AS (SELECT book_id, page_no, list_filter(list_reduce(list_transform(ls, lambda y: [y]), lambda acc, x: acc[:-2] || list_filter(list_transform(({_PARTS})[:-2], lambda z: z), lambda z: {strip('z')} <> '')
  || CASE WHEN len({_PARTS}) > 1 AND {strip(f'({_PARTS})[-1]')} <> '' THEN [{strip(f'({_PARTS})[-1]')}] WHEN {strip(f'({_PARTS})[-1]')} <> '' THEN [{strip(f'({_PARTS})[-1]')}, ''] ELSE [''] END, ['']), lambda z: z <> '') AS vs FROM p)
SELECT book_id, page_no, CASE WHEN len(vs) = 0 THEN '' ELSE array_to_string(list_reduce(list_transform(vs, lambda y: [y]), lambda acc, b: CASE
  WHEN ({_HEADING('acc[-1]')} AND len(acc) > 1) OR ({_HEADING('b[1]')} AND {strip('acc[-1]')} <> '') THEN acc || ['', b[1]] WHEN regexp_matches(acc[-1], '[.؟!]\\s*$') THEN acc || b ELSE acc[:-2] || [acc[-1] || ' ' || b[1]] END), chr(10)) END AS text FROM q""",
    "pdf_headings": f"""SELECT book_id, page_no, CAST(i - 1 AS INTEGER) AS line_no, {_PUNCT(_COMMA('line'))} AS line FROM (SELECT book_id, page_no, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i
  FROM {PAGES} WHERE raw_text IS NOT NULL) WHERE {_HEADING('line')}""",
    "script_sections": f"""
WITH d AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10) || chr(10)), lambda p, i: CASE WHEN i = 1 THEN p ELSE [{', '.join(f"'{h}'" for h in _HEADS)}][(i - 1) % 8 + 1] || chr(10) || p END), chr(10)) AS text
  FROM documents WHERE kind IN ('script', 'memoir') AND text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, {splitlines('text')} AS ls FROM d)),
c AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches({strip('line')}, '^{p}') THEN '{n}'" for p, n in K.SCRIPT_HEADS)} END AS sid FROM l),
h AS (SELECT *, count(sid) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS h FROM c),
g AS (SELECT doc_id, h, {strip("string_agg(line, chr(10) ORDER BY i)")} AS text, coalesce(first(sid ORDER BY i), 'opening') AS section_id, {strip('first(line ORDER BY i)')} AS title FROM h GROUP BY doc_id, h)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY h) - 1 AS INTEGER) AS sec_no, section_id, title, text, CAST(length(text) AS INTEGER) AS n_chars FROM g WHERE text <> ''""",
    "book_metadata": "SELECT DISTINCT book_id, coalesce(metadata['title'], '') AS title, coalesce(metadata['author'], '') AS author, coalesce(metadata['subject'], '') AS subject, coalesce(metadata['creator'], '') AS creator, coalesce(TRY_CAST(metadata['pages'] AS INTEGER), 0) AS pages FROM book",
    "duration_estimate": "SELECT doc_id, round(least(360.0::DOUBLE, greatest(60.0::DOUBLE, length(text) / 12)), 6) AS seconds FROM documents WHERE kind = 'script' AND text IS NOT NULL",
    "quote_sizes": f"""SELECT plan_id, shot_no, CASE WHEN {n_words('typography_text')} <= 8 THEN 'pull_quote_lg' WHEN {n_words('typography_text')} <= 13 THEN 'pull_quote_md' ELSE 'pull_quote_sm' END AS size,
  CASE WHEN {n_words('typography_text')} <= 8 THEN 81 WHEN {n_words('typography_text')} <= 13 THEN 62 ELSE 47 END AS px FROM {SHOTS} WHERE typography_text IS NOT NULL""",
    "scaled_boxes": "SELECT l_orderkey, l_linenumber, round(l_partkey * 72.0::DOUBLE / 400, 6) AS points, CAST(floor(20.0::DOUBLE / 25.4::DOUBLE * (l_suppkey % 5 * 50 + 200)) AS INTEGER) AS strip_px FROM lineitem",
    "bundle_estimate": f"SELECT book_id, round(count(*) * 4 * pow(300.0::DOUBLE / 400, 2), 4) AS mb, CAST(greatest(1, ceil(count(*) * 4 * pow(300.0::DOUBLE / 400, 2) / 20)) AS INTEGER) AS parts FROM {PAGES} GROUP BY book_id",
    "page_file_names": f"SELECT book_id, page_no, 'page_' || printf('%03d', page_no) || '.png' AS image, printf('page%02d_fig%02d_caption.png', page_no, page_no % 3) AS figure FROM {PAGES}",
    "section_keyword_join": f"""WITH k AS (SELECT plan_id, section_id, list_sort(list(DISTINCT search_query)) AS kw FROM {SHOTS} WHERE search_query <> '' AND shot_no % 3 = 0 GROUP BY ALL)
SELECT s.plan_id, s.section_id, coalesce(array_to_string(kw[:4], '|'), '') AS keywords FROM (SELECT DISTINCT plan_id, section_id FROM shot WHERE section_id IS NOT NULL) s LEFT JOIN k USING (plan_id, section_id)""",
    "fallback_keywords": f"SELECT g.genre, coalesce(w, '{' | '.join(FALLBACK_DEFAULT[0])}') AS wikimedia, coalesce(p, '{' | '.join(FALLBACK_DEFAULT[1])}') AS pexels FROM {values([(g,) for g in (*FALLBACK, 'poetry', None)], 'genre')} g LEFT JOIN {values(_GENRES, 'genre, w, p')} f ON g.genre = f.genre",
    "positional_zip": f"""SELECT plan_id, shot_no, chunk_id FROM (SELECT plan_id, book_id, shot_no, row_number() OVER (PARTITION BY plan_id ORDER BY shot_no) AS k FROM {SHOTS})
JOIN (SELECT book_id, chunk_id, row_number() OVER (PARTITION BY book_id ORDER BY chunk_id) AS k FROM {CHUNKS}) USING (book_id, k)""",
    "corrected_strip": f"""WITH {_CLASSES}, gone AS (SELECT book_id, page_no, list(DISTINCT line_no) AS g FROM cls GROUP BY ALL)
SELECT book_id, page_no, translate(coalesce(array_to_string(list_filter(ls, lambda x, k: NOT list_contains(coalesce(g, []), CAST(k - 1 AS INTEGER))), chr(10)), ''), 'ھی»', 'هي،') AS text, CAST(coalesce(len(g), 0) AS INTEGER) AS n_stripped
FROM pg LEFT JOIN gone USING (book_id, page_no)""",
    "line_confidence": "SELECT user_id, event_type, round(sum(value) / count(*), 6) AS confidence FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type",
    "ocr_words": "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY l_linenumber, l_partkey) AS line, count(*) AS n FROM lineitem WHERE l_quantity * 2 >= 65 GROUP BY l_orderkey",
    "archive_filter": f"""WITH {_CAND}, x AS (SELECT CAST(query_no AS VARCHAR) AS query, ord, ['CC-BY-4.0', 'CC BY-NC 2.0', 'PD', 'All rights reserved', '', 'Attribution'][ord % 6 + 1] AS license, mime, width, height FROM cand)
SELECT query, ord, license, 'wikimedia' AS source FROM x WHERE license IN ('CC-BY-4.0', 'PD', '', 'Attribution') AND starts_with(mime, 'image/') AND mime <> 'image/gif' AND width >= 400 AND height >= 400
QUALIFY row_number() OVER (PARTITION BY query ORDER BY ord) <= 5""",
    "video_pick": f"""WITH {_CAND}, f AS (SELECT shot_no, min(ord) AS clip FROM cand WHERE ord % 120 BETWEEN 15 AND 90 GROUP BY shot_no)
SELECT shot_no, clip, arg_min(c.ord, {{'a': abs(width - 1280), 'b': c.ord}}) AS file FROM f JOIN cand c USING (shot_no) WHERE c.ord % 5 = clip % 5 AND width > 0 GROUP BY shot_no, clip""",
    "download_filter": "SELECT doc_id, CASE WHEN strlen(text) >= 1024 THEN CAST(strlen(text) AS INTEGER) END AS bytes FROM documents",
    "section_clips": f"""WITH x AS (SELECT plan_id, section_id, round(sum("end" - start), 3) AS seconds, count(*) FILTER (visual IN ('portrait', 'location', 'object', 'archive', 'broll')) AS ni, count(*) FILTER (visual = 'map') AS nc FROM {SHOTS} WHERE start IS NOT NULL AND "end" > start GROUP BY ALL)
SELECT plan_id, section_id, CASE WHEN ni > 0 THEN 'images' WHEN nc > 0 THEN 'clip' ELSE 'frame' END AS kind, round(CASE WHEN ni > 0 THEN greatest(8.0, seconds / ni) ELSE seconds END, 9) AS "each" FROM x""",
    "plan_round_trip": f"""SELECT plan_id, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY shot_no) AS INTEGER) AS shot_no, coalesce(start, 0.0) AS start, coalesce("end", 0.0) AS "end", coalesce(visual, 'archive') AS visual, coalesce(search_query, '') AS search_query,
  'any' AS source_hint, coalesce(motion, 'static') AS motion, coalesce(show_caption, true) AS show_caption, '' AS note, coalesce(section_id, '') AS section_id FROM {SHOTS}""",
    "span_lines": f"""
WITH x AS (SELECT plan_id AS page, shot_no AS span, start AS y, 1000.0::DOUBLE - shot_no * 37 % 500 AS r, visual AS t, row_number() OVER (PARTITION BY plan_id ORDER BY start, shot_no) AS rn FROM {SHOTS} WHERE start IS NOT NULL AND visual IS NOT NULL),
l AS (WITH RECURSIVE q AS (SELECT page, span, r, t, rn, y AS a, 1 AS line FROM x WHERE rn = 1 UNION ALL SELECT x.page, x.span, x.r, x.t, x.rn, CASE WHEN abs(x.y - q.a) > 4 THEN x.y ELSE q.a END, CASE WHEN abs(x.y - q.a) > 4 THEN q.line + 1 ELSE q.line END
  FROM q JOIN x ON x.page = q.page AND x.rn = q.rn + 1) SELECT * FROM q)
SELECT page, line AS line_no, string_agg(t, ' ' ORDER BY r DESC, span) AS text FROM l GROUP BY page, line""",
    "host_letters": f"""
WITH w AS (SELECT plan_id || '/' || shot_no AS page, unnest(string_split(typography_text, ' ')) AS w, generate_subscripts(string_split(typography_text, ' '), 1) - 1 AS span FROM {SHOTS} WHERE typography_text IS NOT NULL),
c AS (SELECT page, span, unnest(range(0, length(w))) AS i, w FROM w), d AS (SELECT page, CAST(span AS INTEGER) AS span, i, w[i + 1] AS c, 500.0 - i * 7 + i % 3 AS ox FROM c),
m AS (SELECT * FROM d WHERE regexp_matches(c, '^[\\x{{064B}}-\\x{{0652}}\\x{{0670}}]$')), b AS (SELECT * FROM d WHERE NOT regexp_matches(c, '^[\\x{{064B}}-\\x{{0652}}\\x{{0670}}]$'))
SELECT m.page, m.span, m.c, arg_min(b.c, {{'a': abs(m.ox - b.ox), 'b': b.i}}) AS host FROM m JOIN b USING (page, span) GROUP BY m.page, m.span, m.i, m.c""",
}
QUERIES = {k: globals()[k] for k in ORACLE}
