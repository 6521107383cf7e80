"""Queries on word timings, shot timelines, captions and plan audits, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import tables
from quire.functions import text as T
from quire.operators import audit as A
from quire.operators import timeline as L
from quire.session import table as t

from .sqlkit import CHUNKS, SHOTS, n_words, re2, strip

SECONDS = 360.0


def _words(s, d):
    return L.word_timings(tables.chunks(s, d), "book_id", "chunk_id", SECONDS)


def _timed(s, d):
    return tables.shots(s, d).where("start IS NOT NULL AND `end` IS NOT NULL")


def _totals(s, d):
    return _timed(s, d).groupBy("plan_id").agg(F.round(F.max("end") * 0.9, 3).alias("total"))


def _timeline(s, d):
    return L.stitched(_timed(s, d), _totals(s, d)).join(tables.shots(s, d).drop("start", "end"), ["plan_id", "shot_no"])


def word_timings(s, d):
    return _words(s, d).select("book_id", "word_no", "part", "word", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def proportional_map(s, d):
    w = _words(s, d)
    heard = L.word_timings(tables.chunks(s, d).withColumn("text", F.array_join(F.filter(T.tokens(F.col("text")), lambda x: F.length(x) > 2), " ")), "book_id", "chunk_id", 100.0)
    return L.proportional_map(w.select("book_id", "word_no", "word"), heard.select("book_id", "word_no", "start", "end"), "book_id").select("book_id", "word_no", "word", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def snap_boundaries(s, d):
    x = L.snap(_timed(s, d).select("book_id", "plan_id", "shot_no", "start", "end"), _words(s, d), "book_id")
    return x.select("plan_id", "shot_no", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def caption_words(s, d):
    return L.captions_of(_timed(s, d), _words(s, d), "book_id", ["plan_id", "shot_no"])


def section_ranges(s, d):
    return L.section_ranges(_words(s, d), "book_id").select("book_id", "part", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n_words")


def section_of_shot(s, d):
    return L.section_of(_timed(s, d), L.section_ranges(_words(s, d), "book_id"), "book_id", ["plan_id", "shot_no"])


def exclusive_fields(s, d):
    return L.exclusive_fields(tables.shots(s, d)).select("plan_id", "shot_no", "search_query", "typography_template", "typography_text")


def timeline_stitch(s, d):
    return L.stitched(_timed(s, d), _totals(s, d)).select("plan_id", "shot_no", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def split_long(s, d):
    x = L.cut_long(_timed(s, d).where("`end` > start"))
    return x.select("plan_id", "shot_no", "piece", "n_pieces", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def merge_adjacent(s, d):
    return L.merge_adjacent(_timeline(s, d)).withColumn("start", F.round("start", 6)).withColumn("end", F.round("end", 6))


def target_shots(s, d):
    x = t(s, d, "events").select("event_id", (F.col("value") * 3).alias("seconds"), F.lit(4.5).alias("each")).where("seconds IS NOT NULL")
    return x.select("event_id", L.target_shots(F.col("seconds"), F.col("each")).alias("n"))


def section_durations(s, d):
    x = L.section_durations(tables.chunks(s, d).where("text IS NOT NULL").withColumnRenamed("chunk_id", "part"), "book_id", SECONDS)
    return x.select("book_id", "part", F.round("seconds", 6).alias("seconds"))


def ass_events(s, d):
    return L.caption_events(_timed(s, d))


def caption_timeline(s, d):
    b = tables.chunks(s, d).where("text IS NOT NULL").select("book_id", "chunk_id", F.posexplode(T.captions(F.col("text"))).alias("ord", "c"))
    b = b.select(F.concat_ws("/", "book_id", F.col("chunk_id").cast("string")).alias("id"), "ord", T.n_words(F.col("c")).alias("n_words"), F.lit(7.5).alias("from"), F.lit(120.0).alias("to"))
    return L.caption_budget(b, "id").select("id", "ord", F.round("start", 9).alias("start"), F.round("end", 9).alias("end"))


def overlay_cursor(s, d):
    x = _timed(s, d).groupBy("plan_id", "section_id").agg(F.round(F.sum(F.greatest(F.col("end") - F.col("start"), F.lit(0.0))), 3).alias("seconds"), F.count_if(T.strip(F.col("typography_text")) != "").cast("int").alias("n_phrases"))
    x = x.select(F.concat_ws("/", "plan_id", "section_id").alias("id"), F.coalesce(F.col("section_id") == "opening", F.lit(False)).alias("opening"), "seconds", "n_phrases")
    return L.overlays(x, "id").select("id", "kind", "ord", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


def fade_offsets(s, d):
    return L.fade_offsets(_timed(s, d), "plan_id").select("plan_id", "shot_no", F.round("offset", 4).alias("offset"))


def plan_stats(s, d):
    return A.plan_stats(tables.shots(s, d))


def gap_overlap_audit(s, d):
    return A.gaps_overlaps(tables.shots(s, d))


def visual_histogram(s, d):
    return A.histogram(tables.shots(s, d), "visual")


def motion_histogram(s, d):
    return A.histogram(tables.shots(s, d), "motion")


def section_histogram(s, d):
    return A.histogram(tables.shots(s, d), "section_id")


def split_fragments(s, d):
    return A.split_fragments(L.merge_adjacent(_timeline(s, d)))


def typography_dedupe(s, d):
    return A.typography_texts(tables.shots(s, d))


def typography_stats(s, d):
    x = A.typography_texts(tables.shots(s, d))
    return x.groupBy("template").agg(F.count("*").alias("n"), F.min("n_words").alias("shortest"), F.max("n_words").alias("longest"), F.round(F.avg("n_words"), 6).alias("avg"))


def verbatim_audit(s, d):
    books = tables.shots(s, d).select("plan_id", "book_id").distinct()
    texts = A.typography_texts(tables.shots(s, d)).join(books, "plan_id")
    scripts = tables.chunks(s, d).where("text IS NOT NULL").groupBy("book_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), " ").alias("script"))
    return A.verbatim(texts, scripts, "book_id")


def query_quality(s, d):
    return A.query_quality(tables.shots(s, d))


def plan_lines(s, d):
    return A.plan_lines(tables.shots(s, d))


def image_manifest(s, d):
    return A.image_manifest(tables.shots(s, d))


# --------------------------------------------------------------------------------------------------- SQL

_TOK = re2(T.TOKEN)


def _wt(name: str, seconds: float, toks: str) -> str:
    return f"""
{name}0 AS (SELECT book_id, chunk_id, {toks} AS ts FROM {CHUNKS} WHERE text IS NOT NULL),
{name}1 AS (SELECT book_id, chunk_id, unnest(ts) AS word, generate_subscripts(ts, 1) AS i FROM {name}0),
{name}2 AS (SELECT *, CAST(sum(length(word)) OVER (PARTITION BY book_id ORDER BY chunk_id, i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(length(word)) OVER (PARTITION BY book_id) AS BIGINT) AS total,
  row_number() OVER (PARTITION BY book_id ORDER BY chunk_id, i) - 1 AS word_no FROM {name}1),
{name} AS (SELECT book_id, CAST(word_no AS INTEGER) AS word_no, chunk_id AS part, word, CAST({seconds} AS DOUBLE) * (upto - length(word)) / total AS ws, CAST({seconds} AS DOUBLE) * upto / total AS we FROM {name}2)"""


_W = _wt("w", SECONDS, f"regexp_extract_all(text, '{_TOK}')")
_S = f"sh AS (SELECT * FROM {SHOTS} WHERE start IS NOT NULL AND \"end\" IS NOT NULL)"
_ST = f"""{_S}, tt AS (SELECT plan_id, round(max("end") * CAST(0.9 AS DOUBLE), 3) AS total FROM sh GROUP BY plan_id),
s1 AS (SELECT plan_id, shot_no, start AS s, least("end", total) AS e, total, row_number() OVER (PARTITION BY plan_id ORDER BY start, shot_no) AS rn, count(*) OVER (PARTITION BY plan_id) AS n FROM sh JOIN tt USING (plan_id) WHERE start < total),
s2 AS (WITH RECURSIVE r AS (SELECT plan_id, shot_no, s, e, total, rn, n FROM s1 WHERE rn = 1
  UNION ALL SELECT x.plan_id, x.shot_no, r.e, CASE WHEN x.e <= r.e THEN r.e + 2.0 ELSE x.e END, x.total, x.rn, x.n FROM r JOIN s1 x ON x.plan_id = r.plan_id AND x.rn = r.rn + 1) SELECT * FROM r),
st AS (SELECT plan_id, shot_no, s AS start, CASE WHEN rn = n THEN total ELSE e END AS e FROM s2)"""
_CAP = "CASE visual " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in L.CAPS.items()) + " ELSE 8.0 END"


def _np(d: str) -> str:
    return f"CASE WHEN {d} <= CAST({_CAP} AS DOUBLE) + CAST(0.1 AS DOUBLE) THEN 1 ELSE greatest(2, CAST(round_even({d} / 5.0, 0) AS INTEGER)) END"


_MERGED = f"""{_ST}, tl AS (SELECT st.plan_id, st.shot_no, st.start, st.e, x.visual, x.search_query, x.typography_text, x.caption_text, x.note FROM st JOIN {SHOTS} x USING (plan_id, shot_no)),
m1 AS (SELECT *, {_np('(e - start)')} AS np, CASE WHEN abs(start - lag(e) OVER w) <= 0.05 AND coalesce(visual, '') = coalesce(lag(visual) OVER w, '') AND coalesce(search_query, '') = coalesce(lag(search_query) OVER w, '')
  AND coalesce(typography_text, '') = coalesce(lag(typography_text) OVER w, '') THEN 0 ELSE 1 END AS nw FROM tl WINDOW w AS (PARTITION BY plan_id ORDER BY start, shot_no)),
m2 AS (SELECT *, CASE WHEN np > 1 THEN {strip("coalesce(note, '') || ' [auto-split 1/' || np || ']'")} ELSE note END AS note2, sum(nw) OVER (PARTITION BY plan_id ORDER BY start, shot_no ROWS UNBOUNDED PRECEDING) AS isl FROM m1),
mg AS (SELECT plan_id, first(shot_no ORDER BY start, shot_no) AS shot_no, min(start) AS start, last(e ORDER BY start, shot_no) AS e, first(visual ORDER BY start, shot_no) AS visual, first(note2 ORDER BY start, shot_no) AS note,
  list_reduce(list_transform(list(coalesce(caption_text, '') ORDER BY start, shot_no), lambda c: c), lambda a, c: CASE WHEN c <> '' AND c <> a THEN {strip("a || ' ' || c")} ELSE a END) AS caption_text, count(*) AS n_merged FROM m2 GROUP BY plan_id, isl)"""


def _near(t: str, a: str) -> str:
    return f"(SELECT arg_min({a}, {{'d': abs({a} - sh.{t}), 'a': {a}}}) FROM w WHERE w.book_id = sh.book_id)"


def _time(x: str) -> str:
    sec = f"CAST(floor(greatest(0.0, {x})) AS BIGINT)"
    cs = f"least(99, CAST(round_even((greatest(0.0, {x}) - floor(greatest(0.0, {x}))) * 100, 0) AS INTEGER))"
    return f"printf('%d:%02d:%02d.%02d', {sec} // 3600, ({sec} // 60) % 60, {sec} % 60, {cs})"


def _hist(c: str) -> str:
    return f"""WITH g AS (SELECT coalesce({c}, '(unknown)') AS value, count(*) AS n, min({{'a': plan_id, 'b': shot_no}}) AS f FROM {SHOTS} GROUP BY 1)
SELECT value, n, round(n / sum(n) OVER (), 6) AS share, CAST(row_number() OVER (ORDER BY n DESC, f) AS INTEGER) AS rank FROM g"""


_TY = f"""ty AS (SELECT plan_id, {strip('typography_text')} AS text, min(shot_no) AS shot_no, arg_min(coalesce(nullif(typography_template, ''), '(none)'), shot_no) AS template, count(*) AS n_shots
  FROM {SHOTS} WHERE {strip('typography_text')} <> '' GROUP BY 1, 2), tx AS (SELECT *, {n_words('text')} AS n_words FROM ty)"""
_MK = re2(r"[ً-ْٰـ،.؟!:؛\"'`]")


def _bare(x: str) -> str:
    return f"regexp_extract_all({strip(f"regexp_replace({x}, '{_MK}', '', 'g')")}, '{_TOK}')"


def _blocks() -> str:
    from .text_queries import _captions

    return f"""b0 AS (SELECT book_id || '/' || chunk_id AS id, {_captions('text')} AS a FROM {CHUNKS} WHERE text IS NOT NULL),
b1 AS (SELECT id, CAST(i - 1 AS INTEGER) AS ord, greatest({n_words('c')}, 1) AS n, i AS rn FROM (SELECT id, unnest(a) AS c, generate_subscripts(a, 1) AS i FROM b0)),
b2 AS (SELECT *, sum(n) OVER (PARTITION BY id) AS total FROM b1)"""


ORACLE = {
    "word_timings": f"WITH {_W} SELECT book_id, word_no, part, word, round(ws, 6) AS start, round(we, 6) AS \"end\" FROM w",
    "proportional_map": f"""WITH {_W}, {_wt('a', 100.0, f"list_filter(regexp_extract_all(text, '{_TOK}'), lambda x: length(x) > 2)")},
c AS (SELECT book_id, count(*) AS na FROM a GROUP BY book_id), x AS (SELECT w.*, na, count(*) OVER (PARTITION BY w.book_id) AS n FROM w JOIN c USING (book_id)),
y AS (SELECT *, least(na - 1, word_no * na // n) AS lo FROM x), z AS (SELECT *, greatest(lo + 1, least(na, (word_no + 1) * na // n)) - 1 AS hi FROM y)
SELECT z.book_id, z.word_no, z.word, round(f.ws, 6) AS start, round(l.we, 6) AS "end" FROM z JOIN a f ON f.book_id = z.book_id AND f.word_no = lo JOIN a l ON l.book_id = z.book_id AND l.word_no = hi""",
    "snap_boundaries": f"""WITH {_W}, {_S}, n AS (SELECT plan_id, shot_no, start, "end", {_near('start', 'ws')} AS ns, {_near('end', 'we').replace('sh.end', 'sh."end"')} AS ne FROM sh)
SELECT plan_id, shot_no, round(coalesce(ns, start), 6) AS start, round(CASE WHEN ns IS NULL THEN "end" WHEN ne <= ns THEN ns + 1.5 ELSE ne END, 6) AS "end" FROM n""",
    "caption_words": f"""WITH {_W}, {_S} SELECT plan_id, shot_no, count(*) AS n_words, string_agg(word, ' ' ORDER BY word_no) AS caption FROM sh JOIN w ON w.book_id = sh.book_id
AND ws >= start - CAST(0.05 AS DOUBLE) AND we <= "end" + CAST(0.05 AS DOUBLE) GROUP BY plan_id, shot_no""",
    "section_ranges": f"WITH {_W} SELECT book_id, part, round(min(ws), 6) AS start, round(max(we), 6) AS \"end\", count(*) AS n_words FROM w GROUP BY book_id, part",
    "section_of_shot": f"""WITH {_W}, {_S}, r AS (SELECT book_id, part, min(ws) AS rs, max(we) AS re FROM w GROUP BY ALL)
SELECT plan_id, shot_no, min(part) AS part FROM sh LEFT JOIN r ON r.book_id = sh.book_id AND rs <= (start + "end") / 2 AND (start + "end") / 2 <= re GROUP BY plan_id, shot_no""",
    "exclusive_fields": f"""SELECT plan_id, shot_no, CASE WHEN visual IN ('title_card', 'section_mark', 'typography') THEN '' ELSE search_query END AS search_query,
  CASE WHEN NOT coalesce(visual IN ('title_card', 'section_mark', 'typography'), false) AND coalesce(typography_text, '') <> '' THEN NULL ELSE typography_template END AS typography_template,
  CASE WHEN NOT coalesce(visual IN ('title_card', 'section_mark', 'typography'), false) AND coalesce(typography_text, '') <> '' THEN '' ELSE typography_text END AS typography_text FROM {SHOTS}""",
    "timeline_stitch": f"WITH {_ST} SELECT plan_id, shot_no, round(start, 6) AS start, round(e, 6) AS \"end\" FROM st",
    "split_long": f"""WITH {_S}, p AS (SELECT plan_id, shot_no, start, "end" - start AS d, {_np('("end" - start)')} AS n_pieces FROM sh WHERE "end" > start),
q AS (SELECT *, CAST(unnest(range(1, n_pieces + 1)) AS INTEGER) AS piece FROM p)
SELECT plan_id, shot_no, piece, n_pieces, round(start + (piece - 1) * (d / n_pieces), 6) AS start, round(start + piece * (d / n_pieces), 6) AS "end" FROM q""",
    "merge_adjacent": f"WITH {_MERGED} SELECT plan_id, shot_no, round(start, 6) AS start, round(e, 6) AS \"end\", visual, note, caption_text, n_merged FROM mg",
    "target_shots": """SELECT event_id, greatest(8, least(65, CAST(CASE WHEN s <= 180 THEN floor(s / 4.5) ELSE floor(180 / 4.5) + floor((s - 180) / 5.5) END AS INTEGER))) AS n
FROM (SELECT event_id, value * 3 AS s FROM events WHERE value IS NOT NULL)""",
    "section_durations": f"SELECT book_id, chunk_id AS part, round(greatest(5.0, CAST({SECONDS} AS DOUBLE) * length({strip('text')}) / greatest(sum(length({strip('text')})) OVER (PARTITION BY book_id), 1)), 6) AS seconds FROM {CHUNKS} WHERE text IS NOT NULL",
    "ass_events": f"""WITH {_S}, x AS (SELECT *, start + CAST(0.05 AS DOUBLE) AS s, "end" - CAST(0.05 AS DOUBLE) AS e, {strip('caption_text')} AS c FROM sh
  WHERE show_caption AND NOT coalesce(visual IN ('title_card', 'section_mark', 'chapter_heading', 'typography'), false))
SELECT plan_id, shot_no, 'Dialogue: 0,' || {_time('s')} || ',' || {_time('e')} || ',Caption,,0,0,0,,' || replace(replace(replace(c, chr(92), chr(92) || chr(92)), '{{', chr(92) || '{{'), chr(10), chr(92) || 'N') AS event
FROM x WHERE c <> '' AND e > s""",
    "overlay_cursor": f"""WITH {_S}, g AS (SELECT concat_ws('/', plan_id, section_id) AS id, coalesce(section_id = 'opening', false) AS opening, round(sum(greatest("end" - start, 0.0)), 3) AS seconds,
  count(*) FILTER ({strip('typography_text')} <> '') AS np FROM sh GROUP BY plan_id, section_id),
h AS (SELECT *, CASE WHEN opening THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS t0 FROM g), i AS (SELECT *, least(t0 + 2.5, seconds - 1.0) AS m FROM h), j AS (SELECT *, CASE WHEN m > t0 THEN m ELSE t0 END AS t1 FROM i),
r AS (SELECT id, 'title' AS kind, 0 AS ord, 0.0::DOUBLE AS s, 5.0::DOUBLE AS e FROM j WHERE opening UNION ALL SELECT id, 'mark', 0, t0, m FROM j
  UNION ALL SELECT id, 'phrase', CAST(k AS INTEGER), t1 + k * 3.5, least(t1 + (k + 1) * 3.5, seconds - 0.5) FROM (SELECT *, unnest(range(0, np)) AS k FROM j))
SELECT id, kind, ord, round(s, 4) AS start, round(e, 4) AS "end" FROM r WHERE e > s""",
    "fade_offsets": f"WITH {_S} SELECT plan_id, shot_no, round(sum(\"end\" - start - 0.5) OVER (PARTITION BY plan_id ORDER BY start, shot_no ROWS UNBOUNDED PRECEDING), 4) AS \"offset\" FROM sh",
    "plan_stats": f"""WITH {_S} SELECT plan_id, count(*) AS n, arg_min(start, shot_no) AS plan_start, arg_max("end", shot_no) AS plan_end, round(sum("end" - start), 4) AS total, round(avg("end" - start), 9) AS avg,
  round(min("end" - start), 6) AS shortest, round(max("end" - start), 6) AS longest FROM sh GROUP BY plan_id""",
    "gap_overlap_audit": f"""WITH {_S}, x AS (SELECT plan_id, lead(start) OVER (PARTITION BY plan_id ORDER BY shot_no) - "end" AS d FROM sh)
SELECT plan_id, count(*) FILTER (d > 0.05) AS n_gaps, count(*) FILTER (d < -0.05) AS n_overlaps, round(coalesce(sum(d) FILTER (d > 0.05), 0.0), 4) AS gap, round(coalesce(sum(-d) FILTER (d < -0.05), 0.0), 4) AS overlap FROM x GROUP BY plan_id""",
    "visual_histogram": _hist("visual"),
    "motion_histogram": _hist("motion"),
    "section_histogram": _hist("section_id"),
    "split_fragments": f"""WITH {_MERGED}, x AS (SELECT plan_id, count(*) AS n, count(*) FILTER (contains(note, 'auto-split')) AS n_pieces,
  count(DISTINCT CASE WHEN contains(note, 'auto-split') THEN regexp_replace(note, '(?s) \\[auto-split.*$', '') END) AS n_originals FROM mg GROUP BY plan_id)
SELECT plan_id, n, n_pieces, n_originals, n - n_pieces + n_originals AS implied, round(n_pieces * 100.0 / n, 4) AS share, CASE WHEN n_pieces * 100.0 / n < 20 THEN '✓' WHEN n_pieces * 100.0 / n < 50 THEN '⚠' ELSE '❌' END AS verdict FROM x""",
    "typography_dedupe": f"WITH {_TY} SELECT plan_id, text, shot_no, template, n_shots, n_words FROM tx",
    "typography_stats": f"WITH {_TY} SELECT template, count(*) AS n, min(n_words) AS shortest, max(n_words) AS longest, round(avg(n_words), 6) AS avg FROM tx GROUP BY template",
    "verbatim_audit": f"""WITH {_TY}, bk AS (SELECT DISTINCT plan_id, book_id FROM shot), sc AS (SELECT book_id, string_agg(text, ' ' ORDER BY chunk_id) AS script FROM {CHUNKS} WHERE text IS NOT NULL GROUP BY book_id),
hy AS (SELECT book_id, array_to_string({_bare('script')}, ' ') AS hay FROM sc), q AS (SELECT plan_id, shot_no, {_bare('text')} AS q, hay FROM tx JOIN bk USING (plan_id) JOIN hy USING (book_id)),
m AS (SELECT *, len(q) AS n, CASE WHEN len(q) = 0 THEN 0 ELSE list_max(list_transform(range(1, len(q) + 1), lambda k: CASE WHEN contains(hay, array_to_string(q[:k], ' ')) THEN k ELSE 0 END)) END AS matched FROM q)
SELECT plan_id, shot_no, CASE WHEN matched = n THEN 'verbatim' WHEN matched / n >= 0.6 THEN 'partial' ELSE 'paraphrase' END AS verdict, CAST(matched AS INTEGER) AS matched, CAST(n AS INTEGER) AS n_words FROM m""",
    "query_quality": f"SELECT plan_id, count(*) AS n_queries, round(avg({n_words('search_query')}), 6) AS avg_words, count(*) FILTER ({n_words('search_query')} <= 2) AS n_bare FROM {SHOTS} WHERE {strip('search_query')} <> '' GROUP BY plan_id",
    "plan_lines": f"""WITH {_S} SELECT plan_id, shot_no, printf('%3d. %s %6.2f-%6.2fs %s %s', shot_no, CASE WHEN coalesce(section_id, '') <> '' THEN '[' || lpad(section_id, 9, ' ') || ']' ELSE '[         ]' END, round_even(start * 100, 0) / 100, round_even("end" * 100, 0) / 100,
  CASE WHEN length(coalesce(visual, '')) < 14 THEN rpad(coalesce(visual, ''), 14, ' ') ELSE visual END, coalesce(CASE WHEN visual = 'typography' THEN '"' || typography_text[:50] || '"' ELSE search_query[:60] END, '')) AS line FROM sh""",
    "image_manifest": f"""WITH {_S} SELECT plan_id, shot_no, printf('shot_%02d    %s%5.1fs    "%s"', shot_no, CASE WHEN length(visual) < 14 THEN rpad(visual, 14, ' ') ELSE visual END, round_even(("end" - start) * 10, 0) / 10, coalesce(search_query, '')) AS line
FROM sh WHERE visual IS NOT NULL AND visual NOT IN ('title_card', 'section_mark', 'chapter_heading', 'typography')""",
    "caption_timeline": f"""WITH {_blocks()}, r AS (WITH RECURSIVE r AS (SELECT id, ord, rn, n, total, 7.5::DOUBLE AS s, greatest(least(7.5 + greatest(2.0::DOUBLE, 112.5::DOUBLE * n / total) - 0.08, 120.0::DOUBLE - 0.08), 7.5 + 2.0) AS e FROM b2 WHERE rn = 1
  UNION ALL SELECT x.id, x.ord, x.rn, x.n, x.total, r.e + 0.08, greatest(least(r.e + 0.08 + greatest(2.0::DOUBLE, 112.5::DOUBLE * x.n / x.total) - 0.08, 120.0::DOUBLE - 0.08), r.e + 0.08 + 2.0)
  FROM r JOIN b2 x ON x.id = r.id AND x.rn = r.rn + 1 WHERE r.e + 0.08 < 120.0) SELECT * FROM r)
SELECT id, ord, round(s, 9) AS start, round(e, 9) AS "end" FROM r""",
}
QUERIES = {k: globals()[k] for k in ORACLE}
