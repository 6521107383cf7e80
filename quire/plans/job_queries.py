"""Queries of media jobs, subtitle styles and archive answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import tables
from quire.operators import jobs as J
from quire.session import table as t

from .sqlkit import SHOTS


def _timed(s, d):
    return tables.shots(s, d).where("start IS NOT NULL AND `end` > start")


def _clips(s, d):
    return _timed(s, d).select("plan_id", "shot_no", F.concat_ws("/", "plan_id", F.concat(F.col("shot_no").cast("string"), F.lit(".mp4"))).alias("path"), F.lit(0.0).alias("start"), (F.col("end") - F.col("start")).alias("seconds"))


def motion_jobs(s, d):
    return J.motion_jobs(_timed(s, d))


def trim_jobs(s, d):
    return J.trim_jobs(_clips(s, d)).select("plan_id", "shot_no", F.array_join("args", " ").alias("args"))


def fade_graphs(s, d):
    return J.fade_graphs(_clips(s, d)).select("plan_id", "n_clips", "graph", F.size("args").alias("n_args"))


def mux_jobs(s, d):
    p = _timed(s, d).groupBy("plan_id").agg(F.round(F.max("end"), 3).alias("seconds"), F.max(F.coalesce("show_caption", F.lit(False)).cast("int")).alias("shown"), F.count("*").alias("n"))
    p = p.select("plan_id", F.concat("plan_id", F.lit(".mp4")).alias("video"), F.when(F.col("n") % 2 == 0, F.concat("plan_id", F.lit(".mp3"))).alias("audio"), F.when(F.col("shown") == 1, F.concat(F.lit("c:\\"), "plan_id", F.lit(".ass"))).alias("subtitles"), "seconds")
    return J.mux_jobs(p).select("plan_id", F.array_join("args", " ").alias("args"))


def thumbnail_jobs(s, d):
    return _timed(s, d).select("plan_id").distinct().select("plan_id", F.array_join(J.thumbnail_args(F.concat("plan_id", F.lit(".mp4"))), " ").alias("args"))


def subtitle_styles(s, d):
    x = t(s, d, "documents").select("doc_id", (F.col("doc_id") % 2160).cast("int").alias("height"))
    return x.select("doc_id", *(c.alias(k) for k, c in J.style_sizes(F.col("height")).items()))


def overlay_events(s, d):
    from quire.operators import timeline as L

    x = _timed(s, d).groupBy("plan_id").agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("seconds"), F.round(F.min("start"), 3).alias("begin"), F.count("*").alias("n"))
    sec = x.select("plan_id", "begin", F.concat(F.lit("Plan "), "plan_id").alias("title"), F.when(F.col("n") % 2 == 0, "A. Author").otherwise("").alias("author"), F.lit("{Opening}").alias("label"), F.array(F.lit(" one "), F.lit("two")).alias("phrases"))
    o = L.overlays(x.select("plan_id", F.lit(True).alias("opening"), "seconds", F.lit(2).alias("n_phrases")), "plan_id")
    return J.overlay_events(sec, o, "plan_id")


def _answers(s, d):
    return t(s, d, "documents").where("title IS NOT NULL").select((F.col("doc_id") % 40).cast("string").alias("query"), F.col("doc_id").alias("ord"), "title", "kind")


def loc_answers(s, d):
    name = lambda part: F.concat(F.lit("//tile.example/" + part + "/"), F.col("ord").cast("string"), F.lit(".jpg"))
    urls = F.when(F.col("ord") % 5 == 0, F.array().cast("array<string>")).when(F.col("ord") % 3 == 0, F.array(name("full"), name("Thumb"))).otherwise(F.array(name("small"), name("full")))
    rights = F.element_at(F.array(F.lit("No known restrictions on publication."), F.lit("All rights reserved"), F.lit("In the Public Domain"), F.lit(""), F.lit("CC-BY-NC-4.0")), (F.col("ord") % 5 + 1).cast("int"))
    return J.archive_rows(_answers(s, d).withColumn("image_urls", urls).withColumn("rights", rights), "loc")


def archive_answers(s, d):
    x = _answers(s, d).withColumn("identifier", F.when(F.col("ord") % 7 != 0, F.concat(F.lit("item"), F.col("ord").cast("string")))).withColumn("license", F.when(F.col("ord") % 2 == 0, F.lit("https://creativecommons.org/licenses/by/4.0/")))
    return J.archive_rows(x, "internet_archive")


def stock_answers(s, d):
    u = lambda k, p: F.when(F.col("ord") % k != 0, F.concat(F.lit(p), F.col("ord").cast("string")))
    return J.archive_rows(_answers(s, d).withColumn("large2x", u(2, "a")).withColumn("large", u(3, "b")).withColumn("original", u(5, "c")), "pexels")


_S = f"""sh AS (SELECT * FROM {SHOTS} WHERE start IS NOT NULL AND "end" > start)"""
_FR = """greatest(1, CAST(round_even(("end" - start) * 25, 0) AS INTEGER))"""
_RIGHT = "'if(lte(on,1),0,min(x+(iw*{0})/' || n || ',iw-iw/zoom))'"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY query ORDER BY ord) <= 3"
_ANS = "a AS (SELECT CAST(doc_id % 40 AS VARCHAR) AS query, doc_id AS ord, title FROM documents WHERE title IS NOT NULL)"
_TIME = """CAST(floor(floor({0}) / 3600) AS BIGINT) || ':' || lpad(CAST(CAST(floor(floor({0}) / 60) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor({0}) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '.' ||
  lpad(CAST(least(99, CAST(round_even(({0} - floor({0})) * 100, 0) AS INTEGER)) AS VARCHAR), 2, '0')"""
ORACLE = {
    "motion_jobs": f"""WITH {_S}, f AS (SELECT plan_id, shot_no, motion, {_FR} AS n FROM sh)
SELECT plan_id, shot_no, n AS frames, CASE motion WHEN 'zoom_in' THEN 'min(pzoom+' || printf('%.6f', 0.08 / n) || ',1.08)' WHEN 'zoom_out' THEN 'if(lte(on,1),1.08,max(1.0,pzoom-' || printf('%.6f', 0.08 / n) || '))'
  WHEN 'fast_push' THEN 'min(pzoom+' || printf('%.6f', 0.20 / n) || ',1.20)' WHEN 'ken_burns' THEN 'min(pzoom+' || printf('%.6f', (0.12 - 1e-12) / n) || ',1.12)' ELSE '1.10' END AS z,
  CASE motion WHEN 'pan_right' THEN {_RIGHT.format('0.5')} WHEN 'ken_burns' THEN {_RIGHT.format('0.3')} WHEN 'pan_left' THEN 'if(lte(on,1),iw-iw/zoom,max(0,x-(iw*0.5)/' || n || '))' ELSE 'iw/2-(iw/zoom/2)' END AS x, 'ih/2-(ih/zoom/2)' AS y
FROM f WHERE motion IN ('zoom_in', 'zoom_out', 'fast_push', 'pan_right', 'pan_left', 'ken_burns')""",
    "trim_jobs": f"""WITH {_S} SELECT plan_id, shot_no, '-ss 0.000 -i ' || plan_id || '/' || shot_no || '.mp4 -t ' || printf('%.3f', "end" - start) || ' -vf scale=1280:720:force_original_aspect_ratio=decrease,pad=1280:720:(ow-iw)/2:(oh-ih)/2,format=yuv420p'
  || ' -c:v libx264 -preset ultrafast -crf 26 -an' AS args FROM sh""",
    "fade_graphs": f"""WITH {_S}, c AS (SELECT plan_id, shot_no, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY plan_id) AS n, greatest(0.0, sum("end" - start - 1.0) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS o
  FROM sh WINDOW w AS (PARTITION BY plan_id ORDER BY shot_no)),
p AS (SELECT plan_id, i, '[' || CASE WHEN i = 1 THEN '0:v' ELSE 'v' || (i - 1) END || '][' || i || ':v]xfade=transition=fade:duration=1.0:offset=' || printf('%.3f', o) || '[' || CASE WHEN i = n - 1 THEN 'vout' ELSE 'v' || i END || ']' AS p FROM c)
SELECT plan_id, count(*) AS n_clips, coalesce(string_agg(p, ';' ORDER BY i) FILTER (i > 0), '') AS graph, CAST(CASE WHEN count(*) > 1 THEN 12 ELSE 2 END AS INTEGER) AS n_args FROM p GROUP BY plan_id""",
    "mux_jobs": f"""WITH {_S}, p AS (SELECT plan_id, round(max("end"), 3) AS secs, bool_or(coalesce(show_caption, false)) AS shown, count(*) % 2 = 0 AS loud FROM sh GROUP BY plan_id)
SELECT plan_id, '-i ' || plan_id || '.mp4' || CASE WHEN loud THEN ' -i ' || plan_id || '.mp3' ELSE '' END || CASE WHEN shown THEN ' -vf ass=c\\:/' || plan_id || '.ass -c:v libx264 -preset fast -crf 22 -pix_fmt yuv420p' ELSE ' -c:v copy' END
  || CASE WHEN loud THEN ' -c:a aac -b:a 192k -shortest' ELSE ' -an' END || CASE WHEN secs > 0 THEN ' -t ' || printf('%.3f', secs) ELSE '' END AS args FROM p""",
    "thumbnail_jobs": f"WITH {_S} SELECT DISTINCT plan_id, '-ss 2.0 -i ' || plan_id || '.mp4 -vframes 1 -q:v 3' AS args FROM sh",
    "subtitle_styles": """WITH h AS (SELECT doc_id, CAST(doc_id % 2160 AS INTEGER) AS h FROM documents)
SELECT doc_id, greatest(72, h // 9) AS title_size, greatest(44, h // 16) AS title_sub_size, greatest(72, h // 9) + greatest(44, h // 16) + 20 AS title_sub_margin, greatest(52, h // 13) AS section_size, greatest(62, h // 11) AS phrase_size,
  greatest(80, h // 7) AS phrase_margin, greatest(48, h // 14) AS caption_size, greatest(40, h // 18) AS caption_margin FROM h""",
    "overlay_events": f"""WITH {_S}, p AS (SELECT plan_id, round(sum("end" - start), 3) AS secs, round(min(start), 3) AS b, count(*) % 2 = 0 AS named FROM sh GROUP BY plan_id),
m AS (SELECT *, least(7.5::DOUBLE, secs - 1.0) AS m FROM p), q AS (SELECT *, CASE WHEN m > 5.0 THEN m ELSE 5.0::DOUBLE END AS t1 FROM m),
r AS (SELECT plan_id, b, 'title' AS kind, 0 AS ord, 0.0::DOUBLE AS s, 5.0::DOUBLE AS e, 'TitleCard' AS style, 'Plan ' || plan_id AS txt FROM q UNION ALL SELECT plan_id, b, 'author', 0, 0.0, 5.0, 'TitleSub', 'A. Author' FROM q WHERE named
  UNION ALL SELECT plan_id, b, 'mark', 0, 5.0, m, 'SectionMark', '\\{{Opening}}' FROM q
  UNION ALL SELECT plan_id, b, 'phrase', CAST(k AS INTEGER), t1 + k * 3.5, least(t1 + (k + 1) * 3.5, secs - 0.5), 'KeyPhrase', ['one', 'two'][k + 1] FROM (SELECT *, unnest([0, 1]) AS k FROM q)),
z AS (SELECT *, b + s AS x, greatest(b + s + 0.5, b + e) AS y FROM r WHERE e > s)
SELECT plan_id, kind, ord, 'Dialogue: 0,' || {_TIME.format('x')} || ',' || {_TIME.format('y')} || ',' || style || ',,0,0,0,,' || txt AS event FROM z""",
    "loc_answers": f"""WITH {_ANS}, u AS (SELECT *, CASE WHEN ord % 5 = 0 THEN NULL ELSE 'https://tile.example/full/' || ord || '.jpg' END AS url,
  ['No known restrictions on publication.', 'All rights reserved', 'In the Public Domain', '', 'CC-BY-NC-4.0'][ord % 5 + 1] AS rights FROM a)
SELECT query, ord, url, title[:120] AS title, 'PD' AS license, 'loc' AS source FROM u WHERE url IS NOT NULL AND rights IN ('No known restrictions on publication.', 'In the Public Domain', '') {_FIRST}""",
    "archive_answers": f"""WITH {_ANS} SELECT query, ord, 'https://archive.org/download/item' || ord || '/item' || ord || '.jpg' AS url, title[:120] AS title, CASE WHEN ord % 2 = 0 THEN left('https://creativecommons.org/licenses/by/4.0/', 30) ELSE 'PD' END AS license,
  'internet_archive' AS source FROM a WHERE ord % 7 <> 0 {_FIRST}""",
    "stock_answers": f"""WITH {_ANS}, u AS (SELECT *, CASE WHEN ord % 2 <> 0 THEN 'a' || ord WHEN ord % 3 <> 0 THEN 'b' || ord WHEN ord % 5 <> 0 THEN 'c' || ord END AS url FROM a)
SELECT query, ord, url, title[:120] AS title, 'Pexels License' AS license, 'pexels' AS source FROM u WHERE url IS NOT NULL {_FIRST}""",
}
QUERIES = {k: globals()[k] for k in ORACLE}
