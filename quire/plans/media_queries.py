"""Queries on image candidates and render jobs, with their SQL twins. Candidates are made from documents by their hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import tables
from quire.operators import candidates as C
from quire.session import table as t

from .sqlkit import SHOTS, values

SOURCES = ("loc", "wikimedia", "internet_archive", "pexels")


def _nibble(i: int, mod: int):
    """A number below ``mod`` from the i-th hexadecimal digit of a document's hash."""
    return (F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), i, 1), 16, 10).cast("int") % mod).cast("int")


def _candidates(s, d):
    src = F.element_at(F.array(*map(F.lit, SOURCES)), _nibble(5, 4) + 1)
    unscored = _nibble(6, 8) == 0
    score = lambda i: F.when(unscored, -1).otherwise(_nibble(i, 4))
    return t(s, d, "documents").select(
        (F.col("doc_id") % 97).cast("int").alias("shot_no"), F.col("doc_id").alias("ord"), src.alias("source"), F.coalesce("title", F.lit("")).alias("title"), (F.col("doc_id") % 7).cast("int").alias("query_no"),
        score(1).alias("score_subject"), score(2).alias("score_quality"), score(3).alias("score_cinematic"), (_nibble(7, 16) * 100).alias("width"), (_nibble(8, 16) * 100).alias("height"),
        F.when(_nibble(9, 4) == 0, "image/gif").when(_nibble(9, 4) == 1, "video/mp4").otherwise("image/jpeg").alias("mime"),
    )


def candidate_rank(s, d):
    x = C.rank(_candidates(s, d).where(C.passes()), ["shot_no"])
    return x.select("shot_no", "ord", "source", C.total_score().alias("total"), "rank")


def candidate_best(s, d):
    return C.best(_candidates(s, d), ["shot_no"]).select("shot_no", "ord", "source")


def candidate_filter(s, d):
    return _candidates(s, d).where(C.big_enough()).select("ord", "width", "height", "mime")


def limit_per_source(s, d):
    return C.limit_per_source(_candidates(s, d).where(C.big_enough()), ["shot_no"], 2).select("shot_no", "source", "ord")


def limit_total(s, d):
    return C.limit_total(_candidates(s, d), ["shot_no"], 5).select("shot_no", "query_no", "ord")


def candidate_labels(s, d):
    return C.labels(_candidates(s, d), ["shot_no"]).select("shot_no", "ord", "label")


def source_union(s, d):
    x = _candidates(s, d)
    u = C.pooled([x.where(F.col("source") == n).select("shot_no", "ord", "source") for n in SOURCES])
    return u.groupBy("source_no", "source").agg(F.count("*").alias("n"), F.count_distinct("shot_no").alias("n_shots"))


def closest_width(s, d):
    x = _candidates(s, d).where("width > 0")
    return x.groupBy("shot_no").agg(F.min_by("ord", F.struct(F.abs(F.col("width") - 1280), "ord")).alias("ord"))


def waterfall(s, d):
    x = tables.shots(s, d).select("plan_id", "shot_no", "search_query").withColumn("key", F.concat_ws("/", "plan_id", F.col("shot_no").cast("string")))
    step = lambda m, n: x.where(F.col("shot_no") % m == 0).select("key", F.concat(F.lit(n + "/"), "key").alias("path"))
    return C.waterfall(x.select("key"), [("dossier", step(11, "dossier")), ("user", step(5, "user")), ("book", step(4, "book")), ("cache", step(3, "cache")), ("web", step(2, "web"))], "key")


def dossier_resolution(s, d):
    x = t(s, d, "documents")
    pick = lambda i, m, n: F.when(_nibble(i, m) == 0, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    dec = x.select(F.col("doc_id").alias("shot_no"), F.when(_nibble(4, 2) == 0, "portrait").otherwise("archive").alias("visual"), pick(1, 4, "o").alias("override"), F.lit("p1").alias("pinned"), pick(2, 2, "c").alias("chosen"))
    files = x.where(_nibble(3, 2) == 0).select(F.concat(F.lit("o"), F.col("doc_id").cast("string")).alias("path")).unionAll(x.where(_nibble(3, 3) > 0).select(F.concat(F.lit("c"), F.col("doc_id").cast("string")))).unionAll(x.select(F.lit("p1")).distinct())
    return C.resolve_dossier(dec, files)


MANIFEST = [("5", "five.jpg"), ("7", "missing.jpg"), ("query:z", "z.png"), ("3", "three.png")]
FILES = [("five.jpg",), ("shot_07.jpg",), ("shot_07.png",), ("shot_01.jpg",), ("shot_12.webp",), ("three.png",), ("z.png",)]


def user_uploads(s, d):
    x = tables.shots(s, d).select("plan_id", "shot_no", F.coalesce("search_query", F.lit("")).alias("search_query"))
    return C.user_uploads(x, s.createDataFrame(MANIFEST, "key string, name string"), s.createDataFrame(FILES, "name string"))


def dossier_round_trip(s, d):
    shots = tables.shots(s, d)
    cand = shots.where("search_query <> ''").select("plan_id", "shot_no", F.explode(F.sequence(F.lit(1), F.col("shot_no") % 3 + 1)).alias("ord"), F.lit("loc").alias("source"), F.col("search_query").alias("title"))
    return C.read_dossier(C.dossier_json(shots, cand))


def cache_put(s, d):
    x = tables.shots(s, d).where("search_query <> ''").select(F.col("search_query").alias("query"), F.concat_ws("/", "plan_id", F.col("shot_no").cast("string")).alias("best"), "shot_no")
    old = x.where("shot_no < 8").groupBy("query").agg(F.min("best").alias("best")).withColumn("at", F.lit(1))
    new = x.where("shot_no >= 8").groupBy("query").agg(F.max("best").alias("best")).withColumn("at", F.lit(2))
    from quire.functions import text as T

    return C.cache_put(old.select(T.query_hash(F.col("query")).alias("query_hash"), "query", "best", "at"), new)


def winner_sources(s, d):
    b = C.best(_candidates(s, d), ["shot_no"]).select("shot_no", "source")
    shots = tables.shots(s, d)
    plan = shots.select("plan_id", "shot_no").join(b, "shot_no")
    return C.winners(plan, shots)


def genre_tone(s, d):
    genres = [(g,) for g in (*C.TONES, "poetry", None)]
    dim = F.broadcast(s.createDataFrame(list(C.TONES.items()), "genre string, tone string"))  # seven rows
    return s.createDataFrame(genres, "genre string").join(dim, "genre", "left").select("genre", F.coalesce("tone", F.lit(C.TONES["non-fiction"])).alias("tone"))


def quality_gate(s, d):
    x = t(s, d, "documents").where("text IS NOT NULL")
    sc = lambda i: F.when(_nibble(i, 5) > 0, _nibble(i, 11))
    return C.quality_gate(x.select(F.col("doc_id").alias("id"), F.length("text").alias("n_words"), sc(1).alias("hook"), sc(2).alias("structure"), sc(3).alias("pacing"), sc(4).alias("clarity"), sc(5).alias("tone")))


def render_jobs(s, d):
    return C.render_jobs(tables.shots(s, d).where("start IS NOT NULL AND `end` IS NOT NULL"))


def ken_burns(s, d):
    return C.ken_burns_effects(tables.shots(s, d).where("start IS NOT NULL"))


# --------------------------------------------------------------------------------------------------- SQL


def _n(i: int, mod: int) -> str:
    return f"((instr('0123456789abcdef', md5(CAST(doc_id AS VARCHAR))[{i}]) - 1) % {mod})"


_UN = f"{_n(6, 8)} = 0"
_CAND = f"""cand AS (SELECT CAST(doc_id % 97 AS INTEGER) AS shot_no, doc_id AS ord, ['loc', 'wikimedia', 'internet_archive', 'pexels'][{_n(5, 4)} + 1] AS source, coalesce(title, '') AS title, CAST(doc_id % 7 AS INTEGER) AS query_no,
  CAST(CASE WHEN {_UN} THEN -1 ELSE {_n(1, 4)} END AS INTEGER) AS ss, CAST(CASE WHEN {_UN} THEN -1 ELSE {_n(2, 4)} END AS INTEGER) AS sq, CAST(CASE WHEN {_UN} THEN -1 ELSE {_n(3, 4)} END AS INTEGER) AS sc,
  CAST({_n(7, 16)} * 100 AS INTEGER) AS width, CAST({_n(8, 16)} * 100 AS INTEGER) AS height, CASE WHEN {_n(9, 4)} = 0 THEN 'image/gif' WHEN {_n(9, 4)} = 1 THEN 'video/mp4' ELSE 'image/jpeg' END AS mime FROM documents),
rk AS (SELECT *, CASE WHEN ss >= 0 THEN ss + sq + sc ELSE -1 END AS total FROM cand WHERE ss < 0 OR (ss + sq + sc >= 4 AND ss >= 1)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY shot_no ORDER BY CASE WHEN ss >= 0 THEN -total ELSE 99 END, CASE WHEN ss >= 0 THEN -ss ELSE 0 END, CASE WHEN ss >= 0 THEN -sq ELSE 0 END, CASE WHEN ss >= 0 THEN -sc ELSE 0 END, ord) AS INTEGER) AS rank FROM rk)"""
_BIG = "starts_with(mime, 'image/') AND mime <> 'image/gif' AND width >= 400 AND height >= 400"
_KEY = "plan_id || '/' || shot_no"
_FR = "greatest(1, CAST(round_even((\"end\" - start) * 25, 0) AS INTEGER))"


def _rate(r: float) -> str:
    return f"printf('%.6f', CAST({r} AS DOUBLE) / f)"


ORACLE = {
    "candidate_rank": f"WITH {_CAND} SELECT shot_no, ord, source, total, rank FROM ranked",
    "candidate_best": f"WITH {_CAND} SELECT shot_no, ord, source FROM ranked WHERE rank = 1",
    "candidate_filter": f"WITH {_CAND} SELECT ord, width, height, mime FROM cand WHERE {_BIG}",
    "limit_per_source": f"WITH {_CAND} SELECT shot_no, source, ord FROM cand WHERE {_BIG} QUALIFY row_number() OVER (PARTITION BY shot_no, source ORDER BY ord) <= 2",
    "limit_total": f"WITH {_CAND} SELECT shot_no, query_no, ord FROM cand QUALIFY row_number() OVER (PARTITION BY shot_no ORDER BY query_no, ord) <= 5",
    "candidate_labels": f"WITH {_CAND} SELECT shot_no, ord, source || ':' || chr(CAST(96 + row_number() OVER (PARTITION BY shot_no, source ORDER BY ord) AS INTEGER)) AS label FROM cand QUALIFY row_number() OVER (PARTITION BY shot_no, source ORDER BY ord) <= 26",
    "source_union": f"WITH {_CAND} SELECT CAST(list_position(['loc', 'wikimedia', 'internet_archive', 'pexels'], source) - 1 AS INTEGER) AS source_no, source, count(*) AS n, count(DISTINCT shot_no) AS n_shots FROM cand GROUP BY ALL",
    "closest_width": f"WITH {_CAND} SELECT shot_no, arg_min(ord, {{'a': abs(width - 1280), 'b': ord}}) AS ord FROM cand WHERE width > 0 GROUP BY shot_no",
    "waterfall": f"""SELECT key, CASE WHEN via IS NOT NULL THEN via || '/' || key END AS path, via FROM (SELECT {_KEY} AS key, CASE WHEN shot_no % 11 = 0 THEN 'dossier' WHEN shot_no % 5 = 0 THEN 'user' WHEN shot_no % 4 = 0 THEN 'book'
  WHEN shot_no % 3 = 0 THEN 'cache' WHEN shot_no % 2 = 0 THEN 'web' END AS via FROM {SHOTS})""",
    "dossier_resolution": f"""SELECT shot_no, CASE via WHEN 'override' THEN 'o' || shot_no WHEN 'pinned' THEN 'p1' WHEN 'chosen' THEN 'c' || shot_no END AS path, via
FROM (SELECT doc_id AS shot_no, CASE WHEN {_n(1, 4)} = 0 AND {_n(3, 2)} = 0 THEN 'override' WHEN {_n(4, 2)} = 0 THEN 'pinned' WHEN {_n(2, 2)} = 0 AND {_n(3, 3)} > 0 THEN 'chosen' END AS via FROM documents)""",
    "user_uploads": f"""
WITH x AS (SELECT plan_id, shot_no, coalesce(search_query, '') AS q FROM {SHOTS}), f AS {values(FILES, 'name')}, m AS (SELECT * FROM {values(MANIFEST, 'key, name')} SEMI JOIN f USING (name)),
n AS (SELECT regexp_extract(name, '^shot_(\\d+)', 1) AS n, min(name) AS name FROM f WHERE regexp_matches(name, '^shot_\\d+\\.(jpg|jpeg|png|webp|tif|tiff)$') GROUP BY 1)
SELECT plan_id, shot_no, coalesce(a.name, b.name, n.name) AS path, CASE WHEN a.name IS NOT NULL THEN 'number' WHEN b.name IS NOT NULL THEN 'query' WHEN n.name IS NOT NULL THEN 'name' END AS via
FROM x LEFT JOIN m a ON a.key = CAST(shot_no AS VARCHAR) LEFT JOIN m b ON b.key = 'query:' || q LEFT JOIN n ON n.n = printf('%02d', shot_no)""",
    "dossier_round_trip": f"SELECT plan_id, shot_no, coalesce(visual, '') AS visual, coalesce(search_query, '') AS query, CASE WHEN search_query <> '' THEN shot_no % 3 + 1 ELSE 0 END AS n_candidates FROM {SHOTS}",
    "cache_put": f"""
WITH x AS (SELECT search_query AS query, {_KEY} AS best, shot_no FROM {SHOTS} WHERE search_query <> ''), o AS (SELECT query, min(best) AS best FROM x WHERE shot_no < 8 GROUP BY query), n AS (SELECT query, max(best) AS best FROM x WHERE shot_no >= 8 GROUP BY query)
SELECT sha256(query)[:16] AS query_hash, query, coalesce(n.best, o.best) AS best, CASE WHEN n.best IS NOT NULL THEN 2 ELSE 1 END AS "at" FROM o FULL JOIN n USING (query)""",
    "winner_sources": f"WITH {_CAND} SELECT coalesce(r.source, '(none)') AS source, count(*) AS n FROM {SHOTS} s LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r USING (shot_no) GROUP BY 1",
    "genre_tone": f"SELECT g.genre, coalesce(tone, '{C.TONES['non-fiction']}') AS tone FROM {values([(g,) for g in (*C.TONES, 'poetry', None)], 'genre')} g LEFT JOIN {values(list(C.TONES.items()), 'genre, tone')} t ON g.genre = t.genre",
    "quality_gate": "SELECT id, total, total >= 35 AND n BETWEEN 625 AND 850 AS accepted FROM (SELECT doc_id AS id, length(text) AS n, CAST("
    + " + ".join(f"CASE WHEN {_n(i, 5)} > 0 THEN {_n(i, 11)} ELSE 5 END" for i in range(1, 6))
    + " AS INTEGER) AS total FROM documents WHERE text IS NOT NULL)",
    "render_jobs": f"""WITH x AS (SELECT *, {_FR} AS f, coalesce(visual IN ('title_card', 'section_mark', 'chapter_heading', 'typography'), false) AS typo FROM {SHOTS} WHERE "end" - start > 0)
SELECT plan_id, shot_no, CASE WHEN typo THEN 'card' ELSE 'image' END AS asset, CASE WHEN visual IN ('title_card', 'section_mark', 'chapter_heading') THEN visual WHEN visual = 'typography' THEN coalesce(nullif(typography_template, ''), 'statement') END AS template,
  f AS frames, CASE WHEN NOT typo THEN CASE motion WHEN 'zoom_in' THEN 'min(pzoom+' || {_rate(0.08)} || ',1.08)' WHEN 'zoom_out' THEN 'if(lte(on,1),1.08,max(1.0,pzoom-' || {_rate(0.08)} || '))'
  WHEN 'fast_push' THEN 'min(pzoom+' || {_rate(0.20)} || ',1.20)' WHEN 'pan_right' THEN '1.10' WHEN 'pan_left' THEN '1.10' WHEN 'ken_burns' THEN 'min(pzoom+' || {_rate(0.12)} || ',1.12)' END END AS zoom FROM x""",
    "ken_burns": f"""SELECT plan_id, shot_no, ['zoom_in', 'zoom_out', 'pan_right', 'pan_left'][(row_number() OVER (PARTITION BY plan_id ORDER BY start, shot_no) - 1) % 4 + 1] AS effect,
  CASE section_id WHEN 'opening' THEN 'warm' WHEN 'closing' THEN 'cool' ELSE 'neutral' END AS grade FROM {SHOTS} WHERE start IS NOT NULL""",
}
QUERIES = {k: globals()[k] for k in ORACLE}
