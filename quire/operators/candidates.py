"""Image candidates of shots: filters, ranking, waterfall of sources, dossiers and the result cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# Genres and the tone of their scripts; default non-fiction.
TONES = {
    "non-fiction": "تحليلية رصينة، واضحة وموضوعية",
    "history": "سردية تاريخية، تستحضر الأحداث بحيوية",
    "biography": "إنسانية دافئة، تُبرز شخصية البطل",
    "novel": "أدبية رشيقة، تثير المشاعر وتستدعي الخيال",
    "philosophy": "تأملية عميقة، تُبسّط الأفكار دون إخلال بثرائها",
    "science": "علمية ميسّرة، تربط المفاهيم بالحياة اليومية",
    "religion": "روحية هادئة، تجمع بين العلم والإيمان",
}
#: Scores of a candidate that could not be scored: neither kept out nor preferred.
NEUTRAL = (2, 2, 1)
FIRST_PATHS = ("override", "pinned", "chosen")


def scored() -> Column:
    return (F.col("score_subject") >= 0) & (F.col("score_quality") >= 0) & (F.col("score_cinematic") >= 0)


def total_score() -> Column:
    return F.when(scored(), F.col("score_subject") + F.col("score_quality") + F.col("score_cinematic")).otherwise(-1)


def passes() -> Column:
    """Unscored candidates pass; others need 4 in all and 1 for the subject."""
    return ~scored() | ((total_score() >= 4) & (F.col("score_subject") >= 1))


def big_enough(least: int = 400) -> Column:
    """Bitmaps (no gif) of known size at least ``least`` pixels both ways."""
    return F.col("mime").startswith("image/") & (F.col("mime") != "image/gif") & (F.col("width") >= least) & (F.col("height") >= least)


def rank(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """With ``rank`` from 1: best total first, then subject, quality, cinematic; unscored last; ties in the given order."""
    by = lambda c: F.when(scored(), -F.col(c)).otherwise(0)
    order = [F.when(scored(), -total_score()).otherwise(99), by("score_subject"), by("score_quality"), by("score_cinematic"), F.col("ord")]
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def limit_per_source(candidates: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` of each source that pass the filters, in order: a search's own limit after over-fetching."""
    w = Window.partitionBy(*keys, "source").orderBy("ord")
    return candidates.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def limit_total(candidates: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` of a key over its queries in order."""
    w = Window.partitionBy(*keys).orderBy("query_no", "ord")
    return candidates.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def pooled(sources: list[DataFrame]) -> DataFrame:
    """Candidates of all sources in the order of the list, with ``source_no``."""
    out = [s.withColumn("source_no", F.lit(i)) for i, s in enumerate(sources)]
    whole = out[0]
    for s in out[1:]:
        whole = whole.unionByName(s)
    return whole


def labels(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """``label``: a, b, c … z within a key's source, from the 27th on its number counted from 0: 26, 27 …"""
    k = F.row_number().over(Window.partitionBy(*keys, "source").orderBy("ord")) - 1
    return candidates.withColumn("label", F.concat("source", F.lit(":"), F.when(k < 26, F.char(F.lit(97) + k)).otherwise(k.cast("string"))))


def resolve_dossier(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """``(shot_no, path, via)``: override, then the pinned portrait (for portraits), then the chosen file; each only if it exists."""
    have = files.select("path")
    out = decisions
    for name, ok in (("override", F.lit(True)), ("pinned", F.col("visual") == "portrait"), ("chosen", F.lit(True))):
        f = have.select(F.col("path").alias(f"__{name}"))
        out = out.join(f, F.when(ok, F.col(name)) == F.col(f"__{name}"), "left")
    found = [F.col(f"__{n}") for n in FIRST_PATHS]
    via = F.when(found[0].isNotNull(), "override").when(found[1].isNotNull(), "pinned").when(found[2].isNotNull(), "chosen")
    return out.select("shot_no", F.coalesce(*found).alias("path"), via.alias("via"))


def waterfall(shots: DataFrame, steps: list[tuple[str, DataFrame]], key: str = "shot_no") -> DataFrame:
    """``(key, path, via)``: the first step that has a path for the shot; ``steps``: name and (key, path), one path a shot."""
    out, paths = shots.select(key), []
    for name, df in steps:
        out = out.join(df.select(key, F.col("path").alias(f"__{name}")), key, "left")
        paths.append((name, F.col(f"__{name}")))
    via = F.lit(None).cast("string")
    for name, c in reversed(paths):
        via = F.when(c.isNotNull(), name).otherwise(via)
    return out.select(key, F.coalesce(*(c for _, c in paths)).alias("path"), via.alias("via"))


def user_uploads(shots: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``(plan_id, shot_no, path, via)`` of every plan's shots: by number, by query, then by a file's name shot_NN; only files
    that exist.

    ``manifest``: (key, name), keys like "5" or "query:…"; ``files``: (name)."""
    have = manifest.join(files, "name", "left_semi")
    by_no = have.select(F.col("key").alias("__k"), F.col("name").alias("__no"))
    by_q = have.select(F.col("key").alias("__q"), F.col("name").alias("__query"))
    named = files.where(F.col("name").rlike(r"^shot_\d+\.(jpg|jpeg|png|webp|tif|tiff)$")).select(F.regexp_extract("name", r"^shot_(\d+)", 1).alias("__n"), "name").groupBy("__n").agg(F.min("name").alias("__file"))
    x = (
        shots.select("plan_id", "shot_no", "search_query").join(by_no, F.col("shot_no").cast("string") == F.col("__k"), "left")
        .join(by_q, F.concat(F.lit("query:"), "search_query") == F.col("__q"), "left").join(named, F.format_string("%02d", "shot_no") == F.col("__n"), "left")
    )
    via = F.when(F.col("__no").isNotNull(), "number").when(F.col("__query").isNotNull(), "query").when(F.col("__file").isNotNull(), "name")
    return x.select("plan_id", "shot_no", F.coalesce("__no", "__query", "__file").alias("path"), via.alias("via"))


def best(candidates: DataFrame, keys: list[str]) -> DataFrame:
    return rank(candidates.where(passes()), keys).where("rank = 1").drop("rank")


def dossier_json(shots: DataFrame, candidates: DataFrame) -> DataFrame:
    """A plan's dossier as JSON: shots by number with their candidates in order: ``(plan_id, document)``."""
    c = candidates.groupBy("plan_id", "shot_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "source", "title"))), lambda x: F.struct(x["source"].alias("source"), x["title"].alias("title"))).alias("candidates"))
    s = shots.join(c, ["plan_id", "shot_no"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<struct<source:string,title:string>>")))
    entry = F.struct(F.col("shot_no").cast("string").alias("k"), F.struct("visual", F.col("search_query").alias("query"), "candidates").alias("v"))
    return s.groupBy("plan_id").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.map_from_entries(F.collect_list(entry)).alias("shots"))).alias("document"))


DOSSIER = "version int, shots map<string,struct<visual:string,query:string,candidates:array<struct<source:string,title:string>>>>"


def read_dossier(documents: DataFrame) -> DataFrame:
    """``(plan_id, shot_no, visual, query, n_candidates)`` from dossiers; missing fields get their defaults."""
    j = documents.select("plan_id", F.from_json("document", DOSSIER).alias("j")).select("plan_id", F.explode("j.shots").alias("k", "v"))
    return j.select("plan_id", F.col("k").cast("int").alias("shot_no"), F.coalesce("v.visual", F.lit("")).alias("visual"), F.coalesce("v.query", F.lit("")).alias("query"), F.size(F.coalesce("v.candidates", F.array())).alias("n_candidates"))


CANDIDATE = "struct<source:string,title:string,url:string,file:string,score:int,score_breakdown:struct<subject:int,quality:int,cinematic:int>,vision_reason:string,width:int,height:int,license_short:string>"
DECISIONS = (
    "version int, pinned_portrait string, book struct<title:string,character:string>, shots map<string,struct<visual:string,query:string,duration_sec:double,arabic_caption_excerpt:string,"
    f"chosen:string,chosen_url:string,chosen_file:string,override:string,candidates:array<{CANDIDATE}>>>"
)
#: Fields of a shot's decision and what is read where one is missing; a missing override stays null.
_DECIDED = (("visual", ""), ("query", ""), ("duration_sec", 0.0), ("arabic_caption_excerpt", ""), ("chosen", ""), ("chosen_url", ""), ("chosen_file", ""))


def decisions_json(shots: DataFrame, candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """Whole dossiers: ``(plan_id, document)``. ``shots``: plan_id, shot_no and fields of a decision; ``candidates``: plan_id,
    shot_no, ord and fields of a candidate; ``plans``: plan_id and pinned_portrait. Fields that aren't given are left out."""
    fields = [c for c in candidates.columns if c not in ("plan_id", "shot_no", "ord")]
    c = candidates.groupBy("plan_id", "shot_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct(*fields).alias("c")))), lambda x: x["c"]).alias("candidates"))
    entry = F.struct(F.col("shot_no").cast("string").alias("k"), F.struct(*(n for n in shots.columns if n not in ("plan_id", "shot_no")), "candidates").alias("v"))
    s = shots.join(c, ["plan_id", "shot_no"], "left").groupBy("plan_id").agg(F.map_from_entries(F.collect_list(entry)).alias("shots"))
    return s.join(plans, "plan_id", "left").select("plan_id", F.to_json(F.struct(F.lit(1).alias("version"), "pinned_portrait", "shots")).alias("document"))


def read_decisions(documents: DataFrame) -> DataFrame:
    """A row a shot with all fields of its decision and its plan's ``pinned_portrait``; missing fields get their defaults."""
    j = documents.select("plan_id", F.from_json("document", DECISIONS).alias("j")).select("plan_id", "j.pinned_portrait", F.explode("j.shots").alias("k", "v"))
    kept = [F.coalesce(F.col("v")[n], F.lit(d)).alias(n) for n, d in _DECIDED]
    return j.select("plan_id", F.col("k").cast("int").alias("shot_no"), *kept, F.col("v.override").alias("override"), "pinned_portrait", F.coalesce("v.candidates", F.array().cast(f"array<{CANDIDATE}>")).alias("candidates"))


def cache_put(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache with ``results`` in place of entries of the same query: (query_hash, query, best, at)."""
    new = results.withColumn("query_hash", T.query_hash(F.col("query"))).withColumn("__new", F.lit(1))
    both = cache.withColumn("__new", F.lit(0)).unionByName(new.select(*cache.columns, "__new"))
    return both.groupBy("query_hash").agg(F.max_by(F.struct("query", "best", "at"), F.struct("__new", "at")).alias("r")).select("query_hash", "r.*")


def winners(best_rows: DataFrame, shots: DataFrame) -> DataFrame:
    """Winners by source, and shots without: ``(source, n)``."""
    j = shots.select("plan_id", "shot_no").join(best_rows.select("plan_id", "shot_no", "source"), ["plan_id", "shot_no"], "left")
    return j.groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count("*").alias("n"))


def quality_gate(scripts: DataFrame) -> DataFrame:
    """``(id, total, accepted)``: five scores (5 where one is missing) of 35 in all and 625 to 850 words."""
    crit = ("hook", "structure", "pacing", "clarity", "tone")
    total = sum((F.coalesce(F.col(c), F.lit(5)) for c in crit), F.lit(0))
    return scripts.select("id", total.alias("total"), ((total >= 35) & F.col("n_words").between(625, 850)).alias("accepted"))


def motion(name: Column, frames: Column) -> Column:
    """The zoom expression of a motion over so many frames.

    Halves of the last digit fall as the rate's binary value does: 0.12 is a little below, the others above their decimals."""
    rate = lambda r: F.format_string("%.6f", F.lit(r) / frames)
    return (
        F.when(name == "zoom_in", F.concat(F.lit("min(pzoom+"), rate(0.08), F.lit(",1.08)")))
        .when(name == "zoom_out", F.concat(F.lit("if(lte(on,1),1.08,max(1.0,pzoom-"), rate(0.08), F.lit("))")))
        .when(name == "fast_push", F.concat(F.lit("min(pzoom+"), rate(0.20), F.lit(",1.20)")))
        .when(name.isin("pan_right", "pan_left"), "1.10")
        .when(name == "ken_burns", F.concat(F.lit("min(pzoom+"), rate(0.12 - 1e-12), F.lit(",1.12)")))
    )


def render_jobs(shots: DataFrame, fps: int = 25) -> DataFrame:
    """What an encoder is to do for each shot: ``(plan_id, shot_no, asset, template, frames, zoom)``.

    Typography kinds draw a card of their own template, image kinds move; a shot without a length has no job."""
    d = F.col("end") - F.col("start")
    typo = F.coalesce(F.col("visual").isin("title_card", "section_mark", "chapter_heading", "typography"), F.lit(False))
    template = F.when(F.col("visual").isin("title_card", "section_mark", "chapter_heading"), F.col("visual")).when(F.col("visual") == "typography", F.coalesce(F.nullif("typography_template", F.lit("")), F.lit("statement")))
    frames = F.greatest(F.lit(1), F.rint(d * fps).cast("int"))
    return shots.where(d > 0).select("plan_id", "shot_no", F.when(typo, "card").otherwise("image").alias("asset"), template.alias("template"), frames.alias("frames"), F.when(~typo, motion(F.col("motion"), frames)).alias("zoom"))


def ken_burns_effects(shots: DataFrame) -> DataFrame:
    """Effects in turn by a clip's place, and the grade of its section: ``(plan_id, shot_no, effect, grade)``."""
    k = F.row_number().over(Window.partitionBy("plan_id").orderBy("start", "shot_no")) - 1
    effect = F.element_at(F.array(*map(F.lit, ("zoom_in", "zoom_out", "pan_right", "pan_left"))), (k % 4 + 1).cast("int"))
    grade = F.when(F.col("section_id") == "opening", "warm").when(F.col("section_id") == "closing", "cool").otherwise("neutral")
    return shots.select("plan_id", "shot_no", effect.alias("effect"), grade.alias("grade"))
