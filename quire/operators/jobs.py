"""What media tools are to do, as rows: motion expressions, trims, cross-fades, thumbnails, muxes, and subtitle styles.

A row holds the arguments; running the tool is left to whoever has it. Nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

from .candidates import motion

# How a tool is told to scale, encode and burn in; expressions of its pan filter.
CENTRE_X, CENTRE_Y = "iw/2-(iw/zoom/2)", "ih/2-(ih/zoom/2)"
FIT = "scale={w}:{h}:force_original_aspect_ratio=decrease,pad={w}:{h}:(ow-iw)/2:(oh-ih)/2,format=yuv420p"
TRIM = ("-c:v", "libx264", "-preset", "ultrafast", "-crf", "26", "-an")
FADE = ("-map", "[vout]", "-c:v", "libx264", "-preset", "fast", "-crf", "23", "-pix_fmt", "yuv420p")
BURN = ("-c:v", "libx264", "-preset", "fast", "-crf", "22", "-pix_fmt", "yuv420p")
SOUND = ("-c:a", "aac", "-b:a", "192k", "-shortest")


def _args(*parts: str | Column) -> Column:
    return F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def pan_x(name: Column, frames: Column) -> Column:
    """The x expression of a motion over so many frames: pans travel half the buffer, ken_burns 0.3 of it, zooms stay centred."""
    n = frames.cast("string")
    right = lambda share: F.concat(F.lit(f"if(lte(on,1),0,min(x+(iw*{share})/"), n, F.lit(",iw-iw/zoom))"))
    return (
        F.when(name == "pan_right", right("0.5")).when(name == "ken_burns", right("0.3"))
        .when(name == "pan_left", F.concat(F.lit("if(lte(on,1),iw-iw/zoom,max(0,x-(iw*0.5)/"), n, F.lit("))"))).when(name.isin("zoom_in", "zoom_out", "fast_push"), CENTRE_X)
    )


def motion_jobs(shots: DataFrame, fps: int = 25) -> DataFrame:
    """Zoom and pan of each moving shot: ``(plan_id, shot_no, frames, z, x, y)``; shots without a known motion have none."""
    d = F.col("end") - F.col("start")
    frames = F.greatest(F.lit(1), F.rint(d * fps).cast("int"))
    x = shots.where(d > 0).select("plan_id", "shot_no", frames.alias("frames"), "motion").where(F.col("motion").isin("zoom_in", "zoom_out", "fast_push", "pan_right", "pan_left", "ken_burns"))
    return x.select("plan_id", "shot_no", "frames", motion(F.col("motion"), F.col("frames")).alias("z"), pan_x(F.col("motion"), F.col("frames")).alias("x"), F.lit(CENTRE_Y).alias("y"))


def trim_jobs(clips: DataFrame, width: int = 1280, height: int = 720) -> DataFrame:
    """Arguments that cut a clip to its length and fit it into the frame: ``(plan_id, shot_no, args)``.

    ``clips``: (plan_id, shot_no, path, start, seconds); a clip without a length has no job."""
    fit = FIT.format(w=width, h=height)
    args = _args("-ss", F.format_string("%.3f", "start"), "-i", F.col("path"), "-t", F.format_string("%.3f", "seconds"), "-vf", fit, *TRIM)
    return clips.where("seconds > 0 AND path IS NOT NULL").select("plan_id", "shot_no", args.alias("args"))


def fade_graphs(clips: DataFrame, fade: float = 1.0) -> DataFrame:
    """The chain of cross-fades that joins a plan's clips: ``(plan_id, n_clips, graph, args)``; a single clip is copied.

    ``clips``: (plan_id, shot_no, seconds), in the order of the numbers. A plan's graph is one argument by nature."""
    w = Window.partitionBy("plan_id").orderBy("shot_no")
    at = F.sum(F.col("seconds") - fade).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = clips.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("plan_id"))).withColumn("at", F.greatest(F.lit(0.0), at))
    before = F.when(F.col("i") == 1, "0:v").otherwise(F.concat(F.lit("v"), (F.col("i") - 1).cast("string")))
    name = F.when(F.col("i") == F.col("n") - 1, "vout").otherwise(F.concat(F.lit("v"), F.col("i").cast("string")))
    part = F.concat(F.lit("["), before, F.lit("]["), F.col("i").cast("string"), F.lit(f":v]xfade=transition=fade:duration={fade}:offset="), F.format_string("%.3f", "at"), F.lit("["), name, F.lit("]"))
    parts = F.sort_array(F.collect_list(F.when(F.col("i") > 0, F.struct("i", part.alias("p")))))
    graph = F.array_join(F.transform(parts, lambda p: p["p"]), ";")
    g = x.groupBy("plan_id").agg(F.count("*").alias("n_clips"), graph.alias("graph"))
    args = F.when(F.col("n_clips") > 1, _args("-filter_complex", F.col("graph"), *FADE)).otherwise(_args("-c", "copy"))
    return g.select("plan_id", "n_clips", "graph", args.alias("args"))


def thumbnail_args(path: Column, seconds: float = 2.0) -> Column:
    return _args("-ss", str(seconds), "-i", path, "-vframes", "1", "-q:v", "3")


def mux_jobs(plans: DataFrame) -> DataFrame:
    """Arguments that put picture, sound and subtitles together: ``(plan_id, args)``.

    ``plans``: (plan_id, video, audio, subtitles, seconds). The picture is copied unless subtitles are burnt in; without sound
    there is none; a positive length caps the file."""
    sub = F.replace(F.replace(F.col("subtitles"), F.lit("\\"), F.lit("/")), F.lit(":"), F.lit("\\:"))
    none = F.array().cast("array<string>")
    args = F.concat(
        _args("-i", F.col("video")), F.when(F.col("audio").isNotNull(), _args("-i", F.col("audio"))).otherwise(none),
        F.when(sub.isNotNull(), _args("-vf", F.concat(F.lit("ass="), sub), *BURN)).otherwise(_args("-c:v", "copy")),
        F.when(F.col("audio").isNotNull(), _args(*SOUND)).otherwise(_args("-an")),
        F.when(F.col("seconds") > 0, _args("-t", F.format_string("%.3f", "seconds"))).otherwise(none),
    )
    return plans.where("video IS NOT NULL").select("plan_id", args.alias("args"))


def style_sizes(height: Column) -> dict[str, Column]:
    """Font sizes and margins of the five subtitle styles by the picture's height."""
    part = lambda least, by: F.greatest(F.lit(least), F.floor(height / by).cast("int"))
    title, sub = part(72, 9), part(44, 16)
    return {
        "title_size": title, "title_sub_size": sub, "title_sub_margin": title + sub + 20, "section_size": part(52, 13), "phrase_size": part(62, 11), "phrase_margin": part(80, 7),
        "caption_size": part(48, 14), "caption_margin": part(40, 18),
    }


def dialogue(start: Column, end: Column, style: Column, text: Column) -> Column:
    """One subtitle event of a style; it lasts half a second at least."""
    e = F.greatest(start + 0.5, end)
    return F.concat(F.lit("Dialogue: 0,"), T.ass_time(start), F.lit(","), T.ass_time(e), F.lit(","), style, F.lit(",,0,0,0,,"), T.ass_escape(text))


def overlay_events(sections: DataFrame, overlays: DataFrame, key: str) -> DataFrame:
    """Events of the overlay styles: ``(key, kind, ord, event)``.

    ``sections``: (key, begin, title, author, label, phrases array<string>); ``overlays``: (key, kind, ord, start, end) from a
    section's own beginning. A title has its author's name below it, where there is one."""
    x = overlays.join(sections, key)
    style = F.when(F.col("kind") == "title", "TitleCard").when(F.col("kind") == "mark", "SectionMark").otherwise("KeyPhrase")
    text = F.when(F.col("kind") == "title", F.col("title")).when(F.col("kind") == "mark", F.col("label")).otherwise(T.strip(F.get("phrases", F.col("ord"))))
    at = F.col("begin")
    one = F.struct("kind", "ord", dialogue(at + F.col("start"), at + F.col("end"), style, text).alias("event"))
    two = F.when((F.col("kind") == "title") & (F.col("author") != ""), F.struct(F.lit("author").alias("kind"), "ord", dialogue(at + F.col("start"), at + F.col("end"), F.lit("TitleSub"), F.col("author")).alias("event")))
    return x.where(text != "").select(key, F.inline(F.array_compact(F.array(one, two))))


def archive_rows(raw: DataFrame, source: str, n: int = 3) -> DataFrame:
    """Search answers of an archive as candidates ``(query, ord, url, title, license, source)``, the first ``n`` of each query.

    loc: (query, ord, image_urls, rights, title), the last URL, the one before where that is a thumbnail, licences checked;
    internet_archive: (query, ord, identifier, license, title), the derived picture; pexels: (query, ord, large2x, large,
    original, title), the largest there is. URLs without a scheme get one; titles are cut to 120 characters, as the archives'."""
    urls = F.col("image_urls") if source == "loc" else None
    if source == "loc":
        https = lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
        last = https(F.element_at(urls, -1))
        small = F.lower(last).rlike("thumb|150|200") & (F.size(urls) > 1)
        free = F.lower("rights").rlike("no known|public domain")
        rights = F.when(free, "PD").otherwise(F.substring(F.coalesce("rights", F.lit("")), 1, 30))
        x = raw.where(F.size("image_urls") > 0).select("query", "ord", F.when(small, https(F.try_element_at(urls, F.lit(-2)))).otherwise(last).alias("url"), "title", rights.alias("license"))
        x = x.where(T.is_free_license(F.col("license"))).withColumn("license", F.when(F.col("license") == "", "PD").otherwise(F.col("license")))
    elif source == "internet_archive":
        i = F.col("identifier")
        url = F.concat(F.lit("https://archive.org/download/"), i, F.lit("/"), i, F.lit(".jpg"))
        x = raw.where(F.coalesce(i, F.lit("")) != "").select("query", "ord", url.alias("url"), "title", F.coalesce(F.nullif(F.substring("license", 1, 30), F.lit("")), F.lit("PD")).alias("license"))
    else:
        first = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("large2x", "large", "original")))
        x = raw.select("query", "ord", first.alias("url"), "title", F.lit("Pexels License").alias("license")).where("url IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("query").orderBy("ord"))
    x = x.withColumn("__k", k).where(F.col("__k") <= n)
    return x.select("query", "ord", "url", F.substring(F.coalesce("title", F.lit("Untitled")), 1, 120).alias("title"), "license", F.lit(source).alias("source"))
