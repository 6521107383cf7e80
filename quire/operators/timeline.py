"""Word timings and shot timelines: alignment, snapping, captions, sections, stitching, merging.

Joins of words and shots are never a product of the two: nearest anchors are found in one sorted pass (a union and two
windows), containment by buckets of time. Folds run over numbers only; what else a shot has is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

from .folds import fold_sorted, kind

#: Seconds of one bucket of the interval joins.
BUCKET = 16.0
# Longest holds in seconds by kind of visual.
CAPS = {"typography": 12.0, "portrait": 12.0, "archive": 10.0, "broll": 10.0, "location": 10.0, "object": 10.0, "section_mark": 7.0, "title_card": 7.0}
TYPOGRAPHY = ("title_card", "section_mark", "typography")
TYPOGRAPHY_SHOWN = ("title_card", "section_mark", "chapter_heading", "typography")
IMAGE_KINDS = ("portrait", "location", "object", "archive", "broll")


def lookup(key: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def word_timings(texts: DataFrame, key: str, ord_: str, seconds: float) -> DataFrame:
    """``(key, word_no, part, word, start, end)``: a key's texts, in order, spoken over ``seconds`` in proportion to letters.

    Times come from whole letter counts, so no rounding errors add up."""
    by = Window.partitionBy(key)
    w = by.orderBy(ord_, "i")
    x = texts.where("text IS NOT NULL").select(key, ord_, F.posexplode(T.tokens(F.col("text"))).alias("i", "word"))
    x = x.withColumn("n", F.greatest(F.length("word"), F.lit(1))).withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(by))
    at = lambda c: F.lit(seconds) * c / F.col("total")
    return x.select(key, (F.row_number().over(w) - 1).alias("word_no"), F.col(ord_).alias("part"), "word", at(F.col("upto") - F.col("n")).alias("start"), at(F.col("upto")).alias("end"))


def proportional_map(script: DataFrame, heard: DataFrame, key: str) -> DataFrame:
    """Each script word with the times of the heard words at its relative place: ``(key, word_no, word, start, end)``.

    ``script``: (key, word_no, word); ``heard``: (key, word_no, start, end). Keys without heard words have no rows."""
    s_n = F.count("*").over(Window.partitionBy(key))
    counts = heard.groupBy(key).agg(F.count("*").alias("n_heard"))
    x = script.select(key, "word_no", "word").withColumn("n", s_n).join(counts, key)
    at = lambda i: F.floor(i * F.col("n_heard") / F.col("n")).cast("int")
    lo = F.least(F.col("n_heard") - 1, at(F.col("word_no"))).cast("int")
    hi = F.greatest(lo + 1, F.least(F.col("n_heard"), at(F.col("word_no") + 1))).cast("int")
    x = x.withColumn("lo", lo).withColumn("hi", hi - 1)
    first, last = heard.select(key, F.col("word_no").alias("lo"), "start"), heard.select(key, F.col("word_no").alias("hi"), "end")
    return x.join(first, [key, "lo"]).join(last, [key, "hi"]).select(key, "word_no", "word", "start", "end")


def nearest(points: DataFrame, anchors: DataFrame, key: str, t: str, a: str) -> DataFrame:
    """``points`` with ``near``: the nearest anchor of the same key, of two equally near the earlier; null without anchors."""
    names = points.columns
    both = points.withColumn("__t", F.col(t)).withColumn("__a", F.lit(None).cast("double")).unionByName(
        anchors.select(key, F.col(a).alias("__t"), F.col(a).alias("__a")), allowMissingColumns=True
    )
    # two running frames, one from each end: a frame that begins at the row would be computed anew for every row
    by = Window.partitionBy(key)
    running = lambda *order: F.last("__a", ignorenulls=True).over(by.orderBy(*order).rangeBetween(Window.unboundedPreceding, 0))
    lo, hi = running("__t"), running(F.desc("__t"))
    both = both.withColumn("__lo", lo).withColumn("__hi", hi).where("__a IS NULL")
    near = F.when(F.col("__hi").isNull(), F.col("__lo")).when(F.col("__lo").isNull(), F.col("__hi")).when(F.col("__t") - F.col("__lo") <= F.col("__hi") - F.col("__t"), F.col("__lo")).otherwise(F.col("__hi"))
    return both.select(*names, near.alias("near"))


def snap(shots: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Shots with start and end moved to the nearest start and end of a word; at least 1.5 seconds long if they would be empty."""
    s = nearest(shots, words, key, "start", "start").withColumnRenamed("near", "__s")
    e = nearest(s, words, key, "end", "end").withColumnRenamed("near", "__e")
    start, end = F.coalesce("__s", "start"), F.coalesce("__e", "end")
    return e.withColumn("start", start).withColumn("end", F.when(F.col("__s").isNull(), F.col("end")).when(end <= F.col("start"), F.col("start") + 1.5).otherwise(end)).drop("__s", "__e")


def _buckets(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.floor(lo / BUCKET), F.greatest(F.floor(lo / BUCKET), F.floor(hi / BUCKET))))


def captions_of(shots: DataFrame, words: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """``(*ids, n_words, caption)``: the words spoken within each shot, with 0.05 seconds of slack."""
    s = shots.select(key, *ids, "start", "end").withColumn("b", _buckets(F.col("start") - 0.05, F.col("end") + 0.05))
    w = words.select(key, "word_no", "word", F.col("start").alias("ws"), F.col("end").alias("we")).withColumn("b", F.floor(F.col("ws") / BUCKET))
    hit = s.join(w, [key, "b"]).where((F.col("ws") >= F.col("start") - 0.05) & (F.col("we") <= F.col("end") + 0.05))
    return hit.groupBy(*ids).agg(F.count("*").alias("n_words"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "word"))), lambda x: x["word"]), " ").alias("caption"))


def section_ranges(words: DataFrame, key: str) -> DataFrame:
    """``(key, part, start, end, n_words)`` of each part of a key's words."""
    return words.groupBy(key, "part").agg(F.min_by("start", "word_no").alias("start"), F.max_by("end", "word_no").alias("end"), F.count("*").alias("n_words"))


def section_of(shots: DataFrame, ranges: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """``(*ids, part)``: the first part whose range holds the shot's midpoint; null for none."""
    mid = (F.col("start") + F.col("end")) / 2
    s = shots.select(key, *ids, mid.alias("mid")).withColumn("b", F.floor(F.col("mid") / BUCKET))
    r = ranges.select(key, "part", F.col("start").alias("rs"), F.col("end").alias("re")).withColumn("b", _buckets(F.col("rs"), F.col("re")))
    hit = s.join(r, [key, "b"]).where((F.col("rs") <= F.col("mid")) & (F.col("mid") <= F.col("re"))).groupBy(*ids).agg(F.min("part").alias("part"))
    return shots.select(*ids).join(hit, ids, "left")


def exclusive_fields(shots: DataFrame) -> DataFrame:
    """Typography kinds keep their text and lose their search query, all others the other way round."""
    typo, text = F.col("visual").isin(*TYPOGRAPHY), F.coalesce("typography_text", F.lit("")) != ""
    return shots.withColumns(
        {
            "search_query": F.when(typo, "").otherwise(F.col("search_query")),
            "typography_template": F.when(~F.coalesce(typo, F.lit(False)) & text, None).otherwise(F.col("typography_template")),
            "typography_text": F.when(~F.coalesce(typo, F.lit(False)) & text, "").otherwise(F.col("typography_text")),
        }
    )


def stitched(shots: DataFrame, totals: DataFrame) -> DataFrame:
    """A plan's shots as one timeline without gaps: ``(plan_id, shot_no, start, end)``.

    ``totals``: (plan_id, total). Shots from the total on are dropped, later ends cut; every start is the end before it, a
    shot left empty lasts 2 seconds; the last ends at the total. The fold's state is the shot before, its input numbers."""
    x = shots.where("start IS NOT NULL AND `end` IS NOT NULL").join(totals, "plan_id").where("start < total")
    x = x.select("plan_id", F.col("start").cast("double").alias("start"), "shot_no", F.least("end", "total").cast("double").alias("e"), F.col("total").cast("double").alias("total"))

    def step(last: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        plan, s, no, e, total = row
        if last is not None:
            s = last[3]
            if e <= s:
                e = s + 2.0
        return (plan, no, s, e, total), [last[:4]] if last else []

    # the last shot ends at the total
    return fold_sorted(x, ["plan_id"], ["start", "shot_no", "e"], f"plan_id {kind(x, 'plan_id')}, shot_no int, start double, end double", step, lambda r: [(*r[:3], r[4])])


def split_pieces(visual: Column, duration: Column, piece: float = 5.0) -> Column:
    """Into how many pieces a shot is cut: 1 within its kind's longest hold (and a tenth of a second)."""
    return F.when(duration <= lookup(visual, CAPS, 8.0) + 0.1, 1).otherwise(F.greatest(F.lit(2), F.rint(duration / piece).cast("int")))


def cut_long(timeline: DataFrame) -> DataFrame:
    """Shots over their longest hold in equal pieces: ``(plan_id, shot_no, piece, n_pieces, start, end)``."""
    d = F.col("end") - F.col("start")
    x = timeline.withColumn("n_pieces", split_pieces(F.col("visual"), d)).withColumn("d", d).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))))
    at = lambda k: F.col("start") + k * (F.col("d") / F.col("n_pieces"))
    return x.select("plan_id", "shot_no", "piece", "n_pieces", at(F.col("piece") - 1).alias("s"), at(F.col("piece")).alias("e")).withColumnsRenamed({"s": "start", "e": "end"})


def merge_adjacent(timeline: DataFrame) -> DataFrame:
    """Neighbours that show the same joined, with their captions:
    ``(plan_id, shot_no, start, end, visual, note, caption_text, n_merged)``.

    Pieces of a shot over its longest hold would be joined again at once, so such a shot only bears the mark of the cut."""
    w = Window.partitionBy("plan_id").orderBy("start", "shot_no")
    same = lambda c: F.coalesce(F.col(c), F.lit("")) == F.coalesce(F.lag(c).over(w), F.lit(""))
    joins = (F.abs(F.col("start") - F.lag("end").over(w)) <= 0.05) & same("visual") & same("search_query") & same("typography_text")
    n = split_pieces(F.col("visual"), F.col("end") - F.col("start"))
    note = F.when(n > 1, T.strip(F.concat(F.coalesce("note", F.lit("")), F.lit(" [auto-split 1/"), n.cast("string"), F.lit("]")))).otherwise(F.col("note"))
    x = timeline.withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(w)).withColumn("note", note)
    caps = F.transform(F.sort_array(F.collect_list(F.struct("start", "shot_no", F.coalesce("caption_text", F.lit("")).alias("c")))), lambda r: r["c"])
    text = F.aggregate(F.slice(caps, 2, 1 << 30), F.get(caps, F.lit(0)), lambda a, c: F.when((c != "") & (c != a), T.strip(F.concat(a, F.lit(" "), c))).otherwise(a))
    at = F.struct("start", "shot_no")
    return x.groupBy("plan_id", "island").agg(
        F.min_by("shot_no", at).alias("shot_no"), F.min("start").alias("start"), F.max_by("end", at).alias("end"), F.min_by("visual", at).alias("visual"),
        F.min_by("note", at).alias("note"), text.alias("caption_text"), F.count("*").alias("n_merged"),
    ).drop("island")


def target_shots(seconds: Column, each: Column) -> Column:
    """How many shots to plan: in proportion up to 180 seconds, then one in 5.5 seconds, from 8 to 65."""
    n = F.when(seconds <= 180, F.floor(seconds / each)).otherwise(F.floor(F.lit(180) / each) + F.floor((seconds - 180) / 5.5))
    return F.greatest(F.lit(8), F.least(F.lit(65), n.cast("int")))


def section_durations(sections: DataFrame, key: str, seconds: float) -> DataFrame:
    """``(key, part, seconds)``: ``seconds`` shared by letters, at least 5 for each part."""
    n = F.length(T.strip(F.col("text")))
    total = F.greatest(F.sum(n).over(Window.partitionBy(key)), F.lit(1))
    return sections.select(key, "part", F.greatest(F.lit(5.0), F.lit(seconds) * n / total).alias("seconds"))


def caption_events(shots: DataFrame) -> DataFrame:
    """Subtitle events of one style: ``(plan_id, shot_no, event)``; hidden, blank and typography shots have none."""
    s, e = F.col("start") + 0.05, F.col("end") - 0.05
    ok = shots.where(F.coalesce("show_caption", F.lit(False)) & (T.strip(F.col("caption_text")) != "") & ~F.coalesce(F.col("visual").isin(*TYPOGRAPHY_SHOWN), F.lit(False))).where(e > s)
    text = F.concat(F.lit("Dialogue: 0,"), T.ass_time(s), F.lit(","), T.ass_time(e), F.lit(",Caption,,0,0,0,,"), T.ass_escape(T.strip(F.col("caption_text"))))
    return ok.select("plan_id", "shot_no", text.alias("event"))


def caption_budget(blocks: DataFrame, key: str, least: float = 2.0, gap: float = 0.08) -> DataFrame:
    """Times of caption blocks within a section: ``(key, ord, start, end)``.

    ``blocks``: (key, ord, n_words, from, to). Each block gets its share of the time by words, at least ``least`` seconds and,
    but for that, none beyond the section; what no longer fits is left out."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    x = blocks.where(F.col("to") - F.col("from") > least).withColumn("n", n).withColumn("total", F.sum("n").over(Window.partitionBy(key, "from", "to")))
    x = x.select(key, F.col("from").cast("double").alias("b"), F.col("to").cast("double").alias("e"), "ord", "n", "total")

    def step(t: float | None, row: tuple) -> tuple[float, list[tuple]]:
        k, begin, end, no, words, total = row
        t = begin if t is None else t
        if t >= end:
            return t, []
        stop = max(min(t + max(least, (end - begin) * words / total) - gap, end - gap), t + least)
        return stop + gap, [(k, no, t, stop)]

    return fold_sorted(x, [key, "b", "e"], ["ord", "n"], f"{key} {kind(x, key)}, ord int, start double, end double", step)


def overlays(sections: DataFrame, key: str, title: float = 5.0, mark: float = 2.5, phrase: float = 3.5) -> DataFrame:
    """Title, section mark and key phrases one after the other: ``(key, kind, ord, start, end)``.

    ``sections``: (key, opening, seconds, n_phrases); times from the section's start. A mark stays a second within the section,
    phrases half a second; what would have no time is left out."""
    t0 = F.when(F.col("opening"), F.lit(title)).otherwise(F.lit(0.0))
    m = F.least(t0 + mark, F.col("seconds") - 1.0)
    t1 = F.when(m > t0, m).otherwise(t0)
    row = lambda k, o, s, e: F.struct(F.lit(k).alias("kind"), o.cast("int").alias("ord"), s.alias("start"), e.alias("end"))
    ph = F.when(F.col("n_phrases") > 0, F.transform(F.sequence(F.lit(0), F.col("n_phrases") - 1), lambda k: row("phrase", k, t1 + k * phrase, F.least(t1 + (k + 1) * phrase, F.col("seconds") - 0.5)))).otherwise(F.array())
    rows = F.concat(F.array(row("title", F.lit(0), F.lit(0.0), F.lit(title)), row("mark", F.lit(0), t0, m)), ph)
    kept = F.filter(rows, lambda r: (r["end"] > r["start"]) & ((r["kind"] != "title") | F.col("opening")))
    return sections.select(key, F.inline(kept))


def fade_offsets(clips: DataFrame, key: str, fade: float = 0.5) -> DataFrame:
    """Where each clip's cross-fade begins: the clips up to it, less a fade each: ``(key, shot_no, offset)``."""
    w = Window.partitionBy(key).orderBy("start", "shot_no")
    return clips.select(key, "shot_no", (F.sum(F.col("end") - F.col("start") - fade).over(w)).alias("offset"))
