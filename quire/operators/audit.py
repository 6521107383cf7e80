"""Audit of shot plans: statistics, gaps, histograms, split fragments, typography."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def plan_stats(shots: DataFrame) -> DataFrame:
    """``(plan_id, n, plan_start, plan_end, total, avg, shortest, longest)``; shots without both times are left out."""
    d = F.col("end") - F.col("start")
    at = F.col("shot_no")
    return shots.where("start IS NOT NULL AND `end` IS NOT NULL").groupBy("plan_id").agg(
        F.count("*").alias("n"), F.min_by("start", at).alias("plan_start"), F.max_by("end", at).alias("plan_end"), F.round(F.sum(d), 4).alias("total"), F.round(F.avg(d), 9).alias("avg"),
        F.round(F.min(d), 6).alias("shortest"), F.round(F.max(d), 6).alias("longest"),
    )


def gaps_overlaps(shots: DataFrame, slack: float = 0.05) -> DataFrame:
    """``(plan_id, n_gaps, n_overlaps, gap, overlap)`` between shots in the order of their numbers, sums in seconds."""
    w = Window.partitionBy("plan_id").orderBy("shot_no")
    delta = F.lead("start").over(w) - F.col("end")
    x = shots.where("start IS NOT NULL AND `end` IS NOT NULL").select("plan_id", delta.alias("d"))
    gap, over = F.col("d") > slack, F.col("d") < -slack
    return x.groupBy("plan_id").agg(F.count_if(gap).alias("n_gaps"), F.count_if(over).alias("n_overlaps"), F.round(F.coalesce(F.sum(F.when(gap, F.col("d"))), F.lit(0.0)), 4).alias("gap"), F.round(F.coalesce(F.sum(F.when(over, -F.col("d"))), F.lit(0.0)), 4).alias("overlap"))


def histogram(shots: DataFrame, column: str) -> DataFrame:
    """``(value, n, share, rank)`` of a column, the commonest first, of equally common ones the first seen (by plan and shot)."""
    g = shots.groupBy(F.coalesce(column, F.lit("(unknown)")).alias("value")).agg(F.count("*").alias("n"), F.min(F.struct("plan_id", "shot_no")).alias("first"))
    few = Window.partitionBy(F.lit(1))  # as many rows as kinds of value
    rank = F.row_number().over(few.orderBy(F.desc("n"), "first"))
    return g.select("value", "n", F.round(F.col("n") / F.sum("n").over(few), 6).alias("share"), rank.alias("rank"))


def split_fragments(shots: DataFrame) -> DataFrame:
    """``(plan_id, n, n_pieces, n_originals, implied, share, verdict)`` of shots that bear the mark of an automatic cut."""
    cut = F.col("note").contains("auto-split")
    base = F.when(cut, F.regexp_replace("note", r"(?s) \[auto-split.*$", ""))
    x = shots.groupBy("plan_id").agg(F.count("*").alias("n"), F.count_if(cut).alias("n_pieces"), F.count_distinct(base).alias("n_originals"))
    share = F.col("n_pieces") * 100.0 / F.col("n")
    return x.select("plan_id", "n", "n_pieces", "n_originals", (F.col("n") - F.col("n_pieces") + F.col("n_originals")).alias("implied"), F.round(share, 4).alias("share"), F.when(share < 20, "✓").when(share < 50, "⚠").otherwise("❌").alias("verdict"))


def typography_texts(shots: DataFrame) -> DataFrame:
    """Distinct typography texts of a plan, the first shot's of each: ``(plan_id, text, shot_no, template, n_words, n_shots)``."""
    t = T.strip(F.col("typography_text"))
    x = shots.where(t != "").withColumn("text", t)
    first = F.min_by(F.coalesce(F.nullif("typography_template", F.lit("")), F.lit("(none)")), F.col("shot_no"))
    return x.groupBy("plan_id", "text").agg(F.min("shot_no").alias("shot_no"), first.alias("template"), F.count("*").alias("n_shots")).withColumn("n_words", T.n_words(F.col("text")))


def verbatim(texts: DataFrame, scripts: DataFrame, key: str) -> DataFrame:
    """How each text stands in its key's script: ``(plan_id, shot_no, verdict, matched, n_words)``.

    verbatim: all its words in a row; partial: the longest beginning that occurs has 60 % of the words; else paraphrase. A text
    of n words is tested at its n beginnings; scripts are joined once per key."""
    words = lambda c: F.array_join(T.tokens(T.bare_arabic(c)), " ")
    s = scripts.select(key, words(F.col("script")).alias("hay"))
    q = texts.join(s, key).withColumn("q", T.tokens(T.bare_arabic(F.col("text")))).withColumn("n", F.size("q"))
    tests = F.transform(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), lambda k: F.when(F.contains(F.col("hay"), F.array_join(F.slice("q", F.lit(1), k), " ")), k).otherwise(0))
    m = F.when(F.col("n") == 0, 0).otherwise(F.array_max(tests))
    x = q.withColumn("matched", m)
    verdict = F.when(F.col("matched") == F.col("n"), "verbatim").when(F.col("matched") / F.col("n") >= 0.6, "partial").otherwise("paraphrase")
    return x.select("plan_id", "shot_no", verdict.alias("verdict"), "matched", F.col("n").alias("n_words"))


def query_quality(shots: DataFrame) -> DataFrame:
    """``(plan_id, n_queries, avg_words, n_bare)``; bare queries have one or two words."""
    n = T.n_words(F.col("search_query"))
    return shots.where(T.strip(F.col("search_query")) != "").groupBy("plan_id").agg(F.count("*").alias("n_queries"), F.round(F.avg(n), 6).alias("avg_words"), F.count_if(n <= 2).alias("n_bare"))


def plan_lines(shots: DataFrame) -> DataFrame:
    """One line a shot for reading: ``(plan_id, shot_no, line)``."""
    tag = F.when(F.coalesce("section_id", F.lit("")) != "", F.concat(F.lit("["), F.lpad("section_id", 9, " "), F.lit("]"))).otherwise("[         ]")
    extra = F.when(F.col("visual") == "typography", F.concat(F.lit('"'), F.substring("typography_text", 1, 50), F.lit('"'))).otherwise(F.substring("search_query", 1, 60))
    x = shots.where("start IS NOT NULL AND `end` IS NOT NULL")
    cents = lambda c: F.rint(F.col(c) * 100) / 100  # noqa: E731  # halves as they are in binary
    return x.select("plan_id", "shot_no", F.format_string("%3d. %s %6.2f-%6.2fs %-14s %s", "shot_no", tag, cents("start"), cents("end"), F.coalesce("visual", F.lit("")), F.coalesce(extra, F.lit(""))).alias("line"))


def image_manifest(shots: DataFrame) -> DataFrame:
    """Lines of the list of images that a plan needs: ``(plan_id, shot_no, line)``, shots that show an image only."""
    x = shots.where("start IS NOT NULL AND `end` IS NOT NULL AND visual IS NOT NULL").where(~F.col("visual").isin("title_card", "section_mark", "chapter_heading", "typography"))
    return x.select("plan_id", "shot_no", F.format_string('shot_%02d    %-14s%5.1fs    "%s"', "shot_no", "visual", F.rint((F.col("end") - F.col("start")) * 10) / 10, F.coalesce("search_query", F.lit(""))).alias("line"))
