"""Layout decisions on small tables: line runs, rules, boxes and text spans of pages. Everything is windows and filters."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_sorted, kind

PAGE = ("book_id", "page_no")


def ink_runs(rows: DataFrame, key: str, y: str, level: Column) -> DataFrame:
    """Runs of consecutive rows that ``level`` holds for: ``(key, y0, y1)``."""
    w = Window.partitionBy(key).orderBy(y)
    x = rows.where(level).withColumn("__g", F.col(y) - F.row_number().over(w))
    return x.groupBy(key, "__g").agg(F.min(y).alias("y0"), F.max(y).alias("y1")).drop("__g")


def cluster_rows(rows: DataFrame, key: str, y: str, gap: int = 2, thickest: int = 12) -> DataFrame:
    """Rows at most ``gap`` apart as one group; groups over ``thickest`` rows are no rules: ``(key, y0, y1, y_mid)``."""
    w = Window.partitionBy(key).orderBy(y)
    x = rows.withColumn("__n", F.when(F.col(y) - F.lag(y).over(w) <= gap, 0).otherwise(1)).withColumn("__g", F.sum("__n").over(w))
    g = x.groupBy(key, "__g").agg(F.min(y).alias("y0"), F.max(y).alias("y1"))
    return g.where(F.col("y1") - F.col("y0") + 1 <= thickest).select(key, "y0", "y1", F.floor((F.col("y0") + F.col("y1")) / 2).cast("long").alias("y_mid"))


def moving_average(rows: DataFrame, key: str, y: str, value: str, k: int) -> DataFrame:
    """Mean of the k values around each, zeros beyond the ends: ``(key, y, smooth)``; k is odd."""
    w = Window.partitionBy(key).orderBy(y).rowsBetween(-(k // 2), k // 2)
    return rows.select(key, y, (F.sum(value).over(w) / k).alias("smooth"))


def upper_median(values: Column) -> Column:
    """Of an even number the upper of the two in the middle."""
    s = F.sort_array(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def margins(runs: DataFrame, rules: DataFrame, pad_top: int = 20, pad_bottom: int = 20) -> DataFrame:
    """``(book_id, page_no, header0, header1, footer0, footer1, rule_y, keep_top, keep_bottom, band0, band1)`` of each page.

    ``runs``: (book_id, page_no, height, y0, y1, width_frac); ``rules``: (book_id, page_no, y). Short runs at an edge are
    scanner streaks. The first run is the header, the last the footer, if it lies in its band, is narrow or low and stands
    apart; a rule under two lines or more of body takes the footer's place."""
    w = Window.partitionBy(*PAGE).orderBy("y0")
    page = Window.partitionBy(*PAGE)
    h = F.col("height")
    tall = F.col("y1") - F.col("y0") + 1
    streak = ((F.col("y0") <= 2) | (F.col("y1") >= h - 3)) & (tall <= F.greatest(F.lit(3), F.floor(h * 0.012)))
    x = runs.where(~streak).withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(page))
    x = x.withColumn("gap", F.lead("y0").over(w) - F.col("y1")).withColumn("gap_before", F.col("y0") - F.lag("y1").over(w))
    mid = x.groupBy(*PAGE).agg(upper_median(F.collect_list("gap")).alias("gaps"), upper_median(F.collect_list("width_frac")).alias("mid_width"))
    x = x.join(mid, list(PAGE)).withColumn("mid_gap", F.when(F.col("n") >= 3, F.col("gaps")).otherwise(F.greatest(F.lit(8), F.floor(h * 0.012))))
    small = (F.col("width_frac") < F.col("mid_width") * 0.6) | (tall < F.floor(h * 0.04))
    apart = lambda g: F.coalesce(g, h) >= F.greatest(F.floor(F.col("mid_gap") * 0.6), F.lit(20))
    x = x.withColumn("head", (F.col("i") == 1) & (F.col("y0") <= F.floor(h * 0.12)) & small & apart(F.col("gap")))
    x = x.withColumn("header1", F.max(F.when(F.col("head"), F.col("y1"))).over(page)).withColumn("header0", F.max(F.when(F.col("head"), F.col("y0"))).over(page))
    body = x.where("NOT head")
    b = Window.partitionBy(*PAGE)
    body = body.withColumn("m", F.count("*").over(b)).withColumn("j", F.row_number().over(b.orderBy("y0")))
    foot = (F.col("j") == F.col("m")) & (F.col("y1") >= F.floor(h * (1 - 0.12))) & small & apart(F.when(F.col("m") >= 2, F.col("gap_before")))
    body = body.withColumn("foot", foot)
    top = body.groupBy(*PAGE).agg(F.max("height").alias("height"), F.max("header0").alias("header0"), F.max("header1").alias("header1"), F.min("y0").alias("first_y"), F.max("y1").alias("last_y"),
                                  F.max(F.when(~F.col("foot"), F.col("y1"))).alias("last_body"), F.max(F.when(F.col("foot"), F.col("y0"))).alias("f0"), F.max(F.when(F.col("foot"), F.col("y1"))).alias("f1"))
    r = rules.join(top.select(*PAGE, "height", "header1", "first_y"), list(PAGE)).where(F.col("y") > F.coalesce("header1", "first_y") + F.greatest(F.floor(F.col("height") * 0.05), F.lit(50)))
    above = r.join(body.select(*PAGE, "y1"), list(PAGE)).where("y1 < y").groupBy(*PAGE, "y").agg(F.count("*").alias("above")).where("above >= 2")
    rule = above.groupBy(*PAGE).agg(F.min("y").alias("rule_y"))
    t = top.join(rule, list(PAGE), "left")
    no_rule = F.col("rule_y").isNull()
    t = t.withColumn("footer0", F.when(no_rule, F.col("f0"))).withColumn("footer1", F.when(no_rule, F.col("f1")))
    last = F.when(no_rule & F.col("f0").isNotNull(), F.coalesce("last_body", F.col("height") - 1)).otherwise(F.col("last_y"))
    first = F.when(no_rule & F.col("f0").isNotNull() & F.col("last_body").isNull(), 0).otherwise(F.col("first_y"))
    keep_top = F.greatest(F.coalesce(F.col("header1") + 4, F.lit(0)), first - pad_top)
    bound = F.coalesce(F.col("rule_y") - 12, F.col("footer0") - 4, F.col("height") - 1)
    t = t.withColumn("keep_top", keep_top).withColumn("keep_bottom", F.greatest(F.col("keep_top") + 1, F.least(bound, last + pad_bottom)))
    band0, band1 = footer_band(F.col("rule_y"), F.col("footer0"), F.col("footer1"), F.col("height"))
    return t.select(*PAGE, "header0", "header1", "footer0", "footer1", "rule_y", "keep_top", "keep_bottom", F.when(band1 > band0, band0).alias("band0"), F.when(band1 > band0, band1).alias("band1"))


def page_margin(runs: list[tuple[int, int, float]], rules: list[int], h: int, pad_top: int = 20, pad_bottom: int = 20) -> tuple | None:
    """``margins`` of one page's runs and rules, without the page's key; None where that has no row."""
    x = [r for r in runs if not ((r[0] <= 2 or r[1] >= h - 3) and r[1] - r[0] + 1 <= max(3, floor(h * 0.012)))]
    if not x:
        return None
    gaps = [b[0] - a[1] for a, b in zip(x, x[1:], strict=False)]
    widths = sorted(r[2] for r in x)
    mid_gap = sorted(gaps)[len(gaps) // 2] if len(x) >= 3 else max(8, floor(h * 0.012))
    least = max(floor(mid_gap * 0.6), 20)
    small = lambda r: r[2] < widths[len(x) // 2] * 0.6 or r[1] - r[0] + 1 < floor(h * 0.04)
    header0 = header1 = footer0 = footer1 = last_body = None
    body = x
    if x[0][0] <= floor(h * 0.12) and small(x[0]) and (gaps[0] if gaps else h) >= least:
        (header0, header1, _), body = x[0], x[1:]
    if not body:
        return None
    first, last = body[0][0], max(r[1] for r in body)
    foot = body[-1][1] >= floor(h * (1 - 0.12)) and small(body[-1]) and (gaps[-1] if len(body) >= 2 else h) >= least
    above = (header1 if header1 is not None else first) + max(floor(h * 0.05), 50)
    rule = min((y for y in rules if y > above and sum(r[1] < y for r in body) >= 2), default=None)
    if rule is None and foot:
        footer0, footer1, _ = body[-1]
        last_body = max((r[1] for r in body[:-1]), default=None)
        last = last_body if last_body is not None else h - 1
        first = first if last_body is not None else 0
    keep_top = max(header1 + 4 if header1 is not None else 0, first - pad_top)
    bound = rule - 12 if rule is not None else footer0 - 4 if footer0 is not None else h - 1
    band0 = band1 = None
    if rule is not None:
        band0, band1 = max(0, rule - 8), h - max(3, floor(h * 0.012)) - 1
    elif footer0 is not None:
        band0, band1 = max(0, footer0 - 8), min(h - 1, footer1 + 8)
    if band0 is not None and band1 <= band0:
        band0 = band1 = None
    return header0, header1, footer0, footer1, rule, keep_top, max(keep_top + 1, min(bound, last + pad_bottom)), band0, band1


def footer_band(rule: Column, f0: Column, f1: Column, height: Column, pad: int = 8) -> tuple[Column, Column]:
    """First and last row of the footer's picture; null without a footer."""
    a = F.when(rule.isNotNull(), F.greatest(F.lit(0), rule - pad)).when(f0.isNotNull(), F.greatest(F.lit(0), f0 - pad))
    z = F.when(rule.isNotNull(), height - F.greatest(F.lit(3), F.floor(height * 0.012)) - 1).when(f0.isNotNull(), F.least(height - 1, f1 + pad))
    return a, z


def photos(boxes: DataFrame) -> DataFrame:
    """Boxes that are photos by area, fill, least side and aspect, with their reading order ``ord`` within the page."""
    area = F.col("area") / (F.col("height") * F.col("width"))
    lo, hi = F.least("w", "h"), F.greatest("w", "h")
    ok = area.between(0.02, 0.85) & (F.col("area") / (F.col("w") * F.col("h")) >= 0.35) & (lo / F.least("width", "height") >= 0.10) & (hi / F.greatest(lo, F.lit(1)) <= 4.0)
    row = F.floor(F.col("y") / F.greatest(F.lit(1), F.floor(F.col("height") / 20)))
    return boxes.where(ok).withColumn("ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy(row, "x", "y", "w", "h")))


def line_art(boxes: DataFrame) -> DataFrame:
    """Boxes that are drawings: large, not thin, and with little ink (``fill``)."""
    area = F.col("area") / (F.col("height") * F.col("width"))
    return boxes.where(area.between(0.05, 0.90) & (F.least("w", "h") / F.least("width", "height") >= 0.15) & (F.col("fill") <= 0.06))


def caption_reach(boxes: DataFrame, reach: int = 600) -> DataFrame:
    """How far below each photo its caption may be sought: to the next photo that shares a fifth of its columns:
    ``(book_id, page_no, ord, until)``."""
    o = boxes.select(*PAGE, F.col("ord").alias("o2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("w").alias("w2"))
    share = F.greatest(F.lit(0), F.least(F.col("x2") + F.col("w2"), F.col("x") + F.col("w")) - F.greatest("x2", "x"))
    j = boxes.join(o, list(PAGE), "left")
    hit = (F.col("o2") != F.col("ord")) & (share >= F.least("w2", "w") * 0.2) & (F.col("y2") > F.col("y") + F.col("h"))
    end = F.least(F.col("height"), F.col("y") + F.col("h") + reach)
    return j.groupBy(*PAGE, "ord").agg(F.min(F.least(end, F.when(hit, F.col("y2")))).alias("until"))


def padded(boxes: DataFrame, pad: int) -> DataFrame:
    """Boxes with a border of ``pad`` pixels, within the page: ``(book_id, page_no, ord, x0, y0, x1, y1)``."""
    return boxes.select(*PAGE, "ord", F.greatest(F.lit(0), F.col("x") - pad).alias("x0"), F.greatest(F.lit(0), F.col("y") - pad).alias("y0"), F.least("width", F.col("x") + F.col("w") + pad).alias("x1"), F.least("height", F.col("y") + F.col("h") + pad).alias("y1"))


def is_caption_density(d: Column) -> Column:
    return (d > 0.005) & (d < 0.50)


# ------------------------------------------------------------------------------------------------- spans


def visual_lines(spans: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Text spans of right-to-left pages put into lines: ``(page, line_no, text)``.

    A span belongs to the open line if its height differs by at most ``tolerance`` from the line's FIRST span (a fold over the
    spans from the top); within a line spans run from right to left, spans of marks alone half a step later."""
    mark = F.col("text").rlike(r"^[ً-ْٰ\s]+$")
    right = F.col("x_right") - F.when(mark, 5.0).otherwise(0.0)
    x = spans.select("page", F.col("y").cast("double").alias("y"), F.col("span").cast("int").alias("span"), right.cast("double").alias("r"), F.col("text").alias("t"))

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        page, y, span, r, t = row
        first, line = state or (None, 0)
        if first is None or abs(y - first) > tolerance:
            first, line = y, line + 1
        return (first, line), [(page, line, r, span, t)]

    rows = fold_sorted(x, ["page"], ["y", "span"], f"page {kind(x, 'page')}, line int, r double, span int, t string", step)
    parts = F.sort_array(F.collect_list(F.struct((-F.col("r")).alias("k"), F.col("span"), F.col("t"))))
    return rows.groupBy("page", F.col("line").alias("line_no")).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))


def host_letters(chars: DataFrame) -> DataFrame:
    """Each vowel mark of a span with the nearest letter: ``(page, span, c, host)``; of two equally near the first."""
    mark = F.col("c").rlike(r"^[ً-ْٰ]$")
    m = chars.where(mark).select("page", "span", "i", "c", F.col("ox").alias("mx"))
    b = chars.where(~mark).select("page", "span", F.col("i").alias("bi"), F.col("c").alias("host"), "ox")
    j = m.join(b, ["page", "span"])
    return j.groupBy("page", "span", "i", "c").agg(F.min_by("host", F.struct(F.abs(F.col("mx") - F.col("ox")), "bi")).alias("host")).drop("i")
