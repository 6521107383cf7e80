"""Lines of pages: classes of furniture, footnotes that go on, and text without them.

A page's lines are exploded once; what depends on neighbouring lines are windows over one page. Pages of one book form a
chain (a footnote may go on on the next page), which is a fold over two booleans a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

D = T.DIGIT
MARKER = rf"^[(\[{{]\s*[{D}؟?]\s*[)\]}}]"
REVERSED = rf"^[)\]}}]\s*[{D}؟?]\s*[(\[{{]"
NEW_MARKER = rf"^[(\[{{]\s*[{D}]\s*[)\]}}]|^[)\]}}]\s*[{D}]\s*[(\[{{]"
#: Lines that a footnote runs on after its marker, at most.
REACH = 14


def page_number_conf(s: Column) -> Column:
    return (
        F.when(s.rlike("^(?:[٠-٩]+|[۰-۹]+)$"), 0.95).when(s.rlike("^[0-9]+$"), 0.90).when(s.rlike(rf"^[-–—\s]*[{D}]+[-–—\s]*$"), 0.85).when(s.rlike(rf"صفحة?\s*[{D}]+"), 0.90)
    )


def footnote_conf(s: Column) -> Column:
    """Of a stripped line without marks of direction."""
    return (
        F.when(s.rlike(MARKER), 0.95).when(s.rlike(REVERSED), 0.90).when(s.rlike(r"^[*†‡§¶#+\-–—―]"), 0.85).when(s.rlike(r"^[ء-ي]\)"), 0.70)
        .when((F.length(s) < 50) & s.rlike("انظر|راجع|هامش"), 0.60)
    )


def separator_conf(s: Column) -> Column:
    return F.when(s.rlike("^[-_*=—–]+$"), 0.90).when(s.rlike(rf"^[-_*=—–\s]*[{D}]+[-_*=—–\s]*$"), 0.75)


def header_conf(s: Column) -> Column:
    return F.when((s != "") & (F.length(s) < 60) & ~s.rlike("[.،:؛]") & s.rlike(f"مقدمة|فصل|كتاب|ذكريات|مذكرات|مدكرات|[{D}]"), 0.80)


def explode_lines(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """``(book_id, page_no, line_no, line, n_lines)``, lines numbered from 0; null texts have none."""
    arr = F.split(text, "\n")
    more = [c for c in ("versions",) if c in pages.columns]
    return pages.where(F.col(text).isNotNull()).select("book_id", "page_no", *more, F.size(arr).alias("n_lines"), F.posexplode(arr).alias("line_no", "line"))


def classify_lines(pages: DataFrame) -> DataFrame:
    """``(book_id, page_no, line_no, footer_type, confidence, text)``: a row for each class that a line has.

    ``pages`` are a book's pages in the order of ``page_no``. A page behind one with a line that a footnote could go on from is
    taken twice, with and without such a footnote, and the fold over the book's pages picks one of the two. Texts are shuffled
    once, by book; every window and grouping that follows finds its rows there.
    """
    may_go_on = F.coalesce(T.strip_bidi(F.col("raw_text")).rlike(f"(?dm)(?:=| [-–—―]){T.WS}*$"), F.lit(False))
    before_it = F.coalesce(F.lag(may_go_on).over(Window.partitionBy("book_id").orderBy("page_no")), F.lit(False))
    once = pages.where("raw_text IS NOT NULL").select("book_id", "page_no", "raw_text")
    once = once.withColumn("versions", F.when(before_it, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    top = F.greatest(F.lit(1), F.floor(F.col("n_lines") * F.lit(0.15)).cast("int"))
    bottom = F.least(F.col("n_lines") - 1, F.floor(F.col("n_lines") * F.lit(1 - 0.15)).cast("int"))
    base = (
        explode_lines(once).withColumn("s", T.strip(F.col("line"))).withColumn("c", T.strip(T.strip_bidi(F.col("line"))))
        .withColumn("in_top", F.col("line_no") < top).withColumn("in_bottom", F.col("line_no") >= bottom).withColumn("blank", F.col("s") == "")
        .withColumn("is_new", F.coalesce(T.strip_bidi(F.col("s")).rlike(NEW_MARKER), F.lit(False)))
        .withColumn("pending", F.explode("versions"))
    )
    page = Window.partitionBy("book_id", "page_no", "pending")
    upto = page.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = page.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    # a footnote of the page before goes on at the first such line of the bottom region
    crosses = F.col("pending") & F.col("in_bottom") & F.col("c").rlike("^=|^[-–—―][ \t]")
    base = base.withColumn("cross_at", F.min(F.when(crosses, F.col("line_no"))).over(page))
    after = F.col("line_no") > F.col("cross_at")
    base = base.withColumn("cross_stop", F.min(F.when(after & (F.col("blank") | F.col("is_new")), F.col("line_no"))).over(page))
    is_cross = F.coalesce((F.col("line_no") >= F.col("cross_at")) & (F.col("line_no") <= F.col("cross_at") + REACH) & (F.col("cross_stop").isNull() | (F.col("line_no") < F.col("cross_stop"))), F.lit(False))
    base = base.withColumn("cross", is_cross)
    free = ~F.col("blank") & ~F.col("cross")
    foot, number, sep = footnote_conf(F.col("c")), page_number_conf(F.col("s")), separator_conf(F.col("s"))
    base = base.withColumn("low", F.when(free & F.col("in_bottom"), F.when(foot.isNotNull(), F.struct(F.lit("footnote").alias("t"), foot.alias("p"))).when(number.isNotNull(), F.struct(F.lit("page_number").alias("t"), number.alias("p"))).when(sep.isNotNull(), F.struct(F.lit("separator").alias("t"), sep.alias("p")))))
    base = base.withColumn("high", F.when(free & F.col("in_top"), header_conf(F.col("s"))))
    flagged = F.col("cross") | F.col("low").isNotNull() | F.col("high").isNotNull()
    base = base.withColumn("mid", ~flagged & ~F.col("blank") & (F.col("c").rlike(MARKER) | F.col("c").rlike(REVERSED)))
    base = base.withColumn("already", flagged | F.col("mid"))
    # lines after a marker go with it until something stops them
    is_note = F.col("cross") | F.col("mid") | (F.coalesce(F.col("low.t") == "footnote", F.lit(False)))
    stops = F.col("blank") | (~F.col("already") & (F.col("is_new") | ((F.length("s") >= 120) & F.col("s").endswith("."))))
    base = base.withColumn("marker", F.max(F.when(is_note, F.col("line_no"))).over(before)).withColumn("stop", F.max(F.when(stops, F.col("line_no"))).over(upto))
    runs_on = ~F.col("already") & (F.col("line_no") - F.col("marker") <= REACH) & (F.col("stop").isNull() | (F.col("stop") <= F.col("marker")))
    base = base.withColumn("cont", F.coalesce(runs_on, F.lit(False)))
    row = lambda t, p, x: F.struct(F.lit(t).alias("footer_type"), p.cast("double").alias("confidence"), x.alias("text"))
    none = F.array().cast("array<struct<footer_type:string,confidence:double,text:string>>")
    header_numbers = F.transform(T.inline_numbers(F.col("line")), lambda n: F.struct(F.lit("page_number").alias("footer_type"), n["confidence"].alias("confidence"), n["number"].alias("text")))
    rows = F.concat(
        F.when(F.col("cross"), F.array(row("footnote", F.when(F.col("line_no") == F.col("cross_at"), 0.80).otherwise(0.70), F.when(F.col("line_no") == F.col("cross_at"), F.col("c")).otherwise(F.col("s"))))).otherwise(none),
        F.when(F.col("low").isNotNull(), F.array(F.struct(F.col("low.t").alias("footer_type"), F.col("low.p").cast("double").alias("confidence"), F.col("s").alias("text")))).otherwise(none),
        F.when(F.col("high").isNotNull(), F.concat(F.array(row("running_header", F.col("high"), F.col("s"))), header_numbers)).otherwise(none),
        F.when(F.col("mid"), F.array(row("footnote", F.lit(0.88), F.col("s")))).otherwise(none),
        F.when(F.col("cont"), F.array(row("footnote", F.lit(0.60), F.col("s")))).otherwise(none),
    )
    goes_on = F.coalesce((is_note | F.col("cont")) & F.when(F.col("cross") & (F.col("line_no") == F.col("cross_at")), F.col("c")).otherwise(F.col("s")).rlike(r"=$| [-–—―]$"), F.lit(False))
    found = base.select("book_id", "page_no", "pending", "line_no", rows.alias("rows"), goes_on.alias("goes_on"))
    chosen = _pending_pages(found)
    hit = found.where(F.size("rows") > 0).join(chosen, ["book_id", "page_no", "pending"])
    return hit.select("book_id", "page_no", "line_no", F.explode("rows").alias("r")).select("book_id", "page_no", "line_no", "r.*")


def _pending_pages(found: DataFrame) -> DataFrame:
    """Which of its two versions each page takes: whether the page before left a footnote open."""
    per = found.groupBy("book_id", "page_no").agg(F.bool_or(~F.col("pending") & F.col("goes_on")).alias("off"), F.bool_or(F.col("pending") & F.col("goes_on")).alias("on"))
    # a page that leaves the same state whatever the one before settles it; after it, pages that turn it over count
    book = Window.partitionBy("book_id").orderBy("page_no")
    before = book.rowsBetween(Window.unboundedPreceding, -1)
    settles, turns = F.col("off") == F.col("on"), (F.col("off") & ~F.col("on")).cast("int")
    x = per.withColumn("turned", F.sum(turns).over(book.rowsBetween(Window.unboundedPreceding, 0)))
    last = lambda c: F.last(F.when(settles, c), ignorenulls=True).over(before)
    since = F.coalesce(F.lag("turned").over(book), F.lit(0)) - F.coalesce(last(F.col("turned")), F.lit(0))
    return x.select("book_id", "page_no", (F.coalesce(last(F.col("off")), F.lit(False)) != (since % 2 == 1)).alias("pending"))


def strip_lines(pages: DataFrame, classes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages' texts without the lines that have a class not in ``keep``: ``(book_id, page_no, text, n_stripped)``."""
    gone = classes.where(~F.col("footer_type").isin(*keep)) if keep else classes
    gone = gone.groupBy("book_id", "page_no").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("raw_text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return pages.where("raw_text IS NOT NULL").join(gone, ["book_id", "page_no"], "left").select(
        "book_id", "page_no", F.array_join(kept, "\n").alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_stripped")
    )


def footer_report(classes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One report line a class row, in order: ``(book_id, page_no, line_no, entry)``."""
    status = F.when(F.col("footer_type").isin(*keep) if keep else F.lit(False), "PRESERVED").otherwise("STRIPPED")
    return classes.select("book_id", "page_no", "line_no", F.format_string("  [%s] (conf: %.2f) %s: %s", "footer_type", "confidence", status, F.substring("text", 1, 60)).alias("entry"))


def footer_counts(classes: DataFrame) -> DataFrame:
    kinds = ("footnote", "page_number", "separator", "running_header")
    return classes.groupBy("book_id").agg(*(F.count_if(F.col("footer_type") == k).alias(k) for k in kinds), F.count_distinct("page_no").alias("n_pages"))


def header_words(pages: DataFrame, script: str = r"؀-ۿ", least: int = 2) -> DataFrame:
    """Words of ``script`` on the first non-blank line (of at most 60 characters) of ``least`` pages or more of a book."""
    words = (
        pages.where("raw_text IS NOT NULL").select("book_id", "page_no", T.first_line(F.col("raw_text")).alias("s")).where(F.length("s") <= 60)
        .select("book_id", "page_no", F.explode(F.regexp_extract_all("s", F.lit(f"[{script}]+"), F.lit(0))).alias("word"))
    )
    return words.groupBy("book_id", "word").agg(F.count_distinct("page_no").alias("n_pages")).where(F.col("n_pages") >= least)


def pages_without_headers(pages: DataFrame, least: int = 2) -> DataFrame:
    """First lines all of whose words are header words are dropped: ``(book_id, page_no, header, n_words)``."""
    hw = header_words(pages, least=least)
    first = pages.where("raw_text IS NOT NULL").select("book_id", "page_no", T.first_line(F.col("raw_text")).alias("header")).where(F.length("header") <= 60)
    word = first.select("book_id", "page_no", "header", F.explode(F.regexp_extract_all("header", F.lit(r"[؀-ۿ]+"), F.lit(0))).alias("word"))
    known = word.join(hw.select("book_id", "word"), ["book_id", "word"], "left_semi").groupBy("book_id", "page_no").agg(F.count("*").alias("known"))
    all_ = word.groupBy("book_id", "page_no", "header").agg(F.count("*").alias("n_words"))
    return all_.join(known, ["book_id", "page_no"]).where("known = n_words").select("book_id", "page_no", "header", "n_words")


def boundaries(pages: DataFrame) -> DataFrame:
    """Neighbouring pages' ends: the last two and the first three non-blank lines: ``(book_id, page_no, tail, next_page, head)``."""
    ls = F.filter(T.splitlines(F.col("raw_text")), lambda s: T.strip(s) != "")
    w = Window.partitionBy("book_id").orderBy("page_no")
    p = pages.where("pdf_type = 'scanned'").where(T.strip(F.col("raw_text")) != "").withColumn("ls", ls)
    tail, head = F.array_join(F.slice("ls", F.greatest(F.size("ls") - 1, F.lit(1)), F.lit(2)), "\n"), F.array_join(F.slice("ls", 1, 3), "\n")
    out = p.select("book_id", "page_no", tail.alias("tail"), head.alias("own")).withColumn("next_page", F.lead("page_no").over(w)).withColumn("head", F.lead("own").over(w))
    return out.where("next_page IS NOT NULL").select("book_id", "page_no", "tail", "next_page", "head")


def blank_header(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """Blank the first line that holds its page's header text or lies in it: ``(book_id, page_no, line_no, line)`` of each."""
    lines = explode_lines(pages).withColumn("s", T.strip(F.col("line"))).where("s <> ''")
    hit = lines.join(headers, ["book_id", "page_no"]).where("contains(s, header) OR contains(header, s)")
    return hit.groupBy("book_id", "page_no").agg(F.min("line_no").alias("line_no"), F.min_by("line", "line_no").alias("line"))
