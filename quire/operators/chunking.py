"""Sections, token-bounded pieces with overlap, and chunks of books.

Lines of a book are windows over (page, line); only the text of one section is ever put together, in one row. The greedy
packing is a fold inside Catalyst over a section's parts with the word count as state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

from .folds import fold_sorted, kind

MAX_TOKENS, OVERLAP_TOKENS, STUB_WORDS = 1500, 200, 8
SEPARATORS = ("\n\n", "\n", ".", "،", " ")


#: Marks that carry a line's page number through packing; they stand inside a word, so no count changes.
_PAGE_MARK = "\ue000(\\d+)\ue001"


def _marked(line: Column, page_no: Column) -> Column:
    """``line`` with its page's number before its first word; blank lines stay."""
    mark = F.concat(F.lit("\ue000"), page_no.cast("string"), F.lit("\ue001"))
    lead = F.regexp_extract(line, f"^{T.WS}*", 0)
    return F.when(T.strip(line) == "", line).otherwise(F.concat(lead, mark, F.substring(line, F.length(lead) + 1, F.length(line))))


def sections(pages: DataFrame, mark_pages: bool = False) -> DataFrame:
    """``(book_id, sec_no, chapter, text)``: text before the first heading is "intro", headings without a body go to the next
    section that has one, trailing ones to the last; a book without headings is "full_book". Blank pages are left out."""
    w = Window.partitionBy("book_id").orderBy("page_no", "line_no")
    lines = (
        pages.where(T.strip(F.col("raw_text")) != "").select("book_id", "page_no", F.posexplode(F.split("raw_text", "\n")).alias("line_no", "line"))
        .withColumn("is_head", T.is_heading(F.col("line"))).withColumn("h", F.sum(F.col("is_head").cast("int")).over(w))
    )
    if mark_pages:
        lines = lines.withColumn("line", _marked(F.col("line"), F.col("page_no")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_head"), F.struct("page_no", "line_no", "line")))), lambda x: x["line"]), "\n")
    heads = lines.groupBy("book_id", "h").agg(T.strip(body).alias("body"), T.strip(F.max(F.when(F.col("is_head"), F.col("line")))).alias("title"))
    by = Window.partitionBy("book_id").orderBy("h")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("book_id")
    real = (F.col("body") != "").cast("int")
    # section number: the sections that are complete before; trailing headings fall into the last one
    x = (
        heads.withColumn("n", F.coalesce(F.sum(real).over(before), F.lit(0))).withColumn("total", F.sum(real).over(all_))
        .where("h > 0 OR body <> ''").withColumn("trailing", (F.col("n") == F.col("total")))
        .withColumn("sec_no", F.when(F.col("trailing") & (F.col("total") > 0), F.col("total") - 1).otherwise(F.col("n")))
    )
    parts = F.when(F.col("h") == 0, F.array("body")).when(F.col("body") != "", F.array("title", "body")).otherwise(F.array("title"))
    text = F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("h", parts.alias("p")))), lambda y: y["p"])), "\n\n")
    chapter = F.max_by(F.coalesce("title", F.lit("intro")), F.when(~F.col("trailing"), F.col("h")))
    out = x.groupBy("book_id", "sec_no").agg(text.alias("text"), chapter.alias("chapter"), F.max("h").alias("last_h"), F.max("total").alias("total"))
    no_heads = (F.col("total") == 0) | ((F.col("last_h") == 0) & (F.count("*").over(all_) == 1))
    return out.select("book_id", F.col("sec_no").cast("int").alias("sec_no"), F.when(no_heads, "full_book").otherwise(F.col("chapter")).alias("chapter"), "text")


def pack(text: Column, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Column:
    """Pieces of a text within ``max_tokens``: parts between the first separator that occurs are packed greedily, each piece
    opening with the last int(overlap / 1.4) words of the one before. No overlap for 0. A part over the limit stays whole."""
    most, lap = int(max_tokens / 1.4), int(overlap_tokens / 1.4)

    def fold(sep: str) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

        def step(a: Column, part: Column) -> Column:
            cand = F.when(a["cur"] != "", F.concat(a["cur"], F.lit(sep), part)).otherwise(part)
            n = a["n"] + T.n_words(part)
            if not sep.isspace():  # a sign between two words makes them one, between two blanks it is one by itself
                blank = lambda c: (c == "") | c.rlike(T.WS)
                before, after = blank(F.right(a["cur"], F.lit(1))), blank(F.left(part, F.lit(1)))
                n = F.when(a["cur"] == "", T.n_words(part)).otherwise(n + F.when(before & after, 1).when(before | after, 0).otherwise(-1))
            ws = T.word_list(a["cur"])
            tail = F.array_join(F.slice(ws, F.greatest(F.size(ws) - lap + 1, F.lit(1)), F.lit(lap)), " ") if lap else F.lit("")
            fresh = F.when(tail != "", T.strip(F.concat(tail, F.lit(" "), part))).otherwise(part)
            new = lambda done, cur, k: F.struct(done.alias("done"), cur.alias("cur"), k.alias("n"))
            return F.when(n <= most, new(a["done"], cand, n)).when(a["cur"] != "", new(F.concat(a["done"], F.array(a["cur"])), fresh, T.n_words(fresh))).otherwise(new(a["done"], part, T.n_words(part)))

        end = lambda a: F.when(a["cur"] != "", F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"])
        return F.aggregate(F.split(text, "\\." if sep == "." else sep), start, step, end)

    out = F.when(T.token_est(T.n_words(text)) <= max_tokens, F.array(text))
    for sep in SEPARATORS:
        out = out.when(F.contains(text, F.lit(sep)), fold(sep))
    return out.otherwise(F.array(text))


def chunk_pages(pages: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, stub_words: int = STUB_WORDS, exact_pages: bool = False) -> DataFrame:
    """``(book_id, chunk_id, chapter, page_start, page_end, word_count, token_est, text)`` of every book.

    Pieces under ``stub_words`` words are put before the next real piece, trailing ones after the last. The page range
    of every chunk is the book's, or with ``exact_pages`` that of the pages whose lines it holds, its overlap's with them.
    """
    span = pages.where(T.strip(F.col("raw_text")) != "").groupBy("book_id").agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"))
    w = Window.partitionBy("book_id").orderBy("sec_no", "i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    p = (
        sections(pages, exact_pages).select("book_id", "sec_no", "chapter", F.posexplode(pack(F.col("text"), max_tokens, overlap_tokens)).alias("i", "piece"))
        .withColumn("piece", T.strip(F.col("piece"))).withColumn("real", (T.n_words(F.col("piece")) >= stub_words).cast("int"))
        .withColumn("n", F.coalesce(F.sum("real").over(before), F.lit(0))).withColumn("total", F.sum("real").over(Window.partitionBy("book_id")))
    )
    p = p.withColumn("trailing", F.col("n") == F.col("total")).withColumn("chunk_id", F.greatest(F.least(F.col("n"), F.col("total") - 1), F.lit(0)).cast("int"))
    pieces = F.sort_array(F.collect_list(F.struct("sec_no", "i", "piece")))
    text = F.array_join(F.transform(pieces, lambda x: x["piece"]), "\n\n")
    chapter = F.max_by("chapter", F.when(F.col("real") == 1, F.struct("sec_no", "i")))
    if exact_pages:  # a piece from the middle of a line is on the page of the piece before it
        nos = F.regexp_extract_all("piece", F.lit(_PAGE_MARK), F.lit(1)).cast("array<int>")
        p = p.withColumn("nos", nos).withColumn("from", F.coalesce(F.array_min("nos"), F.last(F.get("nos", F.size("nos") - 1), ignorenulls=True).over(before)))
        p = p.withColumn("from", F.when(F.startswith("piece", F.lit("\ue000")), F.col("from")).otherwise(F.least("from", F.coalesce(F.last(F.get("nos", F.size("nos") - 1), ignorenulls=True).over(before), F.col("from")))))
        p = p.withColumn("to", F.coalesce(F.array_max("nos"), F.col("from")))
        own = p.groupBy("book_id", "chunk_id").agg(F.min("from").alias("page_start"), F.max("to").alias("page_end"))
    c = p.groupBy("book_id", "chunk_id").agg(text.alias("text"), F.coalesce(chapter, F.lit("intro")).alias("chapter"))
    n = T.n_words(F.col("text"))
    if exact_pages:
        bare = lambda x: F.regexp_replace(x, _PAGE_MARK, "")
        c = c.withColumns({"text": bare(F.col("text")), "chapter": bare(F.col("chapter"))})
        return c.join(own, ["book_id", "chunk_id"]).select("book_id", "chunk_id", "chapter", "page_start", "page_end", n.alias("word_count"), T.token_est(n).alias("token_est"), "text")
    return c.join(span, "book_id").select("book_id", "chunk_id", "chapter", "page_start", "page_end", n.alias("word_count"), T.token_est(n).alias("token_est"), "text")


def reader_groups(chunks: DataFrame, calls: int = 40, cap: int | None = 3000) -> DataFrame:
    """Chunks of a book grouped so that at most about ``calls`` groups come out, each text cut to ``cap`` characters (None:
    whole): ``(book_id, group_no, n_chunks, text)``."""
    book = Window.partitionBy("book_id")
    x = chunks.where("text IS NOT NULL").withColumn("k", F.row_number().over(book.orderBy("chunk_id")) - 1).withColumn("n", F.count("*").over(book))
    x = x.withColumn("group_no", F.floor(F.col("k") / F.greatest(F.lit(1), F.floor(F.col("n") / calls))).cast("int"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "text"))), lambda c: c["text"]), "\n\n")
    return x.groupBy("book_id", "group_no").agg(F.count("*").alias("n_chunks"), (joined if cap is None else F.substring(joined, 1, cap)).alias("text"))


def bundle_parts(items: DataFrame, keys: list[str], order: str, size: str, limit: int) -> DataFrame:
    """Files packed in order into parts of at most ``limit`` bytes: ``(*keys, order, size, part_no)``.

    A new part begins only when the open one isn't empty and would exceed the limit; a larger file is a part by itself. The
    fold runs over (order, size) pairs of one key, never over contents."""
    x = items.select(*keys, F.col(order).cast("long").alias(order), F.col(size).cast("long").alias(size))
    n = len(keys)

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        used, part = state or (0, 0)
        z = row[n + 1]
        if not part or (used > 0 and used + z > limit):
            used, part = 0, part + 1
        return (used + z, part), [(*row, part)]

    fields = ", ".join(f"`{c}` {kind(x, c)}" for c in x.columns)
    return fold_sorted(x, keys, [order, size], f"{fields}, part_no int", step)


# How the lines begin that open a script's sections, and the sections' ids; the first that fits counts.
SCRIPT_HEADS = (
    ("النقطة\\s+الأولى", "point_1"), ("النقطة\\s+الثانية", "point_2"), ("النقطة\\s+الثالثة", "point_3"), ("النقطة\\s+الرابعة", "point_4"),
    ("النقطة\\s+الخامسة", "point_5"), ("الخاتمة", "closing"), ("تقديم\\s+الكتاب", "cta"),
)


def script_sections(scripts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``(key, sec_no, section_id, title, text, n_chars)`` of each script, in order from 0; ids may repeat.

    What precedes the first heading is "opening", titled by the script's first line; blank sections are left out."""
    s = T.strip(F.col("line"))
    sid = F.lit(None).cast("string")
    for pattern, name in reversed(SCRIPT_HEADS):
        sid = F.when(s.rlike("^" + pattern), name).otherwise(sid)
    w = Window.partitionBy(key).orderBy("i")
    x = scripts.where(F.col(text).isNotNull()).select(key, F.posexplode(T.splitlines(F.col(text))).alias("i", "line")).withColumn("sid", sid)
    x = x.withColumn("h", F.count("sid").over(w))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda r: r["line"])
    g = x.groupBy(key, "h").agg(T.strip(F.array_join(lines, "\n")).alias("text"), F.coalesce(F.min_by("sid", "i"), F.lit("opening")).alias("section_id"), T.strip(F.min_by("line", "i")).alias("title"))
    g = g.where("text <> ''").withColumn("sec_no", (F.row_number().over(Window.partitionBy(key).orderBy("h")) - 1))
    return g.select(key, "sec_no", "section_id", "title", "text", F.length("text").alias("n_chars"))
