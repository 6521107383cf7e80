"""Texts and JSON documents that a book's tables are written out as; one row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

RULE = "═" * 60


def ordered(order: str, value: Column, sep: str) -> Column:
    """Aggregate: values joined in order; nulls are left out."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]), sep)


def one_book(books: DataFrame) -> DataFrame:
    """Of a book's repeated rows the earliest: ``(book_id, source_path, pdf_type, total_pages, title, author)``."""
    r = F.struct("ingested_at", "source_path", "pdf_type", "total_pages", F.col("metadata")["title"].alias("title"), F.col("metadata")["author"].alias("author"))
    return books.groupBy("book_id").agg(F.min(r).alias("r")).select("book_id", "r.source_path", "r.pdf_type", "r.total_pages", "r.title", "r.author")


def raw_snapshot(pages: DataFrame, books: DataFrame) -> DataFrame:
    """Each book's text before processing, a section a page: ``(book_id, document)``."""
    section = F.concat(F.lit("[Page "), F.format_string("%03d", "page_no"), F.lit(" | "), F.coalesce("pdf_type", F.lit("None")), F.lit("]\n"), F.coalesce(F.nullif("raw_text_pre", F.lit("")), F.lit("(empty)")), F.lit("\n" + RULE))
    body = pages.groupBy("book_id").agg(ordered("page_no", section, "\n").alias("body"))
    na = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    head = F.concat_ws("\n", F.concat(F.lit("# RAW EXTRACT — "), F.regexp_extract("source_path", r"([^/]*)$", 1)), F.concat(F.lit("# PDF Type   : "), na("pdf_type")), F.concat(F.lit("# Total pages: "), na("total_pages")), F.concat(F.lit("# Title      : "), na("title")), F.concat(F.lit("# Author     : "), na("author")), F.lit(""))
    return one_book(books).join(body, "book_id").select("book_id", F.concat(head, F.lit("\n"), "body").alias("document"))


def joined_text(pages: DataFrame) -> DataFrame:
    """Non-empty pages' stripped texts joined by blank lines: ``(book_id, text)``."""
    s = T.strip(F.col("raw_text"))
    return pages.where(s != "").groupBy("book_id").agg(ordered("page_no", s, "\n\n").alias("text"))


def pages_json(pages: DataFrame, books: DataFrame) -> DataFrame:
    """Each book with its pages as one JSON document: ``(book_id, document)``."""
    p = F.struct(F.col("page_no").alias("page_number"), "pdf_type", F.coalesce("raw_text", F.lit("")).alias("raw_text"), F.coalesce("raw_text_pre", F.lit("")).alias("raw_text_pre"))
    arr = pages.groupBy("book_id").agg(F.sort_array(F.collect_list(p)).alias("pages"))
    doc = F.to_json(F.struct(F.col("source_path").alias("source"), "pdf_type", "total_pages", "pages"))
    return one_book(books).join(arr, "book_id").select("book_id", doc.alias("document"))


def chunks_text(chunks: DataFrame) -> DataFrame:
    """Chunks' stripped texts joined by blank lines, with their number: ``(book_id, n_chunks, text)``."""
    s = T.strip(F.col("text"))
    return chunks.where(s != "").groupBy("book_id").agg(F.count("*").alias("n_chunks"), ordered("chunk_id", s, "\n\n").alias("text"))


def chunks_json(chunks: DataFrame) -> DataFrame:
    c = F.struct("chunk_id", "chapter", "page_start", "page_end", "word_count", "token_est", "text")
    return chunks.groupBy("book_id").agg(F.to_json(F.struct(F.count("*").alias("chunk_count"), F.sort_array(F.collect_list(c)).alias("chunks"))).alias("document"))


def titled_text(pages: DataFrame) -> DataFrame:
    """``=== stem — Page i ===`` before each page's text: ``(book_id, document)``."""
    part = F.concat(F.lit("=== "), "book_id", F.lit(" — Page "), F.col("page_no").cast("string"), F.lit(" ===\n"), F.coalesce("raw_text", F.lit("")))
    return pages.groupBy("book_id").agg(ordered("page_no", part, "\n\n").alias("document"))
