"""The pN_ queries of the problems tagged llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.session import table as t

from . import confusables, garbled, leaks, ocr, repeated_lines, runs, splitting, tokenizer, truncation

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    keys = ["book_id", "page_no"]
    return {
        "p1_found": lambda s, d: repeated_lines.repeated_lines(t(s, d, "page"), t(s, d, "book")),
        "p1_texts": lambda s, d: repeated_lines.without_repeated_lines(t(s, d, "page"), t(s, d, "book")),
        "p1_lines": lambda s, d: repeated_lines.line_classes(t(s, d, "page"), t(s, d, "book")),
        "p2_found": lambda s, d: ocr.page_noise(t(s, d, "page"), t(s, d, "book")),
        "p2_texts": lambda s, d: ocr.repaired_pages(t(s, d, "page"), t(s, d, "book")),
        "p3_found": lambda s, d: splitting.split_chunks(t(s, d, "chunk")).select("book_id", "chunk_id").distinct(),
        "p3_pieces": lambda s, d: splitting.pieces_once(t(s, d, "chunk")),
        "p4_found": lambda s, d: garbled.affected_pages(t(s, d, "page"), texts=False).select(*keys).distinct(),
        "p4_restored": lambda s, d: garbled.garbled_pages(t(s, d, "page")),
        "p6_found": lambda s, d: confusables.variant_texts(t(s, d, "page"), t(s, d, "chunk")).select("record_type", "book_id", "item_no").distinct(),
        "p6_texts": lambda s, d: confusables.consistent_texts(t(s, d, "page"), t(s, d, "chunk")).distinct(),
        "p6_groups": lambda s, d: confusables.lookalike_groups(t(s, d, "page"), t(s, d, "chunk")),
        "p7_found": lambda s, d: runs.event_runs(t(s, d, "shot"), chains=True).select("plan_id", "first_shot_no", "last_shot_no"),
        "p7_runs": lambda s, d: runs.event_runs(t(s, d, "shot")),
        "p8_ids": lambda s, d: tokenizer.encode_documents(t(s, d, "documents")),
        "p9_found": lambda s, d: leaks.leaked_passages(t(s, d, "documents"), t(s, d, "eval_items")).select("doc_id", "item_id"),
        "p9_passages": lambda s, d: leaks.leaked_passages(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_items": lambda s, d: leaks.leaked_items(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_clean": lambda s, d: leaks.clean_documents(t(s, d, "documents"), t(s, d, "eval_items")),
        "p10_found": lambda s, d: truncation.truncated_texts(t(s, d, "documents")).select("doc_id"),
        "p10_texts": lambda s, d: truncation.truncated_texts(t(s, d, "documents")),
        "p10_rates": lambda s, d: truncation.truncation_rates(t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    from .oracle import oracle_sql

    return oracle_sql()
