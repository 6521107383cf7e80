"""Pages as a stream (an extension; the reference has no streams): arrivals once, and footnotes that go on across pages.

``dedupe_stream`` keeps the first arrival of a page within the watermark. ``open_footnotes`` carries, per book, whether the last
page left a footnote open - one boolean and a page number of keyed state - and emits a row a page.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_stream(pages: DataFrame, delay: str = "30 days") -> DataFrame:
    """First arrival of each (book_id, page_no), repeated rows dropped as long as the watermark keeps their keys."""
    return pages.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["book_id", "page_no"])


def lines_per_window(pages: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Pages and lines that arrived in each window: ``(window, n_pages, n_lines)``."""
    n = F.size(F.split(F.coalesce("raw_text", F.lit("")), "\n"))
    return pages.withWatermark("ingested_at", delay).groupBy(F.window("ingested_at", width)).agg(F.count("*").alias("n_pages"), F.sum(n).alias("n_lines"))


def _goes_on(text: str | None) -> bool:
    last = next((x.rstrip() for x in reversed((text or "").split("\n")) if x.strip()), "")
    return last.endswith(("=", " -", " –", " —", " ―"))


def open_footnotes(pages: DataFrame) -> DataFrame:
    """``(book_id, page_no, pending)``: whether the page before (in order of number within what has arrived) left its last
    line open. Pages of a book are expected in order across batches; within a batch they are sorted."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        open_, last = state.get if state.exists else (False, -1)
        b = pd.concat(list(batches)).sort_values("page_no")
        out = []
        for no, t in zip(b["page_no"], b["raw_text"], strict=True):
            out.append((key[0], int(no), bool(open_)))
            open_, last = _goes_on(t), int(no)
        state.update((bool(open_), last))
        yield pd.DataFrame(out, columns=["book_id", "page_no", "pending"])

    return pages.groupBy("book_id").applyInPandasWithState(step, "book_id string, page_no int, pending boolean", "open boolean, last int", "append", "NoTimeout")
