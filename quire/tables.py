"""Tables without repeated rows: of rows equal but for their time of arrival, one.

Repeated keys are found on the key columns alone; only their rows are made distinct. All other rows - texts with them - are not
shuffled, as long as the repeated keys are few enough to be broadcast (counted).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import small_or_shuffled, table

PAGE_COLUMNS = ("book_id", "page_no", "pdf_type", "raw_text", "raw_text_pre")
CHUNK_COLUMNS = ("book_id", "chunk_id", "chapter", "page_start", "page_end", "word_count", "token_est", "text")
SHOT_COLUMNS = (
    "plan_id", "book_id", "shot_no", "start", "end", "visual", "search_query", "source_hint", "motion", "motion_intensity", "typography_template",
    "typography_text", "caption_text", "show_caption", "note", "section_id",
)


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with its repeated rows once; rows with a null key stay as they are."""
    again = df.groupBy(*keys).agg(F.count("*").alias("__times")).where("__times > 1").select(*keys)
    again = small_or_shuffled(again, 1_000_000)
    return df.join(again, keys, "left_anti").unionAll(df.join(again, keys, "left_semi").distinct())


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "page").select(*PAGE_COLUMNS), ["book_id", "page_no"])


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "chunk").select(*CHUNK_COLUMNS), ["book_id", "chunk_id"])


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(table(spark, sf_dir, "shot").select(*SHOT_COLUMNS), ["plan_id", "shot_no"])
