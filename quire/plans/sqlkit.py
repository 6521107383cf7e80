"""Pieces of the SQL twins (DuckDB): the same rules said in SQL."""

from __future__ import annotations

import re

from quire.functions import text as T


def re2(pattern: str) -> str:
    """A pattern written for Java as RE2 and SQL take it."""
    return re.sub(r"\\u([0-9a-fA-F]{4})", r"\\x{\1}", pattern).replace("'", "''")


WS = re2(T.WS)
LINE_END = re2(T.LINE_END)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+$', '')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda ww: ww <> '')"


def n_words(x: str) -> str:
    return f"CAST(len({words(x)}) AS INTEGER)"


def splitlines(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN [] ELSE string_split_regex(regexp_replace({x}, '(?:{LINE_END})$', ''), '{LINE_END}') END)"


def token_est(n: str) -> str:
    return f"CAST(trunc(CAST({n} AS DOUBLE) * CAST(1.4 AS DOUBLE)) AS INTEGER)"


#: Pages, of rows repeated under one key one.
PAGES = "(SELECT DISTINCT book_id, page_no, pdf_type, raw_text, raw_text_pre FROM page)"
CHUNKS = "(SELECT DISTINCT book_id, chunk_id, chapter, page_start, page_end, word_count, token_est, text FROM chunk)"
SHOTS = """(SELECT DISTINCT plan_id, book_id, shot_no, start, "end", visual, search_query, source_hint, motion, motion_intensity, typography_template,
  typography_text, caption_text, show_caption, note, section_id FROM shot)"""


def values(rows: list[tuple], cols: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({cols}))"
