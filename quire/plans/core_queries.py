"""Queries of the core: the interval operator and the reference's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.operators import intervals
from quire.session import table as t

from . import book_queries, extra_queries, job_queries, kernel_queries, layout_queries, line_queries, media_queries, slot_queries, text_queries, timeline_queries

MODULES = (text_queries, line_queries, book_queries, timeline_queries, media_queries, layout_queries, kernel_queries, extra_queries, job_queries, slot_queries)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    own = {"p5_found": lambda s, d: intervals.shot_coverage(t(s, d, "shot"))}
    return own | {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    own = {
        "p5_found": """
WITH iv AS (
  SELECT DISTINCT plan_id, CAST(round_even(start * 1000, 0) AS BIGINT) AS s, CAST(round_even("end" * 1000, 0) AS BIGINT) AS e
  FROM shot WHERE plan_id IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL AND "end" > start),
ok AS (SELECT * FROM iv WHERE e > s),
o AS (SELECT *, max(e) OVER (PARTITION BY plan_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ok),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM o),
p AS (SELECT plan_id, grp, min(s) AS s, max(e) AS e FROM g GROUP BY plan_id, grp),
q AS (SELECT *, lead(s) OVER (PARTITION BY plan_id ORDER BY s) AS nxt FROM p)
SELECT plan_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM p
UNION ALL SELECT plan_id, 'gap', e, nxt FROM q WHERE nxt IS NOT NULL""",
    }
    return own | {k: q for m in MODULES for k, q in m.ORACLE.items()}
