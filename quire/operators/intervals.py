"""Coverage of overlapping, nested and gapped intervals (problem 5).

Exact time units (milliseconds) are discretised into bitmaps kept as compressed runs, one per entity and time
shard. The bitmaps of a shard are united, and set runs and clear runs are read off:

1. an interval is dilated by the joining tolerance at its end, so touching runs of set bits are joined periods;
2. it is cut at shard borders. Shards that it covers wholly are kept as ONE run over several shards, so an
   interval of any length makes at most three rows;
3. rows are hash-partitioned by (entity, shard), sorted, and united in one streaming pass of vectorised run
   merging, with O(1) state carried between Arrow batches - no group is ever held, so a hot entity is split over
   its shards and a hot shard streams;
4. runs that touch neither border of their shard are final periods, the clear runs between runs of one shard are
   final gaps. Only one or two border runs a shard go on to a window over the entity's shard summaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits (milliseconds) of a shard's bitmap.
SHARD_MS = 1 << 16


def _merge_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union of sorted runs [s, e) of each (entity, shard); emits the united runs in order."""
    carry: tuple | None = None  # entity, shard, s, e of the run still open

    def frame(e, k, s, t):
        return pd.DataFrame({"entity": e, "shard": k, "s": s, "e": t})

    for b in batches:
        if not len(b):
            continue
        ent, shard = b["entity"].to_numpy(object), b["shard"].to_numpy(np.int64)
        s, e = b["s"].to_numpy(np.int64), b["e"].to_numpy(np.int64)
        if carry is not None:
            ent = np.concatenate([np.array([carry[0]], object), ent])
            shard, s, e = (np.concatenate([[c], x]) for c, x in zip(carry[1:], (shard, s, e), strict=True))
        new = np.ones(len(s), bool)
        new[1:] = (ent[1:] != ent[:-1]) | (shard[1:] != shard[:-1])
        group = np.cumsum(new) - 1
        # running maximum of the ends within a group: groups are lifted above one another, so one accumulate does all
        low = e.min()
        span = int(e.max() - low) + 1
        top = np.maximum.accumulate((e - low) + group * span) - group * span + low
        start = new.copy()
        start[1:] |= s[1:] > top[:-1]
        at = np.flatnonzero(start)
        ends = top[np.append(at[1:], len(s)) - 1]
        if len(at) > 1:
            yield frame(ent[at[:-1]], shard[at[:-1]], s[at[:-1]], ends[:-1])
        i = at[-1]
        carry = (ent[i], shard[i], s[i], ends[-1])
    if carry is not None:
        yield frame(*([c] for c in carry))


def coverage(
    df: DataFrame,
    entity: str,
    start: Column,
    end: Column,
    tolerance: int = 0,
    shard: int = SHARD_MS,
) -> DataFrame:
    """Periods covered and gaps between them: ``(entity, kind, start, end)``, kind ``period`` or ``gap``.

    ``start`` and ``end`` are whole units (BIGINT). Defined results: rows with a null entity, a null time or
    ``end <= start`` are ignored; intervals at most ``tolerance`` apart are joined; an empty table gives no rows;
    repeated rows change nothing; extra columns of ``df`` are not looked at and may have any name.
    """
    s0, e0, k = F.col("s"), F.col("e"), F.lit(shard)
    kind_of = df.schema[entity].dataType
    iv = (
        df.select(F.col(entity).cast("string").alias("entity"), start.cast("long").alias("s"), end.cast("long").alias("e"))
        .where("entity IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND e > s")
        .withColumn("e", e0 + tolerance)
    )
    # cut at shard borders: head, run of wholly covered shards, tail
    first, last = F.floor(s0 / k).cast("long"), F.floor((e0 - 1) / k).cast("long")
    # DOUBLE division is exact enough up to 2^53 units; pmod keeps the cut itself exact
    first = F.when(first * k > s0, first - 1).otherwise(first)
    last = F.when(last * k > e0 - 1, last - 1).otherwise(last)
    piece = lambda sh, a, b: F.struct(sh.alias("shard"), a.alias("s"), b.alias("e"))
    pieces = F.when(first == last, F.array(piece(first, s0, e0))).when(
        last == first + 1, F.array(piece(first, s0, last * k), piece(last, last * k, e0))
    ).otherwise(
        F.array(piece(first, s0, (first + 1) * k), piece(first + 1, (first + 1) * k, last * k), piece(last, last * k, e0))
    )
    parts = iv.select("entity", F.explode(pieces).alias("p")).select("entity", "p.*")
    runs = (
        parts.repartition("entity", "shard")
        .sortWithinPartitions("entity", "shard", "s")
        .mapInPandas(_merge_runs, "entity string, shard long, s long, e long")
    )
    periods, gaps = _over_shards(_without_covered(runs, shard))
    out = periods.select("entity", F.lit("period").alias("kind"), "s", (F.col("e") - tolerance).alias("e")).unionByName(
        gaps.select("entity", F.lit("gap").alias("kind"), (F.col("s") - tolerance).alias("s"), "e")
    )
    return out.select(F.col("entity").cast(kind_of).alias(entity), "kind", F.col("s").alias("start"), F.col("e").alias("end"))


def _without_covered(runs: DataFrame, shard: int) -> DataFrame:
    """Drop the runs of shards that a run of an earlier shard covers wholly; such runs end at shard borders."""
    end = (F.col("shard") + 1) * F.lit(shard)
    w = Window.partitionBy("entity").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        runs.groupBy("entity", "shard").agg(F.max("e").alias("top")).withColumn("reach", F.max("top").over(w)).where(F.col("reach") >= end).select("entity", "shard", "reach")
    )
    return (
        runs.join(covered, ["entity", "shard"], "left").where(F.col("reach").isNull() | (F.col("e") > end)).drop("reach")
    )


def _over_shards(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set runs and clear runs over all shards from the runs of each shard."""
    g = Window.partitionBy("entity", "shard").orderBy("s")
    seq = runs.withColumn("next_s", F.lead("s").over(g)).withColumn("prev_e", F.lag("e").over(g))
    # a shard's first and last run may join a neighbour shard's; those between are final
    first, last = F.col("prev_e").isNull(), F.col("next_s").isNull()
    final = seq.where(~first & ~last).select("entity", "s", "e")
    clear = seq.where(~last).select("entity", F.col("e").alias("s"), F.col("next_s").alias("e"))
    border = seq.where(first | last)
    # islands over the border runs: two a shard at most, whatever the number of intervals. Between the first and
    # the last run of a shard lie only final runs, so a break there is a break of the chain, but not a gap.
    w = Window.partitionBy("entity").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    chain = border.select("entity", "shard", "s", "e", first.alias("is_first"), last.alias("is_last")).withColumn("reach", F.max("e").over(w))
    starts = F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach")), 1).otherwise(0)
    chain = chain.withColumn("new", starts).withColumn(
        "island", F.sum("new").over(Window.partitionBy("entity").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0))
    )
    joined = chain.groupBy("entity", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    # a gap from one shard's last run to another's first; within a shard `clear` has it
    across = chain.where((F.col("new") == 1) & F.col("reach").isNotNull() & F.col("is_first")).select(
        "entity", F.col("reach").alias("s"), F.col("s").alias("e")
    )
    return final.unionByName(joined.select("entity", "s", "e")), clear.unionByName(across)


def shot_coverage(shots: DataFrame, tolerance_ms: int = 50) -> DataFrame:
    """Continuous periods of each plan's shots and the gaps between them, in milliseconds.

    Times that aren't numbers, or not within 10^12 seconds, count as null: such shots are ignored. A shot whose times round to
    the same millisecond covers nothing and is ignored too."""
    ms = lambda c: F.rint(F.col(c) * 1000).cast("long")
    finite = (F.abs(F.col("start")) < 1e12) & (F.abs(F.col("end")) < 1e12)
    ok = shots.where(F.col("end") > F.col("start")).where(finite & ~F.isnan("start") & ~F.isnan("end"))
    return coverage(ok, "plan_id", ms("start"), ms("end"), tolerance_ms).withColumnsRenamed({"start": "start_ms", "end": "end_ms"})
