"""Runs of identical or nearly identical consecutive events (problem 7).

Segmentation is optimal: per entity, a pruned dynamic programme over the ordered events minimises the dissimilarity within
segments plus a penalty per boundary. Within a segment, an event costs its dissimilarity to the more alike of the two
events before it: 0 if they show the same, a little if nearly, at least the penalty if their texts differ by more, without
bound if their visuals differ. So one passing event that differs somewhat (A B A) is cheaper kept inside its run than cut
out of it. Segments of two or more events are runs.

Pruning: once two starts lie two or more events back, what comes costs both the same, so only the cheaper one stays alive;
three starts an event are compared, and the programme is linear and exact.

Events are range-partitioned by (entity, time), so an entity with a third of all events is split over many tasks; each
task segments its stretch of each entity. Only the segments at a partition's borders - two a partition - are compared
again, with the neighbouring ones, to join runs that the partitioning cut.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

#: Cost of a boundary; of an event nearly equal to its neighbour; what wholly different texts cost beyond the penalty.
PENALTY, NEAR, SPREAD = 1.0, 0.05, 2.0
#: Letters and digits that two texts must have to be nearly equal with one letter's difference.
LEAST = 12

_NOT_TEXT = re.compile(r"[\W_ـ]+")


def key_text(text: str | None) -> str:
    """Letters and digits only, lower case, without vowel marks and tatweel; null counts as blank."""
    return _NOT_TEXT.sub("", text.lower()) if text else ""


def _one_edit(a: str, b: str) -> bool:
    """Whether ``b`` is ``a`` with one character added, dropped or replaced (or the same)."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def near(a: str, b: str) -> bool:
    """Whether two key texts are equal, or long enough and one letter apart with the same digits."""
    return a == b or (len(a) >= LEAST and len(b) >= LEAST and _digits(a) == _digits(b) and _one_edit(a, b))


def dissimilarity(a: str, b: str) -> float:
    """Dissimilarity of two events of one visual by their key texts: 0 to ``NEAR`` if they are nearly the same, else the
    penalty and more, by the share of letter pairs that they don't have in common."""
    if a == b:
        return 0.0
    if near(a, b):
        return NEAR
    x, y = (Counter(zip(t, t[1:], strict=False)) for t in (a, b))
    return PENALTY + SPREAD * (1 - 2 * sum((x & y).values()) / max(1, len(a) + len(b) - 2))


def segment(one: list[float], two: list[float], penalty: float = PENALTY) -> list[int]:
    """Starts of the cheapest segments of ``len(one)`` events.

    ``one[k]`` is the dissimilarity of event k to the event before, ``two[k]`` to the one before that. Event k of a segment
    that starts at i costs 0 for k = i, ``one[k]`` for k = i + 1, else the less of ``one[k]`` and ``two[k]``. Of equally
    cheap ways the one with the shorter last segment counts.
    """
    n = len(one)
    if not n:
        return []
    back = [0] * n
    best = 0.0  # of all events before k
    far, far_at = float("inf"), 0  # cheapest way whose last segment has two events or more
    last, last_at = float("inf"), 0  # the way whose last segment is event k - 1 alone
    for k in range(n):
        longer = far + min(one[k], two[k])
        pair = last + one[k]
        far, far_at = (pair, last_at) if pair <= longer else (longer, far_at)
        last, last_at = best + penalty, k
        best, back[k] = (last, k) if last <= far else (far, far_at)
    starts, k = [], n - 1
    while k >= 0:
        starts.append(back[k])
        k = back[k] - 1
    return starts[::-1]


_OUT = (
    "plan_id string, part int, ord int, at_head boolean, at_tail boolean, first_no int, last_no int, n long, first_start double, last_start double, stop double, "
    "look string, head_text string, tail_text string, visual string, typography_text string"
)


def _pieces(b: pd.DataFrame, chains: bool) -> list[list]:
    """Segments of one block: events of one plan and visual in a row. With ``chains``, a segment is then cut wherever two
    neighbours aren't nearly the same."""
    t = [key_text(x) for x in b["typography_text"]]
    n = len(t)
    one = [0.0] + [dissimilarity(t[k - 1], t[k]) for k in range(1, n)]
    two = [0.0] * min(n, 2) + [dissimilarity(t[k - 2], t[k]) if one[k] > NEAR else one[k] for k in range(2, n)]
    at = segment(one, two)
    if chains:
        at = sorted({*at, *(k for k in range(1, n) if one[k] > NEAR)})
    at.append(n)
    plan, look = b["plan_id"].iloc[0], b["look"].iloc[0]
    no, st, en, vis, txt = (b[c].tolist() for c in ("shot_no", "start", "stop", "visual", "typography_text"))
    out = []
    for a, z in zip(at, at[1:], strict=False):
        ends = [e for e in en[a:z] if e is not None and e == e]
        out.append([plan, False, False, no[a], no[z - 1], z - a, st[a], st[z - 1], max(ends) if ends else None, look, t[a], t[z - 1], vis[a], txt[a]])
    return out


def _segmenter(chains: bool, least: int):
    """Segments of a sorted partition: those of ``least`` events and the partition's first and last one."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, order, first = TaskContext.get().partitionId(), 0, True
        kept: list[pd.DataFrame] = []  # the block at the end, which may go on in the next batch

        def rows(b: pd.DataFrame, last: bool) -> pd.DataFrame:
            nonlocal order, first
            plan, look = b["plan_id"].to_numpy(object), b["look"].to_numpy(object)
            new = np.ones(len(b) + 1, bool)
            new[1:-1] = (plan[1:] != plan[:-1]) | (look[1:] != look[:-1]) | (look[1:] == None)  # noqa: E711
            at = np.flatnonzero(new)
            out = []
            for i, j in zip(at[:-1], at[1:], strict=True):
                if j - i >= least or (first and not i) or (last and j == len(b)):
                    segs = _pieces(b.iloc[i:j], chains)
                    segs[0][1], segs[-1][2] = first and not i, last and j == len(b)
                    out += [s for s in segs if s[5] >= least or s[1] or s[2]]
            first = False
            order += len(out)
            return pd.DataFrame([[r[0], part, order - len(out) + i, *r[1:]] for i, r in enumerate(out)], columns=[x.split()[0] for x in _OUT.split(", ")])

        for b in batches:
            if not len(b):
                continue
            b = b.astype({"visual": object, "typography_text": object}).where(b.notna(), None)
            b["look"] = [x.strip().lower() if x is not None else None for x in b["visual"]]
            plan, look = b["plan_id"].to_numpy(object), b["look"].to_numpy(object)
            tail = (plan == plan[-1]) & (look == look[-1]) & (look != None)  # noqa: E711
            odd = np.flatnonzero(~tail)
            i = int(odd[-1]) + 1 if len(odd) else 0
            i = min(i, len(b) - 1)
            if i == 0 and kept and not (kept[-1]["plan_id"].iloc[-1] == plan[0] and kept[-1]["look"].iloc[-1] == look[0] and look[0] is not None):
                yield rows(pd.concat(kept), False)
                kept = []
            elif i:
                yield rows(pd.concat([*kept, b.iloc[:i]]), False)
                kept = []
            kept.append(b.iloc[i:])
        if kept:
            yield rows(pd.concat(kept), True)

    return each


def _joins(p: dict, r: dict) -> bool:
    """Whether a partition's last segment goes on in the next one's first: cheaper joined than with a boundary."""
    return p["at_tail"] and r["at_head"] and p["part"] != r["part"] and p["look"] is not None and p["look"] == r["look"] and dissimilarity(p["tail_text"], r["head_text"]) < PENALTY


def event_runs(shots: DataFrame, least: int = 2, chains: bool = False) -> DataFrame:
    """One row per run of at least ``least`` shots: ``(plan_id, first_shot_no, last_shot_no, n_shots, start, end, visual,
    typography_text)``; ``start`` to ``end`` is the time that the run covers.

    With ``chains`` a run holds only shots nearly the same as the one before, each by the rule of equal or one-letter
    differences. Two such neighbours are always in one segment: parting them saves less than a boundary costs. Across the
    border of two tasks, runs are joined where the shots beside it are nearly the same.

    Shots are ordered by ``start``, then ``shot_no``. Defined results: shots with a null plan, number or ``start`` are left
    out; a null ``visual`` equals nothing; a null ``typography_text`` counts as blank; rows repeated under one key count
    once (the earliest ``created_at``); an empty table gives no rows; extra columns aren't looked at.
    """
    once = (
        shots.select("plan_id", "shot_no", F.struct(F.col("created_at"), F.col("start"), F.col("end").alias("stop"), "visual", "typography_text").alias("r"))
        .where("plan_id IS NOT NULL AND shot_no IS NOT NULL AND r.start IS NOT NULL AND NOT isnan(r.start)")
        .groupBy("plan_id", "shot_no").agg(F.min("r").alias("r"))
        .select("plan_id", "shot_no", "r.start", "r.stop", "r.visual", "r.typography_text")
    )
    segs = cut(once.repartitionByRange("plan_id", "start", "shot_no").sortWithinPartitions("plan_id", "start", "shot_no").mapInPandas(_segmenter(chains, least), _OUT))
    # a stretch's head and tail segment may go on in the neighbouring partition; the others are final
    inner = segs.where("NOT at_head AND NOT at_tail")
    border = segs.where("at_head OR at_tail")
    joined = border.groupBy("plan_id").applyInPandas(_join, _OUT)
    done = inner.unionByName(joined).where(F.col("n") >= least)
    return done.select(
        "plan_id", F.col("first_no").alias("first_shot_no"), F.col("last_no").alias("last_shot_no"), F.col("n").alias("n_shots"),
        F.col("first_start").alias("start"), F.col("stop").alias("end"), "visual", "typography_text",
    )


def _join(b: pd.DataFrame) -> pd.DataFrame:
    """Join border segments of one entity across partitions: two a partition at most."""
    b = b.sort_values(["part", "ord"]).astype(object).where(b.notna(), None)
    out: list[dict] = []
    for r in b.to_dict("records"):
        p = out[-1] if out else None
        if p and _joins(p, r):
            stops = [x for x in (p["stop"], r["stop"]) if x is not None]
            p |= {k: r[k] for k in ("part", "at_tail", "last_no", "last_start", "tail_text")} | {"n": p["n"] + r["n"], "stop": max(stops, default=None)}
        else:
            out.append(r)
    return pd.DataFrame(out, columns=b.columns)


