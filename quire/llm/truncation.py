"""Text cut off by field limits (problem 10).

Two kinds of evidence. *Copies*: a text that is a strict prefix of a longer text elsewhere and stops inside a word of it was
cut. The self-join hashes prefixes of fixed lengths (powers of two): a text of n characters meets, at the greatest power of
two up to n, only texts that share more than half of it. Texts that meet a longer or shorter one are then sorted, and in
text order a value is a prefix of another one exactly if it is a prefix of the next. *Endings*: most cut texts have no longer
copy, so a text also counts as cut by its end: a mark of the cut, or what a logistic model judges to be no end. The model
learns from texts as they are against the same texts cut at random, so what closes a text of its kind (sentence ends, the
closing lines of letters) is learnt, not listed.

Scale: texts are read by one Python pass that keeps numbers and hashes only. Prefix groups are aggregated on the map side to
two numbers, whatever their size; only texts that may be a prefix or a copy are sorted, each value once, over ranges of the
text itself, so a template that millions share is split as any other.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut, small_or_shuffled

from .common import logistic

#: Characters that two texts must share to count as copies: the least length of a text looked up.
LEAST_SHARED = 16
#: Texts that the model of endings learns from, at most: so many letters and so many others.
SAMPLE = 2000
#: Kinds that are complete without end punctuation.
FREE = ("heading", "caption")
MARK = re.compile(r"(?:\[ ?(?:\.\.\.|…) ?\]|\.\.\.|…|�+)$")
_TAIL = re.compile(r"[^\w.!?؟。,،;؛:]+$|_+$")


def stem(text: str) -> str:
    """``text`` without white space and a mark of the cut at its end."""
    return MARK.sub("", text.rstrip()).rstrip()


# ------------------------------------------------------------------------------------------- model of endings


def features(text: str, kind: str | None) -> list[str]:
    """Features of how ``text`` ends: its last sign, and of its last line the length, first word and what stands before."""
    t = text.rstrip()
    head, _, last = t.rpartition("\n")
    core = _TAIL.sub("", last)
    c = core[-1:]
    sign = c if c and not c.isalnum() else "9" if c.isdigit() else "a" if c else "-"
    k = "letter" if kind == "letter" else "prose"
    out = ["b", f"k{k}", f"s{sign}", f"ks{k}{sign}"]  # a sentence's end says all
    if sign in ".!?؟。":
        return out
    words = last.split()
    n = len(words)
    first = "#" if last.strip().isdigit() else words[0] if words else ""
    shape = "w" if first[:1].isalnum() else first
    before = _TAIL.sub("", head.rstrip())[-1:] in tuple(".!?؟。")
    size = n if n <= 6 else 7
    gap = head.endswith("\n")
    if n <= 6:  # how a longer line begins tells nothing of its end
        out.append(f"h{k}:{first}")
    return [*out, f"n{k}{size}", f"f{k}{shape}", f"fn{k}{shape}{size}", f"p{k}{before}", f"pn{k}{before}{size}", f"g{k}{gap}{before}"]


class Endings:
    """Logistic model of whether a text's end is a cut."""

    def __init__(self, weights: dict[str, float], known: set[str]) -> None:
        self.weights, self.known = weights, known

    def _seen(self, f: list[str]) -> list[str]:
        # first words of last lines that aren't frequent are one feature
        return [x if x[0] != "h" or x in self.known else x.partition(":")[0] for x in f]

    @classmethod
    def fit(cls, texts: list[tuple[str, str | None]], rounds: int = 300, seed: int = 5, least: int = 3, cuts: int = 5) -> Endings:
        """Learn from ``(text, kind)`` as they are against the same texts, each cut at ``cuts`` places."""
        rng = random.Random(seed)
        rows: list[tuple[list[str], int]] = []
        for t, k in texts:
            if k in FREE or len(t.strip()) < 8 or MARK.search(t.rstrip()):
                continue
            rows.append((features(t, k), 0))
            rows += [(features(t[: rng.randrange(4, len(t.rstrip()))], k), 1) for _ in range(cuts)]
        often = Counter(x for f, y in rows if not y for x in f if x[0] == "h")
        model = cls({}, {x for x, n in often.items() if n >= least})
        seen = [model._seen(f) for f, _ in rows]
        y = [v for _, v in rows]
        model.weights = logistic(seen, y, [1 / cuts if v else 1.0 for v in y], rounds)
        return model

    def score(self, text: str, kind: str | None) -> float:
        """Above 0: rather cut than complete."""
        return sum(self.weights.get(x, 0.0) for x in self._seen(features(text, kind)))

    def ending(self, text: str | None, kind: str | None) -> str | None:
        """``blank``, ``mark``, ``complete`` or ``open``; null for null. Headings and captions need no end, but may bear a mark."""
        if text is None:
            return None
        t = text.rstrip()
        if not t:
            return "blank"
        if MARK.search(t):
            return "mark"
        return "complete" if kind in FREE or self.score(t, kind) <= 0 else "open"


def train_endings(documents: DataFrame, sample: int = SAMPLE) -> Endings:
    """Model learnt from at most ``sample`` letters and ``sample`` other texts, chosen by hash."""
    rows = documents.where("doc_id IS NOT NULL AND length(text) >= 8").select("text", "kind", F.xxhash64("doc_id", "text").alias("h"))
    letter = F.coalesce(F.col("kind") == "letter", F.lit(False))
    texts = [(r.text, r.kind) for part in (rows.where(letter), rows.where(~letter)) for r in part.orderBy("h", "text").limit(sample).collect()]
    return Endings.fit(texts)


# ------------------------------------------------------------------------------------------------ self-join


def _hash(b: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b) - (1 << 63)


def prefixes(s: str, least: int = LEAST_SHARED) -> list[tuple[int, int]]:
    """``(length, hash)`` of the prefixes of ``s`` whose lengths are powers of two from ``least`` (one itself) on."""
    out, p = [], least
    while p <= len(s):
        out.append((p, _hash(s[:p].encode("utf-8", "surrogatepass"))))
        p *= 2
    return out


_FACTS = (
    "doc_id long, source string, kind string, n_chars long, evidence string, in_word boolean, n int, value long, value2 long, "
    "keys array<struct<p:int,h:long>>"
)


def text_facts(documents: DataFrame, endings: Endings) -> DataFrame:
    """What is needed of each text: how it ends, its stem's length and hashes, and the hashes of its prefixes."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t, source, kind in zip(b["doc_id"], b["text"], b["source"], b["kind"], strict=True):
                s = stem(t)
                raw = s.encode("utf-8", "surrogatepass")
                keys = [{"p": p, "h": h} for p, h in prefixes(s)]
                rows.append((i, source, kind, len(t), endings.ending(t, kind), s[-1:].isalnum(), len(s), _hash(raw), xxhash.xxh3_64_intdigest(raw, 1) - (1 << 63), keys))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _FACTS.split(", ")])

    return documents.select("doc_id", "text", "source", "kind").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(each, _FACTS)


_NEXT = "value long, value2 long, part int, text string, head string, head_id long, longer_id long, next_char string"


def _successors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each value of a sorted partition the next one, if it goes on where the value stops; the partition's last value
    comes out with its text, the first one's text beside it."""
    from pyspark import TaskContext

    part, prev, head = TaskContext.get().partitionId(), None, None
    names = [x.split()[0] for x in _NEXT.split(", ")]
    for b in batches:
        rows = []
        for v, v2, t, i in zip(b["value"], b["value2"], b["stem"], b["least_id"], strict=True):
            if prev is None:
                head = (t, i)
            elif t.startswith(prev[2]):
                rows.append((prev[0], prev[1], part, None, None, None, i, t[len(prev[2])]))
            prev = (v, v2, t)
        yield pd.DataFrame(rows, columns=names).astype({"head_id": object, "longer_id": object})
    if prev is not None:
        yield pd.DataFrame([(prev[0], prev[1], part, prev[2], *head, None, None)], columns=names).astype({"head_id": object, "longer_id": object})


def longer_copies(documents: DataFrame, facts: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``(doc_id, longer_id, next_char)`` of texts whose stem is a strict prefix of another's: the least id of the next longer
    one in text order, and the character with which it goes on. Texts of fewer than ``least`` characters aren't looked up."""
    keys = facts.where(F.col("n") >= least).select("doc_id", "n", "value", F.explode("keys").alias("k")).select("doc_id", "n", "k.p", "k.h")
    own = F.col("n") < F.col("p") * 2  # the greatest power of two up to n
    groups = keys.groupBy("p", "h").agg(F.min(F.when(own, F.col("n"))).alias("short"), F.max("n").alias("long")).where("short < long")
    meet = keys.join(small_or_shuffled(groups), ["p", "h"]).where((own & (F.col("n") < F.col("long"))) | (F.col("n") > F.col("short")))
    ids = cut(meet.select("doc_id").distinct())

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [stem(t) for t in b["text"]]
            raw = [x.encode("utf-8", "surrogatepass") for x in s]
            yield pd.DataFrame({"doc_id": b["doc_id"], "value": [_hash(x) for x in raw], "value2": [xxhash.xxh3_64_intdigest(x, 1) - (1 << 63) for x in raw], "stem": s})

    texts = documents.where("text IS NOT NULL").select("doc_id", "text").join(small_or_shuffled(ids, 1_000_000), "doc_id", "left_semi").mapInPandas(each, "doc_id long, value long, value2 long, stem string")
    once = texts.groupBy("value", "value2").agg(F.min("doc_id").alias("least_id"), F.first("stem").alias("stem"))
    found = cut(once.repartitionByRange("stem").sortWithinPartitions("stem").select("value", "value2", "stem", "least_id").mapInPandas(_successors, _NEXT))
    # a partition's last value goes on in the first one of the next: one row a partition
    ends = found.where("text IS NOT NULL")
    w = Window.orderBy("part")
    over = ends.withColumn("nh", F.lead("head").over(w)).withColumn("ni", F.lead("head_id").over(w)).where(F.col("nh").startswith(F.col("text")))
    over = over.select("value", "value2", F.col("ni").alias("longer_id"), F.expr("substring(nh, length(text) + 1, 1)").alias("next_char"))
    goes_on = found.where("text IS NULL").select("value", "value2", "longer_id", "next_char").unionAll(over)
    return facts.select("doc_id", "value", "value2").join(goes_on, ["value", "value2"]).groupBy("doc_id").agg(F.min(F.struct("longer_id", "next_char")).alias("o")).select("doc_id", "o.longer_id", "o.next_char")


def truncated_texts(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, kind, n_chars, evidence, longer_id)`` of every cut text.

    ``evidence`` is ``mark``, ``open`` (the model finds no end) or ``copy`` (a longer copy shows that it stops inside a
    word); ``longer_id`` is a document that goes on where it stops, or null. Defined results: null and blank texts are never
    cut; headings and captions are cut only by a mark or a copy; a null kind counts as prose; repeated rows come out once; an
    empty table gives no rows.
    """
    facts = cut(text_facts(documents, train_endings(documents)))
    rows = facts.select("doc_id", "source", "kind", "n_chars", "evidence", "in_word").distinct().join(longer_copies(documents, facts), "doc_id", "left")
    inside = F.col("in_word") & F.coalesce(F.col("next_char").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    by_end = F.col("evidence").isin("mark", "open")
    return rows.where(by_end | ((F.col("evidence") == "complete") & inside)).select(
        "doc_id", "source", "kind", "n_chars", F.when(by_end, F.col("evidence")).otherwise("copy").alias("evidence"), "longer_id"
    )


def truncation_rates(documents: DataFrame) -> DataFrame:
    """How often each source cuts: ``(source, n_texts, n_cut, share, usual_length)``.

    ``n_texts`` counts distinct documents with a text that isn't blank; ``usual_length`` is the commonest length of the
    source's cut texts, the likely field limit (the least of equally common ones), null if none is cut.
    """
    found = truncated_texts(documents)
    per = found.groupBy("source", "n_chars").agg(F.count_distinct("doc_id").alias("n"))
    lengths = per.groupBy("source").agg(F.sum("n").alias("n_cut"), F.min_by("n_chars", F.struct(-F.col("n"), F.col("n_chars"))).alias("usual_length"))
    texts = documents.where(F.col("text").rlike(r"(?U)\S")).groupBy("source").agg(F.count_distinct("doc_id").alias("n_texts"))
    j = texts.join(lengths.withColumnRenamed("source", "s"), texts["source"].eqNullSafe(F.col("s")), "left")
    n_cut = F.coalesce("n_cut", F.lit(0)).cast("long")
    return j.select("source", "n_texts", n_cut.alias("n_cut"), F.round(n_cut / F.col("n_texts"), 6).alias("share"), "usual_length")
