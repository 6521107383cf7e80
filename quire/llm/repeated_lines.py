"""Lines repeated across one site's documents (problem 1).

Numbers, dates and names in Latin letters are masked in a line (Arabic has no capitals that tell a name), the rest becomes a
stream of letters. Lines are clustered within each source by locality-sensitive hashing: ``BANDS`` bands of ``ROWS``
MinHashes over 5-letter shingles, all of different hash functions, bring masked streams of likeness 0.8 together with a
chance of 0.999; lines of a bucket are compared, and linked lines are one class. Classes whose lines stand in many books are
removed from the texts. Lines whose letters recur exactly are then told among the lines of these classes.

Scale: each page goes through Python once; what is written of a line is numbers. Shuffled are (bucket, value) pairs, aggregated
on the map side to the least and the greatest value of each bucket (of two values on, they differ), so a notice on a third of
all pages costs a few rows a map task. Only lines in buckets that two books or spellings share - notices, not body text - are
looked at further, and only one line of each spelling is read again to be compared.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut, small_or_shuffled

from .common import book_facts

LEAST_LETTERS, LEAST_BOOKS, SHINGLE = 20, 3, 5
_NOT_LETTERS = re.compile(r"[^\w\n]+|[\d_²³¹¼-¾]+")
# Month names, masked as parts of dates.
_MONTHS = re.compile(
    r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december|"
    r"janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre|"
    r"يناير|فبراير|مارس|أبريل|مايو|يونيو|يوليو|أغسطس|سبتمبر|أكتوبر|نوفمبر|ديسمبر)\b",
    re.IGNORECASE,
)
#: Capitalised words inside a line: names.
_NAMES = re.compile(r"(?<=[a-zà-öø-ÿ,;] )[A-ZÀ-ÖØ-Þ][\w’'-]*(?: [A-ZÀ-ÖØ-Þ][\w’'-]*)*")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def letters(text: str) -> str:
    """Letters of ``text`` in lower case; line ends stay."""
    return _NOT_LETTERS.sub("", text.lower())


def masked(text: str) -> str:
    """Letters of ``text`` without names and months; numbers aren't letters."""
    return letters(_NAMES.sub("", _MONTHS.sub("", text)))


#: Bands and MinHashes a band: two lines of likeness s share a bucket with chance 1 - (1 - s**ROWS)**BANDS.
BANDS, ROWS = 10, 3
_MIX = np.random.default_rng(5).integers(1, 2**32, (BANDS * ROWS, 2), np.uint32) | np.uint32(1)
#: Lines hashed at once, so that their shingles stay in the processor's cache.
_BLOCK = 1000


def minhash_bands(lines: list[str]) -> np.ndarray:
    """``BANDS`` 64-bit keys a line, each of ``ROWS`` MinHashes with hash functions of their own."""
    out = np.zeros((BANDS, len(lines)), np.uint64)
    for at in range(0, len(lines), _BLOCK):
        block = [x if len(x) >= SHINGLE else x.ljust(SHINGLE) for x in lines[at : at + _BLOCK]]
        size = np.array([len(x) for x in block])
        buf = np.frombuffer("".join(block).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        with np.errstate(over="ignore"):
            n = len(buf) - SHINGLE + 1
            h = buf[:n] * _ODD[0]
            for k in range(1, SHINGLE):
                h += buf[k : n + k] * _ODD[k]
            h = (h >> np.uint64(32)).astype(np.uint32)
            end = np.cumsum(size)
            cuts = np.stack([end - size, end - SHINGLE + 1], 1).ravel()
            if cuts[-1] >= n:
                cuts = cuts[:-1]
            x = np.empty_like(h)
            to = out[:, at : at + _BLOCK]
            for i, (p, q) in enumerate(_MIX):
                np.multiply(np.bitwise_xor(h, p, out=x), q, out=x)
                to[i // ROWS] = (to[i // ROWS] ^ np.minimum.reduceat(x, cuts)[::2]) * _ODD[i % ROWS]
    return out.view(np.int64)


_MONTH_WORDS = re.compile(_MONTHS.pattern.replace(r"\b", ""), re.IGNORECASE)
_CAPITAL_INSIDE = re.compile(r"[a-zà-öø-ÿ,;] [A-ZÀ-ÖØ-Þ]")


def long_lines(t: str) -> list[tuple[int, str, str]]:
    """``(line_no, letters, masked letters)`` of the lines of ``t`` with at least 20 letters, numbered from 1."""
    out, split = [], None
    may = bool(_CAPITAL_INSIDE.search(t) or _MONTH_WORDS.search(t))
    for j, x in enumerate(letters(t).split("\n")):
        if len(x) >= LEAST_LETTERS and (x.isalpha() or sum(map(str.isalpha, x)) >= LEAST_LETTERS):
            m = x
            if may:
                split = split or t.split("\n")
                if _MONTHS.search(split[j]) or _NAMES.search(split[j]):
                    m = masked(split[j])
            out.append((j + 1, x, m))
    return out


# two bands a number: 32 bits of a band are enough, as what shares a bucket is compared
_LINE = "book_id string, page_no int, line_no int, line_key long, mask_key long, " + ", ".join(f"band_{i} long" for i in range(0, BANDS, 2))
#: Likeness (Jaccard, of shingles of masked letters) that links two lines.
LIKE = 0.8


def _keys(texts: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64).view(np.int64)


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        at, no, plain, mask = [], [], [], []
        for i, t in enumerate(b["raw_text"]):
            for j, x, m in long_lines(t):
                at.append(i)
                no.append(j)
                plain.append(x)
                mask.append(m)
        rows, bands = b.iloc[at], minhash_bands(mask).view(np.uint64)
        yield pd.DataFrame(
            {
                "book_id": rows["book_id"].to_numpy(), "page_no": rows["page_no"].to_numpy(), "line_no": np.array(no, np.int32), "line_key": _keys(plain), "mask_key": _keys(mask),
                **{f"band_{i}": (bands[i] & np.uint64(0xFFFFFFFF00000000) | bands[i + 1] >> np.uint64(32)).view(np.int64) for i in range(0, BANDS, 2)},
            }
        )


def shingle_likeness(a: str, b: str) -> float:
    x, y = ({t[i : i + SHINGLE] for i in range(max(1, len(t) - SHINGLE + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def source_lines(pages: DataFrame, books: DataFrame) -> DataFrame:
    """The long lines of all pages whose book has a source, with their keys and bands: numbers only; cut from its lineage."""
    src = small_or_shuffled(book_facts(books).where("source IS NOT NULL").select("book_id", F.xxhash64("source").alias("source")))
    text = pages.select("book_id", "page_no", "raw_text").where("book_id IS NOT NULL AND page_no IS NOT NULL AND length(raw_text) >= 20")
    return cut(text.mapInPandas(_lines, _LINE).join(src, "book_id"))


def shared_buckets(lines: DataFrame) -> DataFrame:
    """``(source, mask_key, bucket)`` of the buckets that two spellings or, for equal letters, two books share; cut from its
    lineage."""
    book = F.hash("book_id")
    # bands are shared by two spellings, equal letters by two books; 32 bits are enough to tell two values of a bucket apart
    key = lambda k, i, v: F.struct(F.xxhash64("source", k, F.lit(i)).alias("bucket"), v.alias("value"))
    exact = [key("mask_key", -1, book), F.when(F.col("line_key") != F.col("mask_key"), key("line_key", -1, book))]
    band = lambda i: F.shiftrightunsigned(f"band_{i}", 32) if i % 2 == 0 else F.col(f"band_{i - 1}").bitwiseAND(F.lit(0xFFFFFFFF))
    of = F.array_compact(F.array(*exact, *(key(band(i), i, F.hash("mask_key")) for i in range(BANDS))))
    shared = lines.select(F.explode(of).alias("k")).groupBy("k.bucket").agg(F.min("k.value").alias("lo"), F.max("k.value").alias("hi")).where("lo < hi").select("bucket")
    shared = small_or_shuffled(cut(shared), 1_000_000)
    return cut(lines.select("source", "mask_key", F.explode(F.transform(of, lambda k: k["bucket"])).alias("bucket")).join(shared, "bucket", "left_semi").select("source", "mask_key", "bucket").distinct())


def links(keys: list[int], texts: list[str], like: float = LIKE) -> list[tuple[int, int]]:
    """Edges between the keys of a bucket that span what all its pairs of at least ``like`` likeness connect.

    A pair whose keys are already connected isn't compared, so variants of one notice take time by their number."""
    sets = [{t[i : i + SHINGLE] for i in range(max(1, len(t) - SHINGLE + 1))} for t in texts]
    groups: list[list[int]] = []
    out = []
    for i, x in enumerate(sets):
        joined, apart = [i], []
        for g in groups:
            for j in g:
                y = sets[j]
                if min(len(x), len(y)) >= like * max(len(x), len(y)) and (n := len(x & y)) >= like * (len(x) + len(y) - n):
                    out.append((keys[i], keys[j]))
                    joined += g
                    break
            else:
                apart.append(g)
        groups = [*apart, joined]
    return out


def components(edges: DataFrame) -> DataFrame:
    """``(source, node, label)``: the least node that each node of ``(source, a, b)`` is connected with."""
    both = cut(edges.unionByName(edges.select("source", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy("source", F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label"))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), ["source", "b"]).groupBy("source", F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(near, ["source", "node"]).select("source", "node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = step.select("source", F.col("node").alias("label"), F.col("label").alias("far"))
        step = cut(step.join(jump, ["source", "label"]).select("source", "node", "was", F.least("label", "far").alias("label")))
        label = step.drop("was")
        if step.where("label < was").isEmpty():
            return label


def spellings(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """``(source, mask_key, masked)`` of each masked spelling of ``lines``, read from one line of it."""
    one = lines.groupBy("source", "mask_key").agg(F.min(F.struct("book_id", "page_no", "line_no")).alias("r")).select("source", "mask_key", "r.*")
    per = one.groupBy("book_id", "page_no").agg(F.collect_list(F.struct("line_no", "source", "mask_key")).alias("want"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, want in zip(b["raw_text"], b["want"], strict=True):
                lines = long_lines(t)
                have = {(j, k): m for (j, _, m), k in zip(lines, _keys([m for *_, m in lines]).tolist(), strict=True)}
                # a page's repeated rows may differ: the one with the spelling counts
                rows += [(w["source"], w["mask_key"], have[w["line_no"], w["mask_key"]]) for w in want if (w["line_no"], w["mask_key"]) in have]
            yield pd.DataFrame(rows, columns=["source", "mask_key", "masked"])

    text = pages.select("book_id", "page_no", "raw_text").where("raw_text IS NOT NULL").join(small_or_shuffled(cut(per)), ["book_id", "page_no"])
    return text.select("raw_text", "want").mapInPandas(read, "source long, mask_key long, masked string").dropDuplicates(["source", "mask_key"])


def line_classes(pages: DataFrame, books: DataFrame, least_books: int = LEAST_BOOKS, like: float = LIKE) -> DataFrame:
    """Near-duplicate classes, a row a line: ``(book_id, page_no, line_no, source, line_key, line_class, n_books)``, source as
    its hash, line_key the hash of the line's letters.

    Lines of the same letters, and those at least ``like`` by their masked letters, are linked; what links connect is one
    class, and classes of ``least_books`` books count."""
    lines = source_lines(pages, books)
    band = shared_buckets(lines)
    lines = lines.join(small_or_shuffled(cut(band.select("source", "mask_key").distinct())), ["source", "mask_key"], "left_semi").select("book_id", "page_no", "line_no", "source", "line_key", "mask_key")
    # buckets of one spelling - of equal letters in several books - link nothing
    several = band.groupBy("bucket").agg(F.min("mask_key").alias("lo"), F.max("mask_key").alias("hi")).where("lo < hi").select("bucket")
    band = cut(band.join(several, "bucket", "left_semi"))
    spelling = band.join(spellings(pages, lines.join(band.select("source", "mask_key").distinct(), ["source", "mask_key"], "left_semi")), ["source", "mask_key"])

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(b: pd.DataFrame) -> pd.DataFrame:
            at = np.flatnonzero(np.r_[True, b["bucket"].to_numpy()[1:] != b["bucket"].to_numpy()[:-1], True])
            source, key, text, rows = b["source"].tolist(), b["mask_key"].tolist(), b["masked"].tolist(), []
            for i, j in zip(at[:-1], at[1:], strict=True):
                if j - i > 1:
                    rows += [(source[i], x, y) for x, y in links(key[i:j], text[i:j], like)]
            return pd.DataFrame(rows, columns=["source", "a", "b"])

        kept: list[pd.DataFrame] = []  # a bucket may go on in the next batch
        for b in batches:
            if len(b):
                last = b["bucket"] == b["bucket"].iloc[-1]
                if not last.all() or (kept and kept[-1]["bucket"].iloc[-1] != b["bucket"].iloc[-1]):
                    yield found(pd.concat([*kept, b[~last]]))
                    kept = []
                kept.append(b[last])
        if kept:
            yield found(pd.concat(kept))

    like_edges = spelling.repartition("bucket").sortWithinPartitions("bucket", "mask_key").mapInPandas(each, "source long, a long, b long")
    same = lines.where("line_key <> mask_key").select("source", F.col("line_key").alias("a"), F.col("mask_key").alias("b"))
    label = components(like_edges.unionByName(same).distinct()).select("source", F.col("node").alias("mask_key"), "label")
    near = lines.join(small_or_shuffled(cut(label)), ["source", "mask_key"], "left").withColumn("line_class", F.coalesce("label", "mask_key"))
    size = near.select("source", "line_class", "book_id").distinct().groupBy("source", "line_class").agg(F.count("*").alias("n_books")).where(F.col("n_books") >= least_books)
    return near.join(size, ["source", "line_class"]).select("book_id", "page_no", "line_no", "source", "line_key", "line_class", "n_books").distinct()


def repeated_lines(pages: DataFrame, books: DataFrame, least_books: int = LEAST_BOOKS) -> DataFrame:
    """Lines whose letters recur in ``least_books`` books of one source: ``(book_id, page_no, line_no)``, distinct.

    They are the lines of the frequent classes of ``line_classes`` for which an exact check holds: the very letters, not only
    like ones, stand in so many books. Equal letters are always one class, so none is lost.
    Lines are numbered from 1. Defined results: null and blank texts, lines of fewer than 20 letters and books without a
    row or source in ``books`` have none; repeated rows count once; an empty table gives no rows.
    """
    lines = line_classes(pages, books, least_books)
    often = lines.select("source", "line_key", "book_id").distinct().groupBy("source", "line_key").agg(F.count("*").alias("n")).where(F.col("n") >= least_books).select("source", "line_key")
    return lines.join(often, ["source", "line_key"], "left_semi").select("book_id", "page_no", "line_no").distinct()


def without_repeated_lines(pages: DataFrame, books: DataFrame, least_books: int = LEAST_BOOKS) -> DataFrame:
    """Each page's text without the lines of near-duplicate classes that stand in ``least_books`` books of its source:
    ``(book_id, page_no, text, n_removed)``; null texts stay null."""
    gone = line_classes(pages, books, least_books).select("book_id", "page_no", "line_no").groupBy("book_id", "page_no").agg(F.collect_list("line_no").alias("gone"))
    once = pages.select("book_id", "page_no", "raw_text").dropDuplicates(["book_id", "page_no"])
    kept = F.filter(F.split("raw_text", "\n"), lambda x, i: ~F.array_contains("gone", (i + 1).cast("int")))
    return once.join(gone, ["book_id", "page_no"], "left").select(
        "book_id", "page_no", F.when(F.col("gone").isNull(), F.col("raw_text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed")
    )
