"""Evaluation texts leaking into training text (problem 9).

Texts become words: unbroken runs of letters or digits after Arabic vowel marks and tatweel are dropped, in lower case. Each
shard of the corpus (an Arrow batch of documents) gets a suffix array over its word sequence; every suffix of every test item
is looked up in it by binary search, and the matches are extended to the longest verbatim passage with its place.

Two exact reductions keep the array small. A word that no test item has can't be in a match, so all such words are one
separator; and a match of at least k words begins only where k words in a row are words of test items, so only these
positions get into the array. A match is taken at its left end only, which is decided by counts before any pair is made: a
phrase or word repeated n times gives about n pairs, not n squared.

Scale: the corpus is only scanned - no shuffle but that of the found (document, item) pairs. The evaluation set is worked off
in blocks of about ``BLOCK_WORDS`` words; the driver and each worker hold one block at a time, so no set is too large.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut

LEAST_WORDS = 12
#: Words of test items that a worker holds at a time.
BLOCK_WORDS = 2_000_000
#: Documents whose words are indexed together.
SHARD = 4096
#: Pairs of positions looked at together.
PAIRS = 1 << 21

MARKS = r"[ؐ-ؚـً-ٰٟۖ-ۜ۟-۪ۨ-ۭ]"


def word_text(c: Column) -> Column:
    """The words of a text with single spaces between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), MARKS, ""), r"[^\p{L}\p{N}]+", " "))


def _runs(x: np.ndarray, k: int) -> np.ndarray:
    """For each position how many words follow up to the next separator; 0 in runs of fewer than k words."""
    zero = np.flatnonzero(x == 0)
    nxt = np.searchsorted(zero, np.arange(len(x)))
    left = zero[nxt] - np.arange(len(x))
    size = np.diff(np.concatenate([[-1], zero]))[nxt] - 1
    return np.where(size >= k, left, 0)


def suffix_array(ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of ``ids`` with k words or more up to the next separator (0), in the order of their suffixes up to it.

    Prefix doubling: ranks of 1, 2, 4 ... words, until no rank changes. ``ids`` must end with a separator."""
    ahead = _runs(ids, k)
    at = np.flatnonzero(ahead)
    if not len(at):
        return at
    # the runs side by side, each with its separator behind it
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(ahead[at][:-1] == 1)])
    rank = np.zeros(int(place[-1]) + 2, np.int64)
    rank[place] = ids[at]
    left, width, classes = ahead[at], 1, -1
    while True:
        nxt = np.where(left > width, rank[np.minimum(place + width, len(rank) - 1)], 0)
        new, again = np.unique(rank[place] * (int(rank.max()) + 1) + nxt, return_inverse=True)
        rank[place] = again + 1
        if len(new) == classes or len(new) == len(at):
            break
        classes, width = len(new), width * 2
    whole = left >= k
    return at[whole][np.argsort(rank[place][whole], kind="stable")]


def _below(ids: np.ndarray, a: np.ndarray, items: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Sign of the comparison of the k words from ``a`` in ``ids`` with those from ``b`` in ``items``."""
    sign, live = np.zeros(len(a), np.int8), np.arange(len(a))
    for j in range(k):
        x, y = ids[a[live] + j], items[b[live] + j]
        sign[live] = np.sign(x.astype(np.int64) - y)
        live = live[x == y]
        if not len(live):
            break
    return sign


def search(ids: np.ndarray, sa: np.ndarray, items: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of all item suffixes ``q`` at once: the range of ``sa`` whose suffixes share their first k words."""
    out = []
    for least in (0, 1):  # first position not below; first position above
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(sa), np.int64)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            mid = (lo[live] + hi[live]) // 2
            right = _below(ids, sa[mid], items, q[live], k) < least
            lo[live[right]] = mid[right] + 1
            hi[live[~right]] = mid[~right]
        out.append(lo)
    return out[0], out[1]


def shard_matches(ids: np.ndarray, items: np.ndarray, k: int, pairs: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Longest verbatim matches of at least k words: positions in ``ids``, in ``items`` and lengths in words.

    Both are word ids with 0 as separator, beginning and ending with one. A match is given at its left end only; about
    ``pairs`` matches are given at a time.
    """
    sa, q = suffix_array(ids, k), np.flatnonzero(_runs(items, k) >= k)
    if not len(sa) or not len(q):
        return
    lo, hi = search(ids, sa, items, q, k)
    q, lo, hi = (x[hi > lo] for x in (q, lo, hi))
    if not len(q):
        return
    # each range by the word to the left; a pair with equal words there isn't a left end
    group = np.repeat(-1, len(sa))
    first = np.unique(lo)
    top = np.zeros(len(sa) + 1, np.int64)
    top[lo] = hi
    for_each = np.repeat(first, top[first] - first)
    group[for_each + np.arange(len(for_each)) - np.repeat(np.concatenate([[0], np.cumsum(top[first] - first)[:-1]]), top[first] - first)] = for_each
    before = ids[sa - 1].astype(np.int64)
    wide = int(max(before.max(initial=0), items.max(initial=0))) + 1
    key = group * wide + before
    order = np.argsort(key, kind="stable")
    key, by_left = key[order], sa[order]
    left = items[q - 1].astype(np.int64)
    at, end = np.searchsorted(key, lo * wide), np.searchsorted(key, (lo + 1) * wide)
    s, e = np.searchsorted(key, lo * wide + left), np.searchsorted(key, lo * wide + left, "right")
    e = np.where(left == 0, s, e)
    # two ranges a suffix: before and behind those with the same word to the left
    start, n, b = np.concatenate([at, e]), np.concatenate([s - at, end - e]), np.concatenate([q, q])
    some = n > 0
    start, n, b = start[some], n[some], b[some]
    total = np.cumsum(n)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + pairs, "right")))
        m = n[i:j]
        x = by_left[np.repeat(start[i:j] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())]
        y = np.repeat(b[i:j], m)
        length = np.full(len(x), k, np.int64)
        live = np.arange(len(x))
        while len(live):
            u, v = ids[x[live] + length[live]], items[y[live] + length[live]]
            live = live[(u == v) & (u > 0)]
            length[live] += 1
        yield x, y, length
        i = j


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, n_words, doc_word, item_word)``: for each document and item the longest passage of at least
    ``least`` consecutive words that they share, and the words (from 0) at which it begins in both.

    Defined results: null, empty and shorter texts share nothing; of equally long passages the first counts; repeated rows
    change nothing; empty tables give no rows.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, n_words int, doc_word int, item_word int"
    words = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", word_text(F.col("text")).alias("w")).withColumn("n", F.size(F.split("w", " "))).where(F.col("n") >= least).distinct()
    total = words.agg(F.sum("n").alias("n")).first().n or 0
    text = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", word_text(F.col("text")).alias("w"))
    n_blocks, found = ceil(total / block_words), []
    for i in range(n_blocks):
        part = words.where(F.pmod(F.xxhash64("item_id", "w"), F.lit(n_blocks)) == i).select("item_id", "w").collect()
        if part:
            hits = text.mapInArrow(_finder([(r.item_id, r.w.split()) for r in sorted(part)], least), schema)
            found.append(hits if n_blocks == 1 else cut(hits))
    if not found:
        return spark.createDataFrame([], schema)
    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i")))
    return (
        reduce(DataFrame.unionAll, found).groupBy("doc_id", "item_id").agg(best.alias("b"))
        .select("doc_id", "item_id", "b.n_words", (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"))
    )


def _longest(rows: np.ndarray) -> np.ndarray:
    """Of rows (document, item, length, place, place) the longest, then first, of each document and item."""
    rows = rows[np.lexsort((rows[:, 4], rows[:, 3], -rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[new]


def _finder(block: list[tuple[int, list[str]]], least: int):
    vocab = sorted({w for _, ws in block for w in ws})
    at = {w: i + 1 for i, w in enumerate(vocab)}
    item_ids = np.array([i for i, _ in block], np.int64)
    seq, begin = [0], []
    for _, ws in block:
        begin.append(len(seq))
        seq += [at[w] for w in ws] + [0]
    items, first = np.array(seq, np.int32), np.array(begin, np.int64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = pa.array(vocab, pa.string())
        for whole in batches:
            for i in range(0, whole.num_rows, SHARD):
                b = whole.slice(i, SHARD)
                words = pc.split_pattern(b.column(1).cast(pa.string()), " ")
                n = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = pc.fill_null(pc.index_in(words.flatten(), value_set=values), -1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
                # a separator before each document and one at the end
                ends = np.cumsum(n + 1)
                start = ends - n
                ids = np.zeros(int(ends[-1]) + 1, np.int32)
                ids[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
                best = np.zeros((0, 5), np.int64)
                for a, q, length in shard_matches(ids, items, least):
                    doc, item = np.searchsorted(start, a, "right") - 1, np.searchsorted(first, q, "right") - 1
                    best = _longest(np.concatenate([best, np.stack([doc, item, length, a - start[doc], q - first[item]], 1)]))
                doc, item, *rest = best.T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.column(0).to_numpy(zero_copy_only=False)[doc].astype(np.int64)), pa.array(item_ids[item]), *(pa.array(x.astype(np.int32)) for x in rest)],
                    ["doc_id", "item_id", "n_words", "doc_word", "item_word"],
                )

    return each


def clean_documents(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Documents without any leaked passage, with all their columns; null texts stay."""
    return documents.join(leaked_passages(documents, items, least).select("doc_id").distinct(), "doc_id", "left_anti")


def leaked_items(documents: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Each item that leaked: ``(item_id, n_documents, longest)``, longest in words."""
    return leaked_passages(documents, items, least).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("n_words").alias("longest"))

