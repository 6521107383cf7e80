"""Splitting oversized chunks at natural boundaries (problem 3).

Lexical-cohesion segmentation: the words of an oversized chunk are compared in sliding blocks left and right of every
natural boundary (the end of a paragraph, line or sentence); valleys of the similarity mark topic boundaries. Within each
window that the size limit leaves, the cut goes to the deepest valley. Where a window has no natural boundary, all its gaps
between words count. Each piece opens with the last words of the piece before it.

Everything is per chunk; only chunks that may exceed the limit by their text's length (checked JVM-side) reach Python, and
those that the segmentation cuts come out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, RATIO, BLOCK = 1500, 200, 1.4, 40
_WORD = re.compile(r"\S+")
_END = re.compile(r"[.!?؟…][»”\"')\]]*$")


def tokens(words: int) -> int:
    return int(words * RATIO)


def most_words(limit: int = LIMIT) -> int:
    """The greatest number of words within the limit."""
    n = int((limit + 1) / RATIO) + 2
    while tokens(n) > limit:
        n -= 1
    return n


#: Gaps compared at once.
_SLICE = 2048


def cohesion(ids: np.ndarray, gaps: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """For the gap before each word of ``gaps``, the cosine of the word counts of the blocks beside it."""
    n = len(ids)
    pad = -1 - np.arange(block)  # equal to no word and not to each other
    known = np.concatenate([pad, ids, pad - block])
    out = np.zeros(len(gaps))
    for i in range(0, len(gaps), _SLICE):
        g = gaps[i : i + _SLICE]
        left, right = known[g[:, None] + np.arange(block)], known[g[:, None] + block + np.arange(block)]
        same = lambda x, y: (x[:, :, None] == y[:, None, :]).sum((1, 2), dtype=np.int64)
        ll, rr = same(left, left) - np.maximum(0, block - g), same(right, right) - np.maximum(0, g + block - n)
        out[i : i + _SLICE] = same(left, right) / np.sqrt(ll * rr)
    return out


def depths(sim: np.ndarray) -> np.ndarray:
    """Depth of the valley at each gap: how far the similarity rises to the nearest peaks on both sides."""
    n = len(sim)
    up_left, up_right = sim.tolist(), sim.tolist()
    s = sim.tolist()
    for i in range(1, n):
        if s[i - 1] >= s[i]:
            up_left[i] = up_left[i - 1]
    for i in range(n - 2, -1, -1):
        if s[i + 1] >= s[i]:
            up_right[i] = up_right[i + 1]
    return np.array(up_left) + np.array(up_right) - 2 * sim


def boundaries(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """How natural a cut before each word is: 3 paragraph, 2 line that ends a sentence, 1 sentence, 0 inside one."""
    out = np.zeros(len(spans))
    for i in range(1, len(spans)):
        between, ended = text[spans[i - 1][1] : spans[i][0]], bool(_END.search(text[spans[i - 1][0] : spans[i - 1][1]]))
        out[i] = 3 if between.count("\n") > 1 else 2 if "\n" in between and ended else 1 if ended or "\n" in between else 0
    return out


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces of ``text`` as word ranges without their overlap. One range if it is within the limit."""
    spans = [m.span() for m in _WORD.finditer(text)]
    n, most, lap = len(spans), most_words(limit), int(overlap / RATIO)
    if tokens(n) <= limit:
        return [(0, n)]
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(text[a:b].lower().strip(".,،؛:!?؟«»\"'()[]"), len(known)) for a, b in spans])
    kind = boundaries(text, spans)
    natural = np.flatnonzero(kind)
    depth = depths(cohesion(ids, natural))
    out, at = [], 0
    while n - at > most - (lap if at else 0):
        room = most - (lap if at else 0)
        half, end = at + max(1, room // 2), at + room  # a piece is at least half full, where that is natural
        i, j, k = np.searchsorted(natural, [half, at + 1, end + 1])
        i = i if i < k else j
        if i < k:
            gaps, deep = natural[i:k], depth[i:k]
        else:
            gaps = np.arange(half, end + 1)
            deep = depths(cohesion(ids, gaps))
        # the deepest valley; of equally deep ones the more natural boundary, then the fuller piece
        cut = int(gaps[np.lexsort((gaps, kind[gaps], np.round(deep, 12)))[-1]])
        out.append((at, cut))
        at = cut
    return [*out, (at, n)]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """Pieces of ``text`` within the limit, each opening with the last int(overlap / 1.4) words of the piece before it."""
    spans = [m.span() for m in _WORD.finditer(text)]
    if not spans:
        return [text]
    lap, out = int(overlap / RATIO), []
    for a, z in cuts(text, limit, overlap):
        first = max(0, a - lap) if a else 0
        out.append(text[spans[first][0] : spans[z - 1][1]])
    return out


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of oversized chunks: ``(book_id, chunk_id, chapter, piece_no, n_words, token_est, text)``.

    A chunk is oversized if int(words x 1.4) exceeds ``limit``; what its ``token_est`` says doesn't matter. ``limit`` must
    leave room for the overlap in half a piece. Defined results: chunks within the limit, null and empty texts give no rows;
    a null ``chapter`` stays null; rows repeated under one key give one set of pieces; an empty table gives no rows.
    """
    if int(overlap / RATIO) * 2 >= most_words(limit):
        raise ValueError("the overlap must be under half the limit")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for book, no, chapter, t in zip(b["book_id"], b["chunk_id"], b["chapter"], b["text"], strict=True):
                cut = pieces(t, limit, overlap)
                if len(cut) > 1:
                    for i, x in enumerate(cut, 1):
                        w = len(x.split())
                        rows.append((book, no, chapter, i, w, tokens(w), x))
            yield pd.DataFrame(rows, columns=["book_id", "chunk_id", "chapter", "piece_no", "n_words", "token_est", "text"])

    # words of one letter with one space between: fewer characters can't exceed the limit
    long = chunks.select("book_id", "chunk_id", "chapter", "text").where(F.length("text") >= 2 * (most_words(limit) + 1) - 1)
    return long.mapInPandas(each, "book_id string, chunk_id int, chapter string, piece_no int, n_words int, token_est int, text string")


def pieces_once(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``split_chunks`` with the pieces of repeated rows once."""
    return split_chunks(chunks, limit, overlap).dropDuplicates(["book_id", "chunk_id", "piece_no"])
