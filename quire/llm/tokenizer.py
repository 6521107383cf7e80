"""Encoding of a corpus with a public byte-level BPE (problem 8).

Texts are cut into words by the vocabulary's own pattern; each distinct word of a batch is encoded once. Words of equal
byte-length bucket form a padded matrix of token ids. Each round looks all adjacent pairs up in a hash table and merges,
in every row, the leftmost pair of minimum rank; rows are then compacted. Rows without a mergeable pair leave the matrix.

Words of ``LONG`` bytes and more (a page of one letter, a megabyte of spaces) are merged with a heap of pairs instead, in the
same order - least rank first, leftmost of equal ones - so that no word takes time by the square of its length.

The vocabulary file's path is a parameter; the file is read by each worker and never copied. Encoding is per row, without
any shuffle; a text of any length is one row, and its words are the only thing that is held.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the public tokenizers' files lie.
FOLDER = "/opt/tokenizers"
#: Fixed value: the word pattern that belongs to byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose ids a worker keeps between batches; beyond it the store is emptied. Results don't depend on it.
KEEP_WORDS = 200_000
#: Bytes from which a word is merged by itself with a heap: rounds over a row take time by the square of its length.
LONG = 1024
#: Cells of one padded matrix, which bounds memory for words of any length.
CELLS = 1 << 20


class PairTable:
    """Merges as an open-addressing hash table: pair of ids -> id of the merged token, which is also its rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(len(merged) * 2.5 + 1))))
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        keys, todo = self._key(left, right), np.arange(len(merged))
        slot = self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[todo[put]], merged[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, slot = todo[rest], (slot[rest] + 1) & (size - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 20 | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        """Merged id of each pair, ``none`` for pairs that don't merge."""
        keys = self._key(left, right)
        slot = self._slot(keys)
        got = self.keys[slot]
        out = np.where(got == keys, self.values[slot], none).astype(np.int32)
        todo = np.flatnonzero((got != keys) & (got >= 0))
        while len(todo):
            slot_t = (slot[todo] + 1) & (len(self.keys) - 1)
            slot[todo] = slot_t
            got = self.keys[slot_t]
            hit = got == keys[todo]
            out[todo[hit]] = self.values[slot_t[hit]]
            todo = todo[~hit & (got >= 0)]
        return out


class BytePairs:
    """A byte-level BPE of which a token's id is its rank."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pattern = regex.compile(pattern)
        # a token may be split in several places into two tokens; each pair of lower rank than the whole merges into it
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.table = PairTable(np.array(left), np.array(right), np.array(merged, np.int32))
        self.pairs = dict(zip(zip(left, right, strict=True), merged, strict=True))
        self.known: dict[str, np.ndarray] = {}

    def _matrix(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of words of one length bucket."""
        size = np.array([len(x) for x in rows])
        width = int(size.max())
        flat = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8)]
        m = np.full((len(rows), width), -1, np.int32)
        m[np.arange(width) < size[:, None]] = flat
        out: list = [None] * len(rows)
        who = np.arange(len(rows))
        while len(who):
            if m.shape[1] > 1:
                rank = self.table.find(m[:, :-1].ravel(), np.maximum(m[:, 1:], 0).ravel(), self.NONE).reshape(len(m), -1)
                rank[m[:, 1:] < 0] = self.NONE
                at = rank.argmin(1)  # the leftmost of the least
                best = rank[np.arange(len(m)), at]
                done = best == self.NONE
            else:
                done = np.ones(len(m), bool)
            for i in np.flatnonzero(done):
                out[who[i]] = m[i][m[i] >= 0].copy()
            if done.all():
                break
            m, who, at, best = m[~done], who[~done], at[~done], best[~done]
            m[np.arange(len(m)), at] = best
            # compaction: what follows the merged pair moves one to the left
            cols = np.arange(m.shape[1] - 1)
            m = np.where(cols <= at[:, None], m[:, :-1], m[:, 1:])
            m = m[:, : max(1, int((m >= 0).sum(1).max()))]
        return out

    def _long(self, word: bytes) -> np.ndarray:
        """Ids of one long word: a linked list of tokens and a heap of (rank, place) of its pairs."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n, pairs = len(ids), self.pairs
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j], k = r, -1, nxt[j]
            nxt[i] = k
            if k < n:
                prv[k] = i
                if (q := pairs.get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (q, i, r, ids[k]))
            h = prv[i]
            if h >= 0 and (q := pairs.get((ids[h], r))) is not None:
                heapq.heappush(heap, (q, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def words(self, words: list[str]) -> None:
        """Put the ids of ``words`` into the store."""
        new = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(new) > KEEP_WORDS:
            self.known.clear()
            new = list(set(words))
        raw = sorted(((w.encode("utf-8", "replace"), w) for w in new), key=lambda x: len(x[0]))
        while raw and len(raw[-1][0]) >= LONG:
            x, w = raw.pop()
            self.known[w] = self._long(x)
        i = 0
        while i < len(raw):
            width = 1 << (len(raw[i][0]) - 1).bit_length()  # bucket of lengths up to the next power of two
            j, most = i, max(1, CELLS // max(1, width))
            while j < len(raw) and len(raw[j][0]) <= width and j - i < most:
                j += 1
            for (_, w), ids in zip(raw[i:j], self._matrix([x for x, _ in raw[i:j]]), strict=True):
                self.known[w] = ids
            i = j

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of each text: none for null, no ids for an empty text."""
        cut = [None if t is None else self.pattern.findall(t) for t in texts]
        out: list[np.ndarray | None] = []
        i = 0
        while i < len(cut):
            j, n = i, 0  # a stretch of texts whose words fit the store
            while j < len(cut) and (j == i or n + len(cut[j] or ()) <= KEEP_WORDS):
                n += len(cut[j] or ())
                j += 1
            self.words([w for c in cut[i:j] if c for w in c])
            for c in cut[i:j]:
                out.append(None if c is None else np.concatenate([self.known[w] for w in c]) if c else np.zeros(0, np.int32))
            i = j
        return out


@lru_cache(maxsize=2)
def load(path: str) -> BytePairs:
    return BytePairs(path)


def encode_documents(documents: DataFrame, path: str = f"{FOLDER}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``(doc_id, ids)``: the token ids of each document, without special tokens.

    Defined results: a null text has null ids, an empty text an empty list; repeated rows come out repeated; an empty table
    gives no rows; strings of special tokens in a text are ordinary text.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):  # so many texts' ids are held at once
                part = b.slice(i, 512)
                ids = bpe.encode(part.column(1).to_pylist())
                ends = np.cumsum([0] + [0 if x is None else len(x) for x in ids])
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
                null = pa.array([x is None for x in ids] or [], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=null)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(each, "doc_id long, ids array<int>")
