"""Noise in text from scanned pages (problem 2).

An averaged-perceptron character editor decides between keeping a character, replacing it by a letter, deleting it, inserting
a letter and joining its line with the next. It works in two steps: a gate, an averaged perceptron over the classes of
neighbouring characters, is asked at every position of every page and lets through those where something may be wrong; the
editor proper, which sees the characters themselves, then names the edit. Both are trained here, on born-digital pages into
which a noise channel (what scanners confuse, how lines are broken, letters lost) puts errors whose repair is known. An exact
check of where the edit lies gives its kind.

A letter lost without a trace shows only in the word: the editor is also asked at words that no training page has, but
which lack one letter of a word that several have.

Page furniture is found by features of the line's place on the page, its length and its signs, learnt from pages whose title is
known; a running head must then be like the book's title, where the book has one.

Scale: all born-digital pages and all pages of titled books are learnt from. They are counted first - words with their
neighbours, windows of classes, shapes of lines -, so that learning takes time by what is distinct; everything else is per page,
and the gate is computed for whole batches at once. For finding, texts are not shuffled: pages send their flags and the few lines
that may be their head, and these meet the titles.
"""

from __future__ import annotations

import ast
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut, small_or_shuffled

from .common import book_facts, logistic
from .garbled import is_garbled

#: Share of the noise channel's errors that the gate may miss.
MISSED = 0.001

# What scanners read for which letters.
CHANNEL = {
    "1": "lلا", "|": "lلا", "!": "iا", "9": "gqو", "0": "oةه", "€": "e", "@": "a", "+": "t", "5": "sه", "$": "s", "3": "eش", "6": "bة", "%": "ي",
    "*": "م", "^": "ن", "#": "س", ";": "ر", "~": "ب", "٥": "ه", "£": "ع", "8": "bB", "4": "aط", "7": "tع", "2": "zث", "&": "ك",
}
# Signs that break a word at a line's end.
BREAKS = "-‐¬=–‑­"
_LETTER = r"[^\W\d_]"
_MARKS = "̀-ًͯ-ٰٟ"
_SEEN_MARKS = re.compile(rf"[{_MARKS}]")


def page_text(raw: str | None, pre: str | None) -> str:
    """``raw`` unless it is null or blank, then ``pre``; "" if both are."""
    return raw if raw and raw.strip() else (pre or "")


# ------------------------------------------------------------------------------------------------- editor


def _kind(c: str) -> str:
    if not c:
        return "^"
    if c == "\n":
        return "n"
    if c.isalpha():
        return "A" if "؀" <= c <= "ۿ" else "L"
    return "9" if c.isdigit() else "_" if c.isspace() else c


def features(t: str, i: int, j: int) -> list[str]:
    """Features of the span t[i:j] in its context; marks on letters are looked through."""
    a = i
    while a > 0 and _SEEN_MARKS.match(t[a - 1]):
        a -= 1
    p, pp = t[a - 1 : a], t[max(0, a - 2) : max(0, a - 1)]
    k = j
    while k < len(t) and t[k] in " \t\n":
        k += 1
    n, nn, s = t[j : j + 1], t[j + 1 : j + 2], t[i:j]
    nl = "\n" in t[j:k] or (k >= len(t))
    depth = "o" if s == "»" and t.rfind("«", 0, i) > t.rfind("»", 0, i) else "c"
    sk = s + _kind(p)
    return [
        "b", "s" + s, "sk" + sk + _kind(n), "d" + s + depth + _kind(p), "p" + sk + p.lower(), "n" + sk + n.lower(), "pn" + sk + p.lower() + n.lower(),
        "pp" + sk + pp.lower() + p.lower(), "nn" + sk + n.lower() + nn.lower(), f"l{s}{nl}{_kind(p)}{_kind(t[k:k + 1])}",
    ]


# Characters that the gate tells apart; other signs are one class, letters of one script too.
_TOLD = "0123456789٥" + ".,:;!?،؛؟…" + "’'\"“”«»()[]{}<>" + "-‐‑¬=–—\u00ad" + "/\\*|_%€@+^#~$£&"
_ARABIC_LETTER, _LETTER_CLASS, _MARK_CLASS, _BLANK, _LINE_END, _DIGIT = range(1, 7)
_CLASSES = np.zeros(0x10000, np.uint8)
for _i in range(0x10000):
    _c = chr(_i)
    if _c.isalpha():
        _CLASSES[_i] = _ARABIC_LETTER if 0x600 <= _i <= 0x6FF else _LETTER_CLASS
    elif _c.isdigit():
        _CLASSES[_i] = _DIGIT
    elif _c.isspace():
        _CLASSES[_i] = _BLANK
for _i in (*range(0x300, 0x370), *range(0x64B, 0x660), 0x670):
    _CLASSES[_i] = _MARK_CLASS
_CLASSES[ord("\n")] = _LINE_END
for _i, _c in enumerate(_TOLD):
    _CLASSES[ord(_c)] = 7 + _i
_BITS = 18
#: Characters whose features are held at once, whatever the length of a text.
_SLICE = 1 << 18


class Gate:
    """Averaged perceptron over the classes of a character and its neighbours, asked at every position of a text."""

    def __init__(self) -> None:
        self.at, self.w, self.least = np.zeros(0, np.int64), np.zeros(0), 0.0

    @staticmethod
    def _classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each character that isn't a mark, its position in the texts put side by side with three line ends between,
        and where each text begins there."""
        raw = np.frombuffer(("\n\n\n" + "\n\n\n".join(texts) + "\n\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _CLASSES[np.minimum(raw, 0xFFFF)]
        pos = np.flatnonzero(c != _MARK_CLASS)
        return c[pos], pos, 3 + np.concatenate([[0], np.cumsum([len(t) + 3 for t in texts])])

    @staticmethod
    def _windows(c: np.ndarray) -> tuple[np.ndarray, ...]:
        """The class of each character after those of the two before it and before those of the two after it."""
        c = c.astype(np.int64)
        return tuple(np.roll(c, k) for k in (2, 1, 0, -1, -2))

    @classmethod
    def _features(cls, c: np.ndarray) -> np.ndarray:
        """Feature numbers of each character (features x characters) by its class and those of its neighbours."""
        return cls._of_windows(*cls._windows(c))

    @staticmethod
    def _of_windows(p2: np.ndarray, p1: np.ndarray, c: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
        parts = (c, p1 * 97 + c, c * 97 + n1, (p1 * 97 + c) * 97 + n1, ((p2 * 97 + p1) * 97 + c) * 97 + n1, ((p1 * 97 + c) * 97 + n1) * 97 + n2)
        return np.stack([((x * len(parts) + i) * 0x9E3779B1 >> 7) % (1 << _BITS) for i, x in enumerate(parts)])

    def _hits(self, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where ``c`` is let through, slice by slice with two neighbours on both sides."""
        out = []
        for i in range(0, len(c), _SLICE):
            a = max(0, i - 2)
            s = w[self._features(c[a : i + _SLICE + 2])].sum(0)[i - a :][: min(_SLICE, len(c) - i)]
            out.append(i + np.flatnonzero(s >= self.least))
        return np.concatenate(out) if out and len(self.at) else np.zeros(0, np.int64)

    def fit(self, pages: list[tuple[str, set[int]]], rounds: int = 5, missed: float = MISSED) -> Gate:
        """Learn from texts and the positions where they are wrong; the threshold lets through all but ``missed`` of them."""
        w, total, step = np.zeros(1 << _BITS), np.zeros(1 << _BITS), 1
        made = []
        for t, wrong in pages:
            c, pos, begin = self._classes([t])
            made.append((self._features(c), np.isin(pos, [begin[0] + i for i in wrong])))
        for _ in range(rounds):
            for f, y in made:
                s = w[f].sum(0)
                for at, delta in ((f[:, y & (s <= 0)], 1.0), (f[:, ~y & (s >= 0)], -1.0)):
                    np.add.at(w, at, delta)
                    np.add.at(total, at, delta * step)
                step += 1
        w -= total / step
        self.at = np.flatnonzero(w)
        self.w = w[self.at]
        scores = np.concatenate([w[f].sum(0)[y] for f, y in made] or [np.zeros(0)])
        self.least = float(np.quantile(scores, missed)) if len(scores) else 0.0
        return self

    @classmethod
    def count(cls, pages: list[tuple[str, set[int]]]) -> dict[tuple[int, bool], int]:
        """How often each window of five classes, as one number, stands around a clean and a wrong character of the texts."""
        out: Counter = Counter()
        for a in range(0, len(pages), 64):
            c, pos, begin = cls._classes([t for t, _ in pages[a : a + 64]])
            wrong = np.isin(pos, [begin[k] + i for k, (_, at) in enumerate(pages[a : a + 64]) for i in at])
            code = np.zeros(len(c), np.int64)
            for x in cls._windows(c):
                code = code * 97 + x
            for k, n in zip(*(v.tolist() for v in np.unique(code * 2 + wrong, return_counts=True)), strict=True):
                out[k >> 1, bool(k & 1)] += n
        return out

    def fit_counts(self, codes: np.ndarray, clean: np.ndarray, wrong: np.ndarray, rounds: int = 5, missed: float = MISSED) -> Gate:
        """``fit`` on counted windows: of each the label that it has more often is learnt; the threshold lets through all but
        ``missed`` of the wrong characters counted."""
        order = np.random.default_rng(5).permutation(len(codes))
        f = self._of_windows(*(codes[order] // 97**k % 97 for k in (4, 3, 2, 1, 0)))
        wrong = wrong[order]
        y, w, total, step = wrong > clean[order], np.zeros(1 << _BITS), np.zeros(1 << _BITS), 1
        for _ in range(max(rounds, min(100, 40_000 // max(1, len(codes))))):  # few windows: more rounds
            for a in range(0, len(codes), 64):
                g, z = f[:, a : a + 64], y[a : a + 64]
                s = w[g].sum(0)
                for at, delta in ((g[:, z & (s <= 0)], 1.0), (g[:, ~z & (s >= 0)], -1.0)):
                    np.add.at(w, at, delta)
                    np.add.at(total, at, delta * step)
                step += 1
        w -= total / step
        self.at = np.flatnonzero(w)
        self.w = w[self.at]
        scores = w[f].sum(0)[wrong > 0]
        by = np.argsort(scores, kind="stable")
        seen = np.cumsum(wrong[wrong > 0][by])
        self.least = float(scores[by][np.searchsorted(seen, missed * seen[-1], "right")]) if len(scores) else 0.0
        return self

    def places(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """The spans of each text that may be wrong: runs of positions let through."""
        w = np.zeros(1 << _BITS)
        w[self.at] = self.w
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for a in range(0, len(texts), 64):
            c, pos, begin = self._classes(texts[a : a + 64])
            hit = pos[self._hits(w, c)]
            page = np.searchsorted(begin, hit, "right") - 1
            inside = (page >= 0) & (page < len(begin) - 1)
            hit, page = hit[inside], page[inside]
            for n, i in zip(page.tolist(), (hit - begin[page]).tolist(), strict=True):
                spans = out[a + n]
                if i < len(texts[a + n]):
                    if spans and spans[-1][1] == i and not texts[a + n][i].isspace():
                        spans[-1] = (spans[-1][0], i + 1)
                    else:
                        spans.append((i, i + 1))
        return out


class Editor:
    """Averaged perceptron over the edits K (keep), D (delete), J (join lines), Rc (replace by c), I (insert what the word lacks)."""

    gate: Gate
    lacking: dict[str, tuple[int, str]]

    def __init__(self) -> None:
        self.w: dict[str, dict[str, float]] = {}
        self.edits: list[str] = ["K"]
        self.gate, self.words, self.lacking = Gate(), frozenset(), {}

    def fit(self, examples: list[tuple[list[str], str]], rounds: int = 3, seed: int = 7) -> Editor:
        rng = random.Random(seed)
        w: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        total: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        self.edits = sorted({e for _, e in examples} | {"K"})
        step, order = 1, list(range(len(examples)))
        for _ in range(rounds):
            rng.shuffle(order)
            for i in order:
                f, gold = examples[i]
                got = self._best(w, f)
                if got != gold:
                    for x in f:
                        w[x][gold] += 1
                        total[x][gold] += step
                        w[x][got] -= 1
                        total[x][got] -= step
                step += 1
        self.w = {x: {e: v - total[x][e] / step for e, v in y.items() if v or total[x][e]} for x, y in w.items()}
        return self

    def _best(self, w, f: list[str]) -> str:
        score: dict[str, float] = {}
        for x in f:
            for e, v in (w.get(x) or {}).items():
                score[e] = score.get(e, 0.0) + v
        return max(self.edits, key=lambda e: (score.get(e, 0.0), e == "K"))

    def edit(self, t: str, i: int, j: int) -> str:
        return self._best(self.w, features(t, i, j))


_BY_LETTER: dict[str, list[str]] = defaultdict(list)
for _s, _ls in CHANNEL.items():
    for _l in _ls:
        _BY_LETTER[_l].append(_s)


_WORD = re.compile(r"[^\W\d_]{4,}")
#: A sign or digit between letters, after a word or at a line's end: where clean text teaches to keep.
_KEPT = re.compile(rf"(?<=[^\W\d_])[^\w\s{_MARKS}](?=[^\W\d_]|\s|$)|(?<=[^\W\d_])\d+(?=[^\W\d_])|(?<=[^\W\d_])[ \t]+[-–—=](?=[ \t]*\n)")


def lacking_words(words: Counter, least: int = 3) -> dict[str, tuple[int, str]]:
    """What frequent words of five letters or more become by losing one: where it was, and the letter. What several words
    become, or what is a word itself, isn't among them."""
    out: dict[str, tuple[int, str] | None] = {}
    for w, n in words.items():
        if n >= least and len(w) >= 5:
            for i in range(1, len(w) - 1):
                x = w[:i] + w[i + 1 :]
                if w[i] != w[i - 1]:
                    out[x] = None if x in out else (i, w[i])
    return {x: v for x, v in out.items() if v is not None and x not in words}


def gap_features(t: str, i: int, c: str) -> list[str]:
    """Features of a gap before t[i] where the letter ``c`` may be lacking."""
    p, n = t[i - 1 : i].lower(), t[i : i + 1].lower()
    return ["ib", "ic" + c, "ipn" + p + n, "ipc" + p + c, "icn" + c + n]


def _lack(lacking: dict[str, tuple[int, str]], words: frozenset, m: re.Match) -> tuple[int, str] | None:
    w = m.group().lower()
    return None if w in words else lacking.get(w)


def noisy_examples(texts: list[str], seed: int = 3, lacking: dict[str, tuple[int, str]] | None = None, words: frozenset = frozenset()) -> list[tuple[list[str], str]]:
    """Examples from clean texts: errors of the channel put in with their repair, and what must be kept."""
    rng = random.Random(seed)
    out: list[tuple[list[str], str]] = []
    lacking = lacking or {}
    for t in texts:
        for m in _WORD.finditer(t):
            i = rng.randrange(m.start() + 1, m.end() - 1)
            signs = _BY_LETTER.get(t[i].lower())
            if signs:
                s = rng.choice(signs)
                out.append((features(t[:i] + s + t[i + 1 :], i, i + 1), "R" + t[i].lower()))
            r = rng.random()
            if r < 0.05:  # signs too many
                s = rng.choice(list(CHANNEL))
                out.append((features(t[:i] + s + s + t[i:], i, i + 2), "D"))
            elif r < 0.2:
                s = rng.choice(BREAKS)
                x = t[:i] + s + rng.choice(["\n", "\n", " \n"]) + t[i:]
                out.append((features(x, i, i + 1), "J"))
            if (lost := lacking.get(m.group().lower()[: i - m.start()] + m.group().lower()[i - m.start() + 1 :])) and lost[0] == i - m.start() and r < 0.5:
                out.append((gap_features(t[:i] + t[i + 1 :], i, lost[1]), "I"))
            elif lost := _lack(lacking, words, m):
                out.append((gap_features(t, m.start() + lost[0], lost[1]), "K"))
        for m in re.finditer("،", t):
            x = t[: m.start()] + "»" + t[m.end() :]
            out.append((features(x, m.start(), m.start() + 1), "R،"))
        out += [(features(t, i := m.end() - len(m.group().lstrip()), m.end()), "K") for m in _KEPT.finditer(t)]
    return out


def noisy_pages(texts: list[str], seed: int = 4) -> list[tuple[str, set[int]]]:
    """Clean texts with errors of the channel, and the positions of the wrong signs."""
    rng, out = random.Random(seed), []
    for t in texts:
        parts, wrong, done, size = [], set(), 0, 0

        def put(upto: int, new: str, skip: int) -> None:
            nonlocal done, size
            parts.extend((t[done:upto], new))  # noqa: B023
            size += upto - done
            wrong.update(size + k for k, c in enumerate(new) if not c.isspace())  # noqa: B023
            size += len(new)
            done = upto + skip

        for m in re.finditer(_WORD.pattern + "|،", t):
            if m.group() == "،":
                if rng.random() < 0.3:
                    put(m.start(), "»", 1)
                continue
            i, r = rng.randrange(m.start() + 1, m.end() - 1), rng.random()
            signs = _BY_LETTER.get(t[i].lower())
            if r < 0.1 and signs:
                put(i, rng.choice(signs), 1)
            elif r < 0.12:
                put(i, rng.choice(list(CHANNEL)) * 2, 0)
            elif r < 0.18:
                put(i, rng.choice(BREAKS) + rng.choice(["\n", "\n", " \n"]), 0)
        out.append(("".join([*parts, t[done:]]), wrong))
    return out


def editor_from(texts: list[str]) -> Editor:
    """Editor and gate learnt from clean texts."""
    words = Counter(m.group().lower() for t in texts for m in _WORD.finditer(t))
    e = Editor()
    e.words, e.lacking = frozenset(words), lacking_words(words)
    # the gate's clean places are those of the texts themselves, too
    e.gate.fit(noisy_pages(texts) + [(t, set()) for t in texts])
    return e.fit(noisy_examples(texts, lacking=e.lacking, words=e.words))


#: Distinct examples that one editor is learnt from before the editors are averaged.
SHARD = 30_000
_BETWEEN = "\x1f"
_COUNTED = "kind string, unit string, gold string, n double"


def word_units(t: str) -> list[str]:
    """The words of a text with the character before and after: all that the examples of errors inside them depend on."""
    return [t[max(0, m.start() - 1) : m.end() + 1] for m in _WORD.finditer(t)]


def kept_examples(t: str) -> list[tuple[list[str], str]]:
    """What must be kept in a clean text, and its commas read as closing quotes."""
    out = []
    for m in re.finditer("،", t):
        out.append((features(t[: m.start()] + "»" + t[m.end() :], m.start(), m.start() + 1), "R،"))
    return out + [(features(t, m.end() - len(m.group().lstrip()), m.end()), "K") for m in _KEPT.finditer(t)]


def unit_examples(unit: str, n: float) -> list[tuple[list[str], str, float]]:
    """Examples with their weight from a word that stands ``n`` times in the pages: signs for inner letters, signs too many and
    broken lines, as often as ``noisy_examples`` has them. Of a word with many, different errors stand for all, by their weight."""
    m, rng, out = _WORD.search(unit), random.Random(unit), []
    inner = range(m.start() + 1, m.end() - 1)
    may = [(i, s) for i in inner for s in _BY_LETTER.get(unit[i].lower(), ())]
    hit = n * len({i for i, _ in may}) / len(inner)
    for i, s in rng.sample(may, min(len(may), max(1, int(hit)))) if may else ():
        out.append((features(unit[:i] + s + unit[i + 1 :], i, i + 1), "R" + unit[i].lower(), hit / min(len(may), max(1, int(hit)))))
    times = min(20, max(1, int(n * 0.05)))
    for _ in range(times):
        i, s = rng.choice(inner), rng.choice(list(CHANNEL))
        out.append((features(unit[:i] + s + s + unit[i:], i, i + 2), "D", n * 0.05 / times))
    times = min(20, max(1, int(n * 0.15)))
    for _ in range(times):
        i, s = rng.choice(inner), rng.choice(BREAKS)
        out.append((features(unit[:i] + s + rng.choice(["\n", "\n", " \n"]) + unit[i:], i, i + 1), "J", n * 0.15 / times))
    return out


def _counts(pages: DataFrame) -> DataFrame:
    """Over all texts ``(kind, unit, gold, n)``: words (w), what is to be kept (k) and the gate's windows (g), counted."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*k, float(n)) for k, n in held.items()], columns=["kind", "unit", "gold", "n"])

        for b in batches:
            keyed = [(t, zlib.crc32(f"{book} {no} {t}".encode())) for book, no, t in zip(b["book_id"], b["page_no"], b["raw_text"], strict=True) if not is_garbled(t)]
            for a in range(0, len(keyed), 512):
                part = [t for t, _ in keyed[a : a + 512]]
                for t in part:
                    held.update([("w", u, "") for u in word_units(t)])
                    held.update([("k", _BETWEEN.join(f), g) for f, g in kept_examples(t)])
                made = [p for t, seed in keyed[a : a + 512] for p in noisy_pages([t], seed)]
                for (code, wrong), n in Gate.count(made + [(t, set()) for t in part]).items():
                    held["g", str(code), "1" if wrong else "0"] += n
                if len(held) > 200_000:
                    yield rows()
                    held.clear()
        yield rows()

    return pages.select("book_id", "page_no", "raw_text").mapInPandas(each, _COUNTED).groupBy("kind", "unit", "gold").agg(F.sum("n").alias("n"))


def _made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        held: Counter = Counter()
        for kind, unit, gold, n in b[["kind", "unit", "gold", "n"]].itertuples(index=False):
            for f, g, x in unit_examples(unit, n) if kind == "w" else ():
                held[_BETWEEN.join(f), g] += x
            if kind == "k":
                held[unit, gold] += n
        yield pd.DataFrame([(*k, x) for k, x in held.items()], columns=["f", "gold", "n"])


def _learnt(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values("f")
    e = Editor().fit([(f.split(_BETWEEN), g) for f, g in zip(shard["f"], shard["gold"], strict=True)])
    return pd.DataFrame([(x, g, v) for x, y in e.w.items() for g, v in y.items()], columns=["x", "edit", "v"])


def learn_lost(e: Editor, counts: DataFrame) -> None:
    """Teach the editor what letters may be lost, from the counted words of all pages."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": [_WORD.search(u).group().lower() for u in b["unit"]], "n": b["n"]})

    def lacking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(w[:i] + w[i + 1 :], i, w[i]) for w in b["word"] for i in range(1, len(w) - 1) if w[i] != w[i - 1]], columns=["word", "i", "c"])

    w = counts.where("kind = 'w'").select("unit", "n").mapInPandas(words, "word string, n double").groupBy("word").agg(F.sum("n").alias("n"))
    made = w.where("n >= 3 AND length(word) >= 5").mapInPandas(lacking, "word string, i int, c string")
    made = made.groupBy("word").agg(F.count("*").alias("times"), F.first("i").alias("i"), F.first("c").alias("c")).where("times = 1").join(w.select("word"), "word", "left_anti")
    e.lacking = {x: (i, c) for x, i, c in made.select("word", "i", "c").toPandas().sort_values("word").itertuples(index=False)}
    gaps = Editor().fit([(list(f), "I") for f in sorted({tuple(gap_features(x, i, c)) for x, (i, c) in e.lacking.items()})])
    e.w.update(gaps.w)


def train_editor(pages: DataFrame, lost: bool = True) -> Editor:
    """Editor and gate learnt from all born-digital pages (from all pages where there are none), ``lost``: lost letters too.

    The pages are read once and counted: words with their neighbours, signs to be kept, windows of the gate. Of examples with
    equal features the heavier label is learnt. Editors learnt on shards of the distinct examples are averaged."""
    text = pages.where("length(raw_text) > 40")
    digital = text.where("pdf_type = 'digital'")
    counts = cut(_counts(digital if digital.limit(1).count() else text))
    e = Editor()
    g = counts.where("kind = 'g'").groupBy(F.col("unit").cast("long").alias("code")).agg(*(F.sum(F.when(F.col("gold") == x, F.col("n")).otherwise(0)).alias(c) for x, c in (("0", "clean"), ("1", "wrong"))))
    g = g.orderBy("code").toPandas()
    e.gate.fit_counts(*(g[c].to_numpy() for c in ("code", "clean", "wrong")))
    made = counts.where("kind IN ('w', 'k')").mapInPandas(_made, "f string, gold string, n double").groupBy("f", "gold").agg(F.sum("n").alias("n"))
    examples = cut(made.groupBy("f").agg(F.max_by("gold", F.struct("n", "gold")).alias("gold")))
    shards = max(1, round(examples.count() / SHARD))
    w = examples.withColumn("shard", F.pmod(F.xxhash64("f"), F.lit(shards))).groupBy("shard").applyInPandas(_learnt, "x string, edit string, v double")
    for x, edit, v in w.groupBy("x", "edit").agg((F.sum("v") / shards).alias("v")).toPandas().sort_values(["x", "edit"]).itertuples(index=False):
        e.w.setdefault(x, {})[edit] = v
    e.edits = sorted({k for y in e.w.values() for k in y} | {"K", "I"})
    if lost:
        learn_lost(e, counts)
    return e


def _kind_of(t: str, i: int, j: int, edit: str) -> str | None:
    """Kind of an edit of t[i:j], checked exactly: a sign or digits inside a word, a closing quote for a comma after one, a sign
    at a line's end straight after a letter; None for what is neither."""
    a = i
    while a > 0 and _SEEN_MARKS.match(t[a - 1]):
        a -= 1
    if a == 0 or not t[a - 1].isalpha() or any(c.isalpha() for c in t[i:j]):
        return None
    if edit == "J":
        k = j
        while k < len(t) and t[k] in " \t":
            k += 1
        return "hyphen" if j - i == 1 and t[k : k + 1] == "\n" and t[k:].strip() else None
    if t[j : j + 1].isalpha():
        return "misread"
    if edit == "R،" and (j == len(t) or t[j].isspace()):
        return None if t.rfind("«", 0, i) > t.rfind("»", 0, i) else "misread"
    return None


def errors_at(t: str, editor: Editor, places: list[tuple[int, int]]) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, edit)`` of the places that the editor wants to change, of a kind that the exact check tells."""
    out = []
    for i, j in places:
        if j - i > 2:  # longer than the channel's errors: one of its ends may be
            spans = [(i, i + 1), (j - 1, j)]
        else:
            spans = [(i, j)]
        for a, z in spans:
            e = editor.edit(t, a, z)
            if e not in "KI" and (kind := _kind_of(t, a, z, e)):
                out.append((kind, a, z, e))
    return out


def errors(t: str, editor: Editor) -> list[tuple[str, int, int, str]]:
    return errors_at(t, editor, editor.gate.places([t])[0])


def lost_letters(t: str, editor: Editor) -> list[tuple[int, str]]:
    """Gaps and the letters that the editor wants to insert there."""
    out = []
    for m in _WORD.finditer(t):
        lost = _lack(editor.lacking, editor.words, m)
        if lost and editor._best(editor.w, gap_features(t, m.start() + lost[0], lost[1])) == "I":
            out.append((m.start() + lost[0], lost[1]))
    return out


# ---------------------------------------------------------------------------------------------- furniture

_ORNAMENT = r"[^\w\n�]|_"
#: A line that gives nothing but a page number, perhaps with a label or ornaments.
PAGE_NUMBER = re.compile(rf"(?:{_ORNAMENT})*(?:(?:صفحة|صحيفة|ص|page|pages|pg|p|pp|s|n)(?:{_ORNAMENT})*)?\d{{1,4}}(?:{_ORNAMENT})*", re.IGNORECASE)
_FOR_HEAD = re.compile(r"[^\w\s]|[\d_]")


def head_key(line: str) -> str:
    """A line as compared with a title: words in lower case, without numbers, marks and signs."""
    return " ".join(_FOR_HEAD.sub("", line).split()).lower()


def _beside_number(line: str) -> bool:
    s = line.strip()
    return bool(re.match(r"\W*\d{1,4}(?:\s*[|,.،]\s*|\s{2,})[^\W\d_]", s) or re.search(r"[^\W\d_](?:\s*[|,.،]\s*|\s{2,})\d{1,4}\W*$", s))


def page_numbers(lines: list[str]) -> list[int]:
    """Indices of page-number lines. Site notices may follow them, so they needn't be the last lines of a page."""
    return [i for i, x in enumerate(lines) if x and PAGE_NUMBER.fullmatch(x)]


_ALPHA, _NUMBER, _INNER = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"[.!?؟،؛].")


def line_shapes(lines: list[str]) -> list[tuple[int, tuple]]:
    """Place, length beside the page's usual one and signs of the lines of a page that have letters."""
    full = [(i, x, x.strip()) for i, x in enumerate(lines)]
    full = [r for r in full if r[2]]
    usual = sorted([len(s) for *_, s in full])[len(full) // 2] if full else 1
    out = []
    for k, (i, x, s) in enumerate(full):
        if _ALPHA.search(s):
            number = bool(_NUMBER.search(s))
            out.append((i, (
                min(k, 6), min(4 * len(s) // usual, 6), min(s.count(" "), 12), s[-1] if s[-1] in ".!?؟،,:»”-" else "a", bool(_INNER.search(s)), number and _beside_number(x),
                x[0].isspace(), i + 1 < len(lines) and not lines[i + 1].strip(), number, s.isupper(), s[0] in "«“*|-", s[0].islower(),
            )))
    return out


def shape_features(shape: tuple) -> list[str]:
    top, share, *_ = shape
    return ["b", f"t{top}s{share}", f"t{top}n{shape[5]}", *(f"{i}:{v}" for i, v in enumerate(shape))]


class Heads:
    """Logistic model of which lines of a page are running heads, by their place and shape alone."""

    def __init__(self, weights: dict[str, float] | None = None, least: float = -1e9, sure: float = 1e9) -> None:
        self.weights, self.least, self.sure = weights or {}, least, sure
        self._scores: dict[tuple, float] = {}  # of the few shapes that there are

    @classmethod
    def fit(cls, pages: list[tuple[list[str], str]]) -> Heads:
        """Learn from pages and the key of their book's title; lines like it are heads. ``least`` lets through all of them
        and more; ``sure`` is where a line is a head more likely than not, title or no title."""
        fs, ys = [], []
        for lines, title in pages:
            for i, shape in line_shapes(lines):
                fs.append(shape)
                ys.append(int(_like(head_key(lines[i]), title)))
        if not any(ys):
            return cls()
        model = cls(logistic([shape_features(f) for f in fs], ys), sure=0.0)
        scores = np.array([model.score(f) for f, y in zip(fs, ys, strict=True) if y])
        model.least = float(scores.min()) - 4.0  # the title decides what is let through
        return model

    @classmethod
    def fit_counts(cls, shapes: list[tuple], labels: list[int], counts: list[float]) -> Heads:
        """``fit`` on counted shapes of all lines: ``least`` lets through the shapes of all heads there are."""
        if not any(labels):
            return cls()
        mean = sum(counts) / len(counts)
        model = cls(logistic([shape_features(x) for x in shapes], labels, [n / mean for n in counts]), sure=0.0)
        model.least = min(model.score(x) for x, y in zip(shapes, labels, strict=True) if y)
        return model

    def score(self, shape: tuple) -> float:
        s = self._scores.get(shape)
        if s is None:
            s = self._scores[shape] = sum(self.weights.get(x, 0.0) for x in shape_features(shape))
        return s

    def heads(self, lines: list[str]) -> list[tuple[int, str, bool, bool]]:
        """Lines that may be the running head: ``(index, key, beside a number, surely one by its place)``."""
        out = []
        for i, shape in line_shapes(lines):
            s = self.score(shape)
            if s >= self.least and (k := head_key(lines[i])):
                out.append((i, k, _beside_number(lines[i]), s > self.sure))
        return out


def _like(key: str, title: str) -> bool:
    """``like_title`` of two texts."""
    most = max(1, int(len(title) * 0.2))
    if not key or not title or abs(len(key) - len(title)) > most:
        return False
    row = list(range(len(title) + 1))
    for i, x in enumerate(key, 1):
        last, row = row, [i]
        for j, y in enumerate(title, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return False
    return row[-1] <= most


def train_heads(pages: DataFrame, books: DataFrame) -> Heads:
    """Line model learnt from all scanned pages of books with a title: the shapes of their lines, like the title or not, counted."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for text, title in zip(b["text"], b["title"], strict=True):
                lines = text.split("\n")
                least = len(title) - max(1, int(len(title) * 0.2))
                held.update([(shape, len(lines[i]) >= least and _like(head_key(lines[i]), title)) for i, shape in line_shapes(lines)])
            if len(held) > 100_000:
                yield pd.DataFrame([(repr(x), y, n) for (x, y), n in held.items()], columns=["shape", "head", "n"])
                held.clear()
        yield pd.DataFrame([(repr(x), y, n) for (x, y), n in held.items()], columns=["shape", "head", "n"])

    rows = _scanned(pages).select("book_id", F.when(F.trim(F.coalesce("raw_text", F.lit(""))) != "", F.col("raw_text")).otherwise(F.col("raw_text_pre")).alias("text"))
    rows = rows.where("length(text) > 40").join(small_or_shuffled(_titled(books)), "book_id").select("text", "title").mapInPandas(each, "shape string, head boolean, n long")
    rows = rows.groupBy("shape", "head").agg(F.sum("n").alias("n")).toPandas().sort_values(["shape", "head"])
    return Heads.fit_counts([ast.literal_eval(x) for x in rows["shape"]], [int(x) for x in rows["head"]], rows["n"].tolist())


def like_title(key: Column, title: Column) -> Column:
    """Whether a head's key is the title's, perhaps with a fifth of the letters misread."""
    most = F.greatest(F.lit(1), F.floor(F.length(title) * 0.2)).cast("int")
    return (F.abs(F.length(key) - F.length(title)) <= most) & (F.levenshtein(key, title) <= most)


def _scanned(pages: DataFrame) -> DataFrame:
    return pages.where("pdf_type IS NULL OR pdf_type <> 'digital'").where("book_id IS NOT NULL AND page_no IS NOT NULL").select("book_id", "page_no", "raw_text", "raw_text_pre")


_FLAGS = "book_id string, page_no int, hyphen boolean, misread boolean, pageno boolean, heads array<struct<line:int,key:string,numbered:boolean,sure:boolean>>"


def page_flags(pages: DataFrame, editor: Editor, heads: Heads) -> DataFrame:
    """What each scanned page shows by itself, and the lines that may be its running head."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            texts = [page_text(raw, pre) for raw, pre in zip(b["raw_text"], b["raw_text_pre"], strict=True)]
            for book, no, raw, t, places in zip(b["book_id"], b["page_no"], b["raw_text"], texts, editor.gate.places(texts), strict=True):
                if not t.strip():
                    continue
                lines = t.split("\n")
                found = {k for k, *_ in errors_at(t, editor, places)} if places else set()
                if found and is_garbled(raw):
                    found = set()
                rows.append((book, no, "hyphen" in found, "misread" in found, bool(page_numbers(lines)), [{"line": i, "key": k, "numbered": n, "sure": s} for i, k, n, s in heads.heads(lines)]))
            yield pd.DataFrame(rows, columns=["book_id", "page_no", "hyphen", "misread", "pageno", "heads"])

    return _scanned(pages).mapInPandas(each, _FLAGS)


def _titled(books: DataFrame) -> DataFrame:
    """``(book_id, title)``, title as a key, of books that have one."""
    clean = F.lower(F.trim(F.regexp_replace(F.regexp_replace("title", r"[^\p{L}\s]", ""), r"(?U)\s+", " ")))
    return book_facts(books).select("book_id", F.when(clean != "", clean).alias("title")).where("title IS NOT NULL")


def titles(flags: DataFrame, books: DataFrame) -> DataFrame:
    """Title key of each book. Where the book table has none it is learnt: of the lines that are surely a head by their place,
    that on most of the book's pages, provided that no other book has it; a head beside a number weighs double."""
    facts = _titled(books)
    bare = flags.join(facts, "book_id", "left_anti").select("book_id", "page_no", F.explode("heads").alias("h"))
    bare = bare.where("h.sure OR h.numbered").where(F.size(F.split("h.key", " ")).between(1, 8))
    per = bare.groupBy("book_id", F.col("h.key").alias("title")).agg(F.count_distinct("page_no").alias("n"), F.max(F.col("h.numbered").cast("int")).alias("numbered"))
    own = per.groupBy("title").agg(F.count("*").alias("books"), F.first("book_id").alias("book_id"), F.first("n").alias("n"), F.first("numbered").alias("numbered")).where("books = 1")
    learnt = own.groupBy("book_id").agg(F.max_by("title", F.struct(F.col("n") * (1 + F.col("numbered")), "title")).alias("title"))
    return facts.unionByName(learnt)


def page_noise(pages: DataFrame, books: DataFrame) -> DataFrame:
    """``(book_id, page_no, kind)``, one row for each kind of noise on a scanned page, distinct.

    Kinds are hyphen, misread, header and pageno. Defined results: pages of type digital and blank pages have none, a null
    type counts as scanned; pages garbled by a wrong decoding have no hyphen or misread; in books without a title the head is
    learnt from the lines that are surely heads by their place; an empty table gives no rows.
    """
    flags = cut(page_flags(pages, train_editor(pages, lost=False), train_heads(pages, books)))
    t = small_or_shuffled(titles(flags, books))
    plain = flags.select("book_id", "page_no", F.explode(F.array(*(F.when(F.col(k), F.lit(k)) for k in ("hyphen", "misread", "pageno")))).alias("kind")).where("kind IS NOT NULL")
    head = (
        flags.select("book_id", "page_no", F.transform("heads", lambda h: h["key"]).alias("keys")).join(t, "book_id")
        .where(F.exists("keys", lambda k: like_title(k, F.col("title")))).select("book_id", "page_no", F.lit("header").alias("kind"))
    )
    return plain.unionByName(head).distinct()


# ------------------------------------------------------------------------------------------------- repair


def repair(text: str, editor: Editor, head_lines: set[int], garbled: bool = False) -> str:
    """``text`` as continuous paragraphs: furniture removed, misread characters replaced, broken words and lines joined.

    Paragraphs end at blank lines and where a line ends a sentence well before the page's usual width."""
    lines = text.split("\n")
    gone = head_lines | set(page_numbers(lines))
    t = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    if not garbled:
        edits = errors(t, editor)
        touched = {k for _, i, j, _ in edits for k in range(i - 1, j + 1)}
        edits += [("lost", i, i, c) for i, c in lost_letters(t, editor) if i not in touched]
        for kind, i, j, e in sorted(edits, key=lambda x: -x[1]):
            if kind == "lost":
                t = t[:i] + e + t[i:]
            elif kind == "hyphen":
                rest = re.match(r"[ \t]*\n[ \t]*", t[j:])
                t = t[:i] + (t[j + rest.end() :] if rest else t[j:])
            elif e[0] == "R":
                t = t[:i] + e[1] + t[j:]
            elif e == "D":
                t = t[:i] + t[j:]
    width = max((len(x) for x in t.split("\n")), default=0)
    out: list[list[str]] = [[]]
    for x in t.split("\n"):
        s = x.strip()
        if not s:
            out.append([])
            continue
        out[-1].append(s)
        if len(s) < 0.7 * width and s[-1] in ".!?؟…»”":
            out.append([])
    return "\n\n".join(" ".join(p) for p in out if p)


def repaired_pages(pages: DataFrame, books: DataFrame) -> DataFrame:
    """Each scanned page as continuous paragraphs: ``(book_id, page_no, text, n_edits)``; blank pages come out as ""."""
    editor = train_editor(pages)
    flags = cut(page_flags(pages, editor, train_heads(pages, books)))
    t = small_or_shuffled(titles(flags, books))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for book, no, raw, pre, hs in zip(*(b[c] for c in ("book_id", "page_no", "raw_text", "raw_text_pre", "gone")), strict=True):
                x, bad = page_text(raw, pre), is_garbled(raw)
                rows.append((book, no, repair(x, editor, set(hs) if hs is not None else set(), bad), 0 if bad else len(errors(x, editor))))
            yield pd.DataFrame(rows, columns=["book_id", "page_no", "text", "n_edits"])

    head = flags.join(t, "book_id").select("book_id", "page_no", F.transform(F.filter("heads", lambda h: like_title(h["key"], F.col("title"))), lambda h: h["line"]).alias("gone"))
    head = head.where(F.size("gone") > 0).dropDuplicates(["book_id", "page_no"])
    once = _scanned(pages).dropDuplicates(["book_id", "page_no"])
    return once.join(head, ["book_id", "page_no"], "left").mapInPandas(each, "book_id string, page_no int, text string, n_edits int")
