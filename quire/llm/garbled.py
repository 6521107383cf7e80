"""Text decoded with the wrong character encoding (problem 4).

*Finding.* A language model of character bigrams is counted over all pages. A wrong decoding leaves neighbours that no
language has: a token with two characters that follow each other far less often than by chance, or with a character of no
known language, is a candidate. An exact check of the candidates follows: it knows the sequences that UTF-8 leaves under a
one-byte code page, replacement characters, C1 controls, letters with no Latin word around them and signs inside words, and
for a page with enough other letters, whether some swap of code pages turns them into likely text. Single foreign letters
of genuine names and words in another alphabet are none of these.

*Restoring* has two ways, chosen per token:

* UTF-8 read under a one-byte code page is undone exactly, by encoding and decoding again (repeatedly, for text
  garbled more than once);
* one code page read as another is a substitution cipher. Affected pages of a source are put to the likeliest of all swaps
  of code pages (every written with every read one) under the language model, or to none; per source and swap,
  expectation-maximisation then learns p(seen character | letter) from the bigrams of the garbled runs - from that swap, or
  from letter frequencies where no swap is likely - and the most probable mapping is applied with ``str.translate``.

The model's inputs are count tables bounded by the squared alphabet, never rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

# ---------------------------------------------------------------------------------------------- code pages


def _decode(raw: bytes, cp: str) -> str:
    """``raw`` under ``cp``; bytes that it leaves undefined become C1 controls, as sloppy decoders do."""
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(cp))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def _table(cp: str) -> dict[str, int]:
    return {_decode(bytes([b]), cp): b for b in range(255, -1, -1)}


#: Code pages that UTF-8 bytes are wrongly read under.
WIDE = ("cp1252", "latin-1", "cp1256", "mac_roman", "cp437", "cp850")
_ENCODE = {cp: _table(cp) for cp in WIDE}
_ENCODE["cp1252"] |= {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in _ENCODE["cp1252"]}

#: Code pages that the languages are written in, and those that text is wrongly read under.
WRITTEN = ("cp1256", "iso8859_6", "cp720", "mac_arabic", "cp1252", "cp850", "cp437", "mac_roman")
READ = ("cp1252", "cp850", "cp437", "mac_roman", "cp1256", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859_2", "iso8859_5", "iso8859_7", "koi8_r", "cp866", "cp720", "iso8859_6")
#: Every swap of two of them: (written in, read as).
SWAPS = tuple((w, r) for r in READ for w in WRITTEN if w != r)


def _swap(written: str, read: str) -> dict[str, str]:
    """What each character seen stands for."""
    out = {}
    for b in range(0x80, 0x100):
        seen, meant = _decode(bytes([b]), read), _decode(bytes([b]), written)
        if meant.isprintable() and seen != meant:
            out[seen] = meant
    return out


SWAP_MAPS = [_swap(*x) for x in SWAPS]
_CAN_READ = [frozenset(_decode(bytes(range(0x80, 0x100)), r)) for _, r in SWAPS]

# ------------------------------------------------------------------------------------------------ detection


def _class(chars) -> str:
    return "[" + "".join(f"\\u{ord(c):04x}" for c in sorted(set(chars))) + "]"


def _signs(cp: str, less: str = "") -> str:
    """Characters that bytes 80..BF become under ``cp`` and that aren't letters, spaces, format signs or ``less``."""
    return "".join(c for c in _decode(bytes(range(0x80, 0xC0)), cp) if not c.isalpha() and not c.isspace() and c.isprintable() and c not in less)


_W1252 = _signs("cp1252", "\u2019\u00ab\u00bb\u2013\u2010") + "\u0160\u0152\u017d\u0161\u0153\u017e\u0178\u0192\u02c6\u00aa\u00b5\u00ba" + "".join(map(chr, range(0x80, 0xA1))) + "\u00ad"
_W1256 = _signs("cp1256", "\u00ab\u00bb\u00ac\u2019\u2018\u201c\u201d\u2013\u2014\u2026\u00b0-\u060c\u061b\u061f\u00a3")
#: Sequences that a wrong decoding leaves.
PARTS = (
    "�",
    "[\\u0080-\\u009f]",
    "ï»¿",
    "[ÂÃØÙÚÛÐÑÎÏ]" + _class(_W1252),  # UTF-8 as cp1252 or latin-1
    "[ÂÃ][«»’–]|Å" + _class(set(_W1252) - set("–")) + "|â(?:€|‚¬)",
    "[طظعغأآإذر]" + _class(_W1256) + "|آ(?:[°±§©÷]|£\\d)",  # UTF-8 as cp1256
    "[طظأآ](?:[’‘“”–—…°¬«»][A-Za-zء-ي]|[پٹچژڈڑں])|[أآ][«»]|[A-Za-z]أ[ھ\\u00a0]|أھ[A-Za-z]|أ\\u00a0",
    "[أآإ][^\\x00-\\x7f\\u200b-\\u200f\\u2060\\ufeff]?[A-Za-z]",  # a Latin letter with the lead of one under cp1256
    "خ[°-³µ¶¸¹¼-¾]|د[Œ‚ƒ„†‡]|Œ[ª≥øåÇ]",  # Greek under cp1256 and MacRoman
    "[A-Za-zÀ-ÿ]\\?[a-zà-ÿ]",  # a sign that the wrong code page had no place for
    "[–—][∫∏≥≤∞Ω]|√|[ÿŸ]" + _class(_decode(bytes(range(0x80, 0xC0)), "mac_roman")) + "|‚Ä|≈[A-ZÅôæú]|¬[´ª©∞£±ß®]",  # UTF-8 as MacRoman
    "[╪┘┌┤┬├╬┼]|Γ[ÇöÜ]",  # UTF-8 as a DOS page
    "(?<![A-Za-zÀ-ÿ])[À-ÿ][À-ÿ¡¿]+(?![A-Za-z])",  # Arabic letters as Latin ones
    "[A-Za-zÀ-ÿ][‚ƒ„†‡ˆ‰Š‹Ž•˜™š›žŸ—…][a-z]|(?<![\\wÀ-ÿ‚])[‚ƒˆŠ][a-z]|[a-z][‚ƒˆŠ—](?![\\wÀ-ÿ\\n])",  # DOS letters as cp1252
)
GARBLED = re.compile("|".join(f"(?:{p})" for p in PARTS))


#: The one sequence of ASCII characters alone: a sign that the wrong code page had no place for.
_LOST_SIGN = re.compile("[A-Za-z]\\?[a-z]")


def is_garbled(text: str | None) -> bool:
    """Whether ``text`` has any sequence that a wrong decoding leaves; None and "" have none."""
    return bool(text) and not text.isascii() and GARBLED.search(text) is not None or bool(text) and _LOST_SIGN.search(text) is not None


_TOKEN = re.compile(r"[^ \t\n]+")


#: What a token can decode to: Latin, Greek, Cyrillic and Arabic letters, marks, signs and what garbles them again.
_PLAUSIBLE = re.compile("[\\x20-\\x7e\\u0080-\\u017f\\u0192\\u02c6\\u02dc\\u0384-\\u03ff\\u0400-\\u045f\\u060c-\\u06ff\\u2010-\\u22ff\\u2310-\\u25ff\\ufb00-\\ufdff\\ufe70-\\uffee]+")


def _undo_wide(token: str) -> str | None:
    """``token`` with UTF-8 read under a one-byte code page undone, or None."""
    best = None
    for cp in WIDE:
        enc, now = _ENCODE[cp], token
        try:
            now = bytes(enc[c] for c in now).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if len(now) < len(token) and _PLAUSIBLE.fullmatch(now) and (best is None or len(now) < len(best)):
            best = now
    return best


#: Lost second bytes that only one common letter or sign has: fa after D9 and the closing quotation mark after E2 80.
_LOST = (("Ù�", "Ù\x81"), ("â€�", "â€\x9d"))


def refilled(token: str) -> str:
    """``token`` with the replacement characters that can be told replaced by the bytes lost."""
    for a, b in _LOST:
        token = token.replace(a, b)
    return token


def _undo(token: str) -> str | None:
    """As often as it was garbled, four times at most."""
    out = None
    for _ in range(4):
        nxt = _undo_wide(out if out is not None else token)
        if nxt is None:
            break
        out = nxt
    return out


# ------------------------------------------------------------------------------------------ language model

_ARABIC, _FRENCH = "ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىي", "abcdefghijklmnopqrstuvwxyz" + "àâäçéèêëîïôöùûüœ"
_LETTERS = " " + _ARABIC + _FRENCH + "،.!?؟"
#: Signs that texts have beside letters; those of one entry count as one.
_OTHER_SIGNS = (
    "0123456789٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "-‐‑", "«", "»", "’'", "“”\"", "([", ")]", "/", "—–=_", "".join(map(chr, [*range(0x64B, 0x656), 0x670])), "ـ", ",;؛", ":", "*|•", "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff",
)
N = len(_LETTERS) + len(_OTHER_SIGNS) + 1
_INDEX = np.zeros(0x10000, np.uint8)
for _i, _g in enumerate((*_LETTERS, *_OTHER_SIGNS)):
    for _c in _g:
        _INDEX[ord(_c)] = _i + 1
        if len(_c.upper()) == 1:
            _INDEX[ord(_c.upper())] = _i + 1
_INDEX[[9, 10, 13]] = 1
_WORDS = len(_ARABIC) + len(_FRENCH) + 1  # codes up to this are the space and letters
#: Two characters that follow each other this much less often than by chance (log) make a token a candidate.
UNLIKELY = -3.0
#: Letters of no known language that a page needs before swaps of code pages are tried on it, and how far below clean text
#: the mean log likelihood of a bigram may then be.
LEAST_LETTERS, FAR = 24, 0.7


def _codes(text: str) -> np.ndarray:
    return _INDEX[np.frombuffer(text.encode("utf-16-le", "replace"), np.uint16)]


def bigram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bigrams of the texts of a partition, as one row of counts."""
    total = np.zeros(N * N, np.int64)
    for b in batches:
        if len(b):
            x = _codes("\n".join(b["raw_text"])).astype(np.int32)
            total += np.bincount(x[:-1] * N + x[1:], minlength=N * N)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"pair": at, "n": total[at]})


class Model:
    """Bigram model of the languages: ``joint[a, b]``, the probability of b after a."""

    def __init__(self, counts: np.ndarray) -> None:
        joint = counts + 0.05
        joint[0, :] = joint[:, 0] = 0.05  # signs and letters of no language
        self.joint = joint / joint.sum()
        first, second = self.joint.sum(1, keepdims=True), self.joint.sum(0, keepdims=True)
        self.log = np.log(self.joint / first)
        # a table that counts nothing knows no unlikely neighbours
        self.unlikely = np.log(self.joint / (first * second)) < UNLIKELY
        self.unlikely[0, :] = self.unlikely[:, 0] = True
        letters = self.joint[1 : _WORDS + 1, 1 : _WORDS + 1]
        self.usual = float((letters * self.log[1 : _WORDS + 1, 1 : _WORDS + 1]).sum() / letters.sum())

    def candidates(self, text: str) -> list[str]:
        """Tokens of ``text`` with an unlikely pair of characters."""
        if len(text) < 2:
            text += " "
        x = _codes(text)
        at = np.flatnonzero(self.unlikely[x[:-1], x[1:]])
        if not len(at):
            return []
        blank = np.flatnonzero(x == 1)
        # the token of a pair is that of its first character, or of its second where that is a blank
        i = np.unique(np.searchsorted(blank, np.where(x[at] == 1, at + 1, at)))
        a = np.where(i > 0, blank[np.maximum(i - 1, 0)] + 1, 0) if len(blank) else np.zeros(len(i), np.int64)
        z = np.append(blank, len(x))[i]
        if len(x) != len(text):  # characters beyond the basic plane count twice
            raw = text.encode("utf-16-le", "replace")
            return [raw[2 * p : 2 * q].decode("utf-16-le", "replace") for p, q in zip(a, z, strict=True)]
        return [text[p:q] for p, q in zip(a.tolist(), z.tolist(), strict=True)]

    def mean(self, text: str) -> float:
        """Mean log likelihood of the bigrams of ``text``."""
        x = _codes(text)
        return float(self.log[x[:-1], x[1:]].mean()) if len(x) > 1 else float("-inf")


def language_model(pages: DataFrame) -> Model:
    """Counted over all pages; what is collected is bounded by the squared alphabet."""
    rows = pages.select("raw_text").where("raw_text IS NOT NULL").mapInPandas(bigram_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(N * N)
    counts[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return Model(counts.reshape(N, N))


# ------------------------------------------------------------------------------------------------------ EM


def _em(counts: np.ndarray, joint: np.ndarray, e: np.ndarray, alpha: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """p(seen | letter) after ``rounds`` of EM from ``e``, and the log likelihood of the counts."""
    for _ in range(rounds):
        right, left = joint @ e, e.T @ joint  # letter then character; character then letter
        w = counts / np.maximum(e.T @ right, 1e-300)
        e = e * (right @ w.T) + e * (left.T @ w) + alpha
        e /= e.sum(1, keepdims=True)
    return e, float((counts * np.log(np.maximum(e.T @ joint @ e, 1e-300))).sum())


def _by_swapping(code: np.ndarray, free: np.ndarray, counts: np.ndarray, log: np.ndarray) -> np.ndarray:
    """``code`` improved by exchanging the letters of two seen characters, or giving one an unused letter, while that makes
    the counts likelier."""
    score = lambda c: float((counts * log[np.ix_(c, c)]).sum())
    best, better = score(code), True
    while better:
        better = False
        spare = np.setdiff1d(np.arange(2, _WORDS + 1), code[free])
        for n, i in enumerate(free):
            for j in (*free[n + 1 :], *(-spare)):
                c = code.copy()
                c[i] = code[j] if j >= 0 else -j
                if j >= 0:
                    c[j] = code[i]
                if (new := score(c)) > best + 1e-9:
                    code, best, better = c, new, True
    return code


def fit_cipher(seen: list[str], counts: np.ndarray, model: Model, start: dict[str, str] | None, rounds: int = 25, prior: float = 4.0, tries: int = 6) -> dict[str, str]:
    """Mapping of seen characters to letters by EM.

    ``counts[i, j]``: how often ``seen[i]`` is followed by ``seen[j]``. Model: the letters follow ``model``, each letter
    shows as a character by p(seen | letter). ``start`` gives the pseudo-counts of a known swap, ASCII stands for itself.
    Without ``start``, EM begins from letter frequencies, ``tries`` times with different noise, for the Arabic and the Latin
    letters; the likeliest result is improved by exchanges of letters.
    Characters for which no letter gains a clear posterior stay with ``start``.
    """
    joint, x = model.joint, len(seen)
    alpha = np.full((N, x), 0.01)
    fixed = np.array([c.isascii() or (_INDEX[ord(c)] > _WORDS if ord(c) < 0x10000 else True) for c in seen])
    for j, c in enumerate(seen):
        meant = c if start is None else start.get(c, c)
        i = int(_INDEX[ord(meant)]) if len(meant) == 1 and ord(meant) < 0x10000 else 0
        if fixed[j] or start is not None:
            alpha[i, j] += 200.0 if fixed[j] else prior
    often = counts.sum(1)
    free = np.flatnonzero(~fixed)
    if start is None:
        best, rng = None, np.random.default_rng(1)
        by_often = free[np.argsort(-often[free], kind="stable")]
        share = joint.sum(1)
        for letters in (np.arange(2, len(_ARABIC) + 2), np.arange(len(_ARABIC) + 2, _WORDS + 1)):
            ranked = letters[np.argsort(-share[letters], kind="stable")]
            for _ in range(tries if len(free) else 0):
                e = alpha.copy()
                gap = np.abs(np.arange(len(ranked))[:, None] - np.arange(len(by_often))[None, :])
                e[np.ix_(ranked, by_often)] += 20 * np.exp(-gap / 4) * rng.uniform(0.2, 1.8, gap.shape)
                got = _em(counts, joint, e / e.sum(1, keepdims=True), alpha, 3 * rounds)
                if best is None or got[1] > best[1]:
                    best = got
        if best is None:
            return {}
        post = best[0] * share[:, None]
        code = np.array([int(_INDEX[ord(c)]) if f else 0 for c, f in zip(seen, fixed, strict=True)])
        code[free] = post[2 : _WORDS + 1, free].argmax(0) + 2
        code = _by_swapping(code, free, counts, model.log)
        return {seen[j]: _LETTERS[code[j] - 1] for j in free}
    e, _ = _em(counts, joint, alpha / alpha.sum(1, keepdims=True), alpha, rounds)
    post = e * joint.sum(1, keepdims=True)
    post /= np.maximum(post.sum(0, keepdims=True), 1e-300)
    out = dict(start)
    for j, c in enumerate(seen):
        i, known = int(post[:, j].argmax()), start.get(c)
        # marks that the model has no letter for stay; a known swap gives way to what the counts outweigh its prior for
        if known is not None and (len(known) != 1 or _INDEX[ord(known)] == 0 or often[j] < prior):
            continue
        if c.isalpha() and not c.isascii() and 0 < i <= _WORDS and post[i, j] > (0.5 if known is None else 0.98):
            out[c] = _LETTERS[i - 1]
    return out


def _translate(swap: dict[str, str]) -> dict[int, str]:
    return {ord(a): b for a, b in swap.items()}


_TRANSLATE = [_translate(m) for m in SWAP_MAPS]


def nearest_swap(tokens: list[str], model: Model) -> tuple[int, float]:
    """The swap under which ``tokens`` are likeliest and their mean log likelihood then; -1 without tokens."""
    if not tokens:
        return -1, float("-inf")
    text = " " + " ".join(tokens) + " "
    odd = {c for c in text if not c.isascii()}
    best = (-1, float("-inf"))
    for i, t in enumerate(_TRANSLATE):
        if len(odd - _CAN_READ[i]) * 5 <= len(odd):
            score = model.mean(text.translate(t))
            if score > best[1]:
                best = (i, score)
    return best


def swapped(tokens: list[str], model: Model) -> list[str]:
    """The tokens of letters of no known language, if there are enough of them and a swap makes likely text of them."""
    odd = [t for t in tokens if sum(c.isalpha() and (ord(c) > 0xFFFF or _INDEX[ord(c)] == 0) for c in t) * 2 > len(t)]
    if sum(map(len, odd)) < LEAST_LETTERS:
        return []
    return odd if nearest_swap(odd, model)[1] > model.usual - FAR else []


def garbled_tokens(text: str, model: Model) -> list[str]:
    """The garbled tokens of ``text``: if the exact check confirms a candidate of the model, all tokens that it confirms."""
    tokens = model.candidates(text)
    if not tokens:
        return []
    if any(map(is_garbled, tokens)):
        return [t for t in _TOKEN.findall(text) if is_garbled(t)]
    return swapped(tokens, model)


# ------------------------------------------------------------------------------------------------ operators

KEYS = "book_id string, page_no int, source_path string"


def affected_pages(pages: DataFrame, model: Model | None = None, texts: bool = True) -> DataFrame:
    """Pages with a garbled sequence in ``raw_text``: ``(book_id, page_no, source_path, raw_text, n_garbled)``, without the
    text unless ``texts``.

    Null and empty texts are never affected. Repeated rows come out repeated.
    """
    model = model or language_model(pages)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = np.array([len(garbled_tokens(t, model)) for t in b["raw_text"]], np.int64)
            yield (b if texts else b.drop(columns="raw_text"))[n > 0].assign(n_garbled=n[n > 0])

    cols = pages.select("book_id", "page_no", "source_path", "raw_text").where("raw_text <> ''")
    return cols.mapInPandas(find, f"{KEYS}, {'raw_text string, ' if texts else ''}n_garbled long")


def garbled_pages(pages: DataFrame) -> DataFrame:
    """One row per affected page: ``(book_id, page_no, source_path, n_garbled, n_restored, restored)``.

    ``restored`` is the text with every garbled token replaced that could be recovered; ``n_restored`` counts those.
    Pages repeated under one key count once (the first by text). Defined results: an empty table gives no rows; pages
    without a source learn together, as one source; tokens with replacement characters stay as they are, unless what was lost
    can only be one letter or sign.
    """
    model = language_model(pages)
    hit = cut(affected_pages(pages, model).dropDuplicates(["book_id", "page_no"]))  # read twice below

    def ciphers(text: str) -> tuple[set[str], int]:
        """The garbled tokens of a page, and the swap of those that no re-encoding undoes; -1: none likely."""
        tokens = garbled_tokens(text, model)
        narrow = [t for t in tokens if "�" not in t and _undo(t) is None]
        swap, score = nearest_swap(narrow, model)
        enough = sum(map(len, narrow)) >= LEAST_LETTERS
        return set(tokens), -2 if not narrow else -1 if enough and score < model.usual - 2 * FAR else swap

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for src, t in zip(b["source_path"], b["raw_text"], strict=True):
                tokens, swap = ciphers(t)
                if swap >= -1:
                    s = " " + " ".join(w for w in _TOKEN.findall(t) if w in tokens and "�" not in w and _undo(w) is None) + " "
                    rows += [(src or "", swap, a, c) for a, c in zip(s, s[1:], strict=False)]
            yield pd.DataFrame(rows, columns=["source", "swap", "a", "b"]).groupby(["source", "swap", "a", "b"]).size().reset_index(name="n")

    def fit(b: pd.DataFrame) -> pd.DataFrame:
        swap = int(b["swap"].iloc[0])
        seen = sorted(set(b["a"]) | set(b["b"]))
        at = {c: i for i, c in enumerate(seen)}
        counts = np.zeros((len(seen), len(seen)))
        np.add.at(counts, (b["a"].map(at).to_numpy(), b["b"].map(at).to_numpy()), b["n"].to_numpy(float))
        m = fit_cipher(seen, counts, model, SWAP_MAPS[swap] if swap >= 0 else None)
        m = {c: m[c] for c in seen if c in m}
        return pd.DataFrame({"source": b["source"].iloc[:1], "swap": swap, "seen": "\0".join(m), "meant": "\0".join(m.values())})

    maps = (
        hit.mapInPandas(count, "source string, swap int, a string, b string, n long")
        .groupBy("source", "swap", "a", "b").agg(F.sum("n").alias("n"))
        .groupBy("source", "swap").applyInPandas(fit, "source string, swap int, seen string, meant string")
    )
    maps = maps.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("swap", F.struct("seen", "meant")))).alias("maps"))

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, packed in zip(b["raw_text"], b["maps"], strict=True):
                tokens, swap = ciphers(t)
                v = dict(packed).get(swap) if packed is not None else None
                table = _translate(dict(zip(v["seen"].split("\0"), v["meant"].split("\0"), strict=True))) if v and v["seen"] else {}
                done = [0]

                def fix(m: re.Match, tokens=tokens, table=table, done=done) -> str:
                    w = m.group()
                    if w not in tokens:
                        return w
                    full = refilled(w)
                    new = w if "�" in full else _undo(full) or full.translate(table)
                    done[0] += new != w
                    return new

                out.append((_TOKEN.sub(fix, t), done[0]))
            yield pd.DataFrame({"book_id": b["book_id"], "page_no": b["page_no"], "source_path": b["source_path"], "n_garbled": b["n_garbled"], "n_restored": [n for _, n in out], "restored": [t for t, _ in out]})

    joined = hit.join(maps, F.coalesce(hit["source_path"], F.lit("")) == maps["source"], "left")
    return joined.select("book_id", "page_no", "source_path", "raw_text", "n_garbled", "maps").mapInPandas(
        restore, f"{KEYS}, n_garbled long, n_restored long, restored string"
    )
