"""One consistent form for text that looks the same but is written with different characters (problem 6).

*Skeleton*: decompose (NFKD, which also undoes full-width, ligature and positional presentation forms), replace every
character by its prototype from a look-alike table, drop what isn't seen, decompose again. Words with equal skeletons
look alike and are grouped by it.

A word is *unsettled* if it isn't itself the composed skeleton: some character of it isn't its own prototype, isn't seen or
stands apart from what it composes with. Unsettled words are the candidates for variants; an exact check of the kinds of
variant follows on them alone, since words wholly in another alphabet and ordinary quotes and dashes aren't variants.

*Form*: the consistent text itself - composed, ordinary spaces, no unseen marks, look-alike letters in mixed words
replaced by those of the word's own script, Persian letter forms replaced by the Arabic ones. Unlike the skeleton it
keeps accents, case and words wholly in another alphabet.
"""

from __future__ import annotations

import re
import unicodedata as u
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .garbled import is_garbled

# Letters of Cyrillic and Greek that look like a Latin one.
LOOKALIKES = dict(
    zip(
        "авекмнорстухѕіјһԁԛԝүґАВЕКМНОРСТУХЅІЈԌԚԜҮ" + "αβγεικνορτυχωηϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ",
        "aвeкмнopcтyxsijhdqwyrABEKMHOPCTYXSIJGQWY" + "aβyeikvoptuxωηcjABEZHIKMNOPTYXCC",
        strict=True,
    )
)
# Other letters that look like a Latin one - phonetic and small capital ones, Armenian, Cherokee, Coptic.
FAR_LOOKALIKES = dict(
    zip(
        "ɑɡɩıʋɪʏꞵƽⅼℓ" + "օսոհցզյՍՕ" + "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ" + "ⲟⲢⲤⲞⲦⲬⲎ",
        "agiivɪyβslℓ" + "ounhgqjUO" + "ABCDEHJKLMPRSTVWZ" + "oPCOTXH",
        strict=True,
    )
)
# ASCII characters that look like others; they count for the skeleton only.
ASCII_LOOKALIKES = {"0": "O", "1": "l", "I": "l", "|": "l", "m": "rn"}
# Persian and Urdu letter forms and the Arabic letters they stand for.
ARABIC_FORMS = {"ک": "ك", "ڪ": "ك", "ی": "ي", "ې": "ي", "ے": "ي", "ھ": "ه", "ہ": "ه", "ە": "ه", "ۀ": "ه", "ۃ": "ة"}
# Signs that look alike.
SIGNS = {"‐": "-", "‑": "-", "–": "-", "—": "-", "−": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "ـ": ""}

UNSEEN = r"\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff"
SPACES = r"\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
FULL_WIDTH = r"\uff01-\uff5e\uffe0-\uffe6"
PRESENTATION = r"\ufb00-\ufb06\ufb13-\ufb17\ufb1d-\ufdff\ufe70-\ufefc"
_LATIN = r"A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff"
_OTHER = r"\u0370-\u0373\u0376-\u037d\u037f-\u03ff\u1f00-\u1fff\u0400-\u0481\u048a-\u052f"
_MARK = r"\u0300-\u036f"
_PERSIAN = "".join(ARABIC_FORMS)
_KINDS = (
    ("full_width", re.compile(f"[{FULL_WIDTH}]")),
    ("unseen", re.compile(f"[{UNSEEN}]")),
    ("space", re.compile(f"[{SPACES}]")),
    ("presentation", re.compile(f"[{PRESENTATION}]")),
    ("mixed", re.compile(f"[{_LATIN}][{_MARK}]*[{UNSEEN}]*[{_OTHER}]|[{_OTHER}][{_MARK}]*[{UNSEEN}]*[{_LATIN}]")),
    ("arabic_form", re.compile(f"[{_PERSIAN}]")),
)
_DROP = re.compile(f"[{UNSEEN}]")
_SPACE = re.compile(f"[{SPACES}]")
_WIDE = re.compile(f"[{FULL_WIDTH}{PRESENTATION}]+")
_MIXED_WORD = re.compile(f"[{_LATIN}{_OTHER}{_MARK}]+")
_IS_LATIN, _IS_OTHER = re.compile(f"[{_LATIN}]"), re.compile(f"[{_OTHER}]")
_TO_LATIN = {ord(a): b for a, b in LOOKALIKES.items()} | {ord("υ"): "u", ord("ν"): "v", ord("γ"): "y"}
_FROM_LATIN = {ord(b): a for a, b in reversed(LOOKALIKES.items()) if b.isascii()}
_TO_ARABIC = {ord(a): b for a, b in ARABIC_FORMS.items()}
_PROTOTYPE = {ord(a): b for a, b in (LOOKALIKES | FAR_LOOKALIKES | ARABIC_FORMS | SIGNS).items()}
_WHOLE = _PROTOTYPE | {ord(a): b for a, b in ASCII_LOOKALIKES.items()}
_PARTS = re.compile(r"[^ \t\n\r]+")
_EDGE = " \t\n\r.,;:!?\"'()[]{}«»،؛؟…-–—*|"


def skeleton(text: str | None, table: dict[int, str] = _WHOLE) -> str | None:
    """Prototype of how ``text`` looks; null for null."""
    if text is None:
        return None
    if text.isascii():
        return text.translate(table)
    s = _SPACE.sub(" ", _DROP.sub("", text))
    s = u.normalize("NFKD", s).translate(table)
    return u.normalize("NFKD", s)


def settled(word: str) -> bool:
    """Whether ``word`` is its own composed skeleton; ASCII characters are their own prototypes here."""
    return word.isascii() or u.normalize("NFC", skeleton(word, _PROTOTYPE)) == word


class _Settled(dict):
    """``settled`` of words seen, kept up to a bound."""

    def __missing__(self, word: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = settled(word)
        return out


_KNOWN = _Settled()


def unsettled(text: str) -> list[str]:
    """The words of ``text`` that aren't settled."""
    return [] if text.isascii() else [w for w in _PARTS.findall(text) if not _KNOWN[w]]


def kinds(text: str | None) -> list[str]:
    """Which kinds of variant characters ``text`` holds; none for null and empty texts."""
    words = unsettled(text) if text else []
    if not words:
        return []
    odd = " ".join(words)
    out = [k for k, p in _KINDS if p.search(odd)]
    if not u.is_normalized("NFC", odd):
        out.append("uncomposed")
    return out


def _one_script(m: re.Match) -> str:
    w = m.group()
    latin, other = len(_IS_LATIN.findall(w)), len(_IS_OTHER.findall(w))
    if not latin or not other:
        return w
    return w.translate(_TO_LATIN if latin >= other else _FROM_LATIN)


def form(text: str | None) -> str | None:
    """The consistent form of ``text``; null for null. Texts without variants are returned as they are."""
    if not text or not unsettled(text):
        return text
    s = _SPACE.sub(" ", _DROP.sub("", text))
    s = _WIDE.sub(lambda m: u.normalize("NFKC", m.group()), s)
    s = u.normalize("NFC", s).translate(_TO_ARABIC)
    return u.normalize("NFC", _MIXED_WORD.sub(_one_script, s))


def _records(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    rows = pages.select(F.lit("page").alias("record_type"), "book_id", F.col("page_no").alias("item_no"), F.col("raw_text").alias("text")).unionAll(
        chunks.select(F.lit("chunk").alias("record_type"), "book_id", F.col("chunk_id").alias("item_no"), "text")
    )
    return rows.where("text IS NOT NULL")


def variant_texts(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Texts with variant characters: ``(record_type, book_id, item_no, kinds, skeleton_hash, form)``.

    Pages garbled by a wrong decoding are left out: their odd characters are no look-alikes. Null and empty texts are
    never cases; repeated rows come out repeated.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep, out = [], []
            for i, (kind, t) in enumerate(zip(b["record_type"], b["text"], strict=True)):
                k = kinds(t)
                if k and not (kind == "page" and is_garbled(t)):
                    keep.append(i)
                    out.append((k, xxhash.xxh3_64_intdigest(skeleton(t)) - (1 << 63), form(t)))
            if keep:
                yield b.iloc[keep].drop(columns="text").assign(kinds=[x[0] for x in out], skeleton_hash=[x[1] for x in out], form=[x[2] for x in out])

    schema = "record_type string, book_id string, item_no int, kinds array<string>, skeleton_hash long, form string"
    return _records(pages, chunks).mapInPandas(find, schema)


def consistent_texts(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every text in its one form, with the hash of its skeleton: ``(record_type, book_id, item_no, form, skeleton_hash)``.

    Texts that look alike share ``skeleton_hash``. Null texts are left out; an empty text's form is empty.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = [xxhash.xxh3_64_intdigest(skeleton(t)) - (1 << 63) for t in b["text"]]
            yield b.assign(form=[form(t) for t in b["text"]], skeleton_hash=h).drop(columns="text")

    return _records(pages, chunks).mapInPandas(each, "record_type string, book_id string, item_no int, form string, skeleton_hash long")


def lookalike_groups(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Words that look alike but are written differently: ``(skeleton, form, n_words, n_spellings)`` of each skeleton of
    several spellings; ``form`` is that of the commonest spelling.

    Words are what white space parts, without the signs around them. A task counts a batch's spellings before anything is
    shuffled, and a group's words are never gathered: of each spelling one row with its number goes on.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = Counter(w.strip(_EDGE) for t in b["text"] for w in _PARTS.findall(t))
            n.pop("", None)
            if not n:
                continue
            yield pd.DataFrame({"skeleton": [skeleton(w) for w in n], "spelling": list(n), "n": list(n.values())}).astype({"n": "int64"})

    per = _records(pages, chunks).mapInPandas(each, "skeleton string, spelling string, n long").groupBy("skeleton", "spelling").agg(F.sum("n").alias("n"))
    several = per.groupBy("skeleton").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_spellings"), F.max_by("spelling", F.struct("n", "spelling")).alias("spelling")).where("n_spellings > 1")

    def formed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(form=[form(w) for w in b["spelling"]])[["skeleton", "form", "n_words", "n_spellings"]]

    return several.mapInPandas(formed, "skeleton string, form string, n_words long, n_spellings long")
