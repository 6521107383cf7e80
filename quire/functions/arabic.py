"""Repair and normalisation of Arabic text, as Column functions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

# Dot sign, bases it is written beside and the letter that both make; in the order of replacing.
DOTTED = (
    ("\ufbb2", "\u06a1", "ف"), ("\ufbb4", "\u06a1", "ق"),
    ("\ufbb3", "\u066e", "ب"), ("\ufbb5", "\u066e", "ي"), ("\ufbb2", "\u066e", "ن"), ("\ufbb4", "\u066e", "ت"), ("\ufbb6", "\u066e", "ث"),
    ("\ufbb3", "ح", "ج"), ("\ufbb2", "ح", "خ"), ("\ufbb2", "ع", "غ"), ("\ufbb2", "ط", "ظ"),
)
PAIRS = tuple((pair, letter) for dot, base, letter in DOTTED for pair in (dot + base, base + dot))


def fix_decomposed(c: Column) -> Column:
    """Letters that a font split into base and dot sign put together; lone bases as the commonest letter, lone dots dropped.

    The 22 pairs are tried only where a text has any of their signs."""
    fixed = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), PAIRS, c)
    fixed = F.translate(fixed, "\u06a1\u066e\ufbb2\ufbb3\ufbb4\ufbb5\ufbb6", "فب")
    return F.when(T.is_decomposed(c), fixed).otherwise(c)


#: The article's rules as replacements. Particles before a word are looked through: no rule changes a word that begins with
#: one, so what is changed is the rest behind all of them, if it has three letters or more.
_P = "^([وبلكفس]*)"
ARTICLE_RULES = (
    (_P + "([أآ])ل(.)$", r"\1ل\2\3"),  # hamza before lam, three letters; with إ it is a preposition
    (_P + "([أإآ])ل(..+)$", r"\1ال\2\3"),  # longer: the alef of the article is put in
    (_P + "ا([^ل])ل", r"\1ال\2"),  # a letter between alef and lam
    ("^([أإآ])ل$", r"ل\1"),
    ("^ال$", "لا"),
)


def fix_article(w: Column) -> Column:
    """A word with the letters of its article in order."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1].replace("\\", "$")), ARTICLE_RULES, w)


def double_alef(w: Column) -> Column:
    return F.replace(w, F.lit("اال"), F.lit("الا"))


def unify_variants(c: Column) -> Column:
    return F.translate(c, "ھی", "هي")


def ocr_comma(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?<=[{T.ARABIC}])»(?={T.WS})", "،")


def join_split_bases(c: Column) -> Column:
    """Spaces inside words before a dotless base removed."""
    return F.regexp_replace(c, r"([\u0600-ۿ\ufbb2-\ufbb6]) +([\u066e\u06a1])", "$1$2")


def clean_noise(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(?md)^{T.WS}*\p{{Nd}}+{T.WS}*$", "")
    c = F.translate(c, "\u200b\u200c\u200d\ufeff", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]{3,}", "  "), r"\n{4,}", "\n\n\n")
    c = F.regexp_replace(c, rf"{T.WS}+\.(?={T.WS}|$)", ".")
    return F.regexp_replace(c, rf"([\u064b\u064c\u064d]){T.WS}+([اى])", "$1$2")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed canonical form; Catalyst has no built-in for it."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def _blank_to_empty(c: Column, x: Column) -> Column:
    return F.when(T.strip(c) == "", "").otherwise(x)


def normalise_digital(c: Column) -> Column:
    x = unify_variants(nfc(fix_decomposed(join_split_bases(c))))
    x = F.array_join(F.transform(F.split(x, " "), lambda w: double_alef(fix_article(w))), " ")
    return _blank_to_empty(c, T.strip(clean_noise(x)))


def normalise_scanned(c: Column) -> Column:
    x = ocr_comma(F.array_join(T.paragraphs(T.splitlines(c)), "\n\n"))
    return _blank_to_empty(c, T.strip(clean_noise(unify_variants(nfc(fix_decomposed(x))))))


@F.pandas_udf(StringType())
def visual_lam_alef(s: pd.Series) -> pd.Series:
    """Text stored in visual order put into reading order: runs of Arabic reversed, lam-alef ligatures taken apart."""
    import re

    run = re.compile(r"[\u0600-ۿﭐ-﷿ﹰ-ﻼ]+(?:[ \u00a0]+[\u0600-ۿﭐ-﷿ﹰ-ﻼ]+)*")
    return s.map(lambda t: t if t is None else run.sub(lambda m: unicodedata.normalize("NFKD", m.group()[::-1]), t))
