"""Paragraphs from the visual lines of born-digital pages, as folds inside Catalyst over one page's lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

MARKS_ONLY = r"^[؀-ًؕ-ٰٟاآأإ\s]+$"


def fix_comma(c: Column) -> Column:
    """A comma set apart goes behind the word that follows it, as right-to-left lines are read."""
    c = F.regexp_replace(c, r"([^\s]+)\s+،\s*([^\s]+)", "$1 $2،")
    return F.regexp_replace(c, r"^،\s*([^\s]+)", "$1،")


def clean_punctuation(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "،،+", "،"), r"\.{2,}", ".")


def is_heading(c: Column) -> Column:
    """4 to 55 characters without sentence punctuation, not beginning with a vowel mark, not of marks and alefs alone."""
    s = T.strip(c)
    return F.length(s).between(4, 55) & ~s.rlike("[.،؛؟!]") & ~s.rlike(r"^[ً-ٰٟ]") & ~s.rlike(MARKS_ONLY)


def split_sentences(lines: Column) -> Column:
    """Lines cut where a sentence ends inside them; what follows the last cut of a line is put before the next line."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(a: Column, raw: Column) -> Column:
        own = clean_punctuation(fix_comma(T.strip(raw)))
        line = F.when(a["held"] == "", own).when(own == "", a["held"]).otherwise(F.concat(a["held"], F.lit(" "), own))
        parts = F.split(line, r"(?<=[.؟!])\s+(?=[؀-ۿ])")
        last = T.strip(F.element_at(parts, -1))
        whole = F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: T.strip(p) != "")
        cut = (F.size(parts) > 1) & (last != "")
        return F.struct(F.concat(a["out"], whole, F.when(~cut & (last != ""), F.array(last)).otherwise(F.array().cast("array<string>"))).alias("out"), F.when(cut, last).otherwise("").alias("held"))

    return F.aggregate(lines, start, step, lambda a: F.when(a["held"] != "", F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]))


def paragraphs(lines: Column) -> Column:
    """Lines joined to paragraphs, a text with one a line: headings stand alone before a blank line, others end with a sentence."""

    def step(acc: Column, line: Column) -> Column:
        last = F.element_at(acc, -1)
        head = (is_heading(last) & (F.size(acc) > 1)) | (is_heading(line) & (T.strip(last) != ""))
        return (
            F.when(F.size(acc) == 0, F.array(line)).when(head, F.concat(acc, F.array(F.lit(""), line))).when(T.ends_sentence(last), F.concat(acc, F.array(line)))
            .otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", last, line))))
        )

    return F.array_join(F.aggregate(lines, F.array().cast("array<string>"), step), "\n")


def page_paragraphs(text: Column) -> Column:
    return paragraphs(split_sentences(F.split(text, "\n")))
