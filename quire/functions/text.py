"""Text functions: Column -> Column, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python understands it, as a character class for Java's regular expressions.
WS = r"[\s\u000b\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Line ends as ``str.splitlines`` understands them.
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
ARABIC = r"\u0600-ۿ"
DIGIT = "٠-٩۰-۹0-9"
#: The twelve marks of direction and zero width that are ignored before lines are classified.
BIDI = "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u061c\ufeff"
TOKEN = r"[\u0600-ۿݐ-ݿࢠ-\u08ffﭐ-﷿ﹰ-\ufeff\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+$", "")


def splitlines(c: Column) -> Column:
    """Lines; the empty text after a final line end is no line, nor is an empty text."""
    x = F.split(F.regexp_replace(c, f"(?:{LINE_END})$", ""), LINE_END)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(x)


def first_line(c: Column) -> Column:
    """The first line that isn't blank, without white space around it; null where there is none. One match, no list of lines."""
    return F.nullif(strip(F.regexp_extract(c, rf"\A{WS}*([^\n]*)", 1)), F.lit(""))


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    """Number of words divided by any white space."""
    return F.size(word_list(c))


def token_est(words: Column) -> Column:
    """int(words x 1.4), truncated as binary floating point gives it."""
    return F.floor(words.cast("double") * F.lit(1.4)).cast("int")


def strip_bidi(c: Column) -> Column:
    return F.translate(c, BIDI, "")


def tokens(c: Column) -> Column:
    """Words in the tokenizer's sense: runs of Arabic-block characters, letters, digits and underscores."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def bare_arabic(c: Column) -> Column:
    """Without vowel marks, tatweel and common punctuation, as compared in the verbatim check."""
    return strip(F.regexp_replace(c, r"[\u064b-\u0652\u0670\u0640،.؟!:؛\"'`]", ""))


def arabic_ratio(c: Column) -> Column:
    """Share of Arabic-block characters among those that aren't spaces, tabs or line ends; null for none."""
    seen = F.length(F.regexp_replace(c, r"[ \t\n]", ""))
    return F.when(seen > 0, F.length(F.regexp_replace(c, f"[^{ARABIC}]", "")) / seen)


def is_ocr_text(c: Column) -> Column:
    """Blank lines stay; others need three Arabic characters in a row and over 85 % Arabic characters."""
    return (strip(c) == "") | (c.rlike(f"[{ARABIC}]{{3,}}") & (F.coalesce(arabic_ratio(c), F.lit(0.0)) > 0.85))


def latin1_ratio(c: Column) -> Column:
    seen = F.length(F.regexp_replace(c, r"[\u0000- ]", ""))
    return F.when(seen > 0, F.length(F.regexp_replace(c, r"[^\u0080-ÿ]", "")) / seen).otherwise(0.0)


def is_corrupted_font(c: Column) -> Column:
    return c.rlike(r"[ؼ-ؿ]") | (latin1_ratio(c) >= 0.05)


def is_decomposed(c: Column) -> Column:
    return c.rlike(r"[\ufbb2-\ufbb6\u066e\u06a1]")


def inline_numbers(c: Column) -> Column:
    """Numbers of one to three digits in a line with their confidence, digit family by family."""
    one = lambda digits, conf: F.transform(F.regexp_extract_all(c, F.lit(f"[{digits}]{{1,3}}"), F.lit(0)), lambda n: F.struct(n.alias("number"), F.lit(conf).alias("confidence")))
    return F.concat(one("٠-٩", 0.85), one("۰-۹", 0.85), one("0-9", 0.80))


def is_heading(line: Column) -> Column:
    """A line of 4 to 60 characters (white space at its end aside) without sentence punctuation."""
    return ~line.rlike("[.،؛؟!]") & line.rlike(f"(?d)^.{{4,60}}{WS}*$")


def ends_sentence(c: Column) -> Column:
    return c.rlike(rf"[.؟!]{WS}*$")


def wrap(c: Column, width: int) -> Column:
    """Greedy lines of at most ``width`` characters; a longer word is a line by itself."""
    step = lambda acc, w: F.when(
        (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + 1 + F.length(w) <= width),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), w))),
    ).otherwise(F.concat(acc, F.array(w)))
    return F.aggregate(word_list(c), F.array().cast("array<string>"), step)


def paragraphs(lines: Column, cap: int = 250) -> Column:
    """Lines joined to paragraphs: one ends at a blank line, at a line that ends a sentence, or from ``cap`` words on."""

    def step(acc: Column, line: Column) -> Column:
        last, rest = F.element_at(acc, -1), F.slice(acc, F.lit(1), F.size(acc) - 1)
        full = ends_sentence(last) | (n_words(last) >= cap)
        return (
            F.when((line == "") & (last == ""), acc).when(line == "", F.concat(acc, F.array(F.lit(""))))
            .when(last == "", F.concat(rest, F.array(line))).when(full, F.concat(acc, F.array(line)))
            .otherwise(F.concat(rest, F.array(F.concat_ws(" ", last, line))))
        )

    folded = F.aggregate(F.transform(lines, strip), F.array(F.lit("")), step)
    return F.filter(folded, lambda p: p != "")


def captions(c: Column, most: int = 10, least: int = 4) -> Column:
    """Caption blocks: sentences cut into at most ``most`` words; blocks under ``least`` words join the one before if it fits."""
    flat = F.regexp_replace(strip(c), WS + "+", " ")
    sentences = F.filter(F.split(flat, r"(?<=[.؟!]) "), lambda s: s != "")
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((n_words(s) - 1) / most).cast("int")), lambda i: F.array_join(F.slice(F.split(s, " "), i * most + 1, F.lit(most)), " "))
    blocks = F.flatten(F.transform(sentences, cut))

    def step(acc: Column, b: Column) -> Column:
        last, n = F.element_at(acc, -1), n_words(b)
        return F.when((F.size(acc) > 0) & (n < least) & (n_words(last) + n <= most), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", last, b)))).otherwise(
            F.concat(acc, F.array(b))
        )

    merged = F.aggregate(blocks, F.array().cast("array<string>"), step)
    return F.when(F.size(merged) > 0, merged).otherwise(F.array(flat))


def sentence_chunks(c: Column, most: int = 1500) -> Column:
    """Sentences packed to at most ``most`` characters."""
    sentences = F.split(c, rf"(?<=[.؟!]){WS}+")

    def step(acc: Column, s: Column) -> Column:
        last, rest = F.element_at(acc, -1), F.slice(acc, F.lit(1), F.size(acc) - 1)
        over = F.length(last) + F.length(s) > most
        return F.when(over & (last != ""), F.concat(acc, F.array(s))).when(over, F.concat(rest, F.array(s))).otherwise(F.concat(rest, F.array(F.concat(last, F.lit(" "), s))))

    packed = F.filter(F.transform(F.aggregate(sentences, F.array(F.lit("")), step), strip), lambda s: s != "")
    return F.when(F.size(packed) > 0, packed).otherwise(F.array(c))


def clean_script(c: Column) -> Column:
    """A script without markdown: rules dropped, headings (marked, or short lines after a blank one) ended with a pause."""
    end = lambda s: F.concat(F.regexp_replace(F.regexp_replace(F.regexp_replace(rstrip(s), r"[\u064b-\u065f\u0670]+$", ""), r"\.+$", ""), f"{WS}+$", ""), F.lit("\u0652."))
    body = F.transform(splitlines(c), rstrip)
    kind = lambda s: F.when(s.rlike("^#{1,3}"), "heading").when(s.rlike(r"^-{2,}$"), "rule").otherwise("body")
    text = lambda s: F.when(s.rlike("^#{1,3}"), rstrip(F.regexp_replace(s, rf"^#{{1,3}}{WS}*", ""))).otherwise(s)

    def line(s: Column, i: Column) -> Column:
        before = F.get(body, i - 1)
        after_blank = (i == 0) | (kind(before) == "rule") | ((kind(before) == "body") & (before == ""))
        promoted = after_blank & F.length(s).between(4, 60) & ~s.rlike("[.،؛؟!]") & s.rlike(f"[{ARABIC}]")
        return (
            F.when(kind(s) == "rule", F.lit(None)).when((kind(s) == "heading") & (text(s) == ""), F.lit(None)).when(kind(s) == "heading", end(text(s)))
            .when(promoted, end(s)).otherwise(s)
        )

    kept = F.filter(F.transform(body, line), lambda s: s.isNotNull())
    return strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


# -------------------------------------------------------------------------------------- names, links, hashes


def ext_from_url(url: Column) -> Column:
    """File ending of a link: query aside, jpeg as jpg, .jpg by default."""
    path = F.lower(F.regexp_extract(url, r"^[^?#]*", 0))
    ext = F.regexp_extract(path, r"(\.(?:jpe?g|png|webp|tiff?))$", 1)
    return F.when(ext == "", ".jpg").when(ext == ".jpeg", ".jpg").otherwise(ext)


def query_hash(query: Column) -> Column:
    return F.substring(F.sha2(query, 256), 1, 16)


def file_stem(title: Column) -> Column:
    """A title as a file name of at most 50 characters, "book" if nothing is left."""
    s = F.substring(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N}_\u0600-ۿ\-]", "_"), 1, 50)
    return F.when(s == "", "book").otherwise(s)


def excerpt(typography: Column, caption: Column) -> Column:
    """The typography text, else the caption; over 120 characters cut to 117 and an ellipsis."""
    s = F.coalesce(F.nullif(strip(typography), F.lit("")), strip(caption), F.lit(""))
    return F.when(F.length(s) > 120, F.concat(F.substring(s, 1, 117), F.lit("…"))).otherwise(s)


def ass_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("{"), F.lit("\\{")), F.lit("\n"), F.lit("\\N"))


def ass_time(sec: Column) -> Column:
    """Seconds as H:MM:SS.cc, hundredths rounded half to even and at most 99."""
    s = F.greatest(F.lit(0.0), sec)
    whole = F.floor(s).cast("long")
    cs = F.least(F.lit(99), F.rint((s - whole) * 100).cast("int"))
    return F.when(sec.isNotNull(), F.format_string("%d:%02d:%02d.%02d", F.floor(whole / 3600), (F.floor(whole / 60) % 60).cast("long"), whole % 60, cs))


def strip_fence(c: Column) -> Column:
    """A model's answer without the code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def json_object(c: Column, greedy: bool = True) -> Column:
    """The JSON object inside other text, null if there is none."""
    x = F.regexp_extract(strip_fence(c), r"(?s)\{.*\}" if greedy else r"(?s)\{.*?\}", 0)
    return F.when(x != "", x)


def is_free_license(c: Column) -> Column:
    """Free by the current list: unknown counts as free; any of the reserved terms (as plain substrings) as not free."""
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    bad = s.rlike("nc|non-commercial|noncommercial|nd|no derivative|no-derivative|all rights reserved")
    return ~bad & ((s == "") | s.rlike("^(?:cc-|cc0|pd|public domain|attribution|no known|no restrictions)"))


def is_free_license_words(c: Column) -> Column:
    """As ``is_free_license``, with nc and nd only as whole words, so that "and" doesn't reject."""
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    bad = s.rlike(r"\bnc\b|non-commercial|noncommercial|\bnd\b|no derivative|no-derivative|all rights reserved")
    return ~bad & ((s == "") | s.rlike("^(?:cc-|cc0|cc |pd|public domain|attribution|no known|no restrictions)"))


def is_free_license_v1(c: Column) -> Column:
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    return ~s.rlike("nc|nd|non-commercial|no derivative|no deriv") & ((s == "") | s.rlike("^(?:cc-|cc0|pd|public domain|attribution)"))
