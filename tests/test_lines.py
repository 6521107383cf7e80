import random
import re

from pyspark.sql import functions as F

from quire.operators import lines as L

BIDI = "​‌‍‎‏‪‫‬‭‮؜﻿"
MARK = re.compile(r"^[(\[{]\s*[٠-٩۰-۹0-9؟?]\s*[)\]}]")
BACK = re.compile(r"^[)\]}]\s*[٠-٩۰-۹0-9؟?]\s*[(\[{]")
NEW = re.compile(r"^[(\[{]\s*[٠-٩۰-۹0-9]\s*[)\]}]|^[)\]}]\s*[٠-٩۰-۹0-9]\s*[(\[{]")
PAGES = "book_id string, page_no int, pdf_type string, raw_text string, raw_text_pre string"


def clean(x):
    return "".join(c for c in x if c not in BIDI).strip()


def note(c):
    if MARK.match(c):
        return 0.95
    if BACK.match(c):
        return 0.90
    if re.match(r"[*†‡§¶#+\-–—―]", c):
        return 0.85
    if re.match(r"[ء-ي]\)", c):
        return 0.70
    return 0.60 if c and len(c) < 50 and re.search("انظر|راجع|هامش", c) else None


def number(s):
    for p, v in ((r"[٠-٩]+|[۰-۹]+", 0.95), (r"[0-9]+", 0.90), (r"[-–—\s]*[٠-٩۰-۹0-9]+[-–—\s]*", 0.85)):
        if re.fullmatch(p, s):
            return v
    return 0.90 if re.search(r"صفحة?\s*[٠-٩۰-۹0-9]+", s) else None


def separator(s):
    return 0.90 if re.fullmatch(r"[-_*=—–]+", s) else 0.75 if re.fullmatch(r"[-_*=—–\s]*[٠-٩۰-۹0-9]+[-_*=—–\s]*", s) else None


def header(s):
    return 0.80 if s and len(s) < 60 and not re.search("[.،:؛]", s) and re.search("مقدمة|فصل|كتاب|ذكريات|مذكرات|مدكرات|[٠-٩۰-۹0-9]", s) else None


def classify(pages):
    """The rules line by line, page after page of each book."""
    out = []
    books = {}
    for b, no, _, t, _ in pages:
        books.setdefault(b, []).append((no, t))
    for b, ps in books.items():
        pending = False
        for no, t in sorted(ps):
            ls = t.split("\n")
            n = len(ls)
            top, low = max(1, int(n * 0.15)), min(n - 1, int(n * 0.85))
            rows, cross = [], set()
            if pending:
                for i in range(low, n):
                    c = clean(ls[i])
                    if c.startswith("=") or re.match("[-–—―][ \t]", c):
                        rows.append((i, "footnote", 0.80, c))
                        cross.add(i)
                        for j in range(i + 1, min(n, i + 15)):
                            s = ls[j].strip()
                            if not s or NEW.match("".join(x for x in s if x not in BIDI)):
                                break
                            rows.append((j, "footnote", 0.70, s))
                            cross.add(j)
                        break
            for i in range(low, n):
                s, c = ls[i].strip(), clean(ls[i])
                if s and i not in cross:
                    hit = next(((k, v) for k, v in (("footnote", note(c)), ("page_number", number(s)), ("separator", separator(s))) if v), None)
                    if hit:
                        rows.append((i, *hit, s))
            for i in range(top):
                s = ls[i].strip()
                if s and i not in cross and header(s):
                    rows.append((i, "running_header", 0.80, s))
                    for p, v in ((r"[٠-٩]{1,3}", 0.85), (r"[۰-۹]{1,3}", 0.85), (r"[0-9]{1,3}", 0.80)):
                        rows += [(i, "page_number", v, m) for m in re.findall(p, ls[i])]
            seen = {r[0] for r in rows} | cross
            for i, x in enumerate(ls):
                if i not in seen and x.strip() and (MARK.match(clean(x)) or BACK.match(clean(x))):
                    rows.append((i, "footnote", 0.88, x.strip()))
                    seen.add(i)
            for i in [r[0] for r in rows if r[1] == "footnote"]:
                for j in range(i + 1, min(n, i + 15)):
                    s = ls[j].strip()
                    if not s:
                        break
                    if j in seen:
                        continue
                    if NEW.match("".join(x for x in s if x not in BIDI)) or (len(s) >= 120 and s.endswith(".")):
                        break
                    rows.append((j, "footnote", 0.60, s))
                    seen.add(j)
            pending = any(k == "footnote" and re.search(r"=$| [-–—―]$", x.rstrip()) for _, k, _, x in rows)
            out += [(b, no, *r) for r in rows]
    return sorted(out)


def test_classes_against_the_rules(spark):
    rng = random.Random(6)
    kinds = ["نص عادي من كتاب قديم", "٥", "12", "- ٥ -", "صفحة ٧", "(١) هامش أول", ")٢( هامش", "(12) نص", "* نجمة", "أ) حرف", "انظر كذا", "_____", "=====", "-----", "مذكرات ,5", "", "  ", "x" * 130 + ".",
             "= يتبع", "- يتبع", "(٣) ينتهي =", "نص ينتهي -", "‎(٤)‏ مع علامات", "plain line", "[٢] اثنان", "فصل"]
    pages = []
    for b in range(25):
        for no in range(1, rng.choice([2, 3, 6])):
            pages.append((f"b{b}", no, "scanned", "\n".join(rng.choice(kinds) for _ in range(rng.choice([1, 2, 7, 20, 30]))), ""))
    df = spark.createDataFrame(pages, PAGES)
    got = sorted(tuple(r) for r in L.classify_lines(df).collect())
    assert got == classify(pages)
    stripped = {(r.book_id, r.page_no): r for r in L.strip_lines(df, L.classify_lines(df)).collect()}
    for b, no, _, t, _ in pages:
        gone = {r[2] for r in got if r[:2] == (b, no)}
        assert stripped[b, no].text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) and stripped[b, no].n_stripped == len(gone)


def test_documented_cases(spark):
    c = lambda f, xs: [r.y for r in spark.createDataFrame([(x,) for x in xs], "x string").select(f(F.col("x")).alias("y")).collect()]
    assert c(L.page_number_conf, ["٥", "۵", "12", "- ٥ -", "صفحة ٧", "x"]) == [0.95, 0.95, 0.90, 0.85, 0.90, None]
    assert c(L.footnote_conf, ["(١) نص", ")١( نص", "(12) نص", "* نص", "أ) نص", "انظر كذا", "-----", "نص"]) == [0.95, 0.90, None, 0.85, 0.70, 0.60, 0.85, None]
    assert c(L.separator_conf, ["_____", "=====", "نص"]) == [0.90, 0.90, None] and c(L.header_conf, ["مذكرات ,5", "نص، 5", "نص", ""]) == [0.80, None, None, None]


def test_empty_and_headers(spark):
    empty = spark.createDataFrame([], PAGES)
    assert L.classify_lines(empty).collect() == [] and L.header_words(empty).collect() == [] and L.boundaries(empty).collect() == []
    rows = [("b", i, "scanned", f"ذكريات الحرب\nنص {i}\nثم", "") for i in (1, 2)] + [("b", 3, "scanned", None, ""), ("b", 4, "scanned", "\n \nآخر", "")]
    df = spark.createDataFrame(rows, PAGES)
    assert {r.word for r in L.header_words(df).collect()} == {"ذكريات", "الحرب"}
    assert [(r.page_no, r.next_page, r.tail, r.head) for r in L.boundaries(df).orderBy("page_no").collect()] == [(1, 2, "نص 1\nثم", "ذكريات الحرب\nنص 2\nثم"), (2, 4, "نص 2\nثم", "آخر")]
    assert [r.line_no for r in L.blank_header(df, L.pages_without_headers(df)).collect()] == [0, 0]
