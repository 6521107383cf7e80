import random
import re

import numpy as np

from quire.llm import repeated_lines as module
from quire.llm.repeated_lines import letters, line_classes, long_lines, masked, minhash_bands, repeated_lines, shingle_likeness, without_repeated_lines

BOOK = "book_id string, source_path string, metadata map<string,string>, ingested_at timestamp"
PAGE = "book_id string, page_no int, raw_text string, ingested_at timestamp, source string, line_no int"


def test_masks():
    assert letters("Abc, 12/3 déf_") == "abcdéf"
    assert masked("digitised by John Smith on 3 May 2020") == "digitisedbyon"


def test_bands_follow_letters():
    a = "the quick brown fox jumps over the lazy dog again and again"
    got = minhash_bands([letters(a), letters(a.upper()), letters("something else entirely written here")])
    assert (got[:, 0] == got[:, 1]).all() and (got[:, 0] != got[:, 2]).all() and minhash_bands([]).shape[1] == 0
    assert long_lines("x\n" + a + "\n" + a.upper() + " on 3 May 2020") == [(2, letters(a), letters(a)), (3, letters(a) + "onmay", letters(a) + "on")]


def test_likeness():
    assert shingle_likeness("abcdefgh", "abcdefgh") == 1 and shingle_likeness("abcdefgh", "stuvwxyz") == 0 and shingle_likeness("ab", "ab") == 1


def brute(pages, books, least=3):
    src = {}
    for b, s, *_ in books:
        src.setdefault(b, s)
    seen = {}
    for b, no, t, *_ in pages:
        for i, x in enumerate((t or "").split("\n"), 1):
            k = "".join(c for c in x.lower() if c.isalpha())
            if len(k) >= 20 and src.get(b):
                seen.setdefault((src[b], k), set()).add((b, no, i))
    return {r for v in seen.values() if len({b for b, *_ in v}) >= least for r in v}


def test_against_brute_force(spark):
    rng = random.Random(3)
    note = ["Digitised by the Reading Room on {}/{}/2020, all rights reserved", "جميع الحقوق محفوظة لدى دار النشر رقم {} {}", "Short line {} {}"]
    books = [(f"b{i}", None if i == 9 else "hot" if i < 6 else "cold", None, None) for i in range(12)] + [("b1", "hot", None, None)]
    pages = []
    for i in range(13):
        for p in range(1, 4):
            lines = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "sit", "elit"]) + str(rng.random()) for _ in range(5)) for _ in range(3)]
            if rng.random() < 0.6:
                x = rng.choice(note).format(rng.randrange(30), rng.randrange(12))
                lines.insert(rng.randrange(3), rng.choice([x, x.upper(), "* " + re.sub(" ", "  ", x)]))
            pages.append((f"b{i}", p, "\n".join(lines), None, "x", 1))
    pages += [("b1", 9, None, None, "x", 1), ("b1", 10, "", None, "x", 1), pages[0], (None, 1, "x" * 40, None, "x", 1)]
    p, b = spark.createDataFrame(pages, PAGE), spark.createDataFrame(books, BOOK)
    want = brute(pages, books)
    got = {tuple(r) for r in repeated_lines(p, b).collect()}
    assert got == want and want
    texts = {(r.book_id, r.page_no): r for r in without_repeated_lines(p, b).collect()}
    k = next(iter(want))
    t = next(x[2] for x in pages if x[:2] == k[:2]).split("\n")
    classes = line_classes(p, b).collect()
    like = {(r.book_id, r.page_no, r.line_no) for r in classes}
    assert texts[k[:2]].text == "\n".join(x for i, x in enumerate(t, 1) if (*k[:2], i) not in like)
    assert texts[("b1", 9)].text is None
    assert len({(r.book_id, r.page_no, r.line_no) for r in classes}) == len(classes) and want <= {(r.book_id, r.page_no, r.line_no) for r in classes}
    assert repeated_lines(p.limit(0), b).collect() == [] and repeated_lines(p, b.limit(0)).collect() == []


def test_classes_link_all_like_lines(spark):
    rng = random.Random(5)
    abc = "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"
    word = lambda n: "".join(rng.choice(abc) for _ in range(n))
    pairs = []
    for _ in range(300):
        a = word(60)
        b = a[:30] + rng.choice(abc.replace(a[30], "")) + a[31:]
        pairs.append((a, b))
    one, two = minhash_bands([a for a, _ in pairs]), minhash_bands([b for _, b in pairs])
    assert all(shingle_likeness(a, b) >= 0.8 for a, b in pairs) and (one == two).any(0).mean() > 0.99
    pages, books = [], [(f"b{i}", "s", None, None) for i in range(3)]
    for n in range(40):  # each line like the one before it only, all of other books
        a = word(60)
        b = a[:15] + rng.choice(abc.replace(a[15], "")) + a[16:]
        x = [a, b, b[:45] + rng.choice(abc.replace(b[45], "")) + b[46:]]
        pages += [(f"b{i}", n, t, None, "x", 1) for i, t in enumerate(x)]
    got = {}
    for r in line_classes(spark.createDataFrame(pages, PAGE), spark.createDataFrame(books, BOOK)).collect():
        got.setdefault(r.page_no, set()).add((r.book_id, r.line_class))
    whole = [n for n, x in got.items() if len(x) == 3 and len({c for _, c in x}) == 1]
    assert len(whole) >= 39


def test_texts_lose_near_duplicates_and_found_needs_the_classes(spark, monkeypatch):
    who = ["anna bell", "carl dunn", "eve frost", "gus hall"]
    note = "this volume was digitised for the reading room of the old harbour town by our volunteer {}"
    pages = [(f"b{i}", 1, "A line of its own, number " + "xyzwvu"[i] * 9 + "\n" + note.format(w), None, "x", 1) for i, w in enumerate(who)]
    books = [(f"b{i}", "s", None, None) for i in range(4)]
    p, b = spark.createDataFrame(pages, PAGE), spark.createDataFrame(books, BOOK)
    assert {r.n_removed for r in without_repeated_lines(p, b).collect()} == {1} and repeated_lines(p, b).collect() == []
    same = spark.createDataFrame([(x[0], 1, note, None, "x", 1) for x in pages], PAGE)
    assert repeated_lines(same, b).count() == 4
    monkeypatch.setattr(module, "line_classes", lambda *a, **k: line_classes(*a, **k).limit(0))
    assert repeated_lines(same, b).collect() == []
