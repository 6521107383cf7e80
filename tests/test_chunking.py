import random
import re

from pyspark.sql import functions as F

from quire.operators import chunking as C

HEAD = re.compile(r"^(?!.*[.،؛؟!])(.{4,60})\s*$", re.MULTILINE)


def plain_sections(text):
    at = list(HEAD.finditer(text))
    if not at:
        return [("full_book", text.strip())]
    out, held = [], []
    if text[: at[0].start()].strip():
        out.append(("intro", text[: at[0].start()].strip()))
    for m, nxt in zip(at, [*at[1:], None]):
        title, body = m.group(1).strip(), text[m.end() : nxt.start() if nxt else len(text)].strip()
        if body:
            out.append((title, "\n\n".join([*held, title, body])))
            held = []
        else:
            held.append(title)
    if held:
        x = "\n\n".join(held)
        if out:
            out[-1] = (out[-1][0], out[-1][1] + "\n\n" + x)
        else:
            out = [("full_book", x)]
    return out


def plain_pieces(text, most=1500, lap=200):
    if int(len(text.split()) * 1.4) <= most:
        return [text]
    for sep in ("\n\n", "\n", ".", "،", " "):
        parts = text.split(sep)
        if len(parts) > 1:
            out, cur, tail = [], "", ""
            for p in parts:
                cand = cur + sep + p if cur else p
                if len(cand.split()) <= int(most / 1.4):
                    cur = cand
                else:
                    if cur:
                        out.append(cur)
                        tail = " ".join(cur.split()[-int(lap / 1.4) :]) if int(lap / 1.4) else ""
                    cur = (tail + " " + p).strip() if tail else p
            return [*out, cur] if cur else out
    return [text]


def plain_chunks(text, most, lap, stub=8):
    out, held = [], ""
    for title, t in plain_sections(text):
        for p in (x.strip() for x in plain_pieces(t, most, lap)):
            if len(p.split()) < stub:
                held = (held + "\n\n" + p).strip() if held else p
            else:
                out.append([title, (held + "\n\n" + p).strip() if held else p])
                held = ""
    if held:
        if out:
            out[-1][1] += "\n\n" + held
        else:
            out = [["intro", held]]
    return [tuple(x) for x in out]


def book(rng):
    lines = []
    for _ in range(rng.choice([1, 4, 25])):
        lines.append(rng.choice(["فصل في الحرب", "عنوان آخر", "", "جملة تنتهي هنا.", " ".join(f"كلمة{rng.randrange(9)}" for _ in range(40)) + ".", "نص، مع فاصلة " * 9, "abc"]))
    return "\n".join(lines)


def test_chunks_against_the_rules(spark):
    rng = random.Random(4)
    books = {f"b{i}": [book(rng) for _ in range(rng.choice([1, 2, 5]))] for i in range(40)}
    rows = [(b, i, t) for b, ps in books.items() for i, t in enumerate(ps, 1)]
    df = spark.createDataFrame([*rows, ("e", 1, " "), ("e", 2, None)], "book_id string, page_no int, raw_text string")
    for most, lap in ((1500, 200), (60, 14), (60, 0)):
        got = {}
        for r in C.chunk_pages(df, most, lap).orderBy("book_id", "chunk_id").collect():
            got.setdefault(r.book_id, []).append((r.chapter, r.text))
        want = {}
        for b, ps in books.items():
            ps = [p for p in ps if p.strip()]
            if ps:
                want[b] = plain_chunks("\n".join(ps), most, lap)
        assert {b: [t for _, t in x] for b, x in got.items()} == {b: [t for _, t in x] for b, x in want.items()}
        assert got == want


def test_script_sections(spark):
    t = "عنوان\nمقدمة\nالنقطة  الأولى: أ\nنص\n\nالخاتمة\n  \nالنقطة الأولى ثانية"
    df = spark.createDataFrame([("s", t), ("n", "plain"), ("e", ""), ("z", None), ("h", "الخاتمة")], "k string, text string")
    got = [(r.k, r.section_id, r.title, r.text) for r in C.script_sections(df, "k").orderBy("k", "sec_no").collect()]
    assert got == [
        ("h", "closing", "الخاتمة", "الخاتمة"), ("n", "opening", "plain", "plain"), ("s", "opening", "عنوان", "عنوان\nمقدمة"), ("s", "point_1", "النقطة  الأولى: أ", "النقطة  الأولى: أ\nنص"),
        ("s", "closing", "الخاتمة", "الخاتمة"), ("s", "point_1", "النقطة الأولى ثانية", "النقطة الأولى ثانية"),
    ]


def test_bundles(spark):
    sizes = [3, 4, 9, 1, 0, 0, 12, 5]
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate(sizes)], "k string, o long, z long")
    want, used, part = [], 0, 1
    for s in sizes:
        if used and used + s > 9:
            part, used = part + 1, 0
        used += s
        want.append(part)
    assert [r.part_no for r in C.bundle_parts(df, ["k"], "o", "z", 9).orderBy("o").collect()] == want
    assert C.bundle_parts(df.limit(0), ["k"], "o", "z", 9).collect() == []


def test_groups(spark):
    df = spark.createDataFrame([("b", i, f"t{i}") for i in range(7)] + [("c", 1, None)], "book_id string, chunk_id int, text string")
    got = [(r.group_no, r.n_chunks, r.text) for r in C.reader_groups(df, 3).orderBy("group_no").collect()]
    assert got == [(0, 2, "t0\n\nt1"), (1, 2, "t2\n\nt3"), (2, 2, "t4\n\nt5"), (3, 1, "t6")]
    assert C.sections(df.select("book_id", F.col("chunk_id").alias("page_no"), F.col("text").alias("raw_text")).limit(0)).collect() == []


def test_script_revision_counts_whole_books(spark, monkeypatch):
    from quire.plans import kernel_queries

    rows = [("long", i, " ".join(["word"] * 700)) for i in range(5)] + [("short", 1, "a b c")]
    chunks = spark.createDataFrame(rows, "book_id string, chunk_id int, text string")
    monkeypatch.setattr(kernel_queries.tables, "chunks", lambda *_: chunks)
    got = {r.book_id: r for r in kernel_queries.script_revision(spark, "").collect()}
    # the last attempt's script has the marks of two failed attempts
    assert got["long"].n_words == 3500 + 2 * 3 and got["long"].retries == 3 and got["short"].n_words == 3 + 2 * 3


def test_exact_pages(spark):
    say = lambda a, n: " ".join(f"w{a}x{k}" for k in range(n)) + "."
    rows = [("b", i, "\n".join(["  " + say(f"{i}a", 40), "", say(f"{i}b", 30)])) for i in range(1, 9)] + [("c", 1, "A heading here\nsome words of the body of it."), ("c", 2, "more words on the second page of this book.")]
    df = spark.createDataFrame(rows, "book_id string, page_no int, raw_text string")
    plain = {(r.book_id, r.chunk_id): r for r in C.chunk_pages(df, 200, 20).collect()}
    exact = {(r.book_id, r.chunk_id): r for r in C.chunk_pages(df, 200, 20, exact_pages=True).collect()}
    assert plain.keys() == exact.keys() and len(exact) > 5
    for k, r in exact.items():
        assert (r.text, r.chapter, r.word_count, r.token_est) == tuple(plain[k][c] for c in ("text", "chapter", "word_count", "token_est"))
        on = {no for b, no, t in rows if b == r.book_id for w in r.text.split() if w.strip(".") in t.replace(".", "").split()}
        if r.book_id == "b":
            assert (r.page_start, r.page_end) == (min(on), max(on)), k
    assert (exact[("c", 0)].page_start, exact[("c", 0)].page_end) == (1, 2)
