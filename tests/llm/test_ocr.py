import numpy as np

from quire.llm.ocr import PAGE_NUMBER, Gate, Heads, editor_from, errors, lacking_words, lost_letters, noisy_examples, noisy_pages, page_noise, page_numbers, repair, repaired_pages, train_editor, train_heads

PAGE = "book_id string, page_no int, pdf_type string, raw_text string, raw_text_pre string, ingested_at timestamp, title string"
BOOK = "book_id string, source_path string, metadata map<string,string>, ingested_at timestamp"
EN = "The harbour master wrote a long letter about the winter storm.\nSoldiers crossed the river before the village market opened again.\n"
AR = "قال الرجل، إن القافلة كانت في الطريق، ثم ذهب الجنود مع القائد.\nوكان الجبل فوق القرية، وكتب الأستاذ رسالة طويلة عن الحرب.\n"


def editor():
    return editor_from([EN, AR] * 40)


def test_held_out_accuracy():
    e = editor()
    held = ["The letter about the river market opened before the winter.\nقال الجنود، إن الرسالة كانت عن القرية.\n"] * 20
    examples = noisy_examples(held, seed=11)
    assert sum((e._best(e.w, f) == "K") == (g == "K") for f, g in examples) / len(examples) > 0.98
    assert sum(e._best(e.w, f) == g for f, g in examples) / len(examples) > 0.9
    pages = noisy_pages(held, seed=12)
    places = e.gate.places([t for t, _ in pages])
    through = [{i for a, z in p for i in range(a, z)} for p in places]
    assert sum(len(w & x) for (_, w), x in zip(pages, through)) / sum(len(w) for _, w in pages) > 0.98
    assert sum(map(len, through)) < 0.2 * sum(len(t) for t, _ in pages)


def test_gate_takes_long_texts_in_slices(monkeypatch):
    from quire.llm import ocr

    e, texts = editor(), ["the ha1bour was lo-\nst again " * 40, "", "x", "ق1ل الرجل " * 30]
    want = e.gate.places(texts)
    monkeypatch.setattr(ocr, "_SLICE", 50)
    assert e.gate.places(texts) == want and len(want[0]) >= 80 and want[1] == []


def test_rows_come_from_gate_and_editor():
    e, t = editor(), "the ha1bour was lo-\nst again, 25° it’s «so»."
    assert {k for k, *_ in errors(t, e)} == {"misread", "hyphen"}
    gate, e.gate = e.gate, Gate()  # asks nowhere
    assert errors(t, e) == []
    e.gate = gate
    e.w = {}  # always keeps
    assert errors(t, e) == []
    e.edits, e._best = ["K"], lambda w, f: "Rx"  # always replaces
    assert [k for k, *_ in errors(t, e)] != ["misread", "hyphen"]


def test_lost_letters():
    words = "harbour " * 9 + "winter " * 9 + "market " * 9
    e = editor_from([EN + words] * 40)
    assert lost_letters("the harbur was open in wnter", e) == [(8, "o"), (24, "i")] and lost_letters("harbour", e) == []
    assert "harbour was open in winter" in repair("the harbur was open in wnter", e, set())
    assert lacking_words({"abcde": 3, "abde": 1}) == {"acde": (1, "b"), "abce": (3, "d")}


def test_heads_by_place():
    body = ["the harbour master wrote a long letter about the winter storm and more"] * 8
    pages = [(["A notice of the site, which is long."] * (i % 2) + [f"Old Title {i} | {i}" if i % 3 else f"Old Title {i}", *body, "the end."], f"old title") for i in range(60)]
    h = Heads.fit(pages)
    found = h.heads(["Some Other Name", *body])
    assert found[0][:2] == (0, "some other name") and found[0][3] and not any(sure for *_, sure in found[1:])
    assert Heads().heads(["Old Title  12"])[0][1:] == ("old title", True, False) and Heads.fit([]).heads([]) == []


def test_errors_and_repair():
    e = editor()
    assert {k for k, *_ in errors("the ha1bour was lo-\nst again», 3rd l’été «قال الرجل» x\n", e)} == {"misread", "hyphen"}
    assert errors("قال «الرجل» ثم - \nذهب 1st it’s 25°", e) == []
    assert repair("Old Title\nthe harb-\nour was open\nagain.\n\nNext\n- 7 -", e, {0}) == "the harbour was open again.\n\nNext"


def test_page_number_shapes():
    for x in ("12", "- ٥ -", "—۱۴—", "[7]", "٢٠ |", "صفحة ٧", "p. 9", "Page 12", "‎١٢‏"):
        assert PAGE_NUMBER.fullmatch(x), x
    for x in ("", "1) note", "chapter 3", "_____", "12345", "p", "مذكرات 5"):
        assert not PAGE_NUMBER.fullmatch(x), x
    assert page_numbers(["a", "7", ""]) == [1]


def test_operators(spark):
    body = EN * 2
    rows = [("d", i, "digital", EN + AR, None, None, "x") for i in range(1, 61)]
    rows += [
        ("b", 1, "scanned", "My Old Tit1e | 4\n" + body + "the vil-\nlage\n—4—", None, None, "x"),
        ("b", 2, None, "  ", "My Old Title\n" + body, None, "x"),
        ("b", 3, "digital", "12\nthe ha1bour", None, None, "x"),
        ("b", 4, "scanned", None, None, None, "x"),
        ("b", 5, "scanned", "le d‚sert ha1bour\n12", "", None, "x"),
        ("u", 1, "mixed", "Lost Name Here  3\n" + body, None, None, "x"),
        ("u", 2, "mixed", "Lost Name Here\n" + body, None, None, "x"),
    ]
    rows.append(rows[5])
    p = spark.createDataFrame(rows, PAGE)
    b = spark.createDataFrame([("b", "s", {"title": "My Old Title"}, None), ("u", "s", {"title": " "}, None), ("u", "s", None, None)], BOOK)
    got = {tuple(r) for r in page_noise(p, b).collect()}
    assert got == {("b", 1, "misread"), ("b", 1, "header"), ("b", 1, "pageno"), ("b", 1, "hyphen"), ("b", 2, "header"), ("b", 5, "pageno"), ("u", 1, "header"), ("u", 2, "header")}
    texts = {(r.book_id, r.page_no): r.text for r in repaired_pages(p, b).collect()}
    assert "Title" not in texts[("b", 1)] and "village" in texts[("b", 1)] and texts[("b", 4)] == ""
    assert page_noise(p.limit(0), b.limit(0)).collect() == []


def test_every_page_is_learnt_from(spark):
    words = [c * 2 + "arbour" + c for c in "bcdfghjklmnpqrstvwxz"]  # each on 3 of 420 pages
    rows = [("d", i, "digital", EN + (words[i // 3] if i < 60 else "") + " again 7th.", None, None, "x") for i in range(420)]
    rows += [("b", i, "scanned", ("My Old Title | 4\n" if i % 40 == 0 else "") + EN, None, None, "x") for i in range(400)]
    p, b = spark.createDataFrame(rows, PAGE), spark.createDataFrame([("b", "s", {"title": "My Old Title"}, None)], BOOK)
    e = train_editor(p)
    assert all(w[:3] + w[4:] in e.lacking for w in words)
    assert {k for k, *_ in errors("the ha1bour was lo-\nst again 7th.", e)} == {"misread", "hyphen"}
    h = train_heads(p, b)
    assert [h.heads(("My Old Title | 4\n" + EN).split("\n"))[0][1:]] == [("my old title", True, True)] and len(h.heads(EN.split("\n"))) == 0


def test_counts_stand_for_texts():
    texts = noisy_pages([EN, AR] * 40)
    counts = Gate.count(texts)
    codes = np.array(sorted({c for c, _ in counts}))
    gate = Gate().fit_counts(codes, *(np.array([counts.get((c, y), 0) for c in codes.tolist()]) for y in (False, True)))
    assert sum(n for (_, y), n in counts.items() if y) == sum(len(w) for _, w in texts)
    through = [{i for a, z in p for i in range(a, z)} for p in gate.places([t for t, _ in texts])]
    assert sum(len(w & x) for (_, w), x in zip(texts, through)) > 0.99 * sum(len(w) for _, w in texts)
    assert Gate().fit_counts(codes[:0], codes[:0], codes[:0]).places(["x1y"]) == [[]]
