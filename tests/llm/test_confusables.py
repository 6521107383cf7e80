import unicodedata as u

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import confusables
from quire.llm.confusables import consistent_texts, form, kinds, lookalike_groups, settled, skeleton, unsettled, variant_texts

PAGE = "book_id string, page_no int, raw_text string, form string"
CHUNK = "book_id string, chunk_id int, text string, kinds string"


def test_kinds():
    assert kinds("Ａbc") == ["full_width"] and kinds("é") == ["uncomposed"] and kinds("a​b") == ["unseen"]
    assert kinds("a b") == ["space"] and kinds("ﻻ") == ["presentation"] and kinds("ﬁ") == ["presentation"]
    assert kinds("pаge") == ["mixed"] and kinds("ک") == ["arabic_form"]
    for t in (None, "", " \t\n", "книга λόγος", "été Łódź", "قَالَ", "-–—’«»"):
        assert kinds(t) == [], t


def test_form_and_skeleton():
    assert form("ｐаｇｅ é") == "page é" and form("ﻻ ﻣﻊ کی") == "لا مع كي" and form("книга") == "книга"
    assert form(None) is None and form("") == ""
    assert skeleton("pаge") == skeleton("page") and skeleton("ﬁn") == skeleton("fin") and skeleton("ک") == skeleton("ك")


def test_skeleton_of_far_lookalikes():
    for a, b in (("раураl", "paypal"), ("g00gle", "gOOgle"), ("rnodern", "modern"), ("ɑ", "a"), ("Ꭺ", "A"), ("ﬃ", "ffi"), ("e\u0301", "é"), ("a\u200bb", "ab"), ("ＡＢ", "AB")):
        assert skeleton(a) == skeleton(b), a
    assert settled("été") and settled("modern") and settled("قال") and not settled("Ꭺ") and not settled("e\u0301")


def test_cases_come_from_the_skeleton(monkeypatch):
    assert kinds("a\u200bb") and kinds("ک")
    monkeypatch.setattr(confusables, "_KNOWN", confusables._Settled())
    monkeypatch.setattr(confusables, "skeleton", lambda w, table=None: w)
    assert not kinds("a\u200bb") and not kinds("ک")


@given(st.text())
@settings(max_examples=300, deadline=None)
def test_form_is_composed_and_stable(t):
    f = form(t)
    assert form(f) == f
    if not u.is_normalized("NFC", t):
        assert unsettled(t)
    assert u.is_normalized("NFC", f)


def test_operators(spark):
    p = spark.createDataFrame([("b", 1, "a​b", "x"), ("b", 2, "ab", "x"), ("b", 3, None, "x"), ("b", 4, "", "x"), ("b", 5, "d‚sert a​b", "x"), ("b", 1, "a​b", "x")], PAGE)
    c = spark.createDataFrame([("b", 1, "ｘ", "y"), ("b", 2, None, "y")], CHUNK)
    assert {tuple(r) for r in variant_texts(p, c).select("record_type", "book_id", "item_no").collect()} == {("page", "b", 1), ("chunk", "b", 1)}
    assert {r.item_no: r.form for r in consistent_texts(p, c).where("record_type = 'page'").collect()} == {1: "ab", 2: "ab", 4: "", 5: "d‚sert ab"}
    assert [(r.skeleton, r.form, r.n_words, r.n_spellings) for r in lookalike_groups(p, c).collect()] == [("ab", "ab", 4, 2)]
    assert variant_texts(p.limit(0), c.limit(0)).collect() == []
