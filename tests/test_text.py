import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import arabic as A
from quire.functions import text as T


def plain_article(w):
    """The article's rules word by word."""
    if len(w) < 2:
        return w
    c = w
    if c[0] in "أإآ" and c[1] == "ل":
        if len(w) == 2 or (len(w) == 3 and c[0] != "إ"):
            c = c[1] + c[0] + c[2:]
        elif len(w) > 3:
            c = "ال" + c[0] + c[2:]
    if len(c) >= 3 and c[0] == "ا" and c[1] != "ل" and c[2] == "ل":
        c = c[0] + c[2] + c[1] + c[3:]
    if c == "ال":
        c = "لا"
    if c == w and len(w) >= 4 and w[0] in "وبلكفس":
        return w[0] + plain_article(w[1:])
    return c


def one(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_article_against_the_rules(spark):
    import itertools

    words = ["".join(p) for n in range(0, 6) for p in itertools.product("اأإلوم", repeat=n)] + ["واإلعالمية", "وبالأسباب", "كامل", "آلي", "وألي", "وإلى"]
    assert one(spark, A.fix_article, words) == [plain_article(w) for w in words]


def test_words_lines_and_estimates(spark):
    texts = ["", " a  b ", "a b c\x1cd", "x​y", "one\n\ntwo\r\nthree\x0b", "\n", "a\n"]
    assert one(spark, T.n_words, texts) == [len(t.split()) for t in texts]
    assert one(spark, T.splitlines, texts) == [t.splitlines() for t in texts]
    assert one(spark, T.strip, texts) == [t.strip() for t in texts]
    assert one(spark, T.token_est, [45, 85, 10, 0], "int") == [62, 118, 14, 0]


def test_decomposed_is_stable(spark):
    for a, b in A.PAIRS:
        assert len(a) == 2 and len(b) == 1
    texts = [p for p, _ in A.PAIRS] + ["ڡٮ﮶", "كتاب"]
    got = one(spark, A.fix_decomposed, texts)
    assert got == [b for _, b in A.PAIRS] + ["فث", "كتاب"]
    assert one(spark, A.fix_decomposed, got) == got


def test_normalise(spark):
    assert one(spark, A.normalise_scanned, ["", "  ", "قال\nالرجل» ثم\n١٢\n\n١٢\n\nخصوصً ا ھی ."]) == ["", "", "قال الرجل، ثم ١٢\n\nخصوصًا هي."]
    assert one(spark, A.normalise_digital, ["امل اال ألدوات قال\n12\nx   y"]) == ["الم الا الأدوات قال\n\nx  y"]


def test_paragraphs_wrap_captions(spark):
    assert one(spark, lambda c: T.paragraphs(T.splitlines(c), 4), ["a b\nc.\nd\n\ne f g h\ni"]) == [["a b c.", "d", "e f g h", "i"]]
    assert one(spark, lambda c: T.wrap(c, 5), ["aa bb ccccccc d"]) == [["aa bb", "ccccccc", "d"]]
    assert one(spark, T.captions, ["a b c d e f g h i j k. l m.", ""]) == [["a b c d e f g h i j", "k. l m."], [""]]
    assert one(spark, lambda c: T.sentence_chunks(c, 6), ["ab. cd. efghijk. l"]) == [["ab.", "cd.", "efghijk.", "l"]]


def test_script_is_cleaned(spark):
    got = one(spark, T.clean_script, ["# عنوان\n---\nفصل قصير\nجملة طويلة، نعم.\n\n\n\nخاتمة.\n## \nEnglish line"])
    assert got == ["عنوانْ.\nفصل قصيرْ.\nجملة طويلة، نعم.\n\nخاتمة.\nEnglish line"]


def test_names_and_times(spark):
    assert one(spark, T.ass_time, [0.0, 3661.239, 59.999, -4.0, 0.005, 0.015], "double") == ["0:00:00.00", "1:01:01.24", "0:00:59.99", "0:00:00.00", "0:00:00.00", "0:00:00.02"]
    assert one(spark, T.file_stem, ["a b/ج", None, "x" * 60]) == ["a_b_ج", "book", "x" * 50]
    assert one(spark, T.ext_from_url, ["http://a/b.JPEG?x=.png", "http://a/", "http://a/b.tiff"]) == [".jpg", ".jpg", ".tiff"]
    assert one(spark, T.is_free_license, ["CC-BY-4.0", "", "Attribution and share", None, "GFDL"]) == [True, True, False, True, False]


@given(st.text(alphabet="ab \ńé", max_size=20))
@settings(max_examples=5, deadline=None)
def test_nfc(t):
    import pandas as pd

    assert A.nfc.func(pd.Series([t, None])).tolist() == [unicodedata.normalize("NFC", t), None]
