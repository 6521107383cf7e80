import numpy as np

from quire.llm import garbled
from quire.llm.garbled import _ARABIC, SWAP_MAPS, SWAPS, Model, N, _codes, affected_pages, fit_cipher, garbled_pages, garbled_tokens, is_garbled

SCHEMA = "book_id string, page_no int, source_path string, raw_text string, n_garbled string"
AR = "قال الرجل إن القافلة كانت في الطريق إلى المدينة قبل الشتاء وكان الجبل فوق القرية ثم ذهب الجنود مع القائد إلى النهر"


def wrong(text, written, read):
    return text.encode(written).decode(read, "replace")


def test_detects_families_and_leaves_genuine_letters():
    for written, read in (("utf-8", "cp1256"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "latin-1"), ("cp1256", "cp1252"), ("iso8859_6", "latin-1")):
        assert is_garbled("abc " + wrong("القافلة كانت", written, read)), (written, read)
    assert is_garbled("le d‚sert") and is_garbled("l√©t") and is_garbled("x � y") and is_garbled("ï»¿Le")
    for ok in (None, "", "Łanvek Søvrik Åsdrel Ãlvora Ølvra Ñandur Dvořin Küßdorf Çelbat Âmir Îlane", "λόγος «книга»", "l’été à où — œuvre", AR, "£5 ±2 25° § ÷ ©", "ومع‌شى» ع‍لى", "آھوة الآھثة"):
        assert not is_garbled(ok), ok


def model_of(text):
    codes = _codes(text).astype(int)
    counts = np.zeros((N, N))
    np.add.at(counts, (codes[:-1], codes[1:]), 1)
    return Model(counts)


def sentences(n, seed):
    """Invented Arabic: words from syllables of uneven frequency, so that bigrams tell letters apart."""
    rng = np.random.default_rng(seed)
    parts = [a + b for a in _ARABIC for b in "اويلنم"]
    p = 1 / np.arange(1, len(parts) + 1)
    parts = [parts[i] for i in np.random.default_rng(0).permutation(len(parts))]
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4), p=p / p.sum())) for _ in range(n))


def test_em_learns_an_unknown_swap():
    """A permutation that is no known code page is learnt from bigrams alone: no letter is given, and the model comes from
    other text."""
    model, text = model_of(sentences(20000, 1)), sentences(3000, 2)
    letters = sorted(set(text) - {" "})
    glyphs = [chr(0xC0 + i) for i in np.random.default_rng(3).permutation(len(letters))]
    cipher = dict(zip(letters, glyphs, strict=True))
    seen_text = "".join(cipher.get(c, c) for c in text)
    seen = sorted(set(seen_text))
    at = {c: i for i, c in enumerate(seen)}
    x = np.array([at[c] for c in seen_text])
    counts = np.zeros((len(seen), len(seen)))
    np.add.at(counts, (x[:-1], x[1:]), 1)
    got = fit_cipher(seen, counts, model, None)
    back = "".join(got.get(c, c) for c in seen_text)
    assert sum(a == b for a, b in zip(back, text, strict=True)) / len(text) > 0.9


def test_candidates_come_from_the_model(monkeypatch):
    model = model_of(AR * 50 + "le désert était près de la forêt " * 50)
    bad = "نص " + wrong(AR, "utf-8", "cp1256")
    assert len(garbled_tokens(bad, model)) > 10 and not garbled_tokens(AR, model) and not garbled_tokens("", model)
    assert garbled_tokens("x 😀 " + wrong("كان", "utf-8", "cp1256"), model)
    model.unlikely[:] = False
    assert not garbled_tokens(bad, model)


def test_swaps_without_a_known_sequence_are_found():
    model = model_of(sentences(20000, 1))
    for written, read in (("cp1256", "cp1251"), ("iso8859_6", "iso8859_7")):
        t = wrong(sentences(60, 5).replace("ى", "ي"), written, read)
        assert (written, read) in SWAPS and garbled_tokens(t, model), (written, read)
    assert not garbled_tokens("в начале было слово и слово было у бога и слово было бог", model)


def test_pages_are_restored(spark):
    clean = [(f"b{i}", 1, "s", AR, "x") for i in range(30)]
    fr = "le désert était près de la forêt"
    bad = [
        ("g1", 1, "s", "نص " + wrong(AR, "utf-8", "cp1256"), "x"),
        ("g2", 1, None, wrong(AR, "cp1256", "cp1252"), "x"),
        ("g3", 1, "s", wrong(wrong(fr, "utf-8", "latin-1"), "utf-8", "latin-1"), "x"),
        ("g4", 1, "s", "���� x", "x"), ("g5", 1, "s", "Ø®Ù„Ù� waldâ€�", "x"),
        ("n1", 1, "s", None, "x"), ("n2", 1, "s", "", "x"), ("n3", 1, "s", "  ", None),
    ]
    df = spark.createDataFrame(clean + bad + bad[:1], SCHEMA)
    out = {r.book_id: r for r in garbled_pages(df).collect()}
    assert set(out) == {"g1", "g2", "g3", "g4", "g5"}
    assert out["g1"].restored == "نص " + AR and out["g3"].restored == fr
    assert sum(a == b for a, b in zip(out["g2"].restored, AR, strict=True)) > 0.95 * len(AR)
    assert out["g4"].restored == "���� x" and out["g4"].n_restored == 0
    assert out["g5"].restored == "خلف wald”" and out["g5"].n_restored == 2
    assert garbled_pages(df.limit(0)).collect() == []
    assert {r.book_id for r in affected_pages(df, texts=False).collect()} == set(out)


def test_swap_maps_are_inverse():
    assert SWAP_MAPS[SWAPS.index(("cp1256", "cp1252"))]["Ç"] == "ا" and garbled.UNLIKELY < 0
