import random

import numpy as np
import pytest

from quire.llm import splitting
from quire.llm.splitting import cohesion, cuts, most_words, pieces, pieces_once, split_chunks, tokens

SCHEMA = "book_id string, chunk_id int, chapter string, text string, token_est int, piece_no string"


def text(words, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(words):
        out.append(f"w{rng.randrange(60)}" + ("." if i % 9 == 8 else "") + ("\n\n" if i % 90 == 89 else " "))
    return "".join(out)


def test_token_estimate():
    assert [tokens(n) for n in (45, 85, 10)] == [62, 118, 14]
    assert tokens(most_words()) <= 1500 < tokens(most_words() + 1)


def test_cohesion_against_counting():
    ids = np.array([random.Random(2).randrange(9) for _ in range(60)])
    got = np.concatenate([[0], cohesion(ids, np.arange(1, 60), 7)])
    for i in range(1, 60):
        a, b = np.bincount(ids[max(0, i - 7) : i], minlength=9), np.bincount(ids[i : i + 7], minlength=9)
        assert abs(got[i] - (a @ b) / np.sqrt((a @ a) * (b @ b))) < 1e-9


def test_pieces_hold_all_words_within_limit():
    for n in (1073, 1500, 4000):
        t = text(n)
        ps, lap, words = pieces(t), int(200 / 1.4), t.split()
        assert len(ps) > 1 and all(tokens(len(p.split())) <= 1500 for p in ps)
        back = ps[0].split()
        for a, b in zip(ps, ps[1:]):
            assert b.split()[:lap] == a.split()[-lap:]
            back += b.split()[lap:]
        assert back == words
    assert pieces("one two") == ["one two"] and pieces("") == [""] and pieces(text(30), 20, 5)


def test_valley_is_found():
    """Between two vocabularies lies the deepest valley."""
    t = " ".join(f"a{i % 20}" for i in range(700)) + " " + " ".join(f"b{i % 20}" for i in range(700))
    assert abs(cuts(t)[0][1] - 700) <= 2


def test_cut_is_the_deepest_natural_valley():
    """Of many sentence ends the one between two vocabularies is taken, and no place inside a sentence."""
    say = lambda v, n: " ".join(" ".join(f"{v}{(7 * i + k) % 40}" for k in range(9)) + f" {v}end." for i in range(n))
    t = say("a", 78) + " " + say("b", 60)
    assert cuts(t)[0][1] == 780
    none = " ".join(f"a{i % 20}" for i in range(1400))
    assert len(cuts(none)) == 2
    early = "x. " * 100 + "y " * 1400
    assert cuts(early)[0][1] == 100


def test_pieces_come_from_the_segmentation(monkeypatch):
    t = text(1500)
    monkeypatch.setattr(splitting, "cohesion", lambda ids, gaps, block=40: np.zeros(len(gaps)))
    flat = splitting.cuts(t)
    monkeypatch.undo()
    assert flat != splitting.cuts(t)


def test_operator(spark):
    long = text(1300)
    rows = [("b", 1, None, long, 3, "x"), ("b", 1, None, long, 3, "x"), ("b", 2, "c", "short", 9999, "x"), ("b", 3, "c", None, 1, "x"), ("b", 4, "c", "", 1, "x"), ("b", 5, "c", "x" * 9000, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sorted(pieces_once(df).collect(), key=lambda r: r.piece_no)
    assert [r.piece_no for r in out] == list(range(1, len(out) + 1)) and all(r.chapter is None and r.token_est <= 1500 for r in out)
    assert split_chunks(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        split_chunks(df, 100, 90)
