import random

from quire.llm.truncation import Endings, longer_copies, stem, text_facts, train_endings, truncated_texts, truncation_rates

SCHEMA = "doc_id long, text string, source string, kind string, longer_id int"
LONG = "The harbour master wrote a long letter about the winter storm and the soldiers. Then he left."


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 9)))
    say = lambda: " ".join(" ".join(word() for _ in range(9)) + rng.choice(".?!") for _ in range(4))
    close = ["— {} {}", "Yours, {} {}", "المخلص {} {}", "1912", "١٩٢٤"]
    out = [(say() + rng.choice(["\n", "\n\n"]) + rng.choice(close).format(word(), word()), "letter") for _ in range(120)]
    return out + [(say(), rng.choice(["memoir", "brief", None])) for _ in range(120)]


def test_endings_are_learnt():
    m = Endings.fit(corpus())
    cases = [
        ("He was done.", "memoir", "complete"), ("ثم قال؟", "script", "complete"), ("It is done. ✅.", "brief", "complete"), ("«Done.»", "brief", "complete"), ("He (left.)", None, "complete"),
        ("He le", "memoir", "open"), ("He left,", "memoir", "open"), ("He [...]", "memoir", "mark"), ("He le...", "memoir", "mark"), ("قا�", "letter", "mark"), ("He le…", None, "mark"), ("Cap [...]", "caption", "mark"),
        ("A title", "heading", "complete"), ("A picture", "caption", "complete"), ("", "memoir", "blank"), (" \t\n ", "memoir", "blank"), (None, "memoir", None),
        ("A text.\n\nYours, A B", "letter", "complete"), ("A text.\n— A B", "letter", "complete"), ("A text.\n\n1913", "letter", "complete"), ("A text.\n\nالمخلص فلان كذا", "letter", "complete"),
        ("A text.\n\nThen he went on to the hou", "letter", "open"), ("A text.\n— A B", "memoir", "open"),
    ]
    assert [(t, k, m.ending(t, k)) for t, k, _ in cases] == cases
    assert Endings.fit([]).ending("a b", "memoir") == "complete"  # nothing learnt
    assert stem("He le [...]  ") == "He le" and stem("...") == ""


def test_longer_copies_and_rates(spark):
    rows = [
        (1, LONG, "a", "memoir"), (2, LONG[:40], "a", "memoir"), (3, LONG[:40] + "...", "a", "memoir"), (4, LONG[:70], "b", "brief"), (5, LONG + " More.", "b", "brief"),
        (6, None, "b", "brief"), (7, "", "b", "brief"), (8, "Hi", "b", "brief"), (9, "Other words entirely, not a prefix of any text in the whole li", None, "brief"), (10, LONG, "b", "memoir"),
        (11, "Text of a letter.\n\nYours, Anna Bell", "c", "letter"), (12, "Text of a letter.\n\nYours, Anna Be", "c", "letter"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, rows[1]]], SCHEMA)
    facts = text_facts(df, train_endings(df))
    longer = {r.doc_id: r.longer_id for r in longer_copies(df, facts).collect()}
    stems = {i: stem(t or "") for i, t, *_ in rows}
    brute = {i for i, x in stems.items() if len(x) >= 16 and any(y.startswith(x) and len(y) > len(x) for y in stems.values())}
    assert set(longer) == brute == {1, 2, 3, 4, 10, 12} and all(stems[j].startswith(stems[i]) and len(stems[j]) > len(stems[i]) for i, j in longer.items())
    assert longer[2] == 4 and longer[4] == 1 and longer[1] == 5
    got = {r.doc_id: (r.evidence, r.longer_id) for r in truncated_texts(df).collect()}
    assert got[3] == ("mark", 4) and got[12] == ("copy", 11) and not {1, 5, 6, 7, 10, 11} & set(got)
    many = df.union(spark.createDataFrame([(100 + i, t, None, k, 1) for i, (t, k) in enumerate(corpus())], SCHEMA))
    assert {i for i in (r.doc_id for r in truncated_texts(many).collect()) if i < 100} == {2, 3, 4, 8, 9, 12}
    rates = {r.source: (r.n_texts, r.n_cut, r.usual_length) for r in truncation_rates(many).where("source IS NOT NULL").collect()}
    assert rates == {"a": (3, 2, 40), "b": (4, 2, 2), "c": (2, 1, 33)}
    assert truncated_texts(df.limit(0)).collect() == [] and truncation_rates(df.limit(0)).collect() == []


def test_prefixes_across_partitions(spark):
    rng = random.Random(9)
    base = "a template that very many texts begin with: "
    texts = [base + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 14))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "s", "memoir", 1) for i, t in enumerate(texts)], SCHEMA).repartition(7)
    got = {r.doc_id: r.longer_id for r in longer_copies(df, text_facts(df, Endings({}, set()))).collect()}
    stems = [t.rstrip() for t in texts]
    assert set(got) == {i for i, x in enumerate(stems) if any(y != x and y.startswith(x) for y in stems)}
    assert all(stems[j].startswith(stems[i]) for i, j in got.items())
