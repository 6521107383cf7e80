import random

from quire.llm import runs
from quire.llm.runs import PENALTY, dissimilarity, event_runs, key_text, near, segment

SCHEMA = "plan_id string, shot_no int, start double, end double, visual string, typography_text string, created_at timestamp, part int"


def brute(rows):
    by, seen = {}, set()
    for p, no, s, e, v, t, *_ in rows:
        if p is not None and s is not None and (p, no) not in seen:
            seen.add((p, no))
            by.setdefault(p, []).append((s, no, e, v, t))
    out = set()
    for p, x in by.items():
        x.sort(key=lambda r: r[:2])
        run = [x[0]]
        for a, b in zip(x, x[1:] + [None]):
            same = b is not None and a[3] is not None and b[3] is not None and a[3].strip().lower() == b[3].strip().lower() and near(key_text(a[4]), key_text(b[4]))
            if same:
                run.append(b)
            else:
                if len(run) > 1:
                    out.add((p, run[0][1], run[-1][1], len(run)))
                run = [b]
    return out


def cheapest(one, two):
    """The least cost of all segmentations, by trying them."""
    n, best = len(one), None
    for mask in range(1 << (n - 1)):
        starts = [0] + [i for i in range(1, n) if mask >> (i - 1) & 1]
        cost = price(starts, one, two)
        best = cost if best is None else min(best, cost)
    return best


def price(starts, one, two):
    cost = 0.0
    for a, z in zip(starts, [*starts[1:], len(one)]):
        cost += PENALTY + sum(one[k] if k == a + 1 else min(one[k], two[k]) for k in range(a + 1, z))
    return cost


def test_segment_is_optimal():
    rng = random.Random(1)
    differ = 0
    for _ in range(400):
        n = rng.randrange(1, 10)
        one, two = ([rng.choice([0, 0.05, 1.0, 1.4, 2.5, float("inf")]) for _ in range(n)] for _ in range(2))
        got = segment(one, two)
        assert abs(price(got, one, two) - cheapest(one, two)) < 1e-9 or price(got, one, two) == cheapest(one, two)
        differ += got != [0] + [k for k in range(1, n) if one[k] >= PENALTY]
    assert differ > 20 and segment([], []) == []


def test_passing_events_stay_in_their_run(spark):
    a, b = "the harbour at night", "the harbour by night"
    rows = [("p", i, float(i), i + 1.0, "Map", t, None, 1) for i, t in enumerate([a, b, a, a, "nothing of the kind", a, a])]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    spans = lambda **k: {(r.first_shot_no, r.last_shot_no) for r in event_runs(df, **k).collect()}
    assert dissimilarity(key_text(a), key_text(b)) > PENALTY
    assert spans() == {(0, 3), (5, 6)} and spans(chains=True) == {(2, 3), (5, 6)}


def test_runs_come_from_the_segmentation(spark, monkeypatch):
    rows = [("p", i, float(i), i + 1.0, "Map", "x", None, 1) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = runs._pieces(df.toPandas().rename(columns={"end": "stop"}).assign(look="map"), True)
    monkeypatch.setattr(runs, "segment", lambda one, two: list(range(len(one))))
    parts = runs._pieces(df.toPandas().rename(columns={"end": "stop"}).assign(look="map"), True)
    assert [s[5] for s in whole] == [4] and [s[5] for s in parts] == [1] * 4


def test_near():
    assert near(key_text("Ab-c"), key_text("abc")) and near(key_text(None), key_text("  "))
    assert near("abcdefghijkl", "abcdefghijklm") and near("abcdefghijkl", "abcdxfghijkl")
    assert not near("abcdefghijk", "abcdefghijx") and not near("abcdefghijkl1", "abcdefghijkl2")
    assert key_text("قَـال") == key_text("قال")


def test_runs_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for p in range(9):
        for no in range(1, rng.choice([2, 9, 400])):
            s = None if rng.random() < 0.05 else rng.randrange(0, 60) / 4
            v = rng.choice(["Map", " map", None, "photo", "photo"])
            t = rng.choice([None, " ", "abcdefghijklmn", "abcdefghijklm!n", "abcdefghijkxmn", "other"])
            rows.append((f"p{p}", no, s, None if s is None else s + 1, v, t, None, 1))
    rows += rows[:20] + [(None, 1, 1.0, 2.0, "a", "b", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.plan_id, r.first_shot_no, r.last_shot_no, r.n_shots) for r in event_runs(df, chains=True).collect()}
    assert got == brute(rows)
    assert event_runs(df.limit(0)).collect() == []
