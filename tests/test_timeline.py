import random

from pyspark.sql import functions as F

from quire.operators import audit as A
from quire.operators import candidates as C
from quire.operators import kernels as K
from quire.operators import timeline as L

SHOT = (
    "plan_id string, book_id string, shot_no int, start double, end double, visual string, search_query string, motion string, typography_template string, typography_text string, "
    "caption_text string, show_caption boolean, note string, section_id string"
)


def shot(plan, no, s, e, visual="archive", q="q", text="", cap="", note="", show=True, section="opening"):
    return (plan, "b", no, s, e, visual, q, "zoom_in", None, text, cap, show, note, section)


def test_documented_timeline(spark):
    rows = [shot("p", 1, 0.0, 3.5, q="a"), shot("p", 2, 3.5, 12.0, q="b"), shot("p", 3, 12.7, 18.3, q="c"), shot("p", 4, 18.3, 30.0, "portrait", q="d"), shot("p", 5, 31.0, 35.0), shot("p", 6, None, 2.0)]
    df = spark.createDataFrame(rows, SHOT)
    totals = spark.createDataFrame([("p", 30.0)], "plan_id string, total double")
    st = L.stitched(df, totals).orderBy("shot_no").collect()
    assert [(r.shot_no, r.start, r.end) for r in st] == [(1, 0.0, 3.5), (2, 3.5, 12.0), (3, 12.0, 18.3), (4, 18.3, 30.0)]
    assert L.stitched(df.limit(0), totals).collect() == []


def plain_stitch(rows, total):
    out = []
    for s, no, e in sorted(rows):
        if s >= total:
            continue
        e = min(e, total)
        if out:
            s = out[-1][2]
            e = s + 2.0 if e <= s else e
        out.append([no, s, e])
    if out:
        out[-1][2] = total
    return [tuple(x) for x in out]


def test_stitch_and_merge_against_the_rules(spark):
    rng = random.Random(9)
    rows, totals = [], []
    for p in range(15):
        totals.append((f"p{p}", float(rng.choice([5, 20, 40]))))
        for no in range(1, rng.choice([2, 6, 20])):
            s = rng.randrange(0, 100) / 2
            rows.append(shot(f"p{p}", no, s, s + rng.choice([0, 0.5, 3, 15]), rng.choice(["archive", "typography"]), rng.choice(["", "x"]), rng.choice(["", "t"]), rng.choice(["", "c", "d"]), rng.choice(["", "n"])))
    df = spark.createDataFrame(rows, SHOT)
    st = L.stitched(df, spark.createDataFrame(totals, "plan_id string, total double"))
    got = {}
    for r in st.orderBy("plan_id", "start", "shot_no").collect():
        got.setdefault(r.plan_id, []).append((r.shot_no, r.start, r.end))
    want = {p: plain_stitch([(r[3], r[2], r[4]) for r in rows if r[0] == p], t) for p, t in totals}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    merged = L.merge_adjacent(st.join(df.drop("start", "end"), ["plan_id", "shot_no"])).collect()
    by = {(r[0], r[2]): r for r in rows}
    for p, x in want.items():
        out = []
        for no, s, e in x:
            r = by[p, no]
            key = (r[5], r[6], r[9])
            if out and out[-1]["key"] == key and abs(s - out[-1]["e"]) <= 0.05:
                o = out[-1]
                o["e"] = e
                if r[10] and r[10] != o["cap"]:
                    o["cap"] = f"{o['cap']} {r[10]}".strip()
            else:
                out.append({"no": no, "key": key, "s": s, "e": e, "cap": r[10]})
        assert sorted((r.shot_no, r.end, r.caption_text) for r in merged if r.plan_id == p) == sorted((o["no"], o["e"], o["cap"]) for o in out)


def test_word_times(spark):
    t = spark.createDataFrame([("b", 1, "ab, cdef"), ("b", 2, "gh"), ("c", 1, None)], "book_id string, part int, text string")
    w = L.word_timings(t, "book_id", "part", 8.0)
    assert [(r.word, r.start, r.end) for r in w.orderBy("word_no").collect()] == [("ab", 0.0, 2.0), ("cdef", 2.0, 6.0), ("gh", 6.0, 8.0)]
    for n_heard in (1, 2, 3, 7):
        heard = spark.createDataFrame([("b", i, float(i), i + 1.0) for i in range(n_heard)], "book_id string, word_no int, start double, end double")
        got = [(r.start, r.end) for r in L.proportional_map(w, heard, "book_id").orderBy("word_no").collect()]
        want = []
        for i in range(3):
            lo = min(n_heard - 1, i * n_heard // 3)
            hi = max(lo + 1, min(n_heard, (i + 1) * n_heard // 3))
            want.append((float(lo), float(hi)))
        assert got == want
    assert L.proportional_map(w, heard.limit(0), "book_id").collect() == []


def test_nearest_captions_sections(spark):
    rng = random.Random(2)
    words = [("b", i, 1 + i // 20, f"w{i}", i * 0.5, i * 0.5 + 0.5) for i in range(100)]
    w = spark.createDataFrame(words, "book_id string, word_no int, part int, word string, start double, end double")
    shots = [shot("p", n, s, s + rng.choice([0.1, 2.0, 20.0])) for n, s in enumerate([rng.randrange(-10, 600) / 10 for _ in range(40)], 1)]
    df = spark.createDataFrame(shots, SHOT)
    got = {r.shot_no: (r.start, r.end) for r in L.snap(df, w, "book_id").collect()}
    caps = {r.shot_no: r.caption for r in L.captions_of(df, w, "book_id", ["shot_no"]).collect()}
    parts = {r.shot_no: r.part for r in L.section_of(df, L.section_ranges(w, "book_id"), "book_id", ["shot_no"]).collect()}
    for r in shots:
        no, s, e = r[2:5]
        ns, ne = min((x[4] for x in words), key=lambda a: (abs(a - s), a)), min((x[5] for x in words), key=lambda a: (abs(a - e), a))
        assert got[no] == (ns, ne if ne > ns else ns + 1.5)
        assert caps.get(no, "") == " ".join(x[3] for x in words if x[4] >= s - 0.05 and x[5] <= e + 0.05)
        mid = (s + e) / 2
        assert parts[no] == next((p for p in range(1, 6) if (p - 1) * 10 <= mid <= p * 10), None)


def test_sizes_and_splits(spark):
    x = spark.createDataFrame([(337.1, 4.5), (90.0, 3.5), (180.0, 4.5), (20.0, 4.5), (5000.0, 4.5)], "s double, e double")
    assert [r.n for r in x.select(L.target_shots(F.col("s"), F.col("e")).alias("n")).collect()] == [65, 25, 40, 8, 65]
    y = spark.createDataFrame([("typography", 12.1), ("typography", 12.2), ("map", 8.0), ("map", 12.5), ("map", 25.0)], "v string, d double")
    assert [r.n for r in y.select(L.split_pieces(F.col("v"), F.col("d")).alias("n")).collect()] == [1, 2, 1, 2, 5]


def test_audit(spark):
    rows = [shot("p", 1, 0.0, 1.0, text="a b", note="x [auto-split 1/2]"), shot("p", 2, 1.5, 3.0, text=" a b ", note="x [auto-split 2/2]"), shot("p", 3, 2.0, 4.0, text="c"), shot("p", 4, None, None)]
    df = spark.createDataFrame(rows, SHOT)
    g = A.gaps_overlaps(df).first()
    assert (g.n_gaps, g.n_overlaps, g.gap, g.overlap) == (1, 1, 0.5, 1.0)
    f = A.split_fragments(df).first()
    assert (f.n, f.n_pieces, f.n_originals, f.implied, f.verdict) == (4, 2, 1, 3, "❌")
    assert {(r.text, r.n_shots) for r in A.typography_texts(df).collect()} == {("a b", 2), ("c", 1)}
    t = A.typography_texts(df).withColumn("book_id", F.lit("b"))
    s = spark.createDataFrame([("b", "x a، b y")], "book_id string, script string")
    assert {(r.shot_no, r.verdict) for r in A.verbatim(t, s, "book_id").collect()} == {(1, "verbatim"), (3, "paraphrase")}


def test_candidates(spark):
    rows = [(1, i, *s) for i, s in enumerate([(3, 1, 0), (-1, -1, -1), (2, 2, 1), (3, 0, 1), (0, 3, 3), (2, 2, 1), (1, 1, 1)])]
    df = spark.createDataFrame(rows, "shot_no int, ord int, score_subject int, score_quality int, score_cinematic int")
    assert [r.ord for r in C.rank(df.where(C.passes()), ["shot_no"]).orderBy("rank").collect()] == [2, 5, 0, 3, 1]
    files = spark.createDataFrame([("o1",), ("p",), ("c2",), ("c3",)], "path string")
    dec = [(1, "portrait", "o1", "p", "c1"), (2, "portrait", "gone", "p", "c2"), (3, "archive", "gone", "p", "c3"), (4, "archive", None, "p", "gone"), (5, "portrait", None, None, None), (6, "archive", None, "p", "c2")]
    got = {r.shot_no: (r.path, r.via) for r in C.resolve_dossier(spark.createDataFrame(dec, "shot_no int, visual string, override string, pinned string, chosen string"), files).collect()}
    assert got == {1: ("o1", "override"), 2: ("p", "pinned"), 3: ("c3", "chosen"), 4: (None, None), 5: (None, None), 6: ("c2", "chosen")}


def test_kernels(spark):
    assert K.salvage('{"shots": [{"a": 1}, {"b": "}"}]}') == [{"a": 1}, {"b": "}"}]
    assert K.salvage('x {"shots": [{"a": {"c": 1}}, {"b": "cut') == [{"a": {"c": 1}}]
    assert K.salvage('{"shots": [{"a": 1}, {bad}, {"c": 1}') == [{"a": 1}] and K.salvage(None) == [] and K.salvage("no") == []
    df = spark.createDataFrame([(i, f"p{i % 5}") for i in range(20)] + [(99, None)], "i int, p string")
    x = K.complete(df, F.col("p"), "failing", F.lit("none")).collect()
    assert len(x) == 21 and all((r.answer == "none") == (r.error is not None or r.p is None) for r in x)
    y = K.first_backend(df, F.col("p"), ["failing", "echo"]).collect()
    assert len(y) == 21 and {r.backend for r in y} <= {"failing", "echo", None} and all(r.answer == r.p for r in y)
    b = spark.createDataFrame([("a", " ".join(["w"] * 700)), ("b", "short")], "book_id string, outline string")
    out = {r.book_id: r for r in K.revise(b, "echo", "score").collect()}
    assert out["b"].retries == 3 and out["a"].retries in (0, 1, 2, 3) and (out["a"].retries == 3 or out["a"].total >= 35)
    pages = spark.createDataFrame([("b", 1, "a\nb"), ("b", 2, "H\nc\nd"), ("b", 3, None)], "book_id string, page_no int, raw_text string")
    st = {r.page_no: r.text for r in K.stitch_pages(pages, lambda p: {"join": True, "header": "H"}).collect()}
    assert st == {1: "a\nb\nc", 2: "\nd", 3: ""}


def test_labels_past_the_alphabet(spark):
    from quire.plans import media_queries

    df = spark.createDataFrame([(1, i, s) for i in range(30) for s in ("loc", "pexels")], "shot_no int, ord int, source string")
    got = {(r.source, r.ord): r.label for r in C.labels(df, ["shot_no"]).collect()}
    assert len(got) == 60 and [got[("loc", i)] for i in (0, 25, 26, 29)] == ["loc:a", "loc:z", "loc:26", "loc:29"]
    docs = spark.range(97 * 300).select((F.col("id") * 97).alias("doc_id"), F.lit("x").alias("title"))
    old, media_queries.t = media_queries.t, lambda *_: docs
    try:
        assert media_queries.candidate_labels(spark, "").count() == 97 * 300
    finally:
        media_queries.t = old


def test_uploads_of_every_plan(spark, monkeypatch):
    from quire.plans import media_queries

    rows = [("p", 1, "a"), ("p", 5, "z"), ("p", 9, "a"), ("q", 1, "z"), ("q", 9, "z"), ("q", 40, None)]
    shots = spark.createDataFrame(rows, "plan_id string, shot_no int, search_query string")
    monkeypatch.setattr(media_queries.tables, "shots", lambda *_: shots)
    got = {(r.plan_id, r.shot_no): (r.path, r.via) for r in media_queries.user_uploads(spark, "").collect()}
    assert got == {
        ("p", 1): ("shot_01.jpg", "name"), ("p", 5): ("five.jpg", "number"), ("p", 9): (None, None),
        ("q", 1): ("z.png", "query"), ("q", 9): ("z.png", "query"), ("q", 40): (None, None),
    }
