from pyspark.sql import functions as F

from quire.operators import candidates as C
from quire.operators import slots as S
from quire.operators.kernels import complete, first_backend


def test_errors_stay_with_their_items(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "b?")], "id int, t string")
    got = {r.id: (r.value, r.error) for r in S.speech(df, "t", S.speech_stub).collect()}
    assert bytes(got[1][0]) == b"ID3a" and got[2] == (None, "ValueError: nothing to say") and got[3] == (None, None)
    v = {r.id: (r.text, r.failed) for r in S.vowelled(df.where("t IS NOT NULL"), "id", "t", S.vowel_stub).collect()}
    assert v[1] == ("a", 0) and v[4] == ("b?", 1)
    assert S.speech(df.limit(0), "t", S.speech_stub).collect() == []


def test_words_of_a_line(spark):
    w = [{"block": 1, "par": 1, "line": i, "word": x, "conf": c} for i, x, c in ((1, "a", 90.0), (1, "b", 10.0), (1, "c", 65.0), (2, "d", 70.0), (2, " ", 99.0))]
    df = spark.createDataFrame([(w,), ([],)], f"w {S.WORDS}")
    assert [r.t for r in df.select(S.line_text(F.col("w"), 65.0).alias("t")).collect()] == ["a c\nd", ""]


def test_each_prompt_is_sent_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def counting():
        def ask(p):
            import uuid

            (log / f"{p}-{uuid.uuid4().hex}").write_text("")
            if p == "x":
                raise RuntimeError("no")
            return p.upper()

        return ask

    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, None)], "id int, p string")
    out = first_backend(df, F.col("p"), [counting, "echo"])
    got = {r.id: (r.answer, r.backend, list(r.errors)) for r in out.collect()}
    out.count()
    assert got == {1: ("x", "echo", ["kernel 1: RuntimeError: no"]), 2: ("Y", "kernel 1", []), 3: ("Y", "kernel 1", []), 4: (None, None, ["kernel 1: no prompt", "echo: no prompt"])}
    assert sorted(f.name[0] for f in log.iterdir()) == ["x", "y"]
    assert {r.id: r.answer for r in complete(df, F.col("p"), "failing", F.lit("d")).collect()}[4] == "d"


def test_decisions_have_defaults(spark):
    df = spark.createDataFrame([("p", '{"shots": {"3": {"visual": "map", "candidates": [{"source": "loc", "score": 5}]}, "4": {}}, "pinned_portrait": "a.jpg"}'), ("q", "no json")], "plan_id string, document string")
    got = {r.shot_no: r for r in C.read_decisions(df).collect()}
    assert got[3].visual == "map" and got[3].candidates[0].score == 5 and got[3].pinned_portrait == "a.jpg"
    assert got[4].query == "" and got[4].duration_sec == 0.0 and got[4].override is None and got[4].candidates == [] and set(got) == {3, 4}
