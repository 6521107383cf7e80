from quire.tables import once


def test_once(spark):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, None), ("a", 2, None), ("b", 1, "y"), (None, 1, "z"), ("c", None, "w")]
    df = spark.createDataFrame(rows, "k string, n int, t string")
    assert sorted(map(tuple, once(df, ["k", "n"]).collect()), key=str) == sorted(set(rows), key=str)
    assert once(df.limit(0), ["k", "n"]).collect() == []
