import random

from pyspark.sql import functions as F

from quire.operators.intervals import coverage, shot_coverage


def brute(rows, tol):
    by = {}
    for p, s, e in rows:
        if p is not None and s is not None and e is not None and e > s:
            by.setdefault(p, []).append((s, e))
    out = set()
    for p, x in by.items():
        x.sort()
        cur = []
        for s, e in x:
            if cur and s <= cur[-1][1] + tol:
                cur[-1][1] = max(cur[-1][1], e)
            else:
                cur.append([s, e])
        out |= {(p, "period", s, e) for s, e in cur}
        out |= {(p, "gap", a[1], b[0]) for a, b in zip(cur, cur[1:])}
    return out


def test_coverage_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for p in range(12):
        for _ in range(rng.choice([1, 5, 60])):
            s = rng.randrange(-300, 3000)
            rows.append((f"p{p}", s, s + rng.choice([-3, 0, 1, 5, 40, 64, 128, 700])))
    rows += [("p0", None, 5), ("p0", 5, None), (None, 1, 2), rows[0], ("one", 64, 128), ("two", 0, 64), ("two", 64, 70)]
    df = spark.createDataFrame(rows, "plan_id string, start long, end long").withColumn("shard", F.lit("clash"))
    for tol in (0, 7):
        got = {tuple(r) for r in coverage(df, "plan_id", F.col("start"), F.col("end"), tol, shard=64).collect()}
        assert got == brute(rows, tol)


def test_shots_empty_and_rounding(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.05, 2.0), ("a", 2.0511, 3.0), ("a", float("nan"), 9.0), ("a", 1.0, float("inf")), ("a", float("-inf"), 2.0), (None, 1.0, 2.0), ("a", None, 1.0)], "plan_id string, start double, end double")
    assert sorted(map(tuple, shot_coverage(df).collect())) == [("a", "gap", 2000, 2051), ("a", "period", 0, 2000), ("a", "period", 2051, 3000)]
    assert shot_coverage(df.limit(0)).collect() == []
