import time

from pyspark.sql import functions as F

from quire.operators.chunking import bundle_parts
from quire.operators.folds import fold_sorted
from quire.operators.timeline import stitched


def test_state_is_kept_over_batches_and_keys(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = fold_sorted(df, ["k"], ["id"], "k long, n long", lambda s, r: ((r[0], (s[1] if s else 0) + 1), []), lambda s: [s]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in out} == {(0, 1667), (1, 1667), (2, 1666)}
    assert fold_sorted(df.limit(0), ["k"], ["id"], "k long, n long", lambda s, r: (s, [])).collect() == []


def test_one_hot_plan_takes_linear_time(spark):
    n = 100_000
    shots = spark.range(n).select(F.lit("p").alias("plan_id"), F.col("id").cast("int").alias("shot_no"), F.col("id").cast("double").alias("start"), (F.col("id") + 0.5).alias("end"))
    totals = spark.createDataFrame([("p", float(n) + 1)], "plan_id string, total double")
    began = time.time()
    r = stitched(shots, totals).agg(F.count("*").alias("n"), F.max("end").alias("e"), F.sum(F.col("end") - F.col("start")).alias("s")).first()
    assert (r.n, r.e) == (n, n + 1) and abs(r.s - (n + 1)) < 1e-3
    items = shots.select("plan_id", "shot_no", F.lit(10).alias("size"))
    assert bundle_parts(items, ["plan_id"], "shot_no", "size", 100).agg(F.max("part_no")).first()[0] == n / 10
    assert time.time() - began < 60
