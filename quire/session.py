"""Session helpers: local sessions, reliable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is small enough to be broadcast. Sides are narrow (keys and one or two short strings),
#: so this bounds a broadcast to a few tens of MB; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def local_session(cores: int | str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings every test and benchmark shares."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("quire")
    base = {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there.

    The folder is the cluster's ``spark.checkpoint.dir``. Where that is unset, a local session takes a temporary one; a
    cluster, whose workers would each have their own, is refused. The files are shared storage, so a lost executor loses nothing.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return df.checkpoint(eager=True)


def small_or_shuffled(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
