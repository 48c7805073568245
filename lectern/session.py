"""Session defaults the engine expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build(master: str = "local[*]", app: str = "lectern", **conf: str) -> SparkSession:
    """A session with the engine's settings; keyword names use `__` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept by `checkpoint()` in spark.checkpoint.dir, which outlives lost executors.

    Only on one machine (a `local` master), as in tests, a new temporary folder takes the place of a missing setting.
    """
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return df.checkpoint(eager=True)
