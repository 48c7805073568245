"""What the operators share: cut lineage, sized jobs, columns out of the way."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut  # noqa: F401


def few(df: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """`df`, of about so many rows as counted, in no more tasks than these need: small tables make small jobs."""
    want = rows // per_task + 1
    return df.coalesce(want) if want < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def with_text(df: DataFrame, keep, text: str) -> tuple[DataFrame, int]:
    """`keep` and the text, and the text's place among them; a text that is kept anyway goes to Python once."""
    if text in keep:
        return df.select(*keep), list(keep).index(text)
    return df.select(*keep, F.col(text).alias("__text")), len(keep)


@contextmanager
def small_batches(spark, rows: int = 1_000):
    """Jobs that start within hand texts to Python in batches of so many rows; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release() -> None:
    """Gives a worker's unused memory back, as workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def forget(spark) -> None:
    """Lets the driver drop what finished jobs left behind: plans that Python still refers to, and then, as Spark's own
    cleaner does at longer intervals, broadcasts, shuffles and classes of plans that nobody refers to any more."""
    gc.collect()
    release()
    spark.sparkContext._jvm.System.gc()


def aside(df: DataFrame, names) -> DataFrame:
    """`df` with columns of these names under another name, out of the way of an operator's own."""
    return df.withColumnsRenamed({n: f"__own_{n}" for n in names if n in df.columns})


def back(df: DataFrame, columns) -> DataFrame:
    """The columns again under their names, and only they."""
    return df.select(*(F.col(f"__own_{c}").alias(c) if f"__own_{c}" in df.columns else F.col(c) for c in columns))
