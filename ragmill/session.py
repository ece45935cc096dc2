"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "ragmill", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("RAGMILL_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if SparkSession.getActiveSession() is None:
        # One machine: what intermediate results leave goes with the process.
        scratch = tempfile.mkdtemp(prefix="ragmill-")
        atexit.register(shutil.rmtree, scratch, ignore_errors=True)
        builder = builder.config("spark.checkpoint.dir", scratch)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that every executor can reach.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only a local
    master may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/ragmill-{os.urandom(8).hex()}"
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="ragmill-")
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


#: Inputs below this size may sit in fewer pieces than there are cores.
SMALL_BYTES = 1 << 30


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a result; needs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a small input before Python work on each row.

    A large input already comes in many splits and is not shuffled.
    """
    if df.isStreaming:
        return df
    if plan_bytes(df) > SMALL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


#: Rows and length of texts that a Python step works on at a time; what it makes of them is handed on before the next.
SLICE_ROWS, SLICE_LENGTH = 4096, 1 << 19


def slices(frames: Iterator[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
    """Frames of few rows, fewer where ``text`` is long, so that a task holds the results of a slice and not of an Arrow batch."""
    for frame in frames:
        start, length = 0, 0
        for at, value in enumerate(frame[text]):
            length += len(value) if value is not None else 0
            if length >= SLICE_LENGTH or at + 1 - start == SLICE_ROWS:
                yield frame.iloc[start : at + 1]
                start, length = at + 1, 0
        if start < len(frame):
            yield frame.iloc[start:]


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from there.

    Several branches then read it instead of computing it again, and a lost executor
    costs a re-read, not a recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/part"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
