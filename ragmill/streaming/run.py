"""Running a stream to the end of what is there, into an append-only Parquet log."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: What state of keys needs: a store that holds more than memory does, and many small ones without room in advance.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings that hold while a stream starts; it keeps a copy of them."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _log(stream: DataFrame, root: str):
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{root}/log").option("checkpointLocation", f"{root}/checkpoint")
    )


def append_log(stream: DataFrame, root: str) -> DataFrame:
    """Process everything available and return the log so far.

    The file sink commits each batch once, and the checkpoint lies beside the log: a
    restarted job goes on where the last one stopped.
    """
    with settings(stream.sparkSession, STATE_SETTINGS):
        query = _log(stream, root).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_log(stream, root)


def append_log_until(stream: DataFrame, root: str, enough: Callable[[DataFrame], bool], seconds: float, every: str = "1 second") -> DataFrame:
    """Run a continuous stream until ``enough`` holds of its log; a stream whose state expires never ends by itself."""
    with settings(stream.sparkSession, STATE_SETTINGS):
        query = _log(stream, root).trigger(processingTime=every).start()
    end = time.monotonic() + seconds
    try:
        while time.monotonic() < end:
            if query.exception() is not None:
                raise query.exception()
            if query.lastProgress is not None and enough(read_log(stream, root)):
                return read_log(stream, root)
            time.sleep(0.2)
    finally:
        query.stop()
    raise TimeoutError(f"not enough after {seconds} s")


def read_log(stream: DataFrame, root: str) -> DataFrame:
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/log")
