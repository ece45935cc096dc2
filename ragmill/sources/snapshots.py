"""Snapshot tables: every rebuild is a new version folder, readers take the last complete one.

A bucketed table is cut into ranges of a key, one folder each. A load rewrites only the ranges it has keys of; a manifest, which
is a snapshot of its own, says which version holds each range, so readers see a load as a whole or not at all.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragmill.session import materialize

#: Rows of the sample that gives the borders of ranges, per range.
BORDER_SAMPLE = 40
MANIFEST = "bucket int, start string, version long, schema string"


def _versions(spark: SparkSession, root: str) -> list[tuple[int, bool]]:
    """(version, complete) of the folders below root; Spark marks a finished write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("v=") and name[2:].isdigit():
            done = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
            found.append((int(name[2:]), done))
    return sorted(found)


def write_snapshot(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write the next version. A failed write leaves the current version in place."""
    taken = _versions(df.sparkSession, root)
    version = taken[-1][0] + 1 if taken else 1
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{root}/v={version:08d}")
    return version


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    done = [v for v, complete in _versions(spark, root) if complete and version in (None, v)]
    if not done:
        raise FileNotFoundError(f"no complete snapshot below {root}")
    return spark.read.parquet(f"{root}/v={done[-1]:08d}")


def write_chunks(chunks: DataFrame, root: str, model: str, config: dict, buckets: int = 32, mode: str = "append") -> None:
    """Append chunks with their vector, chunker settings and model, foldered by hash of the owner.

    Rebalancing splits the folder of a big owner over as many tasks as its size asks for.
    """
    settings = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in config.items()]))
    bucket = F.pmod(F.xxhash64("owner"), F.lit(buckets)).cast("int")
    out = chunks.withColumn("chunker_config", settings).withColumn("embedding_model", F.lit(model))
    out = out.withColumn("owner_bucket", bucket)
    out.hint("rebalance", F.col("owner_bucket")).write.mode(mode).partitionBy("owner_bucket").parquet(root)


def read_chunks(spark: SparkSession, root: str, owner: str | None = None, buckets: int = 32) -> DataFrame:
    """Chunks; with an owner only its folder is listed and read."""
    df = spark.read.parquet(root)
    if owner is None:
        return df
    bucket = F.pmod(F.xxhash64(F.lit(owner)), F.lit(buckets)).cast("int")
    return df.filter((F.col("owner_bucket") == bucket) & (F.col("owner") == owner))


def _range_of(key: str, borders: list[str], low: int = 0) -> Column:
    """The number of borders up to the key, by halving."""
    if not borders:
        return F.lit(low)
    mid = len(borders) // 2
    below = F.col(key).isNull() | (F.col(key) < F.lit(borders[mid]))
    return F.when(below, _range_of(key, borders[:mid], low)).otherwise(_range_of(key, borders[mid + 1 :], low + mid + 1))


def _manifest(spark: SparkSession, root: str) -> list:
    """(bucket, start, version, schema) of all ranges; as many as the table was made with."""
    return sorted(read_snapshot(spark, f"{root}/manifest").collect(), key=lambda r: r["bucket"])


def _write_ranges(df: DataFrame, root: str, key: str, borders: list[str], version: int) -> None:
    placed = df.withColumn("_bucket", _range_of(key, borders))
    placed.hint("rebalance", F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/data/v={version:08d}")


def write_buckets(df: DataFrame, root: str, key: str, buckets: int = 64) -> None:
    """Write a table anew in up to ``buckets`` ranges of ``key`` of about as many rows; null keys are in the first one."""
    spark = df.sparkSession
    keys = df.select(F.col(key).cast("string").alias("k")).filter("k is not null").distinct()
    # A sample of a size that only the number of ranges decides.
    sample = sorted(r["k"] for r in keys.orderBy(F.md5("k"), "k").limit(buckets * BORDER_SAMPLE).collect())
    borders = sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if sample else []
    taken = _versions(spark, f"{root}/manifest")
    version = taken[-1][0] + 1 if taken else 1
    _write_ranges(df, root, key, borders, version)
    rows = [(i, start, version, df.schema.json()) for i, start in enumerate([None, *borders])]
    write_snapshot(spark.createDataFrame(rows, MANIFEST).coalesce(1), f"{root}/manifest")


def read_buckets(spark: SparkSession, root: str, only: list[int] | None = None) -> DataFrame:
    """The table as its last load left it, or some of its ranges."""
    ranges = _manifest(spark, root)
    schema = T.StructType.fromJson(json.loads(ranges[0]["schema"]))
    paths = [f"{root}/data/v={r['version']:08d}/_bucket={r['bucket']}" for r in ranges if only is None or r["bucket"] in only]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration())
    held = [p for p in paths if fs.exists(hadoop(p))]  # a range without rows has no folder
    return spark.read.schema(schema).parquet(*held) if held else spark.createDataFrame([], schema)


def merge_buckets(source: DataFrame, root: str, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Load ``source``: ``merge(target, source)`` of the ranges that it has keys of; the others stay as they are.

    Returns the ranges that were written. ``merge`` must keep the keys of its rows, as in ``warehouse.merge_changed``.
    """
    spark = source.sparkSession
    ranges = _manifest(spark, root)
    borders = [r["start"] for r in ranges[1:]]
    source = materialize(source)
    touched = sorted(r["b"] for r in source.select(_range_of(key, borders).alias("b")).distinct().collect())
    if not touched:
        return []
    version = max(v for v, _ in _versions(spark, f"{root}/manifest")) + 1
    _write_ranges(merge(read_buckets(spark, root, touched), source), root, key, borders, version)
    rows = [(r["bucket"], r["start"], version if r["bucket"] in touched else r["version"], r["schema"]) for r in ranges]
    write_snapshot(spark.createDataFrame(rows, MANIFEST).coalesce(1), f"{root}/manifest")
    return touched
