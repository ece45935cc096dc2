"""Raw files as rows, and the rule that an original is taken in once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def describe(files: DataFrame) -> DataFrame:
    """(owner, object_key, filename, byte_size, sha256, content) of (object_key, content)."""
    parts = F.split("object_key", "/")
    return files.select(
        parts[0].alias("owner"),
        "object_key",
        F.element_at(parts, -1).alias("filename"),
        F.octet_length("content").alias("byte_size"),
        F.sha2("content", 256).alias("sha256"),
        "content",
    )


def bronze_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root``; the key is the path under it and starts with the owner."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    marker = "/" + root.rstrip("/").split("/")[-1] + "/"
    key = F.substring_index(F.col("path"), marker, -1)
    return describe(files.select(key.alias("object_key"), "content"))


def reject_duplicate_bronze(new: DataFrame, existing: DataFrame, first: str = "arrived") -> DataFrame:
    """New rows whose (owner, object_key) is unknown, the first of each key in the batch.

    Copies of a key fold on the map side; the anti join meets one row per key.
    """
    keys = ["owner", "object_key"]
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), first).alias("r")).select(*keys, "r.*")
    return one.join(existing.select(*keys).distinct(), keys, "left_anti").select(*new.columns)
