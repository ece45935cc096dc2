"""Reading the given Parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL over the tables it names; ``{table}`` marks a table or a given frame."""
    names = set(re.findall(r"\{(\w+)\}", text)) - set(frames)
    inputs = {n: table(spark, sf_dir, n) for n in names} | frames
    return spark.sql(text, **inputs)
