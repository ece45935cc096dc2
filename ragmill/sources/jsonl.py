"""JSON-lines interchange of article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragmill.sources.lawxml import ARTICLE_FIELDS

NULLABLE_TEXT = ("anchor", "article_summary", "era", "law_type")
NAMES = [field.split()[0] for field in ARTICLE_FIELDS.split(", ")]


def _schema(extra: str = "") -> T.StructType:
    # Years and dates arrive as text or number; typing is left to coerce_staging.
    return T.StructType.fromDDL(", ".join(f"{n} string" for n in NAMES) + extra)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line; nulls are written, other scripts stay readable."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines as text columns; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(_schema()).option("mode", "FAILFAST").json(path)


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def coerce_staging(raw: DataFrame) -> DataFrame:
    """Typed staging rows: empty optional text becomes null, year an int, the date a date."""
    typed = {n: empty_to_null(F.col(n)) for n in NULLABLE_TEXT}
    typed["year"] = empty_to_null(F.col("year")).cast("int")
    typed["promulgate_date"] = F.to_date(empty_to_null(F.col("promulgate_date")))
    return raw.select(*[typed.get(n, F.col(n)).alias(n) for n in NAMES])


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines to fields, keeping what does not parse in ``malformed``."""
    kept = lines.filter(F.length(F.trim(F.col(column))) > 0)
    schema = T.StructType([*_schema().fields, T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    return kept.select(F.from_json(column, schema, options).alias("r")).select("r.*").withColumnRenamed("_bad", "malformed")


def profile_lines(parsed: DataFrame) -> DataFrame:
    """(total, laws, anchored, malformed, sample_law_id) of parsed lines."""
    good = F.col("malformed").isNull()
    return parsed.agg(
        F.count_if(good).alias("total"),
        F.count_distinct(F.when(good, F.col("law_id"))).alias("laws"),
        F.count_if(good & (F.length("anchor") > 0)).alias("anchored"),
        F.count_if(~good).alias("malformed"),
        F.min(F.when(good, F.col("law_id"))).alias("sample_law_id"),
    )


def profile_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Profile of a file set; malformed lines are an error unless ``strict`` is off."""
    report = profile_lines(parse_lines(spark.read.text(path)))
    if strict and report.first()["malformed"] > 0:
        raise ValueError(f"malformed lines below {path}")
    return report
