"""Attachment budgets and extraction once per content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.operators.ranking import running

# Default limits.
LIMITS = {"max_chars": 5000, "total_chars": 5000, "max_files": 5, "max_images": 3}


def attachment_budget(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """What of each attachment goes into a request: (…, outcome, kept_chars, truncated).

    Rows are (request_id, message, pos, is_image, ok, chars): the newest message comes
    first, then positions in order. ``ok`` tells that a document could be read or an image
    is valid. Documents are counted per message, characters and images per request; a
    document that fails spends nothing.

    What is left for a document is the total minus the capped lengths of the readable,
    counted documents before it, never below 0: running sums instead of a loop.
    """
    top = LIMITS | (limits or {})
    image, ok = F.col("is_image"), F.col("ok")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    numbered = running(
        df, ["request_id", "message"], F.col("pos").cast("bigint"), [], {"_docs": F.when(image, none).otherwise(one)}
    )
    counted = ~image & (F.col("_docs") < top["max_files"])
    capped = F.least(F.col("chars"), F.lit(top["max_chars"])).cast("bigint")
    sums = running(
        numbered, ["request_id"], (-F.col("message")).cast("bigint"), ["pos"],
        {"_spent": F.when(counted & ok, capped).otherwise(none), "_images": F.when(image & ok, one).otherwise(none)},
    )
    left = F.greatest(F.lit(top["total_chars"]) - F.col("_spent"), F.lit(0))
    kept = F.least(capped, left)
    outcome = (
        F.when(image & (F.col("_images") >= top["max_images"]), "skipped_images")
        .when(image, F.when(ok, "image").otherwise("failed"))
        .when(~counted, "skipped_files")
        .when(left <= 0, "skipped_budget")
        .when(~ok, "failed")
        .when(kept == 0, "skipped_budget")
        .otherwise("included")
    )
    done = sums.withColumn("outcome", outcome)
    included = F.col("outcome") == "included"
    return done.select(
        *df.columns, "outcome", F.when(included, kept).alias("kept_chars"),
        F.when(included, kept < F.col("chars")).alias("truncated"),
    )


def once_per_content(df: DataFrame, extract: Callable[[DataFrame], DataFrame], settings: list[str]) -> DataFrame:
    """Run ``extract`` once per distinct (content, settings) and give the result to all copies.

    ``extract`` maps (sha256, content, settings…) to (sha256, settings…, text). A content
    held by many rows folds before extraction; only its hash is joined back.
    """
    keyed = df.withColumn("sha256", F.sha2("content", 256))
    keys = ["sha256", *settings]
    distinct = keyed.groupBy(*keys).agg(F.any_value("content").alias("content"))
    return keyed.drop("content").join(extract(distinct).select(*keys, "text"), keys, "left")
