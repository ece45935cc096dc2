"""Retrieval evaluation: relevance, Hit@k, MRR, run comparison, self-retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.text import without_space

def needle_hit(content: Column, needle: Column) -> Column:
    """The needle occurs in the content once all whitespace is gone; empty never hits."""
    a, b = without_space(F.coalesce(content, F.lit(""))), without_space(F.coalesce(needle, F.lit("")))
    return (F.length(a) > 0) & (F.length(b) > 0) & F.contains(a, b)


def needle_relevance(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Ranked hits with a ``relevant`` flag; ``labels`` has (query_id, needle)."""
    flag = needle_hit(F.col("content"), F.col("needle"))
    return hits.join(labels, "query_id").withColumn("relevant", flag).drop("needle")


def first_ranks(hits: DataFrame, labels: DataFrame, keys=("query_id",)) -> DataFrame:
    """First relevant rank per labelled query over the whole pool; null is a miss."""
    first = hits.groupBy(*keys).agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"))
    return labels.select("query_id").distinct().join(first, "query_id", "left")


def rank_metrics(hits: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(query_id, hit_at_1, hit_at_k, reciprocal_rank); the reciprocal rank is not cut at k."""
    r = F.col("first_rank")
    return first_ranks(hits, labels).select(
        "query_id",
        F.coalesce(r <= 1, F.lit(False)).alias("hit_at_1"),
        F.coalesce(r <= k, F.lit(False)).alias("hit_at_k"),
        F.coalesce(F.lit(1.0) / r, F.lit(0.0)).alias("reciprocal_rank"),
    )


def first_relevant_rank(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, first_rank) as text, ``miss`` where nothing relevant came."""
    return first_ranks(hits, labels).select(
        "query_id", F.coalesce(F.col("first_rank").cast("string"), F.lit("miss")).alias("first_rank")
    )


def compare_runs(runs: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """One row per run: hits, percentages, MRR, and the difference to run ``base``.

    ``runs`` has (run, query_id, rank, relevant); the divisor is the number of labels, or 1.
    """
    total = labels.agg(F.greatest(F.count_distinct("query_id"), F.lit(1)).alias("n")).scalar()
    first = runs.groupBy("run", "query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("r"))
    first = first.join(labels.select("query_id").distinct(), "query_id", "left_semi")
    sums = first.groupBy("run").agg(
        F.count_if(F.col("r") <= 1).alias("hit_at_1"),
        F.count_if(F.col("r") <= k).alias("hit_at_k"),
        F.coalesce(F.sum(F.lit(1.0) / F.col("r")), F.lit(0.0)).alias("rr"),
    )
    rates = sums.withColumn("n", total).select(
        "run", "hit_at_1", "hit_at_k",
        (100.0 * F.col("hit_at_1") / F.col("n")).alias("pct_at_1"),
        (100.0 * F.col("hit_at_k") / F.col("n")).alias("pct_at_k"),
        (F.col("rr") / F.col("n")).alias("mrr"),
    )
    # One row per run is left here, so this window sees as many rows as there are runs.
    runs_window = Window.partitionBy(F.lit(0))
    base = lambda c: F.max(F.when(F.col("run") == "base", F.col(c))).over(runs_window)
    return rates.select(
        "run", "hit_at_1", "hit_at_k", "pct_at_1", "pct_at_k", "mrr",
        (F.col("hit_at_1") - base("hit_at_1")).alias("delta_at_1"),
        (F.col("hit_at_k") - base("hit_at_k")).alias("delta_at_k"),
        (F.col("mrr") - base("mrr")).alias("delta_mrr"),
    )


def self_hits(hits: DataFrame) -> DataFrame:
    """A sampled row searched by its own text is relevant when it returns itself."""
    return hits.withColumn("relevant", F.col("id") == F.col("query_id"))


def summary(metrics: DataFrame) -> DataFrame:
    """(queries, hit_at_1, hit_at_k, mrr) averages; 0 for no queries."""
    mean = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return metrics.agg(
        F.count(F.lit(1)).alias("queries"),
        mean("hit_at_1").alias("hit_at_1"),
        mean("hit_at_k").alias("hit_at_k"),
        mean("reciprocal_rank").alias("mrr"),
    )


def mean_reciprocal_rank(ranks: DataFrame) -> DataFrame:
    """Mean of 1/rank over queries; an absent target counts 0."""
    part = F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))
    return ranks.agg(F.coalesce(F.avg(part), F.lit(0.0)).alias("mrr"))
