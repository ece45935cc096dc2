"""Running sums and ranks inside a scope without gathering the scope in one task.

A prefix scan: rows are dealt to ranges by scope, order and ties, so rows of one scope, and even of one order value, are
spread over as many ranges as they ask for. Each task sums along its own range; a range begins in the middle of one scope
at most, so as many starting values as there are ranges put the sums right.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.session import materialize


def _ranges(df: DataFrame) -> int:
    """As many ranges as a shuffle of the session has partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _changes(batch: pa.RecordBatch, places: Sequence[int], last: list | None) -> np.ndarray:
    """Where a row has another scope than the row before it; ``last`` is the scope before the batch."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = last is None
    for n, place in enumerate(places):
        codes = pc.dictionary_encode(batch.column(place), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= np.diff(codes) != 0
        if last is not None:
            new[0] |= batch.column(place)[0].as_py() != last[n]
    return new


def running(
    df: DataFrame,
    scope: Sequence[str],
    order: Column,
    ties: Sequence[str],
    sums: dict[str, Column],
    splits: int | None = None,
) -> DataFrame:
    """Add, per name in ``sums``, the sum of whole numbers over the rows before this one.

    Rows are ordered by ``order`` and ``ties``. They cross the network once, whatever the number of sums. Null counts
    as 0, and null scopes are one scope.
    """
    names, width = list(sums), len(df.columns)
    values = [F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint")).alias(f"_v_{n}") for n, v in sums.items()]
    at = [df.columns.index(c) for c in scope]
    keys = [*[F.col(c) for c in scope], F.col("_order"), *[F.col(c) for c in ties]]
    dealt = (
        df.select("*", *values, order.alias("_order")).repartitionByRange(splits or _ranges(df), *keys).sortWithinPartitions(*keys)
        .drop("_order").withColumn("_range", F.spark_partition_id())
    )

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, [0] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _changes(batch, at, last)
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1  # -1: goes on from the batch before
            columns = batch.columns
            for k in range(len(names)):
                value = batch.column(width + k).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.cumsum(value) - value
                base = np.append(before[starts], -carry[k])  # the last one is for group -1
                local = before - base[group]
                carry[k] = int(local[-1] + value[-1])
                columns = [*columns, pa.array(local)]
            last = [batch.column(p)[batch.num_rows - 1].as_py() for p in at]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *[f"_l_{n}" for n in names]])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema]
    local = materialize(dealt.mapInArrow(along, ", ".join([*fields, *[f"`_l_{n}` bigint" for n in names]])))
    totals = local.groupBy("_range", *scope).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    before = Window.partitionBy(*scope).orderBy("_range")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    # Only a scope that goes on from an earlier range has a starting value, which is one per range at most.
    starts = totals.select(
        F.col("_range").alias("_at"), *[F.col(c).alias(f"_k_{i}") for i, c in enumerate(scope)],
        F.row_number().over(before).alias("_nth"), *[F.sum(f"_s_{n}").over(earlier).alias(f"_s_{n}") for n in names],
    ).filter("_nth > 1")
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(scope):
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{i}"))
    out = local.join(F.broadcast(starts), same, "left")
    return out.select(
        *df.columns, *[(F.col(f"_l_{n}") + F.coalesce(f"_s_{n}", F.lit(0).cast("bigint"))).alias(n) for n in names]
    )


def ranked(df: DataFrame, scope: Sequence[str], order: Column, ties: Sequence[str], splits: int | None = None) -> DataFrame:
    """Add ``rank``, from 1, per scope."""
    out = running(df, scope, order, ties, {"rank": F.lit(1).cast("bigint")}, splits)
    return out.withColumn("rank", F.col("rank") + 1)
