"""Exact top-k by inner product with block-at-a-time pruning.

Components become whole numbers. Documents stand in shards; inside a shard they are ordered so that neighbours are alike and
cut into ranges. A block keeps, for each term (component and sign), the largest value of its documents. The sum of a
query's term maxima bounds every score in the block. A query visits blocks from the largest bound down, scores
them through their forward index, and stops once the next bound lies below its k-th score. Bounds equal to it are
still visited, as ties go to the smaller id. A bounded sample of documents gives each query a k-th score to start from.

Queries and shards meet by key: each chunk of queries with each shard, which is the whole of queries x documents in
blocks; only the k best of each meeting come out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, SCALE = 5, 256
SHARD, CHUNK, RANGE = 32_768, 2_048, 128
#: Blocks that a query scores between two looks at its bounds.
STEP = 8
SAMPLE = 1_024


def quantised(vector) -> F.Column:
    """floor(256 x) of every component; exact scores need components below 2**20 or so."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE))


def usable(vector) -> F.Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def _matrix(column, dims: int) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(array), dims)


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """Doubles, where their products and sums are exact whole numbers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return np.float64 if most < 2.0**52 else np.int64


class Blocks:
    """A shard: documents in order, ranges of them, and the term maxima of each range."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        # Neighbours share their strongest components.
        lead = np.argsort(-np.abs(values), axis=1, kind="stable")[:, :2] if values.shape[1] > 1 else np.zeros((len(ids), 2), int)
        sign = np.take_along_axis(values, lead, axis=1) < 0 if values.shape[1] > 1 else lead == 0
        order = np.lexsort((ids, lead[:, 1] * 2 + sign[:, 1], lead[:, 0] * 2 + sign[:, 0]))
        self.ids, self.values = ids[order], values[order]
        starts = np.arange(0, len(ids), RANGE)
        self.high = np.maximum.reduceat(self.values, starts, axis=0).clip(min=0)
        self.low = np.minimum.reduceat(self.values, starts, axis=0).clip(max=0)
        self.count = len(starts)
        pad = self.count * RANGE - len(ids)
        self.padded = np.concatenate([self.values, np.zeros((pad, values.shape[1]), values.dtype)]).reshape(self.count, RANGE, -1)
        self.padded_ids = np.concatenate([self.ids, np.full(pad, -1, np.int64)]).reshape(self.count, RANGE)
        self.real = np.concatenate([np.ones(len(ids), bool), np.zeros(pad, bool)]).reshape(self.count, RANGE)

    def search(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int = K):
        """(query row, id, score) of the best documents of this shard, all that can be among the k best of all."""
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        order = np.argsort(-bounds, axis=1, kind="stable")
        out_q, out_id, out_score = [], [], []
        self.scored = 0
        for q in range(len(ids)):
            best_id, best = np.zeros(0, np.int64), np.zeros(0, queries.dtype)
            kth = floor[q]
            for s in range(0, self.count, STEP):
                at = order[q, s : s + STEP]
                at = at[bounds[q, at] >= kth]
                if not len(at):
                    break
                self.scored += len(at)
                score = (self.padded[at] @ queries[q]).ravel()
                found = self.padded_ids[at].ravel()
                ok = (score >= kth) & self.real[at].ravel() & (found != ids[q])
                best_id, best = np.concatenate([best_id, found[ok]]), np.concatenate([best, score[ok]])
                if len(best) > k:
                    top = np.lexsort((best_id, -best))[:k]
                    best_id, best = best_id[top], best[top]
                if len(best) == k:
                    kth = max(kth, best.min())
            out_q.append(np.full(len(best), q))
            out_id.append(best_id)
            out_score.append(best)
        return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)


def _floors(ids: np.ndarray, queries: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A score that at least k documents of the sample other than the query reach; minus infinity with fewer."""
    low = np.full(len(ids), -np.inf)
    if sample.shape[1:] == queries.shape[1:] and len(sample_ids) > k:
        score = (queries @ sample.T).astype(np.float64)
        score[ids[:, None] == sample_ids[None, :]] = -np.inf
        low = np.partition(score, -k, axis=1)[:, -k]
    return low


def search(docs: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``docs`` (id, value) for each of ``queries`` (id, value).

    Values are arrays of whole numbers; only vectors of as many dimensions meet. A query leaves out documents with its own
    id. Queries that repeat an id count once, with the smallest of their values. Ties go to the smaller id; a document
    that repeats an id counts as often as it stands there. Null ids take no part; empty tables give no rows. Other columns
    are not read, whatever their names are.
    """
    queries = queries.filter("id is not null").groupBy("id").agg(F.min("value").alias("value"))
    n_docs, n_queries = docs.count(), queries.count()
    shards, chunks = max(1, math.ceil(n_docs / SHARD)), max(1, math.ceil(n_queries / CHUNK))
    share = min(1.0, SAMPLE / max(n_docs, 1))
    sample = docs.filter("id is not null").filter(
        F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_003)) < int(1_000_003 * share) + 1
    ).limit(2 * SAMPLE).toArrow()
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sizes = np.array([len(v) for v in sample["value"]], int)
    for d in np.unique(sizes):
        at = pa.array(np.flatnonzero(sizes == d))
        known[int(d)] = (sample["id"].take(at).to_numpy(), _matrix(sample["value"].take(at), int(d)))
    left = docs.filter("id is not null").select(
        "id", "value", F.size("value").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
    )
    right = queries.select(
        "id", "value", F.size("value").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )

    def meet(doc_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        if not doc_rows.num_rows or not query_rows.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        dims = doc_rows["dims"][0].as_py()
        values, asked = _matrix(doc_rows["value"], dims), _matrix(query_rows["value"], dims)
        ids = query_rows["id"].to_numpy()
        kind = _exact(values, asked)
        some_ids, some = known.get(dims, (np.zeros(0, np.int64), np.zeros((0, dims), np.int64)))
        asked = asked.astype(kind)
        blocks = Blocks(doc_rows["id"].to_numpy(), values.astype(kind))
        q, found, score = blocks.search(ids, asked, _floors(ids, asked, some_ids, some.astype(kind), k), k)
        return pa.table({"query_id": ids[q], "vec_id": found, "score": score.astype(np.int64)})

    keys = ["dims", "shard", "chunk"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as value from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id as query_id, value as asked from v where vec_id % 50 = 0),
s as (
  select query_id, vec_id,
         list_sum(list_transform(range(1, len(value) + 1), lambda i: value[i] * asked[i]))::bigint as score
  from q, v where vec_id <> query_id and len(value) = len(asked)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
