"""Hybrid retrieval: exact vector and 2-gram top-k, fusion, rerank, hydration."""

from __future__ import annotations

from functools import partial
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.text import WS, neutralize_markers
from ragmill.operators.topk import QUERY_BLOCK_ROWS, SCOPE_ANY, GramIndex, VectorBlock, batch_topk
from ragmill.session import materialize

RRF_K = 60
TOP_M = 10
FETCH_K = 20
MIN_SIMILARITY = 0.2
NOT_BLANK = f"[^{WS[1:]}"


def _owner_scope(owner: Column) -> Column:
    return F.concat(F.lit("o\x1f"), owner.cast("string"))


def _collection_scope(owner: Column, collection: Column) -> Column:
    return F.concat(F.lit("c\x1f"), owner.cast("string"), F.lit("\x1f"), collection.cast("string"))


def _vector_side(df: DataFrame, *scopes: Column, id_col: str, name: str) -> DataFrame:
    cols = [F.col(id_col).alias(name), *scopes, F.col("embedding").cast("array<double>").alias("payload")]
    return df.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(*cols)


def _text_side(df: DataFrame, *scopes: Column, id_col: str, name: str) -> DataFrame:
    return df.filter(F.col("text").rlike(NOT_BLANK)).select(F.col(id_col).alias(name), *scopes, F.col("text").alias("payload"))


def _any() -> Column:
    return F.lit(SCOPE_ANY).alias("scope")


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """Cosine top-k of (query_id, embedding) over (id, embedding); ties by id."""
    return batch_topk(
        _vector_side(queries, _any(), id_col="query_id", name="query_id"),
        _vector_side(corpus, id_col=id_col, name="id"),
        k,
        VectorBlock,
    )


def bigram_topk(
    queries: DataFrame, corpus: DataFrame, k: int, min_sim: float = MIN_SIMILARITY, id_col: str = "id"
) -> DataFrame:
    """2-gram similarity top-k of (query_id, text) over (id, text); blank queries find nothing."""
    return batch_topk(
        _text_side(queries, _any(), id_col="query_id", name="query_id"),
        _text_side(corpus, id_col=id_col, name="id"),
        k,
        partial(GramIndex, min_sim=min_sim),
    )


def _scoped_queries(queries: DataFrame) -> DataFrame:
    """One row per query and scope: the owner, or each of the owner's named collections."""
    named = F.size(F.coalesce("collections", F.array())) > 0
    scopes = F.when(
        named,
        F.transform(F.array_distinct("collections"), lambda c: _collection_scope(F.col("owner"), c)),
    ).otherwise(F.array(_owner_scope(F.col("owner"))))
    return queries.withColumn("scope", F.explode(scopes))


def _corpus_scopes() -> list[Column]:
    return [
        _owner_scope(F.col("owner")).alias("scope_0"),
        _collection_scope(F.col("owner"), F.col("collection")).alias("scope_1"),
    ]


def vector_topk_scoped(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """Vector top-k inside each query's owner and, where given, its collections.

    Scope is applied before ranking, so a query gets k rows whenever its scope has k.
    """
    return batch_topk(
        _vector_side(_scoped_queries(queries), F.col("scope"), id_col="query_id", name="query_id"),
        _vector_side(corpus, *_corpus_scopes(), id_col=id_col, name="id"),
        k,
        VectorBlock,
        n_scopes=2,
    )


def search_chunks(queries: DataFrame, root: str, k: int, buckets: int = 32) -> DataFrame:
    """``vector_topk_scoped`` over chunks stored by ``snapshots.write_chunks`` under ``root``.

    Only folders of the queries' owners are listed and read, and their rows stay where they are read.
    """
    spark = queries.sparkSession
    # As many numbers as there are folders at most.
    bucket = F.pmod(F.xxhash64(F.col("owner").cast("string")), F.lit(buckets)).cast("int").alias("b")
    wanted = [r["b"] for r in queries.select(bucket).distinct().collect()]
    rows = spark.read.parquet(root).filter(F.col("owner_bucket").isin(wanted))
    return batch_topk(
        _vector_side(_scoped_queries(queries), F.col("scope"), id_col="query_id", name="query_id"),
        _vector_side(rows, *_corpus_scopes(), id_col="id", name="id"),
        k,
        VectorBlock,
        n_scopes=2,
        pruned=True,
    )


def bigram_topk_scoped(
    queries: DataFrame, corpus: DataFrame, k: int, min_sim: float = MIN_SIMILARITY, id_col: str = "id"
) -> DataFrame:
    return batch_topk(
        _text_side(_scoped_queries(queries), F.col("scope"), id_col="query_id", name="query_id"),
        _text_side(corpus, *_corpus_scopes(), id_col=id_col, name="id"),
        k,
        partial(GramIndex, min_sim=min_sim),
        n_scopes=2,
    )


def search_in_groups(
    queries: DataFrame, groups: DataFrame, index: DataFrame, k: int = 30, include_future: bool = False
) -> DataFrame:
    """Vector top-k inside the groups (law numbers) resolved for each query.

    ``groups`` has (query_id, law_num); ``index`` has (id, law_num, is_future, embedding).
    """
    rows = index if include_future else index.filter(~F.col("is_future"))
    scoped = queries.join(groups.select("query_id", "law_num").distinct(), "query_id")
    return batch_topk(
        _vector_side(scoped, F.col("law_num").cast("string").alias("scope"), id_col="query_id", name="query_id"),
        _vector_side(rows, F.col("law_num").cast("string").alias("scope_0"), id_col="id", name="id"),
        k,
        VectorBlock,
        n_scopes=1,
    )


def nearest_titles(queries: DataFrame, master: DataFrame, k: int = 5, min_score: float = 0.5) -> DataFrame:
    """Title vector top-k that drops scores below the floor."""
    return vector_topk(queries, master, k).filter(F.col("score") >= min_score)


def rrf(lists: DataFrame, k: int = RRF_K, m: int = TOP_M) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_idx, rank, id).

    Score is the sum of 1/(k+rank); ties keep the first appearance, list by list.
    """
    fused = lists.groupBy("query_id", "id").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"),
        F.min(F.struct("list_idx", "rank")).alias("seen"),
    )
    # Rounded for comparing only: sums of equal parts may differ in the last bit.
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "seen")
    return (
        fused.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= m)
        .select("query_id", "rank", "id", "score")
    )


def fuse(*lists: DataFrame, k: int = RRF_K, m: int = TOP_M) -> DataFrame:
    """RRF of ranked (query_id, rank, id) results in list order."""
    tagged = [df.select("query_id", F.lit(i).alias("list_idx"), "rank", "id") for i, df in enumerate(lists)]
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df)
    return rrf(union, k, m)


def hydrate(hits: DataFrame, chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Attach chunk text and document title; ids without a chunk drop out, rank stays."""
    out = hits.join(chunks, "id")
    return out if documents is None else out.join(documents, "document_id")


def rerank(hits: DataFrame, scores: DataFrame, m: int, keep_unscored: bool = False) -> DataFrame:
    """Reorder ranked hits by (query_id, id, rerank_score).

    Scores of unknown ids are dropped and a repeated id keeps its best score.
    ``keep_unscored`` leaves hits without a score at the tail; otherwise they go,
    unless nothing of the query was scored, where the fused order stays.
    """
    best = scores.groupBy("query_id", "id").agg(F.max("rerank_score").alias("rerank_score"))
    joined = hits.join(best, ["query_id", "id"], "left")
    if not keep_unscored:
        whole = Window.partitionBy("query_id")
        scored = F.count("rerank_score").over(whole)
        joined = joined.withColumn("_n", scored).filter((F.col("_n") == 0) | F.col("rerank_score").isNotNull())
        joined = joined.drop("_n")
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank")
    return joined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= m)


def hybrid_search(
    queries: DataFrame,
    corpus: DataFrame,
    top_m: int = TOP_M,
    fetch_k: int = FETCH_K,
    min_sim: float = MIN_SIMILARITY,
    k: int = RRF_K,
    candidates: int | None = None,
    scores_of=None,
    scoped: bool = False,
) -> DataFrame:
    """Vector and 2-gram search fused, then optionally reranked.

    ``scores_of(hits)`` returns (query_id, id, rerank_score) for the candidate pool.
    """
    pool = top_m if scores_of is None else max(candidates or FETCH_K, top_m)
    fetch = max(fetch_k, pool) if scores_of is not None else fetch_k
    by_vector = vector_topk_scoped if scoped else vector_topk
    by_text = bigram_topk_scoped if scoped else bigram_topk
    fused = fuse(by_vector(queries, corpus, fetch), by_text(queries, corpus, fetch, min_sim), k=k, m=pool)
    if scores_of is None:
        return fused
    return rerank(fused, scores_of(fused), top_m)


def title_hybrid(queries: DataFrame, master: DataFrame, k: int = 5) -> DataFrame:
    """Candidates by title text and title vector, fused."""
    return hybrid_search(queries, master, top_m=k)


def validate_scope(requests: DataFrame, collections: DataFrame) -> DataFrame:
    """(request_id, owner, valid): one foreign collection makes the whole request invalid.

    No collections means all of the owner's.
    """
    asked = requests.select("request_id", "owner", F.explode_outer(F.array_distinct("collections")).alias("collection"))
    owned = collections.select("owner", "collection").distinct().withColumn("_owned", F.lit(True))
    return (
        asked.join(owned, ["owner", "collection"], "left")
        .groupBy("request_id", "owner")
        .agg(F.bool_and(F.col("_owned").isNotNull() | F.col("collection").isNull()).alias("valid"))
    )


def reference_rows(hits: DataFrame) -> DataFrame:
    """(query_id, n, title, chunk_index, text, score[, rerank_score]) with n from 1."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    extra = ["rerank_score"] if "rerank_score" in hits.columns else []
    return hits.withColumn("n", n).select("query_id", "n", "title", "chunk_index", "text", "score", *extra)


# The reference section of an answer.
REFERENCE_SECTION = "\n\n---\n### 参考情報\n"


def context_text(hits: DataFrame) -> DataFrame:
    """(query_id, context, references): numbered excerpts and the source list.

    ``hits`` has (query_id, rank, title, header_path, text) and at most k rows per query.
    """
    head = F.when(
        F.length(F.coalesce("header_path", F.lit(""))) > 0, F.concat_ws(" / ", "title", "header_path")
    ).otherwise(F.col("title"))
    row = F.struct("rank", head.alias("head"), F.col("text").alias("body"))
    ranked = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    number = F.concat(F.lit("["), F.lit(""))

    def excerpt(r: Column, i: Column) -> Column:
        return F.concat(
            number, (i + 1).cast("string"), F.lit("] ("), neutralize_markers(r["head"]), F.lit(")\n"),
            neutralize_markers(r["body"]),
        )

    def item(r: Column, i: Column) -> Column:
        return F.concat((i + 1).cast("string"), F.lit(". "), r["head"])

    return ranked.select(
        "query_id",
        F.array_join(F.transform("rows", excerpt), "\n\n").alias("context"),
        F.concat(F.lit(REFERENCE_SECTION), F.array_join(F.transform("rows", item), "\n")).alias("references"),
    )


def articles_of_laws(index: DataFrame, laws: DataFrame, include_future: bool = False) -> DataFrame:
    """All articles of the given law numbers."""
    rows = index if include_future else index.filter(~F.col("is_future"))
    return rows.join(laws.select("law_num").distinct(), "law_num", "left_semi")


def articles_by_key(index: DataFrame, keys: DataFrame, include_future: bool = False) -> DataFrame:
    """Full text by (law_num, unique_anchor)."""
    rows = index if include_future else index.filter(~F.col("is_future"))
    return rows.join(keys.select("law_num", "unique_anchor").distinct(), ["law_num", "unique_anchor"], "left_semi")


#: Broad words are a handful of constants that every request left empty is given.
MAX_BROAD = 100


#: Unit vectors whose cosine is 1 at the decimals that scores are compared at (``TIE_DECIMALS``) are at most 3.2e-5 apart.
APART = 4e-5
#: Width of the cells in which they are looked for, along so many directions.
CELL_WIDTH, DIRECTIONS = 1e-3, 4


def _near_cells(apart: float):
    """The cells of a vector's direction, and of all directions that are at most ``apart`` from it; none of a zero vector."""

    @F.pandas_udf("array<string>")
    def cells(vectors: pd.Series) -> pd.Series:
        out, made = [], {}
        for vector in vectors:
            vector = np.where(np.isfinite(vector), vector, 0.0)
            norm = np.sqrt((vector * vector).sum())
            if len(vector) not in made:
                axes = np.random.default_rng(0).normal(size=(DIRECTIONS, len(vector)))
                made[len(vector)] = axes / np.sqrt((axes * axes).sum(axis=1, keepdims=True))
            along = made[len(vector)] @ vector / norm if norm > 0 else None
            if along is None or not np.isfinite(along).all():
                out.append([])
                continue
            low, high = (np.floor((along + d) / CELL_WIDTH).astype(int).tolist() for d in (-apart, apart))
            out.append(["_".join(map(str, c)) for c in product(*(range(a, b + 1) for a, b in zip(low, high)))])
        return pd.Series(out, dtype=object)

    return cells


def _nearest_one(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``vector_topk`` with k 1, for query ids that are distinct and not null.

    No score is above 1, so a query with rows of its own direction has its nearest among these. They are found by cells, and
    only the other queries are searched in the whole corpus.
    """
    if queries.limit(QUERY_BLOCK_ROWS + 1).count() <= QUERY_BLOCK_ROWS:
        return vector_topk(queries, corpus, 1)
    asked = _vector_side(queries, id_col="query_id", name="query_id").withColumn("scope", F.explode(_near_cells(APART)("payload")))
    rows = _vector_side(corpus, id_col="id", name="id").withColumn("scope_0", F.get(_near_cells(0.0)("payload"), 0))
    same = materialize(batch_topk(asked, rows, 1, VectorBlock, n_scopes=1).filter("score >= 1"))
    rest = materialize(queries.join(same.select("query_id"), "query_id", "left_anti"))
    return same.unionByName(vector_topk(rest, corpus, 1))


def nearest_law_per_name(names: DataFrame, master: DataFrame, broad: DataFrame | None = None) -> DataFrame:
    """(query_id, name, id, score): nearest title per name without a floor; ``broad`` names serve requests left empty.

    ``names`` has (query_id, name, embedding), ``broad`` has (name, embedding). A name without a vector finds nothing.
    """
    # Rows get numbers, so that ids and names may be of any type and hold any character.
    rows = materialize(names.select("query_id", "name", "embedding", F.monotonically_increasing_id().alias("row")))
    near = _nearest_one(rows.select(F.col("row").alias("query_id"), "embedding"), master)
    found = near.select(F.col("query_id").alias("row"), "id", "score").join(rows, "row").select("query_id", "name", "id", "score")
    if broad is None:
        return found
    found = materialize(found)
    words = broad.limit(MAX_BROAD + 1).select("name", "embedding", F.monotonically_increasing_id().alias("row"))
    words = materialize(words)
    if words.count() > MAX_BROAD:
        raise ValueError(f"more than {MAX_BROAD} broad names")
    near = vector_topk(words.select(F.col("row").alias("query_id"), "embedding"), master, 1)
    spare = near.select(F.col("query_id").alias("row"), "id", "score").join(words.select("row", "name"), "row").drop("row")
    empty = rows.select("query_id").distinct().join(found.select("query_id"), "query_id", "left_anti")
    every = empty.withColumn("_one", F.lit(1)).join(F.broadcast(spare.withColumn("_one", F.lit(1))), "_one")
    return found.unionByName(every.select("query_id", "name", "id", "score"))
