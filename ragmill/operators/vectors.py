"""Approximate nearest neighbours by inverted cells, and its recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragmill.operators.topk import VectorBlock, batch_topk
from ragmill.session import materialize

#: Cell centres are broadcast, so their number is bounded.
MAX_CELLS = 16_384
#: A cell with more rows than so many times the mean is split.
CROWDED = 2


def clean_vector(col: Column) -> Column:
    """Non-finite elements become 0."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    return F.transform(col, lambda x: F.when(bad(x), F.lit(0.0).cast("float")).otherwise(x))


#: Keys a task holds before it hands its partial sums on.
PARTIAL_KEYS = 50_000


def mean_vectors(df: DataFrame, key: str) -> DataFrame:
    """Mean vector per key: tasks sum in numpy, so only partial sums are shuffled."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = _stack(batch.column("embedding").to_pandas())
            # A null key is a key of its own, as in a grouping.
            coded = batch.column(key).dictionary_encode(null_encoding="encode")
            codes, keys = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            total = np.zeros((len(keys), matrix.shape[1]))
            np.add.at(total, codes, matrix)
            for name, vector, n in zip(keys, total, np.bincount(codes, minlength=len(keys))):
                old = held.get(name)
                held[name] = (vector, n) if old is None else (old[0] + vector, old[1] + n)
            if len(held) > PARTIAL_KEYS:
                yield partials(held, coded.dictionary.type)
                held = {}
        if held:  # a split of a file may have no rows
            yield partials(held, coded.dictionary.type)

    def partials(held: dict, kind: pa.DataType) -> pa.RecordBatch:
        total = pa.array([v for v, _ in held.values()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), kind), total, pa.array([n for _, n in held.values()], pa.int64())], names=[key, "total", "n"]
        )

    key_type = df.schema[key].dataType.simpleString()
    rows = df.filter(F.col("embedding").isNotNull()).select(key, "embedding")
    partial = rows.mapInArrow(sums, f"`{key}` {key_type}, total array<double>, n bigint")
    each = partial.select(key, F.posexplode("total").alias("pos", "x"), "n")
    means = each.groupBy(key, "pos").agg((F.sum("x") / F.sum("n")).alias("m"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(key).agg(F.transform(ordered, lambda r: r["m"]).alias("embedding"))


def md5_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """A deterministic pseudo-random sample: the n smallest md5(keys)."""
    digest = F.md5(F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(digest, *keys).limit(n)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def _stack(column: pd.Series) -> np.ndarray:
    vectors = np.stack(column.to_numpy()).astype(np.float64)
    return np.where(np.isfinite(vectors), vectors, 0.0)


def _mean_step(vectors: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres moved to the mean of their rows, and the rows of each; cells x dim sums leave a task."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            if len(batch):
                unit = _unit(_stack(batch["embedding"]))
                cell = np.argmax(unit @ shared.value.T, axis=1)
                np.add.at(total, cell, unit)
                n += np.bincount(cell, minlength=len(n))
        used = np.nonzero(n)[0]
        if len(used):  # a split of a file may have no rows
            yield pd.DataFrame({"cell": used, "n": n[used], "total": list(total[used])})

    partial = vectors.mapInPandas(sums, "cell int, n long, total array<double>")
    dim = centres.shape[1]
    new = partial.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dim)]).toPandas()
    sizes, moved = np.zeros(len(centres), np.int64), centres.copy()
    if len(new):
        at = new["cell"].to_numpy()
        sizes[at] = new["n"].to_numpy()
        moved[at] = _unit(new.drop(columns=["cell", "n"]).to_numpy(dtype=np.float64))
    return moved, sizes


def _split(vectors: DataFrame, centres: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """More centres for cells of more than ``CROWDED`` times the mean, out of a sample of their own rows."""
    mean = max(1.0, sizes.sum() / max(1, np.count_nonzero(sizes)))
    more = {int(c): int(np.ceil(sizes[c] / mean)) - 1 for c in np.flatnonzero(sizes > CROWDED * mean)}
    if not more or len(centres) + sum(more.values()) > MAX_CELLS:
        return centres
    one = _nearest_cells(vectors.sparkSession, centres, 1)
    wanted = F.create_map(*[F.lit(x) for c, n in more.items() for x in (str(c), n)])
    rows = vectors.withColumn("cell", one("embedding")[0]).withColumn("wanted", wanted[F.col("cell")]).filter("wanted is not null")
    nth = F.row_number().over(Window.partitionBy("cell").orderBy(F.md5(F.col("id").cast("string")), "id"))
    found = rows.withColumn("nth", nth).filter(F.col("nth") <= max(more.values())).filter("nth <= wanted").toPandas()
    return np.concatenate([centres, _unit(_stack(found["embedding"]))]) if len(found) else centres


def cell_centres(corpus: DataFrame, cells: int, rounds: int = 2) -> np.ndarray:
    """Centres from a sample, improved by a few mean steps over the whole corpus; crowded cells are split once more.

    ``cells`` is what the sample starts with, so there may be more centres; a search that asks for all ``cells`` takes them
    all (``_probes``). Only cells x dim sums leave each task, and cells is bounded.
    """
    if cells > MAX_CELLS:
        raise ValueError(f"at most {MAX_CELLS} cells")
    vectors = corpus.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    centres = _unit(_stack(md5_sample(vectors, ["id"], cells).toPandas()["embedding"]))
    for step in range(rounds):
        centres, sizes = _mean_step(vectors, centres)
        if step == 0 and rounds > 1:
            centres = _split(vectors, centres, sizes)
    return centres


def _probes(probes: int, cells: int, centres: int) -> int:
    """Cells to look into: all there are where all that were asked for are, as crowded ones were split into more."""
    return max(probes, centres) if probes >= cells else probes


def _nearest_cells(spark, centres: np.ndarray, n: int):
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cells(vectors: pd.Series) -> pd.Series:
        scores = _unit(_stack(vectors)) @ shared.value.T
        order = np.argsort(-scores, axis=1, kind="stable")[:, :n]
        return pd.Series(list(order.astype(str)))

    return cells


def _placed(corpus: DataFrame, centres: np.ndarray, spill: int = 1) -> DataFrame:
    """(id, cell, home, payload): every row in its ``spill`` best cells; ``home`` marks the best."""
    near = _nearest_cells(corpus.sparkSession, centres, spill)
    rows = corpus.filter(F.col("embedding").isNotNull()).select(
        "id", near("embedding").alias("cells"), F.col("embedding").cast("array<double>").alias("payload")
    )
    return rows.select("id", F.posexplode("cells").alias("place", "cell"), "payload").select(
        "id", "cell", (F.col("place") == 0).alias("home"), "payload"
    )


def _angles(spark, centres: np.ndarray):
    """The angle between a row and the centre of its cell."""
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("double")
    def angle(vectors: pd.Series, cell: pd.Series) -> pd.Series:
        own = shared.value[cell.astype(int).to_numpy()]
        return pd.Series(np.arccos(np.clip((_unit(_stack(vectors)) * own).sum(axis=1), -1, 1)))

    return angle


def build_cells(corpus: DataFrame, root: str, cells: int = 16, rounds: int = 2, spill: int = 2) -> None:
    """Store (id, embedding) by cell under ``root``, and the centres: made once, searched many times.

    A row lies in its ``spill`` best cells, so that neighbours on both sides of a border are found in one cell. Each
    cell is stored with its rows and its radius, the largest angle between its centre and a row that has its home there.
    """
    spark = corpus.sparkSession
    centres = cell_centres(corpus, cells, rounds)
    _placed(corpus, centres, min(spill, len(centres))).write.partitionBy("cell").parquet(f"{root}/vectors")
    stored = spark.read.parquet(f"{root}/vectors").withColumn("cell", F.col("cell").cast("string"))
    size = stored.groupBy("cell").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("home"), _angles(spark, centres)("payload", "cell"))).alias("radius")
    )
    rows = [(str(i), [float(x) for x in c], cells) for i, c in enumerate(centres)]
    known = spark.createDataFrame(rows, "cell string, centre array<double>, asked int").join(size, "cell", "left")
    known.select(F.col("cell").cast("int"), "centre", F.coalesce("n", F.lit(0)).alias("n"), "radius", "asked").coalesce(1).write.parquet(f"{root}/centres")


def _cell_order(queries: DataFrame, centres: pd.DataFrame) -> DataFrame:
    """(query_id, payload, cells): all cells by the best score that a row at home there can have, then by their centre's."""
    unit, radius = _unit(_stack(centres["centre"])), centres["radius"].fillna(-4.0).to_numpy()
    shared = queries.sparkSession.sparkContext.broadcast((unit, radius))

    @F.pandas_udf("array<struct<cell:string,bound:double>>")
    def cells(vectors: pd.Series) -> pd.Series:
        unit, radius = shared.value
        scores = _unit(_stack(vectors)) @ unit.T
        apart = np.arccos(np.clip(scores, -1, 1)) - radius
        bound = np.where(radius < -3, -2.0, np.cos(np.maximum(apart, 0.0)))
        order = np.argsort(-scores, axis=1, kind="stable")
        return pd.Series([[{"cell": str(c), "bound": float(b[c])} for c in row] for row, b in zip(order, bound, strict=True)])

    return queries.select("query_id", F.col("embedding").cast("array<double>").alias("payload"), cells("embedding").alias("cells"))


def search_cells(queries: DataFrame, root: str, k: int, probes: int = 4, by_bound: bool = False) -> DataFrame:
    """Approximate cosine top-k over stored cells; cells that no query looks into are not read.

    A query looks into the ``probes`` cells of the nearest centres, and into every cell where ``probes`` is the number that
    the cells were built with. With ``by_bound`` it goes on with those whose rows can still reach its k-th score, which makes
    the result exact; where rows lie in clusters these are few.
    """
    return cells_read(queries, root, k, probes, by_bound)[0]


def cells_read(queries: DataFrame, root: str, k: int, probes: int, by_bound: bool = False) -> tuple[DataFrame, DataFrame]:
    """``search_cells``, and (query_id, cell, n): the cells that were read with their rows."""
    spark = queries.sparkSession
    centres = spark.read.parquet(f"{root}/centres").orderBy("cell").toPandas()
    # Cells stored before they told what was asked for have as many as that, or more.
    probes = _probes(probes, int(centres["asked"].max()) if "asked" in centres else len(centres), len(centres))
    vectors = spark.read.parquet(f"{root}/vectors")
    ordered = materialize(_cell_order(queries, centres))

    def searched(asked: DataFrame) -> DataFrame:
        # As many values as there are cells at most.
        probed = [r["scope"] for r in asked.select("scope").distinct().collect()]
        rows = vectors.filter(F.col("cell").cast("string").isin(probed))
        return batch_topk(asked, rows.select("id", F.col("cell").cast("string").alias("scope_0"), "payload"), k, VectorBlock, n_scopes=1)

    first = ordered.select("query_id", "payload", F.explode(F.transform(F.slice("cells", 1, probes), lambda c: c["cell"])).alias("scope"))
    found, asked = searched(first), first.select("query_id", "scope")
    if by_bound:
        found = materialize(found)
        floors = found.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        rest = ordered.join(floors, "query_id", "left").select(
            "query_id", "payload", F.explode(F.slice("cells", probes + 1, max(1, len(centres)))).alias("c"), "floor"
        )
        # A hair below, as scores are compared at some decimals.
        more = rest.filter(F.col("floor").isNull() | (F.col("c.bound") >= F.col("floor") - 1e-7)).select("query_id", "payload", F.col("c.cell").alias("scope"))
        both = found.unionByName(searched(materialize(more))).groupBy("query_id", "id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        found = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
        asked = asked.unionByName(more.select("query_id", "scope"))
    sizes = spark.read.parquet(f"{root}/centres").select(F.col("cell").cast("string").alias("cell"), "n")
    return found, asked.withColumnRenamed("scope", "cell").join(sizes, "cell")


def ann_topk(queries: DataFrame, corpus: DataFrame, k: int, cells: int = 16, probes: int = 4) -> DataFrame:
    """Approximate cosine top-k: each query looks only into its nearest cells.

    With as many probes as cells it is exact. For one search of a corpus; ``build_cells`` and ``search_cells`` keep the cells.
    """
    centres = cell_centres(corpus, cells)
    many = _nearest_cells(corpus.sparkSession, centres, _probes(probes, cells, len(centres)))
    vec = F.col("embedding").cast("array<double>")
    asked = queries.select("query_id", F.explode(many("embedding")).alias("scope"), vec.alias("payload"))
    placed = _placed(corpus, centres).select("id", F.col("cell").alias("scope_0"), "payload")
    return batch_topk(asked, placed, k, VectorBlock, n_scopes=1)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact top-k that the approximate search found: (queries, expected, found, recall)."""
    hit = approx.select(F.col("query_id").alias("_query"), F.col("id").alias("_id"), F.lit(1).alias("_hit"))
    # The query without an id has neighbours too.
    same = F.col("query_id").eqNullSafe(F.col("_query")) & (F.col("id") == F.col("_id"))
    joined = exact.select("query_id", "id").join(hit, same, "left")
    return joined.agg(
        F.count_distinct("query_id").alias("queries"),
        F.count(F.lit(1)).alias("expected"),
        F.count("_hit").alias("found"),
        F.round(F.count("_hit") / F.count(F.lit(1)), 6).alias("recall"),
    )
