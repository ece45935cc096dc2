"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by the order of its nearest reference points (pivots, a bounded sample of which no two are close).
Its ``PREFIX`` nearest ones are its entries in inverted pivot lists. Two vectors that share a pivot are compared by their
cosine in double precision, in the list of the first pivot that they share, so each pair is met once.

A dense region of different vectors has one pivot, or a few, however many of the rows it holds. They are in the lists of
all its members, so the region is compared in full; its cost is the square of its distinct vectors.

Equal vectors are one class with a weight. A list is cut into blocks; every two blocks of a list meet in a task of their
own, which returns link counts per vector and a spanning forest of what it linked, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.components import components
from ragmill.session import materialize

COSINE = 0.9
#: Pairs that share one pivot are compared. At cosine 0.9 in 64 dimensions fewer than 1 in 10,000 pairs share less than
#: ``SHARED`` of 1,024 spread pivots or fewer: the margin, not a condition.
PREFIX, SHARED = 16, 3
#: No two pivots have this cosine. Inside a region full of pivots the order of the nearest ones would be noise.
CLOSE = 0.7
#: Pivots grow with the root of the number of vectors, within these bounds.
LEAST_PIVOTS, MOST_PIVOTS = 32, 1024
BLOCK, TILE = 4096, 1024


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; neither huge nor tiny components overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector) -> F.Column:
    """Not null, not all zero, no null or non-finite component."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(array), -1)


def choose_pivots(vectors: DataFrame, n: int) -> dict[int, np.ndarray]:
    """dimensions -> unit pivots: a hash sample of bounded size, thinned. Dimensions without one have no index."""
    want = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, math.sqrt(max(n, 1)))))
    share = min(1.0, 4.0 * want / max(n, 1))
    rows = (
        vectors.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_003)) < int(1_000_003 * share) + 1)
        .orderBy(F.xxhash64("id", F.lit(5))).limit(4 * want).select("vector").toArrow()
    )
    by_size: dict[int, list] = {}
    for v in rows["vector"].to_pylist():
        by_size.setdefault(len(v), []).append(v)
    return {d: spread_pivots(unit_rows(np.array(v, np.float64)), want) for d, v in by_size.items()}


def spread_pivots(sample: np.ndarray, want: int) -> np.ndarray:
    """The first ``want`` rows that are not ``CLOSE`` to an earlier one, those with most of the sample near them first.

    Pairs of a dense region meet in the list of its own pivot then, and blocks of other lists that hold only such pairs
    are passed over.
    """
    open_rows = np.ones(len(sample), bool)
    chosen: list[int] = []
    while len(chosen) < want and open_rows.any():
        chosen.append(int(np.argmax(open_rows)))
        open_rows &= sample @ sample[chosen[-1]] < CLOSE
        open_rows[chosen[-1]] = False
    pivots = sample[chosen]
    near = np.bincount(nearest_pivots(sample, pivots, 1)[:, 0], minlength=len(pivots))
    return pivots[np.argsort(-near, kind="stable")]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """(rows, prefix) numbers of the nearest pivots, nearest first."""
    score = x @ pivots.T
    return np.argsort(-score, axis=1, kind="stable")[:, :prefix]


def index_entries(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(id, weight, vector, dims, pivots, mark): each vector's pivots in order, and their bitmap."""

    def run(batches):
        for batch in batches:
            rows = batch.column("vector")
            sizes = rows.value_lengths().to_numpy()
            order: list = [None] * batch.num_rows
            marks: list = [None] * batch.num_rows
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                known = pivots.get(int(d))
                if known is None:
                    near = np.zeros((len(at), 1), np.int64)
                else:
                    near = nearest_pivots(unit_rows(_matrix(rows.take(pa.array(at)))), known)
                bits = np.zeros((len(at), 64 * -(-(1 if known is None else len(known)) // 64)), bool)
                np.put_along_axis(bits, near, True, axis=1)
                packed = np.packbits(bits, axis=1, bitorder="little")
                for i, a in enumerate(at):
                    order[a], marks[a] = near[i].tolist(), packed[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("weight"), rows, pa.array(sizes.astype(np.int32)), pa.array(order, pa.list_(pa.int32())), pa.array(marks, pa.binary())],
                ["id", "weight", "vector", "dims", "pivots", "mark"],
            )

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.select("id", "weight", "vector").mapInArrow(
        run, f"id long, weight long, vector {kind}, dims int, pivots array<int>, mark binary"
    )


def _find(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _compare(table: pa.Table, cosine: float) -> pa.Table:
    """One pair of blocks of one pivot list: (a, b, links). Rows with b are forest links; others count links of a."""
    bits = np.frombuffer(b"".join(table["mark"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
    # Rows with the same first pivot stand together, so that whole tiles are met in an earlier list.
    order = np.argsort(np.unpackbits(bits, axis=1, bitorder="little").argmax(axis=1), kind="stable")
    table, marks = table.take(pa.array(order)), np.ascontiguousarray(bits[order]).view(np.uint64)
    ids, weight = table["id"].to_numpy(), table["weight"].to_numpy()
    x = unit_rows(_matrix(table["vector"]))
    pivot, i, j = (table[c][0].as_py() for c in ("pivot", "i", "j"))
    own = table["own"].to_numpy()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    word, bit = divmod(pivot, 64)
    low = marks[:, : word + 1].copy()
    low[:, word] &= np.uint64((1 << bit) - 1)
    links = np.zeros(len(ids), np.int64)
    parent: dict[int, int] = {}
    forest: list[tuple[int, int]] = []
    for s in range(0, len(left), TILE):
        a = left[s : s + TILE]
        for t in range(s if i == j else 0, len(right), TILE):
            b = right[t : t + TILE]
            if (np.bitwise_and.reduce(low[a]) & np.bitwise_and.reduce(low[b])).any():
                continue
            hit = x[a] @ x[b].T >= cosine
            if i == j:
                hit &= a[:, None] < b[None, :]
            p, q = np.nonzero(hit)
            p, q = a[p], b[q]
            first = ~(low[p] & low[q]).any(axis=1)
            p, q = p[first], q[first]
            np.add.at(links, p, weight[q])
            np.add.at(links, q, weight[p])
            for u, v in zip(p.tolist(), q.tolist(), strict=True):
                ru, rv = _find(parent, u), _find(parent, v)
                if ru != rv:
                    parent[ru] = rv
                    forest.append((u, v))
    some = np.flatnonzero(links)
    u = np.array([f[0] for f in forest], np.int64)
    v = np.array([f[1] for f in forest], np.int64)
    return pa.table(
        {
            "a": pa.array(np.concatenate([ids[some], ids[u]])),
            "b": pa.array([None] * len(some) + ids[v].tolist(), pa.int64()),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(u), np.int64)])),
        }
    )


def near_vectors(rows: DataFrame, cosine: float = COSINE, prefix: int = PREFIX) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``rows`` (vec_id, embedding; nothing else is looked at).

    Vectors that are null, zero or hold null or non-finite components link with nothing, and so do rows with a null id
    (their component is null, and they are kept). Only vectors of as many dimensions link. Equal vectors link with each
    other. An empty table gives no rows.
    """
    vector = F.col("embedding")
    good = rows.filter("vec_id is not null").filter(usable(vector)).select(
        "vec_id", F.col("embedding").alias("vector"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")
    )
    classes = materialize(
        good.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.min("vector").alias("vector"))
    )
    members = good.select("vec_id", "h1", "h2").join(classes.select("h1", "h2", "id", "weight"), ["h1", "h2"])
    n = classes.count()
    entries = materialize(index_entries(classes, choose_pivots(classes, n)))
    listed = entries.select("id", "weight", "vector", "mark", "dims", F.explode("pivots").alias("pivot"))
    sizes = entries.select("dims", F.explode("pivots").alias("pivot")).groupBy("dims", "pivot").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    pairs = (
        listed.join(sizes, ["dims", "pivot"]).withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("dims", "pivot", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "weight", "vector", "mark")
    )
    found = materialize(
        pairs.groupBy("dims", "pivot", "i", "j").applyInArrow(
            lambda table: _compare(table, cosine), "a long, b long, links long"
        )
    )
    counts = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("others"))
    near = components(found.filter("b is not null").select("a", "b"))
    linked = (
        members.join(counts, F.col("id") == F.col("a"), "left").join(near, F.col("id") == F.col("node"), "left")
        .select(
            F.col("vec_id").alias("v"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("links"),
            F.coalesce("component", "id").alias("component"),
        )
        # Rows that repeat an id are one vector more often, or several under one name.
        .groupBy("v").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    )
    return rows.select("vec_id").join(linked, F.col("vec_id") == F.col("v"), "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
