import collections

import numpy as np
import pytest

from ragmill.llm import embeddings, topk
from pyspark.sql import functions as F

ROWS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    out = [(i, v.tolist()) for i, v in enumerate(x)]
    for i in range(300):
        c = rng.uniform(0.87, 0.93)
        a = x[i].astype(float) / np.linalg.norm(x[i])
        z = rng.normal(size=24)
        z -= z @ a * a
        out.append((1000 + i, (5 * (c * a + np.sqrt(1 - c * c) * z / np.linalg.norm(z))).tolist()))
    out += [(2000 + i, (x[3] + 0.1 * rng.normal(size=24)).tolist()) for i in range(150)]
    out += [(3000 + i, x[7].tolist()) for i in range(100)]
    out += [
        (4000, None), (4001, [0.0] * 24), (4002, [1.0, None] + [0.5] * 22), (4003, [float("nan")] * 24), (4004, [float("inf")] * 24),
        (4005, []), (4006, [1e-30] * 24), (4007, [3e30] * 24), (4008, [1.0, 2.0]), (4009, [2.0, 4.0]), (None, x[7].tolist()), (50, x[50].tolist()),
    ]
    return out


def good(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)


def test_near_vectors(spark, vectors):
    table = spark.createDataFrame([(i, v, 0) for i, v in vectors], ROWS).repartition(4)
    got = embeddings.near_vectors(table).collect()
    assert len(got) == len(vectors)
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if i is not None and good(v)]
    links, parent = collections.Counter(), {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if len(a) == len(b) and embeddings.unit_rows(a[None])[0] @ embeddings.unit_rows(b[None])[0] >= 0.9:
                links[i] += 1
                links[j] += 1
                ra, rb = find(i), find(j)
                parent[max(ra, rb)] = min(ra, rb)
    seen = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    for i, _ in vectors:
        if i is None:
            assert seen[i] == (0, None, True)
        elif i != 50:  # the repeated id
            assert seen[i] == (links[i], find(i), i == find(i)), i
    assert seen[50][1] == 50


def test_near_vectors_small_tables(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], ROWS)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.0, 1.0], 1)], ROWS)
    assert sorted(tuple(r) for r in embeddings.near_vectors(one).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    x = embeddings.unit_rows(rng.normal(size=(3000, 64)))
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * embeddings.unit_rows(z)
    pivots = embeddings.unit_rows(rng.normal(size=(embeddings.MOST_PIVOTS, 64)))
    near = [embeddings.nearest_pivots(v, pivots).tolist() for v in (x, y)]
    shared = np.array([len(set(a) & set(b)) for a, b in zip(*near, strict=True)])
    assert (shared >= embeddings.SHARED).mean() > 0.995


def test_hot_group_with_many_pivots(spark, monkeypatch):
    """A third of the rows in one dense group of different vectors: every link, against all pairs."""
    monkeypatch.setattr(embeddings, "LEAST_PIVOTS", 1024)
    rng = np.random.default_rng(9)
    centre, noise = np.eye(64)[:1], rng.normal(size=(1500, 64))
    noise[:, 0] = 0
    x = np.vstack([np.sqrt(0.91) * centre + 0.3 * embeddings.unit_rows(noise), embeddings.unit_rows(rng.normal(size=(3000, 64)))])
    x[4000:] = embeddings.unit_rows(x[3500:4000] + 0.4 * embeddings.unit_rows(rng.normal(size=(500, 64))))
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], ROWS).repartition(4)
    unit = embeddings.unit_rows(x.astype(float))
    pivots = embeddings.choose_pivots(table.selectExpr("vec_id as id", "embedding as vector"), len(x))[64]
    assert len(pivots) == 1024 and (pivots @ pivots.T - 2 * np.eye(len(pivots))).max() < embeddings.CLOSE
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    assert want[:1500].sum() > 1_000_000
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_vectors(table).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()


def query(table):
    rows = table.filter(topk.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("value"))
    return topk.search(rows, rows.filter("id % 50 = 0"))


def test_topk_is_exact(spark, vectors, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 200)
    monkeypatch.setattr(topk, "CHUNK", 4)
    table = spark.createDataFrame([(i, v, 0) for i, v in vectors if i != 50 and i != 4007], ROWS).repartition(4)
    rows = [
        (i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in vectors
        if i not in (None, 50, 4007) and v is not None and all(c is not None and np.isfinite(c) for c in v)
    ]
    want = []
    for i, a in rows:
        if i % 50 == 0:
            best = sorted((-int(a @ b), j) for j, b in rows if j != i and len(a) == len(b))[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in query(table).collect()) == sorted(want)


def test_topk_prunes_blocks():
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (40, 16))
    values = np.repeat(centres, 128, axis=0) + rng.integers(-5, 5, (40 * 128, 16))
    blocks = topk.Blocks(np.arange(len(values)), values.astype(np.float64))
    _, found, _ = blocks.search(np.array([0]), values[:1].astype(np.float64), np.array([-np.inf]))
    assert len(found) == 5 and blocks.scored < blocks.count / 2


def test_topk_fewer_than_k(spark):
    table = spark.createDataFrame([(0, [1.0], 0), (1, [1.0], 0), (2, [-0.001], 0)], ROWS)
    assert [tuple(r) for r in query(table).orderBy("rank").collect()] == [(0, 1, 1, 65536), (0, 2, 2, -256)]
    assert query(spark.createDataFrame([], ROWS)).count() == 0
