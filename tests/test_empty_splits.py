"""Searches over tables of which most splits have no rows: one file with one row group, read in many pieces."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract

SPLITS = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "0"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(3), tmp_path_factory.mktemp("one-group")
    langs, n = ("en", "de", "fr", "es"), 120

    def write(name, **columns):
        pq.write_table(pa.table(columns), folder / f"{name}.parquet", row_group_size=10 * n)

    texts = [" ".join(rng.choice(("law", "act", "rule", "court", "form")) + str(rng.randrange(40)) for _ in range(20)) for _ in range(n)]
    ids = pa.array(range(n), pa.int64())
    write(
        "documents", doc_id=ids, text=texts, lang=[langs[i % 4] for i in range(n)], source=[f"src{i % 7}" for i in range(n)],
        n_chars=pa.array(map(len, texts), pa.int64()),
    )
    vectors = pa.array([[rng.gauss(0, 1) for _ in range(64)] for _ in range(n)], pa.list_(pa.float32()))
    write("embeddings", vec_id=ids, embedding=vectors, label=pa.array([i % 10 for i in range(n)], pa.int32()))
    write("benchmark", item_id=pa.array(range(12), pa.int64()), text=texts[:12])
    write("pages", page_id=ids, url=[f"http://example.com/{langs[i % 4]}/{i}" for i in range(n)], html=[t * 20 for t in texts])
    before = {k: spark.conf.get(k) for k in SPLITS}
    for k, v in SPLITS.items():
        spark.conf.set(k, v)
    empty = spark.read.parquet(str(folder / "embeddings.parquet")).rdd.glom().map(len).collect()
    assert empty.count(0) > 1
    yield str(folder)
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", [
    "ann_recall_in_clusters", "ann_topk_all_cells", "ann_topk_by_bound", "context_text", "hybrid_search", "hybrid_search_reranked",
    "hybrid_search_scoped", "nearest_law_per_name", "nearest_titles", "reference_rows", "rerank_keep_unscored", "search_in_groups",
    "stored_cells_all", "title_hybrid", "vector_topk", "vector_topk_scoped",
])
def test_search_over_splits_without_rows(spark, tables, name):
    assert contract.queries()[name](spark, tables).count() > 0
