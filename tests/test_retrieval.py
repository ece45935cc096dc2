import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragmill.functions.bigrams import bigram_jaccard, bigram_similarity
from ragmill.operators import evaluation as e
from ragmill.operators import retrieval as r
from ragmill.operators import topk
from ragmill.operators import vectors as v
from ragmill.operators.embedding import embed_rows, hashing_embedder
from ragmill.operators.topk import VectorBlock, batch_topk, bigram_codes
from ragmill.operators.vectors import ann_topk, mean_vectors, recall_at_k
from ragmill.sources import snapshots


def fuse(spark, lists, **options):
    rows = [("q", i, n + 1, x) for i, one in enumerate(lists) for n, x in enumerate(one)]
    df = spark.createDataFrame(rows, "query_id string, list_idx int, rank int, id string")
    return [(x["id"], x["score"]) for x in r.rrf(df, **options).orderBy("rank").collect()]


def test_fusion_keeps_first_appearance_of_ties(spark):
    fused = fuse(spark, [["a"], ["b"]])
    assert [x for x, _ in fused] == ["a", "b"]
    assert fused[0][1] == fused[1][1]


def test_fusion_adds_up_and_cuts(spark):
    fused = fuse(spark, [["a", "b"], ["b", "c"]])
    assert fused[0][0] == "b" and fused[0][1] == pytest.approx(1 / 62 + 1 / 61)
    assert len(fuse(spark, [list("abcde")], m=2)) == 2


def test_bigram_measures(spark):
    row = spark.sql("SELECT '防災庁設置法' AS a, '復興庁設置法' AS b").select(
        bigram_similarity(F.col("a"), F.col("b")), bigram_jaccard(F.col("a"), F.col("b"))
    ).first()
    assert row[0] == pytest.approx(4 / 7)
    assert row[1] == pytest.approx(3 / 7)


def test_task_side_bigrams_equal_the_column(spark):
    texts = [" a  bc　d ", "", "   ", "防災庁 設置法", "😀a x", "aa aa"]
    from ragmill.functions.bigrams import bigrams

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", bigrams(F.col("t")).alias("g"))
    for row in df.collect():
        decoded = sorted(chr(c >> 21) + chr(c & 0x1FFFFF) for c in bigram_codes(row["t"]).tolist())
        assert (decoded if row["t"].strip(" 　") else []) == sorted(row["g"])


def brute(queries, corpus, k):
    out = {}
    for qid, scope, q in queries:
        q = np.array(q)
        rows = [
            (-round(float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), 9), i)
            for i, s, v in corpus
            if scope in ("", s)
        ]
        out[qid] = [i for _, i in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("query_rows, corpus_rows", [(None, 50_000), (3, 7)])
@pytest.mark.parametrize("scoped", [False, True])
def test_topk_equals_brute_force_in_one_block_and_in_many(spark, query_rows, corpus_rows, scoped):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(60, 4))
    vectors[10] = vectors[20]  # a tie, decided by id
    corpus = [(i, "ab"[i % 2], v) for i, v in enumerate(vectors)]
    queries = [(i, "ab"[i % 2] if scoped else "", vectors[i * 2].tolist()) for i in range(11)]
    q = spark.createDataFrame(queries, "query_id int, scope string, payload array<double>")
    c = spark.createDataFrame([(i, s, v.tolist()) for i, s, v in corpus], "id int, scope_0 string, payload array<double>")
    found = batch_topk(q, c.repartition(5), 6, VectorBlock, int(scoped), query_rows, corpus_rows).orderBy("query_id", "rank").collect()
    got = {}
    for row in found:
        got.setdefault(row["query_id"], []).append(row["id"])
    assert got == brute(queries, corpus, 6)


def test_non_finite_elements_count_as_zero_and_zero_vectors_come_last(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    rows = [(1, [float("nan"), 1.0]), (2, [1.0, float("inf")]), (3, [0.0, 0.0]), (4, None)]
    c = spark.createDataFrame(rows, "id int, embedding array<double>")
    found = r.vector_topk(q, c, 10).orderBy("rank").collect()
    assert [(x["id"], x["score"]) for x in found] == [(2, 1.0), (1, 0.0), (3, None)]


def test_blank_query_finds_nothing(spark):
    q = spark.createDataFrame([(1, " 　")], "query_id int, text string")
    c = spark.createDataFrame([(1, "abc")], "id int, text string")
    assert r.bigram_topk(q, c, 5).count() == 0


def test_rerank_variants(spark):
    hits = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 3, "c"), ("p", 1, "z")], "query_id string, rank int, id string")
    scores = spark.createDataFrame([("q", "c", 0.9), ("q", "a", 0.1), ("q", "x", 5.0), ("q", "c", 0.2)], "query_id string, id string, rerank_score double")
    ids = lambda df: [(x["query_id"], x["id"]) for x in df.orderBy("query_id", "rank").collect()]
    assert ids(r.rerank(hits, scores, 5)) == [("p", "z"), ("q", "c"), ("q", "a")]
    assert ids(r.rerank(hits, scores, 5, keep_unscored=True)) == [("p", "z"), ("q", "c"), ("q", "a"), ("q", "b")]


def test_metrics_look_at_the_whole_pool(spark):
    hits = spark.createDataFrame([(1, 7, True), (1, 9, True), (2, 1, False)], "query_id int, rank int, relevant boolean")
    labels = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {x["query_id"]: (x["hit_at_1"], x["hit_at_k"], x["reciprocal_rank"]) for x in e.rank_metrics(hits, labels, 5).collect()}
    assert got == {1: (False, False, 1 / 7), 2: (False, False, 0.0), 3: (False, False, 0.0)}


def test_needles_ignore_whitespace(spark):
    df = spark.createDataFrame([("a　b c", "bc"), ("x", ""), (None, "x")], "c string, n string")
    assert [x[0] for x in df.select(e.needle_hit(F.col("c"), F.col("n"))).collect()] == [True, False, False]


def test_probing_every_cell_is_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    corpus = spark.createDataFrame(rows, "id int, embedding array<double>")
    queries = spark.createDataFrame(rows[:5], "query_id int, embedding array<double>")
    exact = r.vector_topk(queries, corpus, 5)
    assert recall_at_k(ann_topk(queries, corpus, 5, cells=8, probes=8), exact).first()["recall"] == 1.0
    assert recall_at_k(ann_topk(queries, corpus, 5, cells=8, probes=2), exact).first()["recall"] > 0.3


def test_every_cell_is_probed_when_crowded_ones_were_split(spark, tmp_path):
    rng = np.random.default_rng(11)
    vectors = np.concatenate([rng.normal(size=(40, 8)), np.eye(8)[0] + rng.normal(size=(160, 8)) / 1000, np.tile(np.eye(8)[1], (60, 1))])
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, embedding array<double>")
    queries = corpus.filter("id in (0, 50, 230)").withColumnRenamed("id", "query_id")
    assert len(v.cell_centres(corpus, 8)) > 8
    exact = sorted(map(tuple, r.vector_topk(queries, corpus, len(vectors)).collect()))
    assert len(exact) == 3 * len(vectors)  # every row is one of so many nearest
    assert sorted(map(tuple, ann_topk(queries, corpus, len(vectors), cells=8, probes=8).collect())) == exact
    v.build_cells(corpus, str(tmp_path / "cells"), cells=8)
    assert sorted(map(tuple, v.search_cells(queries, str(tmp_path / "cells"), len(vectors), probes=8).collect())) == exact
    assert v.ann_topk(queries, corpus, len(vectors), cells=8, probes=2).count() < len(exact)


def grams(text):
    flat = " ".join(text.split())
    return {f" {flat} "[i : i + 2] for i in range(len(flat) + 1)} if flat else set()


def bigram_brute(queries, corpus, k, least, same):
    out = []
    for qid, scope, q in queries:
        a = grams(q)
        found = []
        for i, s, t in corpus:
            b = grams(t)
            if a and b and (not same or s == scope):
                sim = len(a & b) / max(len(a), len(b))
                if sim >= least and a & b:
                    found.append((-sim, i))
        out += [(qid, n, i, round(-s, 9)) for n, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("sparse, cells", [(32, 1 << 22), (1, 50), (10**9, 300)])
@pytest.mark.parametrize("scoped", [False, True])
def test_bigram_search_with_a_gram_in_every_row(spark, monkeypatch, sparse, cells, scoped):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(topk.GramIndex, "SPARSE", sparse)
    monkeypatch.setattr(topk, "SCORE_CELLS", cells)
    letters = list("abcdefgh漢字😀 ")
    texts = ["zq " + "".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(150)] + ["", " ", "zq", "zq", "a" * 500]
    corpus = [(i, "ab"[i % 2], t) for i, t in enumerate(texts)]
    queries = [(i, "ab"[i % 2], texts[i * 3]) for i in range(45)] + [(90, "a", ""), (91, "b", "nothing of this"), (92, "a", "zq")]
    q = spark.createDataFrame([(i, s, t) for i, s, t in queries], "query_id int, owner string, text string").withColumn("collections", F.lit(None).cast("array<string>"))
    c = spark.createDataFrame([(i, s, None, t) for i, s, t in corpus], "id int, owner string, collection string, text string").repartition(5)
    search = r.bigram_topk_scoped if scoped else r.bigram_topk
    got = sorted((x["query_id"], x["rank"], x["id"], round(x["score"], 9)) for x in search(q, c, 7, 0.15).collect())
    assert got == bigram_brute(queries, corpus, 7, 0.15, scoped)


def test_gram_index_grows_with_its_sets():
    rng = np.random.default_rng(1)
    texts = ["".join(chr(0x4E00 + x) for x in rng.integers(0, 20_000, 40)) for _ in range(3_000)]
    table = pa.table({"query_id": range(3_000), "scope": [""] * 3_000, "payload": texts})
    index = topk.GramIndex(table, 0.2)
    vocabulary, row, flags, starts, lists = index.parts[""]
    assert len(vocabulary) > 100_000 and flags.nbytes < 1 << 20 and len(lists) <= index.sizes.sum()


def test_stored_chunks_are_read_by_owner_and_not_shuffled(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, f"o{i % 40}", "cd"[i % 2], rng.normal(size=4).tolist()) for i in range(2000)]
    corpus = spark.createDataFrame(rows, "id int, owner string, collection string, embedding array<double>")
    root = str(tmp_path / "chunks")
    snapshots.write_chunks(corpus, root, "m", {"size": 1})
    asked = [(n, f"o{n}", ["d"] if n % 2 else None, rng.normal(size=4).tolist()) for n in (3, 4)]
    queries = spark.createDataFrame(asked, "query_id int, owner string, collections array<string>, embedding array<double>")
    found = r.search_chunks(queries, root, 6)
    want = r.vector_topk_scoped(queries, corpus, 6)
    key = lambda x: (x["query_id"], x["rank"], x["id"], round(x["score"], 9))
    assert sorted(map(key, found.collect())) == sorted(map(key, want.collect())) and found.count() == 12
    plan = r.search_chunks(queries, root, 6)._jdf.queryExecution().executedPlan().toString()
    corpus_side = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in corpus_side and "PartitionFilters: [owner_bucket" in corpus_side
    stored = spark.read.parquet(root)
    buckets = stored.filter(F.col("owner").isin("o3", "o4")).select("owner_bucket").distinct().count()
    assert buckets <= 2 and stored.select("owner_bucket").distinct().count() > 10


def test_splits_without_rows_and_keys_without_a_value(spark):
    rows = spark.createDataFrame([(1, 5, [1.0, 0.0]), (2, None, [0.0, 2.0]), (3, None, [0.0, 4.0])], "id long, label int, embedding array<float>")
    spread = rows.repartitionByRange(8, "id").union(rows.limit(0))  # most of its partitions are empty
    means = mean_vectors(spread, "label").withColumnRenamed("label", "query_id")
    assert {(r["query_id"], tuple(r["embedding"])) for r in means.collect()} == {(5, (1.0, 0.0)), (None, (0.0, 3.0))}
    exact = r.vector_topk(means, spread, 1)
    assert {(x["query_id"], x["id"]) for x in exact.collect()} == {(5, 1), (None, 2)}
    named = means.withColumn("query_id", F.col("query_id").cast("string"))
    assert {(x["query_id"], x["id"]) for x in r.vector_topk(named, spread, 1).collect()} == {("5", 1), (None, 2)}
    found = ann_topk(means, spread, 1, cells=2, probes=2)
    assert recall_at_k(found, exact).first()["recall"] == 1.0


def test_small_offers_are_ranked_together(monkeypatch):
    folds, fold = [], topk.TopK.fold
    monkeypatch.setattr(topk.TopK, "fold", lambda self: (folds.append(1), fold(self)))
    rng = np.random.default_rng(3)
    top = topk.TopK(500, 2)
    row, score = rng.integers(0, 500, 5000), np.round(rng.random(5000), 2)
    for start in range(0, 5000, 5):
        top.offer(row[start : start + 5], score[start : start + 5], np.arange(start, start + 5))
    top.fold()
    assert len(folds) < 10
    best = {r: sorted((-score[i], i) for i in np.flatnonzero(row == r))[:2] for r in range(500)}
    assert list(zip(top.row, -top.score, top.id)) == [(r, s_, i) for r in range(500) for s_, i in best[r]]


def test_blocks_of_queries_copy_rows_seldom(spark):
    rng = np.random.default_rng(4)
    vectors = [[float(x) for x in v] for v in np.round(rng.normal(size=(300, 3)), 1)] + [[0.0, 0.0, 0.0]]
    corpus = spark.createDataFrame(list(enumerate(vectors)), "id int, embedding array<double>")
    queries = corpus.withColumnRenamed("id", "query_id")
    sides = [r._vector_side(queries, r._any(), id_col="query_id", name="query_id"), r._vector_side(corpus, id_col="id", name="id")]
    blocked = topk.batch_topk(*sides, 3, topk.VectorBlock, query_rows=1, corpus_rows=10)
    assert sorted(map(tuple, blocked.collect()), key=repr) == sorted(map(tuple, r.vector_topk(queries, corpus, 3).collect()), key=repr)
    # 301 queries one by one; 31 blocks of the corpus have pairs for all cores with ten blocks of queries.
    assert "sequence(0, 300" not in blocked._jdf.queryExecution().toString()


def test_vectors_are_made_on_all_cores(spark, tmp_path):
    spark.range(20).selectExpr("id", "concat('text ', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert embed_rows(rows, hashing_embedder(4)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_name_index_scores_as_sets_do():
    rng = np.random.default_rng(2)
    for widest in (9, 400):  # longer sets than bytes can count take the general way
        texts = ["".join(chr(0x4E00 + c) for c in rng.integers(0, 12 if widest < 50 else 300, rng.integers(0, widest))) for _ in range(60)]
        asked, rows = texts[:30], texts[20:]
        table = pa.table({"query_id": asked, "scope": [""] * len(asked), "payload": asked})
        index, top = topk.NameIndex(table, 0.0), topk.TopK(len(asked), 1)
        ids = np.array([f"L{i:02d}" for i in range(len(rows))])
        for at in range(0, len(rows), 7):
            index.offer(top, ids[at : at + 7], [], pa.array(rows[at : at + 7]))
        top.fold()
        got = {int(r): (str(i), s) for r, i, s in zip(top.row, top.id, top.score)}
        pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
        for q, text in enumerate(asked):
            sims = [(-len(pairs(text) & pairs(r)) / len(pairs(text) | pairs(r)), i) for r, i in zip(rows, ids) if pairs(text) & pairs(r)]
            assert got.get(q) == ((str(min(sims)[1]), -min(sims)[0]) if sims else None)


def test_name_index_passes_over_groups_of_titles(monkeypatch):
    rng, compared, with_count = np.random.default_rng(8), [], topk.BitCounter.with_count

    def counted(self, digits, count):
        found = with_count(self, digits, count)
        compared.append(len(found) * topk.NAMES_A_BIT)
        return found

    monkeypatch.setattr(topk.BitCounter, "with_count", counted)
    titles = ["特" + "".join(chr(0x4E00 + int(c)) for c in str(i)) + "法" for i in range(30_000)]
    names = [titles[i][:-1] + "令" for i in rng.integers(0, len(titles), 200)] + ["港湾", ""]
    index, top = topk.NameIndex(pa.table({"query_id": names, "scope": [""] * len(names), "payload": names}), 0.0), topk.TopK(len(names), 1)
    ids = np.array([f"L{i:05d}" for i in range(len(titles))])
    index.offer(top, ids, [], pa.array(titles))
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    got = {int(r): (str(i), s) for r, i, s in zip(top.row, top.id, top.score)}
    sets = [pairs(t) for t in titles]
    for q in range(0, 200, 20):
        mine = pairs(names[q])
        assert got[q] == min(((i, len(mine & t) / len(mine | t)) for i, t in zip(ids.tolist(), sets)), key=lambda x: (-x[1], x[0]))
    assert 200 not in got and 201 not in got
    assert sum(compared) < len(names) * len(titles) / 50


def test_names_with_the_vector_of_a_title_are_not_searched_in_all(spark, monkeypatch):
    rng, searched, whole = np.random.default_rng(6), [], r.vector_topk
    titles = rng.normal(size=(80, 6))
    titles[60:70] = titles[20:30] * 3 + 1e-7  # of one direction at nine decimals; the smaller id counts
    titles[79] = 0
    names = np.concatenate([titles * 0.5, rng.normal(size=(20, 6)), np.zeros((1, 6))])
    names[0, 0] = float("nan")
    master = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(titles)], "id int, embedding array<double>")
    rows = [(i, f"n{i}", v.tolist()) for i, v in enumerate(names)] + [(500, "none", None)]
    asked = spark.createDataFrame(rows, "query_id int, name string, embedding array<double>")
    want = sorted(map(tuple, r.nearest_law_per_name(asked, master).collect()))
    monkeypatch.setattr(r, "QUERY_BLOCK_ROWS", 10)
    monkeypatch.setattr(r, "vector_topk", lambda q, c, k: (searched.append(q.count()), whole(q, c, k))[1])
    assert sorted(map(tuple, r.nearest_law_per_name(asked, master).collect())) == want
    assert len(want) == 101 and [x[2] for x in want[60:70]] == list(range(20, 30))
    assert searched == [24]  # of 102: twenty others, two zero vectors, the changed one and the one without a vector
