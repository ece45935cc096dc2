"""Evaluation queries: benchmark passages searched in the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.functions.text import snippet
from ragmill.operators import evaluation as e
from ragmill.operators import retrieval as r
from ragmill.operators.vectors import md5_sample
from ragmill.plans import inputs as i
from ragmill.plans import query
from ragmill.tables import table

POOL_SQL = f"""q AS (SELECT item_id AS query_id, text FROM benchmark), c AS (SELECT doc_id AS id, text FROM documents),
{i.bigram_hits_sql('hits', 'q', 'c', 20, 0.2)},
rel AS (SELECT h.query_id, h.rank, h.id, contains(regexp_replace(c.text, '[\\s　]+', '', 'g'), regexp_replace(q.text, '[\\s　]+', '', 'g')) AS relevant
  FROM hits h JOIN q ON q.query_id = h.query_id JOIN c ON c.id = h.id),
first AS (SELECT q.query_id, min(CASE WHEN relevant THEN rank END) AS r FROM q LEFT JOIN rel ON rel.query_id = q.query_id GROUP BY q.query_id)"""


def _queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _labels(spark, sf):
    return _queries(spark, sf).withColumnRenamed("text", "needle")


def _texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _relevant(spark, sf):
    pool = r.bigram_topk(_queries(spark, sf), _texts(spark, sf), 20)
    content = _texts(spark, sf).withColumnRenamed("text", "content")
    return e.needle_relevance(pool.join(content, "id"), _labels(spark, sf))


@query(f"WITH {POOL_SQL} SELECT query_id, rank, id, relevant FROM rel")
def needle_relevance(spark, sf):
    return _relevant(spark, sf).select("query_id", "rank", "id", "relevant")


@query(f"""WITH {POOL_SQL} SELECT query_id, coalesce(r <= 1, FALSE) AS hit_at_1, coalesce(r <= 5, FALSE) AS hit_at_k,
  coalesce(round(1.0::DOUBLE / r, 6), 0.0::DOUBLE) AS reciprocal_rank FROM first""")
def rank_metrics(spark, sf):
    out = e.rank_metrics(_relevant(spark, sf), _labels(spark, sf), 5)
    return out.withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))


@query(f"WITH {POOL_SQL} SELECT query_id, coalesce(CAST(r AS VARCHAR), 'miss') AS first_rank FROM first")
def first_relevant_rank(spark, sf):
    return e.first_relevant_rank(_relevant(spark, sf), _labels(spark, sf))


RUNS_SQL = f"""{POOL_SQL},
scored AS (SELECT rel.*, d.n_chars, d.lang FROM rel JOIN documents d ON d.doc_id = rel.id),
runs AS (SELECT 'base' AS run, query_id, rank, relevant FROM rel UNION ALL
  SELECT 'rerank', query_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lang <> 'es' THEN 1.0::DOUBLE / (1.0::DOUBLE + n_chars) END DESC NULLS LAST, rank), relevant FROM scored),
per AS (SELECT run, query_id, min(CASE WHEN relevant THEN rank END) AS r FROM runs GROUP BY run, query_id),
sums AS (SELECT run, count_if(r <= 1) AS h1, count_if(r <= 5) AS hk, coalesce(sum(1.0::DOUBLE / r), 0) AS rr FROM per GROUP BY run),
rates AS (SELECT s.*, (SELECT greatest(count(DISTINCT item_id), 1) FROM benchmark) AS n FROM sums s)"""


@query(f"""WITH {RUNS_SQL} SELECT a.run, CAST(a.h1 AS BIGINT) AS hit_at_1, CAST(a.hk AS BIGINT) AS hit_at_k,
  round(100.0::DOUBLE * a.h1 / a.n, 6) AS pct_at_1, round(100.0::DOUBLE * a.hk / a.n, 6) AS pct_at_k, round(a.rr / a.n, 6) AS mrr,
  CAST(a.h1 - b.h1 AS BIGINT) AS delta_at_1, CAST(a.hk - b.hk AS BIGINT) AS delta_at_k, round(a.rr / a.n - b.rr / b.n, 6) AS delta_mrr
FROM rates a, rates b WHERE b.run = 'base'""")
def compare_runs(spark, sf):
    base = _relevant(spark, sf).select("query_id", "rank", "id", "relevant")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    scores = base.join(docs.filter(F.col("lang") != "es"), "id").select(
        "query_id", "id", (F.lit(1.0) / (F.lit(1.0) + F.col("n_chars"))).alias("rerank_score")
    )
    again = r.rerank(base, scores, 20, keep_unscored=True)
    runs = base.withColumn("run", F.lit("base")).select("run", "query_id", "rank", "relevant").unionByName(
        again.withColumn("run", F.lit("rerank")).select("run", "query_id", "rank", "relevant")
    )
    out = e.compare_runs(runs, _labels(spark, sf), 5)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


SELF_SQL = f"""{i.CORPUS_SQL},
sample AS (SELECT id AS query_id, text, embedding FROM corpus WHERE embedding IS NOT NULL ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 30),
{i.vector_hits_sql('vec_hits', 'sample', 'corpus', 20)}, {i.bigram_hits_sql('text_hits', 'sample', 'corpus', 20, 0.2)},
{i.rrf_sql('fused', ['vec_hits', 'text_hits'], 60, 10)},
first AS (SELECT s.query_id, min(CASE WHEN f.id = s.query_id THEN rank END) AS r FROM sample s LEFT JOIN fused f ON f.query_id = s.query_id GROUP BY s.query_id)"""


@query(f"""WITH {SELF_SQL} SELECT count(*) AS queries, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS hit_at_1,
  round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS hit_at_k, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM first""")
def self_retrieval(spark, sf):
    chunks = i.corpus(spark, sf)
    # Thirty ids first, so that no text is moved for the sample.
    vectors = chunks.filter(F.col("embedding").isNotNull())
    ids = [row["id"] for row in md5_sample(vectors.select("id"), ["id"], 30).collect()]
    sample = md5_sample(vectors.filter(F.col("id").isin(ids)), ["id"], 30)
    sample = sample.select(F.col("id").alias("query_id"), "text", "embedding")
    found = e.self_hits(r.hybrid_search(sample, chunks))
    out = e.summary(e.rank_metrics(found, sample, 10))
    return out.select("queries", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_k", "mrr")])


@query("SELECT doc_id, CAST(quality AS INTEGER) AS quality FROM labels JOIN (SELECT doc_id AS d FROM labels ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50) s ON s.d = labels.doc_id")
def md5_sample_rows(spark, sf):
    return md5_sample(table(spark, sf, "labels"), ["doc_id"], 50).select("doc_id", "quality")


@query("""WITH ranks AS (SELECT o_custkey, min(rank) AS rank FROM (
    SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders) WHERE o_orderstatus = 'O' GROUP BY o_custkey),
all_customers AS (SELECT c_custkey, rank FROM customer LEFT JOIN ranks ON o_custkey = c_custkey)
SELECT round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM all_customers""")
def mean_reciprocal_rank(spark, sf):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    ranked = table(spark, sf, "orders").withColumn("rank", rank).filter(F.col("o_orderstatus") == "O")
    first = ranked.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("rank").alias("rank"))
    everyone = table(spark, sf, "customer").select("c_custkey").join(first, "c_custkey", "left")
    return e.mean_reciprocal_rank(everyone).select(F.round("mrr", 6).alias("mrr"))


@query("""WITH flat AS (SELECT doc_id, trim(regexp_replace(text, '[\\s　]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE substr(t, 1, 80) || '…' END AS snippet FROM flat""")
def snippets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", snippet(F.col("text"), 80).alias("snippet"))
