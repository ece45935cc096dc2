"""Inputs that several queries derive from the given tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.operators.vectors import mean_vectors
from ragmill.tables import sql, table


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks: id, text, owner, collection, embedding (null where there is none)."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("source").alias("owner"), F.col("lang").alias("collection"), "n_chars"
    )
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return docs.join(vectors, "id", "left")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def label_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query per label: the mean vector of its rows."""
    means = mean_vectors(table(spark, sf, "embeddings"), "label")
    return means.withColumnRenamed("label", "query_id")


def passage_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark passage, searched with the mean vector of label item_id mod 10."""
    means = label_queries(spark, sf).select(F.col("query_id").alias("label"), "embedding")
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), "text", F.pmod("item_id", F.lit(10)).cast("int").alias("label")
    )
    return items.join(means, "label").select("query_id", "text", "embedding")


def owner_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query per owner; every second owner limits itself to two collections."""
    chunks = corpus(spark, sf).filter(F.col("embedding").isNotNull())
    means = mean_vectors(chunks, "owner")
    odd = F.pmod(F.regexp_extract("owner", r"(\d+)", 1).cast("int"), F.lit(2)) == 1
    collections = F.when(odd, F.array(F.lit("en"), F.lit("fr")))
    return means.select(F.col("owner").alias("query_id"), "owner", "embedding", collections.alias("collections"))


CORPUS_SQL = """
corpus AS (
  SELECT d.doc_id AS id, d.text, d.source AS owner, d.lang AS collection, d.n_chars,
         e.embedding::DOUBLE[] AS embedding, e.label
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)
"""


def means_sql(name: str, source: str, key: str) -> str:
    return f"""
{name} AS (
  SELECT query_id, list(m ORDER BY pos) AS embedding FROM (
    SELECT query_id, pos, avg(v) AS m FROM (
      SELECT {key} AS query_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos
      FROM {source} WHERE embedding IS NOT NULL) GROUP BY query_id, pos) GROUP BY query_id)
"""


LABEL_QUERIES_SQL = means_sql("label_queries", "embeddings", "label")
PASSAGE_QUERIES_SQL = """
passage_queries AS (
  SELECT b.item_id AS query_id, b.text, m.embedding
  FROM benchmark b JOIN label_queries m ON m.query_id = b.item_id % 10)
"""
OWNER_QUERIES_SQL = means_sql("owner_means", "corpus", "owner") + """
, owner_queries AS (
  SELECT query_id, query_id AS owner, embedding,
         CASE WHEN CAST(regexp_extract(query_id, '(\\d+)', 1) AS INTEGER) % 2 = 1 THEN ['en', 'fr'] END AS collections
  FROM owner_means)
"""


def vector_hits_sql(name: str, queries: str, rows: str, k: int, extra: str = "TRUE") -> str:
    return f"""
{name} AS (
  SELECT query_id, rank, id, score FROM (
    SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
    FROM (SELECT q.query_id, c.id, round(list_cosine_similarity(q.embedding, c.embedding::DOUBLE[]), 9) AS score
          FROM {queries} q, {rows} c WHERE c.embedding IS NOT NULL AND ({extra})))
  WHERE rank <= {k})
"""


def grams_sql(name: str, source: str, key: str, text: str) -> str:
    """Distinct padded 2-grams per row: (key, g, n)."""
    flat = f"trim(regexp_replace({text}, '[\\s　]+', ' ', 'g'))"
    return f"""
{name}_chars AS (
  SELECT k, p, ch FROM (
    SELECT k, unnest(chars) AS ch, generate_subscripts(chars, 1) AS p
    FROM (SELECT {key} AS k, string_split(' ' || {flat} || ' ', '') AS chars FROM {source} WHERE length({flat}) > 0))),
{name}_pairs AS (
  SELECT DISTINCT k, g FROM (
    SELECT k, ch || lead(ch) OVER (PARTITION BY k ORDER BY p) AS g FROM {name}_chars) WHERE g IS NOT NULL),
{name} AS (SELECT k, g, count(*) OVER (PARTITION BY k) AS n FROM {name}_pairs)
"""


def bigram_hits_sql(name: str, queries: str, rows: str, k: int, min_sim: float, extra: str = "TRUE") -> str:
    return f"""
{grams_sql(name + '_q', queries, 'query_id', 'text')},
{grams_sql(name + '_c', rows, 'id', 'text')},
{name}_sim AS (
  SELECT a.k AS query_id, b.k AS id, count(*) / CAST(greatest(any_value(a.n), any_value(b.n)) AS DOUBLE) AS score
  FROM {name}_q a JOIN {name}_c b ON a.g = b.g GROUP BY a.k, b.k),
{name} AS (
  SELECT query_id, rank, id, score FROM (
    SELECT s.query_id, s.id, s.score,
           CAST(row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
    FROM {name}_sim s JOIN {queries} q ON q.query_id = s.query_id JOIN {rows} c ON c.id = s.id
    WHERE s.score >= {min_sim} AND ({extra}))
  WHERE rank <= {k})
"""


def rrf_sql(name: str, lists: list[str], k: int, m: int) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, {i} AS list_idx, rank, id FROM {t}" for i, t in enumerate(lists))
    return f"""
{name} AS (
  SELECT query_id, rank, id, score FROM (
    SELECT query_id, id, score,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, li, rk) AS INTEGER) AS rank
    FROM (SELECT query_id, id, sum(1.0 / ({k} + rank)::DOUBLE) AS score, min(list_idx) AS li,
                 arg_min(rank, list_idx * 1000000 + rank) AS rk
          FROM ({union}) GROUP BY query_id, id))
  WHERE rank <= {m})
"""


SCOPE_EXTRA = "c.owner = q.owner AND (q.collections IS NULL OR list_contains(q.collections, c.collection))"

HYBRID_SQL = ",".join(
    [
        CORPUS_SQL,
        LABEL_QUERIES_SQL,
        PASSAGE_QUERIES_SQL,
        vector_hits_sql("vec_hits", "passage_queries", "corpus", 20),
        bigram_hits_sql("text_hits", "passage_queries", "corpus", 20, 0.2),
    ]
)

# Versioned articles derived from orders; this SQL runs in Spark and in DuckDB alike.
# One law per customer, a handful of anchors per law, one version per order.
DWH_SQL = """
SELECT
  law_num || '_' || CASE WHEN d = DATE '1995-06-17' THEN 'undated' ELSE replace(CAST(d AS STRING), '-', '') END
    || '_' || lpad(CAST(o_orderkey AS STRING), 12, '0') AS law_id,
  law_num, law_title, unique_anchor,
  CASE WHEN unique_anchor LIKE 'Main_Article_%' THEN 'Mp-At_' || split_part(unique_anchor, '_', 3) END AS anchor,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'Article' || chr(10) || '　削除 '
       WHEN unique_anchor = 'Main_Provision' AND o_orderstatus = 'F' THEN 'Main' || chr(10) || '　 '
       ELSE 'Article ' || unique_anchor || chr(10) || '　' || o_orderpriority || ' ' || CAST(o_totalprice AS STRING) END AS content,
  o_orderpriority AS article_summary, 'Heisei' AS era, CAST(o_orderkey % 30 AS INT) AS year, o_orderstatus AS law_type,
  CASE WHEN o_orderstatus <> 'O' THEN d END AS promulgate_date,
  o_orderkey AS load_no,
  CASE WHEN d = DATE '1995-06-17' THEN NULL ELSE d END AS enforce_date
FROM (
  SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS d,
    'L' || lpad(CAST(o_custkey AS STRING), 9, '0') AS law_num,
    'Act of ' || o_orderstatus || ' ' || CAST(o_custkey AS STRING) AS law_title,
    CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'Main_Provision' WHEN 1 THEN 'Suppl_Article_1'
         ELSE 'Main_Article_' || CAST(o_orderkey % 5 AS STRING) END AS unique_anchor
  FROM {orders}) o
"""
TODAY = "1999-01-01"


def dwh(spark: SparkSession, sf: str) -> DataFrame:
    return sql(spark, sf, DWH_SQL)


INDEX_SQL = f"""
dwh AS ({DWH_SQL}),
idx AS (
  SELECT * FROM (
    SELECT *, enforce_date > DATE '{TODAY}' AS is_future,
      row_number() OVER (PARTITION BY law_num, unique_anchor ORDER BY
        (enforce_date <= DATE '{TODAY}') DESC,
        CASE WHEN enforce_date <= DATE '{TODAY}' THEN enforce_date END DESC NULLS LAST,
        CASE WHEN enforce_date > DATE '{TODAY}' THEN enforce_date END ASC NULLS LAST, law_id DESC) AS rn
    FROM dwh WHERE enforce_date IS NOT NULL) WHERE rn = 1)
"""
