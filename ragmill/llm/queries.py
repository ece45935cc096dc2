"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm import (
    divergence,
    embeddings,
    extraction,
    filter_audit,
    minhash,
    mixing,
    segmentation,
    substrings,
    surrogates,
    token_counts,
    token_files,
    topk,
    toxicity,
)
from ragmill.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Words of texts, and the smallest id reachable by links (a, b), which stand in both directions.
WORDS = r"[^\x20\x09-\x0D]+"
REACHED = "reached(node, other) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.other)"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op8_minhash"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents
), x AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
y AS (
  SELECT doc_id, n, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle FROM x
), s AS (SELECT DISTINCT doc_id, shingle FROM y WHERE pos <= greatest(n - 4, 1)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT i.doc_id AS a, j.doc_id AS b, count(*) AS both_have FROM s i JOIN s j ON i.shingle = j.shingle AND i.doc_id <> j.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN c i ON i.doc_id = a JOIN c j ON j.doc_id = b WHERE 100 * both_have >= 75 * (i.n + j.n - both_have)),
{REACHED}, m AS (SELECT node, least(node, min(other)) AS component FROM reached GROUP BY node)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id
"""


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLE["op4_mixing"] = mixing.ORACLE


@query
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256"
    )


ORACLE["op7_substrings"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
y AS (
  SELECT doc_id, pos, md5(string_agg(word, ' ') OVER part) AS k, count(*) OVER part AS n FROM x
  WINDOW part AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)
), r AS (SELECT k FROM y WHERE n = 35 GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos FROM y WHERE n = 35 AND k IN (SELECT k FROM r)),
g AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1),
t AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.pos) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.pos = x.pos WHERE c.pos IS NULL GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id
"""


@query
def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its surrogates and where they stand. The tables are made up, so a test key may do."""
    key = surrogates.key_of(spark, test_key="key for made-up documents")
    return surrogates.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), key, spans=True).select(
        "doc_id", "text", F.size("entities").alias("n_entities"), "entities"
    )


@query
def op6_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return segmentation.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE["op2_embeddings"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT i.vec_id AS a, j.vec_id AS b FROM v i JOIN v j ON i.vec_id <> j.vec_id AND len(i.e) = len(j.e) WHERE list_cosine_similarity(i.e, j.e) >= 0.9
), {REACHED}, m AS (SELECT node, least(node, min(other)) AS component FROM reached GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.node = vec_id
"""


@query
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(topk.usable(F.col("embedding"))).select(
        F.col("vec_id").alias("id"), topk.quantised(F.col("embedding")).alias("value")
    )
    return topk.search(rows, rows.filter("id % 50 = 0"))


ORACLE["op5_topk"] = topk.ORACLE


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = token_files.write_and_read(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )
    return files.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


ORACLE["op12_filter_audit"] = filter_audit.ORACLE


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE["op13_divergence"] = divergence.ORACLE
