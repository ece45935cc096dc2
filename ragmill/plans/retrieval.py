"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.functions.bigrams import bigram_similarity, bigrams
from ragmill.operators import retrieval as r
from ragmill.operators import vectors as v
from ragmill.operators import warehouse as w
from ragmill.plans import inputs as i
from ragmill.plans import query
from ragmill.session import materialize, shared_dir
from ragmill.sources import snapshots
from ragmill.tables import table

HITS = "SELECT query_id, rank, id, round(score, 6) AS score FROM "


def hits(df):
    return df.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(f"WITH {i.LABEL_QUERIES_SQL}, rows AS (SELECT vec_id AS id, embedding FROM embeddings), "
       f"{i.vector_hits_sql('hits', 'label_queries', 'rows', 10)} {HITS} hits")
def vector_topk(spark, sf):
    return hits(r.vector_topk(i.label_queries(spark, sf), i.vectors(spark, sf), 10))


@query(f"WITH {i.CORPUS_SQL}, {i.OWNER_QUERIES_SQL}, "
       f"{i.vector_hits_sql('hits', 'owner_queries', 'corpus', 5, i.SCOPE_EXTRA)} {HITS} hits")
def vector_topk_scoped(spark, sf):
    return hits(r.vector_topk_scoped(i.owner_queries(spark, sf), i.corpus(spark, sf), 5))


@query(f"WITH {i.CORPUS_SQL}, {i.OWNER_QUERIES_SQL}, "
       f"{i.vector_hits_sql('hits', 'owner_queries', 'corpus', 5, i.SCOPE_EXTRA)} {HITS} hits")
def stored_chunk_search(spark, sf):
    """The same over chunks stored by owner."""
    root = f"{shared_dir(spark)}/chunks"
    snapshots.write_chunks(i.corpus(spark, sf), root, "model", {"size": 1000})
    return hits(r.search_chunks(i.owner_queries(spark, sf), root, 5))


@query(f"WITH {i.grams_sql('grams', 'benchmark', 'item_id', 'text')} "
       "SELECT k AS item_id, count(*) AS n_bigrams, string_agg(g, '|' ORDER BY encode(g)) AS grams FROM grams GROUP BY k")
def bigram_sets(spark, sf):
    grams = bigrams(F.col("text"))
    return table(spark, sf, "benchmark").select(
        "item_id", F.size(grams).cast("bigint").alias("n_bigrams"), F.array_join(F.array_sort(grams), "|").alias("grams")
    )


@query(f"""WITH pairs AS (SELECT p_partkey AS k, p_name AS a, p_type AS b FROM part),
{i.grams_sql('ga', 'pairs', 'k', 'a')}, {i.grams_sql('gb', 'pairs', 'k', 'b')},
common AS (SELECT ga.k, count(*) AS c FROM ga JOIN gb ON ga.k = gb.k AND ga.g = gb.g GROUP BY ga.k),
sizes AS (SELECT k, max(n) AS n FROM (SELECT DISTINCT k, n FROM ga UNION SELECT DISTINCT k, n FROM gb) GROUP BY k)
SELECT s.k AS p_partkey, round(coalesce(c.c, 0) / s.n::DOUBLE, 6) AS similarity FROM sizes s LEFT JOIN common c ON c.k = s.k""")
def bigram_pair_similarity(spark, sf):
    sim = bigram_similarity(F.col("p_name"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", F.round(sim, 6).alias("similarity"))


def passages(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH q AS (SELECT item_id AS query_id, text FROM benchmark), c AS (SELECT doc_id AS id, text FROM documents), "
       f"{i.bigram_hits_sql('hits', 'q', 'c', 10, 0.2)} {HITS} hits")
def bigram_topk(spark, sf):
    return hits(r.bigram_topk(passages(spark, sf), texts(spark, sf), 10))


FUSE_LISTS = """lists AS (
  SELECT o_custkey AS query_id, CAST(o_orderkey % 3 AS INTEGER) AS list_idx, o_orderpriority || o_orderstatus AS id,
    row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderdate, o_orderkey) AS rank
  FROM orders),
fused AS (SELECT query_id, id, sum(1.0 / (60 + rank)::DOUBLE) AS score, min(list_idx * 1000000 + rank) AS seen
  FROM lists GROUP BY query_id, id)"""


@query(f"""WITH {FUSE_LISTS} SELECT query_id, rank, id, round(score, 6) AS score FROM (
  SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS INTEGER) AS rank
  FROM fused) WHERE rank <= 5""")
def rank_fusion(spark, sf):
    from pyspark.sql import Window

    orders = table(spark, sf, "orders").withColumn("list_idx", F.pmod("o_orderkey", F.lit(3)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("o_custkey", "list_idx").orderBy("o_orderdate", "o_orderkey"))
    lists = orders.select(
        F.col("o_custkey").alias("query_id"), "list_idx", rank.alias("rank"),
        F.concat("o_orderpriority", "o_orderstatus").alias("id"),
    )
    return hits(r.rrf(lists, m=5))


def _hybrid(spark, sf):
    return r.hybrid_search(i.passage_queries(spark, sf), i.corpus(spark, sf))


@query(f"WITH {i.HYBRID_SQL}, {i.rrf_sql('fused', ['vec_hits', 'text_hits'], 60, 10)} {HITS} fused")
def hybrid_search(spark, sf):
    return hits(_hybrid(spark, sf))


@query(f"WITH {i.CORPUS_SQL}, {i.OWNER_QUERIES_SQL}, oq AS (SELECT *, 'the ' || query_id || ' of the en and in th' AS text FROM owner_queries), "
       f"{i.vector_hits_sql('vec_hits', 'oq', 'corpus', 20, i.SCOPE_EXTRA)}, "
       f"{i.bigram_hits_sql('text_hits', 'oq', 'corpus', 20, 0.02, i.SCOPE_EXTRA)}, "
       f"{i.rrf_sql('fused', ['vec_hits', 'text_hits'], 60, 10)} {HITS} fused")
def hybrid_search_scoped(spark, sf):
    asked = i.owner_queries(spark, sf).withColumn(
        "text", F.concat(F.lit("the "), "query_id", F.lit(" of the en and in th"))
    )
    return hits(r.hybrid_search(asked, i.corpus(spark, sf), min_sim=0.02, scoped=True))


def _hydrated(spark, sf):
    docs = i.corpus(spark, sf)
    chunks = docs.select(
        "id", F.col("owner").alias("document_id"), "text", F.lit(0).alias("chunk_index"), F.col("collection").alias("header_path")
    )
    titles = docs.select(F.col("owner").alias("document_id")).distinct()
    titles = titles.withColumn("title", F.concat(F.lit("Title "), "document_id"))
    return r.hydrate(_hybrid(spark, sf), chunks, titles)


FUSED = f"WITH {i.HYBRID_SQL}, {i.rrf_sql('fused', ['vec_hits', 'text_hits'], 60, 10)}, " \
        "full_hits AS (SELECT f.*, c.text, c.owner, c.collection, 'Title ' || c.owner AS title FROM fused f JOIN corpus c ON c.id = f.id)"


@query(f"{FUSED} SELECT query_id, rank, id, title, collection AS header_path, md5(text) AS text_md5 FROM full_hits")
def hydrate_hits(spark, sf):
    return _hydrated(spark, sf).select("query_id", "rank", "id", "title", "header_path", F.md5("text").alias("text_md5"))


def _rerank_scores(spark, sf):
    """Scores for the pool: shorter documents first, Spanish ones are left unscored."""

    def score(pool):
        docs = i.corpus(spark, sf).select("id", "collection", "n_chars")
        return pool.join(docs, "id").filter(F.col("collection") != "es").select(
            "query_id", "id", (F.lit(1.0) / (F.lit(1.0) + F.col("n_chars"))).alias("rerank_score")
        )

    return score


RERANK_SCORED = f"""WITH {i.HYBRID_SQL}, {i.rrf_sql('fused', ['vec_hits', 'text_hits'], 60, 20)},
scored AS (SELECT f.query_id, f.id, f.rank, CASE WHEN c.collection <> 'es' THEN 1.0::DOUBLE / (1.0::DOUBLE + c.n_chars) END AS s
  FROM fused f JOIN corpus c ON c.id = f.id)"""


@query(f"""{RERANK_SCORED} SELECT query_id, rank, id, round(s, 9) AS rerank_score FROM (
  SELECT query_id, id, s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS INTEGER) AS rank
  FROM (SELECT *, count(s) OVER (PARTITION BY query_id) AS n FROM scored) WHERE n = 0 OR s IS NOT NULL) WHERE rank <= 10""")
def hybrid_search_reranked(spark, sf):
    found = r.hybrid_search(
        i.passage_queries(spark, sf), i.corpus(spark, sf), candidates=20, scores_of=_rerank_scores(spark, sf)
    )
    return found.select("query_id", "rank", "id", F.round("rerank_score", 9).alias("rerank_score"))


@query(f"""{RERANK_SCORED} SELECT query_id, rank, id, round(s, 9) AS rerank_score FROM (
  SELECT query_id, id, s, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank) AS INTEGER) AS rank
  FROM scored) WHERE rank <= 20""")
def rerank_keep_unscored(spark, sf):
    pool = r.hybrid_search(i.passage_queries(spark, sf), i.corpus(spark, sf), top_m=20)
    found = r.rerank(pool, _rerank_scores(spark, sf)(pool), 20, keep_unscored=True)
    return found.select("query_id", "rank", "id", F.round("rerank_score", 9).alias("rerank_score"))


@query(f"""WITH {i.CORPUS_SQL}, {i.LABEL_QUERIES_SQL},
grp AS (SELECT q.query_id, s.owner FROM label_queries q JOIN (SELECT DISTINCT owner FROM corpus) s
  ON CAST(substr(s.owner, 4) AS INTEGER) % 10 = q.query_id),
gq AS (SELECT q.query_id, q.embedding, g.owner FROM label_queries q JOIN grp g ON g.query_id = q.query_id),
{i.vector_hits_sql('hits', 'gq', 'corpus', 30, "c.owner = q.owner AND c.collection <> 'de'")} {HITS} hits""")
def search_in_groups(spark, sf):
    index = i.corpus(spark, sf).select(
        "id", F.col("owner").alias("law_num"), (F.col("collection") == "de").alias("is_future"), "embedding"
    )
    groups = index.select("law_num").distinct().select(
        F.pmod(F.substring("law_num", 4, 9).cast("int"), F.lit(10)).alias("query_id"), "law_num"
    )
    return hits(r.search_in_groups(i.label_queries(spark, sf), groups, index))


@query(f"WITH {i.LABEL_QUERIES_SQL}, rows AS (SELECT vec_id AS id, embedding FROM embeddings), "
       f"{i.vector_hits_sql('hits', 'label_queries', 'rows', 5)} {HITS} hits WHERE score >= 0.2")
def nearest_titles(spark, sf):
    return hits(r.nearest_titles(i.label_queries(spark, sf), i.vectors(spark, sf), min_score=0.2))


TITLE_SQL = "master AS (SELECT p.page_id AS id, p.url AS text, e.embedding::DOUBLE[] AS embedding, " \
            "split_part(p.url, '/', 4) AS lang FROM pages p LEFT JOIN embeddings e ON e.vec_id = p.page_id)"


def _titles(spark, sf):
    vecs = i.vectors(spark, sf).select("id", "embedding")
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text"))
    return pages.join(vecs, "id", "left").withColumn("lang", F.split_part("text", F.lit("/"), F.lit(4)))


def _title_queries(spark, sf):
    means = v.mean_vectors(_titles(spark, sf).filter(F.col("embedding").isNotNull()), "lang")
    return means.select(
        F.col("lang").alias("query_id"), F.concat(F.lit("http://example.com/"), "lang", F.lit("/")).alias("text"), "embedding"
    )


@query(f"WITH {TITLE_SQL}, {i.means_sql('m', 'master', 'lang')}, "
       "tq AS (SELECT query_id, 'http://example.com/' || query_id || '/' AS text, embedding FROM m), "
       f"{i.vector_hits_sql('vec_hits', 'tq', 'master', 20)}, {i.bigram_hits_sql('text_hits', 'tq', 'master', 20, 0.2)}, "
       f"{i.rrf_sql('fused', ['vec_hits', 'text_hits'], 60, 5)} {HITS} fused")
def title_hybrid(spark, sf):
    return hits(r.title_hybrid(_title_queries(spark, sf), _titles(spark, sf)))


@query(f"WITH {i.CORPUS_SQL}, {i.OWNER_QUERIES_SQL}, {i.vector_hits_sql('hits', 'owner_queries', 'corpus', 1)} "
       "SELECT 'all' AS query_id, query_id AS name, id, round(score, 6) AS score FROM hits")
def nearest_law_per_name(spark, sf):
    names = i.owner_queries(spark, sf).select(F.lit("all").alias("query_id"), F.col("owner").alias("name"), "embedding")
    return r.nearest_law_per_name(names, i.corpus(spark, sf)).select(
        "query_id", "name", "id", F.round("score", 6).alias("score")
    )


NUMBER = "CAST(regexp_extract(owner, '(\\d+)', 1) AS INTEGER)"


@query(f"""WITH {i.CORPUS_SQL}, {i.OWNER_QUERIES_SQL}, {i.LABEL_QUERIES_SQL},
  named AS (SELECT owner AS query_id, embedding FROM owner_queries WHERE {NUMBER} % 3 <> 0),
  words AS (SELECT query_id, embedding FROM label_queries WHERE query_id < 2),
  {i.vector_hits_sql('by_name', 'named', 'corpus', 1)}, {i.vector_hits_sql('by_word', 'words', 'corpus', 1)}
SELECT query_id, query_id AS name, id, round(score, 6) AS score FROM by_name
UNION ALL SELECT o.owner, 'word ' || w.query_id, w.id, round(w.score, 6) FROM owner_queries o, by_word w WHERE {NUMBER} % 3 = 0""")
def nearest_law_by_broad_words(spark, sf):
    """Requests of which no name has a vector take the laws nearest to the broad words."""
    vector = F.when(F.regexp_extract("owner", r"(\d+)", 1).cast("int") % 3 != 0, F.col("embedding"))
    owners = i.owner_queries(spark, sf).filter("owner is not null")
    names = owners.select(F.col("owner").alias("query_id"), F.col("owner").alias("name"), vector.alias("embedding"))
    words = i.label_queries(spark, sf).filter("query_id < 2")
    broad = words.select(F.concat(F.lit("word "), F.col("query_id").cast("string")).alias("name"), "embedding")
    return r.nearest_law_per_name(names, i.corpus(spark, sf), broad).select("query_id", "name", "id", F.round("score", 6).alias("score"))


@query("""WITH asked AS (SELECT event_id AS request_id, 'src' || (user_id % 25) AS owner,
    unnest(CASE event_type WHEN 'view' THEN [NULL] WHEN 'click' THEN ['en', 'de', 'en'] WHEN 'error' THEN ['en', 'xx'] ELSE ['fr'] END) AS collection
  FROM events), owned AS (SELECT DISTINCT source AS owner, lang AS collection FROM documents)
SELECT request_id, a.owner, bool_and(o.owner IS NOT NULL OR a.collection IS NULL) AS valid
FROM asked a LEFT JOIN owned o ON o.owner = a.owner AND o.collection = a.collection GROUP BY request_id, a.owner""")
def validate_scope(spark, sf):
    kind = F.col("event_type")
    asked = (
        F.when(kind == "view", F.array().cast("array<string>"))
        .when(kind == "click", F.array(F.lit("en"), F.lit("de"), F.lit("en")))
        .when(kind == "error", F.array(F.lit("en"), F.lit("xx")))
        .otherwise(F.array(F.lit("fr")))
    )
    requests = table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("src"), F.pmod("user_id", F.lit(25)).cast("string")).alias("owner"), asked.alias("collections"),
    )
    owned = table(spark, sf, "documents").select(F.col("source").alias("owner"), F.col("lang").alias("collection"))
    return r.validate_scope(requests, owned)


@query(f"{FUSED} SELECT query_id, rank AS n, title, 0 AS chunk_index, md5(text) AS text_md5, round(score, 6) AS score FROM full_hits")
def reference_rows(spark, sf):
    rows = r.reference_rows(_hydrated(spark, sf))
    return rows.select("query_id", "n", "title", "chunk_index", F.md5("text").alias("text_md5"), F.round("score", 6).alias("score"))


CLEAN = "regexp_replace(regexp_replace(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{{9F}}]', '', 'g'), '(?m)^\\[(\\d{{1,4}})\\]', '［\\1］', 'g')"


@query(f"""{FUSED} SELECT query_id,
  md5(string_agg('[' || rank || '] (' || {CLEAN.format("title || ' / ' || collection")} || ')' || chr(10) || {CLEAN.format('text')}, chr(10) || chr(10) ORDER BY rank)) AS context_md5,
  chr(10) || chr(10) || '---' || chr(10) || '### 参考情報' || chr(10)
    || string_agg(rank || '. ' || title || ' / ' || collection, chr(10) ORDER BY rank) AS reference_list
FROM full_hits GROUP BY query_id""")
def context_text(spark, sf):
    out = r.context_text(_hydrated(spark, sf))
    return out.select("query_id", F.md5("context").alias("context_md5"), F.col("references").alias("reference_list"))


@query()
def ann_recall(spark, sf):
    """Recall of the cell search against the exact one, per number of probed cells."""
    asked, rows = i.label_queries(spark, sf), i.vectors(spark, sf)
    exact = materialize(r.vector_topk(asked, rows, 10))
    root = shared_dir(spark)
    v.build_cells(rows, root)
    out = None
    for probes in (1, 4, 16):
        part = v.recall_at_k(v.search_cells(asked, root, 10, probes), exact)
        part = part.withColumn("probes", F.lit(probes))
        out = part if out is None else out.unionByName(part)
    return out


# Rows in clusters: every vector is drawn close to one of forty, so the neighbours of a row are known to be together.
def _clustered(spark, sf):
    rows = table(spark, sf, "embeddings").filter("embedding is not null")
    centres = rows.select(F.col("vec_id").alias("centre"), F.col("embedding").alias("middle")).filter("centre < 40")
    near = rows.withColumn("centre", F.col("vec_id") % 40).join(centres, "centre")
    drawn = F.expr("zip_with(middle, embedding, (m, x) -> cast(m as double) + (vec_id % 97) / 1000D * cast(x as double))")
    return near.select(F.col("vec_id").alias("id"), drawn.alias("embedding"))


CLUSTERED_DUCK = """
clustered AS (
  SELECT a.vec_id AS id, list_transform(list_zip(b.embedding, a.embedding), lambda x: x[1]::DOUBLE + (a.vec_id % 97) / 1000.0::DOUBLE * x[2]::DOUBLE) AS embedding
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id % 40 WHERE a.embedding IS NOT NULL AND b.embedding IS NOT NULL),
near_queries AS (SELECT id AS query_id, embedding FROM clustered WHERE id % 8 = 0)
"""


@query(f"WITH {CLUSTERED_DUCK}, {i.vector_hits_sql('hits', 'near_queries', 'clustered', 10)} {HITS} hits")
def ann_topk_by_bound(spark, sf):
    """The cell search that goes on while a cell can still reach the k-th score finds what the exact search finds."""
    rows, root = _clustered(spark, sf), shared_dir(spark)
    v.build_cells(rows, root, cells=64)
    asked = rows.filter("id % 8 = 0").select(F.col("id").alias("query_id"), "embedding")
    return hits(v.search_cells(asked, root, 10, probes=2, by_bound=True))


@query(f"WITH {CLUSTERED_DUCK}, {i.vector_hits_sql('hits', 'near_queries', 'clustered', 10)} "
       "SELECT count(DISTINCT query_id) AS queries, count(*) AS expected, TRUE AS recalled, TRUE AS quarter FROM hits")
def ann_recall_in_clusters(spark, sf):
    """Two of 64 cells: at least 0.96 of the exact top 10, from at most a quarter of the rows."""
    rows, root = _clustered(spark, sf), shared_dir(spark)
    v.build_cells(rows, root, cells=64)
    asked = rows.filter("id % 8 = 0").select(F.col("id").alias("query_id"), "embedding")
    found, read = v.cells_read(asked, root, 10, probes=2)
    one = F.lit(1).alias("one")
    share = read.agg(F.sum("n").alias("read")).select("*", one).join(rows.agg(F.count("*").alias("rows")).select("*", one), "one")
    measured = v.recall_at_k(found, r.vector_topk(asked, rows, 10)).select("*", one).join(share, "one")
    return measured.select("queries", "expected", (F.col("recall") >= 0.96).alias("recalled"), (F.col("read") <= 0.25 * F.col("rows") * F.col("queries")).alias("quarter"))


@query(f"WITH {i.LABEL_QUERIES_SQL}, rows AS (SELECT vec_id AS id, embedding FROM embeddings), "
       f"{i.vector_hits_sql('hits', 'label_queries', 'rows', 10)} {HITS} hits")
def ann_topk_all_cells(spark, sf):
    """The cell search with every cell probed finds exactly what the exact search finds."""
    return hits(v.ann_topk(i.label_queries(spark, sf), i.vectors(spark, sf), 10, cells=16, probes=16))


@query(f"WITH {i.LABEL_QUERIES_SQL}, rows AS (SELECT vec_id AS id, embedding FROM embeddings), "
       f"{i.vector_hits_sql('hits', 'label_queries', 'rows', 10)} {HITS} hits")
def stored_cells_all(spark, sf):
    """The same over stored cells."""
    root = shared_dir(spark)
    v.build_cells(i.vectors(spark, sf), root)
    return hits(v.search_cells(i.label_queries(spark, sf), root, 10, probes=16))


def _index(spark, sf):
    return w.version_index(i.dwh(spark, sf), i.TODAY)


@query(f"WITH {i.INDEX_SQL} SELECT law_num, unique_anchor, law_id, is_future FROM idx "
       "WHERE NOT is_future AND law_num IN (SELECT 'L' || lpad(CAST(c_custkey AS STRING), 9, '0') FROM customer WHERE c_acctbal > 0)")
def articles_of_laws(spark, sf):
    laws = table(spark, sf, "customer").filter(F.col("c_acctbal") > 0)
    laws = laws.select(F.concat(F.lit("L"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("law_num"))
    return r.articles_of_laws(_index(spark, sf), laws).select("law_num", "unique_anchor", "law_id", "is_future")


@query(f"WITH {i.INDEX_SQL} SELECT law_num, unique_anchor, law_id, content, is_future FROM idx "
       "WHERE unique_anchor = 'Main_Article_2' AND law_num IN (SELECT 'L' || lpad(CAST(c_custkey AS STRING), 9, '0') FROM customer)")
def articles_by_key(spark, sf):
    law = F.concat(F.lit("L"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    keys = table(spark, sf, "customer").select(law.alias("law_num"), F.lit("Main_Article_2").alias("unique_anchor"))
    found = r.articles_by_key(_index(spark, sf), keys, include_future=True)
    return found.select("law_num", "unique_anchor", "law_id", "content", "is_future")
