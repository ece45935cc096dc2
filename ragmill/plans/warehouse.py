"""Warehouse queries over the versioned articles derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.functions import dates
from ragmill.operators import warehouse as w
from ragmill.plans import inputs as i
from ragmill.plans import query
from ragmill.session import shared_dir
from ragmill.sources import snapshots
from ragmill.tables import sql, table

LAST = f"DATE '{i.TODAY}'"

# A staging batch with copies: one row per line item, keyed by order and return flag.
STAGING_SQL = """
SELECT CAST(l_orderkey AS STRING) || '_20200101_1' AS law_id, 'Main_Article_' || l_returnflag AS unique_anchor,
  'N' || CAST(l_orderkey AS STRING) AS law_num, 'T' || CAST(l_orderkey AS STRING) AS law_title,
  CAST(l_partkey AS STRING) || '/' || l_linestatus AS content, l_linenumber * 10000000 + l_partkey AS load_no
FROM {lineitem}
"""


@query(f"""WITH s AS ({STAGING_SQL}) SELECT law_id, unique_anchor, max(content) AS content, max(load_no) AS load_no
FROM (SELECT *, rank() OVER (PARTITION BY law_id, unique_anchor ORDER BY load_no DESC) AS rn FROM s) WHERE rn = 1 GROUP BY law_id, unique_anchor""")
def dedup_staging(spark, sf):
    out = w.dedup_staging(sql(spark, sf, STAGING_SQL), tiebreak=("load_no", "content"))
    return out.select("law_id", "unique_anchor", "content", "load_no")


TARGET_SQL = """
SELECT CAST(o_orderkey AS STRING) || '_' || CASE WHEN o_orderstatus = 'P' THEN '20201399' ELSE '20200101' END || '_1' AS law_id,
  'Main_Article_1' AS unique_anchor, o_orderpriority AS content,
  'old ' || o_orderstatus AS law_title, 1 AS load_timestamp, CAST(NULL AS DATE) AS enforce_date
FROM {orders} WHERE o_orderstatus <> 'F'
"""
SOURCE_SQL = """
SELECT CAST(o_orderkey AS STRING) || '_' || CASE WHEN o_orderstatus = 'P' THEN '20201399' ELSE '20200101' END || '_1' AS law_id,
  'Main_Article_1' AS unique_anchor,
  CASE WHEN o_totalprice > 250000 THEN o_orderpriority || ' changed' ELSE o_orderpriority END AS content,
  'new ' || o_orderstatus AS law_title
FROM {orders} WHERE o_orderpriority <> '5-LOW'
"""


MERGED_SQL = f"""WITH t AS ({TARGET_SQL}), s AS ({SOURCE_SQL})
SELECT t.law_id, t.unique_anchor, CASE WHEN s.content <> t.content THEN s.content ELSE t.content END AS content,
  CASE WHEN s.content <> t.content THEN s.law_title ELSE t.law_title END AS law_title,
  CAST(CASE WHEN s.content <> t.content THEN 2 ELSE 1 END AS INTEGER) AS load_timestamp, t.enforce_date
FROM t LEFT JOIN s ON s.law_id = t.law_id
UNION ALL SELECT s.law_id, s.unique_anchor, s.content, s.law_title, 2,
  CAST(try_strptime(split_part(s.law_id, '_', 2), '%Y%m%d') AS DATE) FROM s WHERE s.law_id NOT IN (SELECT law_id FROM t)"""


@query(MERGED_SQL)
def merge_changed(spark, sf):
    return w.merge_changed(sql(spark, sf, TARGET_SQL), sql(spark, sf, SOURCE_SQL), F.lit(2))


@query(MERGED_SQL)
def merge_buckets(spark, sf):
    """The same in two loads on a table of key ranges, of which each load rewrites its own."""
    root, source = shared_dir(spark), sql(spark, sf, SOURCE_SQL)
    snapshots.write_buckets(sql(spark, sf, TARGET_SQL), root, "law_id", 16)
    for part in (source.filter("law_id < '3'"), source.filter("law_id >= '3'")):
        snapshots.merge_buckets(part, root, "law_id", lambda t, s: w.merge_changed(t, s, F.lit(2)))
    return snapshots.read_buckets(spark, root)


@query(f"""WITH dwh AS ({i.DWH_SQL}) SELECT law_id, CAST(try_strptime(split_part(law_id, '_', 2), '%Y%m%d') AS DATE) AS enforce_date FROM dwh""")
def enforce_date(spark, sf):
    return i.dwh(spark, sf).select("law_id", dates.enforce_date(F.col("law_id")).alias("enforce_date"))


@query(f"""WITH dwh AS ({i.DWH_SQL}), f AS (SELECT law_num, law_title, bool_or(unique_anchor LIKE 'Main\\_Article\\_%' ESCAPE '\\') AS has FROM dwh GROUP BY law_num, law_title)
SELECT law_num, law_title, promulgate_date FROM (SELECT d.*, row_number() OVER (PARTITION BY d.law_num
  ORDER BY f.has DESC, promulgate_date DESC NULLS LAST, load_no DESC, d.law_title) AS rn
  FROM dwh d JOIN f ON f.law_num = d.law_num AND f.law_title = d.law_title) WHERE rn = 1""")
def title_master(spark, sf):
    return w.title_master(i.dwh(spark, sf))


@query(f"WITH {i.INDEX_SQL} SELECT law_num, unique_anchor, law_id, enforce_date, is_future FROM idx")
def version_index(spark, sf):
    return w.version_index(i.dwh(spark, sf), i.TODAY).select("law_num", "unique_anchor", "law_id", "enforce_date", "is_future")


BODY = "trim(regexp_replace(content, '^[^\\n]*\\n', ''), ' 　' || chr(10) || chr(9))"


@query(f"WITH dwh AS ({i.DWH_SQL}) SELECT law_id, unique_anchor FROM dwh WHERE {BODY} <> '削除'")
def drop_deletion_stubs(spark, sf):
    return w.drop_deletion_stubs(i.dwh(spark, sf)).select("law_id", "unique_anchor")


@query(f"WITH dwh AS ({i.DWH_SQL}) SELECT law_id, unique_anchor FROM dwh WHERE unique_anchor <> 'Main_Provision' OR (contains(content, chr(10)) AND {BODY} <> '')")
def drop_empty_provision(spark, sf):
    return w.drop_empty_provision(i.dwh(spark, sf)).select("law_id", "unique_anchor")


@query(f"""WITH {i.INDEX_SQL} SELECT law_num, unique_anchor, law_id, content, is_future FROM idx
WHERE {BODY} <> '削除' AND (unique_anchor <> 'Main_Provision' OR (contains(content, chr(10)) AND {BODY} <> ''))""")
def search_index(spark, sf):
    return w.search_index(i.dwh(spark, sf), i.TODAY).select("law_num", "unique_anchor", "law_id", "content", "is_future")


# The next load: every article of orders that are not urgent.
NEW_KEYS_SQL = f"SELECT law_id, unique_anchor FROM ({i.DWH_SQL}) d WHERE article_summary <> '1-URGENT'"


@query(f"WITH dwh AS ({i.DWH_SQL}) SELECT law_id, unique_anchor FROM dwh WHERE (law_id, unique_anchor) IN ({NEW_KEYS_SQL})")
def prune_missing(spark, sf):
    return w.prune_missing(i.dwh(spark, sf), sql(spark, sf, NEW_KEYS_SQL)).select("law_id", "unique_anchor")


@query(f"""WITH dwh AS ({i.DWH_SQL}) SELECT law_title, count(*) AS deleted_rows FROM dwh
WHERE (law_id, unique_anchor) NOT IN ({NEW_KEYS_SQL}) GROUP BY law_title ORDER BY deleted_rows DESC, law_title""")
def deleted_report(spark, sf):
    return w.deleted_report(i.dwh(spark, sf), sql(spark, sf, NEW_KEYS_SQL))


TURNS_SQL = """
SELECT CAST(conv_id AS STRING) || '/' || CAST(turn AS STRING) AS id, text AS content, role,
  CASE WHEN role = 'user' THEN md5(text) END AS embedding FROM {conversations}
"""


@query(f"WITH t AS ({TURNS_SQL}) SELECT md5(content) AS text_md5, arg_min(embedding, id) AS embedding FROM t WHERE embedding IS NOT NULL GROUP BY md5(content)")
def stash_vectors(spark, sf):
    return w.stash_vectors(sql(spark, sf, TURNS_SQL))


@query(f"""WITH t AS ({TURNS_SQL}), s AS (SELECT DISTINCT md5(content) AS h, embedding AS e FROM t WHERE embedding IS NOT NULL)
SELECT id, role, coalesce(embedding, e) AS embedding FROM t LEFT JOIN s ON md5(content) = h""")
def restore_vectors(spark, sf):
    turns = sql(spark, sf, TURNS_SQL)
    return w.restore_vectors(turns, w.stash_vectors(turns)).select("id", "role", "embedding")


TARGETS_SQL = f"t AS ({TURNS_SQL}), d AS (SELECT doc_id, embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"


def _targets(spark, sf):
    return {"documents": i.corpus(spark, sf).select("embedding"), "turns": sql(spark, sf, TURNS_SQL)}


@query(f"WITH {TARGETS_SQL} SELECT 'documents' AS target, CAST(count_if(embedding IS NULL) AS BIGINT) AS pending FROM d UNION ALL SELECT 'turns', CAST(count_if(embedding IS NULL) AS BIGINT) FROM t")
def pending_counts(spark, sf):
    return w.pending_counts(_targets(spark, sf))


@query(f"""WITH {TARGETS_SQL} SELECT 'documents' AS target, count(*) AS total, count(embedding) AS filled, count(*) - count(embedding) AS still_null FROM d
UNION ALL SELECT 'turns', count(*), count(embedding), count(*) - count(embedding) FROM t""")
def fill_status(spark, sf):
    return w.fill_status(_targets(spark, sf))


@query(f"""WITH dwh AS ({i.DWH_SQL}) SELECT law_num, law_title, count(*) AS changed_rows FROM dwh
WHERE md5(content) NOT IN (SELECT md5(content) FROM dwh WHERE law_type = 'F') GROUP BY law_num, law_title""")
def changed_report(spark, sf):
    articles = i.dwh(spark, sf)
    known = articles.filter(F.col("law_type") == "F").select(F.md5("content").alias("text_md5")).distinct()
    return w.changed_report(articles, known)


@query(f"""WITH dwh AS ({i.DWH_SQL}), keys AS (SELECT DISTINCT law_num, unique_anchor FROM dwh WHERE law_type = 'O'),
v AS (SELECT d.* FROM dwh d JOIN keys k ON k.law_num = d.law_num AND k.unique_anchor = d.unique_anchor WHERE enforce_date IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY law_num, unique_anchor ORDER BY enforce_date DESC, law_id DESC) AS rn FROM v WHERE enforce_date <= DATE '1998-06-30')
SELECT b.law_num, b.unique_anchor, b.law_id, b.content, b.enforce_date, n.next_enforce_date, b.enforce_date > {LAST} AS is_future
FROM best b LEFT JOIN (SELECT law_num, unique_anchor, min(enforce_date) AS next_enforce_date FROM v WHERE enforce_date > DATE '1998-06-30' GROUP BY law_num, unique_anchor) n
  ON n.law_num = b.law_num AND n.unique_anchor = b.unique_anchor WHERE rn = 1""")
def resolve_as_of(spark, sf):
    articles = i.dwh(spark, sf)
    keys = articles.filter(F.col("law_type") == "O")
    return w.resolve_as_of(keys, articles, "1998-06-30", i.TODAY).select(
        "law_num", "unique_anchor", "law_id", "content", "enforce_date", "next_enforce_date", "is_future"
    )


@query(f"""WITH dwh AS ({i.DWH_SQL}), req AS (SELECT law_id AS request_id, law_num, unique_anchor, promulgate_date AS as_of FROM dwh WHERE promulgate_date IS NOT NULL),
v AS (SELECT law_num, unique_anchor, enforce_date, max(law_id) AS law_id FROM dwh WHERE enforce_date IS NOT NULL GROUP BY law_num, unique_anchor, enforce_date),
m AS (SELECT r.request_id, r.as_of, v.law_id, v.enforce_date, row_number() OVER (PARTITION BY r.request_id ORDER BY v.enforce_date DESC) AS rn
  FROM req r JOIN v ON v.law_num = r.law_num AND v.unique_anchor = r.unique_anchor AND v.enforce_date <= r.as_of),
n AS (SELECT r.request_id, min(v.enforce_date) AS next_enforce_date FROM req r JOIN v ON v.law_num = r.law_num AND v.unique_anchor = r.unique_anchor AND v.enforce_date > r.as_of GROUP BY r.request_id)
SELECT m.request_id, m.as_of, m.law_id, m.enforce_date, n.next_enforce_date FROM m LEFT JOIN n ON n.request_id = m.request_id WHERE rn = 1""")
def resolve_as_of_each(spark, sf):
    articles = i.dwh(spark, sf)
    asked = articles.filter(F.col("promulgate_date").isNotNull()).select(
        F.col("law_id").alias("request_id"), "law_num", "unique_anchor", F.col("promulgate_date").alias("as_of")
    )
    return w.resolve_as_of_each(asked, articles).select("request_id", "as_of", "law_id", "enforce_date", "next_enforce_date")


STATUS_SQL = f"""{i.INDEX_SQL}, status AS (SELECT law_num, max(law_title) AS law_title,
  count_if(unique_anchor LIKE 'Main\\_Article\\_%' ESCAPE '\\' AND NOT is_future) AS current_main_articles,
  count_if(unique_anchor LIKE 'Main\\_Article\\_%' ESCAPE '\\' AND is_future) AS future_main_articles,
  min(CASE WHEN unique_anchor LIKE 'Main\\_Article\\_%' ESCAPE '\\' AND is_future THEN enforce_date END) AS earliest_future_enforce_date,
  max(CASE WHEN unique_anchor = 'Suppl_Article_1' THEN content END) AS enforcement_clause FROM idx GROUP BY law_num)"""


@query(f"""WITH {STATUS_SQL} SELECT law_num, law_title, CAST(current_main_articles AS BIGINT) AS current_main_articles,
  CAST(future_main_articles AS BIGINT) AS future_main_articles, earliest_future_enforce_date, enforcement_clause FROM status""")
def enforcement_status(spark, sf):
    return w.enforcement_status(w.version_index(i.dwh(spark, sf), i.TODAY))


@query(f"WITH {STATUS_SQL} SELECT law_num, CASE WHEN current_main_articles > 0 OR future_main_articles = 0 THEN 'current' ELSE 'pending' END AS verdict FROM status")
def classify_enforcement(spark, sf):
    status = w.enforcement_status(w.version_index(i.dwh(spark, sf), i.TODAY))
    return w.classify_enforcement(status).select("law_num", "verdict")


FAR_DATE = "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INT) * 365"


@query(f"""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN {FAR_DATE} END AS d FROM orders)
SELECT o_orderkey, CASE WHEN d IS NULL THEN '' WHEN year(d) >= 2100 THEN '施行日未定（政令委任等）' ELSE CAST(d AS VARCHAR) END AS label FROM d""")
def format_enforce_date(spark, sf):
    far = F.date_add(F.col("o_orderdate").cast("date"), (F.pmod("o_orderkey", F.lit(200)) * 365).cast("int"))
    day = F.when(F.col("o_orderstatus") != "P", far)
    return table(spark, sf, "orders").select("o_orderkey", dates.format_enforce_date(day).alias("label"))


DOCS_SQL = "SELECT doc_id, source AS owner, CASE WHEN lang = 'en' THEN source || '/en' END AS collection_id FROM {documents}"
COLLECTIONS_SQL = "SELECT DISTINCT source || '/' || lang AS collection_id, source AS owner, CASE WHEN lang = 'de' AND source < 'src2' THEN 'default' ELSE lang END AS name FROM {documents}"
BACKFILL_SQL = f"""d AS ({DOCS_SQL}), c AS ({COLLECTIONS_SQL}),
allc AS (SELECT * FROM c UNION ALL SELECT o.owner || '/default', o.owner, 'default' FROM (SELECT DISTINCT owner FROM d WHERE collection_id IS NULL) o
  WHERE o.owner NOT IN (SELECT owner FROM c WHERE name = 'default'))"""


def _backfilled(spark, sf):
    return w.backfill_default_collection(sql(spark, sf, DOCS_SQL), sql(spark, sf, COLLECTIONS_SQL), "default")


@query(f"WITH {BACKFILL_SQL} SELECT collection_id, owner, name FROM allc")
def backfill_collections(spark, sf):
    return _backfilled(spark, sf)[0]


@query(f"""WITH {BACKFILL_SQL} SELECT doc_id, d.owner, coalesce(d.collection_id, a.collection_id) AS collection_id
FROM d LEFT JOIN allc a ON a.owner = d.owner AND a.name = 'default'""")
def backfill_documents(spark, sf):
    return _backfilled(spark, sf)[1]
