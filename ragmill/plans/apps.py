"""Application-table queries: nations stand for teams, customers for members, parts for apps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.operators import apps as a
from ragmill.operators import attachments as att
from ragmill.operators import paging as p
from ragmill.operators import storage as st
from ragmill.plans import query
from ragmill.session import shared_dir
from ragmill.tables import sql, table

TEAMS_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS name FROM {nation}"
USERS_SQL = "SELECT CAST(c_nationkey AS BIGINT) AS team_id, c_custkey AS user_id, c_acctbal > 9000 AS is_admin FROM {customer}"
APPS_SQL = """SELECT p_partkey % 26 AS team_id, p_partkey AS app_id, p_name AS name, CASE WHEN p_size % 3 > 0 THEN p_type END AS description,
  CASE CAST(p_size % 4 AS INT) WHEN 0 THEN chr(123) || '"endpoint":"https://' || p_type || '","copyable":true,"status":"published"' || chr(125)
    WHEN 1 THEN chr(123) || '"endpoint":"https://x","systemPrompt":"' || p_name || '","status":"other"' || chr(125) WHEN 2 THEN chr(123) || chr(125) ELSE NULL END AS config,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-02-01 00:00:00' AS updated_at FROM {part}"""


def _teams(spark, sf):
    return sql(spark, sf, TEAMS_SQL)


def _users(spark, sf):
    return sql(spark, sf, USERS_SQL)


def _apps(spark, sf):
    return sql(spark, sf, APPS_SQL)


@query("""WITH top AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts DESC, event_id) AS rn FROM events
  WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-20 00:00:00')
SELECT event_id, CASE WHEN rn = 100 AND EXISTS (SELECT 1 FROM top WHERE rn = 101) THEN TRUE ELSE FALSE END AS more FROM top WHERE rn <= 100""")
def keyset_page(spark, sf):
    """The page of clicks after a cursor."""
    import datetime

    clicks = table(spark, sf, "events").filter(F.col("event_type") == "click")
    page = p.keyset_page(clicks, "ts", "event_id", (datetime.datetime(2024, 1, 20), 2**62))
    return page.select("event_id", F.col("next_cursor").isNotNull().alias("more"))


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank FROM events),
g AS (SELECT *, (rank - 1) // 100 + 1 AS page FROM r)
SELECT g.event_id, g.event_type, g.rank, CAST(g.page AS BIGINT) AS page, base64(encode(CAST(e.event_id AS VARCHAR))) AS cursor
FROM g LEFT JOIN g e ON e.event_type = g.event_type AND e.rank = (g.page - 1) * 100""")
def paginate_all(spark, sf):
    pages = p.paginate_all(table(spark, sf, "events"), ["event_type"], -F.unix_micros(F.col("ts").cast("timestamp")), "event_id")
    return pages.select("event_id", "event_type", "rank", "page", "cursor")


@query("SELECT page_id, base64(encode(url)) AS cursor, url AS back FROM pages")
def cursors(spark, sf):
    cursor = p.encode_cursor(F.col("url"))
    return table(spark, sf, "pages").select("page_id", cursor.alias("cursor"), p.decode_cursor(cursor).alias("back"))


@query("""SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def list_with_counts(spark, sf):
    parents = table(spark, sf, "customer").select("c_custkey", "c_name")
    children = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return a.list_with_counts(parents, children, "c_custkey", F.col("c_name"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'rin')")
def name_contains(spark, sf):
    return a.name_contains(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "RIN")


@query(f"WITH t AS ({TEAMS_SQL}), u AS ({USERS_SQL}) SELECT team_id, name FROM t WHERE team_id IN (SELECT team_id FROM u WHERE is_admin AND user_id = (SELECT min(c_custkey) FROM customer WHERE c_acctbal > 9000))")
def admin_scope(spark, sf):
    users = _users(spark, sf)
    first = users.filter("is_admin").agg(F.min("user_id")).scalar()
    return a.admin_scope(_teams(spark, sf), users, first)


@query(f"""WITH t AS ({TEAMS_SQL}), u AS (SELECT * FROM ({USERS_SQL}) WHERE user_id = (SELECT max(c_custkey) FROM customer)), a AS ({APPS_SQL}), s AS (SELECT team_id, user_id FROM u UNION SELECT 0, user_id FROM u)
SELECT s.user_id, s.team_id, a.app_id, t.name AS team_name FROM s JOIN a ON a.team_id = s.team_id JOIN t ON t.team_id = s.team_id""")
def visible_apps(spark, sf):
    """The list of the newest user."""
    users = _users(spark, sf)
    newest = users.filter(F.col("user_id") == users.agg(F.max("user_id")).scalar())
    return a.visible_apps(newest, _teams(spark, sf), _apps(spark, sf), 0).select("user_id", "team_id", "app_id", "team_name")


@query(f"""WITH t AS ({TEAMS_SQL}), u AS ({USERS_SQL}), n AS (SELECT t.team_id, count(p_partkey) AS n FROM t LEFT JOIN part ON p_partkey % 26 = t.team_id GROUP BY t.team_id), s AS (SELECT team_id, user_id FROM u UNION SELECT 0, user_id FROM u)
SELECT s.user_id, count(*) AS teams, CAST(sum(n) AS BIGINT) AS apps FROM s JOIN n ON n.team_id = s.team_id GROUP BY s.user_id""")
def visible_app_counts(spark, sf):
    return a.visible_app_counts(_users(spark, sf), _teams(spark, sf), _apps(spark, sf), 0)


OPERATIONS_SQL = "SELECT o_orderkey AS op_id, o_custkey % 25 AS team_id, o_custkey AS user_id, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'demote' END AS action FROM {orders}"


@query(f"""WITH o AS ({OPERATIONS_SQL}), u AS ({USERS_SQL}), n AS (SELECT team_id, count_if(is_admin) AS n FROM u GROUP BY team_id)
SELECT op_id, CASE WHEN u.user_id IS NULL THEN 'not_found' WHEN coalesce(n, 0) < 2 AND ((action = 'delete' AND is_admin) OR action = 'demote') THEN 'last_admin' ELSE 'ok' END AS outcome
FROM o LEFT JOIN u ON u.team_id = o.team_id AND u.user_id = o.user_id LEFT JOIN n ON n.team_id = o.team_id""")
def last_admin_guard(spark, sf):
    return a.last_admin_guard(_users(spark, sf), sql(spark, sf, OPERATIONS_SQL)).select("op_id", "outcome")


GROUPS = "CASE CAST(op_id % 3 AS INT) WHEN 0 THEN array('SystemAdminGroup') WHEN 1 THEN array('TeamAdminGroup', 'x') ELSE array('x') END"


@query(f"""WITH o AS ({OPERATIONS_SQL}), u AS ({USERS_SQL}) SELECT op_id, op_id % 3 = 0 OR (op_id % 3 = 1 AND coalesce(is_admin, FALSE)) AS admin_ok, op_id % 3 = 0 OR is_admin IS NOT NULL AS member_ok
FROM o LEFT JOIN u ON u.team_id = o.team_id AND u.user_id = o.user_id""")
def access_check(spark, sf):
    requests = sql(spark, sf, OPERATIONS_SQL).withColumn("groups", F.expr(GROUPS))
    return a.access_check(requests, _users(spark, sf)).select("op_id", "admin_ok", "member_ok")


CONFIG_COLS = """CASE p_size % 4 WHEN 0 THEN 'https://' || p_type WHEN 1 THEN 'https://x' ELSE '' END AS endpoint, CASE WHEN p_size % 4 = 1 THEN p_name ELSE '' END AS system_prompt,
  p_size % 4 = 0 AS copyable, CASE WHEN p_size % 4 = 0 THEN 'published' ELSE 'draft' END AS status"""


@query(f"SELECT p_partkey AS app_id, {CONFIG_COLS} FROM part")
def unpack_config(spark, sf):
    c = a.unpack_config(F.col("config"))
    return _apps(spark, sf).select("app_id", c["endpoint"].alias("endpoint"), c["systemPrompt"].alias("system_prompt"), c["copyable"].alias("copyable"), c["status"].alias("status"))


@query("""SELECT p_partkey AS app_id, p_name AS app_name, '' AS endpoint, '' AS systemPrompt, CASE WHEN p_size % 3 > 0 THEN p_type ELSE '' END AS description, '' AS api_key,
  CASE WHEN p_size % 4 = 0 THEN 'published' ELSE 'draft' END AS status, '1704067200000' AS created_date FROM part""")
def app_view_light(spark, sf):
    return a.app_view(_apps(spark, sf), light=True).select(
        "app_id", "app_name", "endpoint", "systemPrompt", "description", "api_key", "status", "created_date"
    )


@query(f"WITH c AS (SELECT p_partkey AS app_id, {CONFIG_COLS} FROM part) SELECT app_id, endpoint, system_prompt, '1706745600000' AS updated_date FROM c")
def app_view_full(spark, sf):
    return a.app_view(_apps(spark, sf), light=False).select("app_id", "endpoint", F.col("systemPrompt").alias("system_prompt"), "updated_date")


PATCH_SQL = """SELECT p_partkey % 26 AS team_id, p_partkey AS app_id, TRUE AS p_present, CASE WHEN p_size % 2 = 0 THEN 'new' ELSE '' END AS p_endpoint, CAST(NULL AS STRING) AS p_config, CAST(NULL AS STRING) AS p_placeholder, 'how' AS p_howToUse,
  CAST(NULL AS STRING) AS p_systemPrompt, CASE WHEN p_size % 5 = 0 THEN 'key' END AS p_systemPromptKeyName, CASE WHEN p_size % 7 = 0 THEN FALSE END AS p_copyable, CASE WHEN p_size % 3 = 0 THEN 'published' ELSE 'bad' END AS p_status,
  CASE WHEN p_size % 2 = 1 THEN 'renamed' END AS p_name, '' AS p_description FROM {part} WHERE p_brand <> 'Brand#1'"""


@query(f"""WITH c AS (SELECT *, {CONFIG_COLS} FROM part)
SELECT p_partkey AS app_id, CASE WHEN p_brand <> 'Brand#1' AND p_size % 2 = 1 THEN 'renamed' ELSE p_name END AS name, CASE WHEN p_size % 3 > 0 THEN p_type END AS description,
  CASE WHEN p_brand <> 'Brand#1' THEN chr(123) || '"endpoint":"' || CASE WHEN p_size % 2 = 0 THEN 'new' ELSE endpoint END || '","config":"","placeholder":"","systemPrompt":"","systemPromptKeyName":"' || CASE WHEN p_size % 5 = 0 THEN 'key' ELSE '' END
    || '","howToUse":"how","copyable":' || CASE WHEN p_size % 7 = 0 THEN 'false' ELSE CAST(copyable AS VARCHAR) END || ',"status":"' || CASE WHEN p_size % 3 = 0 THEN 'published' ELSE status END || '"' || chr(125)
  WHEN p_size % 4 = 0 THEN chr(123) || '"endpoint":"https://' || p_type || '","copyable":true,"status":"published"' || chr(125) WHEN p_size % 4 = 1 THEN chr(123) || '"endpoint":"https://x","systemPrompt":"' || p_name || '","status":"other"' || chr(125) WHEN p_size % 4 = 2 THEN chr(123) || chr(125) END AS config FROM c""")
def patch_apps(spark, sf):
    return a.patch_apps(_apps(spark, sf), sql(spark, sf, PATCH_SQL)).select("app_id", "name", "description", "config")


COPY_SQL = """SELECT l_orderkey * 100 + l_linenumber AS request_id, l_partkey % 26 AS team_id, l_partkey + l_linenumber % 2 AS app_id, 'copy' AS name, chr(123) || '"endpoint":"mine","placeholder":"' || l_returnflag || '"' || chr(125) AS config FROM {lineitem}"""


@query(f"""WITH r AS ({COPY_SQL}), x AS (SELECT *, {CONFIG_COLS} FROM part), t AS (SELECT n_nationkey FROM nation), k AS (SELECT p_partkey FROM part WHERE p_brand <> 'Brand#2')
SELECT request_id, r.app_id, CASE WHEN r.team_id NOT IN (SELECT n_nationkey FROM t) THEN 'no_team' WHEN x.p_partkey IS NULL THEN 'no_app' WHEN NOT x.copyable THEN 'not_copyable'
  WHEN r.app_id NOT IN (SELECT p_partkey FROM k) THEN 'no_key' ELSE 'ok' END AS outcome,
  CASE WHEN r.team_id IN (SELECT n_nationkey FROM t) AND x.copyable AND r.app_id IN (SELECT p_partkey FROM k) THEN x.endpoint || '/' || json_extract_string(r.config, '$.placeholder') END AS made
FROM r LEFT JOIN x ON x.p_partkey = r.app_id AND x.p_partkey % 26 = r.team_id""")
def copy_apps(spark, sf):
    keys = table(spark, sf, "part").filter("p_brand <> 'Brand#2'").select((F.col("p_partkey") % 26).alias("team_id"), F.col("p_partkey").alias("app_id"))
    out = a.copy_apps(sql(spark, sf, COPY_SQL), _teams(spark, sf), _apps(spark, sf), keys)
    field = lambda f: F.get_json_object("config", f"$.{f}")
    made = F.when(F.col("config").isNotNull(), F.concat_ws("/", field("endpoint"), field("placeholder")))
    return out.select("request_id", "app_id", "outcome", made.alias("made"))


DELETED = "c_mktsegment = 'BUILDING'"


def _cascade(spark, sf):
    collections = table(spark, sf, "customer").select(F.col("c_custkey").alias("collection_id"), "c_mktsegment")
    documents = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("document_id"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("k/"), F.col("o_orderkey").cast("string"))).alias("bronze_key"),
    )
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber", "l_partkey", "l_suppkey")
    return a.cascade_delete(collections.filter(DELETED), collections, documents, chunks)


@query("SELECT l_orderkey AS document_id, count(*) AS chunks FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING') GROUP BY l_orderkey")
def cascade_delete(spark, sf):
    return _cascade(spark, sf)[2].groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))


@query("SELECT 'k/' || o_orderkey AS bronze_key FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus <> 'P'")
def deleted_object_keys(spark, sf):
    return _cascade(spark, sf)[3]


@query(f"""WITH t AS ({TEAMS_SQL}), a AS ({APPS_SQL}), i AS (SELECT l_orderkey, l_linenumber, l_partkey % 26 AS team_id, l_partkey AS app_id FROM lineitem)
SELECT i.l_orderkey, i.l_linenumber, i.app_id, t.name AS team_name_snapshot, a.name AS app_name_snapshot FROM i JOIN a ON a.team_id = i.team_id AND a.app_id = i.app_id JOIN t ON t.team_id = i.team_id""")
def snapshot_names(spark, sf):
    calls = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 26).alias("team_id"), F.col("l_partkey").alias("app_id"))
    return a.snapshot_names(calls, _teams(spark, sf), _apps(spark, sf)).drop("team_id")


HISTORY_SQL = """SELECT event_id, ts AS created_date, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'success' WHEN 'error' THEN 'error' ELSE 'odd' END AS status,
  CASE CAST(event_id % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '"plain ' || event_type || '"' WHEN 2 THEN '[1,2]'
    WHEN 3 THEN chr(123) || '"outputs":"' || event_type || '","artifacts":[' || chr(123) || '"displayName":"a","s3Url":"s3://b/' || CAST(event_id AS STRING) || '"' || chr(125) || ',' || chr(123) || '"displayName":1,"s3Url":"x"' || chr(125) || ',7]' || chr(125)
    ELSE chr(123) || '"outputs":null,"artifacts":[]' || chr(125) END AS outputs FROM {events}"""


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'IN_PROGRESS' WHEN 'click' THEN 'COMPLETED' WHEN 'error' THEN 'ERROR' ELSE 'ACCEPTED' END AS status,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'plain ' || event_type WHEN 2 THEN '[1,2]' WHEN 3 THEN event_type ELSE '' END AS outputs,
  CASE WHEN event_id % 5 = 3 THEN 'a=s3://b/' || event_id END AS artifacts, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS created_date FROM events""")
def history_view(spark, sf):
    out = a.history_view(sql(spark, sf, HISTORY_SQL))
    shown = F.array_join(F.transform("artifacts", lambda x: F.concat_ws("=", x["display_name"], x["s3_url"])), ",")
    return out.select("event_id", "status", "outputs", shown.alias("artifacts"), "created_date")


MESSAGES_SQL = """SELECT conv_id AS chat_id, CAST(turn AS INT) AS pos, CASE WHEN turn % 2 = 0 THEN CAST(1700000000000 + turn AS STRING) || '#1' END AS created_date, 'u' || CAST(conv_id AS STRING) AS user_id, role,
  text AS content, 'm' || CAST(turn AS STRING) AS message_id, 'chat' AS usecase, CASE WHEN role = 'system' THEN 'tr' END AS trace, CASE WHEN role = 'assistant' THEN 'big' END AS llm_type FROM {conversations}"""
NOW_MS = 1700000001000


@query(f"""SELECT chat_id, CASE WHEN created_date IS NULL THEN CAST({NOW_MS} + pos AS VARCHAR) || '#0' ELSE created_date END AS created_date, user_id, role, md5(content) AS content_md5, message_id, trace, coalesce(llm_type, '') AS llm_type,
  'none' AS feedback, '2024-11-12' AS expires FROM ({MESSAGES_SQL})""")
def pack_messages(spark, sf):
    out = a.pack_messages(sql(spark, sf, MESSAGES_SQL), NOW_MS)
    field = lambda f: F.get_json_object("content", f"$.{f}")
    return out.select(
        "chat_id", "created_date", "user_id", "role", F.md5(field("content")).alias("content_md5"), field("messageId").alias("message_id"),
        field("trace").alias("trace"), "llm_type", "feedback", F.date_format("expire_at", "yyyy-MM-dd").alias("expires"),
    )


@query(f"""SELECT 'chat#' || chat_id AS id, CASE WHEN created_date IS NULL THEN CAST({NOW_MS} + pos AS VARCHAR) || '#0' ELSE created_date END AS created_date, message_id, usecase, user_id, 'none' AS feedback, role, md5(content) AS content_md5, trace, coalesce(llm_type, '') AS llm_type FROM ({MESSAGES_SQL})""")
def unpack_messages(spark, sf):
    out = a.unpack_messages(a.pack_messages(sql(spark, sf, MESSAGES_SQL), NOW_MS))
    return out.withColumn("content_md5", F.md5("content")).drop("content", "extra_data")


@query("SELECT conv_id, turn, role FROM conversations WHERE role <> 'system' ORDER BY conv_id, turn")
def conversation(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return p.oldest_first(rows, F.col("role") != "system", "turn")


@query("SELECT event_id, strftime(ts + INTERVAL 364 DAYS, '%Y-%m-%d %H:%M:%S') AS expire_at FROM events WHERE ts + INTERVAL 364 DAYS >= TIMESTAMP '2025-01-15 00:00:00'")
def purge_expired(spark, sf):
    rows = table(spark, sf, "events").select("event_id", a.expire_at(F.col("ts")).alias("expire_at"))
    kept = a.purge_expired(rows, F.lit("2025-01-15 00:00:00").cast("timestamp"))
    return kept.select("event_id", F.date_format("expire_at", "yyyy-MM-dd HH:mm:ss").alias("expire_at"))


KEYS_SQL = """SELECT event_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN CAST(user_id AS STRING) || '/a/f.txt' WHEN 1 THEN CAST(user_id AS STRING) || '/f' WHEN 2 THEN '/a/f' WHEN 3 THEN CAST(user_id AS STRING) || '/../x/f'
  WHEN 4 THEN 'other/a/f' ELSE CAST(user_id AS STRING) || '/a//f' END AS object_key, CAST(user_id AS STRING) AS owner FROM {events}"""


@query(f"WITH k AS ({KEYS_SQL}) SELECT event_id, nullif(split_part(object_key, '/', 1), '') AS key_owner, event_id % 6 = 0 AS owned FROM k")
def owned_keys(spark, sf):
    return sql(spark, sf, KEYS_SQL).select("event_id", st.key_owner(F.col("object_key")).alias("key_owner"), st.owned_key(F.col("object_key"), F.col("owner")).alias("owned"))


STORED_SQL = """SELECT event_id, CAST(user_id AS STRING) AS user_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 's3://bucket/' || CAST(user_id AS STRING) || '/a+b%20c' WHEN 1 THEN 'https://bucket.s3.x.amazonaws.com/' || CAST(user_id AS STRING) || '/f'
  WHEN 2 THEN 's3://other/' || CAST(user_id AS STRING) || '/f' WHEN 3 THEN 'ftp://bucket/x' WHEN 4 THEN 's3://bucket//f' ELSE 's3://bucket/zz/f' END AS url FROM {events}"""


@query("""SELECT event_id, CASE event_id % 6 WHEN 3 THEN NULL WHEN 2 THEN 'other' ELSE 'bucket' END AS bucket,
  CASE event_id % 6 WHEN 0 THEN user_id || '/a+b%20c' WHEN 1 THEN user_id || '/f' WHEN 2 THEN user_id || '/f' WHEN 3 THEN NULL WHEN 4 THEN '/f' ELSE 'zz/f' END AS object_key,
  CASE event_id % 6 WHEN 3 THEN 'bad_url' WHEN 2 THEN 'foreign_bucket' WHEN 4 THEN 'bad_path' WHEN 5 THEN 'foreign_owner' ELSE 'ok' END AS outcome FROM events""")
def storage_urls(spark, sf):
    parsed = st.parse_storage_url(F.col("url"))
    return sql(spark, sf, STORED_SQL).select(
        "event_id", parsed["bucket"].alias("bucket"), parsed["key"].alias("object_key"),
        st.authorize_url(F.col("url"), F.col("user_id"), "bucket").alias("outcome"),
    )


INPUTS_SQL = "SELECT doc_id AS user_id, lang AS team_id, source AS app_id, TIMESTAMP '2024-01-01 00:00:00' AS created_date, text AS inputs FROM {documents}"


def _inputs(spark, sf):
    return sql(spark, sf, INPUTS_SQL).withColumn("inputs", F.to_json(F.struct(F.col("inputs").alias("q"))))


@query("""WITH d AS (SELECT *, strlen(CAST(to_json(struct_pack(q := text)) AS VARCHAR)) > 4096 AS moved, md5(lang || chr(31) || source || chr(31) || doc_id || chr(31) || '2024-01-01 00:00:00') AS h FROM documents)
SELECT doc_id AS user_id, lang AS team_id, moved, CASE WHEN moved THEN chr(123) || '"__inputsRef":"s3://inputs/inputs/' || lang || '/' || source || '/' || doc_id || '/' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '.json"' || chr(125) END AS marker FROM d""")
def offload_large(spark, sf):
    rows, payloads = st.offload_large(_inputs(spark, sf), "inputs", 4096)
    moved = F.contains("inputs", F.lit(st.MARKER))
    return rows.select("user_id", "team_id", moved.alias("moved"), F.when(moved, F.col("inputs")).alias("marker"))


@query("SELECT doc_id AS user_id, md5(text) AS text_md5 FROM documents")
def rehydrate(spark, sf):
    """Offloaded inputs, written beside the table, come back as they were."""
    rows, payloads = st.offload_large(_inputs(spark, sf), "inputs", 4096)
    side = shared_dir(spark) + "/payloads"
    payloads.write.parquet(side)
    back = st.rehydrate(rows, spark.read.parquet(side), "inputs")
    return back.select("user_id", F.md5(F.get_json_object("inputs", "$.q")).alias("text_md5"))


BODY_SQL = """SELECT page_id AS user_id, 'app' AS app_id, TIMESTAMP '2024-01-01 00:00:00' AS created_date, html, url FROM {pages}"""


@query("""WITH b AS (SELECT page_id, html, url FROM pages)
SELECT page_id AS user_id, 0 AS idx, url AS display_name, page_id || '/app/1704067200000/0-' || substr(regexp_replace(url, '[^A-Za-z0-9_.\\-]+', '_', 'g'), 1, 120) AS storage_key, md5(html) AS content_md5 FROM b
UNION ALL SELECT page_id, 2, 'artifact-2', page_id || '/app/1704067200000/2-artifact-2', md5(html) FROM b
UNION ALL SELECT page_id, NULL, 'outputs.txt', page_id || '/app/1704067200000/outputs.txt', md5(html) FROM b WHERE strlen(html) > 8000""")
def explode_artifacts(spark, sf):
    """Results with a named artifact, a broken one, an unnamed one, and the page as output."""
    rows = sql(spark, sf, BODY_SQL)
    encoded = F.base64(F.encode("html", "utf-8"))
    item = lambda *cols: F.to_json(F.struct(*cols))
    parts = F.concat_ws(
        ",", item(F.col("url").alias("display_name"), encoded.alias("contents")), F.lit('"text"'),
        item(F.lit(1).alias("contents")), item(encoded.alias("contents")),
    )
    body = F.concat(F.lit('{"outputs":'), F.to_json(F.array("html")), F.lit(',"artifacts":['), parts, F.lit("]}"))
    body = F.regexp_replace(body, r'^\{"outputs":\[(.*)\],"artifacts":', r'{"outputs":$1,"artifacts":')
    out = st.explode_artifacts(rows.withColumn("body", body), "bucket", 8000)
    return out.select("user_id", "idx", "display_name", "storage_key", F.md5("content").alias("content_md5"))


ATTACH_SQL = """SELECT l_suppkey AS request_id, l_orderkey AS message, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate, l_extendedprice) AS pos,
  l_returnflag = 'R' AS is_image, l_linestatus = 'O' AS ok, CAST(l_quantity AS BIGINT) * 3 AS chars FROM {lineitem}"""


@query(f"""WITH a AS ({ATTACH_SQL}), n AS (SELECT *, count_if(NOT is_image) OVER (PARTITION BY request_id, message ORDER BY pos) AS no FROM a),
s AS (SELECT *, coalesce(sum(CASE WHEN NOT is_image AND ok AND no <= 2 THEN least(chars, 100) ELSE 0 END) OVER w, 0) AS spent, coalesce(sum(CASE WHEN is_image AND ok THEN 1 ELSE 0 END) OVER w, 0) AS images FROM n
  WINDOW w AS (PARTITION BY request_id ORDER BY message DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, greatest(1000 - spent, 0) AS rest FROM s),
o AS (SELECT *, CASE WHEN is_image AND images >= 3 THEN 'skipped_images' WHEN is_image THEN CASE WHEN ok THEN 'image' ELSE 'failed' END WHEN no > 2 THEN 'skipped_files' WHEN rest <= 0 THEN 'skipped_budget' WHEN NOT ok THEN 'failed'
  WHEN least(chars, 100, rest) = 0 THEN 'skipped_budget' ELSE 'included' END AS outcome FROM l)
SELECT request_id, message, pos::BIGINT AS pos, outcome, CASE WHEN outcome = 'included' THEN CAST(least(chars, 100, rest) AS BIGINT) END AS kept_chars, CASE WHEN outcome = 'included' THEN least(chars, 100, rest) < chars END AS truncated FROM o""")
def attachment_budget(spark, sf):
    rows = sql(spark, sf, ATTACH_SQL).withColumn("pos", F.col("pos").cast("bigint"))
    out = att.attachment_budget(rows, {"max_chars": 100, "total_chars": 1000, "max_files": 2, "max_images": 3})
    return out.select("request_id", "message", "pos", "outcome", "kept_chars", "truncated")


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS chars FROM documents")
def once_per_content(spark, sf):
    """Length of every document's text, taken once per distinct content and language."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.encode("text", "utf-8").alias("content"))
    out = att.once_per_content(docs, lambda d: d.withColumn("text", F.decode("content", "utf-8")), ["lang"])
    return out.select("doc_id", F.length("text").alias("chars"))


LINKS_SQL = """SELECT page_id, CASE CAST(page_id % 8 AS INT) WHEN 0 THEN 'https://Files.example.com./' || url WHEN 1 THEN 'http://files.example.com/x' WHEN 2 THEN 'https://u@files.example.com/x' WHEN 3 THEN 'https://files.example.com/%252fx'
  WHEN 4 THEN 'https://files.example.com.evil.org/' WHEN 5 THEN 'https://files.example.com:8443/a?b' WHEN 6 THEN 'https://files.example.com/a∕b' ELSE url END AS link FROM {pages}"""


@query("SELECT page_id, page_id % 8 IN (0, 5) AS valid FROM pages")
def valid_urls(spark, sf):
    return sql(spark, sf, LINKS_SQL).select("page_id", st.valid_url(F.col("link"), "files.example.com").alias("valid"))


ENDPOINTS_SQL = """SELECT p_partkey AS app_id, CASE CAST(p_partkey % 9 AS INT) WHEN 0 THEN 'https://api.example.com/x' WHEN 1 THEN 'http://10.1.2.3:8080/' WHEN 2 THEN 'http://172.20.0.1' WHEN 3 THEN 'http://container/x' WHEN 4 THEN 'ftp://x.org'
  WHEN 5 THEN 'nothing' WHEN 6 THEN 'http://172.32.0.1/' WHEN 7 THEN 'http://[fd00::1]/x' ELSE 'http://user:p@192.168.' || CAST(p_size AS STRING) || '.7/' END AS endpoint, p_size FROM {part}"""


@query("""SELECT p_partkey AS app_id, CASE p_partkey % 9 WHEN 0 THEN 'public' WHEN 1 THEN 'private_allowed' WHEN 2 THEN 'private_not_listed' WHEN 3 THEN 'private_allowed' WHEN 4 THEN 'bad_protocol' WHEN 5 THEN 'invalid' WHEN 6 THEN 'public'
  WHEN 7 THEN 'private_not_listed' ELSE CASE WHEN p_size < 16 THEN 'private_allowed' ELSE 'private_not_listed' END END AS verdict FROM part""")
def endpoint_audit(spark, sf):
    allowed = ("10.0.0.0/8", "192.168.0.0/20", "container")
    return st.endpoint_audit(sql(spark, sf, ENDPOINTS_SQL), True, allowed).select("app_id", "verdict")


# As many ranges as there are orders, of 12 to 32 bits; DuckDB compares first and last addresses.
RANGES_SQL = "SELECT o_orderkey AS k, CAST(12 + o_orderkey % 21 AS INT) AS bits FROM {orders}"


@query(f"""WITH r AS ({RANGES_SQL.replace("{orders}", "orders")}),
  b AS (SELECT DISTINCT bits, (CAST(10 AS BIGINT) << 24) + ((k * 7919) % 16777216) AS base FROM r),
  a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, '10.' || (l_partkey % 256) || '.' || (l_suppkey % 256) || '.' || (l_orderkey % 256) AS host,
    (CAST(10 AS BIGINT) << 24) + (l_partkey % 256) * 65536 + (l_suppkey % 256) * 256 + l_orderkey % 256 AS address FROM lineitem),
  f AS (SELECT DISTINCT bits, base >> (32 - bits) AS first FROM b),
  l AS (SELECT DISTINCT address FROM (SELECT DISTINCT address FROM a) x, (SELECT DISTINCT bits FROM f) n WHERE EXISTS (SELECT 1 FROM f WHERE f.bits = n.bits AND f.first = x.address >> (32 - n.bits)))
SELECT host, CASE WHEN l.address IS NULL THEN 'private_not_listed' ELSE 'private_allowed' END AS verdict, count(*) AS n FROM a LEFT JOIN l ON l.address = a.address GROUP BY ALL""")
def endpoint_audit_many_ranges(spark, sf):
    address = "(shiftleft(10L, 24) + (k * 7919) % 16777216)"
    dotted = " || '.' || ".join(f"CAST(shiftright({address}, {s}) % 256 AS STRING)" for s in (24, 16, 8, 0))
    allowed = sql(spark, sf, RANGES_SQL).selectExpr(f"{dotted} || '/' || CAST(bits AS STRING) AS entry")
    lines = table(spark, sf, "lineitem")
    host = F.concat_ws(".", F.lit("10"), *[(F.col(c) % 256).cast("string") for c in ("l_partkey", "l_suppkey", "l_orderkey")])
    apps = lines.select(F.concat(F.lit("http://"), host, F.lit("/x")).alias("endpoint"))
    return st.endpoint_audit(apps, True, allowed).groupBy("host", "verdict").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_brand AS owner, p_name AS name, count(*) OVER (PARTITION BY p_brand, p_name) > 1 AS conflict FROM part")
def unique_names(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("owner"), F.col("p_name").alias("name"))
    return a.unique_names(rows)


REQUESTS_SQL = """SELECT doc_id, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'ingest' WHEN 1 THEN 'search' ELSE 'collection' END AS kind, CASE WHEN n_chars % 2 = 0 THEN lang END AS title, CASE WHEN n_chars % 3 > 0 THEN text END AS text,
  CASE WHEN n_chars % 5 = 0 THEN source END AS bronze_key, text AS query, CAST(n_chars % 60 AS INT) AS top_k, CASE WHEN n_chars % 7 = 0 THEN '' ELSE source END AS one, CASE WHEN n_chars % 4 > 0 THEN source END AS name, text AS description FROM {documents}"""


@query(f"""WITH r AS ({REQUESTS_SQL}) SELECT doc_id, concat_ws(',',
  CASE WHEN kind = 'ingest' AND (bronze_key IS NULL) = (text IS NULL) THEN 'key_or_text' END, CASE WHEN kind = 'ingest' AND bronze_key IS NULL AND title IS NULL THEN 'title_required' END,
  CASE WHEN kind = 'search' AND length(trim(query)) > 1000 THEN 'query_length' END, CASE WHEN kind = 'search' AND one = '' THEN 'collections' END, CASE WHEN kind = 'search' AND (top_k < 1 OR top_k > 50) THEN 'top_k' END,
  CASE WHEN kind = 'collection' AND name IS NULL THEN 'name_length' END, CASE WHEN kind = 'collection' AND length(description) > 1000 THEN 'description_length' END) AS violations FROM r""")
def validate_requests(spark, sf):
    rows = sql(spark, sf, REQUESTS_SQL).withColumn("collections", F.array("one"))
    return a.validate_requests(rows).select("doc_id", F.array_join("violations", ",").alias("violations"))


CALLS_SQL = "SELECT user_id AS team_id, event_type AS app_id, user_id, date_trunc('second', ts) AS created_date, event_id, value FROM {events}"
WANTED_SQL = "SELECT event_id AS request_id, user_id AS team_id, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE event_type END AS app_id, user_id, date_trunc('second', ts) AS at FROM {events}"


def _wanted(spark, sf):
    return sql(spark, sf, WANTED_SQL).withColumn("created_ms", a.millis(F.col("at"))).drop("at")


@query("""SELECT w.event_id AS request_id, e.event_id FROM events w LEFT JOIN events e
  ON w.event_id % 3 > 0 AND e.user_id = w.user_id AND e.event_type = w.event_type AND date_trunc('second', e.ts) = date_trunc('second', w.ts)""")
def lookup_by_key(spark, sf):
    return a.lookup_by_key(sql(spark, sf, CALLS_SQL), _wanted(spark, sf)).select("request_id", "event_id")


@query("""SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events w WHERE w.event_id % 3 > 0 AND e.user_id = w.user_id AND e.event_type = w.event_type AND date_trunc('second', e.ts) = date_trunc('second', w.ts))""")
def delete_by_key(spark, sf):
    return a.delete_by_key(sql(spark, sf, CALLS_SQL), _wanted(spark, sf)).select("event_id")


@query("SELECT event_id, ts_ms FROM (SELECT event_id, CAST(epoch_us(ts) // 1000 AS VARCHAR) AS ts_ms, ts FROM events WHERE event_type = 'signup') ORDER BY ts DESC, event_id")
def latest_first(spark, sf):
    rows = p.latest_first(table(spark, sf, "events"), F.col("event_type") == "signup", "ts", "event_id")
    return rows.select("event_id", a.millis(F.col("ts")).alias("ts_ms"))


SHELVES_SQL = "SELECT c_nationkey AS owner, c_custkey AS collection_id, c_name AS name, c_mktsegment AS description FROM {customer}"
SHELF_PATCH_SQL = """SELECT o_orderkey AS patch_id, CAST(o_custkey % 25 AS INT) AS owner, o_custkey AS collection_id, CASE WHEN o_orderstatus = 'F' THEN 'Customer#' || lpad(CAST(o_custkey + 25 AS STRING), 9, '0') WHEN o_orderstatus = 'P' THEN 'fresh' END AS p_name,
  CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS p_description FROM {orders}"""


@query(f"""WITH c AS ({SHELVES_SQL}), p AS ({SHELF_PATCH_SQL}), j AS (SELECT p.*, c.name, c.description, EXISTS (SELECT 1 FROM c x WHERE x.owner = p.owner AND x.name = p.p_name AND x.collection_id <> p.collection_id) AS clash
  FROM p LEFT JOIN c ON c.owner = p.owner AND c.collection_id = p.collection_id), o AS (SELECT *, CASE WHEN name IS NULL THEN 'not_found' WHEN clash THEN 'conflict' ELSE 'ok' END AS outcome FROM j)
SELECT patch_id, outcome, CASE WHEN outcome = 'ok' THEN coalesce(p_name, name) ELSE name END AS name, CASE WHEN outcome = 'ok' THEN coalesce(p_description, description) ELSE description END AS description FROM o""")
def patch_collections(spark, sf):
    out = a.patch_collections(sql(spark, sf, SHELVES_SQL), sql(spark, sf, SHELF_PATCH_SQL))
    return out.select("patch_id", "outcome", "name", "description")
