"""Report queries. Model output is a column derived from the given texts."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ragmill.functions import report as r
from ragmill.operators import names as o
from ragmill.operators import reports as rep
from ragmill.operators import warehouse as w
from ragmill.operators.embedding import embed_rows, hashing_embedder
from ragmill.plans import inputs as i
from ragmill.plans import names as np
from ragmill.plans import query
from ragmill.tables import sql, table

URL = "https://laws.example.org/law/"

OUTPUT_SQL = """SELECT o_orderkey AS query_id, CASE CAST(o_orderkey % 6 AS INT)
  WHEN 0 THEN concat(chr(123), '"law_names": ["民法", " 民法 ", "', o_orderpriority, '", ""]', chr(125))
  WHEN 1 THEN concat('Answer: ', chr(123), '"law_names": ["会社法", 7]', chr(125), ' end')
  WHEN 2 THEN 'この件は労働基準法、' || chr(10) || '地方税法に基づく。'
  WHEN 3 THEN '- **民法**（基本） ' || o_orderpriority
  WHEN 4 THEN 'nothing ' || o_orderpriority
  ELSE concat(chr(123), '"law_names": []', chr(125)) END AS text FROM {orders}"""


@query("""SELECT o_orderkey AS query_id, CASE o_orderkey % 6 WHEN 0 THEN '民法|' || o_orderpriority WHEN 1 THEN '会社法|7' WHEN 2 THEN 'この件は労働基準法|地方税法に基づく'
  WHEN 3 THEN '- **民法**（基本） ' || o_orderpriority ELSE '' END AS names FROM orders""")
def parse_names(spark, sf):
    return sql(spark, sf, OUTPUT_SQL).select("query_id", F.array_join(r.parse_names(F.col("text")), "|").alias("names"))


CHOICE_SQL = """SELECT o_orderkey AS query_id, CAST(o_custkey % 30 AS INT) AS n, CASE CAST(o_orderkey % 4 AS INT)
  WHEN 0 THEN '- ' || CAST(o_custkey % 17 AS STRING) || ', 4、4., 99' WHEN 1 THEN '8. 民法' || chr(10) || '* 2' WHEN 2 THEN 'nothing' ELSE '3' || chr(10) || CAST(o_custkey % 23 AS STRING) || '. ,1' END AS text FROM {orders}"""
CHOICE_DUCK = f"""c AS ({CHOICE_SQL}), t AS (SELECT query_id, n, unnest(toks) AS tok, generate_subscripts(toks, 1) AS p FROM (
    SELECT query_id, n, list_transform(string_split_regex(text, '[,、\\n]'), lambda x: trim(regexp_replace(x, '^[\\s　*・-]+', ''))) AS toks FROM c)),
ok AS (SELECT query_id, v, min(p) AS p FROM (SELECT query_id, n, p, TRY_CAST(replace(tok, '.', '') AS INTEGER) AS v FROM t WHERE regexp_full_match(tok, '\\d+\\.?')) WHERE v >= 1 AND v <= n GROUP BY query_id, v),
sel AS (SELECT query_id, list(v ORDER BY p) AS s FROM ok GROUP BY query_id),
chosen AS (SELECT c.query_id, c.n, coalesce(s, CAST(range(1, least(n, 10) + 1) AS INTEGER[])) AS s FROM c LEFT JOIN sel ON sel.query_id = c.query_id)"""


@query(f"WITH {CHOICE_DUCK} SELECT query_id, array_to_string(s, ',') AS picked FROM chosen")
def parse_selection(spark, sf):
    picked = r.parse_selection(F.col("text"), F.col("n"))
    return sql(spark, sf, CHOICE_SQL).select("query_id", F.array_join(F.transform(picked, lambda x: x.cast("string")), ",").alias("picked"))


@query(f"""WITH {CHOICE_DUCK} SELECT query_id, array_to_string(CASE WHEN n <= 5 THEN CAST(range(1, n + 1) AS INTEGER[])
  ELSE list_concat(CAST(range(1, least(n, 8) + 1) AS INTEGER[]), list_filter(s, lambda x: x > 8)) END, ',') AS picked FROM chosen""")
def merge_floor(spark, sf):
    picked = r.merge_floor(F.col("n"), r.parse_selection(F.col("text"), F.col("n")))
    return sql(spark, sf, CHOICE_SQL).select("query_id", F.array_join(F.transform(picked, lambda x: x.cast("string")), ",").alias("picked"))


ARTICLES_SQL = """SELECT l_orderkey AS query_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_shipdate) AS INT) AS rank,
  'Law ' || CAST(l_partkey AS STRING) AS law_title, CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag || l_linestatus END AS article_summary,
  CAST(l_partkey AS STRING) || 'AC' || CASE WHEN l_linestatus = 'O' THEN '_20210401_1' ELSE '_x_1' END AS law_id,
  CASE WHEN l_returnflag <> 'N' THEN CAST(l_shipdate AS DATE) END AS enforce_date, l_returnflag <> 'R' AS resolved, l_linenumber > 4 AS is_future,
  CASE WHEN l_linenumber = 2 THEN CAST(l_shipdate AS DATE) + 40000 END AS next_enforce_date,
  CASE WHEN l_linenumber <> 3 THEN 'https://laws.example.org/law/' || CAST(l_partkey AS STRING) END AS url,
  CASE WHEN l_linenumber <> 5 THEN 'Line' || chr(10) || '　　' || CAST(l_extendedprice AS STRING) || ' ' END AS content FROM {lineitem}"""


@query(f"WITH a AS ({ARTICLES_SQL}) SELECT query_id, string_agg(rank || '. ' || law_title || ' - ' || CASE WHEN article_summary = '' THEN '概要なし' ELSE article_summary END, chr(10) ORDER BY rank) AS summaries FROM a GROUP BY query_id")
def summary_list(spark, sf):
    return rep.summary_list(sql(spark, sf, ARTICLES_SQL))


REPORT_SQL = """SELECT o_orderkey AS query_id, '# R' || chr(10) || CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'See [1] and [3, 2].' WHEN 1 THEN 'None here.' WHEN 2 THEN '[9] [2,2]' ELSE 'x [ 1] [12]' END AS report FROM {orders}"""
CITED_DUCK = f"""a AS ({ARTICLES_SQL}), r AS ({REPORT_SQL}), cnt AS (SELECT query_id, CAST(max(rank) AS INTEGER) AS n FROM a GROUP BY query_id),
nums AS (SELECT DISTINCT r.query_id, CAST(trim(unnest(string_split(g, ','))) AS INTEGER) AS v FROM (SELECT query_id, unnest(regexp_extract_all(report, '\\[(\\d+(?:,\\s*\\d+)*)\\]', 1)) AS g FROM r) r),
good AS (SELECT nums.query_id, v FROM nums JOIN cnt ON cnt.query_id = nums.query_id WHERE v >= 1 AND v <= n),
cited AS (SELECT query_id, v FROM good UNION ALL SELECT query_id, rank FROM a WHERE query_id NOT IN (SELECT query_id FROM good))"""


@query(f"WITH {CITED_DUCK} SELECT query_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS cited FROM cited WHERE query_id IN (SELECT query_id FROM r) GROUP BY query_id")
def cited_numbers(spark, sf):
    counts = sql(spark, sf, ARTICLES_SQL).groupBy("query_id").agg(F.max("rank").alias("n"))
    cited = r.cited_numbers(F.col("report"), F.col("n"))
    return sql(spark, sf, REPORT_SQL).join(counts, "query_id").select("query_id", F.array_join(F.transform(cited, lambda x: x.cast("string")), ",").alias("cited"))


def _references(spark, sf):
    return sql(spark, sf, ARTICLES_SQL).withColumnRenamed("rank", "n").withColumn("title", F.concat_ws(" ", "law_title", "n"))


def _link(n: int) -> str:
    return f"CASE WHEN u{n} IS NULL THEN '[{n}]' ELSE '[[{n}]](' || u{n} || ')' END"


@query(f"""WITH a AS ({ARTICLES_SQL}), r AS ({REPORT_SQL}), u AS (SELECT query_id, {", ".join(f"max(CASE WHEN rank = {n} THEN url END) AS u{n}" for n in (1, 2, 3, 9, 12))} FROM a GROUP BY query_id)
SELECT r.query_id, '# R' || chr(10) || CASE CAST(r.query_id % 4 AS INT) WHEN 0 THEN 'See ' || {_link(1)} || ' and ' || {_link(3)} || ' ' || {_link(2)} || '.' WHEN 1 THEN 'None here.'
  WHEN 2 THEN {_link(9)} || ' ' || {_link(2)} || ' ' || {_link(2)} ELSE 'x [ 1] ' || {_link(12)} END AS report FROM r JOIN u ON u.query_id = r.query_id""")
def link_citations(spark, sf):
    refs = _references(spark, sf).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "url"))).alias("x"))
    rows = sql(spark, sf, REPORT_SQL).join(refs, "query_id")
    return rows.select("query_id", r.link_citations(F.col("report"), F.col("x.n"), F.col("x.url")).alias("report"))


@query("""SELECT doc_id, '```mermaid' || chr(10) || 'A[' || lang || '（x）＃1] --> B' || chr(10) || 'c d' || chr(10) || '```' || chr(10) || n_chars AS report FROM documents""")
def sanitize_diagrams(spark, sf):
    report = F.concat(F.lit("```mermaid\nA["), "lang", F.lit("(x)#1] --> B\n c   d \n```\n"), F.col("n_chars").cast("string"))
    return table(spark, sf, "documents").select("doc_id", r.sanitize_diagrams(report).alias("report"))


@query(f"""WITH a AS ({ARTICLES_SQL}) SELECT query_id, rank AS n, law_title || ' ' || rank AS title, url,
  CASE WHEN resolved THEN enforce_date ELSE CAST(try_strptime(split_part(law_id, '_', 2), '%Y%m%d') AS DATE) END AS enforce_date, is_future, next_enforce_date FROM a""")
def reference_meta(spark, sf):
    return rep.reference_meta(_references(spark, sf))


def suffix_sql():
    label = "CASE WHEN year({0}) >= 2100 THEN '施行日未定（政令委任等）' ELSE CAST({0} AS VARCHAR) END"
    day, nxt = label.format("enforce_date"), label.format("next_enforce_date")
    return (
        f"CASE WHEN enforce_date IS NULL THEN '' ELSE '（' || concat_ws('・', CASE WHEN year(enforce_date) >= 2100 THEN {day} ELSE '施行日: ' || {day} END, "
        f"CASE WHEN is_future THEN '未施行' END, CASE WHEN next_enforce_date IS NOT NULL THEN '改正予定: ' || {nxt} || ' 施行' END) || '）' END"
    )


@query(f"WITH a AS ({ARTICLES_SQL}) SELECT query_id, rank AS n, {suffix_sql()} AS suffix FROM a")
def version_suffix(spark, sf):
    suffix = r.version_suffix(F.col("enforce_date"), F.col("is_future"), F.col("next_enforce_date"))
    return _references(spark, sf).select("query_id", "n", suffix.alias("suffix"))


FORMATTED = f"""'[' || rank || '] ' || CASE WHEN url IS NOT NULL THEN '🔗 **[' || law_title || ' ' || rank || '](' || url || ')**' ELSE '**' || law_title || ' ' || rank || '**' END
  || {suffix_sql()} || CASE WHEN content IS NOT NULL THEN chr(10) || '　　> ' || substr(trim(regexp_replace(content, '\\n　*', ' ', 'g')), 1, 200) || '...' ELSE '' END"""


@query(f"WITH a AS ({ARTICLES_SQL}) SELECT query_id, rank AS n, {FORMATTED} AS line FROM a")
def format_reference(spark, sf):
    suffix = r.version_suffix(F.col("enforce_date"), F.col("is_future"), F.col("next_enforce_date"))
    line = r.format_reference(F.col("n"), F.col("title"), F.col("url"), suffix, F.col("content"))
    return _references(spark, sf).select("query_id", "n", line.alias("line"))


@query(f"""WITH {CITED_DUCK}, src AS (SELECT a.query_id, string_agg({FORMATTED}, chr(10) || chr(10) ORDER BY rank) AS s FROM a JOIN cited c ON c.query_id = a.query_id AND c.v = a.rank GROUP BY a.query_id)
SELECT r.query_id, 'Data' || chr(10) || chr(10) || s AS sources FROM r JOIN src ON src.query_id = r.query_id""")
def finalize_report(spark, sf):
    """The source section of the finished reports of orders that have articles."""
    refs = _references(spark, sf)
    done = rep.finalize_report(sql(spark, sf, REPORT_SQL), refs, F.lit("Data"))
    done = done.join(refs.select("query_id").distinct(), "query_id", "left_semi")
    return done.select("query_id", F.substring_index("report", "## 出典\n\n", -1).alias("sources"))


LAW_STATUS_SQL = """SELECT o_orderkey AS query_id, 'N' || CAST(o_orderkey AS STRING) AS law_num, 'T' || CAST(o_custkey AS STRING) AS law_title, CAST(o_custkey % 20 AS BIGINT) AS future_main_articles,
  CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) END AS earliest_future_enforce_date, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority || chr(10) || ' x' END AS enforcement_clause,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS as_of FROM {orders}"""
HEAD = "'" + "' || chr(10) || '".join(r.PENDING_HEAD) + "' || chr(10)"
TAIL = "'" + "' || chr(10) || '".join(r.PENDING_TAIL) + "'"


AS_OF_DAY = r.AS_OF_LINES[1].replace("{0}", "@")


@query(f"""WITH s AS ({LAW_STATUS_SQL}) SELECT query_id, {HEAD} || '■ ' || law_title || '（' || law_num || '）' || chr(10)
  || '　本則は全 ' || future_main_articles || ' か条とも未施行で、施行済みの本則条文はありません。' || chr(10)
  || CASE WHEN earliest_future_enforce_date IS NOT NULL THEN '　法令データ上の版の施行日は ' || earliest_future_enforce_date || ' です。' || chr(10) ELSE '' END
  || CASE WHEN enforcement_clause IS NOT NULL THEN '　附則の施行期日規定は次のとおりです：' || replace(enforcement_clause, chr(10) || ' ', ' ') || chr(10) ELSE '' END || {TAIL}
  || CASE WHEN as_of IS NULL THEN '' ELSE '{r.AS_OF_LINES[0]}' || chr(10) || replace('{AS_OF_DAY}', '@', CAST(as_of AS VARCHAR)) || chr(10) || '{r.AS_OF_LINES[2]}' || chr(10) || '{r.AS_OF_LINES[3]}' || chr(10) || '---' || chr(10) END AS notices FROM s""")
def notices(spark, sf):
    rows = sql(spark, sf, LAW_STATUS_SQL)
    fields = ("law_num", "law_title", "future_main_articles", "earliest_future_enforce_date", "enforcement_clause")
    return rows.select("query_id", F.concat(r.pending_notice(F.array(F.struct(*fields))), r.as_of_notice(F.col("as_of"))).alias("notices"))


THOUGHT_SQL = """SELECT doc_id, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN '<think>a' || chr(10) || 'b</THINK>' WHEN 1 THEN 'Sure.' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 2 = 0 THEN '# Head' || chr(10) ELSE '  ' END || text AS text FROM {documents}"""


@query(f"""WITH t AS (SELECT doc_id, regexp_replace(text, '(?is)<think(?:ing)?>.*?</think(?:ing)?>', '', 'g') AS c FROM ({THOUGHT_SQL}))
SELECT doc_id, md5(CASE WHEN regexp_matches(c, '(?m)^#') THEN regexp_extract(c, '(?ms)^(#.*)', 1) ELSE regexp_replace(c, '^[\\s　]+|[\\s　]+$', '', 'g') END) AS text_md5 FROM t""")
def strip_preamble(spark, sf):
    return sql(spark, sf, THOUGHT_SQL).select("doc_id", F.md5(r.strip_preamble(F.col("text"))).alias("text_md5"))


@query(f"""WITH dwh AS ({i.DWH_SQL}) SELECT law_id, unique_anchor, '{URL}' || split_part(law_id, '_', 1) || CASE WHEN anchor IS NULL THEN '' ELSE '#' || anchor END AS url,
  law_title || ' ' || article_summary AS title FROM dwh""")
def article_links(spark, sf):
    return i.dwh(spark, sf).select(
        "law_id", "unique_anchor", r.article_url(F.col("law_id"), F.col("anchor"), URL).alias("url"),
        r.article_title(F.col("law_title"), F.col("article_summary")).alias("title"),
    )


def _report_table(spark, sf, as_of):
    """Customers' questions about the laws derived from orders."""
    embed = hashing_embedder(32)
    articles = i.dwh(spark, sf).withColumn("law_title", F.concat(F.lit("特"), F.expr(np.KANJI.format("CAST(substring(law_num, 2) AS BIGINT)")), F.lit("令法")))
    index = w.search_index(articles, i.TODAY).withColumn("id", F.concat_ws("/", "law_num", "unique_anchor"))
    index = embed_rows(index, embed, text="content")
    master = o.title_dictionary(w.title_master(articles))
    name = F.concat(F.lit("特"), F.expr(np.KANJI.format("c_custkey * 2")), F.lit("令法"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), name.alias("name"), "c_mktsegment")
    asked = customers.select("query_id", F.concat("name", F.lit("の第2条は "), "c_mktsegment").alias("text"))
    asked = embed_rows(asked, embed)
    model = customers.select(
        "query_id", F.concat(F.lit('{"law_names": ["'), "name", F.lit('"]}')).alias("law_names_text"), F.lit("1, 2").alias("selection"),
        F.lit("<think>x</think># Report\nsee [1] and [2]").alias("report"),
    )
    candidates = master.select(
        (F.substring("law_num", 2, 9).cast("bigint")).alias("query_id"), "law_num", "law_title"
    )
    return rep.report_table(asked, master, index, articles, model, candidates, URL, i.TODAY, as_of)


@query()
def report_table(spark, sf):
    return _report_table(spark, sf, None).select("query_id", "outcome", "verdict", F.md5("prefix").alias("prefix_md5"), "report")


@query()
def report_table_as_of(spark, sf):
    return _report_table(spark, sf, "1997-06-30").select("query_id", "outcome", "verdict", F.md5("prefix").alias("prefix_md5"), "report")


# Questions that end in every way: one law per customer, present, without articles, without texts, unknown, not in force yet, or
# in force only later. The second article is asked for, so it stands first among the references.
ASKED_SQL = f"""SELECT c_custkey AS query_id, CAST(c_custkey % 7 AS INT) AS kind, 'L' || lpad(CAST(c_custkey AS STRING), 9, '0') AS law_num,
  '特' || {np.KANJI.format('c_custkey')} || '令法' AS law_title, c_mktsegment FROM {{customer}}"""
LAW_DAY = "CASE WHEN kind >= 5 THEN DATE '1998-03-01' ELSE DATE '1995-01-01' END"
ARTICLE_ROWS_SQL = f"""SELECT law_num, law_num || '_19950101_1' AS law_id, law_title, 'Main_Article_' || CAST(n AS STRING) AS unique_anchor, 'Mp-At_' || CAST(n AS STRING) AS anchor,
  CASE WHEN kind = 3 THEN '' ELSE 'Body ' || CAST(n AS STRING) || ' of ' || law_num END AS content, 'Head ' || CAST(n AS STRING) AS article_summary,
  kind = 5 AS is_future, {LAW_DAY} AS enforce_date, law_num || '/' || CAST(n AS STRING) AS id
  FROM ({ASKED_SQL}) a LATERAL VIEW explode(array(1, 2)) b AS n WHERE kind NOT IN (2, 4)"""
DATA_LINE = "'データ基準日: 2026-06-01時点のe-Gov法令データ（r7）'"


def outcome_sql(as_of: bool) -> str:
    """Outcome, report and the days of its references, by the kind of the question."""
    late = "WHEN kind >= 5 THEN 'no_version'" if as_of else ""
    errors = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in r.ERRORS.items())
    title = "law_title || ' Head {0}'" if as_of else "law_title"
    url = "'" + URL + "' || law_num" + (" || '#Mp-At_{0}'" if as_of else "")
    suffix = "'（施行日: 1995-01-01）'" if as_of else "''"
    line = (
        "'[{1}] 🔗 **[' || " + title + " || '](' || " + url + " || ')**' || " + suffix + " || chr(10) || '　　> Body {0} of ' || law_num || '...'"
    )
    gap = "chr(10) || chr(10)"
    report = (
        f"'# Report' || chr(10) || 'see [[1]](' || {url.format(2)} || ') and [[2]](' || {url.format(1)} || ')' || {gap} || '{r.SOURCES_HEADING}' || {gap}"
        f" || {DATA_LINE} || {gap} || {line.format(2, 1)} || {gap} || {line.format(1, 2)}"
    )
    return f"""WITH a AS ({ASKED_SQL.replace("{customer}", "customer")}),
  o AS (SELECT *, CASE kind WHEN 2 THEN 'no_articles' WHEN 3 THEN 'no_full_articles' WHEN 4 THEN 'no_match' ELSE CASE {late} WHEN TRUE THEN 'ok' END END AS outcome,
    CASE kind WHEN 2 THEN 'pending' WHEN 4 THEN 'none' WHEN 5 THEN 'pending' ELSE 'current' END AS verdict FROM a)
SELECT query_id, outcome, verdict, CASE outcome {errors} ELSE {report} END AS report, CASE WHEN outcome = 'ok' THEN '1:1995-01-01,2:1995-01-01' END AS cited_days,
  CASE WHEN outcome = 'ok' THEN 'r7' END AS data_release, {"CASE WHEN outcome = 'ok' THEN '1997-06-30' END" if as_of else "CAST(NULL AS VARCHAR)"} AS as_of FROM o"""


def _outcomes(spark, sf, as_of):
    embed = hashing_embedder(32)
    asked = sql(spark, sf, ASKED_SQL)
    rows = sql(spark, sf, ARTICLE_ROWS_SQL)
    index = embed_rows(rows.drop("anchor"), embed, text="article_summary")
    master = o.title_dictionary(asked.filter("kind <> 4").select("law_num", "law_title"))
    text = F.concat("law_title", F.lit("の第2条は "), "c_mktsegment")
    queries = embed_rows(asked.select("query_id", text.alias("text")), embed)
    model = asked.select(
        "query_id", F.concat(F.lit('{"law_names": ["'), "law_title", F.lit('"]}')).alias("law_names_text"), F.lit("1, 2").alias("selection"),
        F.lit("<think>x</think># Report\nsee [1] and [2]").alias("report"),
    )
    candidates = asked.filter("kind <> 4").select("query_id", "law_num", "law_title")
    meta = spark.createDataFrame([("2026-06-01", "r7")], "fetched string, release string")
    out = rep.report_table(queries, master, index, rows, model, candidates, URL, "1998-01-01", as_of, meta=meta)
    days = F.transform("references", lambda x: F.concat_ws(":", x["n"].cast("string"), x["enforce_date"].cast("string")))
    return out.select("query_id", "outcome", "verdict", "report", F.array_join(days, ",").alias("cited_days"), "data_release", F.col("as_of").cast("string").alias("as_of"))


@query(outcome_sql(False))
def report_outcomes(spark, sf):
    """The batch report with every outcome of a dictionary search, in full."""
    return _outcomes(spark, sf, None)


@query(outcome_sql(True))
def report_outcomes_as_of(spark, sf):
    """The same at a day on which some laws were not in force yet."""
    return _outcomes(spark, sf, "1997-06-30")


def _digest_vectors(texts: list[str]) -> list[list[float]]:
    """A vector of its own for every text, so that a name is nearest to the equal title alone."""
    return [[b / 127.5 - 1 for b in hashlib.sha512(t.encode()).digest()] for t in texts]


@query(f"""WITH a AS ({ASKED_SQL.replace("{customer}", "customer")})
SELECT query_id, CASE WHEN kind = 4 THEN 'no_law' WHEN kind = 2 THEN 'no_articles' WHEN kind = 3 THEN 'no_full_articles' ELSE 'ok' END AS outcome, CASE WHEN kind = 4 THEN 'unidentified' ELSE 'current' END AS verdict,
  CASE WHEN kind IN (2, 3, 4) THEN '' ELSE law_num END AS law FROM a""")
def report_without_titles(spark, sf):
    """No dictionary of titles: laws by the vectors of their names, and none where neither a name nor a vector is given."""
    embed = _digest_vectors
    # Names of ordinances have no ordinances of their own.
    asked = sql(spark, sf, ASKED_SQL).withColumn("law_title", F.regexp_replace("law_title", "法$", ""))
    rows = sql(spark, sf, ARTICLE_ROWS_SQL).withColumn("is_future", F.lit(False))
    index = embed_rows(rows.drop("anchor"), embed, text="article_summary")
    master = o.title_dictionary(asked.limit(0).select("law_num", "law_title"))
    titles = embed_rows(asked.select("law_num", "law_title"), embed, text="law_title").select("law_num", "embedding")
    queries = embed_rows(asked.select("query_id", "kind", F.concat(F.lit("x "), "c_mktsegment").alias("text")), embed)
    queries = queries.select("query_id", "text", F.when(F.col("kind") != 4, F.col("embedding")).alias("embedding"))
    names = F.when(F.col("kind") == 4, F.lit('{"law_names": []}')).otherwise(F.concat(F.lit('{"law_names": ["'), "law_title", F.lit('"]}')))
    model = asked.select("query_id", names.alias("law_names_text"), F.lit("1").alias("selection"), F.lit("# R [1]").alias("report"))
    candidates = asked.limit(0).select("query_id", "law_num", "law_title")
    out = rep.report_table(queries, master, index, rows, model, candidates, URL, "1998-01-01", titles=titles, embed=embed)
    law = F.regexp_extract("report", r"law/(L\d+)", 1)
    return out.select("query_id", "outcome", "verdict", F.when(F.col("outcome") == "ok", law).otherwise("").alias("law"))
