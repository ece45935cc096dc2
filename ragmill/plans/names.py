"""Name queries. Titles are derived from parts: a kanji numeral plus a form of law."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.functions import names as n
from ragmill.functions.bigrams import bigram_jaccard
from ragmill.operators import names as o
from ragmill.operators import warehouse as w
from ragmill.plans import inputs as i
from ragmill.plans import query
from ragmill.session import spread
from ragmill.tables import sql, table

KANJI = "translate(CAST({0} AS STRING), '0123456789', '零壱弐参四伍六七八九')"
FORMS = "CASE CAST({0} % 6 AS INT) WHEN 0 THEN '法' WHEN 1 THEN '設置法' WHEN 2 THEN 'の保護に関する法律' WHEN 3 THEN '法施行令' WHEN 4 THEN '等に関する法律施行規則' ELSE '令（令和元年法律第一号）' END"
MASTER_SQL = f"SELECT 'L' || lpad(CAST(p_partkey AS STRING), 9, '0') AS law_num, '特' || {KANJI.format('p_partkey')} || {FORMS.format('p_size')} AS law_title, p_size, p_partkey FROM {{part}}"
# Names as people write them: spaces, another form, sometimes a law that does not exist.
NAMES_SQL = f"""SELECT o_orderkey AS query_id, '特 ' || {KANJI.format('o_custkey * 2')} || {FORMS.format('o_orderkey')} AS name FROM {{orders}}"""

SUFFIX_RE = "^(.+?)(?:" + "|".join(n.FORM_SUFFIXES) + ")$"


def norm_sql(name: str) -> str:
    return f"regexp_replace(regexp_replace({name}, '[\\s　]', '', 'g'), '[（(][^（()）]*[)）]', '', 'g')"


def key_sql(name: str, raw: bool = False) -> str:
    """Comparison key of a name in DuckDB; the names used here never shrink below two characters."""
    out = name if raw else norm_sql(name)
    for _ in range(n.SUFFIX_ROUNDS):
        out = f"regexp_replace({out}, '{SUFFIX_RE}', '\\1')"
    return out


def folded_sql(ident: str) -> str:
    return f"translate(regexp_replace({ident}, '等+$', ''), '{n.KEY_PARTICLES}', '')"


MASTER_DUCK = f"m AS (SELECT *, {norm_sql('law_title')} AS normalized FROM ({MASTER_SQL})), mk AS (SELECT *, {folded_sql(key_sql('normalized', True))} AS key FROM m)"
NAMES_DUCK = f"nm AS (SELECT *, {norm_sql('name')} AS normalized FROM ({NAMES_SQL})), nk AS (SELECT *, {folded_sql(key_sql('normalized', True))} AS key FROM nm)"


def _master(spark, sf):
    return o.title_dictionary(sql(spark, sf, MASTER_SQL))


def _names(spark, sf):
    return sql(spark, sf, NAMES_SQL)


@query(f"WITH {NAMES_DUCK} SELECT query_id, normalized, {key_sql('normalized', True)} AS ident, key AS name_key FROM nk")
def name_forms(spark, sf):
    """Normal form, identifier and key of every name."""
    forms = _names(spark, sf).withColumn("normalized", n.normalize_name(F.col("name")))
    forms = forms.withColumn("ident", n.strip_suffixes(F.col("normalized")))
    return forms.select("query_id", "normalized", "ident", n.identifier_key(F.col("ident")).alias("name_key"))


@query("SELECT page_id, regexp_replace(url, '[\\s　]', '', 'g') AS text FROM pages")
def normalize_query(spark, sf):
    return table(spark, sf, "pages").select("page_id", n.normalize_query(F.col("url")).alias("text"))


@query(f"WITH {MASTER_DUCK}, {NAMES_DUCK} SELECT DISTINCT nm.query_id, m.law_num, m.law_title FROM nm JOIN m ON m.normalized = nm.normalized")
def match_exact(spark, sf):
    return o.match_exact(_names(spark, sf), _master(spark, sf))


@query(f"WITH {MASTER_DUCK}, {NAMES_DUCK} SELECT DISTINCT nk.query_id, mk.law_num, mk.law_title FROM nk JOIN mk ON mk.key = nk.key")
def match_key(spark, sf):
    return o.match_key(_names(spark, sf), _master(spark, sf))


NAME_LIST_SQL = f"""SELECT o_orderkey AS query_id, array(o_orderpriority, {KANJI.format('o_custkey')} || '法', o_orderstatus, {KANJI.format('o_custkey')} || '法') AS names FROM {{orders}}"""
ALIASES = {"1URGENT": "至急法", "F": "完了法律", "5LOW": "至急法"}


@query("""WITH l AS (SELECT o_orderkey AS query_id, translate(CAST(o_custkey AS STRING), '0123456789', '零壱弐参四伍六七八九') || '法' AS k, o_orderpriority AS a, o_orderstatus AS s FROM orders)
SELECT query_id, CASE a WHEN '1-URGENT' THEN a ELSE a END || '|' || k || '|' || CASE s WHEN 'F' THEN '完了法律' ELSE s END AS names FROM l""")
def apply_aliases(spark, sf):
    names = o.apply_aliases(F.col("names"), ALIASES)
    return sql(spark, sf, NAME_LIST_SQL).select("query_id", F.array_join(names, "|").alias("names"))


@query(
    """SELECT regexp_replace(n_name, '[\\s　・･〔〕（）()]', '', 'g') AS alias_key, 'formal ' || n_regionkey AS title FROM nation WHERE n_nationkey % 3 > 0""")
def parse_aliases(spark, sf):
    """One JSON object per nation; every third value is a number and drops out."""
    value = F.when(F.pmod("n_nationkey", F.lit(3)) == 0, F.lit("7")).otherwise(
        F.concat(F.lit('" formal '), F.col("n_regionkey").cast("string"), F.lit('"'))
    )
    lines = table(spark, sf, "nation").select(
        F.explode(F.array(F.concat(F.lit('{"'), "n_name", F.lit(' ・": '), value, F.lit("}")), F.lit("[1]"), F.lit("{oops"))).alias("value")
    )
    return o.parse_aliases(lines)


@query("""WITH l AS (SELECT o_orderkey AS query_id, translate(CAST(o_custkey AS STRING), '0123456789', '零壱弐参四伍六七八九') || '法' AS k, o_orderpriority AS a, o_orderstatus AS s FROM orders)
SELECT query_id, a || '|' || k || '|' || s || '|' || k || '施行令|' || k || '施行規則' AS names FROM l""")
def expand_ordinances(spark, sf):
    names = n.expand_ordinances(F.col("names"))
    return sql(spark, sf, NAME_LIST_SQL).select("query_id", F.array_join(names, "|").alias("names"))


QUESTIONS_SQL = f"""SELECT o_orderkey AS query_id, 'このたび' || {KANJI.format('o_custkey')} || '民法と業務方法書、 ' || '特' || {KANJI.format('o_custkey * 2')} || {FORMS.format('o_orderkey')}
  || ' の第' || CAST(o_orderkey % 30 AS STRING) || '条と第2条 ' || o_orderpriority AS text FROM {{orders}}"""


@query(f"""WITH q AS ({QUESTIONS_SQL}), hits AS (SELECT query_id, unnest(regexp_extract_all(text, '[一-龥ァ-ヴー]+')) AS name, text FROM q)
SELECT query_id, string_agg(name, '|' ORDER BY instr(text, name)) AS names FROM hits WHERE length(name) >= 4 AND regexp_matches(name, '(法律|法|規則|政令|条例|省令)$') GROUP BY query_id""")
def names_in_query(spark, sf):
    found = n.names_in_query(F.col("text"))
    return sql(spark, sf, QUESTIONS_SQL).select("query_id", F.array_join(found, "|").alias("names")).filter("names <> ''")


FLAT_DUCK = f"flat AS (SELECT query_id, replace(replace(regexp_replace(text, '[\\s　]', '', 'g'), '（', '('), '）', ')') AS text FROM ({QUESTIONS_SQL}))"


@query(f"""WITH {FLAT_DUCK}, hits AS (SELECT query_id, unnest(regexp_extract_all(text, '[一-龥ァ-ヴー]+')) AS name, text FROM flat)
SELECT query_id, name, (instr(text, name) - 1)::int AS start, (instr(text, name) - 1 + length(name))::int AS "end" FROM hits WHERE length(name) >= 4 AND regexp_matches(name, '(法律|法|規則|政令|条例|省令)$')""")
def name_spans(spark, sf):
    return sql(spark, sf, QUESTIONS_SQL).select("query_id", F.inline(n.name_spans(n.normalize_query(F.col("text")))))


# Every question names one law of the master's kind; the longest title that stands there counts.
@query(f"""WITH {FLAT_DUCK}, k AS (SELECT law_num, law_title, unnest([regexp_replace(law_title, '（.*）', ''), replace(replace(law_title, '（', '('), '）', ')')]) AS key FROM ({MASTER_SQL})),
  t AS (SELECT key, arg_min(law_title, law_num) AS law_title FROM k GROUP BY key),
  h AS (SELECT query_id, law_title, instr(text, '特') - 1 AS s, length(key) AS l, row_number() OVER (PARTITION BY query_id ORDER BY length(key) DESC) AS r FROM flat JOIN t ON starts_with(substr(text, instr(text, '特')), key))
SELECT query_id, law_title, s::int AS start, (s + l)::int AS "end" FROM h WHERE r = 1""")
def titles_in_text(spark, sf):
    return o.titles_in_text(sql(spark, sf, QUESTIONS_SQL), _master(spark, sf))


# Titles that all begin with the same twenty characters, two to a question.
ALIKE = "こくみんのきそくをさだめるほうりつだいご"
ALIKE_MASTER_SQL = MASTER_SQL.replace("'特' ||", f"'{ALIKE}' ||")
ALIKE_SQL = f"""SELECT o_orderkey AS query_id, '次の、{ALIKE}' || {KANJI.format('o_custkey')} || {FORMS.format('o_orderkey')} || 'と、 {ALIKE}' || {KANJI.format('o_custkey * 2')} || {FORMS.format('o_custkey')} || 'の' AS text FROM {{orders}}"""


@query(f"""WITH flat AS (SELECT query_id, replace(replace(regexp_replace(text, '[\\s　]', '', 'g'), '（', '('), '）', ')') AS text FROM ({ALIKE_SQL})),
  p AS (SELECT query_id, string_split(text, '{ALIKE}') AS parts FROM flat),
  places AS (SELECT query_id, length(parts[1]) AS s, parts[2] AS rest FROM p UNION ALL SELECT query_id, length(parts[1]) + {len(ALIKE)} + length(parts[2]), parts[3] FROM p),
  k AS (SELECT law_num, law_title, unnest([regexp_replace(law_title, '（.*）', ''), replace(replace(law_title, '（', '('), '）', ')')]) AS key FROM ({ALIKE_MASTER_SQL})),
  t AS (SELECT substr(key, {len(ALIKE) + 1}) AS tail, arg_min(law_title, law_num) AS law_title FROM k GROUP BY 1),
  h AS (SELECT query_id, s, law_title, length(tail) AS l, row_number() OVER (PARTITION BY query_id, s ORDER BY length(tail) DESC) AS r
    FROM places JOIN t ON substr(rest, 1, 1) = substr(tail, 1, 1) AND starts_with(rest, tail))
SELECT query_id, law_title, s::int AS start, (s + {len(ALIKE)} + l)::int AS "end" FROM h WHERE r = 1""")
def titles_that_begin_alike(spark, sf):
    return o.titles_in_text(sql(spark, sf, ALIKE_SQL), o.title_dictionary(sql(spark, sf, ALIKE_MASTER_SQL)))


# Every customer's name against every title, all of which begin with the same character.
def grams_sql(text: str) -> str:
    bare = f"regexp_replace({text}, '[をにはがのもとでやへからまで等]', '', 'g')"
    return f"list_distinct(list_transform(range(1, length({bare})), lambda n: substr({bare}, n::INT, 2)))"


SPOKEN_SQL = f"""SELECT c_custkey AS query_id, '特' || {KANJI.format('c_custkey * 3')} || CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN '法' WHEN 1 THEN '保護法' ELSE '等施行規則' END AS name FROM {{customer}}"""


@query(f"""WITH n AS (SELECT query_id, name, {grams_sql('name')} AS g FROM ({SPOKEN_SQL})), t AS (SELECT law_num, law_title, {grams_sql('law_title')} AS g FROM ({MASTER_SQL})),
  p AS (SELECT query_id, name, law_num, law_title, len(list_intersect(n.g, t.g)) AS c, len(n.g) + len(t.g) AS s FROM n, t),
  r AS (SELECT *, c / (s - c)::DOUBLE AS sim, row_number() OVER (PARTITION BY query_id ORDER BY c / (s - c)::DOUBLE DESC, law_num) AS rn FROM p WHERE c > 0)
SELECT query_id, name, law_num, law_title, round(sim, 6) AS sim FROM r WHERE rn = 1""")
def nearest_by_grams(spark, sf):
    found = o.nearest_by_grams(sql(spark, sf, SPOKEN_SQL), sql(spark, sf, MASTER_SQL))
    return found.withColumn("sim", F.round("sim", 6))


# Candidates of the title search, stood in for by the neighbours of the asked number.
CANDIDATES_SPARK_SQL = f"""SELECT q.query_id, m.law_num, m.law_title FROM (SELECT o_orderkey AS query_id, explode(array(o_custkey, o_custkey * 2)) AS p FROM {{orders}}) q JOIN ({MASTER_SQL}) m ON m.p_partkey = q.p"""
GATED_NAMES = "query_id % 3 = 0"


@query(f"""WITH c AS (SELECT query_id, law_num, law_title FROM (SELECT o_orderkey AS query_id, unnest([o_custkey, o_custkey * 2]) AS p FROM orders) JOIN ({MASTER_SQL}) m ON m.p_partkey = p),
{MASTER_DUCK}, {NAMES_DUCK}, q AS ({QUESTIONS_SQL}),
named AS (SELECT query_id, key FROM nk WHERE {GATED_NAMES}),
spoken AS (SELECT query_id, {folded_sql(key_sql("name"))} AS key FROM (
  SELECT query_id, unnest(regexp_extract_all(text, '[一-龥ァ-ヴー]+')) AS name FROM q WHERE NOT ({GATED_NAMES})) WHERE length(name) >= 4 AND regexp_matches(name, '(法律|法|規則|政令|条例|省令)$')),
keys AS (SELECT DISTINCT query_id, key FROM (SELECT * FROM named UNION ALL SELECT * FROM spoken)),
silent AS (SELECT query_id, {folded_sql(norm_sql("text"))} AS plain FROM q WHERE query_id NOT IN (SELECT query_id FROM keys))
SELECT c.query_id, c.law_num, k.key IS NOT NULL OR coalesce(contains((SELECT plain FROM silent s WHERE s.query_id = c.query_id), mk.key), FALSE) AS accepted FROM c JOIN mk ON mk.law_num = c.law_num LEFT JOIN keys k ON k.query_id = c.query_id AND k.key = mk.key""")
def gate_candidates(spark, sf):
    """A third of the queries have an estimated name, the others only what they say."""
    out = o.gate_candidates(
        sql(spark, sf, CANDIDATES_SPARK_SQL), _names(spark, sf).filter(GATED_NAMES), sql(spark, sf, QUESTIONS_SQL)
    )
    return out.select("query_id", "law_num", "accepted")


def _status(spark, sf):
    laws = sql(spark, sf, MASTER_SQL).select(
        "law_num", (F.col("p_size") % 4).cast("bigint").alias("current_main_articles"), (F.col("p_size") % 3).cast("bigint").alias("future_main_articles")
    )
    return w.classify_enforcement(laws)


ASKED_SQL = f"""SELECT o_orderkey AS query_id, CASE WHEN o_orderstatus = 'P' THEN '特' || {KANJI.format('o_custkey * 2')} || 'の話' ELSE 'なにか' END AS text,
  CASE WHEN o_orderkey % 3 > 0 THEN '特' || {KANJI.format('o_custkey * 2')} || {FORMS.format('o_orderkey')} END AS estimated,
  CASE WHEN o_orderkey % 7 = 0 THEN '無' || {KANJI.format('o_custkey')} || '法' END AS spoken_name FROM {{orders}}"""


def _resolved(spark, sf):
    asked = sql(spark, sf, ASKED_SQL).select(
        "query_id", "text", F.array_compact(F.array("estimated")).alias("law_names"), F.array_compact(F.array("spoken_name")).alias("spoken")
    )
    return o.resolve(asked, _master(spark, sf), _status(spark, sf), sql(spark, sf, CANDIDATES_SPARK_SQL))


@query(f"""WITH {MASTER_DUCK}, q AS (SELECT *, {norm_sql('estimated')} AS nn FROM ({ASKED_SQL})), qk AS (SELECT *, {folded_sql(key_sql('nn', True))} AS k FROM q),
c AS (SELECT query_id, law_num FROM (SELECT o_orderkey AS query_id, unnest([o_custkey, o_custkey * 2]) AS p FROM orders) JOIN ({MASTER_SQL}) m ON m.p_partkey = p),
h0 AS (SELECT query_id, 0 AS st, law_num FROM qk JOIN m ON m.normalized = nn),
h1 AS (SELECT query_id, 1 AS st, law_num FROM qk JOIN mk ON mk.key = k),
h2 AS (SELECT c.query_id, 2 AS st, c.law_num FROM c JOIN qk ON qk.query_id = c.query_id JOIN mk ON mk.law_num = c.law_num
  WHERE CASE WHEN estimated IS NOT NULL THEN mk.key = k ELSE contains({folded_sql('text')}, mk.key) END),
hits AS (SELECT DISTINCT h.* FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) h JOIN q ON q.query_id = h.query_id WHERE spoken_name IS NULL),
first AS (SELECT query_id, min(st) AS st FROM hits GROUP BY query_id),
judged AS (SELECT h.*, CASE WHEN p_size % 4 > 0 OR p_size % 3 = 0 THEN 'current' ELSE 'pending' END AS verdict FROM hits h JOIN first f ON f.query_id = h.query_id AND f.st = h.st JOIN m ON m.law_num = h.law_num),
best AS (SELECT query_id, min(verdict) AS v FROM judged GROUP BY query_id)
SELECT j.query_id, verdict, CASE st WHEN 0 THEN '2-0' WHEN 1 THEN '2-2' ELSE '2-3' END AS stage, law_num FROM judged j JOIN best b ON b.query_id = j.query_id AND b.v = j.verdict
UNION ALL SELECT query_id, 'none', CASE WHEN spoken_name IS NOT NULL THEN '2-Q' ELSE '2-3' END, NULL FROM q WHERE query_id NOT IN (SELECT query_id FROM first)""")
def resolve_names(spark, sf):
    return _resolved(spark, sf)


PAIR_SQL = "SELECT p_partkey, p_name || ' ' || p_type AS a, p_type || ' ' || p_brand AS b FROM {part}"


@query("""WITH p AS (SELECT p_partkey, p_name || ' ' || p_type AS a, p_type || ' ' || p_brand AS b FROM part),
g AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS ga, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS gb FROM p),
c AS (SELECT p_partkey, len(list_intersect(ga, gb)) AS c, len(ga) AS na, len(gb) AS nb FROM g)
SELECT p_partkey, round(c / (na + nb - c)::DOUBLE, 6) AS similarity FROM c""")
def bigram_jaccard_pairs(spark, sf):
    return sql(spark, sf, PAIR_SQL).select("p_partkey", F.round(bigram_jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


BRANDS = ("small ring gear", "red widget plate", "cold anvil rod", "blue bolt gizmo")
BEST_SQL = f"""p AS (SELECT p_partkey, p_name AS a FROM part), c AS (SELECT unnest({list(BRANDS)}) AS b, unnest([0, 1, 2, 3]) AS pos_no),
g AS (SELECT p_partkey, pos_no, b, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS ga, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS gb FROM p, c),
s AS (SELECT p_partkey, pos_no, b, len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb)))::DOUBLE AS sim FROM g),
best AS (SELECT p_partkey, b AS best, sim FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY sim DESC, pos_no) AS rn FROM s) WHERE rn = 1)"""


def _candidates():
    return F.array(*[F.lit(b) for b in BRANDS])


@query(f"WITH {BEST_SQL} SELECT p_partkey, best, round(sim, 6) AS sim FROM best")
def best_match(spark, sf):
    match = o.best_match(F.col("p_name"), _candidates())
    return spread(table(spark, sf, "part").select("p_partkey", "p_name")).select("p_partkey", match.alias("m")).select("p_partkey", "m.best", F.round("m.sim", 6).alias("sim"))


@query(f"WITH {BEST_SQL} SELECT p_partkey, best, round(sim, 6) AS sim FROM best WHERE sim < 0.3")
def substitutions(spark, sf):
    weak = o.substitutions(F.array("p_name"), _candidates())
    return spread(table(spark, sf, "part").select("p_partkey", "p_name")).select("p_partkey", F.inline(weak)).select("p_partkey", "best", F.round("sim", 6).alias("sim"))


@query(f"WITH {BEST_SQL} SELECT p_partkey, best, round(sim, 6) AS sim FROM best WHERE sim < 0.4")
def divergences(spark, sf):
    weak = o.divergences(F.array("p_name"), _candidates())
    return spread(table(spark, sf, "part").select("p_partkey", "p_name")).select("p_partkey", F.inline(weak)).select("p_partkey", "best", F.round("sim", 6).alias("sim"))


# Selected articles of a query: the lines of an order, anchored by line number.
ARTICLES_SQL = """SELECT l_orderkey AS query_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_shipdate) AS INT) AS rank,
  CASE WHEN l_returnflag = 'R' THEN 'Suppl_Article_' ELSE 'Main_Article_' END || CAST(l_linenumber AS STRING) AS unique_anchor,
  'L' || CAST(l_partkey AS STRING) AS law_num, l_returnflag || l_linestatus AS article_summary, 'text ' || CAST(l_partkey AS STRING) AS content FROM {lineitem}"""


@query(f"""WITH a AS ({ARTICLES_SQL}), q AS ({QUESTIONS_SQL}), nums AS (SELECT query_id, unnest(x) AS number, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos FROM (SELECT query_id, regexp_extract_all(text, '第(\\d+)条', 1) AS x FROM q)),
f AS (SELECT query_id, regexp_extract(unique_anchor, 'Article_(\\d+)$', 1) AS number, arg_min(unique_anchor, rank) AS unique_anchor, arg_min(article_summary, rank) AS article_summary FROM a GROUP BY 1, 2)
SELECT n.query_id, n.pos, n.number, f.unique_anchor, f.article_summary FROM nums n JOIN f ON f.query_id = n.query_id AND f.number = n.number""")
def mentioned_articles(spark, sf):
    return o.mentioned_articles(sql(spark, sf, QUESTIONS_SQL), sql(spark, sf, ARTICLES_SQL))


@query(f"""WITH a AS ({ARTICLES_SQL}), m AS (SELECT * REPLACE ('full ' || content AS content) FROM a WHERE unique_anchor = 'Main_Article_2'),
u AS (SELECT 0 AS part, * FROM m UNION ALL SELECT 1, * FROM a WHERE (query_id, unique_anchor) NOT IN (SELECT query_id, unique_anchor FROM m)),
f AS (SELECT query_id, unique_anchor, arg_max(law_num, rank) AS fl, arg_max('summary ' || content, rank) AS fc FROM a WHERE article_summary = 'NO' GROUP BY 1, 2)
SELECT u.query_id, CAST(row_number() OVER (PARTITION BY u.query_id ORDER BY part, rank) AS INTEGER) AS rank, u.unique_anchor, coalesce(fl, law_num) AS law_num, coalesce(fc, content) AS content
FROM u LEFT JOIN f ON f.query_id = u.query_id AND f.unique_anchor = u.unique_anchor""")
def upgrade_full_text(spark, sf):
    rows = sql(spark, sf, ARTICLES_SQL)
    mentioned = rows.filter("unique_anchor = 'Main_Article_2'").withColumn("content", F.concat(F.lit("full "), "content"))
    full = rows.filter("article_summary = 'NO'").withColumn("content", F.concat(F.lit("summary "), "content"))
    return o.upgrade_full_text(rows, mentioned, full)


@query(f"""WITH {MASTER_DUCK}, k AS (SELECT key, arg_min(law_title, law_num) AS law_title FROM (SELECT law_num, law_title, normalized AS key FROM m UNION SELECT law_num, law_title, law_title FROM m) GROUP BY key),
nm AS (SELECT query_id % 100 AS query_id, {norm_sql('name')} AS nn FROM ({NAMES_SQL}))
SELECT query_id, coalesce(string_agg(DISTINCT law_title, '|' ORDER BY law_title), '') AS titles, CAST(count_if(law_title IS NULL) AS BIGINT) AS unmatched
FROM nm LEFT JOIN k ON k.key = nn GROUP BY query_id""")
def master_titles(spark, sf):
    names = _names(spark, sf).withColumn("query_id", F.pmod("query_id", F.lit(100)))
    return o.master_titles(names, _master(spark, sf)).withColumn("titles", F.array_join("titles", "|"))
