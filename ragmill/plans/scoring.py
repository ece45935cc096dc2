"""Scoring queries. Token tables are derived from the lines of orders: one question per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragmill.operators import scoring as s
from ragmill.plans import query
from ragmill.tables import sql, table

TOKENS_SQL = """SELECT l_orderkey AS request_id, 'q' AS question, CASE CAST(l_partkey % 8 AS INT) WHEN 0 THEN ' Yes' WHEN 1 THEN '**no**' WHEN 2 THEN 'Y' WHEN 3 THEN 'NOPE' WHEN 4 THEN 'Also' WHEN 5 THEN '' WHEN 6 THEN 'n' ELSE 'maybe.' END AS token,
  -l_quantity / 10 AS logprob FROM {lineitem}"""
LABELS_SQL = "SELECT o_orderkey AS request_id, 'q' AS question, pos, label FROM {orders} JOIN (SELECT 0 AS pos, 'Yes' AS label UNION ALL SELECT 1, 'No' UNION ALL SELECT 2, 'Maybe') l ON o_orderkey >= 0"
LABEL = "CASE trim(upper(token)) WHEN 'YES' THEN 'Yes' WHEN '**NO**' THEN 'No' WHEN 'Y' THEN 'Yes' WHEN 'N' THEN 'No' WHEN 'MAYBE.' THEN 'Maybe' END"


def _tokens(spark, sf):
    return sql(spark, sf, TOKENS_SQL)


def _labels(spark, sf):
    labels = F.array(*[F.lit(x) for x in ("Yes", "No", "Maybe")])
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.lit("q").alias("question"), F.posexplode(labels).alias("pos", "label")
    )


@query("SELECT conv_id, turn, upper(replace(regexp_replace(text, '^[\\s　]+|[\\s　]+$', '', 'g'), 'ß', 'ss')) AS token FROM conversations")
def normalize_token(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", s.normalize_token(F.col("text")).alias("token"))


@query(f"WITH t AS ({TOKENS_SQL}) SELECT request_id, token, round(logprob, 6) AS logprob, {LABEL} AS label FROM t WHERE request_id IN (SELECT o_orderkey FROM orders)")
def match_labels(spark, sf):
    out = s.match_labels(_tokens(spark, sf), _labels(spark, sf))
    return out.select("request_id", "token", F.round("logprob", 6).alias("logprob"), "label")


SCORES_DUCK = f"""t AS ({TOKENS_SQL}), m AS (SELECT request_id, {LABEL} AS label, sum(exp(logprob)) AS m FROM t GROUP BY 1, 2 HAVING label IS NOT NULL),
l AS ({LABELS_SQL}), j AS (SELECT l.request_id, l.pos, l.label, coalesce(m.m, 0) AS m FROM l LEFT JOIN m ON m.request_id = l.request_id AND m.label = l.label),
p AS (SELECT *, sum(m) OVER (PARTITION BY request_id) AS total FROM j),
q AS (SELECT request_id, pos, label, total, CASE WHEN total > 0 THEN m / total END AS p, row_number() OVER (PARTITION BY request_id ORDER BY m DESC, pos) = 1 AS best_first FROM p),
sc AS (SELECT request_id, any_value(total) AS total, string_agg(label || '=' || format('{{:.6f}}', round(p, 6)), ',' ORDER BY pos) AS probabilities,
  any_value(label) FILTER (best_first) AS top, max(p) AS best, sum(pos * round(p, 6)) AS e FROM q GROUP BY request_id)"""


def _shown(scores):
    pairs = F.zip_with("labels", "probabilities", lambda a, b: F.concat(a, F.lit("="), F.format_string("%.6f", b)))
    return F.array_join(pairs, ",")


@query(f"""WITH {SCORES_DUCK} SELECT request_id, probabilities, CASE WHEN total > 0 THEN top END AS top,
  CASE WHEN total > 0 THEN round(least(1, greatest(0, (3 * best - 1) / 2)), 6) END AS confidence, CASE WHEN total > 0 THEN NULL ELSE 'no_candidate' END AS error FROM sc""")
def score_candidates(spark, sf):
    out = s.score_candidates(_tokens(spark, sf), _labels(spark, sf))
    return out.select("request_id", F.nullif(_shown(out), F.lit("")).alias("probabilities"), "top", "confidence", "error")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 2 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (l_linenumber * l_discount * 10 - 1) / (l_linenumber - 1))), 6) END AS confidence FROM lineitem")
def confidence(spark, sf):
    value = s.confidence(F.col("l_discount") * 10, F.col("l_linenumber"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", value.alias("confidence"))


@query(f"WITH {SCORES_DUCK} SELECT request_id, round(e, 6) AS score FROM sc WHERE total > 0")
def expected_score(spark, sf):
    out = s.score_candidates(_tokens(spark, sf), _labels(spark, sf)).filter("error IS NULL")
    return out.select("request_id", s.expected_score(F.col("probabilities")).alias("score"))


# One question per order: yes/no, lettered choices (plain or named), or levels.
QUESTION_SQL = """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 11 = 0 THEN 'bad name' ELSE 'q' END AS name, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'noul' WHEN 4 THEN 'odd' WHEN 3 THEN 'score' ELSE 'choice' END AS type,
  CASE WHEN o_orderkey % 13 = 0 THEN '"  "' ELSE '"Is it ' || o_orderpriority || '?"' END AS instructions,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 1 THEN '["' || o_orderpriority || '", null, "third"]' WHEN 2 THEN chr(123) || '"yes": "' || o_orderstatus || '", "no": null, "x": ["a"]' || chr(125) WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN '["low"]' ELSE '["low", "high"]' END END AS criteria,
  o_orderpriority, o_orderstatus FROM {orders}"""


def _questions(spark, sf):
    rows = sql(spark, sf, QUESTION_SQL)
    return rows.withColumn("options", s.question_options(F.col("type"), F.col("criteria")))


OPTIONS = """CASE CAST(request_id % 5 AS INT) WHEN 0 THEN 'Yes/Yes/|No/No/' WHEN 1 THEN 'A/A/' || o_orderpriority || '|B/B/|C/C/third' WHEN 2 THEN 'A/yes/' || o_orderstatus || '|B/no/|C/x/[' || chr(10) || '  "a"' || chr(10) || ']'
  WHEN 3 THEN CASE WHEN request_id % 2 = 0 THEN '0/0/low' ELSE '0/0/low|1/1/high' END ELSE '' END"""


@query(f"WITH q AS ({QUESTION_SQL}) SELECT request_id, {OPTIONS} AS options FROM q")
def question_options(spark, sf):
    shown = F.transform("options", lambda o: F.concat_ws("/", o["token"], o["label"], F.coalesce(o["description"], F.lit(""))))
    return _questions(spark, sf).select("request_id", F.array_join(shown, "|").alias("options"))


@query(f"""WITH q AS ({QUESTION_SQL}) SELECT request_id, CASE WHEN request_id % 11 = 0 THEN 'bad_name' WHEN type = 'odd' THEN 'bad_type' WHEN request_id % 13 = 0 THEN 'bad_instructions'
  WHEN type = 'score' AND request_id % 2 = 0 THEN 'level_count' END AS reason FROM q""")
def validate_questions(spark, sf):
    return s.validate_questions(sql(spark, sf, QUESTION_SQL)).select("request_id", "reason")


@query(f"""WITH {SCORES_DUCK}, o AS (SELECT o_orderkey AS request_id, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'noul' WHEN 1 THEN 'choice' ELSE 'score' END AS type FROM orders)
SELECT o.request_id, type, CASE WHEN type = 'noul' THEN top = 'Yes' END AS noul, CASE WHEN type = 'choice' THEN CASE top WHEN 'Yes' THEN 'one' WHEN 'No' THEN 'two' ELSE 'three' END END AS choice,
  CASE WHEN type = 'score' THEN round(e, 6) END AS score, CASE WHEN type <> 'noul' THEN round(least(1, greatest(0, (3 * best - 1) / 2)), 6) END AS confidence,
  CASE WHEN type = 'score' THEN '|y|' END AS legend FROM o JOIN sc ON sc.request_id = o.request_id WHERE total > 0""")
def answers(spark, sf):
    """Orders read as yes/no, choice or score questions over the same three tokens."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("noul", "choice", "score")]), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    option = lambda t, l, d: F.struct(F.lit(t).alias("token"), F.lit(l).alias("label"), F.lit(d).cast("string").alias("description"))  # noqa: E731, E741
    options = F.array(option("Yes", "one", None), option("No", "two", "y"), option("Maybe", "three", None))
    questions = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.lit("q").alias("question"), kind.alias("type"), options.alias("options")
    )
    out = s.answers(s.score_candidates(_tokens(spark, sf), _labels(spark, sf)), questions)
    legend = F.array_join(F.map_values("legend"), "|")
    return out.select("request_id", "type", "noul", "choice", "score", "confidence", legend.alias("legend"))


@query("""SELECT doc_id, CASE WHEN strlen(text) > 8192 THEN 'state_too_large' WHEN strlen(text) + strlen(lang) + 250 > 4096 THEN 'context_overflow' ELSE 'ok' END AS outcome FROM documents""")
def context_gate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("state"), F.col("lang").alias("system_prompt"), F.col("text").alias("user_prompt"))
    return s.context_gate(docs, 4096).select("doc_id", "outcome")


@query("""WITH u AS (SELECT user_id AS request_id, CASE WHEN event_type <> 'error' OR user_id % 2 = 0 THEN event_id END AS a, user_id AS b FROM events)
SELECT request_id, CASE WHEN count(a) = count(*) THEN CAST(sum(a) AS BIGINT) END AS input_tokens, CAST(sum(b) AS BIGINT) AS output_tokens FROM u GROUP BY request_id""")
def usage_totals(spark, sf):
    events = table(spark, sf, "events")
    known = (F.col("event_type") != "error") | (F.pmod("user_id", F.lit(2)) == 0)
    usage = events.select(F.col("user_id").alias("request_id"), F.when(known, F.col("event_id")).alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return s.usage_totals(usage, ("request_id",), "input_tokens", "output_tokens")


@query(f"""WITH q AS ({QUESTION_SQL}) SELECT request_id, md5('<state>' || chr(10) || o_orderstatus || chr(10) || '</state>' || chr(10) || chr(10) || '問い: ' || CASE WHEN request_id % 13 = 0 THEN '  ' ELSE 'Is it ' || o_orderpriority || '?' END || chr(10) || chr(10)
  || CASE CAST(request_id % 5 AS INT) WHEN 0 THEN '選択肢:' || chr(10) || 'Yes: 当てはまる（はい）' || chr(10) || 'No: 当てはまらない（いいえ）'
     WHEN 1 THEN '選択肢:' || chr(10) || 'A: ' || o_orderpriority || chr(10) || 'B' || chr(10) || 'C: third'
     WHEN 2 THEN '選択肢:' || chr(10) || 'A: yes — ' || o_orderstatus || chr(10) || 'B: no' || chr(10) || 'C: x — [' || chr(10) || '  "a"' || chr(10) || ']'
     ELSE CASE WHEN request_id % 2 = 0 THEN '評価段階（0 が最も低く、0 が最も高い）:' || chr(10) || '0: low' ELSE '評価段階（0 が最も低く、1 が最も高い）:' || chr(10) || '0: low' || chr(10) || '1: high' END END
  || chr(10) || chr(10) || '上の問いへの答えを、次のいずれか 1 つだけで出力してください: ' || CASE CAST(request_id % 5 AS INT) WHEN 0 THEN 'Yes / No' WHEN 3 THEN CASE WHEN request_id % 2 = 0 THEN '0' ELSE '0 / 1' END ELSE 'A / B / C' END) AS prompt_md5
FROM q WHERE type <> 'odd'""")
def prompt_text(spark, sf):
    rows = _questions(spark, sf).filter("type <> 'odd'")
    text = s.prompt_text(F.col("o_orderstatus"), s.entry_text(F.col("instructions")), F.col("type"), F.col("options"))
    return rows.select("request_id", F.md5(text).alias("prompt_md5"))
