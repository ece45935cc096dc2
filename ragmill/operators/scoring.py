"""Token-distribution scoring: from next-token log-probabilities to answers.

A question has at most 20 options and 20 candidate tokens, so both travel as arrays
inside one row and nothing is paired across rows.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragmill.functions.text import nfkc, strip_close_tag, trimmed
from ragmill.session import spread

# Limits and words of the question format.
NOUL_LABELS = ("Yes", "No")
DECIMALS = 6
MAX_QUESTIONS = 16
CHOICES = (2, 20)
LEVELS = (2, 10)
MAX_DEPTH = 8
NAME_PATTERN = r"^[A-Za-z0-9_-]{1,64}$"
RESERVE_TOKENS = 250
MAX_STATE_BYTES = 8192
STATE_OPEN, STATE_CLOSE = "<state>", "</state>"
QUESTION_LINE = "問い: "
NOUL_LINES = ("選択肢:", "Yes: 当てはまる（はい）", "No: 当てはまらない（いいえ）")
CHOICE_LINE = "選択肢:"
SCORE_LINE = ("評価段階（", " が最も低く、", " が最も高い）:")
CLOSING = "上の問いへの答えを、次のいずれか 1 つだけで出力してください: "


def normalize_token(token: Column) -> Column:
    return F.upper(nfkc(trimmed(token)))


def rounded(col: Column) -> Column:
    return F.round(col, DECIMALS)


def match_label(norm: Column, bare: Column, lookup: Column) -> Column:
    """The label a normalised token stands for, by a map of normal forms to labels.

    Equal; equal without surrounding punctuation; the only label the token begins.
    A label that begins the token does not count.
    """
    begun = F.filter(F.map_keys(lookup), lambda x: x.startswith(norm))
    found = F.coalesce(
        F.try_element_at(lookup, norm),
        F.when((bare != "") & (bare != norm), F.try_element_at(lookup, bare)),
        F.when(F.size(begun) == 1, F.try_element_at(lookup, F.get(begun, F.lit(0)))),
    )
    return F.when(norm != "", found)


def label_arrays(labels: DataFrame) -> DataFrame:
    """(request_id, question, labels, lookup) of rows (request_id, question, pos, label).

    Of labels with the same normal form the last one counts.
    """
    row = F.struct("pos", "label", normalize_token(F.col("label")).alias("norm"))
    rows = spread(labels).groupBy("request_id", "question").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    norms = F.array_distinct("rows.norm")
    last = F.transform(norms, lambda x: F.element_at(F.filter("rows", lambda r: r["norm"] == x), -1)["label"])
    return rows.select("request_id", "question", F.col("rows.label").alias("labels"), F.map_from_arrays(norms, last).alias("lookup"))


def match_labels(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Tokens (request_id, question, token, logprob) with the label they count for, or null."""
    normal = spread(tokens).withColumn("norm", normalize_token(F.col("token")))
    normal = normal.withColumn("bare", F.regexp_replace("norm", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    joined = normal.join(label_arrays(labels).select("request_id", "question", "lookup"), ["request_id", "question"])
    return joined.withColumn("label", match_label(F.col("norm"), F.col("bare"), F.col("lookup")))


def confidence(p: Column, n: Column) -> Column:
    """clamp((n·p − 1)/(n − 1), 0, 1); 0 with fewer than two candidates."""
    raw = (n * p - 1) / F.nullif(n - 1, F.lit(0))
    return F.when(n < 2, F.lit(0.0)).otherwise(rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))))


def expected_score(probabilities: Column) -> Column:
    """Σ i·pᵢ over the rounded probabilities in label order."""
    weighted = F.transform(probabilities, lambda p, i: p * i)
    return rounded(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x))


def score_candidates(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """(request_id, question, labels, probabilities, top, confidence, error) per question.

    Mass of every label renormalised over the candidates; ``no_candidate`` when none of
    the tokens counts.
    """
    matched = match_labels(tokens, labels).filter(F.col("label").isNotNull())
    mass = matched.groupBy("request_id", "question", "label").agg(F.sum(F.exp("logprob")).alias("m"))
    masses = mass.groupBy("request_id", "question").agg(F.map_from_entries(F.collect_list(F.struct("label", "m"))).alias("mass"))
    out = label_arrays(labels).join(masses, ["request_id", "question"], "left")
    names = F.col("labels")
    raw = F.transform(names, lambda x: F.coalesce(F.try_element_at("mass", x), F.lit(0.0)))
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("raw", raw).withColumn("total", total)
    ok = F.col("total") > 0
    share = F.transform("raw", lambda m: m / F.col("total"))
    out = out.withColumn("p", F.when(ok, share))
    best = F.array_max("p")
    top = F.element_at(names, F.array_position(F.col("p"), best).cast("int"))
    return out.select(
        "request_id", "question", "labels",
        F.transform("p", rounded).alias("probabilities"), F.when(ok, top).alias("top"),
        F.when(ok, confidence(best, F.size("labels"))).alias("confidence"),
        F.when(~ok, F.lit("no_candidate")).alias("error"),
    )


def _entry_text(value) -> str | None:
    """Strings as they are, structures as JSON indented by two."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, indent=2)


def _number(text: str):
    value = float(text)
    return int(value) if value.is_integer() else value


def _load(text: str):
    return json.loads(text, parse_float=_number)


@F.pandas_udf(T.StringType())
def _entry(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else _entry_text(_load(v)))


def entry_text(value: Column) -> Column:
    """Prompt text of a JSON value."""
    return _entry(value)


_OPTION = T.StructType(
    [T.StructField("token", T.StringType()), T.StructField("label", T.StringType()), T.StructField("description", T.StringType())]
)


def option_list(kind: str, criteria: str | None) -> list[dict]:
    """Options of a question: Yes/No, lettered choices or numbered levels."""
    if kind == "noul":
        return [{"token": x, "label": x, "description": None} for x in NOUL_LABELS]
    values = _load(criteria) if criteria else []
    names = list(values) if isinstance(values, dict) else [None] * len(values)
    texts = list(values.values()) if isinstance(values, dict) else values
    tokens = [chr(65 + i) if kind == "choice" else str(i) for i in range(len(texts))]
    return [
        {"token": t, "label": t if n is None else n, "description": _entry_text(x)} for t, n, x in zip(tokens, names, texts)
    ]


@F.pandas_udf(T.ArrayType(_OPTION))
def _options(kinds: pd.Series, criteria: pd.Series) -> pd.Series:
    return pd.Series([option_list(k, c) for k, c in zip(kinds, criteria)])


def question_options(kind: Column, criteria: Column) -> Column:
    """(token, label, description) structs of a question type and its criteria as JSON."""
    return _options(kind, criteria)


def answers(scores: DataFrame, questions: DataFrame) -> DataFrame:
    """(request_id, question, type, noul, choice, score, probabilities, confidence, legend).

    ``questions`` has (request_id, question, type, options). A choice answers with the
    caller's labels, a score with its expectation and the legend of its levels.
    """
    joined = scores.filter(F.col("error").isNull()).join(questions, ["request_id", "question"])
    kind = F.col("type")
    public = F.when(kind == "choice", F.col("options.label")).otherwise(F.col("labels"))
    at = F.array_position(F.col("labels"), F.col("top")).cast("int")
    legend = F.map_from_arrays(F.col("options.token"), F.transform("options.description", lambda d: F.coalesce(d, F.lit(""))))
    return joined.select(
        "request_id", "question", "type",
        F.when(kind == "noul", F.col("top") == "Yes").alias("noul"),
        F.when(kind == "choice", F.element_at(public, at)).alias("choice"),
        F.when(kind == "score", expected_score(F.col("probabilities"))).alias("score"),
        F.when(kind != "noul", F.map_from_arrays(public, "probabilities")).alias("probabilities"),
        F.when(kind != "noul", F.col("confidence")).alias("confidence"),
        F.when(kind == "score", legend).alias("legend"),
    )


def _depth(value) -> int:
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else None
    return 0 if inner is None else 1 + max(map(_depth, inner), default=0)


_SHAPE = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("depth", T.IntegerType()),
        T.StructField("blank", T.BooleanType()), T.StructField("bad_label", T.BooleanType()),
    ]
)


def _shape_of(text: str | None) -> dict:
    if text is None:
        return {"kind": None, "n": 0, "depth": 0, "blank": False, "bad_label": False}
    value = json.loads(text)
    kind = {dict: "object", list: "array", str: "string"}.get(type(value), "other")
    parts = list(value.values()) if kind == "object" else value if kind == "array" else []
    allowed = lambda p: p is None or isinstance(p, (str, dict, list))
    return {
        "kind": kind,
        "n": len(parts),
        "depth": _depth(value),
        "blank": (kind == "string" and not value.strip()) or any((isinstance(p, str) and not p.strip()) or not allowed(p) for p in parts),
        "bad_label": kind == "object" and any(not k.strip() or len(k.strip()) > 64 for k in value),
    }


@F.pandas_udf(_SHAPE)
def _shape(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_shape_of(t) for t in texts], columns=[f.name for f in _SHAPE])


def validate_questions(questions: DataFrame) -> DataFrame:
    """Questions (request_id, name, type, instructions, criteria as JSON) with ``reason``, null when valid.

    A request with too many questions is invalid as a whole.
    """
    shaped = questions.withColumn("_i", _shape("instructions")).withColumn("_c", _shape("criteria"))
    counts = questions.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n"))
    kind, c, i = F.col("type"), F.col("_c"), F.col("_i")
    # The elements of the criteria start one level down.
    limit = lambda pair: (c["n"] < pair[0]) | (c["n"] > pair[1])
    instructions_bad = (
        ~F.coalesce(i["kind"].isin("string", "object", "array"), F.lit(False))
        | ((i["kind"] == "string") & i["blank"]) | (i["depth"] > MAX_DEPTH)
    )
    reason = (
        F.when(F.col("_n") > MAX_QUESTIONS, "too_many_questions")
        .when(~F.col("name").rlike(NAME_PATTERN), "bad_name")
        .when(~kind.isin("noul", "choice", "score"), "bad_type")
        .when(instructions_bad, "bad_instructions")
        .when((kind == "choice") & ~F.coalesce(c["kind"].isin("array", "object"), F.lit(False)), "bad_criteria")
        .when((kind == "score") & ~F.coalesce(c["kind"] == "array", F.lit(False)), "bad_criteria")
        .when((kind == "choice") & limit(CHOICES), "choice_count")
        .when((kind == "score") & limit(LEVELS), "level_count")
        .when((kind != "noul") & (c["blank"] | c["bad_label"]), "bad_criteria")
        .when((kind != "noul") & (c["depth"] > MAX_DEPTH + 1), "too_deep")
    )
    return shaped.join(counts, "request_id").withColumn("reason", reason).drop("_i", "_c", "_n")


def context_gate(df: DataFrame, context: int, max_state: int = MAX_STATE_BYTES) -> DataFrame:
    """(…, outcome) of (state, system_prompt, user_prompt): bytes bound the tokens from above."""
    used = F.octet_length("system_prompt") + F.octet_length("user_prompt")
    outcome = F.when(F.octet_length("state") > max_state, "state_too_large").when(
        used + RESERVE_TOKENS > context, "context_overflow"
    )
    return df.withColumn("outcome", F.coalesce(outcome, F.lit("ok")))


def usage_totals(df: DataFrame, keys: tuple[str, ...], *counts: str) -> DataFrame:
    """Sums per request; a sum is missing as soon as one part is."""
    sums = [F.when(F.count(c) == F.count(F.lit(1)), F.sum(c)).alias(c) for c in counts]
    return df.groupBy(*keys).agg(*sums)


def prompt_text(state: Column, instructions: Column, kind: Column, options: Column) -> Column:
    """The question as the model sees it: delimited state, question, options, closing line."""

    def option(o: Column) -> Column:
        name = F.when((o["label"] != o["token"]) & (o["label"] != ""), o["label"])
        rest = F.concat_ws(" — ", name, F.when(o["description"] != "", o["description"]))
        return F.when(rest == "", o["token"]).otherwise(F.concat(o["token"], F.lit(": "), rest))

    lines = F.array_join(F.transform(options, option), "\n")
    tokens = options["token"]
    levels = F.concat(
        F.lit(SCORE_LINE[0]), F.element_at(tokens, 1), F.lit(SCORE_LINE[1]), F.element_at(tokens, -1), F.lit(SCORE_LINE[2])
    )
    body = (
        F.when(kind == "noul", "\n".join(NOUL_LINES))
        .when(kind == "choice", F.concat(F.lit(CHOICE_LINE + "\n"), lines))
        .otherwise(F.concat(levels, F.lit("\n"), lines))
    )
    return F.concat_ws(
        "\n",
        F.lit(STATE_OPEN), strip_close_tag(state), F.lit(STATE_CLOSE), F.lit(""),
        F.concat(F.lit(QUESTION_LINE), instructions), F.lit(""), body, F.lit(""),
        F.concat(F.lit(CLOSING), F.array_join(tokens, " / ")),
    )
