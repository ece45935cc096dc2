"""Name resolution against a title dictionary, with a three-way verdict.

Columns used throughout: ``master`` is (law_num, law_title, normalized, key), made by
``title_dictionary``; names of a query come as rows (query_id, name).
"""

from __future__ import annotations

from bisect import bisect_left
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragmill.functions import names as n
from ragmill.functions.bigrams import name_bigrams, set_jaccard, without_particles
from ragmill.functions.text import let, map_of
from ragmill.operators.topk import FEW_NAMES, NAME_QUERIES, NAME_ROWS, SCOPE_ANY, NameIndex, batch_topk
from ragmill.session import materialize, plan_bytes, spread

#: Aliases become a constant map in the plan.
MAX_ALIASES = 10_000
#: A 2-gram that more titles hold is looked at only where nothing rarer decides.
HEAVY_GRAM = 500
#: Characters of a text that are looked at together.
WINDOW = 32
#: Written bytes and rows up to which the dictionary of titles is sent to every task; a larger one is joined by a shuffle. A row
#: takes some 200 bytes in the driver and in every executor, however little it takes in a file.
DICTIONARY_BYTES, DICTIONARY_ROWS = 16 << 20, 50_000
# A title must not follow one of the characters of these ranges.
WORD_BEFORE = (("一", "龥"), ("ァ", "ヴ"), ("ー", "ー"), ("々", "々"))
# Stages of the resolution, in the order they are tried.
STAGES = ("2-0", "2-2", "2-3")
STAGE_UNKNOWN_NAME = "2-Q"
ARTICLE_NUMBER = r"第(\d+)条"


def title_dictionary(titles: DataFrame) -> DataFrame:
    """(law_num, law_title) with normal form and comparison key."""
    normalized = spread(titles).withColumn("normalized", n.normalize_name(F.col("law_title")))
    return normalized.withColumn("key", n.identifier_key(n.strip_suffixes(F.col("normalized"))))


def match_exact(names: DataFrame, master: DataFrame) -> DataFrame:
    """(query_id, law_num, law_title) whose normal form equals one of the names."""
    wanted = names.select("query_id", n.normalize_name(F.col("name")).alias("normalized")).distinct()
    wanted = wanted.filter(F.length("normalized") > 0)
    return wanted.join(master, "normalized").select("query_id", "law_num", "law_title")


def match_key(names: DataFrame, master: DataFrame) -> DataFrame:
    """(query_id, law_num, law_title) whose key equals one of the names' keys; containment does not count."""
    wanted = names.select("query_id", n.name_key(F.col("name")).alias("key")).distinct()
    wanted = wanted.filter(F.length("key") >= n.MIN_LENGTH)
    return wanted.join(master, "key").select("query_id", "law_num", "law_title")


def parse_aliases(texts: DataFrame, column: str = "value") -> DataFrame:
    """(alias_key, title) of JSON objects; values that are not text, or empty, drop out.

    A text that is no JSON object gives no aliases.
    """
    parsed = texts.select(F.try_parse_json(column).alias("v"))
    parsed = parsed.filter(F.schema_of_variant("v").startswith("OBJECT"))
    pairs = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer()).alias("e"))
    text = F.when(F.schema_of_variant("e.value") == "STRING", F.trim(F.try_variant_get("e.value", "$", "string")))
    rows = pairs.select(n.alias_key(F.col("e.key")).alias("alias_key"), text.alias("title"))
    return rows.filter((F.length("alias_key") > 0) & (F.length("title") > 0))


def load_aliases(spark: SparkSession, path: str) -> dict[str, str]:
    """The alias file as a dictionary of bounded size; an unreadable file gives none."""
    from pyspark.errors import PySparkException

    try:
        rows = parse_aliases(spark.read.text(path, wholetext=True)).limit(MAX_ALIASES + 1).collect()
    except PySparkException:
        return {}
    if len(rows) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} aliases")
    return {r["alias_key"]: r["title"] for r in rows}


def apply_aliases(names: Column, aliases: dict[str, str]) -> Column:
    """Nicknames of an array replaced by formal titles, order kept, repeats dropped."""
    if not aliases:
        return F.array_distinct(names)
    known = map_of(aliases)
    return F.array_distinct(F.transform(names, lambda x: F.coalesce(known[n.alias_key(x)], x)))


def titles_in_order() -> Column:
    """Aggregate of ``titles_in_text``: distinct titles of a text in the order of their places."""
    places = F.sort_array(F.collect_list(F.struct("start", "end", "law_title")))
    return F.array_distinct(F.transform(places, lambda p: p["law_title"])).alias("titles")


def _title_keys(master: DataFrame) -> DataFrame:
    """(key, law_title): every title under both of its forms, first title first."""
    forms = master.select(
        "law_num", "law_title", F.explode(F.array_distinct(F.array("normalized", n.normalize_query(F.col("law_title"))))).alias("key")
    )
    return forms.filter(F.length("key") > 0).groupBy("key").agg(F.min_by("law_title", "law_num").alias("law_title"))


def _pick(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Longest first, the earlier of equal ones, nothing overlapping; in text order."""
    starts: list[int] = []
    taken: list[tuple[int, int, str]] = []
    for start, end, title in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        at = bisect_left(starts, end)
        if not at or taken[at - 1][1] <= start:
            starts.insert(at, start)
            taken.insert(at, (start, end, title))
    return taken


def _halves(master: DataFrame) -> DataFrame:
    """Keys of titles with hashes of their first and last ``size`` characters, ``size`` the largest power of two that fits.

    Two strings of one length are equal just when these two halves are, which overlap.
    """
    size = F.expr("cast(1 << cast(floor(log2(length(key))) as int) as int)")
    return _title_keys(master).withColumn("size", size).select(
        "key", "law_title", "size", F.length("key").alias("length"),
        F.expr("xxhash64(left(key, size))").alias("head"), F.expr("xxhash64(right(key, size))").alias("tail"),
    )


def _places(texts: DataFrame, begins: DataFrame, size: int, longest: int) -> DataFrame:
    """(query_id, text_key, start, rest): places of (query_id, text) where a title may begin, with what it may span.

    ``begins`` are the beginnings of ``size`` characters that titles have. Texts are cut into windows first, so that a place
    costs no more in a long text than in a short one.
    """
    text = texts.select("query_id", F.xxhash64("text").alias("text_key"), F.split("text", "").alias("chars"))
    windows = text.select(
        "query_id", "text_key",
        F.expr(
            f"inline(transform(if(size(chars) > 0, sequence(0, size(chars) - 1, {WINDOW}), array()), at -> struct(at, least({WINDOW}, size(chars) - at) as places, "
            f"if(at > 0, chars[at - 1], '') as before, array_join(slice(chars, at + 1, {WINDOW + longest}), '') as piece)))"
        ),
    )
    places = windows.select("*", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("i"))
    places = places.withColumn("begin", F.expr(f"substring(piece, i + 1, {size})")).join(begins, "begin").select(
        "query_id", "text_key", (F.col("at") + F.col("i")).alias("start"),
        F.expr("if(i > 0, substring(piece, i, 1), before)").alias("before"), F.expr(f"substring(piece, i + 1, {longest})").alias("rest"),
    )
    within = F.lit(False)
    for low, high in WORD_BEFORE:
        within = within | F.col("before").between(low, high)
    return places.filter(~within).drop("before")


def titles_in_text(texts: DataFrame, master: DataFrame) -> DataFrame:
    """(query_id, law_title, start, end): dictionary titles written out in (query_id, text).

    No title right after a kanji or katakana. Positions refer to the normalised text. Every place is looked up by the hashes
    of its next 1, 2, 4, … characters among the beginnings of titles, as far as there are titles of that size; a beginning gives
    the lengths of its titles, and beginning, length and end the title. So a place meets one title for each
    length at most, however many titles begin alike. Rows that repeat both id and text count once.
    """
    keys = materialize(_halves(master).withColumn("ending", F.expr("right(key, 2)")))
    ends = keys.select("size", "head", "length", "ending").distinct()
    # A row for each power of two.
    found = {r["size"]: r for r in keys.groupBy("size").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("rows")).join(
        ends.groupBy("size").agg(F.count(F.lit(1)).alias("ends")), "size").collect()}
    longest, sizes = max((r["longest"] for r in found.values()), default=1), sorted(found) or [1]
    few = [s for s in sizes if s not in found or found[s]["ends"] <= DICTIONARY_ROWS]
    many = [s for s in sizes if s not in few]
    small = plan_bytes(keys) <= DICTIONARY_BYTES and sum(r["rows"] for r in found.values()) <= DICTIONARY_ROWS
    begins = keys.select(F.left("key", F.lit(sizes[0])).alias("begin")).distinct()
    few_begins = begins.limit(DICTIONARY_ROWS + 1).count() <= DICTIONARY_ROWS
    text = spread(texts.select("query_id", "text")).select("query_id", n.normalize_query(F.col("text")).alias("text"))
    places = _places(text, F.broadcast(begins) if few_begins else begins, sizes[0], longest)
    if few and many:
        places = materialize(places)

    def spans_of(some: list[int], sent: bool) -> DataFrame:
        """Spans that begin like titles of these sizes; where they are ``sent``, spans that end otherwise are dropped at once."""
        part = keys.filter(F.col("size").isin(some))
        heads = part.groupBy("size", "head").agg(F.collect_set("length").alias("lengths"))
        begun = F.array(*[F.expr(f"if(length(rest) >= {s}, struct({s} as size, xxhash64(left(rest, {s})) as head), null)") for s in some])
        asked = places.withColumn("x", F.explode(begun)).filter("x is not null").select("query_id", "text_key", "start", "rest", "x.*")
        met = asked.join(F.broadcast(heads) if sent else heads.hint("merge"), ["size", "head"])
        spans = met.withColumn("length", F.explode("lengths")).filter("length <= length(rest)").drop("lengths")
        if sent:
            known = F.broadcast(ends.filter(F.col("size").isin(some)))
            spans = spans.withColumn("ending", F.expr("right(left(rest, length), 2)")).join(known, ["size", "head", "length", "ending"], "left_semi").drop("ending")
        return spans.withColumn("tail", F.expr("xxhash64(substring(rest, length - size + 1, size))"))

    spans = spans_of(few, True).unionByName(spans_of(many, False)) if few and many else spans_of(few or many, bool(few))
    # Spark itself would send a dictionary that takes few bytes in its files.
    known = spans.join(F.broadcast(keys) if small else keys.hint("merge"), ["size", "length", "head", "tail"]).filter("left(rest, length) = key")
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"), "law_title")
    # Spans of one text only; their number is bounded by the length of that text.
    hits = known.groupBy("query_id", "text_key").agg(F.collect_set(span).alias("hits"))

    @F.pandas_udf("array<struct<law_title:string,start:int,end:int>>")
    def pick(column: pd.Series) -> pd.Series:
        return column.map(
            lambda hs: [{"law_title": t, "start": s, "end": e} for s, e, t in _pick([(h["start"], h["end"], h["law_title"]) for h in hs])]
        )

    single = hits.filter("size(hits) = 1").select("query_id", F.inline("hits")).select("query_id", "law_title", "start", "end")
    return single.unionByName(hits.filter("size(hits) > 1").select("query_id", F.inline(pick("hits"))))


def gate_candidates(candidates: DataFrame, names: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates (query_id, law_num, law_title, …) with ``accepted``.

    With estimated names, a candidate's key must equal one of theirs. Without, it must
    equal a name spoken in the query, or, where none is spoken, occur in the query.
    """
    keyed = candidates
    if "key" not in candidates.columns:
        keyed = candidates.withColumn("key", n.name_key(F.col("law_title")))
    asked = queries.select("query_id", F.col("text").alias("_text"))
    named = names.select("query_id").distinct().withColumn("_named", F.lit(True))
    spoken_rows = asked.join(named, "query_id", "left_anti").select(
        "query_id", F.explode(n.names_in_query(F.col("_text"))).alias("name")
    )
    keyed_names = names if "key" in names.columns else names.withColumn("key", n.name_key(F.col("name")))
    given = keyed_names.select("query_id", "key").unionByName(spoken_rows.select("query_id", n.name_key(F.col("name")).alias("key")))
    keys = given.distinct()
    keys = keys.filter(F.length("key") >= n.MIN_LENGTH).withColumn("_equal", F.lit(True))
    silent = asked.join(given.select("query_id").distinct(), "query_id", "left_anti").select(
        "query_id", n.identifier_key(n.normalize_name(F.col("_text"))).alias("_plain")
    )
    joined = keyed.join(keys, ["query_id", "key"], "left").join(silent, "query_id", "left")
    within = (F.length("key") >= n.MIN_LENGTH) & F.contains("_plain", "key")
    accepted = F.coalesce("_equal", F.lit(False)) | F.coalesce(within, F.lit(False))
    return joined.withColumn("accepted", accepted).drop("key", "_equal", "_plain")


def resolve(
    queries: DataFrame, master: DataFrame, status: DataFrame, candidates: DataFrame, found: DataFrame | None = None
) -> DataFrame:
    """(query_id, verdict, stage, law_num): current, pending or none.

    ``queries`` has (query_id, text, law_names, spoken) with names as arrays,
    ``candidates`` (query_id, law_num, law_title) is the title search, ``status`` comes
    from ``classify_enforcement``, ``found`` from ``titles_in_text``.
    """
    master = materialize(master)
    found = titles_in_text(queries, master) if found is None else found
    titles = found.groupBy("query_id").agg(titles_in_order())
    known = queries.join(titles, "query_id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    searched = F.array_union("law_names", n.expand_ordinances(F.col("titles")))
    roles = F.array(
        F.struct(F.lit(True).alias("spoken"), F.array_union("spoken", "titles").alias("names")),
        F.struct(F.lit(False).alias("spoken"), searched.alias("names")),
    )
    names = known.select("query_id", F.inline(roles)).select(
        "query_id", F.col("spoken").alias("is_spoken"), F.explode("names").alias("name")
    )

    # One join finds exact and key matches of spoken and of searched names alike.
    # Read three times below, so the normalised names are computed once.
    keyed = materialize(title_dictionary(names.withColumnRenamed("name", "law_title")))
    matches = _forms(keyed).join(_forms(master), ["stage_no", "form"])
    per_law = matches.groupBy("query_id", "law_num").agg(
        F.bool_or("is_spoken").alias("spoken_hit"), F.min(F.when(~F.col("is_spoken"), F.col("stage_no"))).alias("stage_no")
    )
    per_query = keyed.groupBy("query_id").agg(F.bool_or("is_spoken").alias("has_spoken"))
    hit_query = per_law.groupBy("query_id").agg(F.bool_or("spoken_hit").alias("spoken_hit"))
    # A law named by the user must exist; otherwise nothing else may answer for it.
    unknown = per_query.filter("has_spoken").join(hit_query.filter("spoken_hit"), "query_id", "left_anti").select("query_id")

    by_name = per_law.filter(F.col("stage_no").isNotNull()).select("query_id", "stage_no", "law_num")
    candidates = candidates.join(master.select("law_num", "key"), "law_num")
    gated = gate_candidates(candidates, keyed.filter(~F.col("is_spoken")), queries).filter("accepted")
    gated = gated.select("query_id", F.lit(len(STAGES) - 1).alias("stage_no"), "law_num")
    hits = by_name.unionByName(gated).distinct().join(unknown, "query_id", "left_anti")

    judged = hits.join(status.select("law_num", F.col("verdict").alias("known")), "law_num", "left")
    # A law without a status makes nothing current, and is none of the laws of the answer.
    judged = judged.withColumn("verdict", F.coalesce("known", F.lit("pending")))
    per_stage = judged.groupBy("query_id", "stage_no", "verdict").agg(F.count("known").alias("n_known"))
    # The earliest stage wins; within it 'current' sorts before 'pending'.
    best = per_stage.groupBy("query_id").agg(F.min(F.struct("stage_no", "verdict", "n_known")).alias("b"))
    kept = judged.join(best, "query_id").filter(
        (F.col("stage_no") == F.col("b.stage_no")) & (F.col("verdict") == F.col("b.verdict"))
        & (F.col("known").isNotNull() | (F.col("b.n_known") == 0))
    )
    kept = kept.withColumn("law_num", F.when(F.col("known").isNotNull(), F.col("law_num"))).distinct()
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), F.col("stage_no") + 1)
    answered = kept.select("query_id", "verdict", stage.alias("stage"), "law_num")
    missed = queries.select("query_id").join(best, "query_id", "left_anti")
    missed = missed.join(unknown.withColumn("_u", F.lit(True)), "query_id", "left")
    none = missed.select(
        "query_id",
        F.lit("none").alias("verdict"),
        F.when(F.col("_u"), STAGE_UNKNOWN_NAME).otherwise(STAGES[-1]).alias("stage"),
        F.lit(None).cast("string").alias("law_num"),
    )
    return answered.unionByName(none)


def _forms(keyed: DataFrame) -> DataFrame:
    """A row per form a name can match by: its normal form, and its key when long enough."""
    forms = F.array(
        F.struct(F.lit(0).alias("stage_no"), F.col("normalized").alias("form"), F.lit(1).alias("least")),
        F.struct(F.lit(1).alias("stage_no"), F.col("key").alias("form"), F.lit(n.MIN_LENGTH).alias("least")),
    )
    rest = [c for c in keyed.columns if c in ("query_id", "is_spoken", "law_num")]
    rows = keyed.select(*rest, F.inline(forms))
    return rows.filter(F.length("form") >= F.col("least")).drop("least")


def best_match(name: Column, candidates: Column) -> Column:
    """(best, sim): the most similar candidate of an array; the first of equal ones."""
    return let(_with_grams(candidates), lambda known: _best_of(name, known))


def _with_grams(candidates: Column) -> Column:
    return F.transform(candidates, lambda c, i: F.struct((-i).alias("at"), c.alias("best"), name_bigrams(c).alias("grams")))


def _best_of(name: Column, known: Column) -> Column:
    """``best_match`` over candidates that come with their 2-grams."""

    def best(grams: Column) -> Column:
        scored = F.transform(known, lambda c: F.struct(set_jaccard(grams, c["grams"]).alias("sim"), c["at"].alias("at"), c["best"].alias("best")))
        return let(F.array_max(scored), lambda top: F.struct(top["best"].alias("best"), top["sim"].alias("sim")))

    return let(name_bigrams(name), best)


def nearest_by_grams(names: DataFrame, master: DataFrame, heavy: int = HEAVY_GRAM) -> DataFrame:
    """(query_id, name, law_num, law_title, sim): the title most similar to each name, of equal ones the first.

    A name without any 2-gram that more than ``heavy`` titles have meets its titles in a join on 2-grams. All other names are
    searched in all titles, block by block, each text once: groups of like titles are passed over by what they can reach at
    most, and no pair of a name and a title becomes a row. Names and titles without a common 2-gram have no row.
    """
    asked = names.select("query_id", "name").distinct().select("query_id", "name", name_bigrams(F.col("name")).alias("grams"))
    asked = asked.filter("size(grams) > 0").withColumn("bare", without_particles(F.col("name")))
    titles = materialize(master.select("law_num", "law_title", name_bigrams(F.col("law_title")).alias("t_grams")).filter("size(t_grams) > 0"))
    index = titles.select("law_num", F.explode("t_grams").alias("g"))
    often = materialize(index.groupBy("g").count().filter(F.col("count") > heavy).select("g"))
    frequent = asked.select("query_id", "name", F.explode("grams").alias("g")).join(often, "g").select("query_id", "name", F.lit(True).alias("often")).distinct()
    asked = materialize(asked.join(frequent, ["query_id", "name"], "left"))
    rare, wide = asked.filter("often is null"), asked.filter("often")

    met = rare.select("query_id", "name", F.explode("grams").alias("g")).join(index, "g").select("query_id", "name", "law_num").distinct()
    bare = F.col("bare")
    texts = wide.select(bare.alias("query_id"), F.lit(SCOPE_ANY).alias("scope"), bare.alias("payload")).distinct()
    known = titles.filter("law_num is not null").groupBy(without_particles(F.col("law_title")).alias("payload")).agg(F.min("law_num").alias("id"))
    known = materialize(known.select("id", "payload"))
    blocks = {"query_rows": NAME_QUERIES, "corpus_rows": NAME_ROWS} if known.count() >= FEW_NAMES else {}
    nearest = batch_topk(texts, known, 1, partial(NameIndex, min_sim=0.0), **blocks)
    found = wide.join(nearest.select(F.col("query_id").alias("bare"), F.col("id").alias("law_num")), "bare").select("query_id", "name", "law_num")
    both = met.unionByName(found).join(asked, ["query_id", "name"]).join(titles, "law_num")
    scored = both.withColumn("sim", set_jaccard(F.col("grams"), F.col("t_grams")))
    rows = scored.groupBy("query_id", "name").agg(F.min_by(F.struct("law_num", "law_title", "sim"), F.struct(-F.col("sim"), "law_num")).alias("b"))
    return rows.select("query_id", "name", "b.*")


def weak_matches(names: Column, candidates: Column, below: float) -> Column:
    """Names whose best match stays below the threshold, as (name, best, sim)."""

    def row(name: Column, known: Column) -> Column:
        return let(_best_of(name, known), lambda m: F.struct(name.alias("name"), m["best"].alias("best"), m["sim"].alias("sim")))

    none = F.array().cast("array<struct<name:string,best:string,sim:double>>")
    rows = let(_with_grams(candidates), lambda known: F.transform(names, lambda name: row(name, known)))
    weak = F.filter(rows, lambda m: m["sim"] < below)
    return F.when((F.size(names) > 0) & (F.size(candidates) > 0), weak).otherwise(none)


def substitutions(names: Column, estimated: Column) -> Column:
    """Spoken names that no estimated name resembles."""
    return weak_matches(names, estimated, 0.3)


def divergences(names: Column, titles: Column) -> Column:
    """Estimated names that no found title resembles."""
    distinct = F.array_distinct(F.filter(titles, lambda t: F.length(t) > 0))
    return weak_matches(names, distinct, 0.4)


def mentioned_articles(queries: DataFrame, articles: DataFrame) -> DataFrame:
    """(query_id, pos, number, unique_anchor, article_summary) for every 第N条 of the query.

    The first article, by rank, whose anchor ends with that number.
    """
    numbers = F.regexp_extract_all("text", F.lit(ARTICLE_NUMBER), F.lit(1))
    asked = queries.select("query_id", F.posexplode(numbers).alias("pos", "number"))
    tail = F.regexp_extract("unique_anchor", r"Article_(\d+)$", 1)
    rest = F.struct("unique_anchor", "article_summary")
    first = articles.groupBy("query_id", tail.alias("number")).agg(F.min_by(rest, "rank").alias("r"))
    return asked.join(first, ["query_id", "number"]).select("query_id", "pos", "number", "r.*")


def upgrade_full_text(selected: DataFrame, mentioned: DataFrame, full: DataFrame) -> DataFrame:
    """Mentioned articles first, replacing same anchors; then full texts by anchor.

    All three have (query_id, rank, unique_anchor, law_num, content); a query has at most
    a few dozen rows.
    """
    cols = ["query_id", "rank", "unique_anchor", "law_num", "content"]
    rest = selected.select(*cols).join(mentioned.select("query_id", "unique_anchor").distinct(), ["query_id", "unique_anchor"], "left_anti")
    rows = mentioned.select(*cols).withColumn("part", F.lit(0)).unionByName(rest.select(*cols).withColumn("part", F.lit(1)))
    texts = full.groupBy("query_id", "unique_anchor").agg(
        F.max_by(F.struct(F.col("law_num").alias("f_law"), F.col("content").alias("f_content")), "rank").alias("f")
    )
    joined = rows.join(texts, ["query_id", "unique_anchor"], "left")
    order = Window.partitionBy("query_id").orderBy("part", "rank")
    return joined.select(
        "query_id", F.row_number().over(order).alias("rank"), "unique_anchor",
        F.coalesce("f.f_law", "law_num").alias("law_num"), F.coalesce("f.f_content", "content").alias("content"),
    )


def master_titles(names: DataFrame, master: DataFrame) -> DataFrame:
    """(query_id, titles, unmatched): names that are titles, and how many are not."""
    keyed = names.withColumn("key", n.normalize_name(F.col("name")))
    joined = keyed.join(_title_keys(master), "key", "left")
    return joined.groupBy("query_id").agg(
        F.array_sort(F.collect_set("law_title")).alias("titles"), F.count_if(F.col("law_title").isNull()).alias("unmatched")
    )
