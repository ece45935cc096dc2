"""Report assembly: references, final text, and the whole batch from question to report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.functions import names as names_fn
from ragmill.functions import report as r
from ragmill.operators import names, retrieval, warehouse
from ragmill.operators.embedding import EmbedFn, embed_rows
from ragmill.session import materialize

#: Articles pre-ranked per query before selection.
PRERANK = 30


def summary_list(articles: DataFrame) -> DataFrame:
    """(query_id, summaries): numbered titles and summaries of pre-ranked articles."""
    line = r.summary_line(F.col("rank"), F.col("law_title"), F.col("article_summary"))
    ranked = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    lines = articles.groupBy("query_id").agg(ranked.alias("rows"))
    return lines.select("query_id", F.array_join(F.col("rows.line"), "\n").alias("summaries"))


def select_articles(articles: DataFrame, selections: DataFrame) -> DataFrame:
    """Articles kept by floor and selection, in chosen order with a new rank.

    ``articles`` has (query_id, rank, …), ``selections`` (query_id, selection) holds
    model output; a query without one keeps all its articles.
    """
    counts = articles.groupBy("query_id").agg(F.max("rank").cast("int").alias("n"))
    chosen = counts.join(selections, "query_id", "left")
    picked = r.merge_floor(F.col("n"), r.parse_selection(F.col("selection"), F.col("n")))
    every = F.sequence(F.lit(1), F.col("n"))
    order = F.when(F.col("selection").isNull(), every).otherwise(picked)
    rows = chosen.select("query_id", F.posexplode(order).alias("at", "rank"))
    joined = rows.join(articles, ["query_id", "rank"])
    return joined.withColumn("rank", F.col("at") + 1).drop("at")


def reference_meta(references: DataFrame) -> DataFrame:
    """(query_id, n, title, url, enforce_date, is_future, next_enforce_date) of cited references."""
    day = r.reference_date(F.col("enforce_date"), F.col("law_id"), F.col("resolved"))
    return references.select(
        "query_id", "n", "title", "url", day.alias("enforce_date"),
        F.coalesce("is_future", F.lit(False)).alias("is_future"), "next_enforce_date",
    )


def _reference_array(references: DataFrame) -> DataFrame:
    row = F.struct("n", "title", "url", "law_id", "content", "enforce_date", "is_future", "next_enforce_date")
    return references.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("refs"))


def finalize_report(reports: DataFrame, references: DataFrame, data_line: Column | None = None) -> DataFrame:
    """(query_id, report, cited): linked citations, safe diagrams and the source section.

    ``reports`` has (query_id, report), ``references`` (query_id, n, title, url, law_id,
    content, enforce_date, is_future, next_enforce_date), at most a few dozen per query.
    """
    none = F.array().cast("array<int>")
    joined = reports.join(_reference_array(references), "query_id", "left")
    cited = r.cited_numbers(F.col("report"), F.coalesce(F.size("refs"), F.lit(0)))
    joined = joined.withColumn("cited", F.when(F.col("refs").isNull(), none).otherwise(cited))
    used = F.filter("refs", lambda x: F.array_contains("cited", x["n"]))

    def line(x: Column) -> Column:
        suffix = r.version_suffix(x["enforce_date"], x["is_future"], x["next_enforce_date"])
        return r.format_reference(x["n"], x["title"], x["url"], suffix, x["content"])

    joined = joined.withColumn("used", F.coalesce(used, F.expr("slice(refs, 1, 0)")))
    sources = F.array_join(F.transform("used", line), "\n\n")
    linked = r.link_citations(F.col("report"), F.coalesce(F.col("used.n"), none), F.coalesce(F.col("used.url"), F.array().cast("array<string>")))
    body = r.sanitize_diagrams(linked)
    head = F.lit("") if data_line is None else F.coalesce(F.concat(data_line, F.lit("\n\n")), F.lit(""))
    text = F.concat_ws("\n\n", body, F.lit(r.SOURCES_HEADING), F.concat(head, F.coalesce(sources, F.lit(""))))
    return joined.select("query_id", text.alias("report"), "cited")


# Words that names nobody knows are searched with, and how near a title must be to a question.
BROAD = ("法律", "規則", "政令")
QUESTION_TITLES, QUESTION_SCORE = 5, 0.5


def nearest_laws(asked: DataFrame, queries: DataFrame, titles: DataFrame, embed: EmbedFn) -> DataFrame:
    """(query_id, verdict, stage, law_num) without a dictionary of titles: current, or unidentified.

    Each estimated name takes its nearest title; where none has one, the broad words do. A question without names takes
    the titles near to itself, and is unidentified where there are none.
    """
    spark = asked.sparkSession
    master = titles.select(F.col("law_num").alias("id"), "embedding")
    named = embed_rows(asked.select("query_id", F.explode("law_names").alias("name")), embed, text="name")
    broad = embed_rows(spark.createDataFrame([(w,) for w in BROAD], "name string"), embed, text="name")
    by_name = retrieval.nearest_law_per_name(named, master, broad).select("query_id", F.col("id").alias("law_num"))
    silent = queries.join(asked.filter("size(law_names) = 0").select("query_id"), "query_id", "left_semi")
    by_question = retrieval.nearest_titles(silent, master, QUESTION_TITLES, QUESTION_SCORE).select("query_id", F.col("id").alias("law_num"))
    laws = by_name.unionByName(by_question).distinct()
    verdict = F.when((F.size("law_names") == 0) & F.col("law_num").isNull(), "unidentified").otherwise("current")
    return asked.join(laws, "query_id", "left").select("query_id", verdict.alias("verdict"), F.lit(None).cast("string").alias("stage"), "law_num")


def _summaries_upgraded(final: DataFrame, summaries: DataFrame, laws: DataFrame, article: DataFrame, include_future: bool) -> DataFrame:
    """``final`` with the full articles of the laws and anchors of ``summaries`` in the place of the same anchor."""
    own = summaries.groupBy("query_id", "law_num").agg(F.min("rank").alias("law_rank")).join(laws, ["query_id", "law_num"])
    anchors = summaries.select("query_id", "unique_anchor").distinct()
    full = own.join(anchors, "query_id").join(article.drop("id"), ["law_num", "unique_anchor"]).filter(F.length("content") > 0)
    full = full.filter(~F.col("is_future") | F.col("pending") | F.lit(include_future))
    # Of several laws with the anchor the last one counts.
    rest = [c for c in article.columns if c not in ("id", "unique_anchor")]
    best = full.groupBy("query_id", "unique_anchor").agg(F.max_by(F.struct(*rest), F.struct("law_rank", "law_num")).alias("u"))
    joined = final.join(best, ["query_id", "unique_anchor"], "left")
    return joined.select(*[F.coalesce(f"u.{c}", c).alias(c) if c in rest else F.col(c) for c in final.columns])


def report_table(
    queries: DataFrame,
    master: DataFrame,
    index: DataFrame,
    dwh: DataFrame,
    model: DataFrame,
    candidates: DataFrame,
    url_base: str,
    today: str,
    as_of: str | None = None,
    aliases: dict[str, str] | None = None,
    titles: DataFrame | None = None,
    embed: EmbedFn | None = None,
    meta: DataFrame | None = None,
) -> DataFrame:
    """(query_id, outcome, verdict, prefix, report, cited, as_of, data_fetched, data_release, references) for a batch of questions.

    ``queries`` has (query_id, text, embedding); ``model`` holds what the language model
    answered per query: (query_id, law_names_text, selection, report); ``index`` is the
    version index with (id, embedding); ``candidates`` is the title search. ``outcome``
    is ok or one of no_law, no_match, no_articles, no_full_articles, no_version.

    Where the dictionary of titles is empty, laws are the nearest ones by ``titles`` (law_num, embedding): by the vectors of
    the names, which ``embed`` makes, or of the question where no name was estimated. ``meta`` (fetched, release) has the state
    of the data in one row, which the report tells. Articles that the index marks ``is_summary_only``, where it has that
    column, give their place to the full articles of the same anchor. ``references`` are those that a report cites.
    """
    include_future = as_of is not None
    given = queries.join(model, "query_id", "left")
    estimated = r.parse_names(F.col("law_names_text"))
    spoken = names_fn.names_in_query(names_fn.normalize_query(F.col("text")))
    known = aliases or {}
    asked = given.select(
        "query_id", "text", estimated.alias("estimated"), names_fn.name_spans(names_fn.normalize_query(F.col("text"))).alias("spans"),
        names_fn.expand_ordinances(names.apply_aliases(estimated, known)).alias("law_names"),
        names.apply_aliases(spoken, known).alias("spoken"),
    )
    # Each of these feeds several branches below.
    queries, asked, index = map(materialize, (queries, asked, index))
    found = materialize(names.titles_in_text(queries, master))
    status = warehouse.classify_enforcement(warehouse.enforcement_status(index))
    if titles is not None and master.isEmpty():
        verdicts = materialize(nearest_laws(asked, queries, titles, embed))
    else:
        verdicts = materialize(names.resolve(asked, master, status, candidates, found))
    per_query = verdicts.groupBy("query_id").agg(F.max("verdict").alias("verdict"))

    # Pending laws are answered from articles that are not in force yet.
    laws = verdicts.filter("verdict in ('current', 'pending') and law_num is not null").select("query_id", "law_num", (F.col("verdict") == "pending").alias("pending"))
    rows = index.withColumn("scope_key", F.when(F.col("is_future"), F.lit("f")).otherwise(F.lit("c")))
    both = F.when(F.col("pending") | F.lit(include_future), F.array(F.lit("c"), F.lit("f"))).otherwise(F.array(F.lit("c")))
    groups = laws.select("query_id", F.explode(both).alias("k"), "law_num").select(
        "query_id", F.concat_ws("|", "k", "law_num").alias("law_num")
    )
    scoped = rows.select("id", F.concat_ws("|", "scope_key", "law_num").alias("law_num"), "is_future", "embedding")
    ranked = retrieval.search_in_groups(queries, groups, scoped, PRERANK, include_future=True)
    article = index.select("id", "law_num", "law_id", "law_title", "unique_anchor", "content", "article_summary", "is_future")
    articles = materialize(ranked.join(article, "id").drop("score", "id"))

    chosen = materialize(select_articles(articles, model.select("query_id", "selection")))
    mentioned = names.mentioned_articles(queries, chosen)
    full = chosen.filter(F.length("content") > 0)
    wanted = F.regexp_extract_all("text", F.lit(names.ARTICLE_NUMBER), F.lit(1))
    keys = queries.select("query_id", F.posexplode(wanted).alias("place", "num")).groupBy(
        "query_id", F.concat(F.lit("Main_Article_"), "num").alias("unique_anchor")
    ).agg(F.min("place").cast("bigint").alias("place"))
    laws_of = chosen.select("query_id", "law_num").distinct()
    allowed = keys.join(laws_of, "query_id").join(laws.select("query_id", "law_num", "pending"), ["query_id", "law_num"])
    named = allowed.join(article, ["law_num", "unique_anchor"]).filter(
        ~F.col("is_future") | F.col("pending") | F.lit(include_future)
    )
    named = named.select("query_id", F.lit(0).alias("part"), F.col("place").alias("rank"), *[c for c in article.columns if c != "id"])
    rest = full.join(named.select("query_id", "unique_anchor").distinct(), ["query_id", "unique_anchor"], "left_anti")
    final = named.unionByName(rest.withColumn("part", F.lit(1)).withColumn("rank", F.col("rank").cast("bigint")))

    if "is_summary_only" in index.columns:
        final = _summaries_upgraded(final, chosen.join(index.filter("is_summary_only").select("law_id", "unique_anchor"), ["law_id", "unique_anchor"], "left_semi"), laws, article, include_future)

    if as_of is not None:
        versions = warehouse.resolve_as_of(final, dwh, as_of, today).select(
            "law_num", "unique_anchor", F.col("law_id").alias("v_law_id"), F.col("content").alias("v_content"),
            F.col("article_summary").alias("v_summary"), F.col("anchor").alias("v_anchor"), "enforce_date",
            F.col("is_future").alias("v_future"), "next_enforce_date",
        )
        final = final.join(versions, ["law_num", "unique_anchor"]).select(
            "query_id", "part", "rank", "unique_anchor", F.col("v_law_id").alias("law_id"),
            r.article_title(F.col("law_title"), F.col("v_summary")).alias("title"),
            F.coalesce("v_content", "content").alias("content"),
            r.article_url(F.col("v_law_id"), F.col("v_anchor"), url_base).alias("url"),
            "enforce_date", F.col("v_future").alias("is_future"), "next_enforce_date",
        )
    else:
        nothing = F.lit(None).cast("date")
        final = final.select(
            "query_id", "part", "rank", "unique_anchor", "law_id", F.col("law_title").alias("title"), "content",
            r.article_url(F.col("law_id"), F.lit(None).cast("string"), url_base).alias("url"),
            nothing.alias("enforce_date"), "is_future", nothing.alias("next_enforce_date"),
        )
    # At most selection plus mentions per query, so numbering inside an array is bounded.
    row = F.struct("part", "rank", "unique_anchor", "law_id", "title", "url", "content", "enforce_date", "is_future", "next_enforce_date")
    listed = final.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    references = materialize(listed.select("query_id", F.posexplode("rows").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("n"), "x.title", "x.url", "x.law_id", "x.content", "x.enforce_date", "x.is_future", "x.next_enforce_date"
    ))

    pending_row = F.struct("law_num", "law_title", "future_main_articles", "earliest_future_enforce_date", "enforcement_clause")
    pending = laws.filter("pending").join(status, "law_num").groupBy("query_id").agg(F.sort_array(F.collect_list(pending_row)).alias("pending"))
    mentions = mentioned.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "number", "article_summary"))), lambda m: F.struct(m["number"].alias("number"), m["article_summary"].alias("article_summary"))).alias("mentions")
    )
    titles = found.groupBy("query_id").agg(names.titles_in_order(), F.collect_list(F.struct("start", "end")).alias("title_spans"))
    law_titles = articles.groupBy("query_id").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("rank", "law_title"))), lambda x: x["law_title"])).alias("law_titles"))
    # Each has a row per question at most. Spark would send them through the driver, as they take few bytes when shuffled.
    context = asked
    for side in (titles, law_titles, pending, mentions):
        context = context.join(side.hint("merge"), "query_id", "left")
    empty = F.array().cast("array<string>")
    titles_col = F.coalesce("titles", empty)
    # Words that stand inside a title found in the text are pieces of it, not names of their own.
    spans = F.coalesce("title_spans", F.array().cast("array<struct<start:int,end:int>>"))
    own = F.filter("spans", lambda s: ~F.exists(spans, lambda t: (t["start"] <= s["start"]) & (s["end"] <= t["end"])))
    outside = F.array_distinct(F.transform(own, lambda s: s["name"]))
    prefix = r.prompt_prefix(
        F.coalesce("pending", F.expr("CAST(array() AS array<struct<law_num:string,law_title:string,future_main_articles:bigint,earliest_future_enforce_date:date,enforcement_clause:string>>)")),
        F.lit(as_of).cast("date"),
        names.substitutions(F.concat(outside, titles_col), F.concat("estimated", titles_col)),
        names.divergences(F.col("estimated"), F.coalesce("law_titles", empty)),
        F.coalesce("mentions", F.expr("CAST(array() AS array<struct<number:string,article_summary:string>>)")),
    )
    prefixes = context.select("query_id", prefix.alias("prefix"))

    state = meta.select("fetched", "release").first() if meta is not None else None
    fetched, release = (F.lit(state["fetched"]), F.lit(state["release"])) if state else (F.lit(None).cast("string"),) * 2
    line = r.data_date_line(fetched.cast("string"), release) if state else None
    made = finalize_report(model.select("query_id", r.strip_preamble(F.col("report")).alias("report")), references, line)
    # Badges are made of the same references as the text.
    used = reference_meta(references.withColumn("resolved", F.lit(as_of is not None)))
    used = used.join(made.select("query_id", F.explode("cited").alias("n")), ["query_id", "n"]).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "title", "url", "enforce_date", "is_future", "next_enforce_date"))).alias("references")
    )
    got = articles.select("query_id").distinct().withColumn("_a", F.lit(True))
    whole = full.select("query_id").distinct().withColumn("_f", F.lit(True))
    has = references.select("query_id").distinct().withColumn("_r", F.lit(True))
    out = queries.select("query_id")
    for side in (per_query, got, whole, has, prefixes, made, used):
        out = out.join(side.hint("merge"), "query_id", "left")
    outcome = (
        F.when(F.col("verdict") == "unidentified", "no_law")
        .when(F.col("verdict") == "none", "no_match")
        .when(F.col("_a").isNull(), "no_articles")
        .when(F.col("_f").isNull(), "no_full_articles")
        .when(F.col("_r").isNull(), "no_version")
        .otherwise("ok")
    )
    message = F.element_at(F.create_map(*[F.lit(x) for kv in r.ERRORS.items() for x in kv]), F.col("outcome"))
    ok = F.col("outcome") == "ok"
    return out.withColumn("outcome", outcome).select(
        "query_id", "outcome", "verdict", F.when(ok, F.col("prefix")).alias("prefix"),
        F.when(ok, F.col("report")).otherwise(message).alias("report"), F.when(ok, F.col("cited")).alias("cited"),
        F.when(ok, F.lit(as_of).cast("date")).alias("as_of"), F.when(ok, fetched.cast("string")).alias("data_fetched"),
        F.when(ok, release.cast("string")).alias("data_release"), F.when(ok, F.col("references")).alias("references"),
    )
