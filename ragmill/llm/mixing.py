"""Temperature mixing of sources, in DataFrame operations only.

The weight of a source is its token share to the power ``t``. At ``t = 1`` sources keep their shares, at ``t = 0`` all
weigh the same; in between, entropy and the repetition of small sources grow as ``t`` falls. The exponent is
bisected to a target entropy, or to the repetition limit where that is met first. The budget is the smallest
that passes every source once, so no document is lost and small sources repeat.

A source's budget is realised as blocks: each block is one permutation of all its documents by a keyed hash, and the
last block is cut where the budget ends. Tokens are words ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragmill.session import materialize

#: The exponent is a multiple of ``2 ** -BITS``; each round over the sources settles ``ROUND`` bits.
BITS, ROUND = 20, 5
REPEAT_LIMIT = 4.0
SEED = "mix"
WORDS = r"[^\x20\x09-\x0D]+"


def _key(source) -> F.Column:
    """Sources by name; null is a source of its own."""
    return F.concat(F.when(source.isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce(source, F.lit("")))


def order_key(block, doc_id, text_md5, seed: str = SEED) -> F.Column:
    """Where a row stands in a block's permutation; rows equal in id and text stand together."""
    return F.md5(
        F.concat_ws("|", F.lit(seed), block.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("-")), text_md5)
    )


def token_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, s, tokens, text_md5) per row; a null text has no tokens."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "source", _key(F.col("source")).alias("s"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("tokens"), F.md5(text).alias("text_md5"),
    )


def _evaluate(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """exponent -> (entropy of the weights, repetition of the source that repeats most); one row each to the driver."""
    e = F.col("e")
    power = F.pow("p", e)
    rows = (
        shares.withColumn("e", F.explode(F.array(*[F.lit(x) for x in exponents])))
        .groupBy("e")
        .agg(
            F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("zl"),
            F.max(F.pow(F.col("top") / F.col("p"), 1 - e)).alias("repeat"),
        )
        .select("e", (F.log("z") - e * F.col("zl") / F.col("z")).alias("h"), "repeat")
        .collect()
    )
    return {r["e"]: (r["h"], r["repeat"]) for r in rows}


def _bisect(shares: DataFrame, fits) -> float:
    """The largest multiple of ``2 ** -BITS`` in [0, 1) that ``fits`` (which holds up to some point), else 0.

    One pass over the sources tries the ``2 ** ROUND - 1`` inner points of ``ROUND`` halvings.
    """
    low, step = 0, 1 << BITS
    for _ in range(BITS // ROUND):
        step >>= ROUND
        points = [(low + step * i) / (1 << BITS) for i in range(1, 1 << ROUND)]
        found = _evaluate(shares, points)
        low += step * sum(1 for x in points if fits(*found[x]))
    return low / (1 << BITS)


def weights(totals: DataFrame, entropy: float | None = None, repeat_limit: float = REPEAT_LIMIT) -> DataFrame:
    """(s, tokens, weight, budget, blocks, rest) per source with tokens, from (s, tokens).

    ``entropy`` is the target in nats; by default half way between the shares' own and the largest possible. ``blocks``
    whole passes and ``rest`` tokens of one more make up the budget. Without tokens there are no rows.
    """
    some = totals.filter("tokens > 0")
    scale = some.agg(F.sum("tokens").alias("n"), F.max("tokens").alias("m"), F.count("*").alias("k")).first()
    if not scale["k"]:
        return some.selectExpr("s", "tokens", "1D as weight", "tokens as budget", "1L as blocks", "0L as rest")
    shares = some.select("s", "tokens", (F.col("tokens") / F.lit(scale["n"])).alias("p"), F.lit(scale["m"] / scale["n"]).alias("top"))
    ends = _evaluate(shares, [0.0, 1.0])
    target = (ends[0.0][0] + ends[1.0][0]) / 2 if entropy is None else entropy
    by_entropy = _bisect(shares, lambda h, repeat: h >= target)
    if ends[0.0][1] <= repeat_limit:
        by_limit = 0.0
    else:
        by_limit = _bisect(shares, lambda h, repeat: repeat > repeat_limit) + 2.0**-BITS
    t = max(by_entropy, by_limit)
    z = shares.agg(F.sum(F.pow("p", F.lit(t))).alias("z")).first()["z"]
    budget = F.floor(F.col("tokens") * F.pow(F.col("top") / F.col("p"), F.lit(1 - t)) + 1e-6)
    return shares.select(
        "s", "tokens", (F.pow("p", F.lit(t)) / z).alias("weight"), budget.alias("budget"),
    ).withColumn("blocks", F.expr("budget div tokens")).withColumn("rest", F.col("budget") - F.col("blocks") * F.col("tokens"))


def plan(rows: DataFrame, entropy: float | None = None, repeat_limit: float = REPEAT_LIMIT, seed: str = SEED) -> DataFrame:
    """(s, weight, budget, blocks, cut): whole passes of each source, and the last key of its cut block.

    The running sum over a permutation first skips whole hash buckets, by sums of (source, bucket); only the one
    bucket where the budget ends is ordered. A source with a third of all rows is spread over 4,096 buckets.
    """
    totals = rows.groupBy("s").agg(F.sum("tokens").alias("tokens"))
    sources = materialize(weights(materialize(totals), entropy, repeat_limit))
    keyed = rows.filter("tokens > 0").join(sources.filter("rest > 0").select("s", "blocks", "rest"), "s").select(
        "s", "rest", "tokens", order_key(F.col("blocks"), F.col("doc_id"), F.col("text_md5"), seed).alias("key")
    )
    keyed = keyed.withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy("s", "rest", "bucket").agg(F.sum("tokens").alias("tokens"), F.max("key").alias("last"))
    upto = Window.partitionBy("s").orderBy("bucket")
    run = materialize(sums.withColumn("upto", F.sum("tokens").over(upto)))
    whole = run.filter("upto <= rest").groupBy("s").agg(F.max("last").alias("whole_cut"))
    ends = run.filter("upto > rest and upto - tokens < rest").select("s", "bucket", (F.col("upto") - F.col("tokens")).alias("before"))
    inside = Window.partitionBy("s", "bucket").orderBy("key")
    part = (
        keyed.join(ends, ["s", "bucket"]).withColumn("at", F.col("before") + F.sum("tokens").over(inside))
        .filter("at <= rest").groupBy("s").agg(F.max("key").alias("part_cut"))
    )
    return (
        sources.join(whole, "s", "left").join(part, "s", "left")
        .select("s", "weight", "budget", "blocks", F.coalesce("part_cut", "whole_cut", F.lit("")).alias("cut"))
    )


def _passes(rows: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """``rows`` (with s, doc_id, text_md5, tokens) once per block that they are in, with ``block``."""
    last = order_key(F.col("blocks"), F.col("doc_id"), F.col("text_md5"), seed) <= F.col("cut")
    # Rows without tokens cost nothing: they stay, once.
    count = F.when(F.col("tokens") == 0, 1).otherwise(F.col("blocks") + F.when(last, 1).otherwise(0))
    return (
        rows.join(sources, "s", "left").fillna({"blocks": 1, "cut": ""})
        .withColumn("block", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    )


def mix(docs: DataFrame, entropy: float | None = None, repeat_limit: float = REPEAT_LIMIT, seed: str = SEED) -> DataFrame:
    """(doc_id, source, block, order_key, tokens, weight): one row per pass of a document.

    A source is read block after block, each in the order of ``order_key``. Every row of ``docs`` is in at least one
    block; rows without tokens are in the first only, with the weight null where their source has none. Null texts have no
    tokens, texts of any length are counted whole; rows that share an id or a text are passed each. An empty table gives no
    rows. Columns other than doc_id, text and source are not read, whatever their names are.
    """
    rows = materialize(token_rows(docs))
    return _passes(rows, plan(rows, entropy, repeat_limit, seed), seed).select(
        "doc_id", "source", "block", order_key(F.col("block"), F.col("doc_id"), F.col("text_md5"), seed).alias("order_key"),
        "tokens", "weight",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, in their own columns, as often as the mix passes them; none where ``docs`` is empty."""
    names = docs.columns
    seed = options.get("seed", SEED)
    rows = materialize(token_rows(docs))
    sources = plan(rows, **options)
    own = docs.withColumns({f"__{n}": F.col(n) for n in names})
    text = F.coalesce("text", F.lit(""))
    own = own.select(
        *[F.col(f"__{n}") for n in names], "doc_id", _key(F.col("source")).alias("s"), F.md5(text).alias("text_md5"),
        (~F.rlike(text, F.lit(WORDS))).alias("blank"),
    ).withColumn("tokens", F.when(F.col("blank"), 0).otherwise(1))
    return _passes(own, sources, seed).select(*[F.col(f"__{n}").alias(n) for n in names])


ORACLE = r"""
with recursive rows as (
  select doc_id, source, case when source is null then 'n' else 's' end || coalesce(source, '') as s,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as tokens, md5(coalesce(text, '')) as text_md5
  from documents),
totals as (select s, sum(tokens)::bigint as tokens from rows group by s having sum(tokens) > 0),
shares as (select s, tokens, tokens / (select sum(tokens) from totals) as p from totals),
ps as (select list(p order by s) as l, max(p) as top, min(p) as least from shares),
target as (select (ln(len(l)) - list_sum(list_transform(l, lambda p: p * ln(p)))) / 2 as h from ps),
b as (
  select 0 as step, 0::double as e, 0::double as r
  union all
  select step + 1,
    case when (select ln(list_sum(list_transform(l, lambda p: pow(p, e + pow(2, -step - 1)))))
        - (e + pow(2, -step - 1)) * list_sum(list_transform(l, lambda p: pow(p, e + pow(2, -step - 1)) * ln(p)))
          / list_sum(list_transform(l, lambda p: pow(p, e + pow(2, -step - 1)))) >= (select h from target) from ps)
      then e + pow(2, -step - 1) else e end,
    case when (select pow(top / least, 1 - (r + pow(2, -step - 1))) > 4 from ps) then r + pow(2, -step - 1) else r end
  from b where step < 20),
t as (select greatest(e, case when (select top / least <= 4 from ps) then 0 else r + pow(2, -20) end) as t from b where step = 20),
budgets as (
  select s, tokens, pow(p, t) / (select sum(pow(p, (select t from t))) from shares) as weight,
         floor(tokens * pow((select top from ps) / p, 1 - t) + 1e-6)::bigint as budget from shares, t),
sources as (select *, budget // tokens as blocks, budget % tokens as rest from budgets),
keyed as (
  select r.*, b.weight, coalesce(b.blocks, 1) as blocks, coalesce(b.rest, 0) as rest,
         md5('mix|' || coalesce(b.blocks, 1) || '|' || coalesce(r.doc_id::varchar, '-') || '|' || text_md5) as key
  from rows r left join sources b using (s)),
run as (select *, sum(tokens) over (partition by s order by key) as upto from keyed),
passes as (select *, case when tokens = 0 then 1 else blocks + (upto <= rest)::int end as n from run),
out as (select doc_id, source, unnest(range(n)) as block, tokens, weight, text_md5 from passes)
select doc_id, source, block::int as block,
       md5('mix|' || block || '|' || coalesce(doc_id::varchar, '-') || '|' || text_md5) as order_key, tokens, weight
from out
"""
