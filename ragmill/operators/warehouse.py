"""Corpus warehouse: dedup, merge, version index, as-of resolution, incremental rebuild.

"One row per key" is always an aggregate (max_by / min_by over a struct), not a
window: copies of a hot key fold on the map side instead of meeting in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.dates import enforce_date
from ragmill.operators.vectors import md5_sample

KEY = ("law_id", "unique_anchor")
ARTICLE = ("law_num", "unique_anchor")
# Fixed value: the whole body of a deleted article.
DELETED = "削除"
BODY_SPACE = " 　\n\t"

__all__ = ["md5_sample"]


def pick_one(df: DataFrame, keys: Sequence[str], best: Column, highest: bool = True) -> DataFrame:
    """The row of each key with the highest (or lowest) ``best``."""
    rest = [c for c in df.columns if c not in keys]
    choose = F.max_by if highest else F.min_by
    picked = df.groupBy(*keys).agg(choose(F.struct(*rest), best).alias("_row"))
    return picked.select(*[F.col(k) if k in keys else F.col(f"_row.{k}") for k in df.columns])


def days(col: Column) -> Column:
    return F.unix_date(col)


def dedup_staging(df: DataFrame, keys: Sequence[str] = KEY, tiebreak: Sequence[str] = ("load_no",)) -> DataFrame:
    """One row per key: the last by the tie-break columns."""
    return pick_one(df, keys, F.struct(*tiebreak))


def merge_changed(target: DataFrame, source: DataFrame, loaded_at: Column, stamp: str = "load_timestamp") -> DataFrame:
    """The target's next snapshot.

    New keys are inserted; a matched row changes only where the content differs, which
    also bumps the load time; nothing is deleted and ``enforce_date`` never changes.
    ``source`` must hold one row per key (see ``dedup_staging``).
    """
    cols = [c for c in target.columns if c not in KEY]
    t = target.select(*KEY, F.struct(*cols).alias("t"))
    s_cols = [c for c in source.columns if c not in KEY]
    s = source.select(*KEY, F.struct(*s_cols).alias("s"))
    joined = t.join(s, list(KEY), "full_outer")
    new = F.col("t").isNull()
    changed = F.col("t").isNotNull() & F.col("s").isNotNull() & (F.col("s.content") != F.col("t.content"))
    take = new | F.coalesce(changed, F.lit(False))

    def column(name: str) -> Column:
        old = F.col(f"t.{name}")
        if name == stamp:
            return F.when(take, loaded_at).otherwise(old)
        if name == "enforce_date":
            return F.when(new, enforce_date(F.col("law_id"))).otherwise(old)
        return F.when(take, F.col(f"s.{name}")).otherwise(old) if name in s_cols else old

    return joined.select(*KEY, *[column(c).alias(c) for c in cols]).select(*target.columns)


def title_master(dwh: DataFrame, load_order: str = "load_no") -> DataFrame:
    """One title per law number: titles with a main article first, then the newest."""
    main = F.col("unique_anchor").startswith("Main_Article_")
    titles = dwh.groupBy("law_num", "law_title").agg(
        F.bool_or(main).alias("has_article"),
        F.max(F.struct("promulgate_date", load_order)).alias("newest"),
    )
    best = F.struct(
        (~F.col("has_article")).alias("a"),
        F.coalesce(-days(F.col("newest.promulgate_date")), F.lit(2**31 - 1)).alias("b"),
        (-F.col(f"newest.{load_order}")).alias("c"),
        F.col("law_title").alias("d"),
    )
    out = titles.select("law_num", "law_title", F.col("newest.promulgate_date").alias("promulgate_date"), best.alias("o"))
    return pick_one(out, ["law_num"], F.col("o"), highest=False).drop("o")


def version_index(dwh: DataFrame, today: str) -> DataFrame:
    """One version per article: the newest in force, else the earliest future one."""
    day = F.lit(today).cast("date")
    in_force = F.col("enforce_date") <= day
    order = F.struct(
        in_force.alias("a"),
        F.when(in_force, days(F.col("enforce_date"))).otherwise(-days(F.col("enforce_date"))).alias("b"),
        F.col("law_id").alias("c"),
    )
    picked = pick_one(dwh.filter(F.col("enforce_date").isNotNull()), ARTICLE, order)
    return picked.withColumn("is_future", F.col("enforce_date") > day)


def body_of(content: Column) -> Column:
    """Text after the first line; the whole text when there is only one line."""
    return F.btrim(F.regexp_replace(content, r"^[^\n]*\n", ""), F.lit(BODY_SPACE))


def drop_deletion_stubs(df: DataFrame) -> DataFrame:
    return df.filter(body_of(F.col("content")) != DELETED)


def drop_empty_provision(df: DataFrame) -> DataFrame:
    """Article-less main provisions without a body; a single line counts as no body."""
    has_body = F.contains("content", F.lit("\n")) & (body_of(F.col("content")) != "")
    return df.filter((F.col("unique_anchor") != "Main_Provision") | has_body)


def search_index(dwh: DataFrame, today: str) -> DataFrame:
    """The index rebuild: version choice, then both clean-ups."""
    return drop_empty_provision(drop_deletion_stubs(version_index(dwh, today)))


def prune_missing(dwh: DataFrame, new_keys: DataFrame) -> DataFrame:
    """Keep only rows whose key the new load still has."""
    return dwh.join(new_keys.select(*KEY).distinct(), list(KEY), "left_semi")


def deleted_report(dwh: DataFrame, new_keys: DataFrame) -> DataFrame:
    """Rows that pruning removes, per title, most first."""
    gone = dwh.join(new_keys.select(*KEY).distinct(), list(KEY), "left_anti")
    counts = gone.groupBy("law_title").agg(F.count(F.lit(1)).alias("deleted_rows"))
    return counts.orderBy(F.desc("deleted_rows"), "law_title")


def stash_vectors(df: DataFrame, text: str = "content", vector: str = "embedding", order: str = "id") -> DataFrame:
    """(text_md5, vector): one vector per text hash."""
    kept = df.filter(F.col(vector).isNotNull())
    return kept.groupBy(F.md5(text).alias("text_md5")).agg(F.min_by(vector, order).alias(vector))


def restore_vectors(df: DataFrame, stash: DataFrame, text: str = "content", vector: str = "embedding") -> DataFrame:
    """Fill missing vectors from the stash by text hash.

    Rows that have a vector bypass the join. A text shared by many rows is skewed on the
    left side alone, which adaptive skew handling splits.
    """
    found = stash.select("text_md5", F.col(vector).alias("_found"))
    keyed = df.filter(F.col(vector).isNull()).withColumn("text_md5", F.md5(text))
    restored = keyed.join(found, "text_md5", "left").select(
        *[F.col("_found").alias(c) if c == vector else F.col(c) for c in df.columns]
    )
    return df.filter(F.col(vector).isNotNull()).unionByName(restored)


def pending_counts(targets: dict[str, DataFrame], vector: str = "embedding") -> DataFrame:
    """(target, pending): rows that still lack a vector."""
    return _per_target(targets, lambda: [F.count_if(F.col(vector).isNull()).alias("pending")])


def fill_status(targets: dict[str, DataFrame], vector: str = "embedding") -> DataFrame:
    """(target, total, filled, still_null)."""
    return _per_target(
        targets,
        lambda: [
            F.count(F.lit(1)).alias("total"),
            F.count(vector).alias("filled"),
            F.count_if(F.col(vector).isNull()).alias("still_null"),
        ],
    )


def _per_target(targets, measures) -> DataFrame:
    out = None
    for name, df in targets.items():
        part = df.agg(*measures()).select(F.lit(name).alias("target"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def changed_report(index: DataFrame, stash: DataFrame, text: str = "content") -> DataFrame:
    """(law_num, law_title, changed_rows): texts the stash does not know."""
    new = index.withColumn("text_md5", F.md5(text)).join(stash.select("text_md5"), "text_md5", "left_anti")
    return new.groupBy("law_num", "law_title").agg(F.count(F.lit(1)).alias("changed_rows"))


def resolve_as_of(keys: DataFrame, dwh: DataFrame, as_of: str, today: str) -> DataFrame:
    """The version of each article in force at ``as_of``; articles without one drop out.

    A single aggregate finds both the version and the next change.
    """
    at, now = F.lit(as_of).cast("date"), F.lit(today).cast("date")
    dated = dwh.filter(F.col("enforce_date").isNotNull()).join(
        keys.select(*ARTICLE).distinct(), list(ARTICLE), "left_semi"
    )
    cols = [c for c in dwh.columns if c not in ARTICLE]
    in_force = F.col("enforce_date") <= at
    best = F.when(in_force, F.struct("enforce_date", "law_id"))
    picked = dated.groupBy(*ARTICLE).agg(
        F.max_by(F.struct(*cols), best).alias("v"),
        F.max(in_force).alias("any"),
        F.min(F.when(~in_force, F.col("enforce_date"))).alias("next_enforce_date"),
    )
    return (
        picked.filter("any")
        .select(*ARTICLE, "v.*", "next_enforce_date")
        .withColumn("is_future", F.col("enforce_date") > now)
    )


def resolve_as_of_each(requests: DataFrame, dwh: DataFrame) -> DataFrame:
    """As-of join where every request brings its own date: (request_id, law_num, unique_anchor, as_of).

    Versions collapse to one per (article, date) first. Versions and dates of an article then stand in one order, where
    each date takes the last version before it and the first one after it; they are never paired.
    """
    dated = dwh.filter(F.col("enforce_date").isNotNull())
    versions = pick_one(dated, [*ARTICLE, "enforce_date"], F.col("law_id"))
    cols = [c for c in versions.columns if c not in ARTICLE]
    asked = requests.select(*ARTICLE, "as_of").distinct()
    line = versions.select(
        *ARTICLE, F.col("enforce_date").alias("day"), F.lit(0).alias("kind"), F.struct(*cols).alias("v")
    ).unionByName(
        asked.select(*ARTICLE, F.col("as_of").alias("day"), F.lit(1).alias("kind")), allowMissingColumns=True
    )
    forward = Window.partitionBy(*ARTICLE).orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(*ARTICLE).orderBy(F.desc("day"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        line.withColumn("before", F.last("v", ignorenulls=True).over(forward))
        .withColumn("next_enforce_date", F.last("v.enforce_date", ignorenulls=True).over(back))
        .filter("kind = 1 and before is not null")
        .select(*ARTICLE, F.col("day").alias("as_of"), "before.*", "next_enforce_date")
    )
    return requests.join(found, [*ARTICLE, "as_of"])


def enforcement_status(index: DataFrame, clause_anchor: str = "Suppl_Article_1") -> DataFrame:
    """Per law: main articles in force and pending, the first pending date, the enforcement clause.

    This follows the callers' contract; main articles are those anchored ``Main_Article_``.
    """
    main = F.col("unique_anchor").startswith("Main_Article_")
    return index.groupBy("law_num").agg(
        F.max("law_title").alias("law_title"),
        F.count_if(main & ~F.col("is_future")).alias("current_main_articles"),
        F.count_if(main & F.col("is_future")).alias("future_main_articles"),
        F.min(F.when(main & F.col("is_future"), F.col("enforce_date"))).alias("earliest_future_enforce_date"),
        F.max(F.when(F.col("unique_anchor") == clause_anchor, F.col("content"))).alias("enforcement_clause"),
    )


def classify_enforcement(status: DataFrame) -> DataFrame:
    """A law is current with any main article in force, or with none pending."""
    current = (F.col("current_main_articles") > 0) | (F.col("future_main_articles") == 0)
    return status.withColumn("verdict", F.when(current, "current").otherwise("pending"))


def backfill_default_collection(docs: DataFrame, collections: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(collections, documents): a default collection per owner, given to documents lacking one."""
    owners = docs.filter(F.col("collection_id").isNull()).select("owner").distinct()
    have = collections.filter(F.col("name") == name).select("owner")
    added = owners.join(have, "owner", "left_anti").select(
        F.concat_ws("/", "owner", F.lit(name)).alias("collection_id"), "owner", F.lit(name).alias("name")
    )
    all_collections = collections.unionByName(added)
    default = all_collections.filter(F.col("name") == name).select("owner", F.col("collection_id").alias("_default"))
    lacking = docs.filter(F.col("collection_id").isNull()).join(default, "owner", "left")
    assigned = lacking.withColumn("collection_id", F.col("_default")).select(*docs.columns)
    return all_collections, docs.filter(F.col("collection_id").isNotNull()).unionByName(assigned)
