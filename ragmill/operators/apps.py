"""Application tables: teams, users, apps, invocations, messages, collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The team every user belongs to, status words, and how they are shown.
COMMON_TEAM = "00000000-0000-0000-0000-000000000000"
APP_STATUS = ("draft", "published")
SHOWN_STATUS = {"running": "IN_PROGRESS", "success": "COMPLETED", "error": "ERROR"}
UNKNOWN_STATUS = "ACCEPTED"
TTL_DAYS = 364
SYSTEM_ADMIN, TEAM_ADMIN = "SystemAdminGroup", "TeamAdminGroup"
TEXT_FIELDS = ("endpoint", "config", "placeholder", "systemPrompt", "systemPromptKeyName", "howToUse")
KEPT_FIELDS = ("endpoint", "config", "placeholder", "howToUse")
PROMPT_FIELDS = ("systemPrompt", "systemPromptKeyName")
HEAVY_FIELDS = ("endpoint", "config", "systemPrompt", "systemPromptKeyName")
CONFIG_DDL = ", ".join(f"{f} string" for f in TEXT_FIELDS) + ", copyable boolean, status string"


def millis(ts: Column) -> Column:
    """Epoch milliseconds as text, as times are shown to clients."""
    return F.unix_millis(ts.cast("timestamp")).cast("string")


def list_with_counts(parents: DataFrame, children: DataFrame, key: str, order: Column, name: str = "n") -> DataFrame:
    """Parents with the number of their children, 0 included."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    out = parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out.orderBy(order, key)


def name_contains(df: DataFrame, column: str, part: str) -> DataFrame:
    """Case-insensitive substring; ``%`` and ``_`` mean themselves."""
    return df.filter(F.contains(F.lower(column), F.lower(F.lit(part))))


def admin_scope(teams: DataFrame, users: DataFrame, user_id) -> DataFrame:
    """Teams in which the user is an admin."""
    mine = users.filter((F.col("user_id") == user_id) & F.col("is_admin")).select("team_id")
    return teams.join(mine, "team_id", "left_semi")


def visible_apps(users: DataFrame, teams: DataFrame, apps: DataFrame, common_team) -> DataFrame:
    """(user_id, team_id, app_id, team_name, …): apps of each user's teams and the common team.

    Teams that do not exist are skipped. The list is for the users who ask; for all users
    at once see ``visible_app_counts``.
    """
    named = apps.join(teams.select("team_id", F.col("name").alias("team_name")), "team_id")
    return _scope(users, common_team).join(named, "team_id")


def _scope(users: DataFrame, common_team) -> DataFrame:
    own = users.select("user_id", "team_id")
    common = users.select("user_id").withColumn("team_id", F.lit(common_team).cast(users.schema["team_id"].dataType))
    return own.unionByName(common).distinct()


def visible_app_counts(users: DataFrame, teams: DataFrame, apps: DataFrame, common_team) -> DataFrame:
    """(user_id, teams, apps): what every user sees, without pairing users with apps."""
    per_team = apps.groupBy("team_id").agg(F.count(F.lit(1)).alias("_apps"))
    known = teams.select("team_id").join(per_team, "team_id", "left")
    return _scope(users, common_team).join(known, "team_id").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("teams"), F.sum(F.coalesce("_apps", F.lit(0))).alias("apps")
    )


def last_admin_guard(users: DataFrame, operations: DataFrame) -> DataFrame:
    """Operations (team_id, user_id, action) with ``outcome``.

    Deleting an admin, or demoting anybody, needs two admins in the team.
    """
    admins = users.groupBy("team_id").agg(F.count_if("is_admin").alias("_admins"))
    joined = operations.join(users, ["team_id", "user_id"], "left").join(admins, "team_id", "left")
    few = F.coalesce("_admins", F.lit(0)) < 2
    blocked = few & (((F.col("action") == "delete") & F.col("is_admin")) | (F.col("action") == "demote"))
    outcome = F.when(F.col("is_admin").isNull(), "not_found").when(blocked, "last_admin").otherwise("ok")
    return joined.withColumn("outcome", outcome).select(*operations.columns, "outcome")


def access_check(requests: DataFrame, users: DataFrame) -> DataFrame:
    """(…, admin_ok, member_ok) of requests (user_id, team_id, groups)."""
    joined = requests.join(users.select("team_id", "user_id", "is_admin"), ["team_id", "user_id"], "left")
    system = F.array_contains("groups", SYSTEM_ADMIN)
    team = F.array_contains("groups", TEAM_ADMIN) & F.coalesce("is_admin", F.lit(False))
    return joined.withColumn("admin_ok", system | team).withColumn("member_ok", system | F.col("is_admin").isNotNull()).drop("is_admin")


def unpack_config(payload: Column) -> Column:
    """The config JSON as a struct with defaults; an unknown status is a draft."""
    raw = F.from_json(payload, CONFIG_DDL)
    texts = [F.coalesce(raw[f], F.lit("")).alias(f) for f in TEXT_FIELDS]
    status = F.when(raw["status"].isin(*APP_STATUS), raw["status"]).otherwise(APP_STATUS[0])
    return F.struct(*texts, F.coalesce(raw["copyable"], F.lit(False)).alias("copyable"), status.alias("status"))


def app_view(apps: DataFrame, light: bool) -> DataFrame:
    """Apps as clients see them: the key is never shown, the light view blanks heavy fields."""
    rows = apps.withColumn("_c", unpack_config(F.col("config")))
    shown = [(F.lit("") if light and f in HEAVY_FIELDS else F.col(f"_c.{f}")).alias(f) for f in TEXT_FIELDS]
    return rows.select(
        "team_id", "app_id", F.col("name").alias("app_name"), *shown,
        F.coalesce("description", F.lit("")).alias("description"), F.lit("").alias("api_key"),
        "_c.copyable", "_c.status", millis(F.col("created_at")).alias("created_date"), millis(F.col("updated_at")).alias("updated_date"),
    )


def patch_apps(apps: DataFrame, patches: DataFrame) -> DataFrame:
    """Apps (team_id, app_id, name, description, config) after patches with columns p_*.

    Non-empty texts win, the boolean and a known status win, and the two prompt fields
    are always overwritten, also with nothing.
    """
    rows = apps.join(patches, ["team_id", "app_id"], "left").withColumn("_c", unpack_config(F.col("config")))
    given = F.col("p_present")
    full = lambda f: given & (F.length(F.col(f"p_{f}")) > 0)
    fields = {f: F.when(full(f), F.col(f"p_{f}")).otherwise(F.col(f"_c.{f}")) for f in KEPT_FIELDS}
    fields |= {f: F.when(given, F.coalesce(f"p_{f}", F.lit(""))).otherwise(F.col(f"_c.{f}")) for f in PROMPT_FIELDS}
    fields["copyable"] = F.coalesce(F.when(given, F.col("p_copyable")), F.col("_c.copyable"))
    fields["status"] = F.when(given & F.col("p_status").isin(*APP_STATUS), F.col("p_status")).otherwise(F.col("_c.status"))
    order = (*TEXT_FIELDS, "copyable", "status")
    merged = F.to_json(F.struct(*[fields[f].alias(f) for f in order]))
    return rows.select(
        "team_id", "app_id",
        F.when(full("name"), F.col("p_name")).otherwise(F.col("name")).alias("name"),
        F.when(full("description"), F.col("p_description")).otherwise(F.col("description")).alias("description"),
        F.when(given, merged).otherwise(F.col("config")).alias("config"),
    )


def copy_apps(requests: DataFrame, teams: DataFrame, apps: DataFrame, keys: DataFrame) -> DataFrame:
    """(…, outcome, config): the endpoint comes from the source, the rest from the request.

    Requests are (request_id, team_id, app_id, name, config); ``keys`` lists apps that have a key.
    """
    source = apps.select("team_id", "app_id", unpack_config(F.col("config")).alias("_s"))
    joined = (
        requests.join(teams.select("team_id").distinct().withColumn("_t", F.lit(True)), "team_id", "left")
        .join(source, ["team_id", "app_id"], "left")
        .join(keys.select("team_id", "app_id").distinct().withColumn("_k", F.lit(True)), ["team_id", "app_id"], "left")
    )
    outcome = (
        F.when(F.col("_t").isNull(), "no_team")
        .when(F.col("_s").isNull(), "no_app")
        .when(~F.col("_s.copyable"), "not_copyable")
        .when(F.col("_k").isNull(), "no_key")
        .otherwise("ok")
    )
    asked = unpack_config(F.col("config"))
    made = F.to_json(asked.withField("endpoint", F.col("_s.endpoint")))
    return joined.withColumn("outcome", outcome).select(
        "request_id", "team_id", "app_id", "name", "outcome", F.when(F.col("outcome") == "ok", made).alias("config")
    )


def cascade_delete(gone: DataFrame, collections: DataFrame, documents: DataFrame, chunks: DataFrame):
    """(collections, documents, chunks, object_keys) after deleting collections by id.

    Documents and chunks go with their collection; the keys of deleted originals are
    returned so that the objects can be removed.
    """
    ids = gone.select("collection_id").distinct()
    dead = documents.join(ids, "collection_id", "left_semi")
    keys = dead.filter(F.length("bronze_key") > 0).select("bronze_key")
    return (
        collections.join(ids, "collection_id", "left_anti"),
        documents.join(ids, "collection_id", "left_anti"),
        chunks.join(dead.select("document_id"), "document_id", "left_anti"),
        keys,
    )


def snapshot_names(invocations: DataFrame, teams: DataFrame, apps: DataFrame) -> DataFrame:
    """Invocations with the team and app names of this moment; unknown apps drop out."""
    named = apps.select("team_id", "app_id", F.col("name").alias("app_name_snapshot"))
    teams = teams.select("team_id", F.col("name").alias("team_name_snapshot"))
    return invocations.join(named, ["team_id", "app_id"]).join(teams, "team_id")


def history_view(df: DataFrame) -> DataFrame:
    """Status, outputs as text, valid artifacts, and times in milliseconds.

    ``outputs`` is JSON text: a string, an object, or {outputs, artifacts}.
    """
    v = F.try_parse_json("outputs")
    kind = F.schema_of_variant(v)
    structured = kind.startswith("OBJECT") & F.col("outputs").rlike(r'"outputs"\s*:') & F.col("outputs").rlike(r'"artifacts"\s*:')
    inner = F.try_variant_get(v, "$.outputs", "string")
    plain = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
    text = F.when(v.isNull() | (kind == "VOID"), "").when(structured, F.coalesce(inner, F.lit(""))).otherwise(plain)
    refs = F.try_variant_get(v, "$.artifacts", "array<variant>")
    field = lambda a, name: F.try_variant_get(a, f"$.{name}", "string")
    is_text = lambda a, name: F.schema_of_variant(F.try_variant_get(a, f"$.{name}", "variant")) == "STRING"
    valid = F.filter(refs, lambda a: is_text(a, "displayName") & is_text(a, "s3Url"))
    artifacts = F.transform(
        valid, lambda a: F.struct(field(a, "displayName").alias("display_name"), field(a, "s3Url").alias("s3_url"))
    )
    shown = F.create_map(*[F.lit(x) for kv in SHOWN_STATUS.items() for x in kv])
    return df.select(
        *[c for c in df.columns if c not in ("status", "outputs", "created_date")],
        F.coalesce(F.try_element_at(shown, F.col("status")), F.lit(UNKNOWN_STATUS)).alias("status"),
        text.alias("outputs"), F.when(structured & (F.size(artifacts) > 0), artifacts).alias("artifacts"),
        millis(F.col("created_date")).alias("created_date"),
    )


def pack_messages(df: DataFrame, now_ms: int) -> DataFrame:
    """Message rows: variable fields as JSON, a missing time becomes ``now + pos # 0``.

    ``pos`` is the place in the request, from 0.
    """
    content = F.to_json(F.struct("content", F.col("message_id").alias("messageId"), "usecase", "trace"))
    made = F.concat((F.lit(now_ms) + F.col("pos")).cast("string"), F.lit("#0"))
    return df.select(
        "chat_id", F.coalesce("created_date", made).alias("created_date"), "user_id", "role", content.alias("content"),
        F.lit("none").alias("feedback"), F.coalesce("llm_type", F.lit("")).alias("llm_type"),
        expire_at(F.timestamp_millis(F.lit(now_ms))).alias("expire_at"),
    )


def unpack_messages(df: DataFrame) -> DataFrame:
    """Message rows as clients see them."""
    p = F.from_json("content", "content string, trace string, messageId string, usecase string, extraData string")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return df.select(
        F.concat(F.lit("chat#"), F.col("chat_id").cast("string")).alias("id"), "created_date", blank(p["messageId"]).alias("message_id"),
        blank(p["usecase"]).alias("usecase"), "user_id", F.coalesce("feedback", F.lit("none")).alias("feedback"), "role",
        blank(p["content"]).alias("content"), p["trace"].alias("trace"), p["extraData"].alias("extra_data"), blank(F.col("llm_type")).alias("llm_type"),
    )


def expire_at(ts: Column) -> Column:
    return ts + F.expr(f"INTERVAL {TTL_DAYS} DAYS")


def purge_expired(df: DataFrame, now: Column) -> DataFrame:
    return df.filter(F.col("expire_at").isNull() | (F.col("expire_at") >= now))


def unique_names(df: DataFrame, keys: tuple[str, ...] = ("owner", "name")) -> DataFrame:
    """Rows with ``conflict``: their owner uses the name more than once.

    Only conflicting keys are joined back, so unique rows are not gathered by key.
    """
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return df.join(twice.withColumn("_c", F.lit(True)), list(keys), "left").withColumn("conflict", F.coalesce("_c", F.lit(False))).drop("_c")


def lookup_by_key(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests (team_id, app_id, user_id, created_ms as text) with the row found, or nulls."""
    at = keys.withColumn("created_date", F.timestamp_millis(F.col("created_ms").cast("bigint")))
    return at.join(df, ["team_id", "app_id", "user_id", "created_date"], "left")


def delete_by_key(df: DataFrame, keys: DataFrame) -> DataFrame:
    at = keys.select("team_id", "app_id", "user_id", F.timestamp_millis(F.col("created_ms").cast("bigint")).alias("created_date"))
    return df.join(at, ["team_id", "app_id", "user_id", "created_date"], "left_anti")


def patch_collections(collections: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches (patch_id, owner, collection_id, p_name, p_description) with outcome and new values.

    not_found for a foreign or missing one, conflict when the owner already has the name.
    """
    rows = patches.join(collections, ["owner", "collection_id"], "left")
    taken = collections.select("owner", F.col("name").alias("p_name"), F.col("collection_id").alias("_other"))
    clash = patches.join(taken, ["owner", "p_name"]).filter(F.col("_other") != F.col("collection_id"))
    clash = clash.select("patch_id").distinct().withColumn("_clash", F.lit(True))
    joined = rows.join(clash, "patch_id", "left")
    outcome = F.when(F.col("name").isNull(), "not_found").when(F.col("_clash"), "conflict").otherwise("ok")
    ok = outcome == "ok"
    return joined.select(
        "patch_id", "owner", "collection_id", outcome.alias("outcome"),
        F.when(ok, F.coalesce("p_name", "name")).otherwise(F.col("name")).alias("name"),
        F.when(ok, F.coalesce("p_description", "description")).otherwise(F.col("description")).alias("description"),
    )


# Limits of the request fields.
NAME_MAX, DESCRIPTION_MAX, TITLE_MAX, QUERY_MAX = 100, 1000, 200, 1000
COLLECTIONS_MAX, TOP_K_MAX, KEY_MAX = 50, 50, 1024


def validate_requests(df: DataFrame) -> DataFrame:
    """Requests (kind, title, text, bronze_key, query, top_k, collections, name, description) with ``violations``.

    kind is ingest, search or collection; missing fields are null.
    """
    kind, length = F.col("kind"), lambda c: F.length(F.trim(F.col(c)))
    ingest, search, collection = kind == "ingest", kind == "search", kind == "collection"
    rules = {
        "title_length": ingest & ((length("title") == 0) | (length("title") > TITLE_MAX)),
        "key_length": ingest & ((F.length("bronze_key") == 0) | (F.length("bronze_key") > KEY_MAX)),
        "text_empty": ingest & (F.length("text") == 0),
        "key_or_text": ingest & (F.col("bronze_key").isNull() == F.col("text").isNull()),
        "title_required": ingest & F.col("bronze_key").isNull() & F.col("title").isNull(),
        "query_length": search & ((F.coalesce(length("query"), F.lit(0)) == 0) | (length("query") > QUERY_MAX)),
        "collections": search & ((F.size("collections") > COLLECTIONS_MAX) | F.exists("collections", lambda c: F.length(c) == 0)),
        "top_k": search & ((F.col("top_k") < 1) | (F.col("top_k") > TOP_K_MAX)),
        "name_length": collection & ((F.coalesce(length("name"), F.lit(0)) == 0) | (length("name") > NAME_MAX)),
        "description_length": collection & (F.length("description") > DESCRIPTION_MAX),
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.withColumn("violations", found)
