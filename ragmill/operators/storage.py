"""Object keys, storage urls, payloads kept beside the table, endpoint rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragmill.functions.text import let
from ragmill.session import materialize

# Limits, url forms and address ranges.
OFFLOAD_BYTES = 10_240
S3_URL = r"^s3://([^/]+)/(.+)$"
HTTPS_URL = r"^https://([^.]+)\.s3[^/]*\.amazonaws\.com/(.+)$"
UUID_JSON = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\.json$"
MARKER = "__inputsRef"
BAD_URL_CHARS = r"[\x00-\x1F⁄∕／\\]"
ENCODED_SLASH = r"(?i)%25(?:2f|5c)|%(?:2f|5c)"
PRIVATE_RANGES = ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "0.0.0.0/8")
LOCAL_NAMES = ("localhost", "host.docker.internal", "::1", "::")
#: First bits of an IPv4 address that make a bucket of the allow-list.
BUCKET_BITS = 16


def key_owner(key: Column) -> Column:
    """The first segment of an object key; null when it is empty."""
    return F.nullif(F.split_part(key, F.lit("/"), F.lit(1)), F.lit(""))


def owned_key(key: Column, owner: Column) -> Column:
    """The key starts with the owner, has three segments or more, and none is empty, ``.`` or ``..``."""
    parts = F.split(key, "/")
    clean = F.forall(parts, lambda p: ~p.isin("", ".", ".."))
    return F.coalesce(key_owner(key) == owner, F.lit(False)) & (F.size(parts) >= 3) & clean


def parse_storage_url(url: Column) -> Column:
    """(bucket, key) of an s3:// or https:// form; nulls for anything else."""
    either = lambda i: F.coalesce(F.nullif(F.regexp_extract(url, S3_URL, i), F.lit("")), F.nullif(F.regexp_extract(url, HTTPS_URL, i), F.lit("")))
    return F.struct(either(1).alias("bucket"), either(2).alias("key"))


def authorize_url(url: Column, user: Column, bucket: str) -> Column:
    """ok, bad_url, foreign_bucket, bad_path or foreign_owner."""
    plain = F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))
    parsed = parse_storage_url(plain)
    owner = key_owner(parsed["key"])
    return (
        F.when(parsed["key"].isNull(), "bad_url")
        .when(parsed["bucket"] != bucket, "foreign_bucket")
        .when(owner.isNull(), "bad_path")
        .when(owner != user, "foreign_owner")
        .otherwise("ok")
    )


def _uuid(*parts: str) -> Column:
    digest = F.md5(F.concat_ws("\x1f", *[F.col(p).cast("string") for p in parts]))
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _prefix() -> Column:
    return F.concat(F.lit("inputs/"), *[F.concat(F.col(c).cast("string"), F.lit("/")) for c in ("team_id", "app_id", "user_id")])


def offload_large(df: DataFrame, bucket: str, limit: int = OFFLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, payloads): inputs above the limit move to (object_key, payload), a marker stays.

    Rows are (team_id, app_id, user_id, created_date, inputs as JSON text). The object
    name follows from the row's key, so a retried write gives the same one.
    """
    key = F.concat(_prefix(), _uuid("team_id", "app_id", "user_id", "created_date"), F.lit(".json"))
    large = F.octet_length("inputs") > limit
    marker = F.to_json(F.struct(F.concat(F.lit(f"s3://{bucket}/"), key).alias(MARKER)))
    payloads = df.filter(large).select(key.alias("object_key"), F.col("inputs").alias("payload"))
    return df.withColumn("inputs", F.when(large, marker).otherwise(F.col("inputs"))), payloads


def rehydrate(df: DataFrame, payloads: DataFrame, bucket: str) -> DataFrame:
    """Markers replaced by their payload, only where they name the row's own object; others stay."""
    url = parse_storage_url(F.get_json_object("inputs", f"$.{MARKER}"))
    rest = F.replace(url["key"], _prefix(), F.lit(""))
    own = (url["bucket"] == bucket) & F.startswith(url["key"], _prefix()) & rest.rlike(UUID_JSON)
    own = F.coalesce(own, F.lit(False))
    # Rows without an own marker bypass the join: as null keys they would meet in one task.
    joined = df.filter(own).withColumn("object_key", url["key"]).join(payloads, "object_key", "left")
    restored = joined.withColumn("inputs", F.coalesce("payload", "inputs")).select(*df.columns)
    return df.filter(~own).unionByName(restored)


def artifact_name(name: Column) -> Column:
    clean = F.left(F.regexp_replace(name, r"[^A-Za-z0-9_.\-]+", "_"), F.lit(120))
    return F.when(F.length(clean) > 0, clean).otherwise("file")


def explode_artifacts(df: DataFrame, bucket: str, limit: int = OFFLOAD_BYTES) -> DataFrame:
    """(…key, idx, display_name, storage_key, content) of the results in ``body`` (JSON text).

    Artifacts keep their number when an earlier one cannot be decoded; outputs above the
    limit become an artifact of their own, without number.
    """
    keys = ["user_id", "app_id", "created_date"]
    base = F.concat(
        F.col("user_id").cast("string"), F.lit("/"), F.col("app_id").cast("string"), F.lit("/"), F.unix_millis(F.col("created_date").cast("timestamp")).cast("string"), F.lit("/")
    )
    rows = df.select(*keys, F.try_parse_json("body").alias("v"))
    listed = F.try_variant_get("v", "$.artifacts", "array<variant>")
    kept = F.filter(listed, lambda a: F.schema_of_variant(a).rlike("^(OBJECT|ARRAY)"))
    each = rows.select(*keys, F.posexplode(kept).alias("idx", "a"))
    text = lambda name: F.when(
        F.schema_of_variant(F.try_variant_get("a", f"$.{name}", "variant")) == "STRING", F.try_variant_get("a", f"$.{name}", "string")
    )
    shown = F.coalesce(text("display_name"), F.concat(F.lit("artifact-"), F.col("idx").cast("string")))
    content = F.try_to_binary(text("contents"), F.lit("base64"))
    named = each.select(*keys, "idx", shown.alias("display_name"), content.alias("content")).filter(F.col("content").isNotNull())
    stored = F.concat(base, F.col("idx").cast("string"), F.lit("-"), artifact_name(F.col("display_name")))
    files = named.select(*keys, "idx", "display_name", stored.alias("storage_key"), "content")

    outputs = F.try_variant_get("v", "$.outputs", "string")
    large = rows.filter(F.octet_length(outputs) > limit).select(
        *keys, F.lit(None).cast("int").alias("idx"), F.lit("outputs.txt").alias("display_name"),
        F.concat(base, F.lit("outputs.txt")).alias("storage_key"), F.encode(outputs, "utf-8").alias("content"),
    )
    return files.unionByName(large).withColumn("s3_url", F.concat(F.lit(f"s3://{bucket}/"), "storage_key"))


def url_host(url: Column) -> Column:
    """Lower-case host of a url without user, port and trailing dot."""
    authority = F.regexp_extract(F.trim(url), r"(?i)^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    return F.lower(F.regexp_replace(host, r"\.$", ""))


def valid_url(url: Column, host: str) -> Column:
    """HTTPS on exactly this host, no user info, no control, look-alike or encoded slash."""
    authority = F.regexp_extract(F.trim(url), r"(?i)^https://([^/?#]*)", 1)
    port = F.regexp_extract(authority, r":(\d*)$", 1)
    ok = (F.length(authority) > 0) & ~F.contains(authority, F.lit("@")) & (url_host(url) == host)
    ok = ok & ((port == "") | (F.coalesce(port.try_cast("int"), F.lit(70000)) <= 65535))
    return F.coalesce(~url.rlike(BAD_URL_CHARS) & ~url.rlike(ENCODED_SLASH) & ok, F.lit(False))


def ipv4(host: Column) -> Column:
    """The address as a number; null when it is not four numbers up to 255."""

    def number(parts: Column) -> Column:
        value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p)
        return F.when((F.size(parts) == 4) & F.forall(parts, lambda p: p <= 255), value)

    good = F.when(host.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), host)
    return let(F.transform(F.split(good, r"\."), lambda p: p.try_cast("bigint")), number)


def _range(cidr: str) -> tuple[int, int] | None:
    """First and last address of an IPv4 range; null when it is not one."""
    import ipaddress

    try:
        net = ipaddress.IPv4Network(cidr, strict=False)
    except ValueError:
        return None
    return int(net.network_address), int(net.broadcast_address)


def in_ranges(address: Column, ranges: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for low, high in filter(None, map(_range, ranges)):
        out = out | address.between(low, high)
    return F.coalesce(out, F.lit(False))


def is_private(host: Column) -> Column:
    def private(h: Column) -> Column:
        named = h.isin(*LOCAL_NAMES) | h.endswith(".localhost") | h.rlike("^f[cd][0-9a-f]{2}:") | h.rlike("^fe[89ab][0-9a-f]:")
        plain = ~F.contains(h, F.lit("."))
        return named | let(ipv4(h), lambda address: F.when(address.isNotNull(), in_ranges(address, PRIVATE_RANGES)).otherwise(plain))

    return let(host, private)


def listed_hosts(hosts: DataFrame, entries: DataFrame) -> DataFrame:
    """The distinct rows of ``hosts`` (host) that the allow-list ``entries`` (entry) names: host names, or IPv4 ranges.

    Addresses and ranges meet in buckets of the first ``BUCKET_BITS`` bits. A range of so many bits or fewer covers whole buckets.
    Of the longer ones a running maximum of last addresses tells whether any that begins before an address reaches it; a
    bucket has 65,536 addresses at most, so no window grows with the tables. Entries that are neither are left out.
    """
    own = F.col("entry")
    names = entries.filter(~F.contains(own, F.lit("/"))).select(F.lower(own).alias("host"))
    base, bits = ipv4(F.split_part(own, F.lit("/"), F.lit(1))), F.split_part(own, F.lit("/"), F.lit(2))
    ranges = (
        entries.filter(own.rlike(r"^[^/]+/\d{1,2}$")).select(base.alias("base"), bits.try_cast("int").alias("bits"))
        .filter("base is not null and bits <= 32").select("bits", F.expr("shiftright(base, 32 - bits)").alias("first")).distinct()
    )
    hosts = hosts.select("host").distinct()
    listed = hosts.join(names.distinct(), "host", "left_semi")
    asked = hosts.select("host", ipv4(F.col("host")).alias("low")).filter("low is not null")
    asked = asked.select(F.shiftright("low", 32 - BUCKET_BITS).alias("bucket"), "low", F.lit(None).cast("bigint").alias("high"), "host")
    wide = ranges.filter(F.col("bits") <= BUCKET_BITS).select(
        F.explode(F.expr(f"sequence(shiftleft(first, {BUCKET_BITS} - bits), shiftleft(first + 1, {BUCKET_BITS} - bits) - 1)")).alias("bucket")
    )
    narrow = ranges.filter(F.col("bits") > BUCKET_BITS).select(
        F.expr(f"shiftright(first, bits - {BUCKET_BITS})").alias("bucket"), F.expr("shiftleft(first, 32 - bits)").alias("low"),
        F.expr("shiftleft(first + 1, 32 - bits) - 1").alias("high"), F.lit(None).cast("string").alias("host"),
    )
    # Ranges that begin at an address are peers of it, so they count.
    reach = F.max("high").over(Window.partitionBy("bucket").orderBy("low"))
    reached = narrow.unionByName(asked).withColumn("reach", reach).filter("host is not null and reach >= low")
    covered = asked.join(wide.distinct(), "bucket", "left_semi")
    return listed.unionByName(reached.select("host")).unionByName(covered.select("host")).distinct()


def endpoint_audit(apps: DataFrame, allow_private: bool, allowed: tuple[str, ...] | DataFrame = ()) -> DataFrame:
    """Apps with the ``host`` of their ``endpoint`` and a ``verdict``.

    invalid, bad_protocol, public, private_blocked, private_not_listed or private_allowed. ``allowed`` is a table (entry) of
    any size, or a few entries.
    """
    if not isinstance(allowed, DataFrame):
        allowed = apps.sparkSession.createDataFrame([(a,) for a in allowed], "entry string")
    rows = apps.withColumn("host", F.regexp_replace(url_host(F.col("endpoint")), r"^\[|\]$", ""))
    # What depends on the host alone is asked once for each of them.
    hosts = materialize(rows.select("host").distinct().withColumn("_private", is_private(F.col("host"))))
    listed = listed_hosts(hosts.filter("_private"), allowed).withColumn("_listed", F.lit(True))
    rows = rows.join(hosts.join(listed, "host", "left"), "host", "left")
    scheme = F.lower(F.regexp_extract(F.trim("endpoint"), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    verdict = (
        F.when((scheme == "") | ((F.col("host") == "") & scheme.isin("http", "https")), "invalid")
        .when(~scheme.isin("http", "https"), "bad_protocol")
        .when(~F.col("_private"), "public")
        .when(F.lit(not allow_private), "private_blocked")
        .when(F.col("_listed"), "private_allowed")
        .otherwise("private_not_listed")
    )
    return rows.withColumn("verdict", verdict).select(*apps.columns, "host", "verdict")
