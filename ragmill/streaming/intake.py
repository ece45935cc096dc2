"""Continuous intake: raw files to text to chunks with vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.functions import files
from ragmill.functions.html import html_text
from ragmill.functions.text import trimmed
from ragmill.operators.chunking import cut_documents, gate_documents
from ragmill.operators.embedding import EmbedFn, embed_rows


def extract(raw: DataFrame, limits: dict | None = None) -> DataFrame:
    """(document_id, owner, text, mime, outcome, reason) of raw files (object_key, content): one row per file.

    Files that may not be taken in are ``rejected`` with the reason; those of a kind that has no reader here are
    ``failed``, like files without any text. Works on a stream: every step is stateless.
    """
    name = F.substring_index("object_key", "/", -1)
    kind = files.detect_kind(name, F.lit(""))
    named = raw.select(
        F.col("object_key").alias("document_id"), F.split_part("object_key", F.lit("/"), F.lit(1)).alias("owner"),
        name.alias("filename"), F.lit("").alias("media_type"), F.octet_length("content").alias("byte_size"),
        files.sniff_container(F.col("content")).alias("container"), kind.alias("kind"), "content",
    )
    top = files.LIMITS | (limits or {})
    readable = (
        F.col("kind").isin("html", "text") & files.container_matches(F.col("kind"), F.col("container"))
        & (F.col("byte_size") <= top["max_bytes"])
    )
    plain = named.withColumn("plain", files.decode_text(F.when(readable, F.col("content")))).drop("content")
    page = html_text(F.when(F.col("kind") == "html", F.col("plain")))
    read = plain.withColumn("text", F.when(F.col("kind") == "html", page).otherwise(F.col("plain"))).drop("plain")
    blank = F.col("kind").isin("html", "text") & (F.length(trimmed(F.coalesce("text", F.lit("")))) == 0)
    status = F.when(F.col("kind").isin("pdf", "docx", "xlsx"), "error").when(blank, "no_text")
    judged = gate_documents(
        read.withColumns({"status": status, "pages": F.lit(None).cast("int"), "char_count": F.length("text")}), limits
    )
    return judged.select(
        "document_id", "owner", F.when(F.col("outcome") == "ok", F.col("text")).alias("text"), "mime", "outcome", "reason"
    )


def continuous_ingest(
    raw: DataFrame, embed_fn: EmbedFn, size: int = 1000, overlap: int = 120, limits: dict | None = None
) -> DataFrame:
    """Outcomes and chunks with vectors of a stream of raw files; write them with ``append_log``.

    Every file has a row: ``chunking.outcomes`` of the log tells what became of it, rows with a ``chunk_index`` are
    its chunks. The checkpoint of the file source takes each file once.
    """
    limit = (files.LIMITS | (limits or {}))["max_chunks"]
    return embed_rows(cut_documents(extract(raw, limits), size, overlap, limit=limit), embed_fn, text="chunk_text")
