"""Cutting documents into chunks. Lengths count code points."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragmill.functions import files
from ragmill.operators.embedding import EmbedFn, embed_rows
from ragmill.session import slices, spread

# Chunk size, overlap, and the order in which separators are tried.
MAX_SIZE = 1000
OVERLAP = 120
SEPARATORS = ("\n\n", "\n", "。", "、", " ", "")

_HEADING = re.compile(r"(#{1,3})\s+(.+?)\s*")


def split_headers(text: str) -> Iterator[tuple[str | None, str]]:
    """(path, body) per heading section; a text of headings alone is one section."""
    titles: dict[int, str] = {}
    path, lines, found = None, [], False
    for line in [*text.split("\n"), None]:
        heading = _HEADING.fullmatch(line) if line is not None and line.startswith("#") else None
        if heading is None and line is not None:
            lines.append(line)
            continue
        body = "\n".join(lines).strip()
        if body:
            found = True
            yield path, body
        lines = []
        if heading:
            level = len(heading[1])
            titles = {k: v for k, v in titles.items() if k < level} | {level: heading[2]}
            path = " > ".join(titles.values())
    if not found and text.strip():
        yield None, text.strip()


def merge_splits(pieces: Sequence[str], sep: str, size: int, overlap: int, text: str | None = None) -> Iterator[str]:
    """The longest runs of pieces that fit; each begins with the longest tail of the run before that the overlap allows.

    With the end places of all pieces known, a run's end and the next one's start are two binary searches, and a run is a
    part of ``text``, which is all pieces joined.
    """
    n, gap = len(pieces), len(sep)
    text = sep.join(pieces) if text is None else text
    at = list(accumulate([len(p) + gap for p in pieces], initial=0))  # where each piece begins in the text
    start, least = 0, 1
    while True:
        stop = bisect_right(at, at[start] + size + gap, least) - 1
        if stop < least:
            stop = least
        if stop >= n:
            yield text[at[start] :]
            return
        yield text[at[start] : at[stop] - gap]
        tail = at[stop] - gap - overlap
        room = at[stop + 1] - gap - size
        # An empty piece has no width; it stays in front of one that hardly fits.
        start = min(bisect_left(at, max(tail, room, at[start])), stop - (pieces[stop - 1] == ""))
        least = stop + 1


def recursive_split(text: str, seps: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Cut at the coarsest separator that occurs; pieces that are not below ``size`` are cut at finer ones.

    Work that is left waits on a stack: texts with the separators still open to them, and runs to be packed.
    """
    waiting: list[tuple[str | list[str], Sequence[str] | str, str | None]] = [(text, seps, None)]
    while waiting:
        work, open_seps, joined = waiting.pop()
        if isinstance(work, list):
            yield from merge_splits(work, open_seps, size, overlap, joined)
            continue
        if open_seps is None:
            yield work
            continue
        usable = [i for i, s in enumerate(open_seps) if s in work]
        level = usable[0] if usable else len(open_seps) - 1
        sep = open_seps[level] if open_seps else ""
        finer = (open_seps[level + 1 :] or None) if sep else None
        pieces = work.split(sep) if sep else list(work)
        if max(map(len, pieces), default=size) < size:
            waiting.append((pieces, sep, work))
            continue
        todo = []
        for short, group in groupby(pieces, key=lambda p: len(p) < size):
            todo += [(list(group), sep, None)] if short else [(p, finer, None) for p in group]
        waiting += reversed(todo)


def chunk_text(text: str, size: int = MAX_SIZE, overlap: int = OVERLAP, seps: Sequence[str] = SEPARATORS):
    """(header_path, chunk) pairs of one text."""
    for path, body in split_headers(text or ""):
        for piece in recursive_split(body, seps, size, overlap):
            piece = piece.strip()
            if piece:
                yield path, piece


def header_sections(df: DataFrame) -> DataFrame:
    """(document_id, section, header_path, body) of (document_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text"):
            rows = [
                (doc, n, path, body)
                for doc, text in zip(frame["document_id"], frame["text"])
                for n, (path, body) in enumerate(split_headers(text or ""))
            ]
            yield pd.DataFrame(rows, columns=["document_id", "section", "header_path", "body"])

    kind = df.schema["document_id"].dataType.simpleString()
    return spread(df.select("document_id", "text")).mapInPandas(
        run, f"document_id {kind}, section int, header_path string, body string"
    )


def cut_documents(
    df: DataFrame, size: int = MAX_SIZE, overlap: int = OVERLAP, seps: Sequence[str] = SEPARATORS, limit: int | None = None
) -> DataFrame:
    """Chunks and outcome of (document_id, text, ...) in one pass: every document has at least one row.

    ``text`` gives way to (chunk_count, outcome, reason, chunk_index, chunk_text, header_path); other columns stay. A
    document of more than ``limit`` chunks is ``rejected`` (``too_many_chunks``) and has one row without a chunk, and so
    has one without any chunk, which is ``ok``; one whose text is null was never read and is ``failed`` (``no_text``). A
    document that comes with an ``outcome`` other than ``ok`` is not cut and keeps its reason. The task that cuts a document knows all this, so nothing is counted or joined afterwards.
    """
    judged = "outcome" in df.columns
    kept = [c for c in df.columns if c not in ("text", "outcome", "reason")]
    verdict = ["outcome", "reason"] if judged else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, "text"):
            at, counts, ends, reasons, numbers, pieces, paths = [], [], [], [], [], [], []
            verdicts = zip(frame["outcome"], frame["reason"]) if judged else (("ok", None) for _ in range(len(frame)))
            for i, (text, (outcome, reason)) in enumerate(zip(frame["text"], verdicts)):
                if outcome == "ok" and text is None:
                    outcome, reason = "failed", "no_text"
                chunks = list(chunk_text(text, size, overlap, seps)) if outcome == "ok" else []
                count = len(chunks)
                if limit is not None and count > limit:
                    outcome, reason, chunks = "rejected", "too_many_chunks", []
                n = len(chunks) or 1
                at += [i] * n
                counts += [count] * n
                ends += [outcome] * n
                reasons += [reason] * n
                numbers += range(n) if chunks else [None]
                pieces += [piece for _, piece in chunks] or [None]
                paths += [path for path, _ in chunks] or [None]
            made = {
                "chunk_count": counts, "outcome": ends, "reason": pd.Series(reasons, dtype=object),
                "chunk_index": pd.array(numbers, dtype="Int32"), "chunk_text": pieces, "header_path": pd.Series(paths, dtype=object),
            }
            yield frame[kept].iloc[at].reset_index(drop=True).assign(**made)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema]
    made = "chunk_count bigint, outcome string, reason string, chunk_index int, chunk_text string, header_path string"
    return spread(df.select(*kept, *verdict, "text")).mapInPandas(run, ", ".join([*fields, made]))


def outcomes(cut: DataFrame) -> DataFrame:
    """One row per document of ``cut_documents``: what became of it."""
    chunk = ["chunk_index", "chunk_text", "header_path", "embedding"]
    return cut.filter("chunk_index is null or chunk_index = 0").drop(*chunk)


def chunk_documents(
    df: DataFrame, size: int = MAX_SIZE, overlap: int = OVERLAP, seps: Sequence[str] = SEPARATORS
) -> DataFrame:
    """One row per chunk of (document_id, text, ...), numbered from 0 in each document.

    ``text`` gives way to (chunk_index, chunk_text, header_path); other columns stay, so
    provenance needs no join.
    """
    cut = cut_documents(df.drop("outcome", "reason", "chunk_count"), size, overlap, seps)
    return cut.filter("chunk_index is not null").drop("chunk_count", "outcome", "reason")


def reject_over_chunked(chunks: DataFrame, limit: int = files.LIMITS["max_chunks"]) -> DataFrame:
    """Chunks of documents within the limit; a larger document is refused whole.

    Chunk numbers are dense from 0, so a document is over the limit exactly when it
    has a chunk numbered ``limit``: the refused set is found without counting groups.
    """
    refused = chunks.filter(F.col("chunk_index") == limit).select("document_id")
    return chunks.join(refused, "document_id", "left_anti")


def chunk_and_embed(
    docs: DataFrame, embed_fn: EmbedFn, size: int = MAX_SIZE, overlap: int = OVERLAP, limit: int | None = files.LIMITS["max_chunks"],
    every: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks): every document has its outcome, also one that is refused or has no chunk.

    ``docs`` has (document_id, owner, text, ...). Other columns travel with
    the chunks as their provenance. Write ``cut_documents`` once where both results are used. With ``every``, where the chunks
    are all that is kept, they have (outcome, reason) as well, and a row without a chunk for each document that has none.
    """
    cut = cut_documents(docs, size, overlap, limit=limit)
    chunks = cut.drop("chunk_count") if every else cut.filter("chunk_index is not null").drop("chunk_count", "outcome", "reason")
    return outcomes(cut), embed_rows(chunks, embed_fn, text="chunk_text")


def gate_documents(df: DataFrame, limits: dict | None = None) -> DataFrame:
    """(…, outcome, reason): ok, rejected(reason) or failed(status).

    ``df`` has (filename, media_type, byte_size, container, status, pages, char_count);
    status is what the extractor reported, null when it succeeded. Nothing is cut short.
    """
    top = files.LIMITS | (limits or {})
    kind = files.detect_kind(F.col("filename"), F.col("media_type"))
    reason = (
        F.when(F.col("byte_size") > top["max_bytes"], "too_large")
        .when(kind.isin("image", "unsupported"), "unsupported")
        .when(~files.container_matches(kind, F.col("container")), "content_mismatch")
        .when(F.col("status") == "timeout", "timeout")
        .when(F.col("status") == "too_large", "too_large")
    )
    late = F.when(F.col("pages") > top["max_pages"], "too_many_pages").when(
        F.col("char_count") > top["max_chars"], "too_many_chars"
    )
    failed: Column = reason.isNull() & F.col("status").isNotNull()
    outcome = F.when(failed, "failed").when(F.coalesce(reason, late).isNotNull(), "rejected").otherwise("ok")
    return (
        df.withColumn("outcome", outcome)
        .withColumn("reason", F.when(failed, F.col("status")).otherwise(F.coalesce(reason, late)))
        .withColumn("mime", F.when(F.col("outcome") != "rejected", files.mime_of(kind, F.col("filename"))))
    )


def ingest_report(docs: DataFrame) -> DataFrame:
    """Per mime: documents, characters, chunks and time spent; no content."""
    return docs.groupBy("mime").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("char_count").alias("chars"),
        F.sum("chunk_count").alias("chunks"),
        F.sum("extract_ms").alias("extract_ms"),
        F.sum("embed_ms").alias("embed_ms"),
    )


def stale_documents(df: DataFrame) -> DataFrame:
    """Documents whose recorded extractor label is not the current one, or has none."""
    kinds = [(name, f"{version}+r{rules}") for name, version, rules in files.EXTRACTORS.values()]
    current = df.sparkSession.createDataFrame(kinds, "extractor string, extractor_version string")
    return df.join(F.broadcast(current), ["extractor", "extractor_version"], "left_anti")
