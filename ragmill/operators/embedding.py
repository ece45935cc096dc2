"""Filling missing vectors with a pluggable embedding function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.operators.topk import bigram_codes
from ragmill.session import slices, spread

EmbedFn = Callable[[list[str]], Sequence[Sequence[float]]]
# Fixed value: texts per call of the embedding function.
BATCH = 8


class BatchRefused(Exception):
    """The embedding function cannot take this many texts at once."""


def hashing_embedder(dim: int = 64) -> EmbedFn:
    """A deterministic embedding of 2-gram counts; needs no model and no network."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            mixed = bigram_codes(text).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            np.add.at(out[i], (mixed >> np.uint64(32)) % np.uint64(dim), np.where(mixed >> np.uint64(63), 1.0, -1.0))
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=out, where=norms > 0).tolist()

    return embed


def embed_all(texts: list[str], embed_fn: EmbedFn, batch: int = BATCH) -> list[list[float]]:
    """Vectors of all texts in order; a refused batch is halved.

    A wrong count is an error, and so is what is no vector: none, one without values or with values that are not finite, or
    one of another length than the others.
    """
    out: list[list[float]] = []
    todo = [texts[i : i + batch] for i in range(0, len(texts), batch)][::-1]
    while todo:
        part = todo.pop()
        try:
            vectors = embed_fn(part)
        except BatchRefused:
            if len(part) == 1:
                raise
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
            continue
        if len(vectors) != len(part):
            raise ValueError(f"embedding count mismatch: expected {len(part)}, got {len(vectors)}")
        for text, vector in zip(part, vectors):
            made = [float(x) for x in vector] if vector is not None else []
            if not made or not np.isfinite(made).all() or out and len(made) != len(out[0]):
                raise ValueError(f"no vector like the others for a text of {len(text)} characters: {len(made)} values")
            out.append(made)
    return out


def embed_missing(
    df: DataFrame,
    embed_fn: EmbedFn,
    text: str = "text",
    vector: str = "embedding",
    batch: int = BATCH,
    keys: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Rows whose vector was missing and whose text is not blank, now with a vector.

    Append the result to the table; running again picks up what is still missing.
    ``limit`` takes a representative part, chosen by md5 of the keys.
    """
    todo = df.filter(F.col(vector).isNull() & (F.length(F.trim(F.col(text))) > 0))
    if limit is not None:
        from ragmill.operators.vectors import md5_sample

        todo = md5_sample(todo, list(keys), limit)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, text):
            yield frame.assign(**{vector: embed_all(frame[text].tolist(), embed_fn, batch)})

    return spread(todo).mapInPandas(fill, df.schema)


def embed_rows(df: DataFrame, embed_fn: EmbedFn, text: str = "text", vector: str = "embedding", batch: int = BATCH) -> DataFrame:
    """Add a vector to rows just made; blank text gets none. One pass, nothing is computed twice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, text):
            texts = frame[text].fillna("")
            has = texts.str.strip() != ""
            made = iter(embed_all(texts[has].tolist(), embed_fn, batch))
            yield frame.assign(**{vector: [next(made) if h else None for h in has]})

    out = df.drop(vector)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema]
    return spread(out).mapInPandas(run, ", ".join([*fields, f"`{vector}` array<double>"]))


def fill_vectors(df: DataFrame, embed_fn: EmbedFn, text: str = "text", vector: str = "embedding") -> DataFrame:
    """The whole table with missing vectors filled; rows that have one bypass Python."""
    blank = F.col(vector).isNotNull() | ~(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0)
    return df.filter(blank).unionByName(embed_missing(df, embed_fn, text, vector))
