"""Removal of passages that occur more than once: seeds, extension, maximal repeats.

A passage counts as repeated where a window of ``WINDOW`` consecutive words starts in two places. Seeds are winnowed
anchors: the ``SEED``-word groups with the smallest hash of some window. Which anchor a window picks depends on
its own words only, so two equal windows share theirs, and documents are joined on them.

A seed is extended both ways by its block, all words that any window around it can reach. Where whole blocks agree
with another place, every window inside is repeated, and block after block this covers a maximal repeat but for its
ends. There windows are compared one by one: those that no agreeing block covers, against each other and against one
witness of each group of agreeing blocks. No pairs of places are formed, so a passage in a third of all documents
costs as much per place as one that occurs twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.texts import column, mix, offsets_of, slices, split_words, text_batches, word_hashes
from ragmill.session import materialize

WINDOW, SEED = 35, 8
REACH = WINDOW - SEED  # words of a window beyond its seed
#: Bits of the filter that keeps untouched texts out of the joins; a full one lets more through.
FILTER_BITS = 1 << 23
EDGE, AGREES, WITNESS = 0, 1, 2


class Rolling:
    """Hashes of any ranges of a word sequence, from one running sum."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        base = 6364136223846793005
        powers, back = np.full(n, base, np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        if n:
            powers[0] = 1
        back[0] = 1
        np.multiply.accumulate(powers, out=powers)
        self.back = np.multiply.accumulate(back)
        self.run = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(words) * powers, out=self.run[1:])

    def ranges(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.run[stop] - self.run[start]) * self.back[start])

    def windows(self, size: int) -> np.ndarray:
        n = max(len(self.run) - size, 0)
        return mix((self.run[size:] - self.run[:n]) * self.back[:n])


def _sliding(best, x: np.ndarray, size: int) -> np.ndarray:
    """Minimum or maximum of each ``size`` neighbours, by doubling."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = best(x[: len(x) - step], x[step:])
        have += step
    return x


def anchors_of(words: np.ndarray, sizes: np.ndarray):
    """(row, place in its text, seed hash, block hash) of all anchors of the texts, one after the other."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rolling = Rolling(words)
    seeds = rolling.windows(SEED) | np.uint64(1)
    least = _sliding(np.minimum, seeds, REACH + 1)
    inside = rows[: len(least)] == rows[WINDOW - 1 :]
    least = np.where(inside, least, np.uint64(0))
    pad = np.zeros(REACH, np.uint64)
    chosen = _sliding(np.maximum, np.concatenate([pad, least, pad]), REACH + 1) == seeds
    at = np.flatnonzero(chosen)
    first, last = offsets_of(sizes)[:-1][rows[at]], offsets_of(sizes)[1:][rows[at]]
    lo, hi = np.maximum(at - REACH, first), np.minimum(at + WINDOW, last)
    # A block that an end of its text cuts agrees with blocks cut the same way only.
    shape = mix(((at - lo) * 1000 + (hi - lo)).astype(np.uint64))
    return rows[at], at - first, seeds[at], rolling.ranges(lo, hi) ^ shape


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("dk"), "text")


def anchors(docs: DataFrame) -> DataFrame:
    """(a, block, dk, pos): the anchors of every text; ``dk`` is the key of its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, place, seed, block = anchors_of(*word_hashes(column(part, "text")))
                keys = column(part, "dk").to_numpy()[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed.view(np.int64)), pa.array(block.view(np.int64)), pa.array(keys), pa.array(place.astype(np.int32))],
                    ["a", "block", "dk", "pos"],
                )

    return _keyed(docs).filter("text is not null").select("dk", "text").mapInArrow(run, "a long, block long, dk long, pos int")


def marks(docs: DataFrame) -> DataFrame:
    """(dk, marks): places of seeds that occur more than once, as ``4 * pos + kind``, by document.

    Seeds and blocks are counted before their places are shuffled, and places are joined to the counts, one row each. The
    counts are written first: a join of two plain shuffles can be split where a seed has very many places.
    """
    found = anchors(docs)
    repeated = materialize(found.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a"))
    places = materialize(found.join(repeated, "a"))
    blocks = materialize(
        places.groupBy("a", "block").agg(F.count("*").alias("m"), F.min(F.struct("dk", "pos")).alias("first")).filter("m > 1")
    )
    kind = (
        F.when(F.col("m").isNull(), EDGE).when(F.col("first") == F.struct("dk", "pos"), WITNESS).otherwise(AGREES)
    )
    return (
        places.join(blocks, ["a", "block"], "left").select("dk", (F.col("pos") * 4 + kind).cast("int").alias("mark"))
        .groupBy("dk").agg(F.collect_set("mark").alias("marks"))
    )


def _present(ids: DataFrame) -> np.ndarray:
    words = (
        ids.select(F.pmod("dk", F.lit(FILTER_BITS)).cast("int").alias("slot"))
        .selectExpr("slot div 32 as w", "shiftleft(1L, slot % 32) as b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    )
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    bitmap[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.uint32)
    return bitmap


def marked_texts(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(dk, text, marks) of the documents that have marks."""
    bitmap = _present(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.mod(column(batch, "dk").to_numpy(), FILTER_BITS)
            hit = (bitmap[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1)
            yield batch.filter(pa.array(hit.astype(bool)))

    texts = _keyed(docs).filter("text is not null").select("dk", "text").mapInArrow(run, "dk long, text string")
    return texts.join(marked, "dk")


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of ``n`` words lie in a range of ``size`` words from one of ``starts``."""
    step = np.zeros(n + size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step)[:n] > 0


class Marked:
    """One document with its marks: what agreeing blocks cover, and which windows are still open."""

    def __init__(self, words: np.ndarray, marks: np.ndarray):
        self.n = len(words)
        pos, kind = marks // 4, marks % 4
        self.rolling = Rolling(words)
        seeds = self.rolling.windows(SEED) | np.uint64(1)
        windows = self.n - WINDOW + 1
        least = _sliding(np.minimum, seeds, REACH + 1)[:windows]
        # Start places of windows inside agreeing blocks.
        agree = pos[kind != EDGE]
        self.known = covered(windows + REACH, agree, REACH + 1)[REACH:][:windows] if len(agree) else np.zeros(windows, bool)
        self.open = np.flatnonzero(~self.known & np.isin(least, seeds[pos]))
        proof = pos[kind == WITNESS]
        near = covered(windows + REACH, proof, REACH + 1)[REACH:][:windows] if len(proof) else np.zeros(windows, bool)
        self.witness = np.flatnonzero(near & np.isin(least, seeds[proof]))

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        return self.rolling.ranges(starts, starts + WINDOW).view(np.int64)


def _marked_rows(part: pa.RecordBatch) -> Iterator[Marked]:
    words, sizes = word_hashes(column(part, "text"))
    at = offsets_of(sizes)
    marks = column(part, "marks")
    for i in range(part.num_rows):
        yield Marked(words[at[i] : at[i + 1]], np.sort(marks[i].values.to_numpy()).astype(np.int64))


def _windows(texts: DataFrame) -> DataFrame:
    """(h, dk, start, weight): open windows of weight 1, and witnesses (no dk) of weight 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                docs = [(d, d.hashes(d.open), d.hashes(d.witness)) for d in _marked_rows(part)]
                opened = np.array([len(d.open) for d, _, _ in docs])
                shown = sum(len(d.witness) for d, _, _ in docs)
                keys = np.repeat(column(part, "dk").to_numpy(), opened)
                none = pa.nulls(shown, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([*(o for _, o, _ in docs), *(w for _, _, w in docs)])),
                        pa.concat_arrays([pa.array(keys, pa.int64()), none]),
                        pa.array(np.concatenate([*(d.open for d, _, _ in docs), np.zeros(shown, np.int64)]).astype(np.int32)),
                        pa.array(np.repeat([1, 2], [len(keys), shown]).astype(np.int32)),
                    ],
                    ["h", "dk", "start", "weight"],
                )

    return texts.mapInArrow(run, "h long, dk long, start int, weight int")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) per row of ``docs`` (doc_id, text).

    ``kept`` is the text of the words left, one space between them. Null texts have no words; texts below a window's
    length lose none. Rows that repeat both id and text get the same answer each.
    """
    texts = materialize(marked_texts(text_batches(docs), materialize(marks(docs))))
    windows = _windows(texts)
    repeated = windows.groupBy("h").agg(F.sum("weight").alias("n")).filter("n > 1").select("h")
    hits = (
        windows.filter("dk is not null").select("h", "dk", "start").join(repeated, "h", "left_semi")
        .groupBy("dk").agg(F.collect_set("start").alias("starts"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, "text")):
            starts, removed, digests = column(part, "starts"), [], []
            for i, (doc, words) in enumerate(zip(_marked_rows(part), _texts(part), strict=True)):
                begin = np.flatnonzero(doc.known)
                if starts[i].is_valid:
                    begin = np.concatenate([begin, starts[i].values.to_numpy()])
                gone = covered(doc.n, begin.astype(np.int64), WINDOW)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(" ".join(words[~gone].tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [column(part, "dk"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["dk", "n_removed", "kept_sha256"]
            )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [w.tolist() for w in _texts(part)]
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, "doc_id"), column(part, "dk"), pa.array([len(w) for w in texts], pa.int64()),
                        pa.array([hashlib.sha256(" ".join(w).encode()).hexdigest() for w in texts], pa.string()),
                    ],
                    ["doc_id", "dk", "n_words", "all_sha256"],
                )

    less = texts.join(hits, "dk", "left").mapInArrow(cut, "dk long, n_removed long, kept_sha256 string").dropDuplicates(["dk"])
    return (
        _keyed(docs).mapInArrow(whole, "doc_id long, dk long, n_words long, all_sha256 string").join(less, "dk", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
            F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"),
        )
    )


def _texts(part: pa.RecordBatch) -> Iterator[np.ndarray]:
    codes, dictionary, sizes = split_words(column(part, "text"))
    names = np.array(dictionary.to_pylist() or [""], object)
    at = offsets_of(sizes)
    for i in range(len(sizes)):
        yield names[codes[at[i] : at[i + 1]]]
