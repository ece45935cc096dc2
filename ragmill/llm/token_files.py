"""Token ids in files of directly addressable codes.

An id is split into chunks of ``CHUNK_BITS`` bits. Level ``l`` holds the ``l``-th chunk of every id that has one, and a
bitmap that tells which of them go on to the next level. The place of an id's next chunk is the number of ones before
it, which a directory of ranks gives at once. So any id is read with a few look-ups, without decoding a block.

A file row is a segment: whole documents in id order, their lengths, and the levels. Segments are rows of Parquet files, so
any file system that Spark reaches will do and a lost task is written again. Ids of all documents follow each other
in ascending ``doc_id``: by buckets of ranges of ids, and in a bucket by segment.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragmill.llm.texts import column, offsets_of, slices, split_words, text_batches
from ragmill.session import shared_dir

CHUNK_BITS = 8
#: Bits between two entries of the directory of ranks.
RANK_EVERY = 512
#: A segment is closed after this many ids, at the end of a document.
SEGMENT_IDS = 1 << 18
#: Positions are joined to segments by cells of this many ids.
CELL = 1 << 18
END_ID = 1
#: Distinct words whose ids a task keeps.
KEPT_WORDS = 1_200_000
#: ASCII punctuation that the pieces of a word never join; an apostrophe may begin a piece of its own kind.
_TAIL = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


# --- codes ------------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> list[dict]:
    """Levels of a sequence of ids: chunks, continuation bitmap, ranks."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk, rest = (rest & np.uint32(0xFF)).astype(np.uint8), rest >> np.uint32(CHUNK_BITS)
        more = rest > 0
        ones = np.concatenate([[0], np.cumsum(more)])[::RANK_EVERY].astype(np.uint32)
        levels.append({"chunks": chunk.tobytes(), "more": np.packbits(more, bitorder="little").tobytes(), "ranks": ones.tobytes()})
        if not more.any():
            return levels
        rest = rest[more]


def token_at(levels: list[dict], i: int) -> int:
    """One id, by its place in the segment."""
    value = 0
    for depth, level in enumerate(levels):
        value |= level["chunks"][i] << (CHUNK_BITS * depth)
        more = level["more"]
        if not more[i >> 3] >> (i & 7) & 1:
            return value
        base = i // RANK_EVERY
        rank = int.from_bytes(level["ranks"][4 * base : 4 * base + 4], "little")
        start = base * RANK_EVERY
        bits = int.from_bytes(more[start >> 3 : (i >> 3) + 1], "little") & ((1 << (i - start)) - 1)
        i = rank + bits.bit_count()
    return value


def unpack(levels: list[dict]) -> np.ndarray:
    """All ids of a segment."""
    parts = [
        (np.frombuffer(x["chunks"], np.uint8), np.unpackbits(np.frombuffer(x["more"], np.uint8), bitorder="little")) for x in levels
    ]
    value = parts[-1][0].astype(np.uint32)
    for chunk, more in reversed(parts[:-1]):
        own = chunk.astype(np.uint32)
        own[more[: len(chunk)].astype(bool)] |= value << np.uint32(CHUNK_BITS)
        value = own
    return value


# --- tokens -----------------------------------------------------------------------------------


class WordTokens:
    """Ids of texts, word by word: white space never reaches the pieces of this tokenizer, so equal words have
    equal ids wherever they stand. Words are encoded once and kept.

    Nor do pieces reach from a letter or digit to the punctuation behind it, and letters are lower-cased before anything
    else: a word is looked up as its lower-case head and its tail of ASCII punctuation. Words that may hold a special
    token are taken as they are.
    """

    END, EMPTY = 0, 1

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {"": self.EMPTY}
        self.flat = np.array([END_ID], np.uint32)
        self.starts, self.lengths = np.array([0, 0], np.int64), np.array([1, 0], np.int64)

    def _learn(self, fresh: list[str]) -> None:
        """Encode new words: plain ones many in one text, told apart by where their tokens begin, others alone."""
        plain = [w for w in fresh if w.isascii() or max(w) < "\u0250"]
        others = [w for w in fresh if not (w.isascii() or max(w) < "\u0250")]
        flats, counts = [], []
        for at in range(0, len(plain), 20_000):
            groups = [plain[i : i + 100] for i in range(at, min(at + 20_000, len(plain)), 100)]
            for group, found in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                begins = np.cumsum([0] + [len(w) + 1 for w in group])
                flats.append(np.array(found.ids, np.uint32))
                places = np.array([o[0] for o in found.offsets], np.int64)
                counts.append(np.bincount(np.searchsorted(begins, places, side="right") - 1, minlength=len(group)))
        for found in self.tokenizer.encode_batch(others, add_special_tokens=False):
            flats.append(np.array(found.ids, np.uint32))
            counts.append(np.array([len(found.ids)]))
        lengths = np.concatenate(counts)
        self.known.update(zip(plain + others, range(len(self.starts), len(self.starts) + len(fresh)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, *flats])

    def _numbers(self, names: list[str]) -> np.ndarray:
        found = list(map(self.known.get, names))
        if None in found:
            self._learn(list(dict.fromkeys(w for w, n in zip(names, found, strict=True) if n is None)))
            found = list(map(self.known.get, names))
        return np.array(found, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; ids per text)"""
        if len(self.known) > KEPT_WORDS:
            self._reset()
        codes, words, sizes = split_words(texts)
        trimmed = pc.ascii_rtrim(words, characters=_TAIL)
        special = pc.match_substring(words, "<|")
        # The lower case of a dotted capital I ends in a mark, which joins the punctuation.
        parted = pc.and_not(pc.match_substring_regex(trimmed, r"[\p{L}\p{N}]$"), pc.or_(special, pc.ends_with(trimmed, "İ")))
        heads = pc.if_else(parted, trimmed, words)
        names = pc.if_else(special, heads, pc.ascii_lower(heads))
        tail = (pc.binary_length(words).to_numpy() - pc.binary_length(heads).to_numpy()).astype(np.int64)
        numbers = np.full((len(words), 2), self.EMPTY, np.int64)
        if len(words):
            unique = names.dictionary_encode()
            numbers[:, 0] = self._numbers(unique.dictionary.to_pylist())[unique.indices.to_numpy()]
            some = np.flatnonzero(tail)
            numbers[some, 1] = self._numbers(
                [w[-n:] for w, n in zip(words.take(pa.array(some)).to_pylist(), tail[some].tolist(), strict=True)]
            )
        units = np.insert(numbers[codes].ravel() if len(codes) else np.zeros(0, np.int64), 2 * offsets_of(sizes)[1:], self.END)
        lengths = self.lengths[units]
        before = np.cumsum(lengths) - lengths
        ids = self.flat[np.repeat(self.starts[units] - before, lengths) + np.arange(lengths.sum())]
        ends = offsets_of(2 * sizes + 1)
        totals = np.add.reduceat(lengths, ends[:-1]) if len(sizes) else np.zeros(0, np.int64)
        return ids, totals


def encoded(docs: DataFrame, path: str, bounds: list[int], kind: str = "<u4") -> DataFrame:
    """(bucket, doc_id, tie, ids) per row; ids as little-endian numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens(path)
        cuts = np.array(bounds, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                ids, totals = words.encode(column(part, "text"))
                at = offsets_of(totals)
                wide = ids.astype(kind)
                doc_id = column(part, "doc_id")
                bucket = np.searchsorted(cuts, doc_id.fill_null(-(1 << 63)).to_numpy(), side="left").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket), doc_id, column(part, "tie"),
                        pa.array([wide[at[i] : at[i + 1]].tobytes() for i in range(len(totals))], pa.binary()),
                    ],
                    ["bucket", "doc_id", "tie", "ids"],
                )

    return text_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(
        run, "bucket int, doc_id long, tie long, ids binary"
    )


_LEVEL = pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
_SEGMENT = pa.schema([
    ("bucket", pa.int32()), ("segment", pa.int32()), ("offset", pa.int64()), ("n", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("levels", pa.list_(_LEVEL)),
])
_SEGMENT_SQL = (
    "bucket int, segment int, offset long, n long, doc_ids array<long>, lengths array<long>, "
    "levels array<struct<chunks:binary,more:binary,ranks:binary>>"
)


def _segments(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows to segments; a bucket's rows come one after the other."""
    bucket, segment, offset = None, 0, 0
    ids: list[bytes] = []
    names: list[int | None] = []
    held, width = 0, np.dtype(kind).itemsize

    def close():
        flat = np.frombuffer(b"".join(ids), kind)
        row = {
            "bucket": bucket, "segment": segment, "offset": offset, "n": len(flat), "doc_ids": list(names),
            "lengths": [len(x) // width for x in ids], "levels": pack(flat),
        }
        return pa.RecordBatch.from_pylist([row], _SEGMENT)

    for batch in batches:
        for b, name, own in zip(
            column(batch, "bucket").to_pylist(), column(batch, "doc_id").to_pylist(), column(batch, "ids").to_pylist(), strict=True
        ):
            if ids and (b != bucket or held >= SEGMENT_IDS):
                yield close()
                segment, offset = segment + 1, offset + held
                ids, names, held = [], [], 0
            if b != bucket:
                bucket, segment, offset = b, 0, 0
            ids.append(own)
            names.append(name)
            held += len(own) // width
    if ids:
        yield close()


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the ids of all rows of ``docs`` (doc_id, text), an end id after each, to segments under ``path``.

    Null and empty texts have the end id only. Rows with a null id come first, rows that share an id follow each
    other in an order that depends on their texts only. A text of any length is one document of one segment. An empty table
    gives an empty folder of segments. Other columns are not read, whatever their names are.
    """
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    quantiles = [i / buckets for i in range(1, buckets)]
    bounds = docs.agg(F.percentile_approx("doc_id", quantiles, 10 * buckets).alias("b")).first()["b"] if quantiles else None
    # Ids cross the network in two bytes where the vocabulary allows.
    kind = "<u2" if WordTokens(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
    rows = encoded(docs, tokenizer, sorted(set(bounds or [])), kind)
    (
        rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "tie")
        .mapInArrow(lambda batches: _segments(batches, kind), _SEGMENT_SQL).write.option("compression", "zstd").parquet(path)
    )


def index(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, the number of ids before them; levels are not read unless they are asked for."""
    segments = spark.read.parquet(path)
    # One row per bucket, of which there are as many as partitions: few enough to send to every task.
    totals = segments.groupBy("bucket").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return segments.join(F.broadcast(totals.select("bucket", before.alias("before"))), "bucket").withColumn(
        "start", F.col("before") + F.col("offset")
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files; ``ids`` as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = unpack(column(batch, "levels")[k].as_py()).astype("<u4")
                lengths = column(batch, "lengths")[k].values.to_numpy()
                at = offsets_of(lengths)
                raw = [ids[at[i] : at[i + 1]].tobytes() for i in range(len(lengths))]
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "doc_ids")[k].values, pa.array(column(batch, "start")[k].as_py() + at[:-1]), pa.array(lengths),
                        pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return index(spark, path).select("start", "doc_ids", "lengths", "levels").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )


def lookup(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, token) for the ``position`` column: single ids out of the middle of the files."""
    segments = index(spark, path).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("start") + F.col("n") - 1) / CELL)))
    )
    at = positions.select("position", F.floor(F.col("position") / CELL).alias("cell"))
    narrow = segments.select("cell", "bucket", "segment", "start", "n")
    asked = (
        at.join(narrow, "cell").filter("position >= start and position < start + n")
        .groupBy("bucket", "segment").agg(F.collect_list("position").alias("positions"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                levels, start = column(batch, "levels")[k].as_py(), column(batch, "start")[k].as_py()
                places = column(batch, "positions")[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places, pa.int64()), pa.array([token_at(levels, p - start) for p in places], pa.int64())], ["position", "token"]
                )

    return (
        index(spark, path).join(asked, ["bucket", "segment"]).select("start", "levels", "positions")
        .mapInArrow(run, "position long, token long")
    )


def write_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write to a new folder of the shared file system, and what the files hold."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens"
    write(docs, path, tokenizer)
    return read(spark, path)
