"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets, and components.

A document's set holds its distinct 5-word shingles. SuperMinHash walks, for each shingle, a random permutation of
the registers; at step ``j`` the shingle offers a value in ``[j, j+1)`` to the register that its permutation names.
Ranks of one shingle are thus spread without repetition over the registers, which lowers the variance of the
estimate, and a document is done as soon as every register holds a value of an earlier step.

Copies with the same set are one class, so a class of any size costs one comparison. Inside a band bucket every class
meets one hub of the bucket, not every other class; what a hub does not settle is compared in later rounds, between
different components only. Links are confirmed on the full sets of both texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.components import components
from ragmill.llm.texts import column, mix, offsets_of, slices, text_batches, window_hashes, word_hashes
from ragmill.session import materialize

SHINGLE = 5
REGISTERS, BAND_ROWS = 128, 4
BANDS = REGISTERS // BAND_ROWS
#: Pairs whose signatures agree less than this are no candidates of the later rounds: 0.75 lies 6.5 standard
#: errors above it.
LEAST_ESTIMATE = 0.5
#: Bits of a set's bitmap. A bit that only one of two sets has is a shingle that only this one has, which bounds
#: what they have in common from above.
BITMAP = 2048
#: Members of a bucket that one task compares with as many others.
BLOCK = 512
#: Bits of the filter that keeps texts without candidates out of the verification. A fixed size: when it fills
#: up it lets more through, and nothing is lost.
FILTER_BITS = 1 << 23

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and the size of each set.

    A text of fewer than five words has its whole word sequence as its one shingle; one without words has none.
    """
    words, sizes = word_hashes(pc.ascii_lower(pc.fill_null(texts, "")))
    starts = offsets_of(sizes)
    windows = window_hashes(words, SHINGLE, 1)
    sets, counts = [], np.zeros(len(sizes), np.int64)
    for i, n in enumerate(sizes):
        lo = starts[i]
        if n >= SHINGLE:
            own = np.unique(windows[lo : lo + n - SHINGLE + 1])
        elif n:
            own = window_hashes(words[lo : lo + n], int(n), 1) ^ mix(np.array([n], np.uint64))
        else:
            continue
        sets.append(own)
        counts[i] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), counts


def _draw(hashes: np.ndarray, step: int) -> np.ndarray:
    return mix(hashes + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def superminhash(elements: np.ndarray, counts: np.ndarray, m: int = REGISTERS, chunk: int = 1 << 17) -> np.ndarray:
    """Register values (rows, m) of the sets; rows of empty sets stay at the largest value.

    Steps run over all shingles at once; rows whose registers are all set drop out. The top byte of a value is its
    step, the rest the random part.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(counts), m), full, np.uint64)
    starts = offsets_of(counts)
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    begin = 0
    while begin < len(order):
        total = np.cumsum(counts[order[begin:]])
        stop = begin + max(1, int(np.searchsorted(total, chunk, side="right")))
        rows = order[begin:stop]
        begin = stop
        own = counts[rows]
        where = np.repeat(starts[rows] - offsets_of(own)[:-1], own) + np.arange(own.sum())
        _fill(elements[where], np.repeat(np.arange(len(rows)), own), rows, out, m)
    return out


def _fill(hashes, local, rows, out, m) -> None:
    """One chunk of whole rows; ``local`` numbers the row of each element."""
    registers = np.full(len(rows) * m, np.iinfo(np.uint64).max, np.uint64)
    none = np.iinfo(np.uint64).max
    perm = None
    for step in range(m):
        rank = _draw(hashes, step)
        k = step + (((rank >> np.uint64(32)) * np.uint64(m - step)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(step) << np.uint64(56)) | (mix(rank ^ _GOLDEN) >> np.uint64(8))
        if step == 0:
            register = k
        else:
            at = np.arange(len(hashes))
            register = perm[at, k].astype(np.int64)
            perm[at, k] = perm[:, step]
            perm[:, step] = register
        np.minimum.at(registers, local * m + register, value)
        open_rows = (registers.reshape(-1, m) == none).any(axis=1)
        if not open_rows.any():
            break
        keep = open_rows[local]
        if step == 0:
            hashes, local, k = hashes[keep], local[keep], k[keep]
            perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(hashes), 1))
            perm[np.arange(len(hashes)), k] = 0
            perm[:, 0] = k
        elif not keep.all():
            hashes, local, perm = hashes[keep], local[keep], perm[keep]
    out[rows] = registers.reshape(-1, m)


def band_keys(signature: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """(sets, bands) keys of ``rows`` registers each; the band is part of the key."""
    parts = signature.reshape(len(signature), -1, rows)
    key = np.tile(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(rows):
        key = mix(key * np.uint64(3) + parts[:, :, r])
    return key.view(np.int64)


def bitmaps(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(sets, BITMAP / 64) words with the bit of every shingle set."""
    bits = np.zeros((len(counts), BITMAP), bool)
    bits[np.repeat(np.arange(len(counts)), counts), (mix(elements ^ _GOLDEN) % np.uint64(BITMAP)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _may_link(bits: np.ndarray, size: np.ndarray, other: np.ndarray, other_size: int) -> np.ndarray:
    """Whether sets can reach the threshold with one other, by their bitmaps and sizes; never false for a link."""
    common = np.minimum(
        size - np.bitwise_count(bits & ~other).sum(axis=1, dtype=np.int64),
        other_size - np.bitwise_count(other & ~bits).sum(axis=1, dtype=np.int64),
    )
    return 100 * common >= 75 * (size + other_size - common)


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, a 128-bit digest of the set, band keys, a byte of each register, and the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", give_back=True):
                elements, counts = shingle_sets(column(part, "text"))
                values = superminhash(elements, counts)
                starts = offsets_of(counts)
                sums = [np.concatenate([[0], np.cumsum(mix(elements ^ np.uint64(s)), dtype=np.uint64)]) for s in (11, 29)]
                digest = [(s[starts[1:]] - s[starts[:-1]]).view(np.int64) for s in sums]
                keys = band_keys(values)
                short, bits = mix(values).astype(np.uint8), bitmaps(elements, counts)
                some = counts > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, "doc_id"), pa.array(counts), pa.array(digest[0]), pa.array(digest[1]),
                        pa.array([k if s else None for k, s in zip(keys, some, strict=True)], pa.list_(pa.int64())),
                        pa.array([x.tobytes() if s else None for x, s in zip(short, some, strict=True)], pa.binary()),
                        pa.array([x.tobytes() if s else None for x, s in zip(bits, some, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "d1", "d2", "bands", "signature", "bits"],
                )

    return text_batches(docs).select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, signature binary, bits binary"
    )


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of ``id``; its size does not depend on the number of ids."""
    words = (
        ids.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).cast("int").alias("slot"))
        .selectExpr("slot div 32 as w", "shiftleft(1L, slot % 32) as b")
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    ).toPandas()
    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    bitmap[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.uint32)
    return bitmap


def involved(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows whose id may be among ``ids``, one row per id."""
    bitmap = _id_filter(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = column(batch, "slot").to_numpy()
            hit = (bitmap[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1)
            yield batch.select(["doc_id", "text"]).filter(pa.array(hit.astype(bool)))

    return (
        docs.filter("doc_id is not null and text is not null")
        .select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("int").alias("slot"))
        .mapInArrow(run, "doc_id long, text string")
    )


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose full sets reach ``100 * common >= 75 * union``.

    A row with a repeated id stands for each of its texts.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    texts = involved(docs, ids)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = {}
                for name in ("ta", "tb"):
                    found = column(part, name).dictionary_encode()
                    elements, counts = shingle_sets(found.dictionary)
                    at = offsets_of(counts)
                    sets[name] = ([elements[at[i] : at[i + 1]] for i in range(len(counts))], found.indices.to_pylist())
                keep = []
                for i, j in zip(sets["ta"][1], sets["tb"][1], strict=True):
                    x, y = sets["ta"][0][i], sets["tb"][0][j]
                    keep.append(_linked(x, y))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < 75 * large:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= 75 * (len(x) + len(y) - common)


def _cross_pairs(members: DataFrame, best_only: bool) -> DataFrame:
    """Pairs of one bucket in different components whose signatures agree enough.

    ``members``: key, n (rows of that key), id, component, n_shingles, signature, bits. Buckets are cut into blocks, and every two blocks of a bucket meet in a task of their own. With ``best_only``
    each member brings its likeliest partner only.
    """
    placed = (
        members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "component", "n_shingles", "signature", "bits")
    )

    def run(rows: pa.Table) -> pa.Table:
        ids, comp = rows["id"].to_numpy(), rows["component"].to_numpy()
        own = rows["own"].to_numpy()
        sig = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint8).reshape(len(ids), -1)
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(ids), -1)
        size = rows["n_shingles"].to_numpy()
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        a_rows, b_rows = np.flatnonzero(own == i), np.flatnonzero(own == j)
        pa_, pb_ = [], []
        for x in a_rows:
            agree = (sig[b_rows] == sig[x]).mean(axis=1)
            hit = (comp[b_rows] != comp[x]) & (agree >= LEAST_ESTIMATE) & ((ids[b_rows] > ids[x]) | (i != j))
            hit[hit] = _may_link(bits[b_rows[hit]], size[b_rows[hit]], bits[x], size[x])
            found = b_rows[hit]
            if best_only and len(found):
                found = found[[np.argmax(agree[hit])]]
            pa_.extend([ids[x]] * len(found))
            pb_.extend(ids[found])
        a, b = np.array(pa_, np.int64), np.array(pb_, np.int64)
        return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return placed.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs`` (doc_id, text; other columns don't matter).

    Texts without words link with nothing. A row with a null id links with nothing: its component is null and it is
    kept. Rows that share an id are one node, with the links of all their texts. An empty table gives no rows.
    """
    rows = materialize(signatures(docs))
    sets = rows.filter("doc_id is not null and n_shingles > 0")
    # Ids with several texts carry the links of each of them.
    classes = sets.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("id"))
    named = materialize(sets.select("doc_id", "d1", "d2", "n_shingles").join(classes, ["d1", "d2", "n_shingles"]))
    same = named.filter("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    first = named.filter("doc_id = id").select("id", "d1", "d2", "n_shingles").distinct()
    nodes = (
        sets.withColumnRenamed("doc_id", "id").join(first, ["id", "d1", "d2", "n_shingles"])
        .dropDuplicates(["id", "d1", "d2", "n_shingles"]).select("id", "n_shingles", "bands", "signature", "bits")
    )
    nodes = materialize(nodes)
    entries = nodes.select("id", F.explode("bands").alias("key"))
    hubs = entries.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    # What follows is about buckets of several classes only.
    shared = materialize(entries.join(hubs, "key").select("key", "id", "hub", "n"))
    stars = materialize(
        shared.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    )
    links = tested = None
    if not stars.isEmpty():
        links, tested = materialize(verify(stars, docs)), stars
        for best_only in (True, False):
            found = components(links)
            labelled = shared.filter("n > 2").join(found, F.col("id") == F.col("node"), "left").select(
                "key", "id", "n", F.coalesce("component", "id").alias("component")
            )
            mixed = (
                labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                .filter("lo <> hi").select("key")
            )
            members = labelled.join(mixed, "key").join(nodes.select("id", "n_shingles", "signature", "bits"), "id")
            fresh = materialize(_cross_pairs(members, best_only).join(tested, ["a", "b"], "left_anti"))
            if fresh.isEmpty():
                continue
            links = materialize(links.unionByName(verify(fresh, docs)))
            tested = tested.unionByName(fresh)
    edges = same if links is None else same.unionByName(links)
    found = components(edges)
    out = rows.join(found, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, in the columns of ``docs``.

    Rows that share an id and a text are one document. Rows that share an id and differ in their texts are documents of their
    own: the smallest text has the id, the others stand behind all ids, so they go only where they are near to another
    document. Null and empty texts are the same. Rows with a null id all stay, an empty table gives none; texts of any length
    are compared whole.
    """
    names = docs.columns
    text = F.coalesce("text", F.lit(""))
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = materialize(repeated.select("doc_id"))
    if repeated.isEmpty():
        decided = near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id")
        kept = docs.filter("doc_id is not null").join(decided, "doc_id", "left_semi")
        return kept.select(*names).unionByName(docs.filter("doc_id is null").select(*names))
    rows = docs.filter("doc_id is not null").select("doc_id", text.alias("text"), F.struct(*names).alias("row"))
    # Written, so that every later pass sees the same row of an id and text.
    several = materialize(
        rows.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.first("row").alias("row"))
    )
    first = several.groupBy("doc_id").agg(F.min("text").alias("text"))
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    place = F.monotonically_increasing_id()
    own = several.join(first, ["doc_id", "text"], "left_anti").select(
        (F.lit(high + 1) + place if high < 1 << 62 else F.lit(low - 1) - place).alias("doc_id"), "text", "row"
    )
    every = rows.join(repeated, "doc_id", "left_anti").unionByName(several.join(first, ["doc_id", "text"], "left_semi"))
    every = every.unionByName(materialize(own))
    decided = near_duplicates(every.select("doc_id", "text")).filter("kept").select("doc_id")
    return every.join(decided, "doc_id", "left_semi").select("row.*").unionByName(docs.filter("doc_id is null").select(*names))
