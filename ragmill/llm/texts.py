"""Words and word hashes of Arrow text columns, computed slice by slice inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a task holds as words at one time; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20


#: Rows of an Arrow batch of documents; the default of 10,000 long texts is much for small executors.
BATCH_ROWS = 2_000


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of ``BATCH_ROWS`` rows in its session, unless a number was chosen there."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES, give_back: bool = False):
    """Cuts of a batch with about ``size`` bytes of one text column each, whole rows only.

    ``give_back`` returns all free memory to the system after the batch, which takes some time.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    total = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    if give_back:
        release()
    else:
        pa.default_memory_pool().release_unused()


def release() -> None:
    """Give memory that is no longer in use back to the system, where the C library can.

    Workers outlive their tasks, and what a task leaves in cycles would stay with them.
    """
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text (null: none).

    Returns the words of all rows as codes, the distinct words, and the number of words of each row.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    # Blank ends of a text give empty words.
    empty = pc.index(flat.dictionary, pa.scalar("", flat.dictionary.type)).as_py()
    if empty >= 0:
        rows = np.repeat(np.arange(len(sizes)), sizes)
        keep = codes != empty
        codes = codes[keep]
        sizes = np.bincount(rows[keep], minlength=len(sizes)).astype(np.int64)
    return codes, flat.dictionary, sizes


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_strings(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(v) for v in values.to_pylist()), np.uint64, len(values))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the number of words of each row."""
    codes, dictionary, sizes = split_words(texts)
    if not len(codes):
        return np.zeros(0, np.uint64), sizes
    return hash_strings(dictionary)[codes], sizes


def window_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words; windows across rows are the caller's to drop.

    Sums of powers are kept as differences of one running sum, so the cost does not depend on ``size``.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = pow(6364136223846793005, 2 * seed + 1, 1 << 64)
    inverse = pow(base, -1, 1 << 64)
    powers = np.full(len(words), base, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    back = np.full(n, inverse, np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    run = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * powers, out=run[1:])
    return mix((run[size:] - run[:n]) * back)


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out
