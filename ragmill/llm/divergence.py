"""How far the sources of a language are from each other, over the terms that enough documents hold.

Terms are runs of ASCII letters and of everything beyond ASCII. Which of them are held by enough documents is found
by growing byte prefixes: at each level the distinct documents of every prefix are counted, prefixes below the threshold are
discarded, and only the extensions of what is left are counted at the next level, until no prefix is left that is not a
complete term. Terms that few documents hold, which are most of a vocabulary, so fall out as parts of a few prefixes
and are never grouped one by one.

Texts are read once. A slice of documents becomes one row of a written table, a pack of its terms in byte order; no document is
in two slices, so the distinct documents of a prefix are the sum of those in the slices. Counts of kept terms
are dealt by term and become blocks of terms by sources, which give the sums of all pairs of sources without a row
for each pair and term.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragmill.llm.texts import column, offsets_of, release
from ragmill.session import materialize, plan_bytes

LEAST = 3
TOP = 200
#: Bytes of the first prefixes; each level doubles them.
FIRST = 4
SCALE = 1_000_000_000
#: Text, and rows, that a task looks at together.
SLICE_BYTES, SLICE_ROWS = 8 << 20, 1 << 16
#: Written bytes up to which a table is sent to every task; larger ones are joined by a shuffle.
SENT_BYTES = 8 << 20
#: Rows (term, source) that make a block, and numbers of it that a task compares at a time.
BLOCK_ROWS, BLOCK = 50_000, 1 << 18
#: Rows of an Arrow batch that leaves a task.
ROWS_OUT = 20_000

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)


# --- terms ------------------------------------------------------------------------------------


def split_terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Terms of every text: codes of all in order, the distinct terms, terms per text.

    All separators are ASCII, so they are blanked out byte by byte.
    """
    texts = pc.fill_null(pc.cast(texts, pa.string()), "")
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(_LETTERS[raw]))
    lists = pc.ascii_split_whitespace(plain)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    some = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not some.all():  # blank ends of a text give empty terms
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[some], minlength=len(sizes)).astype(np.int64)
        flat = flat.filter(pa.array(some))
    flat = flat.dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False), flat.dictionary, sizes


def _packed(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(pack: pa.Scalar) -> pa.RecordBatch:
    with pa.ipc.open_stream(pack.as_buffer()) as reader:
        return reader.read_next_batch()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS_OUT):
        yield batch.slice(at, ROWS_OUT)


def _in_order(words: pa.Array, codes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct strings sorted by their bytes, and the codes that belong to them."""
    order = pc.sort_indices(words)
    rank = np.empty(len(words), np.int64)
    rank[order.to_numpy()] = np.arange(len(words))
    return words.take(order), rank[codes] if len(codes) else np.zeros(0, np.int64)


def _slice_pack(rows: pa.Table, least: int) -> bytes:
    """Languages and terms of a slice in order, with the first documents and the counts by source of each."""
    rows = rows.sort_by([("lang", "ascending"), ("source", "ascending")])
    lang, source = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    row_lang, row_source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lang, source))
    codes, words, sizes = split_terms(rows["text"].combine_chunks())
    words, codes = _in_order(words, codes)
    n_rows, n_words = rows.num_rows, max(1, len(words))
    row = np.repeat(np.arange(n_rows), sizes)
    # By language, term and row; rows stand by source already.
    key, n = np.unique((row_lang[row] * n_words + codes) * n_rows + row, return_counts=True)
    term_key, row = np.divmod(key, n_rows)
    new_term = np.diff(term_key, prepend=-1) != 0
    new_source = new_term | (np.diff(row_source[row], prepend=-1) != 0)
    starts, source_starts = np.flatnonzero(new_term), np.flatnonzero(new_source)
    group = np.cumsum(new_term) - 1
    first = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key)))) < least
    own_lang, own_term = np.divmod(term_key[starts], n_words)

    def lists(of: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets_of(np.bincount(of, minlength=len(starts))).astype(np.int32)), values)

    own_source = pa.DictionaryArray.from_arrays(pa.array(row_source[row[source_starts]].astype(np.int32)), source.dictionary)
    counts = np.add.reduceat(n, source_starts).astype(np.int64) if len(key) else np.zeros(0, np.int64)
    return _packed(
        pa.RecordBatch.from_arrays(
            [
                pa.DictionaryArray.from_arrays(pa.array(own_lang.astype(np.int32)), lang.dictionary), words.take(pa.array(own_term)),
                lists(group[first], pa.array(row[first].astype(np.int32))), lists(group[source_starts], own_source),
                lists(group[source_starts], pa.array(counts)),
            ],
            ["lang", "term", "docs", "sources", "counts"],
        )
    )


def _gathered(batches: Iterator[pa.RecordBatch], size, rows: int) -> Iterator[pa.Table]:
    """Tables of about ``size`` bytes of text and at most ``rows`` rows, out of batches of any size."""
    held, held_bytes, held_rows = [], 0, 0
    for batch in batches:
        at = 0
        lengths = np.ones(batch.num_rows, np.int64)
        if size is not None:
            lengths = pc.fill_null(pc.binary_length(column(batch, "text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(lengths)
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            stop = at + rows - held_rows
            if size is not None:
                stop = min(stop, int(np.searchsorted(total, before + size - held_bytes, side="right")))
            stop = min(batch.num_rows, max(stop, at + (not held)))
            if stop > at:
                held.append(batch.slice(at, stop - at))
                held_bytes += int(total[stop - 1] - before)
                held_rows += stop - at
                at = stop
            if at < batch.num_rows or held_rows >= rows or size is not None and held_bytes >= size:
                yield pa.Table.from_batches(held)
                held, held_bytes, held_rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def term_packs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One ``pack`` per slice of documents; every row of ``docs`` is one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, SLICE_BYTES, SLICE_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([_slice_pack(rows, least)], pa.binary())], ["pack"])
            release()

    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]).mapInArrow(run, "pack binary")


# --- prefixes ---------------------------------------------------------------------------------


def _sent(df: DataFrame) -> DataFrame:
    """A written table, marked for sending to every task where it is small."""
    return F.broadcast(df) if plan_bytes(df) <= SENT_BYTES else df


def _slice_prefixes(pack: pa.RecordBatch, length: int, above: int) -> pa.RecordBatch:
    """(lang, prefix, complete, n) of the terms of more than ``above`` bytes, which stand in byte order."""
    size = pc.binary_length(pack["term"]).to_numpy()
    pack = pack.filter(pa.array(size > above))
    size = size[size > above]
    prefix = pc.binary_slice(pack["term"].cast(pa.binary()), 0, length)
    complete = size <= length
    lang = pack["lang"].indices.to_numpy()
    new = np.ones(len(size), bool)
    if len(size):
        new[1:] = pc.not_equal(prefix[1:], prefix[:-1]).to_numpy(zero_copy_only=False)
        new[1:] |= (lang[1:] != lang[:-1]) | (complete[1:] != complete[:-1])
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    docs = pack["docs"].flatten().to_numpy().astype(np.int64)
    held = np.repeat(group, pc.list_value_length(pack["docs"]).to_numpy(zero_copy_only=False))
    n = np.bincount(np.unique(held * (docs.max(initial=0) + 1) + docs) // (docs.max(initial=0) + 1), minlength=len(starts))
    at = pa.array(starts)
    return pa.RecordBatch.from_arrays(
        [pack["lang"].take(at).cast(pa.string()), prefix.take(at), pa.array(complete[starts]), pa.array(n.astype(np.int64))],
        ["lang", "prefix", "complete", "n"],
    )


def prefixes(packs: DataFrame, length: int, least: int = LEAST, under: DataFrame | None = None, above: int = 0) -> DataFrame:
    """(lang, prefix, complete) of the prefixes of ``length`` bytes that enough documents hold.

    ``under`` (lang, prefix) are the kept prefixes of ``above`` bytes; others are not extended. A term that is not longer than
    ``length`` is complete, and a prefix apart from that of longer terms with the same beginning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in column(batch, "pack"):
                yield from _parts(_slice_prefixes(_unpacked(pack), length, above))

    rows = packs.mapInArrow(run, "lang string, prefix binary, complete boolean, n long")
    if under is not None:
        known = under.select(F.col("lang").alias("l"), F.col("prefix").alias("p"))
        rows = rows.join(known, (F.col("lang") == F.col("l")) & (F.substring("prefix", 1, above) == F.col("p")), "left_semi")
    counted = rows.groupBy("lang", "prefix", "complete").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least).select("lang", "prefix", "complete")


def kept_terms(packs: DataFrame, least: int = LEAST, first: int | None = None) -> DataFrame:
    """(lang, term) of the terms that at least ``least`` documents of the language hold, level by level."""
    found, under, above, length = [], None, 0, first or FIRST
    while True:
        level = materialize(prefixes(packs, length, least, under, above))
        found.append(level.filter("complete").select("lang", F.col("prefix").cast("string").alias("term")))
        longer = level.filter("not complete").select("lang", "prefix")
        if longer.isEmpty():
            return reduce(DataFrame.unionAll, found)
        under, above, length = _sent(longer), length, 2 * length


# --- divergence -------------------------------------------------------------------------------


def term_counts(packs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, term, source, n) per slice of the kept terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scalar in column(batch, "pack"):
                pack = _unpacked(scalar)
                of = pa.array(np.repeat(np.arange(pack.num_rows), pc.list_value_length(pack["sources"]).to_numpy(zero_copy_only=False)))
                rows = pa.RecordBatch.from_arrays(
                    [pack["lang"].take(of), pack["term"].take(of), pack["sources"].flatten(), pack["counts"].flatten()],
                    ["lang", "term", "source", "n"],
                )
                for part in _parts(rows):
                    yield part.set_column(0, "lang", part["lang"].cast(pa.string())).set_column(2, "source", part["source"].cast(pa.string()))

    rows = packs.mapInArrow(run, "lang string, term string, source string, n long")
    return rows.join(_sent(kept), ["lang", "term"], "left_semi")


def _block(rows: pa.RecordBatch) -> pa.RecordBatch:
    """A block of sorted rows of one language."""
    term, source = (rows[c].dictionary_encode() for c in ("term", "source"))
    names, code = _in_order(source.dictionary, source.indices.to_numpy())
    n_names = max(1, len(names))
    key, back = np.unique(term.indices.to_numpy().astype(np.int64) * n_names + code, return_inverse=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, back, rows["n"].to_numpy())
    of, code = np.divmod(key, n_names)
    totals = np.zeros(len(names), np.int64)
    np.add.at(totals, code, n)
    at = pa.array(offsets_of(np.bincount(of, minlength=len(term.dictionary))).astype(np.int32))
    pack = pa.RecordBatch.from_arrays(
        [term.dictionary, pa.ListArray.from_arrays(at, pa.array(code.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(n))],
        ["term", "source", "n"],
    )
    return pa.RecordBatch.from_arrays(
        [
            rows["lang"].slice(0, 1), pa.array([len(term.dictionary)], pa.int64()), pa.ListArray.from_arrays([0, len(names)], names),
            pa.ListArray.from_arrays([0, len(names)], pa.array(totals)), pa.array([_packed(pack)], pa.binary()),
        ],
        ["lang", "n_terms", "sources", "totals", "pack"],
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole terms out of rows sorted by language and term."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def by_lang(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang = rows["lang"].dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(lang)) + 1).tolist(), len(lang)]
        for at, end in zip(cuts, cuts[1:], strict=False):
            yield _block(rows.slice(at, end - at))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) < BLOCK_ROWS:
            continue
        rows = joined(held)
        # The last term may go on in the next batch.
        last = [pc.equal(rows[c], rows[c][-1]) for c in ("lang", "term")]
        cut = pc.sum(pc.invert(pc.and_(*last))).as_py()
        if cut:
            yield from by_lang(rows.slice(0, cut))
            held = [rows.slice(cut)]
        else:
            sums = pa.Table.from_batches([rows]).group_by(["lang", "term", "source"]).aggregate([("n", "sum")])
            held = sums.rename_columns(["lang", "term", "source", "n"]).cast(rows.schema).combine_chunks().to_batches()
    if held:
        yield from by_lang(joined(held))


def _shares(count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + 1) / below)``, exact; counts too large for 64 bits go through Python's integers."""
    if count.max(initial=0) < 9_000_000_000:
        return 1 + SCALE * (count + 1) // below
    return (1 + SCALE * (count.astype(object) + 1) // np.asarray(below).astype(object)).astype(np.int64)


def _compared(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, item, value): sums of the task's terms for every two sources, and the best terms of each by block."""
    sums: dict[str, np.ndarray] = {}

    def found(lang, a, b, item, value):
        n = len(value)
        yield from _parts(
            pa.RecordBatch.from_arrays(
                [
                    pa.repeat(lang, n).cast(pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()) if b is not None else pa.nulls(n, pa.int32()),
                    item if item is not None else pa.nulls(n, pa.string()), pa.array(value, pa.int64()),
                ],
                ["lang", "a", "b", "item", "value"],
            )
        )

    for batch in batches:
        for k in range(batch.num_rows):
            lang = column(batch, "lang")[k].as_py()
            names, own = column(batch, "all_sources")[k].as_py(), column(batch, "sources")[k].as_py()
            totals, terms = column(batch, "all_totals")[k].values.to_numpy(), column(batch, "terms")[k].as_py()
            place = {name: i for i, name in enumerate(names)}
            to_all = np.array([place[x] for x in own], np.int64)
            held = sums.setdefault(lang, np.zeros((len(names), len(names)), np.int64))
            block = _unpacked(column(batch, "pack")[k])
            step = max(1, BLOCK // len(names))
            for at in range(0, block.num_rows, step):
                part = block.slice(at, step)
                of = np.repeat(np.arange(part.num_rows), pc.list_value_length(part["n"]).to_numpy(zero_copy_only=False))
                count = np.zeros((part.num_rows, len(names)), np.int64)
                count[of, to_all[part["source"].flatten().to_numpy()]] = part["n"].flatten().to_numpy()
                p = _shares(count, totals + terms)
                for a in range(len(names)):
                    apart = p[:, a : a + 1] - p
                    held[a] += (apart * apart // p).sum(axis=0)
                whole = count.astype(object).sum(axis=1) if count.max(initial=0) >= 1 << 40 else count.sum(axis=1)
                q = _shares(whole, sum(totals.tolist()) + terms)
                for a in range(len(names)):
                    some = np.flatnonzero((count[:, a] > 0) & (p[:, a] > q))
                    value = (p[some, a] - q[some]) ** 2 // q[some]
                    best = np.lexsort((some, -value))[:top]
                    yield from found(lang, np.full(len(best), a), None, part["term"].take(pa.array(some[best])), value[best])
    for lang, held in sums.items():
        a, b = np.indices(held.shape)
        yield from found(lang, a.ravel(), b.ravel(), None, held.ravel())


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and in which terms.

    Part ``pair`` has every other source, farthest first; part ``term`` the ``top`` terms that the source has more of than its
    language. Null lang, source and text are empty strings, so they are a language and a source of their own. Every row
    is a document, repeated ones too; ids are not read. A text of any length is one document and cut whole. Equal values
    rank by item. Groups without terms have pairs; in a language without kept terms all values of pairs are 0. An empty table
    gives no row. Columns other than lang, source and text are not read, whatever their names are.
    """
    packs = materialize(term_packs(docs, least))
    kept = materialize(kept_terms(packs, least))
    blocks = materialize(
        term_counts(packs, kept).repartition("lang", "term").sortWithinPartitions("lang", "term")
        .mapInArrow(_blocks, "lang string, n_terms long, sources array<string>, totals array<long>, pack binary")
    )
    totals = (
        blocks.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x"))
        .groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.totals").alias("total"))
    )
    # One row per language with all its sources; the result has a row for every two of them.
    langs = materialize(
        docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        .join(totals, ["lang", "source"], "left").groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0).cast("long")).alias("total")))).alias("x"))
        .join(blocks.groupBy("lang").agg(F.sum("n_terms").alias("terms")), "lang", "left")
        .select("lang", F.col("x.source").alias("all_sources"), F.col("x.total").alias("all_totals"), "terms")
    )
    found = materialize(
        blocks.select("lang", "sources", "pack").join(_sent(langs), "lang")
        .mapInArrow(lambda batches: _compared(batches, top), "lang string, a int, b int, item string, value long")
    )
    sums = found.filter("b is not null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    own = langs.select("lang", F.posexplode("all_sources").alias("a", "source"))
    other = own.select("lang", F.col("a").alias("b"), F.col("source").alias("item"))
    pairs = (
        own.join(other, "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left")
        .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    )
    terms = found.filter("b is null").join(own, ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), "item", "value")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(
        terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
c AS (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY 1, 2, 3),
g AS (
  SELECT a.lang, a.source, coalesce(b.n, 0) AS n, coalesce(v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM d) a
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY 1, 2) b ON a.lang = b.lang AND a.source = b.source
  LEFT JOIN v ON v.lang = a.lang
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS p
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (coalesce(x.n, 0) + 1)) // (t.n + v.v) AS q
  FROM k JOIN v ON v.lang = k.lang JOIN (SELECT lang, sum(n) AS n FROM c GROUP BY 1) t ON t.lang = k.lang
  LEFT JOIN (SELECT lang, term, sum(n) AS n FROM c GROUP BY 1, 2) x ON x.lang = k.lang AND x.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, (((p - q) * (p - q)) // q)::BIGINT
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r
)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""
