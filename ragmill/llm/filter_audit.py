"""What filters remove, and what they take from each other, kept up to date while files arrive.

A stream reads the files in micro-batches. Four filters look at a document alone; the fifth, of texts that a smaller id
has already, depends on all others, so what a batch says about it may be taken back by a later one: the state of a text
is its smallest id so far with the sources of the rows that have it. When a smaller id arrives, what was counted
for the rows before it is retracted from the counters of their source and counted again with the fifth failure added.

Counters are rows (part, mask, good, toxic) with a change of their number, where a mask has a bit for each filter that a
document fails. A batch writes the sums of its changes to a folder of its own, so a repeated batch replaces its first try. As
the counters say how many documents fail which filters together, they give every step of every order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ragmill.llm.texts import column, slices, split_words
from ragmill.session import shared_dir

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 50, 65, 5, "#$%&*|"
#: The bit of the filter of repeated texts.
COPY = 16
#: Files of a micro-batch.
BATCH_FILES = 4
#: Text that a task judges together.
SLICE_BYTES = 4 << 20
#: Rows that a task folds before the shuffle.
FOLD_ROWS = 200_000
#: Groups that texts are dealt to. A call into Python and a batch of results serve all texts of a group, not one text.
GROUPS = 4096
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "part string, mask int, good int, toxic int, n long"
_ROWS = "key binary, doc_id long, part string, mask int, good int, toxic int, n long"
_FOLDED = pa.schema([
    ("key", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("good", pa.int32()),
    ("toxic", pa.int32()), ("n", pa.int64()),
])


_SIGN = np.zeros(256, bool)
_SIGN[list(SIGNS.encode())] = True


def masks(texts: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails: 1, 2, 4, 8."""
    texts = pc.fill_null(pc.cast(texts, pa.string()), "")
    codes, names, sizes = split_words(texts)
    pairs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(1, len(names)) + codes)
    distinct = np.bincount(pairs // max(1, len(names)), minlength=len(sizes))
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)

    def number(of: np.ndarray) -> np.ndarray:
        run = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(of, out=run[1:])
        return (run[at[1:] - at[0]] - run[at[:-1] - at[0]]).astype(np.int64)

    fails = [
        sizes < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * sizes,
        100 * number((raw >= 0x41) & (raw <= 0x5A)) > CAPITAL_PERCENT * number((raw & 0xC0) != 0x80),  # bytes that begin a character
        number(_SIGN[raw]) > 0,
    ]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "text", SLICE_BYTES):
            text = column(rows, "text")
            key = pa.array([sha256(t.as_buffer()).digest() for t in text], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [column(rows, "doc_id"), column(rows, "part"), key, pa.array(masks(text), pa.int32())], ["doc_id", "part", "key", "mask"]
            )


def _single(stream: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, doc_id, part, mask, good, toxic) per document: all that is asked of a text by itself."""
    known = (
        labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
        .withColumn("salt", F.lit(0))
    )
    rows = stream.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    narrow = rows.mapInArrow(_judged, "doc_id long, part string, key binary, mask int")
    # Rows without an id have no label and are spread.
    salted = narrow.select(
        "*", F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("key", "part"), F.lit(4096))).otherwise(0).cast("int").alias("salt"),
    )
    return salted.join(known, ["id", "salt"], "left").select(
        "key", "doc_id", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    )


def _folded(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of rows with the same text those of the smallest id go on; the others are counted at once, as repeated."""
    counted = ["part", "mask", "good", "toxic"]
    code = rows["key"].combine_chunks().dictionary_encode().indices
    ids = pc.fill_null(rows["doc_id"], (1 << 63) - 1)
    least = pa.table({"code": code, "id": ids}).group_by("code").aggregate([("id", "min")]).sort_by("code")["id_min"]
    first = pc.equal(ids, least.take(code))
    known = pc.is_valid(rows["doc_id"])
    rows = rows.append_column("n", pa.repeat(pa.scalar(1, pa.int64()), rows.num_rows))
    going = rows.filter(pc.and_(first, known)).group_by(["key", "doc_id", *counted]).aggregate([("n", "sum")])
    going = going.rename_columns(["key", "doc_id", *counted, "n"])
    rest = rows.filter(pc.invert(pc.and_(first, known)))
    copies = pc.if_else(pc.is_valid(rest["doc_id"]), pa.scalar(COPY, pa.int32()), pa.scalar(0, pa.int32()))
    rest = rest.set_column(rest.schema.get_field_index("mask"), "mask", pc.add(rest["mask"], copies))
    rest = rest.group_by(counted).aggregate([("n", "sum")]).rename_columns([*counted, "n"])
    # Numbers that are settled travel under a key of their own.
    name = pc.binary_join_element_wise(rest["part"], *[rest[c].cast(pa.string()) for c in counted[1:]], "/").cast(pa.binary())
    rest = rest.append_column("key", name).append_column("doc_id", pa.nulls(rest.num_rows, pa.int64()))
    for table in (going, rest):
        yield from table.select(_FOLDED.names).cast(_FOLDED).combine_chunks().to_batches()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= FOLD_ROWS:
            yield from _folded(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield from _folded(pa.Table.from_batches(held))


class SmallestId(StatefulProcessor):
    """State of a text: its smallest id so far, the mask and labels of that id, and its rows by part.

    A group of texts has a map of their states, by the key of a text, and gives the sums of its changes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState(
            "smallest", "key binary", "doc_id long, mask int, good int, toxic int, parts array<struct<part:string,n:long>>"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held: dict[bytes, list] = {}  # key: smallest id, its marks, rows by part, changed
        sums: Counter = Counter()
        for row in rows:
            marks = (row.mask, row.good, row.toxic)
            if row.doc_id is None:
                sums[row.part, *marks] += row.n
                continue
            text = held.get(row.key)
            if text is None:
                old = self.states.getValue((row.key,))
                text = held[row.key] = [old[0], tuple(old[1:4]), {p[0]: p[1] for p in old[4]}, False] if old else [None, None, {}, False]
            smallest, known, parts, _ = text
            if smallest is not None and row.doc_id > smallest:
                sums[row.part, row.mask | COPY, row.good, row.toxic] += row.n
                continue
            if smallest is None or row.doc_id < smallest:
                for part, n in parts.items():
                    sums[part, *known] -= n
                    sums[part, known[0] | COPY, *known[1:]] += n
                text[:3] = row.doc_id, marks, {}
            text[2][row.part] = text[2].get(row.part, 0) + row.n
            text[3] = True
            sums[row.part, *marks] += row.n
        for name, (smallest, marks, parts, changed) in held.items():
            if changed:
                self.states.updateValue((name,), (smallest, *marks, list(parts.items())))
        for (part, mask, good, toxic), n in sums.items():
            yield Row(part=part, mask=mask, good=good, toxic=toxic, n=n)

    def close(self) -> None:
        pass


def changes(stream: DataFrame, labels: DataFrame) -> DataFrame:
    """The changes of the part counters, as documents arrive."""
    rows = _single(stream, labels).mapInArrow(_fold, _ROWS)
    group = F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int").alias("group")
    return rows.select(group, "*").groupBy("group").transformWithState(SmallestId(), CHANGES, "Update", "None")


def run(stream: DataFrame, labels: DataFrame, root: str) -> None:
    """Process what is there. ``root`` keeps state and counters: another call with it goes on with new files only."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        sums.write.mode("overwrite").parquet(f"{root}/counters/batch={number}")

    settings = {
        "spark.sql.streaming.stateStore.providerClass": PROVIDER,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # Many small stores: their files are not made larger than what is in them.
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        query = (
            changes(stream, labels).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        )
    finally:  # the query has a copy of the settings
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()


def counters(spark: SparkSession, root: str) -> DataFrame:
    """(part, mask, good, toxic, n) as they stand."""
    spark.createDataFrame([], CHANGES).write.mode("overwrite").parquet(f"{root}/counters/batch=-1")
    rows = spark.read.schema(f"{CHANGES}, batch long").parquet(f"{root}/counters")
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


def interactions(counted: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, out of the counters."""
    steps = [
        {"filter_order": "".join(order), "step": i + 1, "bit": 1 << FILTERS.index(f), "before": sum(1 << FILTERS.index(x) for x in order[:i])}
        for order in permutations(FILTERS) for i, f in enumerate(order)
    ]
    one = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in steps])
    masks = counted.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )
    by_part = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = by_part.select("part", "masks", F.explode(one).alias("s")).select("part", "masks", "s.*")

    def total(condition: str, number: str = "x.n") -> F.Column:
        return F.expr(f"aggregate(masks, 0L, (sum, x) -> sum + if({condition}, {number}, 0L))")

    removed = "x.mask & bit <> 0 and x.mask & before = 0"
    return rows.select(
        "part", "filter_order", "step",
        total("x.mask & (before | bit) = 0").alias("kept"), total(removed).alias("removed"),
        total("x.mask & bit <> 0 and x.mask & before <> 0").alias("redundant"), total("x.mask = bit").alias("unique_fails"),
        total(removed, "x.good").alias("good_lost"), total(removed, "x.toxic").alias("toxic_lost"),
        # Of the filters that a document fails each comes first in as many orders.
        total("x.mask & bit <> 0", "x.n * (120 div bit_count(x.mask))").alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame, batch_files: int = BATCH_FILES, root: str | None = None) -> DataFrame:
    """What each filter does in each order, per part: a row per source, ``filter_order`` and ``step``.

    ``path`` is a Parquet table of documents (doc_id, text, source), read as a stream of its files, ``labels`` has (doc_id,
    quality, toxic). Null text and source are empty strings; a text may have any length. Rows without an id are no copies
    and make none; rows that share id and text are no copies of each other, as none has a smaller id, and
    all of them count. A document without a label is neither good nor toxic; of several labels of one id any will do. An
    empty table gives no rows. Columns are read by name, others are left out, whatever their names are.
    """
    root = root or f"{shared_dir(spark)}/filter-audit"
    path = path.rstrip("/")
    files = f"{path[:-1]}[{path[-1]}]"  # as a pattern, the table may be a folder or a single file
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", batch_files).parquet(files)
    run(stream, labels, root)
    return interactions(counters(spark, root))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (
  SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, FALSE)::INT AS mask FROM w
), l AS (
  SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY 1
), c AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY 1, 2
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
)
SELECT part, filter_order, step::INTEGER AS step,
  sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step, bit
"""
