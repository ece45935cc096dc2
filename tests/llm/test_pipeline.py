"""The stages and the surrogates against plain versions of what each is to do with its own input."""

import collections
import random

import public_tokenizers
import pytest

import corpus_pipeline
from ragmill.llm import mixing, segmentation, surrogates, toxicity
from ragmill.tables import table
from tests import oracle
from tests.llm.test_documents import near_by_pairs

KEY = "a key for tests"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def ids_of(rows):
    return collections.Counter((r["doc_id"], r["text"]) for r in rows)


@pytest.fixture(scope="module")
def odd(spark):
    """The given documents with rows of every odd kind, and columns whose names the stages might use themselves."""
    docs = table(spark, oracle.DEFAULT_DIR, "documents").limit(150)
    rng = random.Random(8)
    base = " ".join(f"word{rng.randrange(5000)}" for _ in range(80))
    extra = [
        (None, "a row without an id"), (None, None), (9001, None), (9002, ""), (9003, " \n "), (9004, base), (9005, base), (9006, base + " end"),
        (9007, "x " * 20_000), (9008, "one text of an id"), (9008, "quite another text of it"), (9009, "mail a.b@example.org or +1 212-555-0147"),
    ]
    more = spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in extra], docs.schema)
    return docs.unionByName(more).selectExpr("*", "'k' as key", "1 as block", "2 as row", "0D as score", "3 as n_pieces", "4 as tokens").repartition(4)


def test_each_stage_does_its_work_on_its_own_input(spark, odd):
    sf, stages = oracle.DEFAULT_DIR, dict(corpus_pipeline.STAGES)
    columns = odd.columns
    docs = rows_of(odd)

    # Toxicity: the rows that the model scores at the threshold or above go, all others stay.
    labels = table(spark, sf, "labels")
    scored = toxicity.score(odd, toxicity.fit(odd, labels), tuple(columns), "found").collect()
    kept = rows_of(frame := stages["toxicity"](spark, odd, sf))
    assert frame.columns == columns and len(scored) == len(docs)
    assert ids_of(kept) == collections.Counter((r["doc_id"], r["text"]) for r in scored if r["found"] < toxicity.THRESHOLD)

    # Near-duplicates: one of each group by brute force, rows without an id, and every text of an id that is like no other.
    frame = spark.createDataFrame(kept, odd.schema).repartition(3)
    left = rows_of(out := stages["near-duplicates"](spark, frame, sf))
    assert out.columns == columns
    single = [(r["doc_id"], r["text"]) for r in kept if r["doc_id"] not in (None, 9008)]
    groups = collections.defaultdict(list)
    for i, (_, component) in near_by_pairs(single).items():
        groups[component].append(i)
    assert all(len({r["doc_id"] for r in left} & set(g)) == 1 for g in groups.values())
    assert sum(r["doc_id"] is None for r in left) == sum(r["doc_id"] is None for r in kept)
    assert sum(r["doc_id"] == 9008 for r in left) == sum(r["doc_id"] == 9008 for r in kept)

    # Personal data: every text as the plain function gives it.
    frame = spark.createDataFrame(left, odd.schema).repartition(3)
    clean = rows_of(out := stages["personal data"](spark, frame, sf))
    key = surrogates.key_of(spark, "key for made-up documents")
    want = collections.Counter((r["doc_id"], surrogates.replace(r["text"], key)[0] if r["text"] else r["text"]) for r in left)
    assert out.columns == columns and ids_of(clean) == want
    assert all(r["n_chars"] == len(r["text"]) for r in clean if r["text"] is not None)
    assert not any("example.org" in (r["text"] or "") and "a.b@" in r["text"] for r in clean)

    # Mixing: no row is lost, and each comes as often as the plan of its source says, give or take the last block.
    frame = spark.createDataFrame(clean, odd.schema).repartition(3)
    mixed = rows_of(out := stages["mixing"](spark, frame, sf))
    assert out.columns == columns
    before, after = ids_of(clean), ids_of(mixed)
    assert set(before) == set(after) and all(after[k] >= before[k] for k in before)
    passes = {r["source"]: r["n"] for r in mixing.mix(frame).groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert collections.Counter(r["source"] for r in mixed) == passes

    # Pieces: a row each, and decoding gives the text back.
    frame = spark.createDataFrame(mixed, odd.schema).repartition(3)
    pieces = rows_of(stages["pieces"](spark, frame, sf))
    vocab = segmentation.vocabulary(public_tokenizers.path("piece_bpe_32k.model"), segmentation.ALPHA)
    got = collections.Counter((r["doc_id"], segmentation.decode(r["pieces"], vocab) if r["pieces"] else "") for r in pieces)
    assert got == collections.Counter((r["doc_id"], r["text"] or "") for r in mixed) and all(r["lossless"] for r in pieces)


def test_stages_on_an_empty_table(spark, odd):
    docs = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, oracle.DEFAULT_DIR)
        assert docs.count() == 0, name


def test_surrogates_of_a_whole_table_are_distinct_and_the_same_everywhere(spark):
    """Brute force over every mention of the table: one surrogate per entity, one entity per surrogate, none a real entity."""
    docs = table(spark, oracle.DEFAULT_DIR, "documents").select("doc_id", "text")
    new = {r["doc_id"]: r for r in surrogates.with_surrogates(docs, KEY, spans=True).collect()}
    made, owners, n = {}, collections.defaultdict(set), 0
    for r in docs.collect():
        found, row = surrogates.entities(r["text"]), new[r["doc_id"]]
        assert len(found) == len(row["entities"])
        rest, old, shift = [], 0, 0
        for (start, end, kind, canonical), e in zip(found, row["entities"], strict=True):
            text = row["text"][e["start"] : e["end"]]
            # What stands between entities is as it was.
            assert row["text"][old + shift : e["start"]] == r["text"][old:start]
            old, shift = end, e["end"] - end
            key = surrogates._canonical(kind, text)[1] if kind in ("email", "phone", "card", "account", "ssn", "iban") else text
            assert made.setdefault((kind, canonical), key) == key
            owners[kind, key].add(canonical)
            n += 1
            rest.append(text)
        assert row["text"][old + shift :] == (r["text"] or "")[old:] if r["text"] else True
    real = {k for k in made if k[0] not in ("given",)}
    assert n > 20 and all(len(x) == 1 for (kind, _), x in owners.items())
    assert not any((kind, key) in real for kind, key in owners if kind != "given")
