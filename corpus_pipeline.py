"""From raw documents to training tokens: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ragmill.llm import minhash, mixing, segmentation, surrogates, toxicity
from ragmill.session import materialize
from ragmill.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null and empty texts are scored like others."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; rows without an id all stay."""
    return minhash.drop_near_duplicates(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates under the key of the session; the given tables are made up, so a test key stands in where there is none."""
    return surrogates.with_surrogates(docs, surrogates.key_of(spark, test_key="key for made-up documents"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, in the columns of documents; those of small sources as often as the mix passes them."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document; passes of one document have the same, as draws are seeded by its id."""
    import public_tokenizers

    # Executors have grown in the stages before, so workers keep little.
    return segmentation.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), kept_bytes=32 << 20, slice_bytes=512 << 10)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", replace_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL knows neither the classifier nor the sampled segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage that leaves no rows leaves an empty table to the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
