"""All Unicode blanks count as white space."""

from pyspark.sql import functions as F

from ragmill.functions import text as t
from ragmill.operators import evaluation
from ragmill.operators.topk import bigram_codes

BLANKS = "      　 \u0085\x1c\t\r\n \x0b\x0c"


def test_blanks_are_removed(spark):
    df = spark.createDataFrame([("a" + BLANKS + "b" + BLANKS,)], "s string")
    row = df.select(t.without_space(F.col("s")), t.one_space(F.col("s")), t.trimmed(F.col("s"))).first()
    assert (row[0], row[1]) == ("ab", "a b ") and row[2] == "a" + BLANKS + "b"


def test_needle_is_found_behind_any_blank(spark):
    df = spark.createDataFrame([("a b c", "abc"), ("ac", "abc")], "content string, needle string")
    assert [r[0] for r in df.select(evaluation.needle_hit(F.col("content"), F.col("needle"))).collect()] == [True, False]


def test_bigrams_see_the_same_blanks():
    assert all((bigram_codes(f"a{c}b") == bigram_codes("a b")).all() for c in BLANKS)
