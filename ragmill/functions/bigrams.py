"""The two 2-gram measures; they differ on purpose and must not be mixed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragmill.functions.text import WS, trimmed, one_space

#: Overlapping pairs of characters: look two ahead, step one code point.
PAIRS = r"(?s)(?=(..))."
# Fixed value: characters ignored when two names are compared.
NAME_PARTICLES = "をにはがのもとでやへからまで等"


def padded(text: Column) -> Column:
    """Words separated and surrounded by one space; empty for blank text."""
    flat = trimmed(one_space(text))
    return F.when(F.length(flat) > 0, F.concat(F.lit(" "), flat, F.lit(" "))).otherwise("")


def bigrams(text: Column) -> Column:
    """Distinct 2-grams of the padded text."""
    return F.array_distinct(F.regexp_extract_all(padded(text), F.lit(PAIRS), F.lit(1)))


def set_similarity(a: Column, b: Column) -> Column:
    """common / larger set, for two arrays of distinct 2-grams."""
    widest = F.greatest(F.size(a), F.size(b))
    return F.when(widest > 0, F.size(F.array_intersect(a, b)) / widest).otherwise(F.lit(0.0))


def bigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(bigrams(a), bigrams(b))


def without_particles(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), f"[{NAME_PARTICLES}]", "")


def name_bigrams(name: Column) -> Column:
    """Distinct 2-grams of a name, particles removed, without padding."""
    return F.array_distinct(F.regexp_extract_all(without_particles(name), F.lit(PAIRS), F.lit(1)))


def set_jaccard(a: Column, b: Column) -> Column:
    """intersection / union of two distinct arrays; 0 when either is empty."""
    common = F.size(F.array_intersect(a, b))
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def bigram_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(name_bigrams(a), name_bigrams(b))


__all__ = ["WS", "padded", "bigrams", "bigram_similarity", "bigram_jaccard", "name_bigrams", "set_jaccard", "set_similarity"]
