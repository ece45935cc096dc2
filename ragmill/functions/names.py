"""Law names: normal form, identifying part, comparison key."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragmill.functions.text import let, nfkc, without_space

# Patterns and word lists of law names.
ENACTMENT_NUMBER = "(明治|大正|昭和|平成|令和)[一二三四五六七八九十百元]+年[^（()）]*?第[一二三四五六七八九十百千]+号"
PARENTHETICAL = "[（(][^（()）]*[)）]"
PARENTHETICAL_BODY = "[（(]([^（()）]*)[)）]"
KEY_PARTICLES = "のにをはがともへや"
FORM_SUFFIXES = (
    "の施行に伴う関係法律の整備等に関する法律",
    "の施行に伴う関係政令の整備等に関する政令",
    "の一部を改正する法律",
    "の一部を改正する政令",
    "の一部を改正する省令",
    "の一部を改正する規則",
    "に関する法律施行令",
    "に関する法律施行規則",
    "の特例に関する法律",
    "に関する法律",
    "に関する政令",
    "に関する省令",
    "に関する府令",
    "に関する規則",
    "に関する命令",
    "に関する件",
    "を定める政令",
    "を定める省令",
    "を定める規則",
    "を定める件",
    "法律施行令",
    "法律施行規則",
    "法施行令",
    "法施行規則",
    "施行令",
    "施行規則",
    "施行法",
    "設置法",
    "組織令",
    "組織規則",
    "の特例",
    "法律",
    "省令",
    "政令",
    "府令",
    "条例",
    "規則",
    "命令",
    "法",
    "令",
    "律",
    "等",
)
SUFFIX_ROUNDS = 6
MIN_LENGTH = 2
SPOKEN_NAME = "[一-龥ァ-ヴー]+(?:法律|法|規則|政令|条例|省令)(?![一-龥ァ-ヴー])"
SPOKEN_MIN = 4
ORDINANCES = ("施行令", "施行規則")
ALIAS_SEPARATORS = r"[\s　・･〔〕（）()]"

#: The leftmost match that ends the name is its longest suffix.
_SUFFIX = "(?<=.)(?:" + "|".join(FORM_SUFFIXES) + ")$"


def normalize_query(text: Column) -> Column:
    """NFKC and no whitespace: positions refer to this form."""
    return without_space(nfkc(F.coalesce(text, F.lit(""))))


def _bare(base: Column) -> Column:
    def choose(base: Column) -> Column:
        outside = F.regexp_replace(F.regexp_replace(base, PARENTHETICAL, ""), ENACTMENT_NUMBER, "")
        inner = F.regexp_extract(base, PARENTHETICAL_BODY, 1)
        forms = F.array(outside, inner, base)
        return F.element_at(F.filter(F.concat(forms, F.array(F.lit(""))), lambda f: (F.length(f) > 0) | (base == "")), 1)

    return let(base, choose)


def normalize_name(name: Column) -> Column:
    """Without parentheticals and enactment numbers; what is inside them when nothing else is left."""
    return _bare(normalize_query(name))


def strip_suffixes(normalized: Column) -> Column:
    """The identifying part of an already normalised name."""

    def strip(name: Column) -> Column:
        out = name
        for _ in range(SUFFIX_ROUNDS):
            out = F.regexp_replace(out, _SUFFIX, "")
        return let(out, lambda short: F.when(F.length(short) < MIN_LENGTH, name).otherwise(short))

    return let(normalized, strip)


def identifier(name: Column) -> Column:
    return strip_suffixes(normalize_name(name))


def identifier_key(ident: Column) -> Column:
    """Identifier without a trailing 等 and without particles."""

    def fold(name: Column) -> Column:
        key = F.translate(F.regexp_replace(name, "等+$", ""), KEY_PARTICLES, "")
        return let(key, lambda k: F.when(F.length(k) < MIN_LENGTH, name).otherwise(k))

    return let(F.coalesce(ident, F.lit("")), fold)


def name_key(name: Column) -> Column:
    return identifier_key(identifier(name))


def alias_key(name: Column) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), ALIAS_SEPARATORS, "")


def names_in_query(text: Column) -> Column:
    """Law-like words of a text, at least four characters long."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPOKEN_NAME), F.lit(0))
    return F.filter(found, lambda n: F.length(n) >= SPOKEN_MIN)


_SPOKEN = re.compile(SPOKEN_NAME)
_SPAN = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
)


@F.pandas_udf(T.ArrayType(_SPAN))
def _spans(texts: pd.Series) -> pd.Series:
    def of(text):
        hits = _SPOKEN.finditer(text or "")
        return [{"name": m[0], "start": m.start(), "end": m.end()} for m in hits if len(m[0]) >= SPOKEN_MIN]

    return texts.map(of)


def name_spans(text: Column) -> Column:
    """As names_in_query, with positions; Spark's regex functions give none."""
    return _spans(text)


def expand_ordinances(names: Column) -> Column:
    """Originals first, then enforcement order and rules of every act among them."""
    acts = F.filter(names, lambda n: n.endswith("法律") | n.endswith("法"))
    added = F.flatten(F.transform(acts, lambda n: F.array(*[F.concat(n, F.lit(o)) for o in ORDINANCES])))
    return F.array_distinct(F.concat(names, added))
