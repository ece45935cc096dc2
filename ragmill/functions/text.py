"""Text cleaning columns. Lengths and cuts count code points."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All Unicode blanks, most of which Java's ``\s`` leaves out: separators of spaces, lines and paragraphs, and the
#: blanks among the control characters.
WS = r"[\p{Z}\t-\r\x1C-\x1F\x{85}]"
WS_CHARS = " \t\n\r　"
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F\x80-\x9F]"
CONTROL_ALL = r"[\x00-\x1F\x7F\x80-\x9F]"

# Language names and their BCP-47 codes.
LANGUAGE_CODES = {
    "ja": "ja-JP",
    "japanese": "ja-JP",
    "en": "en-US",
    "english": "en-US",
    "zh": "zh-CN",
    "chinese": "zh-CN",
    "ko": "ko-KR",
    "korean": "ko-KR",
}
# Fixed value: stands in for a name that is empty after cleaning.
NO_NAME = "(名前なし)"
# Fixed value: characters that count as Japanese script.
JAPANESE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}　-〿＀-￯]"


def trimmed(col: Column) -> Column:
    """Trim whitespace, all Unicode blanks."""
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def without_space(col: Column) -> Column:
    return F.regexp_replace(col, f"{WS}+", "")


def one_space(col: Column) -> Column:
    return F.regexp_replace(col, f"{WS}+", " ")


def let(value: Column, use) -> Column:
    """``use(value)`` with value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def map_of(values: dict) -> Column:
    """A small constant dictionary as a map column."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(col: Column) -> Column:
    """Unicode NFKC; Spark has no built-in for it. Pure ASCII text never leaves the JVM."""
    plain = col.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, col).otherwise(_nfkc(F.when(~plain, col)))


def lf(col: Column) -> Column:
    return F.regexp_replace(col, r"\r\n?", "\n")


def strip_control(col: Column) -> Column:
    """Drop C0 (but newline and tab), DEL and C1."""
    return F.regexp_replace(col, CONTROL, "")


def neutralize_markers(col: Column) -> Column:
    """``[12]`` at a line start becomes full-width, so it cannot pose as a source."""
    return F.regexp_replace(strip_control(lf(col)), r"(?m)^\[(\d{1,4})\]", "［$1］")


def neutralize_document_tags(col: Column) -> Column:
    """Escape ``<`` where a document tag would begin or end."""
    return F.regexp_replace(strip_control(lf(col)), r"(?i)<(?=/?\s*documents?[\s>])", "&lt;")


def cut_chars(col: Column, n: int) -> Column:
    """(text, cut): the first n code points and whether something was left out."""
    return F.struct(F.left(col, F.lit(n)).alias("text"), (F.length(col) > n).alias("cut"))


def escape_attribute(col: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def clean_name(col: Column, n: int = 100) -> Column:
    spaced = F.regexp_replace(col, r"[\t\n\r]", " ")
    cut = F.left(trimmed(one_space(F.regexp_replace(spaced, CONTROL_ALL, ""))), F.lit(n))
    return F.when(F.length(cut) > 0, escape_attribute(cut)).otherwise(NO_NAME)


def object_name(col: Column, fallback: str, n: int = 120, ext_n: int = 16) -> Column:
    """A name that is safe inside an object key and keeps a short extension."""
    name = F.regexp_replace(F.regexp_replace(col, CONTROL_ALL, ""), r"[/\\]", "_")
    name = trimmed(F.regexp_replace(trimmed(one_space(name)), r"^\.+", ""))
    tail = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    has_ext = (F.length(tail) > 0) & (F.length(tail) <= ext_n) & (F.length(tail) < F.length(name))
    ext = F.when(has_ext, tail).otherwise("")
    cut = F.concat(F.left(name, F.lit(n) - F.length(ext)), ext)
    out = F.when(F.length(name) > n, cut).otherwise(name)
    return F.when(F.length(out) > 0, out).otherwise(fallback)


def remove_japanese_spaces(col: Column) -> Column:
    """Remove whitespace beside Japanese characters; keep it between Latin words."""
    after = F.regexp_replace(col, f"({JAPANESE}){WS}+", "$1")
    return F.regexp_replace(after, f"{WS}+({JAPANESE})", "$1")


def map_language(col: Column) -> Column:
    return F.coalesce(map_of(LANGUAGE_CODES)[F.lower(trimmed(col))], col)


def is_japanese(col: Column) -> Column:
    return F.lower(trimmed(col)).isin("ja", "japanese")


def strip_close_tag(col: Column) -> Column:
    return F.regexp_replace(col, r"(?i)</\s*state\s*>", "")


def snippet(col: Column, n: int) -> Column:
    flat = trimmed(one_space(col))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.left(flat, F.lit(n)), F.lit("…")))


_BYTE_RUN = re.compile(r"(?:<0x[0-9A-Fa-f]{2}>)+")


def decode_byte_run(run: str) -> str:
    """Turn ``<0xE3>``-style tokens back into text; bytes that form no character stay."""
    data = bytes.fromhex("".join(run[i + 3 : i + 5] for i in range(0, len(run), 6)))
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                char = data[at : at + size].decode("utf-8")
            except UnicodeDecodeError:
                continue
            # A decoded replacement character cannot be told from damage: keep the tokens.
            if char != "�":
                out.append(char)
                at += size
                break
        else:
            out.append(run[at * 6 : at * 6 + 6])
            at += 1
    return "".join(out)


def decode_bytes_text(text: str) -> str:
    return _BYTE_RUN.sub(lambda m: decode_byte_run(m.group()), text)


@F.pandas_udf(T.StringType())
def _decode_byte_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or "<0x" not in t else decode_bytes_text(t))


def decode_byte_tokens(col: Column) -> Column:
    return _decode_byte_tokens(col)
