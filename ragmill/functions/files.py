"""What a file is: by name, by content, and whether it may be taken in."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File kinds by extension and by media type.
DOCX_MEDIA = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX_MEDIA = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
HTML_EXT = ("html", "htm")
HTML_MEDIA = ("text/html", "application/xhtml+xml")
TEXT_EXT = ("txt", "md", "markdown", "csv")
TEXT_MEDIA = ("text/plain", "text/markdown", "text/x-markdown", "text/csv", "application/csv")
IMAGE_MEDIA = ("image/png", "image/jpeg", "image/jpg", "image/webp", "image/gif")
# First bytes of the containers, as hex.
MAGIC = {
    "25504446": "pdf",
    "504B0304": "zip",
    "89504E47": "image",
    "47494638": "image",
    "52494646": "image",
    "FFD8FF": "image",
}
# Version of each text extractor and of its rules.
EXTRACTORS = {
    "pdf": ("pdfjs-dist", "6.3.289", 1),
    "docx": ("mammoth", "1.12.3", 1),
    "xlsx": ("read-excel-file", "9.3.10", 1),
    "html": ("node-html-parser", "9.0.4", 2),
    "text": ("text-decode", "1", 1),
}
# Default limits of taking a document in.
LIMITS = {"max_bytes": 20971520, "max_chars": 300000, "max_pages": 300, "max_chunks": 300}


def extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def detect_kind(name: Column, media: Column) -> Column:
    ext = extension(name)
    kind = F.lower(F.trim(F.split_part(F.coalesce(media, F.lit("")), F.lit(";"), F.lit(1))))
    return (
        F.when((ext == "pdf") | (kind == "application/pdf"), "pdf")
        .when((ext == "docx") | (kind == DOCX_MEDIA), "docx")
        .when((ext == "xlsx") | (kind == XLSX_MEDIA), "xlsx")
        .when(ext.isin(*HTML_EXT) | kind.isin(*HTML_MEDIA), "html")
        .when(kind.isin(*IMAGE_MEDIA), "image")
        .when(ext.isin(*TEXT_EXT) | kind.isin(*TEXT_MEDIA), "text")
        .otherwise("unsupported")
    )


def sniff_container(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    out = F.when(F.lit(False), "")
    for magic, name in MAGIC.items():
        out = out.when(head.startswith(magic), name)
    return out.otherwise("unknown")


def container_matches(kind: Column, container: Column) -> Column:
    expected = F.when(kind == "pdf", "pdf").when(kind.isin("docx", "xlsx"), "zip").otherwise("unknown")
    return expected == container


def mime_of(kind: Column, name: Column) -> Column:
    ext = extension(name)
    return (
        F.when(kind == "pdf", "application/pdf")
        .when(kind == "docx", DOCX_MEDIA)
        .when(kind == "xlsx", XLSX_MEDIA)
        .when(kind == "html", "text/html")
        .when(ext.isin("md", "markdown"), "text/markdown")
        .when(ext == "csv", "text/csv")
        .otherwise("text/plain")
    )


def extractor_label(version: Column, rules: Column) -> Column:
    return F.concat(version, F.lit("+r"), rules.cast("string"))


def current_label(kind: Column) -> Column:
    """Label of the extractor a kind is read with today."""
    out = F.when(F.lit(False), "")
    for name, (_, version, rules) in EXTRACTORS.items():
        out = out.when(kind == name, f"{version}+r{rules}")
    return out


# Byte order marks and the charsets tried after UTF-8.
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
LEGACY = ("cp932", "euc_jp")


def decode_bytes(data: bytes) -> str:
    tries = [(data[len(mark) :], name) for mark, name in BOMS if data.startswith(mark)]
    for body, name in [*tries, (data, "utf-8"), *[(data, name) for name in LEGACY]]:
        try:
            return body.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def _decode(contents: pd.Series) -> pd.Series:
    return contents.map(lambda b: None if b is None else decode_bytes(bytes(b)))


def decode_text(content: Column) -> Column:
    """Text of bytes; valid UTF-8 without a mark never leaves the JVM's fast path."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    marked = F.hex(F.substring(content, 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")
    return F.when(~marked & utf8.isNotNull(), utf8).otherwise(_decode(F.when(marked | utf8.isNull(), content)))
