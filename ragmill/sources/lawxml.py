"""Law XML files to article rows."""

from __future__ import annotations

import os
from xml.parsers import expat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.functions.dates import era_to_date
from ragmill.session import slices, spread

# Element names of the law XML and the words it uses.
SUBITEMS = [f"Subitem{n}" for n in range(1, 11)]
BLOCKS = {"Article", "Paragraph", "Item", "List", "Table", *SUBITEMS}
TITLES = {"ArticleCaption", "ArticleTitle", "ParagraphNum", "ItemTitle", *[f"{s}Title" for s in SUBITEMS]}
SENTENCES = {"ParagraphSentence", "ItemSentence", *[f"{s}Sentence" for s in SUBITEMS]}
INDENT = "　"
DELETED = "削除"
MAIN_PROVISION = ("Main_Provision", "本則")
BLANKS = "　 \n\t"

ARTICLE_FIELDS = (
    "law_id string, law_num string, law_title string, unique_anchor string, anchor string, content string, "
    "article_summary string, era string, year int, law_type string, promulgate_date string"
)
PARSED = (
    "path string, error string, law_id string, law_num string, law_title string, unique_anchor string, anchor string, "
    "content string, article_summary string, era string, law_type string, xml_year string, xml_month string, xml_day string"
)


class LawReader:
    """Articles of one law file, put together while its elements close.

    Every open block keeps the texts of its titles, of its sentences, and the lines of what it contains. When it closes, its
    own line comes first and all lines go to the block around it, one step deeper. Text is one growing list of
    pieces; an element's text is what was added since it opened.
    """

    def __init__(self):
        self.pieces: list[str] = []
        self.open: list[dict] = []
        self.law: dict[str, str | None] = {"law_num": None, "law_title": None}
        self.main: list[dict] = []
        self.other: list[dict] = []
        self.bare: list[str] | None = None  # lines of the first main provision, as long as it has no article

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        up = self.open[-1] if self.open else None
        if up is None:
            self.law |= {
                "era": attrs.get("Era"), "law_type": attrs.get("LawType"), "xml_year": attrs.get("Year"),
                "xml_month": attrs.get("PromulgateMonth"), "xml_day": attrs.get("PromulgateDay"),
            }
        article = up["article"] if up else None
        part = up["part"] if up else None
        node = {"tag": tag, "begin": len(self.pieces), "article": article, "part": part, "block": None}
        if tag == "MainProvision":
            node["part"] = "Main"
            node["first"] = self.bare is None
            if node["first"]:
                self.bare, self.has_article = [], False
        elif tag == "SupplProvision":
            node["part"] = "Suppl" if "AmendLawNum" not in attrs else None
        elif tag == "Article":
            if any(n.get("first") for n in self.open):
                self.has_article = True
            node["block"] = node["article"] = {
                "number": attrs.get("Num"), "deleted": attrs.get("Delete") == "true", "caption": "", "paragraph": None, "sentence": "",
                "titles": [], "sentences": [], "lines": [],
            }
        inside = up is not None and (up["block"] is not None or tag == "Paragraph" and up.get("first"))
        if node["block"] is None and tag in BLOCKS and inside:
            node["block"] = {"titles": [], "sentences": [], "lines": []}
        if tag == "Paragraph" and article is not None and article["paragraph"] is None:
            article["paragraph"] = node
        self.open.append(node)

    def text(self, data: str) -> None:
        self.pieces.append(data)

    def end(self, tag: str) -> None:
        node = self.open.pop()
        up = self.open[-1] if self.open else None
        text = "".join(self.pieces[node["begin"] :]).strip()
        if tag == "LawNum" and self.law["law_num"] is None:
            self.law["law_num"] = text
        if tag == "LawTitle" and self.law["law_title"] is None:
            self.law["law_title"] = text
        article = node["article"]
        if tag == "ParagraphSentence" and article and article["sentence"] == "" and article["paragraph"] in self.open:
            article["sentence"] = text or None
        lines = self._lines(node["block"]) if node["block"] is not None else None
        if tag == "Article":
            self._close_article(node, lines)
        if up is None:
            return
        if up["block"] is not None:
            around = up["block"]
            if tag in TITLES:
                around["titles"].append(text)
                if tag == "ArticleCaption" and up["tag"] == "Article" and not around["caption"]:
                    around["caption"] = text
            elif tag in SENTENCES:
                around["sentences"].append(text)
            elif lines is not None and tag in BLOCKS:
                around["lines"] += [INDENT + x for x in lines]
            elif text:
                around["lines"].append(INDENT + text)
        elif up.get("first") and tag == "Paragraph":
            self.bare += [INDENT + x for x in lines]

    @staticmethod
    def _lines(block: dict) -> list[str]:
        heads = block["titles"] + block["sentences"]
        return ([INDENT.join(heads)] if heads else []) + block["lines"]

    def _close_article(self, node: dict, lines: list[str]) -> None:
        article, part = node["article"], node["part"]
        content = "\n".join(lines)
        # Below the first line, or in the only one.
        if part is None or article["deleted"] or content[content.find("\n") + 1 :].strip(BLANKS) == DELETED:
            return
        row = {
            "unique_anchor": f"{part}_Article_{article['number']}",
            "anchor": f"Mp-At_{article['number']}" if part == "Main" else None,
            "content": content,
            "article_summary": article["caption"] or article["sentence"] or "",
        }
        (self.main if part == "Main" else self.other).append(row)

    def rows(self) -> list[dict]:
        """Main provisions, then original (not amending) supplementary provisions."""
        found = list(self.main)
        if self.bare and not self.has_article and "\n".join(self.bare).strip(BLANKS) not in ("", DELETED):
            anchor, heading = MAIN_PROVISION
            found.append(
                {"unique_anchor": anchor, "anchor": None, "content": "\n".join([heading, *self.bare]), "article_summary": heading}
            )
        shared = {k: v for k, v in self.law.items()} | {k: self.law[k] or "" for k in ("law_num", "law_title")}
        return [shared | row for row in found + self.other]


def article_rows(content: bytes) -> list[dict]:
    """The rows of one law file; a file that is no XML raises."""
    reader = LawReader()
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = reader.start
    parser.EndElementHandler = reader.end
    parser.CharacterDataHandler = reader.text
    parser.Parse(content, True)
    return reader.rows()


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [field.split()[0] for field in PARSED.split(", ")]
    for batch in slices(batches, "content"):
        rows: list[dict] = []
        for path, content in zip(batch["path"], batch["content"]):
            law_id = os.path.splitext(os.path.basename(path))[0]
            try:
                found = article_rows(bytes(content))
                rows += [row | {"path": path, "law_id": law_id} for row in found]
            except Exception as exc:  # noqa: BLE001 - one bad file must not fail the run
                rows.append({"path": path, "error": f"{type(exc).__name__}: {exc}"})
        yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda d: d.notna(), None)


def parse_law_xml(files: DataFrame) -> DataFrame:
    """(path, content) to one row per article, or one row with ``error`` per bad file."""
    parsed = spread(files.select("path", "content")).mapInPandas(_parse, PARSED)
    year = F.when(F.col("xml_year").rlike(r"^\d+$"), F.col("xml_year").try_cast("int"))
    date = era_to_date(F.col("era"), F.col("xml_year"), F.col("xml_month"), F.col("xml_day"))
    return parsed.withColumn("year", F.coalesce(year, F.lit(0))).withColumn("promulgate_date", date)


def articles(parsed: DataFrame) -> DataFrame:
    """The 11 interchange columns."""
    return parsed.filter(F.col("error").isNull()).select(*[f.split()[0] for f in ARTICLE_FIELDS.split(", ")])


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull()).select("path", "error")


def read_law_xml(spark: SparkSession, path: str) -> DataFrame:
    """Parse every ``*.xml`` below a folder; split the result with ``articles`` and ``errors``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(path)
    return parse_law_xml(files)
