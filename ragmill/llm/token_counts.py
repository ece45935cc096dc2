"""Token counts of texts without encoding them: whole tokens first, merges for the rest.

A tokenizer cuts a text into pre-tokens and merges each of them on its own. ``prove`` asks the model once, on the driver,
which strings of the vocabulary come back as one token when they stand alone; a pre-token among these counts as one.
Only the others are merged, each of them once per task.

Where pre-tokens never hold white space, equal words have equal counts wherever they stand, so a task cuts texts at
blanks and looks at distinct words only. Texts of other tokenizers are cut into pre-tokens by the tokenizer itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.texts import column, offsets_of, slices, split_words

LIMIT = 2048
#: Words whose counts a task keeps, and their characters; longer words are counted anew wherever they stand.
KEPT_WORDS, KEPT_CHARS, LONGEST_KEPT = 400_000, 16 << 20, 200
#: Split patterns of public tokenizers that match no white space.
BLANK_FREE = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
#: Texts that show whether a piece model changes what it is given.
_PROBES = ("a", " a", "a  b ", "\t\n", "Ａﬁ", "éÉ", "​ 　x", "가가", "①½")


class JsonTokens:
    """Pre-tokens and merges of a ``.json`` file of the tokenizers library."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.by_word = self._blank_free(spec)
        self.normalise = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        cut = self.tokenizer.pre_tokenizer
        self.cut = (lambda text: [p for p, _ in cut.pre_tokenize_str(text)]) if cut else (lambda text: [text] if text else [])
        self.merged = self.tokenizer.model.tokenize

    def _blank_free(self, spec: dict) -> bool:
        """Do texts fall apart at blanks? Only steps that are known not to look over a blank count."""
        steps = spec["normalizer"] or {}
        kinds = [s["type"] for s in steps.get("normalizers", [steps] if steps else [])]
        blanks = [s for s in steps.get("normalizers", []) if s["type"] == "Replace"]
        cut = spec["pre_tokenizer"] or {}
        first, *rest = cut.get("pretokenizers", [cut])
        return (
            set(kinds) <= {"NFC", "Lowercase", "Replace"}
            and all(s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in blanks)
            and first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"]
            and first["pattern"].get("Regex") in BLANK_FREE
            and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in rest)
            and not any(c.isspace() for t in self.added for c in t)
        )

    def candidates(self) -> Iterator[str]:
        for piece in self.tokenizer.get_vocab(with_added_tokens=False):
            yield piece.removesuffix(self.suffix) if self.suffix else piece

    def alone(self, piece: str) -> bool:
        return len(self.merged(piece)) == 1

    def words(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        return split_words(texts)

    def count(self, text: str, whole: frozenset[str]) -> int:
        plain = self.normalise(text)
        if any(t in text or t in plain for t in self.added):
            # Added tokens are cut out before anything else; the tokenizer knows how.
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(1 if p in whole else len(self.merged(p)) for p in self.cut(plain))


class PieceTokens:
    """Pieces of a ``.model`` file of the sentencepiece library; a pre-token is a run of blanks and what follows
    up to the next one, the blank that the model puts before every text included."""

    BLANK = "▁"

    def __init__(self, path: str):
        import re

        import sentencepiece

        self.segment = re.compile(" +[^ ]*").findall
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [p for p in pieces if p.startswith(self.BLANK) and len(p) > 1]
        # Pieces hold blanks at their start only, and texts come back as they were given.
        self.by_word = not any(self.BLANK in p.lstrip(self.BLANK) for p in pieces) and all(
            self.model.decode(self.model.encode(t)) == t for t in _PROBES
        )

    def candidates(self) -> Iterator[str]:
        return (p[1:] for p in self.pieces)

    def alone(self, piece: str) -> bool:
        return len(self.model.encode(piece)) == 1

    def words(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        parts = [self.segment(" " + t.replace(self.BLANK, " ")) if t else [] for t in texts.to_pylist()]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = pa.array([s[1:] for own in parts for s in own], pa.string()).dictionary_encode()
        return flat.indices.to_numpy(zero_copy_only=False), flat.dictionary, sizes

    def count(self, text: str, whole: frozenset[str]) -> int:
        if self.by_word and (not text or text in whole):
            return 1  # a blank with nothing behind it is a piece
        return len(self.model.encode(text))


def tokens_of(path: str) -> JsonTokens | PieceTokens:
    return PieceTokens(path) if path.endswith(".model") else JsonTokens(path)


def prove(path: str) -> frozenset[str]:
    """The strings that encode alone as one token, each of them tried; as many as the vocabulary has at most."""
    tokens = tokens_of(path)
    if isinstance(tokens, PieceTokens) and not tokens.by_word:
        return frozenset()
    return frozenset(p for p in tokens.candidates() if tokens.alone(p))


class Counter:
    """Counts of texts, slice by slice."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokens, self.whole = tokens_of(path), whole
        self.known: dict[str, int] = {}
        self.chars = 0

    def _number(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.tokens.count(word, self.whole)
            if len(word) <= LONGEST_KEPT:
                if len(self.known) >= KEPT_WORDS or self.chars >= KEPT_CHARS:
                    self.known, self.chars = {}, 0
                self.known[word] = n
                self.chars += len(word)
        return n

    def counts(self, texts: pa.Array) -> np.ndarray:
        if not self.tokens.by_word:
            return np.array([self.tokens.count(t, self.whole) if t else 0 for t in texts.to_pylist()], np.int64)
        codes, words, sizes = self.tokens.words(texts)
        own = np.fromiter(map(self._number, words.to_pylist()), np.int64, len(words))
        run = np.concatenate([[0], np.cumsum(own[codes])]) if len(codes) else np.zeros(1, np.int64)
        at = offsets_of(sizes)
        return run[at[1:]] - run[at[:-1]]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text).

    ``n_tokens`` is what the library of ``path`` (tokenizers for .json, sentencepiece for .model) gives without begin
    and end tokens. Null and empty texts have no bytes and no tokens; texts of any length are counted whole, and one task
    counts one text. Rows that share an id or a text each have their own row, null ids stay null, an empty table gives an
    empty one. Other columns of ``docs`` are not read, whatever their names are.
    """
    whole = docs.sparkSession.sparkContext.broadcast(prove(path))  # the vocabulary bounds its size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, whole.value)
        for batch in batches:
            for part in slices(batch, "text"):
                n = counter.counts(column(part, "text"))
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), pc.cast(column(part, "n_bytes"), pa.int64()), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    )
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
