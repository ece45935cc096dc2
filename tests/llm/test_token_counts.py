import random

import pyarrow as pa
import public_tokenizers
import pytest

from ragmill.llm import token_counts
from ragmill.tables import table

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")
ODD = [
    "", None, " ", "  a  b ", "\t\n", "<|endoftext|>x", "a<|startoftext|> b", "<|EndOfText|>", "<s> </s> <unk> <0x41>", "́a ̈b",
    "\0a\0 b", "x" * 5000, "▁a ▁▁", "don't I'LL 'sx", "ΑΣ Σς İstanbul ǅ", "a\x0bb\x0cc\x1cd\x85e\xa0f　g", "中文 한국어 हिन्दी", "😀‍👍 ½ ３", "é é",
]


def library(path, texts):
    texts = [t or "" for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_counts_are_the_librarys(name):
    path = public_tokenizers.path(name)
    rng = random.Random(3)
    signs = "ab Zİß 's 'll\t\x0b\x0c\x1c\x85\xa0　é̈<|endoftext|>中文한국ΑΣς12３½‍😀\n  ..!▁"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(1500)]
    counter = token_counts.Counter(path, token_counts.prove(path))
    assert counter.counts(pa.array(texts, pa.string())).tolist() == library(path, texts)


@pytest.mark.parametrize("name", FILES)
def test_proven_strings_are_single_tokens(name):
    path = public_tokenizers.path(name)
    whole = token_counts.prove(path)
    tokens = token_counts.tokens_of(path)
    assert len(whole) > 10_000 and all(tokens.alone(p) for p in whole)
    if name.startswith("word"):  # the pre-tokens of plain words are the words themselves
        some = sorted(p for p in whole if p.isascii() and p.isalpha())[::50]
        assert library(path, some) == [1] * len(some)


def test_small_caches_change_nothing(monkeypatch):
    path = public_tokenizers.path(FILES[0])
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 5)
    counter = token_counts.Counter(path, frozenset())  # nothing proven: everything is merged
    assert counter.counts(pa.array(ODD, pa.string())).tolist() == library(path, ODD)
    assert len(counter.known) <= 5


def test_whole_table(spark):
    path = public_tokenizers.path(FILES[0])
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.collect()
    want = dict(zip((r["doc_id"] for r in rows), library(path, [r["text"] for r in rows]), strict=True))
    got = token_counts.count_tokens(docs, path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(rows)
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got) and any(r["over_limit"] for r in got)


def test_odd_rows_repeats_and_clashing_names(spark, frame):
    path = public_tokenizers.path(FILES[0])
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "other"), (3, "other"), (None, "a b"), (None, None)]
    docs = frame(rows).selectExpr("*", "7 as n_tokens", "'x' as N_Bytes", "true as over_limit")
    got = token_counts.count_tokens(docs, path).collect()
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, library(path, [t for _, t in rows]), strict=True)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert token_counts.count_tokens(frame([]), path).collect() == []
