import ipaddress
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from ragmill import session
from ragmill.functions import text as t
from ragmill.functions.files import decode_bytes, decode_text
from ragmill.functions.html import page_text
from ragmill.operators import attachments, chunking
from ragmill.operators import scoring as s
from ragmill.operators.embedding import BatchRefused, embed_all, hashing_embedder
from ragmill.operators import ranking, storage
from ragmill.operators.ranking import ranked
from ragmill.sources import bronze, jsonl, lawxml, snapshots
from ragmill.streaming import tokens

LAW = """<?xml version="1.0" encoding="UTF-8"?>
<Law Era="Reiwa" Year="2" LawType="Act" PromulgateMonth="4" PromulgateDay="1"><LawNum>令和二年法律第九十九号</LawNum><LawBody>
<LawTitle>架空の港の管理に関する法律</LawTitle><MainProvision><Chapter>
<Article Num="7"><ArticleCaption>（灯台）</ArticleCaption><ArticleTitle>第七条</ArticleTitle><Paragraph Num="1"><ParagraphNum/>
<ParagraphSentence><Sentence>灯台は白く塗る。</Sentence></ParagraphSentence><Item Num="1"><ItemTitle>イ</ItemTitle><ItemSentence><Sentence>夜は光る</Sentence></ItemSentence></Item></Paragraph></Article>
<Article Num="8" Delete="true"><ArticleTitle>第八条</ArticleTitle></Article>
<Article Num="9:11"><ArticleTitle>第九条から第十一条まで</ArticleTitle><Paragraph><ParagraphSentence>削除</ParagraphSentence></Paragraph></Article>
</Chapter></MainProvision><SupplProvision><Article Num="2"><ArticleTitle>第二条</ArticleTitle><Paragraph><ParagraphSentence>春から始める。</ParagraphSentence></Paragraph></Article></SupplProvision>
<SupplProvision AmendLawNum="y"><Article Num="1"><ArticleTitle>書き換え</ArticleTitle></Article></SupplProvision></LawBody></Law>"""
BARE = "<Law><LawNum>n</LawNum><LawBody><LawTitle>t</LawTitle><MainProvision><Paragraph><ParagraphSentence>本文</ParagraphSentence></Paragraph></MainProvision></LawBody></Law>"


def test_law_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "1AC_20200401_x.xml").write_text(LAW, encoding="utf-8")
    (tmp_path / "2AC_20200401_x.xml").write_text(BARE, encoding="utf-8")
    (tmp_path / "bad.xml").write_text("<Law>", encoding="utf-8")
    parsed = lawxml.read_law_xml(spark, str(tmp_path))
    rows = {(r["law_id"], r["unique_anchor"]): r for r in lawxml.articles(parsed).collect()}
    assert set(rows) == {("1AC_20200401_x", "Main_Article_7"), ("1AC_20200401_x", "Suppl_Article_2"), ("2AC_20200401_x", "Main_Provision")}
    first = rows["1AC_20200401_x", "Main_Article_7"]
    assert first["content"] == "（灯台）　第七条\n　　灯台は白く塗る。\n　　イ　夜は光る"
    assert (first["anchor"], first["article_summary"], first["promulgate_date"], first["year"]) == ("Mp-At_7", "（灯台）", "2020-04-01", 2)
    assert rows["1AC_20200401_x", "Suppl_Article_2"]["article_summary"] == "春から始める。"
    bare = rows["2AC_20200401_x", "Main_Provision"]
    assert (bare["content"], bare["promulgate_date"]) == ("本則\n　本文", "0000-01-01")
    assert lawxml.errors(parsed).count() == 1


def test_jsonl_profile_rejects_malformed(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"law_id": "a", "anchor": "x"}\n\n{"law_id": \n', encoding="utf-8")
    with pytest.raises(ValueError):
        jsonl.profile_jsonl(spark, str(tmp_path))
    row = jsonl.profile_jsonl(spark, str(tmp_path), strict=False).first()
    assert (row["total"], row["laws"], row["anchored"], row["malformed"]) == (1, 1, 1, 1)


def test_snapshot_readers_skip_unfinished_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert snapshots.write_snapshot(spark.range(3), root) == 1
    assert snapshots.write_snapshot(spark.range(5), root) == 2
    (tmp_path / "t" / "v=00000003").mkdir()
    assert snapshots.read_snapshot(spark, root).count() == 5
    assert snapshots.read_snapshot(spark, root, 1).count() == 3


def test_bronze_files_read(spark, tmp_path):
    folder = tmp_path / "store" / "u1" / "x"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_bytes(b"abc")
    row = bronze.bronze_files(spark, str(tmp_path / "store")).first()
    assert (row["owner"], row["object_key"], row["filename"], row["byte_size"]) == ("u1", "u1/x/a.txt", "a.txt", 3)


def test_charsets(spark):
    text = "日本語テスト"
    assert decode_bytes(text.encode("shift_jis")) == text
    assert decode_bytes(text.encode("euc_jp")) == text
    stored = [text.encode("utf-8"), b"\xef\xbb\xbf" + text.encode("utf-8"), b"\xfe\xff" + text.encode("utf-16-be"), text.encode("shift_jis")]
    df = spark.createDataFrame([(b,) for b in stored], "b binary")
    assert [x[0] for x in df.select(decode_text(F.col("b"))).collect()] == [text] * 4


def test_pages():
    html = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>x</script></head><body><p>a <b>b</b></p><div>c<br>d</div><pre>\n  x\n    y\n</pre><p>&amp; e</p></body></html>"
    assert page_text(html) == "T\na b\nc\nd\n  x\n    y\n& e"


def test_headings():
    text = "# 章1\n本文A\n## 節1.1\n本文B\n# 章2\n本文C"
    assert list(chunking.split_headers(text)) == [("章1", "本文A"), ("章1 > 節1.1", "本文B"), ("章2", "本文C")]
    assert list(chunking.split_headers("# only")) == [(None, "# only")]


def test_chunks_keep_all_words_within_the_size():
    rng = random.Random(3)
    for _ in range(60):
        words = ["".join(rng.choices("abc。、", k=rng.randint(1, 40))) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", "\n", "\n\n", "　"]) for w in words)
        size, overlap = rng.choice([(30, 5), (50, 0), (80, 20)])
        chunks = [c for _, c in chunking.chunk_text(text, size, overlap)]
        assert all(c and len(c) <= size for c in chunks)
        letters = lambda x: [c for c in x if c in "abc"]
        if overlap == 0:
            assert sum(len(letters(c)) for c in chunks) == len(letters(text))
        else:
            assert sum(len(letters(c)) for c in chunks) >= len(letters(text))


def test_chunks_do_not_depend_on_partitions(spark):
    rows = [(i, f"# h{i}\n" + "word " * (i * 50)) for i in range(8)]
    df = spark.createDataFrame(rows, "document_id int, text string")
    a = sorted(map(tuple, chunking.chunk_documents(df.repartition(1)).collect()))
    assert a == sorted(map(tuple, chunking.chunk_documents(df.repartition(7)).collect()))
    by_doc = {}
    for row in a:
        by_doc.setdefault(row[0], []).append(row[1])
    assert all(v == list(range(len(v))) for v in by_doc.values())


def test_refused_batches_are_halved():
    calls = []

    def fussy(texts):
        calls.append(len(texts))
        if len(texts) > 2:
            raise BatchRefused
        return [[float(x)] for x in texts]

    assert embed_all([str(i) for i in range(7)], fussy) == [[float(i)] for i in range(7)]
    with pytest.raises(ValueError):
        embed_all(["a", "b"], lambda texts: [[0.0]])
    assert hashing_embedder(8)(["a b"]) == hashing_embedder(8)([" a  b "])


def test_a_document_without_chunks_shows_why(spark, tmp_path):
    rows = [(1, "one two"), (2, None), (3, " "), (4, "word " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en"), "n_chars": F.length("text")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = contract.queries()["chunk_and_embed"](spark, str(tmp_path)).collect()
    assert sorted((r["document_id"], r["chunk_index"], r["dims"], r["outcome"], r["reason"]) for r in found) == [
        (1, 0, 32, "ok", None), (2, None, None, "failed", "no_text"), (3, None, None, "ok", None), (4, None, None, "rejected", "too_many_chunks"),
    ]
    documents, chunks = chunking.chunk_and_embed(docs.withColumnRenamed("doc_id", "document_id"), hashing_embedder(4))
    assert sorted((r["document_id"], r["outcome"]) for r in documents.collect()) == [(1, "ok"), (2, "failed"), (3, "ok"), (4, "rejected")]
    assert [r["document_id"] for r in chunks.collect()] == [1]


@pytest.mark.parametrize("bad", [None, [], [float("nan"), 1.0], [1.0, float("inf")], [1.0, 2.0, 3.0]])
def test_what_is_no_vector_is_an_error(bad):
    with pytest.raises(ValueError):
        embed_all(["a", "b"], lambda texts: [[1.0, 0.5], bad])


def test_byte_tokens():
    assert t.decode_bytes_text("a<0xE3><0x80><0x80>b<0xFF><0xC3><0xA9>") == "a　b<0xFF>é"
    held, out = "", ""
    for chunk in ("x<0xE3><0x8", "0><0", "x80>y", "<0xE3>"):
        text, held = tokens.push(held, chunk)
        out += text
    assert out + t.decode_bytes_text(held) == "x　y<0xE3>"
    assert tokens.push("", "<0x41>" * 20)[1] == ""


def test_japanese_spaces(spark):
    df = spark.createDataFrame([("値 は 10 です",), ("AB cd",)], "t string")
    assert [x[0] for x in df.select(t.remove_japanese_spaces(F.col("t"))).collect()] == ["値は10です", "AB cd"]


def scores(spark, entries, labels):
    import math

    tok = spark.createDataFrame([(1, "q", a, math.log(p)) for a, p in entries], "request_id int, question string, token string, logprob double")
    lab = spark.createDataFrame([(1, "q", i, x) for i, x in enumerate(labels)], "request_id int, question string, pos int, label string")
    return s.score_candidates(tok, lab).first()


def test_scoring(spark):
    row = scores(spark, [("Ａ", 0.5), (" B", 0.25), ("**", 0.15), ("C", 0.1)], ["A", "B", "C"])
    assert row["probabilities"] == [0.588235, 0.294118, 0.117647]
    assert (row["top"], row["confidence"]) == ("A", 0.382353)
    row = scores(spark, [("ALSO", 0.9), ("Y", 0.05)], ["A", "Yes"])
    assert (row["probabilities"], row["top"]) == ([0.0, 1.0], "Yes")
    assert scores(spark, [("zzz", 0.9)], ["A", "B"])["error"] == "no_candidate"


def loop_budget(rows, max_chars, total, max_files, max_images):
    """The rule as a loop: newest message first, then positions in order."""
    out, left, images = {}, total, max_images
    for message in sorted({m for m, *_ in rows}, reverse=True):
        docs = 0
        for _, pos, image, ok, chars in sorted(r for r in rows if r[0] == message):
            if image:
                if images <= 0:
                    out[message, pos] = ("skipped_images", None)
                    continue
                images -= ok
                out[message, pos] = ("image" if ok else "failed", None)
                continue
            docs += 1
            if docs > max_files:
                out[message, pos] = ("skipped_files", None)
            elif left <= 0:
                out[message, pos] = ("skipped_budget", None)
            elif not ok:
                out[message, pos] = ("failed", None)
            else:
                kept = min(chars, max_chars, left)
                left -= kept
                out[message, pos] = ("included", kept) if kept else ("skipped_budget", None)
    return out


def test_budget_equals_the_loop(spark):
    rng = random.Random(11)
    limits = {"max_chars": 50, "total_chars": 120, "max_files": 2, "max_images": 2}
    data, want = [], {}
    for request in range(120):
        rows = [(m, p, rng.random() < 0.3, rng.random() < 0.7, rng.choice([0, 10, 49, 50, 51, 90])) for m in range(rng.randint(1, 4)) for p in range(rng.randint(0, 5))]
        data += [(request, *r) for r in rows]
        want |= {(request, *k): v for k, v in loop_budget(rows, 50, 120, 2, 2).items()}
    df = spark.createDataFrame(data, "request_id int, message int, pos int, is_image boolean, ok boolean, chars int")
    got = {(r["request_id"], r["message"], r["pos"]): (r["outcome"], r["kept_chars"]) for r in attachments.attachment_budget(df, limits).collect()}
    assert got == want


def test_running_sums_of_one_scope_with_equal_order_values(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(None if i % 50 == 0 else "hot", 7 if i % 3 else 8, i, rng.choice([None, 1, -2, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "scope string, v long, id int, x long").repartition(5)
    written = []
    keep = ranking.materialize
    monkeypatch.setattr(ranking, "materialize", lambda d: written.append(keep(d)) or written[-1])
    got = {r["id"]: (r["n"], r["s"]) for r in ranking.running(df, ["scope"], F.col("v"), ["id"], {"n": F.lit(1), "s": F.col("x")}, splits=9).collect()}
    for scope in (None, "hot"):
        n = s = 0
        for _, i, x in sorted((v, i, x) for k, v, i, x in rows if k == scope):
            assert got[i] == (n, s)
            n, s = n + 1, s + (x or 0)
    # Equal values of one scope are spread over the ranges by their ties.
    sizes = [r["count"] for r in written[0].groupBy("_range").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 1000
    assert ranking.running(df.limit(0), ["scope"], F.col("v"), ["id"], {"n": F.lit(1)}).count() == 0


def test_ranks_of_a_hot_scope(spark):
    rng = random.Random(2)
    rows = [(0 if i < 900 else i % 7, rng.randint(0, 40), i) for i in range(1200)]
    df = spark.createDataFrame(rows, "scope int, v long, id int")
    got = {r["id"]: r["rank"] for r in ranked(df, ["scope"], F.col("v"), ["id"], splits=8).collect()}
    for scope in range(7):
        ordered = sorted((v, i) for s_, v, i in rows if s_ == scope)
        assert [got[i] for _, i in ordered] == list(range(1, len(ordered) + 1))


def test_allow_list_of_any_size(spark):
    hosts = ["10.1.2.3", "10.1.2.4", "192.168.77.1", "container", "fd00::1", "10.255.0.1", "172.16.0.9"]
    apps = spark.createDataFrame([(i, f"http://{'[' + h + ']' if ':' in h else h}:80/x") for i, h in enumerate(hosts)], "id int, endpoint string")

    def verdicts(*entries):
        rows = spark.createDataFrame([(e,) for e in entries], "entry string")
        return {r["host"]: r["verdict"] == "private_allowed" for r in storage.endpoint_audit(apps, True, rows).collect()}

    assert set(verdicts().values()) == {False}
    got = verdicts("10.1.2.3/32", "192.168.0.0/17", "CONTAINER", "10.255.0.0/8x", "300.1.1.1/8", "10.0.0.0/33", "a/8", "172.16.0.0/", "/8")
    assert {h for h, ok in got.items() if ok} == {"10.1.2.3", "192.168.77.1", "container"}
    assert {h for h, ok in verdicts("0.0.0.0/0").items() if ok} == {h for h in hosts if h[0] == "1"}
    many = spark.range(100_000).selectExpr("concat('11.', id % 256, '.', (id div 256) % 256, '.', id % 7, '/', 20 + id % 13) as entry")
    many = many.unionByName(spark.createDataFrame([("10.1.2.0/30",)], "entry string"))
    got = storage.endpoint_audit(apps, True, many).filter("verdict = 'private_allowed'").collect()
    assert [r["host"] for r in got] == ["10.1.2.3"]


def test_hosts_meet_ranges_without_copies(spark):
    rng = random.Random(5)
    hosts = [f"10.{rng.randint(0, 2)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}" for _ in range(300)] + ["container", "1.2.3", "10.256.0.1"]
    entries = [f"10.{rng.randint(0, 2)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}/{b}" for b in (*range(15, 33), 24, 24, 32)] + [hosts[0], hosts[1] + "/32"]
    found = storage.listed_hosts(spark.createDataFrame([(h,) for h in hosts], "host string"), spark.createDataFrame([(e,) for e in entries], "entry string"))
    nets = [ipaddress.ip_network(e, strict=False) for e in entries]
    assert {r["host"] for r in found.collect()} == {h for h in hosts[:300] if any(ipaddress.ip_address(h) in n for n in nets)}
    # No row per host and length of a range.
    assert "inline(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_python_steps_work_in_slices():
    frames = [pd.DataFrame({"text": ["x" * session.SLICE_LENGTH, "a", None, "b"]}), pd.DataFrame({"text": []})]
    frames.append(pd.DataFrame({"text": ["c"] * (session.SLICE_ROWS + 1)}))
    parts = list(session.slices(iter(frames), "text"))
    assert [len(p) for p in parts] == [1, 3, session.SLICE_ROWS, 1]
    assert pd.concat(parts)["text"].tolist() == pd.concat(frames)["text"].tolist()


def test_short_pieces_are_packed_like_mixed_ones():
    words = " ".join(["abcd"] * 40)
    assert list(chunking.recursive_split(words, (" ", ""), 80, 20)) == [" ".join(["abcd"] * n) for n in (16, 16, 16)]
    assert list(chunking.recursive_split("", (" ", ""), 80, 20)) == []
    assert [p for _, p in chunking.split_headers(" # no\n# h\nb")] == ["# no", "b"]


def test_packed_runs_are_parts_of_the_text():
    rng = random.Random(5)
    for _ in range(300):
        pieces = ["x" * rng.randrange(0, 9) for _ in range(rng.randrange(1, 40))]
        text, (size, overlap) = ", ".join(pieces), rng.choice([(10, 0), (20, 6), (40, 15)])
        runs = list(chunking.merge_splits(pieces, ", ", size, overlap, text))
        assert runs == list(chunking.merge_splits(pieces, ", ", size, overlap)) and all(r in text for r in runs)
        assert all(len(r) <= size for r in runs) and text.startswith(runs[0]) and text.endswith(runs[-1])
