import random
import re

import pytest
from pyspark.sql import functions as F

from ragmill.functions import names as n
from ragmill.functions import report as r
from ragmill.operators import names as o
from ragmill.operators import reports as rep
from ragmill.operators import retrieval


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{x} string" for x in names)).select(column).first()[0]


def test_identifiers(spark):
    cases = {
        "防災庁設置法": "防災庁", "民法": "民法", "労働基準法施行規則": "労働基準", "個人情報の保護に関する法律": "個人情報の保護",
        "大正三年法律第三十七号（公共団体ノ管理スル公共用土地物件ノ使用ニ関スル法律）": "公共団体ノ管理スル公共用土地物件ノ使用ニ関スル",
        "会社法（平成十七年法律第八十六号）": "会社", "　民 法 ": "民法",
    }
    df = spark.createDataFrame(list(cases.items()), "name string, want string")
    for row in df.select("name", "want", n.identifier(F.col("name")).alias("got")).collect():
        assert row["got"] == row["want"], row


def test_keys_do_not_accept_containment(spark):
    df = spark.createDataFrame([("会社法", "会社更生法"), ("個人情報保護法", "個人情報の保護に関する法律")], "a string, b string")
    got = [x[0] for x in df.select(n.name_key(F.col("a")) == n.name_key(F.col("b"))).collect()]
    assert got == [False, True]


def test_spoken_names_are_not_cut_out_of_words(spark):
    text = "業務方法書と労働基準法の違い、移民法"
    assert one(spark, n.names_in_query(F.col("c0")), text) == ["労働基準法"]
    spans = one(spark, n.name_spans(F.col("c0")), text)
    assert [(s["name"], text[s["start"] : s["end"]]) for s in spans] == [("労働基準法", "労働基準法")]


def titles(spark, text, *names):
    master = o.title_dictionary(spark.createDataFrame([(f"L{i}", t) for i, t in enumerate(names)], "law_num string, law_title string"))
    texts = spark.createDataFrame([(1, text)], "query_id int, text string")
    return [(x["law_title"], x["start"], x["end"]) for x in o.titles_in_text(texts, master).orderBy("start").collect()]


def test_titles_longest_first_and_not_inside_words(spark):
    assert titles(spark, "民法施行法と移民法と会社法", "民法", "民法施行法", "会社法") == [("民法施行法", 0, 5), ("会社法", 10, 13)]
    assert titles(spark, "この民法と 会社法", "民法", "会社法") == [("民法", 2, 4), ("会社法", 5, 8)]
    assert titles(spark, "憲と民法", "憲", "民法") == [("憲", 0, 1), ("民法", 2, 4)]
    assert titles(spark, "", "民法") == titles(spark, "民法") == []


def plain_titles(text, names):
    """Every title at every place, longest first."""
    text, before = text.replace(" ", ""), "[一-龥ァ-ヴー々]"
    spans = [
        (i, i + len(t), t) for i in range(len(text)) for t in set(names)
        if t and text.startswith(t, i) and not (i and re.match(before, text[i - 1]))
    ]
    taken = []
    for s, e, t in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        if all(e <= a or b <= s for a, b, _ in taken):
            taken.append((s, e, t))
    return [(t, s, e) for s, e, t in sorted(taken)]


@pytest.mark.parametrize("sent", [None, -1])
def test_titles_that_begin_alike_and_long_texts(spark, monkeypatch, sent):
    if sent is not None:
        monkeypatch.setattr(o, "DICTIONARY_BYTES", sent)
    rng = random.Random(1)
    common = "このたびさだめるいちばんながいきそくの"
    names = [common + "".join(rng.choice("あいう😀法") for _ in range(rng.randrange(1, 9))) for _ in range(120)] + ["あ", "いう", "法", common[:16]]
    pieces = [*names, "、", "あ", "漢", "ー", "x y", "😀", common]
    text = "".join(rng.choice(pieces) for _ in range(400))
    assert titles(spark, text, *names) == plain_titles(text, names)
    assert titles(spark, "あ" * 1000, "ああ", "あああ") == [("あああ", 3 * i, 3 * i + 3) for i in range(333)]


@pytest.mark.parametrize("rows", [0, 60, 1000])
def test_a_large_dictionary_is_not_sent_but_its_endings_are(spark, monkeypatch, rows):
    """None, some and all of the sizes of titles have few beginnings and endings."""
    monkeypatch.setattr(o, "DICTIONARY_ROWS", rows)
    rng = random.Random(5)
    common = "さだめるいちばんながいきそくのだいご"
    names = [common + "".join(rng.choice("一二三四五") for _ in range(rng.randrange(3, 6))) + "法" for _ in range(150)]
    names += [f"{a}{b}法" for a in "港湾灯台船" for b in "港湾灯台船"]
    text = "".join(rng.choice([*names, "、", "と", common]) + "の" for _ in range(120))
    master = o.title_dictionary(spark.createDataFrame([(f"L{i}", t) for i, t in enumerate(names)], "law_num string, law_title string"))
    found = o.titles_in_text(spark.createDataFrame([(1, text)], "query_id int, text string"), master)
    assert [(x["law_title"], x["start"], x["end"]) for x in found.orderBy("start").collect()] == plain_titles(text, names)
    monkeypatch.setattr(o, "plan_bytes", lambda df: 0)  # however few bytes it takes in a file
    plan = o.titles_in_text(spark.createDataFrame([(1, text)], "query_id int, text string"), master)._jdf.queryExecution().optimizedPlan().toString()
    sent = [line for line in plan.split("\n") if "Join Inner" in line and "tail" in line]
    assert sent and all(("broadcast" in line) == (rows == 1000) for line in sent)


def resolve(spark, text, law_names, spoken, laws, candidates=()):
    master = o.title_dictionary(spark.createDataFrame([(k, t) for k, t, _ in laws], "law_num string, law_title string"))
    status = spark.createDataFrame([(k, v) for k, _, v in laws], "law_num string, verdict string")
    q = spark.createDataFrame([(1, text, law_names, spoken)], "query_id int, text string, law_names array<string>, spoken array<string>")
    c = spark.createDataFrame([(1, k, t) for k, t in candidates] or [], "query_id int, law_num string, law_title string")
    return sorted((x["verdict"], x["stage"], x["law_num"]) for x in o.resolve(q, master, status, c).collect())


LAWS = [("L1", "民法", "current"), ("L2", "防災庁設置法", "pending"), ("L3", "会社更生法", "current")]


def test_resolution_stages(spark):
    assert resolve(spark, "x", ["民法"], [], LAWS) == [("current", "2-0", "L1")]
    assert resolve(spark, "x", ["防災庁法"], [], LAWS) == [("pending", "2-2", "L2")]
    assert resolve(spark, "x", ["民法", "防災庁設置法"], [], LAWS) == [("current", "2-0", "L1")]
    assert resolve(spark, "x", ["民法"], ["人工知能人格権法"], LAWS) == [("none", "2-Q", None)]
    assert resolve(spark, "防災庁はもう設置されていますか", [], [], LAWS, [("L2", "防災庁設置法"), ("L3", "会社更生法")]) == [("pending", "2-3", "L2")]
    # A law without a status is pending without being one of the laws.
    assert resolve(spark, "x", ["民法"], [], [("L1", "民法", None)]) == [("pending", "2-0", None)]
    assert resolve(spark, "x", ["民法", "会社更生法"], [], [("L1", "民法", None), ("L3", "会社更生法", "pending")]) == [("pending", "2-0", "L3")]
    assert resolve(spark, "宇宙移民法の要件は", [], [], LAWS, [("L1", "民法")]) == [("none", "2-3", None)]


def test_aliases_file(spark, tmp_path):
    good = tmp_path / "a.json"
    good.write_text('{"景品 表示法": " 不当景品類及び不当表示防止法 ", "x": 5, "y": ""}', encoding="utf-8")
    assert o.load_aliases(spark, str(good)) == {"景品表示法": "不当景品類及び不当表示防止法"}
    bad = tmp_path / "b.json"
    bad.write_text("[1, 2", encoding="utf-8")
    assert o.load_aliases(spark, str(bad)) == {}
    assert o.load_aliases(spark, str(tmp_path / "none.json")) == {}


def test_parse_names(spark):
    cases = {
        '{"law_names": ["民法", "民法", " 刑法 "]}': ["民法", "刑法"], '```json\n{"law_names": ["民法"]}\n```': ["民法"],
        'はい {"law_names": ["会社法"]} です': ["会社法"], "関連するのは労働基準法です。": ["関連するのは労働基準法です"],
        "": [], '{"law_names": []}': [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for row in df.select("t", r.parse_names(F.col("t")).alias("n")).collect():
        assert row["n"] == cases[row["t"]], row


def test_selection_takes_pure_numbers(spark):
    df = spark.createDataFrame([("1, 4、7.", 10), ("8. 民法", 12), ("- 3\n* 2", 5), ("99", 3)], "t string, n int")
    assert [x[0] for x in df.select(r.parse_selection(F.col("t"), F.col("n"))).collect()] == [[1, 4, 7], list(range(1, 11)), [3, 2], [1, 2, 3]]


def test_links_skip_diagrams():
    urls = {1: "u1", 2: "u2"}
    assert r.linked("a [1] b [1, 3]", urls) == "a [[1]](u1) b [[1]](u1) [3]"
    assert r.linked("```mermaid\nA[1] --> B\n```\n[2]", urls) == "```mermaid\nA[1] --> B\n```\n[[2]](u2)"


def test_diagram_labels_are_escaped():
    text = '```mermaid\nA["x & y"] --> B(第1条・\'a\')\n  C   D \n```'
    assert r.sanitized_diagrams(text) == "```mermaid\nA[“x ＆ y“] --> B(第1条/‘a‘)\nC D\n```"


def test_preamble_and_reasoning(spark):
    assert one(spark, r.strip_preamble(F.col("c0")), "<think>a\nb</think>hello\n# T\nx") == "# T\nx"
    assert one(spark, r.strip_preamble(F.col("c0")), "  plain 　") == "plain"


def test_summaries_give_their_place_to_full_articles(spark):
    columns = "query_id int, part int, rank long, law_num string, law_id string, law_title string, unique_anchor string, content string, article_summary string, is_future boolean"
    final = spark.createDataFrame(
        [(1, 0, 0, "A", "A_1", "a", "Main_Article_1", "short", "s", False), (1, 1, 2, "B", "B_1", "b", "Main_Article_9", "other", "s", False)], columns
    )
    summaries = final.filter("rank = 0").unionByName(final.filter("rank = 0").withColumn("law_num", F.lit("B")).withColumn("rank", F.lit(5).cast("long")))
    laws = spark.createDataFrame([(1, "A", False), (1, "B", False)], "query_id int, law_num string, pending boolean")
    article = spark.createDataFrame(
        [("1", "A", "A_1", "a", "Main_Article_1", "full of A", "h", False), ("2", "B", "B_1", "b", "Main_Article_1", "full of B", "h", False),
         ("3", "B", "B_2", "b", "Main_Article_1", "not yet", "h", True)],
        "id string, law_num string, law_id string, law_title string, unique_anchor string, content string, article_summary string, is_future boolean",
    )
    got = rep._summaries_upgraded(final, summaries, laws, article, False).orderBy("part").collect()
    assert [(x["law_num"], x["content"], x["rank"]) for x in got] == [("B", "full of B", 0), ("B", "other", 2)]
    assert rep._summaries_upgraded(final, summaries.limit(0), laws, article, False).filter("content = 'short'").count() == 1


def test_names_without_a_vector_fall_back_to_broad_words(spark):
    vectors = "query_id string, name string, embedding array<double>"
    names = spark.createDataFrame([("a\x1fb", "x\x1fy", [1.0, 0.0]), ("a\x1fb", "z", None), ("c", "w", None)], vectors)
    master = spark.createDataFrame([("L1", [1.0, 0.1]), ("L2", [0.0, 1.0])], "id string, embedding array<double>")
    broad = spark.createDataFrame([("法律", [0.1, 1.0]), ("規則", None)], "name string, embedding array<double>")
    got = {(x["query_id"], x["name"], x["id"]) for x in retrieval.nearest_law_per_name(names, master, broad).collect()}
    assert got == {("a\x1fb", "x\x1fy", "L1"), ("c", "法律", "L2")}
    asked = spark.createDataFrame([(1, ["one"]), (2, []), (3, [])], "query_id int, law_names array<string>")
    queries = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 2.0]), (3, None)], "query_id int, embedding array<double>")
    titles = master.withColumnRenamed("id", "law_num")
    laws = rep.nearest_laws(asked, queries, titles, lambda texts: [[1.0, 0.0] for _ in texts]).collect()
    assert sorted((x["query_id"], x["verdict"], x["law_num"]) for x in laws if x["law_num"]) == [(1, "current", "L1"), (2, "current", "L2")]
    assert [x["verdict"] for x in laws if x["query_id"] == 3] == ["unidentified"]
    with pytest.raises(ValueError, match="broad"):
        many = spark.range(retrieval.MAX_BROAD + 1).selectExpr("cast(id as string) as name", "array(1D, 0D) as embedding")
        retrieval.nearest_law_per_name(names, master, many)


@pytest.mark.parametrize("heavy", [0, 1, 3, 10**6])
def test_the_nearest_title_by_grams_whatever_is_frequent(spark, heavy):
    rng = random.Random(heavy)
    word = lambda: "特定" + "".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randrange(0, 5))) + rng.choice(["法", "施行令"])
    titles = [(f"L{i:03d}", word()) for i in range(60)] + [("L900", "x"), ("L901", "")]
    names = [(i, word()) for i in range(40)] + [(1, "特定甲法"), (2, "none"), (3, ""), (4, None)]

    def grams(text):
        bare = re.sub("[をにはがのもとでやへからまで等]", "", text or "")
        return {bare[i : i + 2] for i in range(len(bare) - 1)}

    want = []
    for q, name in set(names):
        a = grams(name)
        sims = [(-len(a & grams(t)) / len(a | grams(t)), k, t) for k, t in titles if a & grams(t)]
        if sims:
            s, k, t = min(sims)
            want.append((q, name, k, t, round(-s, 9)))
    found = o.nearest_by_grams(
        spark.createDataFrame(names, "query_id int, name string"), spark.createDataFrame(titles, "law_num string, law_title string"), heavy
    )
    assert sorted((x["query_id"], x["name"], x["law_num"], x["law_title"], round(x["sim"], 9)) for x in found.collect()) == sorted(want)


def test_alike_names_meet_titles_without_a_row_per_pair(spark, monkeypatch):
    n, met = 700, []
    titles = spark.range(n).selectExpr("concat('L', lpad(id, 5, '0')) as law_num", "concat('特', translate(id, '0123456789', '零壱弐参四伍六七八九'), '法') as law_title")
    names = titles.selectExpr("cast(substr(law_num, 2) as int) as query_id", "law_title as name")
    jaccard = o.set_jaccard

    def counted(a, b):
        met.append(spark.sparkContext.accumulator(0))
        seen = met[-1]
        count = F.udf(lambda: seen.add(1), "string").asNondeterministic()
        return jaccard(a, b) + F.when(count().isNotNull(), 1.0).otherwise(0.0)

    monkeypatch.setattr(o, "set_jaccard", counted)
    found = {r["query_id"]: (r["law_num"], r["sim"]) for r in o.nearest_by_grams(names, titles, 5).collect()}
    assert len(found) == n and all(sim == 1.0 for _, sim in found.values())
    assert found[123][0] == "L00123"
    assert sum(c.value for c in met) < 20 * n  # of 490,000 pairs, all of which share a 2-gram


def test_weak_matches_compute_every_gram_once(spark):
    names, titles = F.array(F.lit("港湾管理法"), F.lit("")), F.array(F.lit("港湾法"), F.lit("港湾管理令"), F.lit("港湾管理令"))
    rows = spark.range(1).select(o.weak_matches(names, titles, 0.7).alias("weak"), o.best_match(F.col("id").cast("string"), titles).alias("best"))
    row = rows.first()
    assert [(m["name"], m["best"], round(m["sim"], 6)) for m in row["weak"]] == [("港湾管理法", "港湾管理令", 0.6), ("", "港湾法", 0.0)]
    assert (row["best"]["best"], row["best"]["sim"]) == ("港湾法", 0.0)
    # Each of the two expressions has the 2-grams of names and of titles in one place.
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") <= 4
