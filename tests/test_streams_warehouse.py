import time
from datetime import date

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ragmill.functions import dates
from ragmill.functions.text import decode_bytes_text
from ragmill.operators import apps, paging, storage
from ragmill.sources import snapshots
from ragmill.operators import warehouse as w
from ragmill.streaming import intake, jobs, run, tokens
from ragmill.operators.embedding import hashing_embedder


def test_job_state_over_several_batches_and_a_restart(spark, tmp_path):
    events = [
        ("a", 1, "queued", None), ("a", 2, "started", None), ("a", 3, "retry", None), ("a", 4, "started", None),
        ("a", 5, "completed", "x"), ("a", 6, "failed", "late"), ("b", 1, "queued", None), ("c", 2, "failed", "boom"), ("c", 1, "started", None),
    ]
    df = spark.createDataFrame(events, "job string, seq long, outcome string, detail string")
    for i, part in enumerate(events):
        df.filter((F.col("job") == part[0]) & (F.col("seq") == part[1])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 4:
            stream = run.file_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema, 1)
            run.append_log(jobs.job_changes(stream), str(tmp_path / "out"))
    stream = run.file_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema, 1)
    log = run.append_log(jobs.job_changes(stream), str(tmp_path / "out"))
    got = {r["job"]: (r["status"], r["seq"], r["attempts"], r["detail"]) for r in jobs.current(log).collect()}
    want = {r["job"]: (r["status"], r["seq"], r["attempts"], r["detail"]) for r in jobs.job_state(df).collect()}
    # What comes after the end was reported is no attempt any more; the table as one batch counts it.
    assert got == want | {"c": ("FAILED", 2, 0, "boom")}
    assert got["a"][:2] == ("COMPLETED", 5) and got["b"][0] == "QUEUED" and want["c"] == ("FAILED", 2, 1, "boom")


def test_chunks_of_a_stream_keep_their_held_tail_between_batches(spark, tmp_path):
    rows = [("s", 0, "x<0xE3><0x8", False), ("s", 1, "0><0x", False), ("s", 2, "80>y<0xE3>", True)]
    for row in rows:
        spark.createDataFrame([row], "stream_id string, seq long, chunk string, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        schema = spark.read.parquet(str(tmp_path / "in")).schema
        stream = run.file_stream(spark, str(tmp_path / "in"), "*.parquet", schema)
        log = run.append_log(tokens.decode_stream(stream), str(tmp_path / "out"))
    assert "".join(r["text"] for r in log.orderBy("seq").collect()) == "x　y<0xE3>"


def test_new_groups_of_jobs_ask_the_store_once():
    class States(dict):
        asked = 0

        def exists(self):
            return bool(self)

        def getValue(self, key):
            self.asked += 1
            return self.get(key)

        updateValue = dict.__setitem__

    states, state = States(), jobs.JobState()
    state.init(type("Handle", (), {"getMapState": lambda *_: states})())
    rows = [Row(job=f"j{i % 50}", seq=i, outcome="started", detail=None) for i in range(200)]
    first = list(state.handleInputRows((0,), iter(rows), None))
    assert len(first) == len(states) == 50 and states.asked == 0
    then = list(state.handleInputRows((0,), iter([Row(job="j1", seq=999, outcome="failed", detail="x"), Row(job="new", seq=1, outcome="started", detail=None)]), None))
    assert [(r.job, r.status, r.attempts, r.version) for r in then] == [("j1", "FAILED", 4, 2), ("new", "IN_PROGRESS", 1, 1)] and states.asked == 2


def test_a_finished_job_stays_finished(spark, tmp_path):
    for row in (("a", 5, "completed", "x"), ("a", 3, "failed", "earlier"), ("a", 9, "started", None)):
        df = spark.createDataFrame([row], "job string, seq long, outcome string, detail string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = run.file_stream(spark, str(tmp_path / "in"), "*.parquet", df.schema)
        log = run.append_log(jobs.job_changes(stream), str(tmp_path / "out"))
    assert [tuple(r) for r in log.collect()] == [("a", "COMPLETED", 5, 0, "x", 1)]


@pytest.mark.parametrize("front", ["", "x" * 100, "y<0x41>" * 30])
def test_byte_tokens_may_be_cut_anywhere(front):
    text = front + "<0xE3><0x81><0x82> é <0xF0><0x9F><0x99><0x82><0xE3><0x81><0x84>z<0xFF><0xE3> <0x"
    want = decode_bytes_text(text)
    for a in range(len(front), len(text) + 1):
        for b in (a, min(a + 1, len(text)), min(a + 7, len(text)), len(text)):
            one, held = tokens.push("", text[:a])
            two, held = tokens.push(held, text[a:b])
            three, held = tokens.push(held, text[b:])
            assert one + two + three + decode_bytes_text(held) == want, (a, b)
            assert len(held) <= 3 * 6 + 5


def test_intake_takes_each_file_once(spark, tmp_path):
    schema = "object_key string, content binary"
    for i, (name, body) in enumerate((("a.html", b"<p>hello</p>"), ("b.txt", b"text"), ("c.pdf", b"%PDF"), ("d.txt", b"%PDF-1"))):
        spark.createDataFrame([(f"u/{i}/{name}", body)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = run.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.read.parquet(str(tmp_path / "in")).schema)
        log = run.append_log(intake.continuous_ingest(stream, hashing_embedder(4)), str(tmp_path / "out"))
    assert sorted((r["document_id"], r["chunk_text"], r["outcome"], r["reason"]) for r in log.collect()) == [
        ("u/0/a.html", "hello", "ok", None), ("u/1/b.txt", "text", "ok", None),
        ("u/2/c.pdf", None, "failed", "error"), ("u/3/d.txt", None, "rejected", "content_mismatch"),
    ]


def test_backoff_steps(spark):
    df = spark.createDataFrame([(n,) for n in (0, 240, 241, 480, 481, 720, 721)], "n int")
    assert [r[0] for r in df.select(jobs.backoff(F.col("n"))).collect()] == [30, 30, 60, 60, 300, 300, 900]


VERSIONS = "law_id string, law_num string, law_title string, unique_anchor string, content string, enforce_date date"


def versions(spark):
    rows = [
        ("x_20200101_1", "x", "t", "A1", "old", date(2020, 1, 1)), ("x_20220101_1", "x", "t", "A1", "new", date(2022, 1, 1)),
        ("x_20990101_1", "x", "t", "A1", "later", date(2099, 1, 1)), ("x_bad_1", "x", "t", "A1", "undated", None),
        ("x_20990101_1", "x", "t", "A2", "future", date(2099, 1, 1)), ("x_20220101_1", "x", "t", "A3", "Title\n　削除 ", date(2022, 1, 1)),
        ("x_20220101_1", "x", "t", "Main_Provision", "本則\n　 ", date(2022, 1, 1)),
    ]
    return spark.createDataFrame(rows, VERSIONS)


def test_index_picks_the_version_in_force(spark):
    index = {r["unique_anchor"]: (r["content"], r["is_future"]) for r in w.search_index(versions(spark), "2024-01-01").collect()}
    assert index == {"A1": ("new", False), "A2": ("future", True)}


def test_as_of(spark):
    keys = versions(spark).select("law_num", "unique_anchor").distinct()
    row = {r["unique_anchor"]: r for r in w.resolve_as_of(keys, versions(spark), "2021-06-01", "2024-01-01").collect()}
    assert set(row) == {"A1"}
    assert (row["A1"]["content"], row["A1"]["next_enforce_date"], row["A1"]["is_future"]) == ("old", date(2022, 1, 1), False)


def test_dates(spark):
    df = spark.createDataFrame([("a_20260102_x",), ("a_20261399_x",), ("a_2026_x",), ("a",)], "i string")
    assert [r[0] for r in df.select(dates.enforce_date(F.col("i"))).collect()] == [date(2026, 1, 2), None, None, None]


def test_keyset_pages_meet_the_end(spark):
    df = spark.range(25).select(F.col("id"), (F.col("id") % 5).alias("t"))
    seen, cursor = [], None
    while True:
        rows = paging.keyset_page(df, "t", "id", cursor, 10).collect()
        seen += [r["id"] for r in rows]
        if rows[-1]["next_cursor"] is None:
            break
        cursor = (rows[-1]["t"], rows[-1]["id"])
    assert sorted(seen) == list(range(25)) and len(seen) == 25


def test_foreign_markers_stay(spark):
    rows = [("t", "a", "u", '{"__inputsRef":"s3://b/inputs/t/a/other/00000000-0000-0000-0000-000000000000.json"}'), ("t", "a", "u", '{"__inputsRef":"s3://b/inputs/t/a/u/../x.json"}')]
    df = spark.createDataFrame(rows, "team_id string, app_id string, user_id string, inputs string")
    side = spark.createDataFrame([("inputs/t/a/other/00000000-0000-0000-0000-000000000000.json", "secret")], "object_key string, payload string")
    assert [r["inputs"] for r in storage.rehydrate(df, side, "b").collect()] == [r[3] for r in rows]


def test_private_addresses(spark):
    hosts = {"127.0.0.1": True, "172.31.0.1": True, "172.32.0.1": False, "8.8.8.8": False, "db": True, "a.localhost": True, "fd00::1": True, "example.com": False, "300.1.1.1": False}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r["h"]: r["p"] for r in df.select("h", storage.is_private(F.col("h")).alias("p")).collect()} == hosts


def test_unknown_status_is_a_draft(spark):
    df = spark.createDataFrame([('{"status":"x","copyable":true}',), ("nonsense",), (None,)], "c string")
    got = [r[0] for r in df.select(apps.unpack_config(F.col("c"))).collect()]
    assert [(g["status"], g["copyable"], g["endpoint"]) for g in got] == [("draft", True, ""), ("draft", False, ""), ("draft", False, "")]


def test_a_load_rewrites_only_the_ranges_of_its_keys(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = [(f"L{i:05d}", "a", f"text {i}", 1, None) for i in range(4000)] + [(None, "a", "no key", 1, None)]
    columns = "law_id string, unique_anchor string, content string, load_timestamp int, enforce_date date"
    snapshots.write_buckets(spark.createDataFrame(rows, columns), root, "law_id", 100)
    assert len(snapshots._manifest(spark, root)) == 100

    def load(changed):
        source = spark.createDataFrame([(k, "a", t) for k, t in changed], "law_id string, unique_anchor string, content string")
        touched = snapshots.merge_buckets(source, root, "law_id", lambda t, s: w.merge_changed(t, s, F.lit(2)))
        return touched, {r["law_id"]: (r["content"], r["load_timestamp"]) for r in snapshots.read_buckets(spark, root).collect()}

    one_percent = [(f"L{i:05d}", f"new {i}") for i in range(1000, 1040)]
    touched, now = load(one_percent)
    assert len(touched) <= 2 and len(now) == 4001
    assert all(now[k] == (t, 2) for k, t in one_percent) and now["L00999"] == ("text 999", 1) and now[None] == ("no key", 1)
    written = {p.name for p in (tmp_path / "table" / "data" / "v=00000002").iterdir() if p.name.startswith("_bucket")}
    assert len(written) <= 2
    # New keys beyond all ranges, an empty load, and keys of many ranges.
    touched, now = load([("Z", "last"), ("A", "first")])
    assert touched == [0, 99] and now["Z"] == ("last", 2) and len(now) == 4003
    assert load([])[0] == [] and len(load([(f"L{i:05d}", "x") for i in range(0, 4000, 20)])[1]) == 4003
    # A load that failed before its manifest was written changes nothing, and the next one takes its place.
    source = spark.createDataFrame([("L00001", "a", "broken")], "law_id string, unique_anchor string, content string")
    with pytest.raises(ZeroDivisionError):
        snapshots.merge_buckets(source, root, "law_id", lambda t, s: 1 / 0)
    assert load([("L00001", "whole")])[1]["L00001"] == ("whole", 2)


def test_an_empty_table_of_ranges(spark, tmp_path):
    root = str(tmp_path / "none")
    columns = "law_id string, unique_anchor string, content string, load_timestamp int, enforce_date date"
    snapshots.write_buckets(spark.createDataFrame([], columns), root, "law_id", 4)
    assert snapshots.read_buckets(spark, root).count() == 0
    source = spark.createDataFrame([("k_20200101_1", "a", "b")], "law_id string, unique_anchor string, content string")
    assert snapshots.merge_buckets(source, root, "law_id", lambda t, s: w.merge_changed(t, s, F.lit(2))) == [0]
    assert [(r["content"], str(r["enforce_date"])) for r in snapshots.read_buckets(spark, root).collect()] == [("b", "2020-01-01")]


def test_state_of_jobs_expires_in_a_running_stream(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "out")

    def send(*events):
        spark.createDataFrame(events, "job string, seq long, outcome string, detail string").coalesce(1).write.mode("append").parquet(str(folder))

    send(("a", 1, "started", None), ("a", 2, "completed", "x"), ("b", 1, "started", None))
    schema = spark.read.parquet(str(folder)).schema

    def changes(expire_ms):
        return jobs.job_changes(run.file_stream(spark, str(folder), "*.parquet", schema), expire_ms)

    def rows(log):
        return sorted((r["job"], r["status"], r["seq"], r["attempts"], r["version"]) for r in log.collect())

    first = [("a", "COMPLETED", 2, 1, 1), ("b", "IN_PROGRESS", 1, 1, 1)]
    assert rows(run.append_log_until(changes(5_000), root, lambda log: log.count() >= 2, 90)) == first
    # Heard of again too late: both begin anew, with a first version.
    time.sleep(6)
    send(("a", 3, "started", None), ("b", 2, "failed", "late"))
    log = run.append_log_until(changes(5_000), root, lambda log: log.count() >= 4, 90)
    assert rows(log) == sorted([*first, ("a", "IN_PROGRESS", 3, 1, 1), ("b", "FAILED", 2, 0, 1)])
    # Without an expiry what has ended stays ended.
    kept = run.append_log(changes(None), str(tmp_path / "kept"))
    assert rows(kept) == [("a", "COMPLETED", 2, 2, 1), ("b", "FAILED", 2, 1, 1)]
