import collections
import itertools
import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ragmill.llm import filter_audit

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
LABELS = "doc_id long, quality int, toxic int"


def failed(text):
    words = WORD.findall(text)
    return {
        f for f, bad in (
            ("A", len(words) < 50), ("B", 100 * len(set(words)) < 65 * len(words)),
            ("C", 100 * len(re.findall("[A-Z]", text)) > 5 * len(text)), ("D", bool(re.search("[#$%&*|]", text))),
        ) if bad
    }


def by_hand(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, source in rows:
        fails = failed(text or "")
        if i is not None and i > first[text or ""]:
            fails.add("E")
        mine = [x for x in labels if x[0] == i and i is not None]
        docs.append((source or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = {}, collections.Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def write(folder, name, rows):
    columns = [[r[0] for r in rows], [r[1] for r in rows], ["en"] * len(rows), [r[2] for r in rows], [len(r[1] or "") for r in rows]]
    pq.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, SCHEMA.types, strict=True)], schema=SCHEMA), folder / name)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    plain = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(30, 90))) for _ in range(25)]
    plain += [t + " # 5%" for t in plain[:8]] + [t.upper() for t in plain[5:12]] + ["same " * n for n in (10, 49, 50, 70)]
    plain += [" ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)) + " \t\x0b ", "", None, "É" * 30, "a\x1cb", "x" * 50_000]
    out = [(i, rng.choice(plain), rng.choice(["s", "s", "s", "t", None])) for i in range(220)]
    out += [(500, plain[0], "s"), (500, plain[0], "t"), (500, plain[0], "t"), (3, plain[1], "u"), (3, plain[1], "s"), (3, plain[2], "s")]
    out += [(None, plain[0], "s"), (None, plain[0], "s"), (None, None, None), (None, "none like it", "t")]
    out += [(1000 + i, plain[3], "s") for i in range(60)]
    return out


@pytest.fixture(scope="module")
def labels():
    rng = random.Random(6)
    found = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 1100, 3)]
    return [*found, (3, None, 1), (3, 1, None), (500, 1, 0), (None, 1, 1)]


def test_smaller_ids_that_arrive_later_take_back_what_was_counted(spark, rows, labels, tmp_path):
    order = sorted(rows, key=lambda r: -1 if r[0] is None else -r[0])  # the smallest ids come last
    (tmp_path / "documents.parquet").mkdir()
    n = 7
    for k in range(n):
        write(tmp_path / "documents.parquet", f"part-{k}.parquet", order[k * len(order) // n : (k + 1) * len(order) // n])
    known = spark.createDataFrame(labels, LABELS)
    root = str(tmp_path / "state")
    found = filter_audit.audit(spark, str(tmp_path / "documents.parquet"), known, 2, root)
    assert got(found) == by_hand(rows, labels)

    def log():
        return spark.read.schema(f"{filter_audit.CHANGES}, batch long").parquet(f"{root}/counters").filter("batch >= 0")

    assert log().select("batch").distinct().count() == 4 and log().filter("n < 0").count() > 0
    # More files: only these are read, and what they change is taken back.
    more = [(-5, order[0][1], "s"), (-6, "wholly new", "new"), (70_000, rows[0][1], "t")]
    write(tmp_path / "documents.parquet", "part-8.parquet", more)
    again = filter_audit.audit(spark, str(tmp_path / "documents.parquet"), known, 2, root)
    assert got(again) == by_hand(rows + more, labels)
    assert log().select("batch").distinct().count() == 5


def test_one_file_small_folds_and_sql(spark, rows, labels, tmp_path, monkeypatch):
    monkeypatch.setattr(filter_audit, "FOLD_ROWS", 20)
    write(tmp_path, "documents.parquet", rows)
    found = got(filter_audit.audit(spark, str(tmp_path / "documents.parquet"), spark.createDataFrame(labels, LABELS)))
    assert found == by_hand(rows, labels)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    con.register("labels", pa.table({k: pa.array([x[i] for x in labels], pa.int64()) for i, k in enumerate(["doc_id", "quality", "toxic"])}))
    assert sorted(con.execute(filter_audit.ORACLE).fetchall()) == found


def test_empty_table_and_clashing_names(spark, rows, labels, tmp_path):
    write(tmp_path, "none.parquet", [])
    known = spark.createDataFrame(labels, LABELS)
    assert filter_audit.audit(spark, str(tmp_path / "none.parquet"), known).collect() == []
    frame = spark.createDataFrame([(r[0], r[1], r[2], "k", 1, 2, 3) for r in rows[:40]], "doc_id long, text string, source string, key string, mask int, n int, part int")
    frame.coalesce(1).write.parquet(str(tmp_path / "odd.parquet"))
    found = filter_audit.audit(spark, str(tmp_path / "odd.parquet"), known.limit(0))
    assert got(found) == by_hand(rows[:40], [])
