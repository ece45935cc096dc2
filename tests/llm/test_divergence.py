import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ragmill.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def by_hand(rows, least=3, top=200):
    counts, held, groups = collections.Counter(), collections.defaultdict(set), set()
    for i, (_, text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in TERM.findall((text or "").translate(FOLD)):
            counts[lang, source, t] += 1
            held[lang, t].add(i)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (l, t), d in held.items() if l == lang and len(d) >= least)
        sources = [s for l, s in groups if l == lang]

        def p(of):
            n = {t: sum(counts[lang, s, t] for s in of) for t in kept}
            below = sum(n.values()) + len(kept)
            return {t: 1 + 10**9 * (n[t] + 1) // below for t in kept}

        whole = p(sources)
        for s in sources:
            own = p([s])
            parts = {"pair": [], "term": []}
            for o in sources:
                if o != s:
                    q = p([o])
                    parts["pair"].append((-sum((own[t] - q[t]) ** 2 // q[t] for t in kept), o.encode()))
            for t in kept:
                if counts[lang, s, t] and own[t] > whole[t]:
                    parts["term"].append((-((own[t] - whole[t]) ** 2 // whole[t]), t.encode()))
            for part, found in parts.items():
                for rank, (v, item) in enumerate(sorted(found), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item.decode(), -v, rank))
    return sorted(out)


def table(spark, rows, parts=3):
    full = [(*r, len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts) if full else spark.createDataFrame([], DOCS)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 14))) for _ in range(300)]
    words += ["commonprefix" + w for w in words[:60]]
    out = [
        (i, " ".join(rng.choice(words) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "c", None]))
        for i in range(150)
    ]
    out += [
        (200, None, "en", "a"), (201, "", "xx", "only"), (202, "1 2 3 _ ~", "yy", "p"), (203, None, "yy", "q"), (204, "rare", "yy", "q"),
        (205, "THE the tHe É é", "en", "a"), (206, "x" * 40_000 + " " + "y" * 39_999, "en", "b"), (207, "x" * 40_000, "en", "b"),
        (208, "x" * 40_000 + "!" + "y" * 39_999, "en", "c"), (None, "the\x00the\x7fİ ſ", "en", "a"), (None, "the the", "en", "a"), (5, "the", "en", "a"),
    ]
    out += [(300 + i, "same passage of words here", "en", "a") for i in range(60)]
    out += [(5, "twice the same", "tw", "s"), (5, "twice the same", "tw", "s"), (5, "twice the same", "tw", "s")]
    return out


def test_against_plain_arithmetic(spark, rows):
    assert got(divergence.audit(table(spark, rows))) == by_hand(rows)


def test_levels_slices_and_shuffled_joins_change_nothing(spark, rows, monkeypatch):
    for name, value in (("FIRST", 1), ("SLICE_BYTES", 500), ("ROWS_OUT", 30), ("SENT_BYTES", -1), ("BLOCK", 8), ("BLOCK_ROWS", 9)):
        monkeypatch.setattr(divergence, name, value)
    assert got(divergence.audit(table(spark, rows, 5), top=7)) == by_hand(rows, top=7)


def test_prefixes_are_discarded(spark):
    texts = [(0, "alpha alpine", "en", "s"), (1, "alps alpha", "en", "s"), (2, "alpaca beta", "en", "s"), (3, "beta", "en", "s")]
    packs = divergence.term_packs(table(spark, texts))
    level = {(bytes(r["prefix"]), r["complete"]) for r in divergence.prefixes(packs, 3).collect()}
    assert level == {(b"alp", False)}  # three documents hold it, though no term below it is in three
    assert divergence.kept_terms(packs, 3, 3).collect() == []
    assert [r["term"] for r in divergence.kept_terms(packs, 2, 3).orderBy("term").collect()] == ["alpha", "beta"]


def test_terms_are_the_pattern():
    texts = ["", None, "Ab-cD é÷x", "\x00A\x7f[b]`c`{d}", "漢字 かな", " lead", "trail ", "a" * 70_000]
    codes, names, sizes = divergence.split_terms(pa.array(texts).slice(0))
    names = names.to_pylist()
    flat = [names[c] for c in codes]
    want = [TERM.findall((t or "").translate(FOLD)) for t in texts]
    assert flat == [t for w in want for t in w] and sizes.tolist() == [len(w) for w in want]
    codes, names, sizes = divergence.split_terms(pa.array(texts).slice(2, 3))
    assert [names.to_pylist()[c] for c in codes] == [t for w in want[2:5] for t in w]


def test_counts_beyond_a_long():
    n, below = np.array([[10**12, 0]]), np.array([3 * 10**12 + 5, 10])
    assert divergence._shares(n, below).tolist() == [[1 + 10**9 * (10**12 + 1) // (3 * 10**12 + 5), 1 + 10**9 // 10]]


def test_sql_and_empty_tables_and_clashing_names(spark, rows):
    some = [(r[0], (r[1] or "")[:500].replace("\x00", " "), r[2], r[3]) for r in rows]
    frame = table(spark, some)
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pandas(frame.toPandas()))
    want = sorted(con.execute(divergence.ORACLE).fetchall())
    odd = frame.selectExpr("*", "1 as row", "'t' as term", "2 as n", "'x' as Terms")
    assert got(divergence.audit(odd)) == want == by_hand(some)
    assert got(divergence.audit(table(spark, []))) == []
