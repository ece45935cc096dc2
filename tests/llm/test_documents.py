"""Operators on documents against plain versions, on small tables with every odd row."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from ragmill.llm import minhash, mixing, segmentation, substrings, surrogates, token_files, toxicity
from tests import oracle

WORD = re.compile("[^\x20\x09-\x0d]+")
KEY = "a key for tests"
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def prose(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = prose(rng, 120)
    passage = prose(rng, 60, 10**6)
    out = [(i, prose(rng, rng.randrange(1, 200), 10**6)) for i in range(30)]
    for i in range(30, 60):  # near copies, some just on either side of the threshold
        words = base.split()
        for _ in range(rng.randrange(0, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(words)))
    out += [(60 + i, prose(rng, 20) + " " + passage + " " + prose(rng, 20)) for i in range(8)]
    out += [(i, base) for i in range(70, 80)]
    out += [
        (80, None), (81, ""), (82, " \n\t "), (83, "one two"), (84, "One TWO"), (85, "one two three four five"),
        (86, "again " * 300), (87, "again " * 300), (88, prose(rng, 30_000)), (89, "É é ß  x"), (70, base), (90, "x" * 50_000),
    ]
    return out


def near_by_pairs(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(frame, rows):
    got = minhash.near_duplicates(frame(rows)).collect()
    want = near_by_pairs(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_null_ids_and_empty(frame):
    got = minhash.near_duplicates(frame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)])).collect()
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in got) == [(-1, True), (-1, True), (1, True)]
    assert minhash.near_duplicates(frame([])).count() == 0
    kept = minhash.drop_near_duplicates(frame([(1, "b"), (1, "a"), (2, "q"), (2, "q"), (None, "n"), (None, "n")])).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == [(-1, "n"), (-1, "n"), (1, "a"), (1, "b"), (2, "q")]


def test_near_duplicates_of_a_dropped_row_stay(frame):
    one, other = "a b c d e f g h i j", "q r s t u v w x y z"
    kept = minhash.drop_near_duplicates(frame([(1, one), (1, other), (3, other), (4, other), (5, one), (None, one)])).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == [(-1, one), (1, one), (3, other)]


def test_surrogates_need_a_key_and_scan_long_texts_once(spark, frame):
    with pytest.raises(ValueError, match="surrogates.key"):
        surrogates.key_of(spark)
    assert surrogates.key_of(spark, "k") == "k"
    spark.conf.set(surrogates.KEY_SETTING, "of the session")
    assert surrogates.key_of(spark, "k") == "of the session"
    spark.conf.unset(surrogates.KEY_SETTING)
    assert surrogates.surrogate("ssn", "123-45-6789", "one") != surrogates.surrogate("ssn", "123-45-6789", "two")
    text = " ".join(f"u{i}@mail{i}.org" for i in range(16_000))
    start = time.perf_counter()
    assert len(surrogates.entities(text)) == 16_000 and time.perf_counter() - start < 2
    odd = frame([(1, "mail a.b@c.org now")]).selectExpr("*", "1 as row", "2 as redrawn", "'e' as ENTITIES")
    out = surrogates.with_surrogates(odd, KEY).first()
    assert (out["row"], out["redrawn"], out["ENTITIES"]) == (1, 2, "e") and "a.b@c.org" not in out["text"]
    with pytest.raises(ValueError, match="entities"):
        surrogates.with_surrogates(odd, KEY, spans=True)


def test_texts_that_share_an_id_are_compared_on_their_own(frame):
    one, other, third = "a b c d e f g h i j", "q r s t u v w x y z", "k l m n o p k k l m"
    rows = [(1, one), (1, other), (1, third), (1, third), (1, None), (1, ""), (1 << 40, other + " a"), (2, one + " a"), (2, "2 3 4 5 6 7")]
    kept = [(r["doc_id"], r["text"] or "") for r in minhash.drop_near_duplicates(frame(rows)).collect()]
    assert sorted(kept) == sorted([(1, one), (1, third), (1, ""), (1 << 40, other + " a"), (2, "2 3 4 5 6 7")])
    far = [((1 << 63) - 1, one), ((1 << 63) - 1, other), (5, other), (6, third)]
    kept = minhash.drop_near_duplicates(frame(far)).collect()
    assert sorted(r["text"] for r in kept) == sorted([one, other, third])


def test_superminhash_estimates_and_registers():
    rng = np.random.default_rng(0)
    pool = rng.integers(1, 1 << 62, 600).astype(np.uint64)
    a, b = np.sort(pool[:400]), np.sort(pool[100:])
    sig = minhash.superminhash(np.concatenate([a, b, a[:1]]), np.array([400, 500, 1, 0]))
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.15
    # One shingle fills all registers, each at a step of its own.
    assert sorted((sig[2] >> np.uint64(56)).tolist()) == list(range(minhash.REGISTERS))
    assert (sig[3] == np.iinfo(np.uint64).max).all()
    # The chunking of rows does not matter.
    again = minhash.superminhash(np.concatenate([a, b, a[:1]]), np.array([400, 500, 1, 0]), chunk=1)
    assert (sig == again).all()


def test_bitmaps_never_hide_a_link():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 3000))
        x = rng.integers(1, 1 << 62, n).astype(np.uint64)
        y = np.concatenate([x[: int(n * rng.uniform(0.6, 1))], rng.integers(1, 1 << 62, int(rng.integers(0, n))).astype(np.uint64)])
        bits = minhash.bitmaps(np.concatenate([x, y]), np.array([len(x), len(y)]))
        if minhash._linked(np.sort(x), np.sort(y)):
            assert minhash._may_link(bits[:1], np.array([len(x)]), bits[1], len(y))[0]


def removed_by_windows(rows, n=35):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = collections.Counter(tuple(w[s : s + n]) for _, w in words for s in range(len(w) - n + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if seen[tuple(w[s : s + n])] > 1:
                gone[s : s + n] = [True] * n
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repeats(frame, rows):
    odd = [*rows, (None, rows[0][1]), (101, " ".join(rows[1][1].split()[::-1]))]
    got = substrings.remove_repeats(frame(odd)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == removed_by_windows(odd)


def test_repeats_empty(frame):
    assert substrings.remove_repeats(frame([])).count() == 0


def test_mix_passes_everything_once_and_meets_the_entropy(frame):
    rng = random.Random(3)
    docs = [(i, prose(rng, 40), "big") for i in range(300)] + [(1000 + i, prose(rng, 40), f"s{i % 4}") for i in range(80)]
    docs += [(2000, None, "big"), (2001, "", None), (None, "x y", None), (5, prose(rng, 7), "s1"), (5, "dup", "s1"), (5, "dup", "s1")]
    mixed = mixing.mix(frame(docs)).collect()
    passes = collections.Counter((r["doc_id"], r["source"], r["tokens"]) for r in mixed)
    assert set(passes) == {(i, s, len(WORD.findall(t or ""))) for i, t, s in docs}
    assert passes[(2000, "big", 0)] == 1
    tokens = collections.Counter()
    for r in mixed:
        tokens[r["source"]] += r["tokens"]
    own = collections.Counter()
    for _, t, s in docs:
        own[s] += len(WORD.findall(t or ""))
    assert tokens["big"] == own["big"]
    assert all(own[s] <= tokens[s] <= 4 * own[s] for s in own)
    assert tokens["s0"] > 1.3 * own["s0"]
    # Blocks are whole permutations, but for the last of a source.
    blocks = collections.Counter((r["source"], r["block"]) for r in mixed)
    last = {s: max(b for x, b in blocks if x == s) for s, _ in blocks}
    assert all(blocks[(s, b)] == sum(d[2] == s and bool(WORD.findall(d[1] or "")) for d in docs) for s, b in blocks if 0 < b < last[s])


def test_mixed_documents_are_the_mix(frame):
    rng = random.Random(4)
    docs = [(i, prose(rng, 30), "a" if i % 9 else "b") for i in range(90)] + [(200, None, "a"), (201, "", None)]
    table = frame(docs)
    mixed = collections.Counter(r["doc_id"] for r in mixing.mix(table).collect())
    again = mixing.mixed_documents(table)
    assert again.columns == table.columns
    assert collections.Counter(r["doc_id"] for r in again.collect()) == mixed
    assert mixing.mix(frame([])).count() == 0
    assert mixing.mix(frame([(1, None), (2, " ")])).count() == 2


def test_mix_limit(frame):
    rng = random.Random(4)
    docs = [(i, prose(rng, 30), "a") for i in range(200)] + [(900, prose(rng, 30), "b")]
    mixed = mixing.mix(frame(docs), entropy=0.69, repeat_limit=3.0).collect()
    assert sum(r["source"] == "b" for r in mixed) in (2, 3)


@pytest.fixture(scope="module")
def vocab():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


TEXTS = [
    "hello world", "  two  spaces ", "tab\tnl\n\n▁mark é日本語 🙂x\x00", "a", "", " ", "   ", "the the the", "x" * 300, "ab " * 3000,
    "́combining ﷐", "▁", "▁▁ a▁", "don't 12345",
]


def test_segmentation_is_lossless_and_reproducible(frame, vocab, spark):
    table = frame([*enumerate(TEXTS), (100, None), (None, "no id"), (7, TEXTS[7])])
    one = segmentation.encode(table, vocab).collect()
    two = segmentation.encode(table.repartition(1), vocab).collect()
    assert all(r["lossless"] for r in one)
    assert sorted(map(repr, one)) == sorted(map(repr, two))
    assert [r["n_pieces"] for r in one if r["doc_id"] == 100] == [0]
    back = segmentation.decoded(segmentation.encode(table, vocab), vocab).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in back) == collections.Counter(
        (r["doc_id"], r["text"] or "") for r in table.collect()
    )
    assert segmentation.encode(frame([]), vocab).count() == 0
    other = segmentation.encode(table, vocab, seed=1).collect()
    assert {tuple(r["pieces"]) for r in one} != {tuple(r["pieces"]) for r in other}


def test_segmentation_samples_the_lattice(vocab):
    v = segmentation.vocabulary(vocab)
    n = 40_000

    def every(u):
        if not u:
            return [((), 0.0)]
        return [((v.ids[u[:k]], *a), v.log[u[:k]] + w) for k in range(1, len(u) + 1) if u[:k] in v.ids for a, w in every(u[k:])]

    for word in ("there", "oner"):
        got = collections.Counter(tuple(x.tolist()) for x in segmentation.sample([word] * n, np.arange(n), v))
        paths = every(" " + word)
        total = sum(np.exp(w) for _, w in paths)
        assert all(abs(got[p] / n - np.exp(w) / total) < 0.01 for p, w in paths)
        assert set(got) <= {p for p, _ in paths}


def test_pieces_over_word_starts_are_refused(tmp_path):
    import sentencepiece as spm

    spm.SentencePieceTrainer.train(
        sentence_iterator=iter(["of the sea of the land"] * 50), model_prefix=str(tmp_path / "m"), vocab_size=290, model_type="bpe",
        byte_fallback=True, split_by_whitespace=False, hard_vocab_limit=False, minloglevel=2,
    )
    with pytest.raises(ValueError, match="reach over word starts"):
        segmentation.Vocabulary(str(tmp_path / "m.model"))


def test_segmentation_long_units_have_the_same_lattice(vocab):
    v = segmentation.vocabulary(vocab)
    lattices = segmentation.Lattices(v)
    for unit in (" there", " é日本語x", "  a", " tab\tx"):
        fast = lattices._filter([unit], np.array([len(unit)]), np.array([7]))
        slow = lattices._filter_long(unit, 7)
        order = np.argsort(fast[0], kind="stable")
        assert np.abs(fast[0][order] - slow[0]).max() <= 2
        assert (fast[1][order] == slow[1]).all() and (fast[2][order] == slow[2]).all()


def test_token_files(frame, spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = [*enumerate(TEXTS), (50, None), (-3, "negative"), (20, "İstanbul ΣΑΣ é   x<|endoftext|>y <|startoftext|>"), (21, "It's 2024, don't!\x1cq")]
    found = token_files.write_and_read(frame(docs), path).collect()
    plain = Tokenizer.from_file(path)
    at, want = 0, {}
    for i, t in sorted(docs):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found} == want
    folder = str(tmp_path / "tokens")
    token_files.write(frame(docs), folder, path)
    every = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(found, key=lambda r: r["start"])])
    asked = spark.createDataFrame([(int(p),) for p in [0, 1, 5, len(every) - 1, len(every) // 2]], "position long")
    assert {r["position"]: r["token"] for r in token_files.lookup(spark, folder, asked).collect()} == {
        p: int(every[p]) for p in [0, 1, 5, len(every) - 1, len(every) // 2]
    }
    # Null and repeated ids come out each; no rows give no files.
    twice = token_files.write_and_read(frame([(None, "a b"), (1, "c"), (1, "c"), (1, "dd dd")]), path).collect()
    assert sorted((r["start"], r["n_tokens"]) for r in twice)[0][0] == 0 and len(twice) == 4
    assert sum(r["n_tokens"] for r in twice) == max(r["start"] + r["n_tokens"] for r in twice)
    assert token_files.write_and_read(frame([]), path).count() == 0


def test_codes():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(1, int), rng.integers(0, 256, 2000), rng.integers(0, 1 << 17, 5000), np.array([0, 255, 256, 65535, 65536, (1 << 32) - 1])):
        levels = token_files.pack(ids)
        assert (token_files.unpack(levels) == ids).all()
        assert all(token_files.token_at(levels, int(i)) == ids[i] for i in rng.integers(0, len(ids), 50))


def test_surrogates_are_distinct_and_keep_their_form():
    seen = {surrogates.surrogate("surname", a + b + c, KEY) for a in "bcd" for b in "aeiou" for c in "lmnr"}
    assert len(seen) == 60 and all(len(s) == 3 and s[1] in "aeiou" for s in seen)
    for text in ("Ελένη", "Петров", "Müller-Lüdenscheidt", "王小明", "كمال"):
        new = surrogates.surrogate("surname", text, KEY)
        assert len(new) == len(text) and [c.isupper() for c in new] == [c.isupper() for c in text]
        assert [ord(c) >> 8 for c in new] == [ord(c) >> 8 for c in text] or text.startswith(("M", "王"))
    card = surrogates.surrogate("card", "4111111111111111", KEY)
    assert surrogates.luhn_ok(card) and card != "4111111111111111"
    for ip in ("10.1.2.3", "192.168.0.7", "8.8.8.8"):
        new = surrogates.surrogate("ip", ip, KEY)
        assert surrogates._range(sum(int(x) << s for x, s in zip(new.split("."), (24, 16, 8, 0), strict=True))) == surrogates._range(
            sum(int(x) << s for x, s in zip(ip.split("."), (24, 16, 8, 0), strict=True))
        )
    for kind, names in surrogates.NAMES.items():
        assert {surrogates.surrogate("given", n, KEY) for n in names.split()} == set(names.split()), kind
    assert re.fullmatch("[0-9a-f]{40}", surrogates.surrogate("secret", "1eb9c654e721b4f812088970e66a6345cee33dd6", KEY))


PRIVATE = (
    'Mail Anna.Schmidt22@mail5.example.com, anna.schmidt22@mail5.example.com, call +1 (521) 555-6210 or +1-521-555-6210; '
    'card 4521 9408 8619 4967, ip 8.196.197.208, token = "1eb9c654e721b4f812088970e66a6345cee33dd6", SSN 123-45-6789. '
    "Mr. John Smith met Frau Müller. Smith left."
)


def test_surrogates_in_documents(frame):
    docs = [(1, PRIVATE), (2, "again 8.196.197.208!! and Mr. Smith"), (3, None), (4, ""), (5, "nothing here"), (None, PRIVATE), (1, PRIVATE)]
    table = frame(docs)
    out = surrogates.with_surrogates(table, KEY)
    assert out.columns == table.columns
    got = {(r["doc_id"], r["n_chars"]): r["text"] for r in out.collect()}
    texts = {i: t for (i, _), t in got.items()}
    assert out.count() == len(docs) and texts[3] is None and texts[4] == "" and texts[5] == "nothing here"
    new = texts[1]
    assert texts[None] == new
    for part in ("chmidt22", "521) 555", "521-555", "4521 9408", "8.196.197.208", "1eb9c654", "123-45-6789", "Smith", "Müller", "John"):
        assert part not in new
    first, second = re.findall(r"\S+@\S+example\.com", new)
    assert first[1:] == second[1:] and first[0].isupper() and first.lower() == second
    one, two = re.search(r"call (\S+ \S+ \S+) or (\S+);", new).groups()
    assert re.sub(r"\D", "", one) == re.sub(r"\D", "", two) and one.startswith("+1 (")
    surname = re.search(r"Mr\. \w+ (\w+) met", new)[1]
    assert f"{surname} left" in new and f"Mr. {surname}" in texts[2]
    assert re.search(r"ip (\S+),", new)[1] in texts[2]
    assert surrogates.with_surrogates(frame([]), KEY).count() == 0


def test_neighbouring_entities_are_told_apart():
    text = "4451718024887799 27.65.93.188 4111-1111-1111-1111 378282246310005 +1 (372) 555-2774 12345 2024-05-06"
    kinds = [(text[a:b], k) for a, b, k, _ in surrogates.entities(text)]
    assert kinds == [
        ("4451718024887799", "card"), ("27.65.93.188", "ip"), ("4111-1111-1111-1111", "card"), ("378282246310005", "card"),
        ("+1 (372) 555-2774", "phone"),
    ]


@pytest.mark.parametrize("frame_of", ["[{}]", "'{}'", "„{}“", "«{}»", "Name:{}", "<b>{}</b>", "x —{}", "{},", "{}2", "/{}/"])
@pytest.mark.parametrize("name", ["Anna Schmidt", "Мария Иванова", "Dr. Weber"])
def test_names_beside_any_mark(frame_of, name):
    text = frame_of.format(name)
    new, spans = surrogates.replace(text, KEY)
    assert spans and name.split()[1] not in new and (name[:2] == "Dr" or name.split()[0] not in new)
    # The same entity as in a plain document.
    assert name[:2] == "Dr" or new == text.replace(name, surrogates.replace(f"so {name} said", KEY)[0][3:-5])


def test_surrogate_collisions_are_drawn_anew(spark):
    """Entities of a shape with few members: their surrogates hit real ones until they are drawn anew."""
    names = [("surname", a + b) for a in "Bcd" for b in "ae"] + [("surname", "Zu")]
    rows = surrogates.assign(spark.createDataFrame(names, "kind string, canonical string"), KEY).collect()
    made = [r["made"] for r in rows]
    assert len(set(made)) == len(names) and not set(made) & {c for _, c in names}
    assert all(r["made"] == surrogates.surrogate(r["kind"], r["canonical"], KEY, attempt=r["attempt"]) for r in rows)


INSULTS = "idiot moron stupid loser worthless trash scum pathetic disgusting clown".split()


def test_surrogates_of_a_nearly_full_shape_stay_distinct(spark):
    full = [("surname", a + b) for a in "AEIOU" for b in "bcdfghjklmnpqrstvwxyz"][:95]
    rows = [*full, ("surname", "Schmidt"), ("ip", "10.0.0.1"), ("given", "Anna"), ("given", "Maria")]
    got = surrogates.assign(spark.createDataFrame(rows, "kind string, canonical string"), KEY, rounds=6).collect()
    assert sorted((r["kind"], r["canonical"]) for r in got) == sorted(rows)
    assert len({(r["kind"], r["made"]) for r in got}) == len(rows)
    assert all(r["made"] != r["canonical"] for r in got if r["kind"] != "given")
    assert all(r["made"] == surrogates.surrogate(r["kind"], r["canonical"], KEY, attempt=r["attempt"]) for r in got)
    assert len({r["attempt"] for r in got if ("surname", r["canonical"]) in full}) == 1


@pytest.mark.parametrize("kind,name", [
    ("ip", "192.168.3.4"), ("ip", "8.8.8.8"), ("ip", "172.20.1.1"), ("secret", "00ff12ab" * 4), ("mac", "AA:0B:cc:01:02:03"),
    ("card", "4111111111111111"), ("phone", "+49|3012345678"), ("email", "anna.b@example.com"), ("surname", "Łąß山田カ"), ("iban", "DE89370400440532013000"),
])
def test_surrogates_stay_in_their_group(kind, name):
    assert all(surrogates.group(kind, surrogates.surrogate(kind, name, KEY, attempt=t)) == surrogates.group(kind, name) for t in range(40))


def test_toxicity_learns_and_rejects(frame, spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(1500):
        bad = i % 6 == 0
        words = prose(rng, 40).split()
        if bad:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice([*INSULTS, "zorblaxa", "zorblaxo", "zorblaxu"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs += [(9000, None), (9001, ""), (None, "you idiot"), (3, docs[3][1]), (9002, "x " * 50_000)]
    table, known = frame(docs), spark.createDataFrame([*labels, (4, 1, None), (None, 1, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, known)
    scored = {r["doc_id"]: (r["score"], r["held"]) for r in toxicity.score(table.withColumn("held", toxicity.held_out(table.doc_id)), model, ("doc_id", "held")).collect()}
    held = [i for i in range(1500) if scored[i][1]]
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held) and len(held) > 250
    assert sum((scored[i][0] >= 0.3) == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s, _ in scored.values()) and scored[9000][0] == scored[9001][0] < 0.3
    kept = toxicity.reject_toxic(table, known)
    assert kept.columns == table.columns and 9000 in {r["doc_id"] for r in kept.collect()}


def test_toxicity_without_rows_or_labels(frame, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.reject_toxic(frame([]), none).count() == 0
    kept = {r["doc_id"] for r in toxicity.reject_toxic(frame([(i, "plain words here") for i in range(20)]), none).collect()}
    assert kept == set(range(20))


def test_label_model_counts_companions_once():
    # Two voters that always hit together say no more than one of them.
    m = len(toxicity.VOTERS)
    masks = np.array([0b11, toxicity.SILENCE, 0b100, 0b111, 0b1000, 0b1100])
    counts = np.array([60, 5000, 60, 60, 40, 40])
    model = toxicity.fit_label_model(masks, counts)
    assert model.parent[1] == 0 or model.parent[0] == 1
    post = model.posterior((masks[:, None] >> np.arange(m)) & 1)
    assert post[1] < 0.05 < post[0] and post[3] >= post[0]


def test_extra_columns_do_not_matter(frame, rows):
    """Columns with the operators' own names."""
    table = frame(rows[:40])
    names = ["a", "b", "dk", "marks", "key", "id", "row", "s", "blocks", "cut", "block", "tokens", "score", "tie", "bucket", "signature", "__n"]
    odd = table.select("*", *[table.lang.alias(n) for n in names])
    assert minhash.near_duplicates(odd).count() == 40
    assert substrings.remove_repeats(odd).count() == 40
    assert mixing.mix(odd).count() >= 40
    for out in (minhash.drop_near_duplicates(odd), mixing.mixed_documents(odd), surrogates.with_surrogates(odd, KEY)):
        assert out.columns == odd.columns and out.count() > 0
    labels = odd.selectExpr("doc_id", "1 as quality", "0 as toxic")
    assert toxicity.reject_toxic(odd, labels).columns == odd.columns


def test_arrow_slices_of_one_long_text():
    hashes, sizes = substrings.word_hashes(pa.array(["a " * 200_000]))
    assert len(hashes) == 200_000 and sizes.tolist() == [200_000]


def test_mix_and_token_files_with_clashing_names(frame):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "one two"), (2, None), (None, "x " * 3000), (3, "one two")]
    odd = frame(rows).selectExpr("*", "'a' as s", "1 as tokens", "2 as block", "0L as bucket", "'t' as tie", "3 as ids", "1D as Weight")
    assert {r["doc_id"] for r in mixing.mix(odd).collect()} == {1, 2, 3, None}
    files = {r["doc_id"]: r["n_tokens"] for r in token_files.write_and_read(odd, path).collect()}
    assert files == {1: 3, 2: 1, None: 3001, 3: 3}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{oracle.DEFAULT_DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-duplicates", "personal data", "mixing", "pieces"]
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, oracle.DEFAULT_DIR)
        assert docs.columns == columns, name
        if name != "mixing":
            assert docs.count() <= seen
            seen = docs.count()
    run = corpus_pipeline.run(spark, oracle.DEFAULT_DIR)
    assert {r["doc_id"] for r in run.collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert run.filter("not lossless").count() == 0
