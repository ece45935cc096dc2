"""Personal data replaced by keyed surrogates of the same type, script and shape.

A surrogate is a keyed permutation of all strings of the same shape: digits become digits, vowels vowels, letters
letters of the same script and case, separators stay. Two entities of one type can therefore never share a
surrogate unless one had to be drawn anew, and every mention of an entity gets the same one in every document.
Names from the lists become names of the same gender and script; other name parts are permuted in their letters.
Names are found after a title or by a listed given name, in Latin, Greek and Cyrillic letters. Names that neither a title nor
a listed given name introduces, and all names in other scripts (Arabic, Hebrew, Devanagari, Kana, Han, Hangul), stay in clear.
Payment cards keep their check digit rule, IP addresses stay in their private or public range.

The corpus-wide check: a surrogate must differ from its own entity, from every real entity of its type, and from every
other surrogate. Those that don't are drawn anew with the next attempt until none is left, and only these few
travel to the documents as exceptions. Shapes that real entities nearly fill are told in ``assign``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragmill.llm.texts import column, text_batches
from ragmill.session import materialize

#: The setting of a session that holds the key. Whoever knows the key can undo surrogates, so there is no key here.
KEY_SETTING = "spark.ragmill.surrogates.key"

# Given names by gender and script.
NAMES: dict[str, str] = {
    "f latin": "Anna Maria Emma Laura Julia Sarah Lisa Sophie Claire Lucia Elena Carmen Ingrid Helga Alice Emily Olivia Hannah Marie Camille Isabel Teresa Monika Petra Jane Mary Patricia Linda Susan Karen",
    "m latin": "John James Robert Michael William David Thomas Peter Paul Martin Stefan Klaus Hans Jürgen Pierre Louis Antoine Carlos Miguel José Luis Andrés Oliver Daniel Mark Steven Andrew George Kevin Brian",
    "f cyrillic": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия",
    "m cyrillic": "Иван Пётр Сергей Алексей Дмитрий Андрей Михаил Николай Владимир Павел",
    "f greek": "Μαρία Ελένη Κατερίνα Σοφία Άννα Γεωργία",
    "m greek": "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παύλος",
}
#: Words before a name, which stay as they are, with the gender they tell.
TITLES: dict[str, str] = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f",
    "Dr": "", "Prof": "",
}
# Letters that change among themselves; each class once in lower case, upper case follows.
CLASSES = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöüãõåæø", "çñ", "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ", "אבגדהוזחטיכלמנסעפצקרשת",
    "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह",
    "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろ",
    "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロ",
)
#: Ideographs and syllables change inside their own run of 64 neighbours.
BLOCKS = ((0x4E00, 0x9FC0), (0xAC00, 0xD780))

_CLASS: dict[str, tuple[str, int]] = {}
for _letters in CLASSES:
    for _form in dict.fromkeys((_letters, _letters.upper())):
        _CLASS.update({_c: (_form, _i) for _i, _c in enumerate(_form)})


# --- keyed permutations -----------------------------------------------------------------------


def _round(key: str, label: str, value: int, bits: int) -> int:
    digest = hashlib.blake2b(f"{label}|{value}".encode(), key=key.encode()[:64], digest_size=64).digest()
    return int.from_bytes(digest, "big") & ((1 << bits) - 1)


def permute(value: int, size: int, key: str, label: str) -> int:
    """A keyed permutation of ``range(size)``: a Feistel network on enough bits, walked until it is inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    if size < 2:
        return value
    while True:
        left, right = value >> half, value & ((1 << half) - 1)
        for r in range(8):
            left, right = right, left ^ _round(key, f"{label}|{half}|{r}", right, half)
        value = left << half | right
        if value < size:
            return value


def reshape(text: str, key: str, label: str) -> str:
    """The text under a keyed permutation of all texts of its shape (class and case of each character)."""
    places, value, size = [], 0, 1
    for c in text:
        known = _CLASS.get(c)
        if known is None:
            code = ord(c)
            if any(low <= code < high for low, high in BLOCKS):
                known = ("", code)
        places.append(known)
        if known:
            n, i = (len(known[0]), known[1]) if known[0] else (64, known[1] % 64)
            value, size = value * n + i, size * n
    shape = "".join("." if p is None else p[0][:1] or chr(p[1] & ~63) for p in places)
    value = permute(value, size, key, f"{label}|{shape}")
    out = []
    for c, known in zip(reversed(text), reversed(places), strict=True):
        if known is None:
            out.append(c)
        elif known[0]:
            value, i = divmod(value, len(known[0]))
            out.append(known[0][i])
        else:
            value, i = divmod(value, 64)
            out.append(chr((known[1] & ~63) + i))
    return "".join(reversed(out))


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _walk(start: str, step, good) -> str:
    """Repeat a permutation until the value is of the right kind; still a permutation of that kind."""
    value = step(start)
    while not good(value):
        value = step(value)
    return value


def _card(digits: str, key: str, label: str) -> str:
    kind = luhn_ok(digits)
    return _walk(digits, lambda d: reshape(d, key, label), lambda d: luhn_ok(d) == kind and (d[0] == "0") == (digits[0] == "0"))


def _range(value: int) -> str:
    for name, low, high in (
        ("10", 10 << 24, 11 << 24), ("172", (172 << 24) | (16 << 16), (172 << 24) | (32 << 16)),
        ("192", (192 << 24) | (168 << 16), (192 << 24) | (169 << 16)), ("127", 127 << 24, 128 << 24), ("0", 0, 1 << 24),
    ):
        if low <= value < high:
            return name
    return "public"


def _ip(text: str, key: str, label: str) -> str:
    parts = [int(x) for x in text.split(".")]
    value = sum(p << s for p, s in zip(parts, (24, 16, 8, 0), strict=True))
    kind = _range(value)
    found = _walk(value, lambda v: permute(v, 1 << 32, key, label), lambda v: _range(v) == kind) if kind == "public" else None
    if found is None:
        # Inside a private range only the lower two bytes change.
        found = (value & 0xFFFF0000) | permute(value & 0xFFFF, 1 << 16, key, f"{label}|{value >> 16}")
    return ".".join(str(found >> s & 255) for s in (24, 16, 8, 0))


def _phone(digits: str, key: str, label: str) -> str:
    """``digits`` starts with ``+cc|`` or nothing; the subscriber's number changes, a leading 0 or 1 stays one."""
    code, _, rest = digits.rpartition("|")
    first = rest[:1] in "01"
    new = _walk(rest, lambda d: reshape(d, key, f"{label}|{code}"), lambda d: (d[:1] in "01") == first)
    return f"{code}|{new}" if code else new


def _email(text: str, key: str, label: str) -> str:
    local, _, domain = text.partition("@")
    return f"{reshape(local, key, label + '|local')}@{_domain(domain, key)}"


def _domain(domain: str, key: str) -> str:
    """Labels before the registered name change; of other domains the name itself does. Endings stay."""
    labels = domain.split(".")
    keep = 2 if len(labels) > 2 or labels[-2:-1] == ["example"] else 1
    if labels[-keep:][0] == "example" or keep == 1:
        head, tail = labels[:-keep], labels[-keep:]
    else:
        head, tail = labels[:-1], labels[-1:]
    return ".".join([*(reshape(x, key, "domain") for x in head), *tail])


@lru_cache(maxsize=64)
def _listed() -> dict[str, tuple[str, int]]:
    return {n: (group, i) for group, names in NAMES.items() for i, n in enumerate(names.split())}


def _given(name: str, key: str, label: str) -> str:
    group, i = _listed()[name]
    names = NAMES[group].split()
    return names[permute(i, len(names), key, f"{label}|{group}")]


def _hex(text: str, key: str, label: str) -> str:
    """Hexadecimal digits stay such; other secrets keep their classes of letters."""
    digits = re.sub("[:-]", "", text)
    for alphabet in ("0123456789abcdef", "0123456789ABCDEF"):
        if not set(digits) - set(alphabet):
            value = permute(int(digits, 16), 16 ** len(digits), key, f"{label}|{len(digits)}")
            made = iter(f"{value:0{len(digits)}x}" if alphabet[-1] == "f" else f"{value:0{len(digits)}X}")
            return "".join(next(made) if c.isalnum() else c for c in text)
    return reshape(text, key, label)


_MAKERS = {"secret": _hex, "mac": _hex, "card": _card, "account": _card, "ip": _ip, "phone": _phone, "email": _email, "given": _given}


def surrogate(kind: str, canonical: str, key: str, attempt: int = 0) -> str:
    """The surrogate of an entity; each attempt is a permutation of its own."""
    return _MAKERS.get(kind, reshape)(canonical, key, f"{kind}|{attempt}")


# --- detection --------------------------------------------------------------------------------

_PATTERNS = [
    ("secret", re.compile(r"""(?i:\b(?:token|api[_-]?key|secret|password|passwd|access[_-]?key)\b\s*[=:]\s*["']?)([A-Za-z0-9_\-+/]{8,})""")),
    ("secret", re.compile(r"\b((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32})\b")),
    ("email", re.compile(r"(?<![\w.+-])([\w.+-]*\w@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})")),
    ("iban", re.compile(r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b")),
    ("ip", re.compile(r"(?<![\d.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?![\d]|\.\d)")),
    ("mac", re.compile(r"\b([0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5})\b")),
    ("ssn", re.compile(r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)")),
    ("card", re.compile(r"(?<![\d.-])(\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{5})(?![\d-])")),
]
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_UPPER = r"[A-ZÀ-ÖØ-ÞΆ-ΫЀ-Я][^\W\d_]+"
#: Runs of letters, as _NAME cuts them, whatever mark stands beside them.
_LETTERS = re.compile(r"[^\W\d_]+")
_NAME = re.compile(rf"\b(?:({_TITLE})\.? )?({_UPPER}(?:[ ]{_UPPER}){{0,2}})")


def _canonical(kind: str, text: str) -> tuple[str, str]:
    """(kind, form that all mentions of the entity share)"""
    if kind in ("card", "ssn", "iban"):
        digits = re.sub(r"[ -]", "", text)
        return ("card" if luhn_ok(digits) else "account", digits) if kind == "card" else (kind, digits)
    if kind == "phone":
        digits = re.sub(r"\D", "", text)
        # A country code is what stands between the plus and the first separator.
        code = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
        return kind, f"+{code[1]}|{digits[len(code[1]):]}" if code else ("+|" + digits if text[0] == "+" else digits)
    if kind == "email":
        return kind, text.lower()
    return kind, text


def _dress(kind: str, text: str, made: str) -> str:
    """The surrogate of the canonical form, in the spelling of this mention."""
    if kind in ("card", "account", "ssn", "iban", "phone"):
        code, _, rest = made.rpartition("|")
        letters = iter(code.lstrip("+") + rest)
        return "".join(next(letters) if c.isalnum() else c for c in text)
    if kind == "email":
        local, _, domain = text.partition("@")
        if local.isupper():
            return made.upper()
        if local[:1].isupper():
            return made[:1].upper() + made[1:]
    return made


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of all entities, by place, without overlaps."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []  # in order, without overlaps

    def add(start: int, end: int, kind: str, canonical: str) -> None:
        at = bisect_left(taken, (end, 0))
        if not at or taken[at - 1][1] <= start:
            taken.insert(at, (start, end))
            found.append((start, end, kind, canonical))

    digits = any(c in text for c in "0123456789")
    lower = text.lower()
    secrets = any(w in lower for w in ("token", "key", "secret", "passw"))
    for i, (kind, pattern) in enumerate(_PATTERNS):
        if i == 0 and not secrets or kind == "email" and "@" not in text or not digits and i and kind != "email":
            continue
        for m in pattern.finditer(text):
            if kind == "phone" and sum(c.isdigit() for c in m[1]) < 8:
                continue
            add(m.start(1), m.end(1), *_canonical(kind, m[1]))
    listed = _listed()
    surnames: set[str] = set()
    if not _hints().isdisjoint(_LETTERS.findall(text)):
        for m in _NAME.finditer(text):
            words = [(m.start(2) + w.start(), w[0]) for w in re.finditer(r"\S+", m[2])]
            while words and not m[1] and words[0][1] not in listed:
                words.pop(0)
            if not words or not m[1] and len(words) < 2:
                continue
            for place, word in words:
                if word in listed:
                    add(place, place + len(word), "given", word)
                elif not m[1] and place == words[0][0]:
                    break
                else:
                    surnames.add(word)
                    add(place, place + len(word), "surname", word)
        # The same person by surname alone.
        for name in surnames:
            for m in re.finditer(rf"\b{re.escape(name)}\b", text):
                add(m.start(), m.end(), "surname", name)
    return sorted(found)


@lru_cache(maxsize=1)
def _hints() -> frozenset[str]:
    """Without one of these words there is no name in a text."""
    return frozenset({*TITLES, *_listed()})


def replace(text: str | None, key: str, attempts: dict[tuple[str, str], int] | None = None):
    """(text with surrogates, [(kind, start, end)] in it); null stays null."""
    if not text:
        return text, []
    out, spans, at, length = [], [], 0, 0
    for start, end, kind, canonical in entities(text):
        new = _dress(kind, text[start:end], surrogate(kind, canonical, key, (attempts or {}).get((kind, canonical), 0)))
        out += [text[at:start], new]
        length += start - at + len(new)
        spans.append((kind, length - len(new), length))
        at = end
    return "".join([*out, text[at:]]), spans


# --- Spark ------------------------------------------------------------------------------------


def _row_key(doc_id="doc_id", text="text"):
    return F.xxhash64(doc_id, text)


def mentions(docs: DataFrame) -> DataFrame:
    """(row, kind, canonical): the distinct entities of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, names = [], [], []
            for row, text in zip(column(batch, "row").to_pylist(), column(batch, "text"), strict=True):
                for kind, canonical in {(k, c) for _, _, k, c in entities(text.as_py())}:
                    rows.append(row)
                    kinds.append(kind)
                    names.append(canonical)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(kinds, pa.string()), pa.array(names, pa.string())],
                ["row", "kind", "canonical"],
            )

    return docs.select(_row_key().alias("row"), "text").filter("text is not null").mapInArrow(run, "row long, kind string, canonical string")


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, canonical, attempt) with their surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names, tries = (column(batch, n).to_pylist() for n in ("kind", "canonical", "attempt"))
            made = [surrogate(k, c, key, t) for k, c, t in zip(kinds, names, tries, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "made"])

    return entities.select("kind", "canonical", "attempt").mapInArrow(
        run, "kind string, canonical string, attempt int, made string"
    )


def group(kind: str, canonical: str) -> str:
    """What an entity has in common with all its surrogates; entities of two groups never share one."""
    if kind == "ip":
        value = sum(int(p) << s for p, s in zip(canonical.split("."), (24, 16, 8, 0), strict=True))
        return "public" if _range(value) == "public" else str(value >> 16)
    if kind in ("secret", "mac"):
        return str(len(canonical))
    blocks = ("." if not any(low <= ord(c) < high for low, high in BLOCKS) else chr(ord(c) & ~63) for c in canonical)
    return "".join(_CLASS[c][0][0] if c in _CLASS else b for c, b in zip(canonical, blocks, strict=True))


def _grouped(drawn: DataFrame) -> DataFrame:
    """``drawn`` with the group of each entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names = (column(batch, n).to_pylist() for n in ("kind", "canonical"))
            made = pa.array([group(k, c) for k, c in zip(kinds, names, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "group"])

    return drawn.select("kind", "canonical", "attempt", "made").mapInArrow(
        run, "kind string, canonical string, attempt int, made string, group string"
    )


def _common(drawn: DataFrame, clash: DataFrame, key: str, first: int, rounds: int) -> DataFrame:
    """``drawn``, with one common attempt for all entities of every group that has one of ``clash``."""
    grouped = materialize(_grouped(drawn))
    full = materialize(grouped.join(clash, ["kind", "canonical"], "left_semi").select("kind", "group").distinct())
    rest = grouped.join(full, ["kind", "group"], "left_anti").filter("kind <> 'given'")
    given = grouped.filter("kind = 'given'")
    done = [rest, given]
    left = materialize(grouped.join(full, ["kind", "group"], "left_semi"))
    for attempt in range(first, first + rounds):
        left = materialize(_grouped(_drawn(left.withColumn("attempt", F.lit(attempt)), key)))
        twice = left.groupBy("kind", "group", "made").agg(F.count("*").alias("n")).filter("n > 1").select("kind", "group")
        own = left.filter("made = canonical").select("kind", "group")
        again = materialize(twice.union(own).distinct())
        done.append(left.join(again, ["kind", "group"], "left_anti"))
        left = materialize(left.join(again, ["kind", "group"], "left_semi"))
        if left.isEmpty():
            break
    else:
        if not left.groupBy("kind", "made").count().filter("count > 1").isEmpty():
            raise ValueError("entities without surrogates of their own are left")
        done.append(left)
    names = ["kind", "canonical", "attempt", "made"]
    out = done[0].select(*names)
    for part in done[1:]:
        out = out.unionByName(part.select(*names))
    return materialize(out)


def assign(entities: DataFrame, key: str, rounds: int = 50) -> DataFrame:
    """(kind, canonical, attempt, made): surrogates without collisions for distinct (kind, canonical).

    Where real entities nearly fill their shape, some still clash after the rounds. All entities of such a shape then take
    one common attempt, a permutation of the shape: their surrogates are distinct and differ from their own entity, but
    may be other real entities. Only a shape of a single string keeps its entity. A clash beyond that is an error.

    Given names come from closed lists, where real names and surrogates are the same by design; the list is
    permuted as a whole, so only their distinctness is at stake, and that holds by construction.
    """
    drawn = materialize(_drawn(entities.withColumn("attempt", F.lit(0)), key))
    for attempt in range(rounds + 1):
        free = drawn.filter("kind <> 'given'")
        real = free.select("kind", F.col("canonical").alias("made"), F.lit(True).alias("real"))
        winners = free.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canonical")).alias("w"), F.count("*").alias("n"))
        clash = (
            free.join(winners, ["kind", "made"]).join(real, ["kind", "made"], "left")
            .filter("real or (n > 1 and w.canonical <> canonical)").select("kind", "canonical")
        )
        clash = materialize(clash)
        if clash.isEmpty():
            return drawn
        if attempt == rounds:
            break
        again = drawn.join(clash, ["kind", "canonical"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        drawn = materialize(
            drawn.join(clash, ["kind", "canonical"], "left_anti").unionByName(_drawn(again, key))
        )
    return _common(drawn, clash, key, rounds + 1, 50)


def key_of(spark: SparkSession, test_key: str | None = None) -> str:
    """The key that the session is given in ``KEY_SETTING``; ``test_key`` only stands in for it where data are made up."""
    key = spark.conf.get(KEY_SETTING, None) or test_key
    if not key:
        raise ValueError(f"set {KEY_SETTING} to a secret of at least 16 characters")
    return key


def with_surrogates(docs: DataFrame, key: str, spans: bool = False) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and ``n_chars``, where there is one, counted anew.

    With ``spans`` an array ``entities`` of (kind, start, end) of the surrogates follows; a column of that name, whatever its
    case, is refused. Null and empty texts stay as they are, texts of any length are taken whole. Rows that repeat an
    id or a text each have their own row, equal entities get equal surrogates in all of them. An empty table gives an
    empty one. Other columns are passed on, whatever their names are.
    """
    if spans and "entities" in (c.lower() for c in docs.columns):
        raise ValueError("docs has a column entities")
    found = materialize(mentions(text_batches(docs)))
    redrawn = assign(found.select("kind", "canonical").distinct(), key).filter("attempt > 0")
    exceptions = materialize(
        found.join(redrawn.select("kind", "canonical", "attempt"), ["kind", "canonical"])
        .distinct().groupBy("row").agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias("redrawn"))
    )
    names = docs.columns
    # The places of columns count, so that no name can clash.
    rows = docs.select(F.struct(*names).alias("doc"), _row_key().alias("row"))
    if exceptions.isEmpty():
        rows = rows.withColumn("redrawn", F.lit(None).cast("array<struct<kind:string,canonical:string,attempt:int>>"))
    else:
        rows = rows.join(exceptions, "row", "left")
    rows = rows.select("doc", "redrawn")
    at = names.index("text")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = [], []
            redrawn = column(batch, "redrawn").to_pylist()
            columns = column(batch, "doc").flatten()
            for i, text in enumerate(columns[at]):
                tries = {(r["kind"], r["canonical"]): r["attempt"] for r in redrawn[i] or ()}
                new, marks = replace(text.as_py(), key, tries)
                texts.append(new)
                places.append([{"kind": k, "start": a, "end": b} for k, a, b in marks])
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                old = columns[names.index("n_chars")]
                columns[names.index("n_chars")] = pa.array(
                    [len(t) if t is not None else o.as_py() for t, o in zip(texts, old, strict=True)], old.type
                )
            if spans:
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                columns.append(pa.array(places, kind))
            yield pa.RecordBatch.from_arrays(columns, [*names, *["entities"] * spans])

    extra = ["entities array<struct<kind:string,start:int,end:int>>"] if spans else []
    return rows.mapInArrow(run, ", ".join([*types, *extra]))
