"""Sampled segmentations over the piece lattice of a SentencePiece vocabulary, and lossless decoding.

Forward filtering computes, from the left, the total weight of all segmentations of each prefix; backward sampling
draws pieces from the right with probability in proportion to it. That gives exact samples of
``P(pieces) ~ product of piece weights``. The draws of a row are a hash of its key, so a segmentation is reproducible
on any number of executors.

No piece of the vocabulary reaches over the start of a space that follows another character, so the lattice of a text
is a chain of independent units (spaces, then a word). Units are filtered once per kind of unit and slice; the
backward draws of all their mentions run at once. The vocabulary's own scores are merge ranks; weights are made of them by
``weight(rank) = (rank + 10) ** -ALPHA``, the usual rank-frequency law; larger ``ALPHA`` gives fewer pieces. A
character without a piece is the sequence of its UTF-8 bytes, at the weight of the rarest piece for each. So is a
text's own ``▁``, which the vocabulary uses as the mark of a space: decoding is lossless for every text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.texts import column, mix, release, slices, text_batches

ALPHA = 2.0
MARK = "▁"
#: Bytes, about, that a worker keeps for units seen again, beyond which it starts anew, and text that it holds as units at one time.
#: Smaller ones change no result; they cost time and spare memory.
KEPT_BYTES, SLICE_BYTES = 128 << 20, 4 << 20
_UNIT = re.compile(" *[^ ]+| +")


#: Pieces up to this length are looked for at every place.
SHORT = 6
TABLE_BITS, SECOND = 20, 0xD6E8FEB86659FD93
_BASE = 0x9E3779B97F4A7C15


def reversed_hash(piece: str) -> int:
    """A 64-bit hash that grows by one character to the left."""
    h = 0
    for c in reversed(piece):
        h = (h * _BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class Vocabulary:
    """Pieces by text, their log weights, and the byte pieces of a model file."""

    def __init__(self, path: str, alpha: float = ALPHA):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = np.zeros(256, np.int32)
        self.of_byte: dict[int, int] = {}
        plain = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.of_byte[i] = int(piece[3:5], 16)
            elif not model.is_control(i) and not model.is_unknown(i):
                plain[piece.replace(MARK, " ")] = i
        self.ids = plain
        # Scores that are no rank count as the last one.
        ranks = {p: min(max(-model.get_score(i), 0.0), len(self.pieces)) for p, i in plain.items()}
        self.log = {p: -alpha * math.log(r + 10) for p, r in ranks.items()}
        self.byte_log = -alpha * math.log(len(self.pieces) + 10)
        self.longest = max(map(len, plain))
        # Two direct-mapped tables; a piece that finds its slot of the first one taken goes to the second.
        self.slots = np.full((2, 1 << TABLE_BITS), -1, np.int32)
        self.hash_of_id = np.zeros(len(self.pieces) + 1, np.uint64)
        for p, i in plain.items():
            h = reversed_hash(p)
            self.hash_of_id[i] = h
            at = [int(x[0]) for x in self._places(np.array([h], np.uint64))]
            table = 0 if self.slots[0, at[0]] < 0 else 1
            if self.slots[table, at[table]] >= 0:
                raise ValueError("the piece tables are too small")
            self.slots[table, at[table]] = i
        self.long_ends = np.zeros(1 << TABLE_BITS, bool)
        ends = np.array([reversed_hash(p[-SHORT:]) for p in plain if len(p) > SHORT], np.uint64)
        self.long_ends[self._places(ends)[0]] = True
        self.log_of_id = np.full(len(self.pieces) + 1, -np.inf)
        for p, i in plain.items():
            self.log_of_id[i] = self.log[p]
        spaced = [p for p in plain if " " in p.lstrip(" ")]
        if spaced:
            raise ValueError(f"pieces reach over word starts: {spaced[:3]}")

    @staticmethod
    def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        move, factor = np.uint64(64 - TABLE_BITS), np.uint64(SECOND)
        return (h * factor) >> move, ((h ^ (h >> np.uint64(29))) * factor) >> move

    def find(self, h: np.ndarray) -> np.ndarray:
        """The ids of pieces by hash, -1 where there is none."""
        one, two = self._places(h)
        first, second = self.slots[0][one], self.slots[1][two]
        return np.where(self.hash_of_id[first] == h, first, np.where(self.hash_of_id[second] == h, second, -1))


@lru_cache(maxsize=4)
def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    return Vocabulary(path, alpha)


def units(text: str) -> list[str]:
    """The units of a text, a space put in front; a single leading space is left out of the unit's name."""
    if not text:
        return []
    words = text.split(" ")
    if "" not in words:
        return words
    return [u[1:] if u[:1] == " " and u[1:2] not in ("", " ") else u for u in _UNIT.findall(" " + text)]


class Growing:
    """An array that is added to at its end; its room doubles, so what it holds is seldom copied."""

    def __init__(self, dtype):
        self.room, self.n = np.zeros(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            room = np.zeros(max(self.n + len(values), 2 * len(self.room)), self.room.dtype)
            room[: self.n] = self.held
            self.room = room
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def held(self) -> np.ndarray:
        return self.room[: self.n]


class Lattices:
    """The filtered lattices of distinct units, as flat arrays of draw states.

    State ``s`` is a place in a unit; a draw there takes the piece that ends at it and goes to the state where the
    piece begins (-1: the unit's start). The edges of state ``s`` hold ``s * 2**32`` plus their running probabilities in
    units of ``2**-32``: one search finds the draws of any number of states, and no draw depends on which other
    units are kept.
    """

    #: Longer units are filtered one by one.
    LONG = 48
    CELLS = 50_000

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.codes: dict[str, int] = {}
        self._cum, self._piece, self._target = Growing(np.int64), Growing(np.int32), Growing(np.int32)
        self._ends, self._first = Growing(np.int64), Growing(np.int64)
        self.states = self.chars = 0

    cum, piece, target = (property(lambda self, n=n: getattr(self, n).held) for n in ("_cum", "_piece", "_target"))
    ends, first = (property(lambda self, n=n: getattr(self, n).held) for n in ("_ends", "_first"))

    @property
    def bytes(self) -> int:
        """What is kept: arrays with their room, strings and their places in the dictionary."""
        arrays = (self._cum, self._piece, self._target, self._ends, self._first)
        return sum(x.room.nbytes for x in arrays) + 2 * self.chars + 180 * len(self.codes)

    def codes_of(self, found: list[list[str]]) -> np.ndarray:
        """The codes of all units; units not seen before are filtered."""
        unique = pa.array(list(chain.from_iterable(found)), pa.string()).dictionary_encode()
        codes, before = self.codes, len(self.codes)
        names = unique.dictionary.to_pylist()
        own = np.fromiter((codes.setdefault(u, len(codes)) for u in names), np.int64, len(names))
        if len(codes) > before:
            # New units got their numbers in the order of their names.
            self._add([u if u[:1] == " " else " " + u for u, c in zip(names, own.tolist(), strict=True) if c >= before])
        return own[unique.indices.to_numpy()]

    def _add(self, fresh: list[str]) -> None:
        lengths = np.array([len(u) for u in fresh], np.int64)
        base = self.states + np.cumsum(lengths) - lengths
        self.states += int(lengths.sum())
        self.chars += int(lengths.sum())
        self._ends.add(base + lengths - 1)
        parts = []
        order = np.argsort(lengths, kind="stable")
        short = order[lengths[order] <= self.LONG]
        at = 0
        while at < len(short):
            # Units of about one length; the arrays of a step hold CELLS places with all their pieces.
            width = int(lengths[short[min(at + 255, len(short) - 1)]])
            rows = short[at : at + max(256, self.CELLS // width)]
            at += len(rows)
            parts.append(self._filter([fresh[i] for i in rows], lengths[rows], base[rows]))
        for i in order[len(short) :]:
            parts.append(self._filter_long(fresh[i], int(base[i])))
        cum = np.concatenate([p[0] for p in parts])
        by_state = np.argsort(cum, kind="stable")
        edges = np.zeros(self.states - len(self.first), np.int64)
        np.add.at(edges, ((cum - 1) >> 32) - len(self.first), 1)
        self._first.add(len(self.cum) + np.cumsum(edges) - edges)
        self._cum.add(cum[by_state])
        self._piece.add(np.concatenate([p[1] for p in parts])[by_state])
        self._target.add(np.concatenate([p[2] for p in parts])[by_state])

    def _filter(self, found: list[str], lengths: np.ndarray, base: np.ndarray):
        """Forward filtering of many units at once: all places, by piece length."""
        vocab, n, width = self.vocab, len(found), int(lengths.max())
        flat = np.frombuffer("".join(u.ljust(width, "\0") for u in found).encode("utf-32-le"), np.uint32)
        chars = flat.reshape(n, width).astype(np.uint64)
        inside = np.arange(width) < lengths[:, None]
        depth = min(vocab.longest, width)
        ids = np.full((n, width, depth + 1), -1, np.int32)  # the last one stands for bytes
        h = np.zeros((n, width), np.uint64)
        for k in range(1, min(depth, SHORT) + 1):
            h = h[:, 1:] if k > 1 else h
            h = h * np.uint64(_BASE) + chars[:, : width - k + 1] + np.uint64(1)
            ids[:, k - 1 :, depth - k] = np.where(inside[:, k - 1 :], vocab.find(h), -1)
        if depth > SHORT:
            # Longer pieces only where their last characters stand.
            u, e = np.nonzero(vocab.long_ends[vocab._places(h)[0]] & inside[:, SHORT - 1 :])
            h, e = h[u, e], e + SHORT - 1
            for k in range(SHORT + 1, depth + 1):
                ok = e >= k - 1
                u, e, h = u[ok], e[ok], h[ok]
                h = h * np.uint64(_BASE) + chars[u, e - k + 1] + np.uint64(1)
                ids[u, e, depth - k] = vocab.find(h)
        raw = inside & (ids[:, :, depth - 1] < 0)
        size = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4)))
        weight = vocab.log_of_id[ids]
        ids[:, :, depth] = np.where(raw, -2 - chars.astype(np.int64), -1)
        weight[:, :, depth] = np.where(raw, size * vocab.byte_log, -np.inf)
        forward = np.full((n, width + depth), -np.inf)
        forward[:, depth - 1] = 0.0  # place 0 sits at column depth - 1
        share = np.zeros(weight.shape)
        for e in range(width):
            # Column j of the window begins a piece of length depth - j.
            value = weight[:, e, :] + np.concatenate([forward[:, e : e + depth], forward[:, e + depth - 1 : e + depth]], axis=1)
            top = value.max(axis=1)
            live = np.isfinite(top)
            sums = np.cumsum(np.exp(value - np.where(live, top, 0.0)[:, None]), axis=1)
            total = np.where(live, sums[:, -1], 1.0)
            share[:, e, :] = sums / total[:, None]
            forward[:, e + depth] = np.where(live, top + np.log(total), -np.inf)
        u, e, j = np.nonzero(ids != -1)
        state = base[u] + e
        part = (share[u, e, j] * 4294967296.0).astype(np.int64)
        last = np.append(state[1:] != state[:-1], True)
        part[last] = 1 << 32
        begin = e - np.where(j == depth, 0, depth - j - 1)
        return (state << 32) + part, ids[u, e, j], np.where(begin > 0, base[u] + begin - 1, -1)

    def _filter_long(self, unit: str, base: int):
        get, log, n, longest = self.vocab.ids.get, self.vocab.log, len(unit), self.vocab.longest
        forward = [0.0] * (n + 1)
        cum, piece, target = [], [], []
        for e in range(1, n + 1):
            edges = []
            for b in range(e - longest if e > longest else 0, e):
                i = get(unit[b:e])
                if i is not None:
                    edges.append((forward[b] + log[unit[b:e]], i, base + b - 1 if b else -1))
            c = unit[e - 1]
            if c not in self.vocab.ids:
                edges.append((forward[e - 1] + len(c.encode()) * self.vocab.byte_log, -2 - ord(c), base + e - 2 if e > 1 else -1))
            top = max(x[0] for x in edges)
            sums, total = [], 0.0
            for x in edges:
                total += math.exp(x[0] - top)
                sums.append(total)
            forward[e] = top + math.log(total)
            state = (base + e - 1) << 32
            cum.extend(state + int(w / total * 4294967296.0) for w in sums)
            cum[-1] = state + (1 << 32)
            piece.extend(x[1] for x in edges)
            target.extend(x[2] for x in edges)
        return np.array(cum, np.int64), np.array(piece, np.int64), np.array(target, np.int64)


    def draw(self, state: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The edge of each state that holds its number: the first with a larger running probability."""
        cum, edge, value = self.cum, self.first[state], (state << 32) + number
        late = np.flatnonzero(cum[edge] <= value)
        while len(late):
            edge[late] += 1
            late = late[cum[edge[late]] <= value[late]]
        return edge


def draw_number(key: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """32 random bits for the ``step``-th draw in the unit at ``place`` of the row with ``key``."""
    at = place.astype(np.uint64) + np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mix(key + mix(at)) >> np.uint64(32)).astype(np.int64)


def sample(texts: list[str], keys: np.ndarray, vocab: Vocabulary, lattices: Lattices | None = None) -> list[np.ndarray]:
    """Piece ids (int32) of one sampled segmentation per text; ``lattices`` may hold units from before."""
    lattices = Lattices(vocab) if lattices is None else lattices
    per_text = [units(t) for t in texts]
    sizes = np.array([len(u) for u in per_text], np.int64)
    codes = lattices.codes_of(per_text)
    del per_text
    if not len(codes):
        return [np.zeros(0, np.int32) for _ in texts]
    row = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[row]
    state, who = lattices.ends[codes], np.arange(len(codes))
    key = keys.astype(np.uint64)[row]
    drawn, owner, step = [], [], 0
    while len(who):
        edge = lattices.draw(state, draw_number(key[who], place[who], step))
        drawn.append(lattices.piece[edge])
        owner.append(who)
        state = lattices.target[edge].astype(np.int64)
        go = state >= 0
        who, state, step = who[go], state[go], step + 1
    pieces, owner = np.concatenate(drawn)[::-1], np.concatenate(owner)[::-1]
    order = np.argsort(owner, kind="stable")
    pieces, owner = pieces[order], owner[order]
    raw = np.flatnonzero(pieces < -1)
    if len(raw):
        found, which = np.unique(pieces[raw], return_inverse=True)
        spelled = [vocab.bytes[np.frombuffer(chr(-2 - int(c)).encode(), np.uint8)] for c in found]
        count = np.ones(len(pieces), np.int64)
        count[raw] = np.array([len(b) for b in spelled])[which]
        at = np.cumsum(count) - count
        owner, pieces = np.repeat(owner, count), np.repeat(pieces, count)
        for j, ids in enumerate(spelled):
            for k, i in enumerate(ids):
                pieces[at[raw[which == j]] + k] = i
    bounds = np.searchsorted(row[owner], np.arange(len(texts) + 1))
    pieces = pieces.astype(np.int32)
    return [pieces[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def decode(ids, vocab: Vocabulary) -> str:
    """The text that was segmented, whatever the segmentation."""
    out: list[bytes] = []
    for i in ids:
        byte = vocab.of_byte.get(int(i))
        out.append(bytes([byte]) if byte is not None else vocab.pieces[i].replace(MARK, " ").encode())
    return b"".join(out).decode()[1:]


def row_keys(doc_id, text, seed: int = 0) -> F.Column:
    """The key of a row's draws: its id, or its text where it has none."""
    return F.when(doc_id.isNull(), F.xxhash64(F.coalesce(text, F.lit("")), F.lit(seed))).otherwise(F.xxhash64(doc_id, F.lit(seed)))


def encode(
    docs: DataFrame, path: str, seed: int = 0, alpha: float = ALPHA, kept_bytes: int = KEPT_BYTES, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """(doc_id, pieces, n_pieces, pieces_crc32, lossless) per row of ``docs`` (doc_id, text).

    ``lossless`` tells that decoding gave back the whole text. Null and empty texts have no pieces. Rows that
    repeat both id and text get the same segmentation. The crc is of the ids as little-endian 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, alpha)
        lattices = Lattices(vocab)
        for batch in batches:
            for part in slices(batch, "text", slice_bytes, give_back=True):
                texts = [t or "" for t in column(part, "text").to_pylist()]
                ids = sample(texts, column(part, "key").to_numpy().view(np.uint64), vocab, lattices)
                if lattices.bytes > kept_bytes:
                    lattices = Lattices(vocab)
                sizes = np.array([len(i) for i in ids])
                flat = np.concatenate(ids) if len(ids) else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, "doc_id"),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat)),
                        pa.array(sizes.astype(np.int64)), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                        pa.array(_same(texts, ids, vocab), pa.bool_()),
                    ],
                    ["doc_id", "pieces", "n_pieces", "pieces_crc32", "lossless"],
                )
        lattices = vocab = None
        release()

    rows = text_batches(docs).select("doc_id", "text", row_keys(F.col("doc_id"), F.col("text"), seed).alias("key"))
    return rows.mapInArrow(run, "doc_id long, pieces array<int>, n_pieces long, pieces_crc32 long, lossless boolean")


def _same(texts: list[str], ids: list[np.ndarray], vocab: Vocabulary) -> list[bool]:
    spelled = _spellings(vocab)
    return [b"".join(spelled[i].tolist())[1:] == t.encode() for t, i in zip(texts, ids, strict=True)]


@lru_cache(maxsize=4)
def _spellings(vocab: Vocabulary) -> np.ndarray:
    """The bytes that each id stands for."""
    return np.array(
        [bytes([vocab.of_byte[i]]) if i in vocab.of_byte else p.replace(MARK, " ").encode() for i, p in enumerate(vocab.pieces)], object
    )


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (doc_id, pieces) with ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [decode(p or [], vocab) for p in column(batch, "pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
