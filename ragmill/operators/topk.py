"""Batch top-k: many queries against a large corpus, without pairing every row.

The corpus is never shuffled or paired. A block of queries of proven size is
broadcast, every task keeps a running top-k per query over its own part of the
corpus, and only tasks x queries x k rows reach the final ranking. When there are
more queries than fit one block, both sides are cut into hash blocks and joined
block by block, so no task ever holds more than one query block and one corpus block.
Searches inside scopes have a key: both sides are grouped by scope.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragmill.session import materialize, spread

#: Rows of one query block. With 768 float64 values a block is about 25 MB.
QUERY_BLOCK_ROWS = 4096
#: Bytes one broadcast query block may take; wider rows get shorter blocks.
QUERY_BLOCK_BYTES = 64 << 20
#: Rows of one corpus block when both sides are blocked.
CORPUS_BLOCK_ROWS = 50_000
#: Bytes of one corpus block; long texts get shorter blocks.
CORPUS_BLOCK_BYTES = 256 << 20
#: Cells of one score matrix held at a time (float64).
SCORE_CELLS = 1 << 22
#: Entries that wait until they are ranked among those held.
WAITING = 1 << 14
#: Tiles of queries of one group when both sides are blocked.
QUERY_TILES = 32
#: Scores are compared at this many decimals, so that ties do not hang on fold order.
TIE_DECIMALS = 9

SCOPE_ANY = ""


class TopK:
    """Running top-k per query row, ordered by score desc, id asc."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.floor = np.full(rows, -np.inf)
        self.row = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.id = None
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def offer(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Offers wait until there are as many as are held, so that many small ones cost no more than a large one."""
        if len(row) == 0:
            return
        self.waiting.append((row, score, ids))
        self.n_waiting += len(row)
        if self.n_waiting >= max(WAITING, len(self.row)):
            self.fold()

    def fold(self) -> None:
        if not self.waiting:
            return
        held = [] if self.id is None else [(self.row, self.score, self.id)]
        row, score, ids = map(np.concatenate, zip(*held, *self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        starts = np.searchsorted(row, row, side="left")
        keep = np.arange(len(row)) - starts < self.k
        self.row, self.score, self.id = row[keep], score[keep], ids[keep]
        counts = np.bincount(self.row, minlength=len(self.floor))
        ends = np.cumsum(counts) - 1
        full = counts == self.k
        self.floor[full] = self.score[ends[full]]

    def offer_matrix(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer a (rows x ids) score block, dropping what cannot enter the top-k."""
        floor = self.floor[rows]
        if scores.shape[1] > self.k:
            kth = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            floor = np.maximum(floor, kth)
        at, col = np.nonzero(scores >= floor[:, None])
        self.offer(rows[at], scores[at, col], ids[col])

    def table(self, query_ids: pa.Array, id_type: pa.DataType) -> pa.Table:
        ids = pa.array([] if self.id is None else self.id, id_type)
        return pa.table({"query_id": query_ids.take(pa.array(self.row)), "id": ids, "score": pa.array(self.score, pa.float64())})


def _ids(column) -> np.ndarray:
    values = np.asarray(column)
    return values.astype(str) if values.dtype == object else values


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal sizes as a float64 matrix; non-finite values become 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.where(np.isfinite(flat), flat, 0.0)
    return flat.reshape(len(column), -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / norms[:, None]


class VectorBlock:
    """Query vectors of one block, grouped by scope."""

    def __init__(self, table: pa.Table):
        self.query_ids = table["query_id"].combine_chunks()
        self.unit = _unit(_matrix(table["payload"].combine_chunks()))
        self.by_scope = _rows_by_scope(table)

    def offer(self, top: TopK, ids: np.ndarray, scopes: list[np.ndarray], payload: pa.Array):
        vectors = _unit(_matrix(payload))
        known = not (np.isnan(vectors).any() or np.isnan(self.unit).any())
        for _, rows, cols in _matching(self.by_scope, scopes, len(ids)):
            step = max(1, SCORE_CELLS // max(1, len(rows)))
            for start in range(0, len(cols), step):
                part = cols[start : start + step]
                scores = self.unit[rows] @ vectors[part].T
                floor = top.floor[rows]
                if known and np.isfinite(floor).all():
                    # Only what can still enter is rounded; a hair below may round up to the k-th score.
                    at, col = np.nonzero(scores >= (floor - 10.0**-TIE_DECIMALS)[:, None])
                    top.offer(rows[at], np.round(scores[at, col], TIE_DECIMALS), ids[part[col]])
                    continue
                scores = np.round(scores, TIE_DECIMALS)
                # A zero vector has no direction: it ranks after everything else.
                scores = np.where(np.isnan(scores), -2.0, scores)
                top.offer_matrix(rows, scores, ids[part])


class GramIndex:
    """2-gram sets of one query block as an index over the distinct 2-grams, per scope.

    A 2-gram that few queries hold has a list of them; only those that more than one in ``SPARSE`` hold have a row of
    flags. The rows are fewer than ``SPARSE`` times the mean set, whatever the alphabet, so the index grows with the sets of
    its queries and not with their number times the vocabulary. Documents are counted many at a time.
    """

    SPARSE = 32

    def __init__(self, table: pa.Table, min_sim: float):
        self.query_ids = table["query_id"].combine_chunks()
        self.by_scope = _rows_by_scope(table)
        self.min_sim = min_sim
        sets = [self.codes(t) for t in table["payload"].to_pylist()]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.parts = {scope: self._part([sets[r] for r in rows]) for scope, rows in self.by_scope.items()}

    def codes(self, text: str | None) -> np.ndarray:
        return bigram_codes(text)

    def similarity(self, common: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """common / larger set, as in ``functions.bigrams.set_similarity``."""
        return common / np.maximum(sizes, lengths)

    def _part(self, sets: list[np.ndarray]):
        """(2-grams, row of flags or -1 by 2-gram, flags, starts of lists by 2-gram, lists) for the queries of a scope."""
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        grams, code = np.unique(flat, return_inverse=True)
        order = np.argsort(code, kind="stable")
        gram, who = code[order], owner[order]
        held = np.bincount(gram, minlength=len(grams))
        often = held * self.SPARSE > len(sets)
        row = np.where(often, np.cumsum(often) - 1, -1)
        flags = np.zeros((int(often.sum()), len(sets)), np.uint8)
        flags[row[gram[often[gram]]], who[often[gram]]] = 1
        starts = np.concatenate([[0], np.cumsum(np.where(often, 0, held))])
        return grams, row, flags, starts, who[~often[gram]]

    def _common(self, part, at: np.ndarray, doc: np.ndarray, n: int, wide: int) -> np.ndarray:
        """How many 2-grams each of ``n`` documents shares with each query."""
        _, row, flags, starts, lists = part
        common = np.zeros((n, wide), np.int32)
        often = row[at] >= 0
        if often.any():
            rows, own = row[at[often]], doc[often]
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            common[own[cuts]] = np.add.reduceat(flags[rows], cuts, axis=0, dtype=np.int32)
        rare, own = at[~often], doc[~often]
        length = starts[rare + 1] - starts[rare]
        if length.sum():
            before = np.cumsum(length) - length
            who = lists[np.repeat(starts[rare] - before, length) + np.arange(length.sum())]
            common += np.bincount(np.repeat(own, length) * wide + who, minlength=n * wide).reshape(n, wide).astype(np.int32)
        return common

    def offer(self, top: TopK, ids: np.ndarray, scopes: list[np.ndarray], payload: pa.Array):
        sets = [self.codes(t) for t in payload.to_pylist()]
        lengths = np.array([len(s) for s in sets], np.int64)
        widest, least = self.sizes.max(initial=0), self.sizes.min(initial=0)
        for scope, rows, cols in _matching(self.by_scope, scopes, len(ids)):
            sizes, grams = self.sizes[rows], self.parts[scope][0]
            if not len(grams):
                continue
            # common / larger set >= t is impossible once the sizes differ that much.
            cols = cols[(lengths[cols] > 0) & (lengths[cols] * self.min_sim <= widest) & (least * self.min_sim <= lengths[cols])]
            cells = np.cumsum(lengths[cols] * len(rows))
            start = 0
            while start < len(cols):
                stop = max(start + 1, int(np.searchsorted(cells, (cells[start - 1] if start else 0) + SCORE_CELLS, side="right")))
                own = cols[start:stop]
                doc = np.repeat(np.arange(len(own)), lengths[own])
                codes = np.concatenate([sets[c] for c in own])
                at = np.searchsorted(grams, codes)
                at[at == len(grams)] = 0
                known = grams[at] == codes
                common = self._common(self.parts[scope], at[known], doc[known], len(own), len(rows))
                sims = self.similarity(common, sizes[None, :], lengths[own][:, None])
                hit, query = np.nonzero((common > 0) & (sims >= self.min_sim) & (sims >= top.floor[rows][None, :]))
                top.offer(rows[query], sims[hit, query], ids[own[hit]])
                start = stop


#: Names that are searched as one block, queries that search it, and how many names side by side have one bit for each 2-gram.
NAME_ROWS, NAME_QUERIES, NAMES_A_BIT = 1 << 19, 1 << 16, 8
#: Below so many names it takes longer to look for groups than to compare them all.
FEW_NAMES = 30_000


class BitCounter:
    """For every 2-gram, which groups have it, as bits: a 64-bit word stands for 64 groups.

    A 2-gram in many words has a bitmap, one in few of them has these words alone, so all of it grows with the sets of the groups.
    """

    DENSE = 8

    def __init__(self, gram: np.ndarray, group: np.ndarray, n_grams: int, n_groups: int):
        self.words = wide = max(1, -(-n_groups // 64))
        key = np.sort(gram * (wide * 64) + group)
        word = key >> 6
        cuts = np.flatnonzero(np.diff(word, prepend=-1))
        self.values = np.bitwise_or.reduceat(np.uint64(1) << (key & 63).astype(np.uint64), cuts) if len(cuts) else np.zeros(0, np.uint64)
        owner, self.at = word[cuts] // wide, word[cuts] % wide
        self.starts = np.searchsorted(owner, np.arange(n_grams + 1))
        many = np.diff(self.starts) * self.DENSE > wide
        self.row = np.where(many, np.cumsum(many) - 1, -1).tolist()
        self.maps = np.zeros((int(many.sum()), wide), np.uint64)
        dense = many[owner]
        self.maps[np.asarray(self.row)[owner[dense]], self.at[dense]] = self.values[dense]

    def _bits(self, gram: int) -> np.ndarray:
        if self.row[gram] >= 0:
            return self.maps[self.row[gram]]
        part, bits = slice(self.starts[gram], self.starts[gram + 1]), np.zeros(self.words, np.uint64)
        bits[self.at[part]] = self.values[part]
        return bits

    def digits(self, grams: list[int]) -> list[np.ndarray]:
        """How many of ``grams`` each group has, as binary digits, the lowest first: full adders over the bitmaps."""
        level, out = [self._bits(g) for g in grams], []
        while level:
            carries = []
            while len(level) > 1:
                x, y = level.pop(), level.pop()
                total, carry = x ^ y, x & y
                if level:
                    z = level.pop()
                    carry |= total & z
                    total ^= z
                level.append(total)
                carries.append(carry)
            out.append(level[0])
            level = carries
        return out

    def with_count(self, digits: list[np.ndarray], count: int) -> np.ndarray:
        """The groups that have just so many."""
        held = None
        for place, digit in enumerate(digits):
            digit = digit if count >> place & 1 else ~digit
            held = digit if held is None else held & digit
        words = np.flatnonzero(held)
        bit = np.flatnonzero(np.unpackbits(held[words].view(np.uint8), bitorder="little").view(bool))
        return words[bit >> 6] * 64 + (bit & 63)


class NameIndex(GramIndex):
    """The same over names: 2-grams without padding, common / union as in ``functions.bigrams.set_jaccard``.

    For the nearest name alone, names are sorted and stand in small groups of one size and of like texts. What a query has in
    common with a group is no less than what it has in common with a name of it, so groups are counted as bits and their names are
    compared from the highest count down, as long as a name of a group can reach the best so far.
    """

    ROWS = NAME_ROWS

    def __init__(self, table: pa.Table, min_sim: float):
        self.query_ids = table["query_id"].combine_chunks()
        self.by_scope = _rows_by_scope(table)
        self.table, self.min_sim, self.parts = table, min_sim, None
        self.flat, self.starts = name_codes(table["payload"].to_pylist())
        self.sizes = np.diff(self.starts)
        self.grams, self.asked = np.unique(self.flat, return_inverse=True)

    def codes(self, text: str | None) -> np.ndarray:
        points = _points(text)
        return np.unique(points[:-1] << 21 | points[1:])

    def similarity(self, common: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return common / (sizes + lengths - common)

    def offer(self, top: TopK, ids: np.ndarray, scopes: list[np.ndarray], payload: pa.Array):
        if top.k > 1 or len(ids) < FEW_NAMES:
            return self._offer_few(top, ids, scopes, payload)
        texts = payload.to_pylist()
        by_text = np.array(sorted(range(len(texts)), key=lambda i: texts[i] or ""), np.int64)
        for _, rows, cols in _matching(self.by_scope, scopes, len(ids)):
            asked = np.zeros(len(ids), bool)
            asked[cols] = True
            cols = by_text[asked[by_text]]
            for start in range(0, len(cols), NAME_ROWS):
                own = cols[start : start + NAME_ROWS]
                self._offer(top, rows[self.sizes[rows] > 0], ids[own], [texts[i] for i in own])

    def _offer_few(self, top: TopK, ids: np.ndarray, scopes: list[np.ndarray], payload: pa.Array):
        """Names are short, so common 2-grams are counted in bytes; a pair is scored only where they are enough for the top-k."""
        if self.parts is None:
            super().__init__(self.table, self.min_sim)
        sets = [self.codes(t) for t in payload.to_pylist()]
        lengths = np.array([len(s) for s in sets], np.int64)
        if max(lengths.max(initial=0), self.sizes.max(initial=0)) > np.iinfo(np.uint8).max:
            return super().offer(top, ids, scopes, payload)
        for scope, rows, cols in _matching(self.by_scope, scopes, len(ids)):
            sizes, (grams, row, flags, starts, lists) = self.sizes[rows], self.parts[scope]
            step = max(1, SCORE_CELLS // max(1, len(rows)))
            for length in np.unique(lengths[cols][lengths[cols] > 0]) if len(grams) else ():
                alike = cols[lengths[cols] == length]
                for start in range(0, len(alike), step):
                    own = alike[start : start + step]
                    floor = np.maximum(top.floor[rows], self.min_sim)
                    # common / union >= floor; a hair less, as this is rounded otherwise than the score.
                    need = np.maximum(np.ceil(floor * (sizes + length) / (1 + floor) - 1e-6), 1)
                    codes = np.stack([sets[c] for c in own])
                    at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
                    known = grams[at] == codes
                    common = np.zeros((len(own), len(rows)), np.uint8)
                    for doc, place in zip(*np.nonzero(known), strict=True):
                        gram = at[doc, place]
                        if row[gram] >= 0:
                            common[doc] += flags[row[gram]]
                        else:
                            common[doc, lists[starts[gram] : starts[gram + 1]]] += 1
                    hit, query = np.nonzero(common >= np.minimum(need, 255).astype(np.uint8))
                    sims = self.similarity(common[hit, query].astype(np.int64), sizes[query], length)
                    enough = sims >= floor[query]
                    top.offer(rows[query[enough]], sims[enough], ids[own[hit[enough]]])
                    top.fold()

    def _offer(self, top: TopK, rows: np.ndarray, ids: np.ndarray, texts: list[str | None]) -> None:
        flat, starts = name_codes(texts)
        lengths = np.diff(starts)
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        if not len(order) or not len(rows):
            return
        ids, starts, lengths = ids[order], starts[order], lengths[order]
        # The 2-grams that queries have too, name by name.
        place = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        gram = np.minimum(np.searchsorted(self.grams, flat[place]), len(self.grams) - 1)
        known = self.grams[gram] == flat[place]
        gram, doc = gram[known], np.repeat(np.arange(len(order)), lengths)[known]
        begin = np.searchsorted(doc, np.arange(len(order) + 1))
        # The names of a group differ in size only where one size ends and the next begins.
        shortest = lengths[::NAMES_A_BIT]
        bits = BitCounter(gram, doc // NAMES_A_BIT, len(self.grams), len(shortest))
        present, mark = np.diff(bits.starts) > 0, np.zeros(len(self.grams), bool)
        found: list[tuple[int, float, int]] = []
        for row in rows.tolist():
            size, floor, best = int(self.sizes[row]), max(float(top.floor[row]), self.min_sim), None
            mine = self.asked[self.starts[row] : self.starts[row + 1]]
            mine = mine[present[mine]]
            digits, least = bits.digits(mine.tolist()), int(shortest[0])
            mark[mine] = True
            for common in range(len(mine), 0, -1):
                if common / (size + max(least, common) - common) < floor:
                    break
                groups = bits.with_count(digits, common)
                if len(groups):
                    groups = groups[common / (size + np.maximum(shortest[groups], common) - common) >= floor]
                for at in range(0, len(groups), 1 << 12):
                    docs = (groups[at : at + (1 << 12), None] * NAMES_A_BIT + np.arange(NAMES_A_BIT)).ravel()
                    docs = docs[docs < len(order)]
                    wide = begin[docs + 1] - begin[docs]
                    ends = np.cumsum(wide)
                    hit = np.concatenate([[0], np.cumsum(mark[gram[np.arange(ends[-1]) + np.repeat(begin[docs] - (ends - wide), wide)]])])
                    both = hit[ends] - hit[ends - wide]
                    sims = both / (size + lengths[docs] - both)
                    sim = sims.max()
                    if both.any() and sim >= floor:
                        near = docs[sims == sim]
                        near = near[np.argmin(ids[near])] if ids.dtype.kind != "U" else min(near.tolist(), key=ids.__getitem__)
                        if best is None or sim > best[0] or ids[near] < ids[best[1]]:
                            floor, best = float(sim), (float(sim), int(near))
            mark[mine] = False
            if best is not None:
                found.append((row, *best))
        if found:
            row, sim, near = zip(*found)
            top.offer(np.array(row, np.int64), np.array(sim), ids[list(near)])
            top.fold()


#: Whitespace of the 2-gram measure: that of ``functions.text.WS``.
_SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def name_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 2-grams of every text without padding, as ``NameIndex.codes``, one text after the other, and where each begins."""
    texts = [t or "" for t in texts]
    points = _points("".join(texts))
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    both = owner[:-1] == owner[1:]
    codes, owner = (points[:-1] << 21 | points[1:])[both], owner[:-1][both]
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    kept = np.ones(len(codes), bool)
    kept[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    return codes[kept], np.searchsorted(owner[kept], np.arange(len(texts) + 1))


def bigram_codes(text: str | None) -> np.ndarray:
    """Distinct 2-grams of a text as sorted integers (two code points each).

    Words are separated and surrounded by one space, as in ``functions.bigrams.padded``.
    """
    points = _points(text)
    padded = np.concatenate([[32], np.where(np.isin(points, _SPACES), 32, points), [32]])
    kept = padded[np.concatenate([[True], (padded[1:] != 32) | (padded[:-1] != 32)])]
    return np.unique(kept[:-1] << 21 | kept[1:])


def _rows_by_scope(table: pa.Table) -> dict[str, np.ndarray]:
    scopes = pd.Series(table["scope"].to_pandas())
    return {s: np.asarray(ix, dtype=np.int64) for s, ix in scopes.groupby(scopes).indices.items()}


def _matching(by_scope, scopes, n: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(scope, query rows, corpus positions) that share a scope."""
    if SCOPE_ANY in by_scope:
        yield SCOPE_ANY, by_scope[SCOPE_ANY], np.arange(n)
    for column in scopes:
        for scope, cols in pd.Series(column).groupby(column).indices.items():
            rows = by_scope.get(scope)
            if rows is not None:
                yield scope, rows, np.asarray(cols)


def _together(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows, where a block is made for many at once; fewer where they are wide."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= CORPUS_BLOCK_BYTES:
            yield pa.concat_batches(held) if len(held) > 1 else batch
            held = []
    if held:
        yield pa.concat_batches(held)


def _search(blocks_of: Callable, k: int, n_scopes: int) -> Callable:
    """The task body: stream corpus batches, keep a running top-k, emit it once."""

    def run(batches: Iterable[pa.RecordBatch], query_table: pa.Table) -> pa.Table | None:
        block, id_type = blocks_of(query_table), None
        top = TopK(len(block.query_ids), k)
        for batch in _together(batches, getattr(block, "ROWS", 0)):
            if batch.num_rows:
                id_type = batch.column("id").type
                ids = _ids(batch.column("id").to_pandas())
                scopes = [np.asarray(batch.column(f"scope_{i}").to_pandas(), dtype=object) for i in range(n_scopes)]
                block.offer(top, ids, scopes, batch.column("payload"))
        top.fold()
        return top.table(block.query_ids, id_type) if top.id is not None else None

    return run


def _block_rows(queries: DataFrame) -> int:
    """Query rows to try as one block; long texts get shorter blocks."""
    if isinstance(queries.schema["payload"].dataType, T.ArrayType):
        return QUERY_BLOCK_ROWS
    widest = queries.agg(F.max(F.octet_length("payload"))).first()[0] or 1
    return max(1, min(QUERY_BLOCK_ROWS, QUERY_BLOCK_BYTES // (widest * 16)))


def batch_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    blocks_of: Callable,
    n_scopes: int = 0,
    query_rows: int | None = None,
    corpus_rows: int = CORPUS_BLOCK_ROWS,
    pruned: bool = False,
) -> DataFrame:
    """Exact top-k per query: (query_id, rank, id, score).

    ``queries`` has (query_id, scope, payload), ``corpus`` has (id, payload,
    scope_0..). Without corpus scopes every query searches the whole corpus. With them the two sides meet by scope, and
    corpus rows of a scope that no query names are not shuffled. ``pruned`` tells that most of ``corpus`` is asked for:
    then a block of queries goes to the rows, which are not shuffled at all.
    """
    block_rows = query_rows or _block_rows(queries)
    id_type = corpus.schema["id"].dataType.simpleString()
    qid_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qid_type}, id {id_type}, score double"

    head = None
    if pruned or not n_scopes:
        run = _search(blocks_of, k, n_scopes)
        head = queries.limit(block_rows + 1).toArrow()
        if head.nbytes > QUERY_BLOCK_BYTES:
            block_rows = max(1, head.num_rows * QUERY_BLOCK_BYTES // head.nbytes // 2)
    if n_scopes and (head is None or head.num_rows > block_rows):
        partial = _by_scope(queries, corpus, k, blocks_of, n_scopes, schema, block_rows, corpus_rows)
    else:
        if head.num_rows <= block_rows:
            shared = queries.sparkSession.sparkContext.broadcast(head)

            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                if not shared.value.num_rows:  # nobody asks
                    return
                found = run(batches, shared.value)
                if found is not None:
                    yield from found.to_batches()

            partial = (corpus if n_scopes else spread(corpus)).mapInArrow(scan, schema)
        else:
            partial = _blocked(queries, corpus, run, schema, block_rows, corpus_rows)

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    if n_scopes:
        # A query that names several scopes may meet a row in each of them; the other search never repeats one.
        partial = partial.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", F.when(F.col("score") > -1.5, F.col("score")).alias("score"))
    )


def _by_scope(queries, corpus, k, blocks_of, n_scopes, schema, block_rows, corpus_rows) -> DataFrame:
    """Both sides grouped by scope. Scopes above a block's size are cut: their corpus rows lie in blocks, and only
    their own queries are copied to them; many queries of one scope are cut likewise. Small scopes share a block, so that
    there are as many groups as the rows ask for and not as many as there are scopes."""
    run = _search(blocks_of, k, 1)
    placed = corpus.select("id", "payload", F.explode(F.array_distinct(F.array_compact(F.array(*[f"scope_{i}" for i in range(n_scopes)])))).alias("scope"))
    asked = queries.groupBy("scope").agg(F.count(F.lit(1)).alias("asked"))
    is_vector = isinstance(corpus.schema["payload"].dataType, T.ArrayType)
    width = F.size("payload") * 8 if is_vector else F.octet_length("payload")
    sizes = materialize(
        placed.groupBy("scope").agg(F.count(F.lit(1)).alias("rows"), F.sum(width.cast("long")).alias("bytes")).join(asked, "scope")
        .withColumn("q_blocks", F.ceil(F.col("asked") / block_rows).cast("int"))
        .withColumn("c_blocks", F.ceil(F.greatest(F.col("rows") / corpus_rows, F.col("bytes") / CORPUS_BLOCK_BYTES)).cast("int"))
    )
    own_block = (F.col("q_blocks") > 1) | (F.col("c_blocks") > 1)
    small = sizes.filter(~own_block).agg(F.sum("rows"), F.sum("bytes"), F.sum("asked")).first()
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = max(parts, *(math.ceil((n or 0) / most) for n, most in zip(small, (corpus_rows, CORPUS_BLOCK_BYTES, block_rows), strict=True)))
    place = F.when(own_block, F.concat(F.lit("s"), "scope")).otherwise(F.pmod(F.xxhash64("scope"), F.lit(shared)).cast("string"))

    def placed_as() -> DataFrame:  # columns of its own for either side
        return sizes.select("scope", *[F.col(c).alias(c) for c in ("q_blocks", "c_blocks")], place.alias("place"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def own(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    # Queries and sizes are keyed by scope as well, so a scope's rows are found by an equi-join.
    right = (
        placed.join(placed_as(), "scope").withColumn("cb", own("id", "c_blocks")).withColumn("qb", every("q_blocks"))
        .select("place", "cb", "qb", "id", F.col("scope").alias("scope_0"), "payload")
    )
    left = (
        queries.join(placed_as(), "scope").withColumn("qb", own("query_id", "q_blocks")).withColumn("cb", every("c_blocks"))
        .select("place", "cb", "qb", "query_id", "scope", "payload")
    )

    def meet(qs: pa.Table, cs: pa.Table) -> pa.Table:
        found = run(cs.combine_chunks().to_batches(), qs) if qs.num_rows and cs.num_rows else None
        if found is None:
            return pa.table({"query_id": qs["query_id"][:0], "id": cs["id"][:0], "score": pa.array([], pa.float64())})
        return found

    keys = ("place", "qb", "cb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)


def _blocked(queries, corpus, run, schema, block_rows, corpus_rows) -> DataFrame:
    """Both sides in hash blocks; one task meets one query block and one corpus block.

    Every row is copied once for each block of the other side, so blocks are as large as their bytes allow, as long as
    there are pairs of blocks for all cores. The queries of a pair are searched tile by tile.
    """
    is_vector = isinstance(corpus.schema["payload"].dataType, T.ArrayType)
    width = F.size("payload") * 8 if is_vector else F.octet_length("payload")
    (asked, asked_size), (rows, size) = (
        side.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first() for side in (queries, corpus)
    )
    c_blocks = max(1, math.ceil(rows / corpus_rows), math.ceil(size / CORPUS_BLOCK_BYTES))
    tiles = max(1, math.ceil(asked / block_rows))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    least = max(math.ceil(tiles / QUERY_TILES), math.ceil(asked_size / QUERY_BLOCK_BYTES), math.ceil(4 * cores / c_blocks))
    q_blocks = min(max(tiles, math.ceil(asked / QUERY_BLOCK_ROWS)), least)

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id", "scope"), F.lit(q_blocks)).cast("int"))
    right = corpus.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(c_blocks)).cast("int"))
    # So many partitions that hardly two pairs share one; Spark would join small ones, though a pair takes long whatever its bytes.
    parts = 8 * q_blocks * c_blocks
    left = left.withColumn("cb", every(c_blocks)).repartition(parts, "qb", "cb")
    right = right.withColumn("qb", every(q_blocks)).repartition(parts, "qb", "cb")

    def meet(qs: pa.Table, cs: pa.Table) -> pa.Table:
        batches = cs.combine_chunks().to_batches() if qs.num_rows else []
        found = [run(batches, qs.slice(start, block_rows)) for start in range(0, qs.num_rows, block_rows)] if batches else []
        none = pa.table({"query_id": qs["query_id"][:0], "id": cs["id"][:0], "score": pa.array([], pa.float64())})
        return pa.concat_tables([none, *(f for f in found if f is not None)])

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(meet, schema)
