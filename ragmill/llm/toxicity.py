"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier.

Voters are small word lists and patterns. Each votes "toxic" or abstains. A generative model with the unknown
label as hidden variable is fitted to how often each combination of votes occurs: it gives the voters'
accuracies, and a tree of their correlations per class (voters that hit together beyond what the label
explains do not count twice). Its posterior labels train a logistic classifier on votes and words, which is
brought to the scale of the given labels with two parameters.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragmill.llm.texts import column, text_batches
from ragmill.session import materialize

# The word lists of the voters.
LEXICONS: dict[str, str] = {
    "intellect": "idiot idiots moron morons stupid imbecile imbeciles dumb dumbass fool fools cretin dunce halfwit dimwit retard retarded",
    "failure": "loser losers worthless useless failure pathetic hopeless nobody",
    "filth": "trash scum garbage filth vermin filthy dirtbag scumbag lowlife parasite maggot pig pigs rat rats",
    "contempt": "disgusting disgrace revolting repulsive despicable contemptible",
    "ridicule": "clown clowns joke jerk jerks buffoon freak freaks weirdo ugly",
    "profanity": "fuck fucking fucked fucker shit shitty bullshit bitch bastard asshole crap damn cunt dick prick slut whore",
    "threat": "kill murder hurt beat destroy hang shoot rape burn",
    "hate": "hate hated subhuman inferior savages nazi deport exterminate",
    "german": "dummkopf trottel vollidiot arschloch scheisse scheiße hurensohn abschaum wertlos erbärmlich ekelhaft blödmann",
    "french": "imbécile crétin connard connasse salope merde putain débile abruti minable dégoûtant ordure",
    "spanish": "idiota imbécil estúpido estúpida mierda puta basura asqueroso inútil pendejo cabrón patético",
}
#: Patterns over the lower-cased text.
PATTERNS: dict[str, str] = {
    "address": r"\byou(?:'re| are)? (?:a |an |such a |so |fucking |all )*(?:idiot|moron|loser|stupid|pathetic|worthless|disgusting|clown|scum|trash|useless|dumb)",
    "dismissal": r"\bshut (?:the \w+ )?up\b|\bgo to hell\b|\bget lost\b|\bpiece of (?:trash|shit|garbage)\b",
    "spaced": r"\b(?:i[ .*_-]d[ .*_-]i[ .*_-]o[ .*_-]t|m[ .*_-]o[ .*_-]r[ .*_-]o[ .*_-]n|s[ .*_-]c[ .*_-]u[ .*_-]m)\b",
    "masked": r"\b(?:f[*@#u]{1,3}ck|sh[*@!#]t|b[*@!#]tch|id[1!*]ot|l[0*]ser|tr[@*]sh|st[*]pid|m[0*]ron)\b",
}
#: Voters mined from labelled rows: prefixes of words, grouped by their first letters.
MINED = 16
STEM, LONGEST = 4, 8
CANDIDATES, PRECISION = 200_000, 0.95
FIXED = len(LEXICONS) + len(PATTERNS)
#: The last voter speaks, for "clean", where all others abstain.
VOTERS = (*LEXICONS, *PATTERNS, *(f"mined{j}" for j in range(MINED)), "silence")
SILENCE = 1 << (len(VOTERS) - 1)
BUCKETS = 1 << 14
#: Rows on which the classifier is fitted, and labelled rows for its scale.
SAMPLE_ROWS = 6_000
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


@dataclass
class Voters:
    """What votes: words, patterns with plain substrings without which they can't match, and mined prefixes."""

    words: dict[str, int]
    patterns: list
    stems: dict[str, list[tuple[str, int]]]

    def __call__(self, text: str | None) -> tuple[int, set[str]]:
        """(votes as bits, distinct lower-case words) of a whole text; null counts as empty."""
        lower = (text or "").lower()
        found = set(_WORD.findall(lower))
        votes = 0
        for w in found & self.words.keys():
            votes |= self.words[w]
        if self.stems:
            for w in found:
                for prefix, bit in self.stems.get(w[:STEM], ()):
                    if w.startswith(prefix):
                        votes |= bit
        for bit, pattern, hints in self.patterns:
            if (not hints or any(h in lower for h in hints)) and pattern.search(lower):
                votes |= bit
        return votes or SILENCE, found


def voters(mined: list[list[str]] = ()) -> Voters:
    words: dict[str, int] = {}
    for j, text in enumerate(LEXICONS.values()):
        for word in text.split():
            words[word] = words.get(word, 0) | 1 << j
    hints = (("you",), ("shut", "go to hell", "get lost", "piece of"), (), ())
    patterns = [(1 << (len(LEXICONS) + j), re.compile(p), hints[j]) for j, p in enumerate(PATTERNS.values())]
    stems: dict[str, list[tuple[str, int]]] = {}
    for j, group in enumerate(mined):
        for prefix in group:
            stems.setdefault(prefix[:STEM], []).append((prefix, 1 << (FIXED + j)))
    return Voters(words, patterns, stems)


def prefixes(words) -> set[str]:
    return {w[:k] for w in words if len(w) >= STEM for k in range(STEM, min(len(w), LONGEST) + 1)}


def candidates(toxic: list[str], support: int = 4, most: int = CANDIDATES) -> list[str]:
    """Prefixes that several labelled toxic rows (strings of their words) share, the most frequent ones."""
    hits = Counter()
    for words in toxic:
        hits.update(prefixes(words.split()))
    support = max(support, len(toxic) // 500)
    return sorted((p for p, n in hits.items() if n >= support), key=lambda p: (-hits[p], p))[:most]


def mine(toxic: list[str], precise: set[str]) -> list[list[str]]:
    """Groups of the precise prefixes, those with the same first letters together.

    A greedy cover picks those that explain most toxic rows that no earlier one did.
    """
    rows: dict[str, set[int]] = {p: set() for p in precise}
    for i, words in enumerate(toxic):
        for p in prefixes(words.split()) & precise:
            rows[p].add(i)
    # Shorter prefixes first among equals: they cover forms not seen yet.
    good = sorted(precise, key=lambda p: (len(p), p))
    groups: dict[str, list[str]] = {}
    covered: set[int] = set()
    while good:
        gains = {p: len(rows[p] - covered) for p in good}
        best = max(good, key=lambda p: (gains[p], -len(p)))
        if gains[best] < 2 or (best[:STEM] not in groups and len(groups) == MINED):
            break
        groups.setdefault(best[:STEM], []).append(best)
        covered |= rows[best]
        good = [p for p in good if gains[p] >= 2 and not p.startswith(best)]
    for stem, group in groups.items():
        # All precise prefixes of a stem belong to its voter.
        group.extend(sorted(p for p in precise if p[:STEM] == stem and not any(p.startswith(g) for g in group)))
    return list(groups.values())


def buckets_of(found: set[str]) -> list[int]:
    """Hash buckets of the words that stand for more than one or two letters."""
    return sorted({zlib.crc32(w.encode()) % BUCKETS for w in found if len(w) > 2})


# --- generative label model -------------------------------------------------------------------


@dataclass
class LabelModel:
    """Class prior, per voter its parent in the correlation tree (-1: none), and P(vote | class, parent's vote)."""

    prior: float
    parent: list[int]
    table: np.ndarray  # voter, class, parent's vote (0 where there is none) -> P(vote = 1)
    label_says: tuple[float, float] = (0.01, 0.9)  # class -> P(given label = 1)

    def posterior(self, votes: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """P(toxic | votes, given label) for rows of 0/1 votes; a label of -1 says nothing."""
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        if known is not None:
            for c in (0, 1):
                said = self.label_says[c]
                log[:, c] += np.where(known < 0, 0.0, np.where(known == 1, math.log(said), math.log1p(-said)))
        for j, up in enumerate(self.parent):
            given = votes[:, up] if up >= 0 else np.zeros(len(votes), int)
            for c in (0, 1):
                p = self.table[j, c, given]
                # Who abstains says nothing: lists of other languages or topics have no part in a text.
                log[:, c] += np.where(votes[:, j] == 1, np.log(p), 0.0)
        log -= log.max(axis=1, keepdims=True)
        e = np.exp(log)
        return e[:, 1] / e.sum(axis=1)


def _tables(votes, weights, post, parent):
    table = np.zeros((votes.shape[1], 2, 2))
    for j, up in enumerate(parent):
        for c, q in ((0, 1 - post), (1, post)):
            for g in (0, 1):
                w = weights * q * ((votes[:, up] == g) if up >= 0 else 1)
                # A voter speaks rarely on clean rows (as firmly assumed as a fifth of all rows says), now and
                # then on toxic ones.
                a, b = ((0.0002 * weights.sum(), 0.2 * weights.sum()), (1.0, 3.0))[c]
                if j == len(parent) - 1:
                    a, b = ((0.95 * weights.sum(), 0.05 * weights.sum()), (1.0, 9.0))[c]
                table[j, c, g] = ((w * votes[:, j]).sum() + a) / (w.sum() + a + b)
    return table.clip(1e-6, 1 - 1e-6)


def _tree(votes, weights, post, least: float = 0.005) -> list[int]:
    """Chow-Liu: the strongest correlations inside the classes, as a forest."""
    m = votes.shape[1]
    strength = np.zeros((m, m))
    total = weights.sum()
    for q in (1 - post, post):
        w = weights * q
        n = max(w.sum(), 1e-9)
        for j in range(m):
            for k in range(j):
                for x in (0, 1):
                    for y in (0, 1):
                        pxy = (w * (votes[:, j] == x) * (votes[:, k] == y)).sum() / n
                        px, py = (w * (votes[:, j] == x)).sum() / n, (w * (votes[:, k] == y)).sum() / n
                        if pxy > 0:
                            strength[j, k] += n / total * pxy * math.log(pxy / (px * py))
    m -= 1  # silence has no companions
    parent, seen = [-1] * (m + 1), {0}
    while len(seen) < m:
        best = max(
            ((max(strength[j, k], strength[k, j]), j, k) for j in range(m) if j not in seen for k in seen),
            key=lambda t: (t[0], -t[1], -t[2]),
        )
        if best[0] >= least:
            parent[best[1]] = best[2]
        seen.add(best[1])
    return parent


def fit_label_model(
    masks: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, rounds: int = 60
) -> LabelModel:
    """Expectation maximisation over the distinct vote combinations and how many rows show each.

    ``known`` is a given label per combination (-1: none). It counts as one more voter, of an accuracy that is
    estimated with the others, as given labels err too.
    """
    m = len(VOTERS)
    if not len(masks):
        return LabelModel(0.1, [-1] * m, np.full((m, 2, 2), 0.5))
    votes = (masks[:, None] >> np.arange(m)) & 1
    weights = counts.astype(float)
    known = np.full(len(masks), -1) if known is None else known
    start = np.tile(np.array([[0.002], [0.2]]), (m, 1, 2))
    start[-1] = [[0.95], [0.1]]
    model = LabelModel(0.1, [-1] * m, start)
    for phase in range(2):
        for _ in range(rounds):
            post = model.posterior(votes, known)
            prior = float(((weights * post).sum() + 1) / (weights.sum() + 10))
            says = tuple(
                float(((weights * q)[known == 1].sum() + 20 * s) / ((weights * q)[known >= 0].sum() + 20))
                for q, s in ((1 - post, 0.01), (post, 0.9))
            )
            model = LabelModel(
                min(max(prior, 1e-4), 0.5), model.parent, _tables(votes, weights, post, model.parent), says
            )
        if phase == 0:
            post = model.posterior(votes, known)
            parent = _tree(votes, weights, post)
            model = LabelModel(model.prior, parent, _tables(votes, weights, post, parent), model.label_says)
    return model


# --- linear classifier ------------------------------------------------------------------------


@dataclass
class Classifier:
    bias: float
    vote_weights: np.ndarray
    word_weights: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    mined: tuple | list = ()

    def margin(self, votes: int, found: set[str]) -> float:
        total = self.bias + sum(w for j, w in enumerate(self.vote_weights) if votes >> j & 1)
        hit = buckets_of(found)
        if hit:
            total += float(self.word_weights[hit].sum()) / math.sqrt(len(hit))
        return total

    def score(self, votes: int, found: set[str]) -> float:
        z = self.scale * self.margin(votes, found) + self.shift
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_classifier(masks: np.ndarray, words: list, target: np.ndarray, steps: int = 300) -> Classifier:
    """Logistic regression on votes and word buckets against posterior labels (full gradient, momentum)."""
    m = len(VOTERS)
    votes = ((masks[:, None] >> np.arange(m)) & 1).astype(float)
    sizes = np.array([len(w) for w in words], int)
    flat = np.concatenate([np.asarray(w, int) for w in words]) if sizes.sum() else np.zeros(0, int)
    rows = np.repeat(np.arange(len(words)), sizes)
    value = 1 / np.sqrt(np.maximum(sizes, 1))[rows]
    a, b = np.zeros(m), np.zeros(BUCKETS)
    va, vb, c, vc = np.zeros(m), np.zeros(BUCKETS), -2.0, 0.0
    n = max(len(masks), 1)
    for _ in range(steps if len(masks) else 0):
        z = c + votes @ a + np.bincount(rows, b[flat] * value, minlength=len(masks))
        err = _sigmoid(z) - target
        ga = votes.T @ err / n + 1e-4 * a
        gb = np.bincount(flat, err[rows] * value, minlength=BUCKETS) / n + 1e-3 * b
        va, vb, vc = 0.9 * va - 1.5 * ga, 0.9 * vb - 1.5 * gb, 0.9 * vc - 0.5 * err.mean()
        a, b, c = a + va, b + vb, c + vc
    return Classifier(float(c), a, b)


def calibrate(model: Classifier, margins: np.ndarray, labels: np.ndarray) -> Classifier:
    """Scale and shift of the margin by the labels; as it is with too few labels of either kind."""
    if labels.sum() < 3 or (1 - labels).sum() < 3:
        return model
    centre, spread = margins.mean(), max(margins.std(), 1e-6)
    x = np.stack([(margins - centre) / spread, np.ones(len(margins))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (p - labels) + 1e-3 * (w - [1.0, 0.0]))
    if w[0] <= 0:
        return model
    scale = float(w[0] / spread)
    return replace(model, scale=scale, shift=float(w[1] - w[0] * centre / spread))


# --- Spark ------------------------------------------------------------------------------------

_HASH = "pmod(xxhash64(text, {id}), 1000003)"


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _mined(learn: DataFrame, known: DataFrame, sample_rows: int) -> list[list[str]]:
    """Mine the words of about ``sample_rows / 4`` labelled toxic rows.

    How precise a prefix is, is counted on about ``8 * sample_rows`` labelled rows of both kinds, inside the tasks. Both
    bounds are parameters; only prefixes and counts reach the driver.
    """
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}

    def part(salt: int, rows: float, total: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_003)) < int(1_000_003 * min(1.0, rows / max(total, 1)))

    def words_of(text: str | None) -> set[str]:
        return {w[:LONGEST] for w in _WORD.findall((text or "").lower())}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(sorted(words_of(t.as_py()))) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["words"])

    # The ids that are picked are as many as the bound of their sample.
    picked = known.filter("toxic = 1").filter(part(7, sample_rows / 4, counts.get(1, 0))).select("doc_id")
    toxic = sorted(learn.join(F.broadcast(picked), "doc_id").select("text").mapInArrow(words, "words string").toPandas()["words"])
    asked = {p: i for i, p in enumerate(candidates(toxic))}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, len(asked)), np.int64)
        for batch in batches:
            for text, label in zip(column(batch, "text"), column(batch, "toxic").to_pylist(), strict=True):
                for p in prefixes(words_of(text.as_py())) & asked.keys():
                    seen[label, asked[p]] += 1
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["i", "clean", "toxic"])

    counted = known.filter(part(8, 8 * sample_rows, sum(counts.values())))
    found = (
        learn.join(F.broadcast(counted), "doc_id").select("text", "toxic").mapInArrow(hits, "i long, clean long, toxic long")
        .groupBy("i").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    )
    sure = found[(found["toxic"] >= 3) & (found["toxic"] >= PRECISION * (found["toxic"] + found["clean"]))]
    names = list(asked)
    return mine(toxic, {names[i] for i in sure["i"]})


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """Fit on ``docs`` (doc_id, text) and the labels of the rows that are not held out.

    Vote combinations are counted over all rows. The classifier sees a hash sample of about ``sample_rows``
    rows, its scale one of as many labelled rows; both bounds are parameters. An empty table gives a model
    that scores by the prior.
    """
    learn = text_batches(docs).select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    known = (
        labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    n_rows, n_known = max(learn.count(), 1), max(known.count(), 1)
    mined = _mined(learn, known, sample_rows)
    part = F.expr(_HASH.format(id="doc_id"))
    marked = learn.select(
        "doc_id", "text",
        (part < F.lit(int(1_000_003 * min(1.0, sample_rows / n_rows)))).alias("sampled"),
        (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, sample_rows / n_known)))).alias("scaled"),
    )

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = voters(mined)
        for batch in batches:
            out = {"doc_id": [], "votes": [], "sampled": [], "buckets": []}
            counts: dict[int, int] = {}
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            sampled, scaled = column(batch, "sampled"), column(batch, "scaled")
            for i in range(batch.num_rows):
                mask, found = vote(texts[i].as_py())
                counts[mask] = counts.get(mask, 0) + 1
                if sampled[i].as_py() or scaled[i].as_py():
                    out["doc_id"].append(ids[i].as_py())
                    out["votes"].append(mask)
                    out["sampled"].append(sampled[i].as_py())
                    out["buckets"].append(buckets_of(found))
            rows = len(out["votes"])
            for mask, n in counts.items():
                out["doc_id"].append(None)
                out["votes"].append(mask)
                out["sampled"].append(False)
                out["buckets"].append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["doc_id"], pa.int64()), pa.array(out["votes"], pa.int64()),
                    pa.array(out["sampled"], pa.bool_()), pa.array(out["buckets"], pa.list_(pa.int32())),
                    pa.array([None] * rows + list(counts.values()), pa.int64()),
                ],
                ["doc_id", "votes", "sampled", "buckets", "n"],
            )

    seen = materialize(
        marked.mapInArrow(votes, "doc_id long, votes long, sampled boolean, buckets array<int>, n long")
    )
    # As many rows as there are combinations of votes, whatever the number of documents.
    combos = seen.filter("n is not null").groupBy("votes").agg(F.sum("n").alias("n")).toPandas()
    scale = (
        seen.filter("n is null and doc_id is not null").join(known, "doc_id")
        .filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, sample_rows / n_known))))
        .orderBy("doc_id", "votes").select("votes", "buckets", "toxic").toPandas()
    )
    said = scale.groupby(["votes", "toxic"]).size().reset_index(name="n")
    generative = fit_label_model(
        np.concatenate([combos["votes"], said["votes"]]).astype(np.int64),
        np.concatenate([combos["n"], said["n"]]).astype(float),
        np.concatenate([np.full(len(combos), -1), said["toxic"]]).astype(int),
    )
    rows = seen.filter("n is null and sampled").orderBy("votes", "doc_id").select("votes", "buckets").toPandas()
    masks = rows["votes"].to_numpy(np.int64)
    m = len(VOTERS)
    target = generative.posterior((masks[:, None] >> np.arange(m)) & 1) if len(masks) else np.zeros(0)
    model = replace(fit_classifier(masks, list(rows["buckets"]), target), mined=mined)
    margins = np.array([
        model.bias + sum(w for j, w in enumerate(model.vote_weights) if int(v) >> j & 1)
        + (float(model.word_weights[np.asarray(b, int)].sum()) / math.sqrt(len(b)) if len(b) else 0.0)
        for v, b in zip(scale["votes"], scale["buckets"], strict=True)
    ])
    return calibrate(model, margins, scale["toxic"].to_numpy(float)) if len(margins) else model


def score(docs: DataFrame, model: Classifier, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep``, and as ``name`` the score of the whole text of every row; null and empty texts get a score too."""
    names = list(keep)
    source = text_batches(docs).select(*names, F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = voters(model.mined)
        for batch in batches:
            # By place, so that no name can clash.
            scores = [model.score(*vote(t.as_py())) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64())], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*names).schema)
    return source.mapInArrow(run, f"{schema}, `{name}` double")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, in their own columns.

    Null and empty texts are scored like others, texts of any length whole; rows that repeat an id or a text are decided each on
    its own and alike. An empty table gives an empty one.
    """
    names, own = docs.columns, "score"
    while own.lower() in (n.lower() for n in names):
        own = f"_{own}"
    return score(docs, fit(docs, labels), tuple(names), own).filter(F.col(own) < threshold).select(*names)
