"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad.  Its features are shares of character classes, the repetition
of its words, whether the line occurred before in its document, and the same of the line before
and the line after it.  Forward-backward gives each line's probability of being good under a
chain with learned transitions; the mean of these, weighted by the lines' lengths, is the
document's raw quality, and a logistic curve fitted on rows that the chain hasn't seen makes it a
probability.  Labels are of documents, so a fitted document's lines carry its label.

A document's text goes through one task in slices of lines (``SLICE`` bytes); a line of more than
``LONGEST`` bytes is cut at white space into several.  No row leaves its task: scoring has no
shuffle, and the model, a few hundred numbers, is bound to the task.

The fit takes at most ``sample`` labelled documents (half for the chain, half for the curve) of
at most ``FIT_CHARS`` characters, chosen by a hash of their ids, and never an id whose
crc32(id as text) mod 4 is 2.  Labels, languages, sources and ids are no inputs of a score.

Null texts are empty.  Texts without a word have no lines: their score is the share of good
documents in the fit.  Without any labelled document the score is 0.5; with labels of one kind
only it is that share too.  Documents labelled twice count by their lowest label, null labels
not at all.  Null ids are never held out; repeated rows get equal scores; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that are fitted, and the longest of them.
SAMPLE = 4000
FIT_CHARS = 20_000
#: Bytes of text whose words are looked at together, and of the longest line.
SLICE = 1 << 20
LONGEST = 1 << 13
#: A document counts as good from here on.
GOOD = 0.7

LETTER, UPPER, DIGIT, SYMBOL, STOP, OTHER, SPACE = range(7)
KINDS = np.full(256, SYMBOL, np.uint8)
for _chars, _kind in ((range(97, 123), LETTER), (range(65, 91), UPPER), (range(48, 58), DIGIT), (b".,;:?!", STOP), (b"'\"-()", LETTER), (range(128, 256), OTHER), ([*range(9, 14), 32], SPACE)):
    KINDS[list(_chars)] = _kind
OWN = 15
#: Features of a line: its own, those of the line before and behind (after whether there is one), and one that is always 1.
FEATURES = 3 * OWN + 3

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; kept for the slice size."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def lines_of(data: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's lines; long ones are cut at white space (or where there is none in reach, anywhere)."""
    breaks = np.flatnonzero(data[low:high] == 10) + low
    starts, ends = np.concatenate([[low], breaks + 1]), np.concatenate([breaks, [high]])
    if (ends - starts).max(initial=0) > LONGEST:
        cuts = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            while b - a > LONGEST:
                white = np.flatnonzero(KINDS[data[a + LONGEST // 2 : a + LONGEST]] == SPACE)
                cut = a + LONGEST // 2 + int(white[-1]) if len(white) else a + LONGEST
                cuts.append((a, cut))
                a = cut
            cuts.append((a, b))
        starts, ends = np.array(cuts, np.int64).T
    return starts, ends


def _slice_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features, number of words and a hash of the words of each line; the lines follow each other in ``data``."""
    low, m = int(starts[0]), len(starts)
    part = data[low : int(ends[-1])]
    kind = KINDS[part]
    line = np.repeat(np.arange(m), np.diff(np.append(starts - low, len(part))))  # the break belongs to the line before
    counts = np.bincount(line * 7 + kind, minlength=7 * m).reshape(m, 7).astype(np.float64)
    word = kind != SPACE
    new = np.concatenate([[True], line[1:] != line[:-1]]) if len(part) else np.zeros(0, bool)
    first = np.flatnonzero(word & (new | ~np.concatenate([[False], word[:-1]])))
    last = np.flatnonzero(word & np.concatenate([~word[1:] | new[1:], [True]]))
    owner = line[first]
    words = np.bincount(owner, minlength=m).astype(np.float64)
    up, down = powers(len(part))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)])])
    name = (sums[last + 1] - sums[first]) * down[first]
    name ^= name >> np.uint64(29)
    order = np.lexsort((name, owner))
    a, b = owner[order], name[order]
    different = np.bincount(a[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])] if len(a) else a, minlength=m)
    again = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (name[1:] == name[:-1])], minlength=m)
    closed = np.bincount(owner, weights=kind[last] == SYMBOL, minlength=m)
    letters = np.concatenate([[0], np.cumsum(np.isin(kind, (LETTER, UPPER, DIGIT, OTHER)))])
    bare = np.bincount(owner, weights=letters[last + 1] == letters[first], minlength=m)
    shout = np.bincount(owner, weights=(kind[first] == UPPER) & (last > first) & (kind[np.minimum(first + 1, len(kind) - 1)] == UPPER), minlength=m)
    size, many = np.maximum(1, counts[:, :6].sum(axis=1)), np.maximum(1, words)
    ended = np.zeros(m)
    ended[owner] = kind[last] == STOP  # the last word's stays
    own = np.column_stack([
        np.log1p(size), counts[:, UPPER] / size, counts[:, DIGIT] / size, counts[:, SYMBOL] / size, counts[:, STOP] / size, counts[:, OTHER] / size, np.log1p(size / many),
        different / many, again / many, closed / many, bare / many, shout / many, np.log1p(words) - np.log1p(different), ended, np.zeros(m),
    ])
    place = (np.arange(len(owner)) - (np.cumsum(words) - words)[owner]).astype(np.uint64)  # of a word in its line
    mixed = name * (np.uint64(2) * place + np.uint64(1))
    hashes = np.zeros(m, np.uint64)
    np.add.at(hashes, owner, mixed)
    return own, words, hashes


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, lengths of the lines, lines of each text) of an array of texts; lines without a word are left out."""
    texts = texts.fill_null("").cast(pa.large_string())
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    found = [lines_of(data, int(a), int(b)) for a, b in zip(at[:-1], at[1:], strict=True)]
    text = np.repeat(np.arange(len(found)), [len(s) for s, _ in found])
    starts, ends = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(2))
    parts, k = [], 0
    while k < len(starts):
        to = max(k + 1, int(np.searchsorted(ends, starts[k] + SLICE, side="right")))
        parts.append(_slice_features(data, starts[k:to], ends[k:to]))
        k = to
    if not parts:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0), np.zeros(len(texts), np.int64)
    own, words, hashes = (np.concatenate([p[j] for p in parts]) for j in range(3))
    own, hashes, text, size = own[words > 0], hashes[words > 0], text[words > 0], (ends - starts)[words > 0].astype(np.float64)
    order = np.lexsort((np.arange(len(text)), hashes, text))
    met = np.zeros(len(text))
    met[order[1:]] = (text[order][1:] == text[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    own[:, OWN - 1] = met
    before, behind = np.zeros_like(own), np.zeros_like(own)
    has = np.zeros((len(text), 2))
    same = text[1:] == text[:-1]
    before[1:][same], behind[:-1][same] = own[:-1][same], own[1:][same]
    has[1:, 0], has[:-1, 1] = same, same
    return np.hstack([own, before, behind, has, np.ones((len(text), 1))]).astype(np.float32), size, np.bincount(text, minlength=len(texts))


class Chain:
    """Weights of the features for a good line, and of the four transitions (bad and good, to bad and good)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def marginals(self, lines: np.ndarray, counts: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Each line's probability of being good, and the expected transitions (2 x 2, if ``pairs``); the k-th lines of all texts go together."""
        odds = np.clip(lines @ self.weights, -30, 30)
        local = np.column_stack([1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))])
        step = np.exp(self.moves - self.moves.max())
        order = np.argsort(-counts, kind="stable")
        begin = (np.cumsum(counts) - counts)[order]
        longest = int(counts.max(initial=0))
        alive = np.searchsorted(-counts[order], -np.arange(longest), side="left")  # texts with more lines than k
        ahead, back = np.empty_like(local), np.ones_like(local)
        for k in range(longest):
            i = begin[: alive[k]] + k
            a = local[i] if k == 0 else (ahead[i - 1] @ step) * local[i]
            ahead[i] = a / a.sum(axis=1, keepdims=True)
        for k in range(longest - 2, -1, -1):
            i = begin[: alive[k + 1]] + k
            b = (local[i + 1] * back[i + 1]) @ step.T
            back[i] = b / b.sum(axis=1, keepdims=True)
        both = ahead * back
        good = both[:, 1] / both.sum(axis=1)
        expected = np.zeros((2, 2))
        if pairs and longest > 1:
            inner = np.ones(len(lines), bool)
            inner[(np.cumsum(counts) - counts)[counts > 0]] = False
            i = np.flatnonzero(inner)
            joint = ahead[i - 1][:, :, None] * step * (local[i] * back[i])[:, None, :]
            expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return good, expected

    @classmethod
    def fit(cls, lines: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 150, ridge: float = 1e-3, rate: float = 0.1) -> Chain:
        """Maximum likelihood by Adam on standardised features; ``labels`` by text."""
        mean, spread = lines.mean(axis=0), lines.std(axis=0)
        spread[spread < 1e-6] = 1
        mean[-1] = 0  # the constant
        x = ((lines - mean) / spread).astype(np.float32)
        y = np.repeat(labels, counts).astype(np.float64)
        inner = np.ones(len(y), bool)
        inner[(np.cumsum(counts) - counts)[counts > 0]] = False
        i = np.flatnonzero(inner)
        seen = np.array([[np.sum((y[i - 1] == a) & (y[i] == b)) for b in (0, 1)] for a in (0, 1)], float)
        theta, first, second = np.zeros(x.shape[1] + 4), 0.0, 0.0
        for k in range(1, rounds + 1):
            own = cls(theta[:-4], theta[-4:].reshape(2, 2))
            good, expected = own.marginals(x, counts, pairs=True)
            slope = np.concatenate([x.T @ (y - good), (seen - expected).ravel()]) / len(y) - ridge * theta
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            theta = theta + rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        weights = theta[:-4] / spread
        weights[-1] -= weights[:-1] @ mean[:-1]
        return cls(weights, theta[-4:].reshape(2, 2))


def weighted(good: np.ndarray, size: np.ndarray, counts: np.ndarray, empty: float) -> np.ndarray:
    """The mean of the lines' probabilities weighted by their lengths, by text."""
    text = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(text, size, len(counts))
    return np.where(counts > 0, np.bincount(text, good * size, len(counts)) / np.maximum(total, 1), empty)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


class Model:
    """A chain, the curve over its raw quality, and the share of good documents in the fit."""

    def __init__(self, chain: Chain | None, curve: np.ndarray, share: float):
        self.chain, self.curve, self.share = chain, curve, share

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.chain is None:
            return np.full(len(texts), self.share)
        lines, size, counts = features(texts)
        good, _ = self.chain.marginals(lines, counts)
        raw = weighted(good, size, counts, self.share)
        return np.where(counts > 0, 1 / (1 + np.exp(-(self.curve[0] * _logit(raw) + self.curve[1]))), self.share)

    @classmethod
    def fit(cls, texts: pa.Array, labels: np.ndarray) -> Model:
        """Even rows fit the chain, odd ones the curve."""
        share = float(labels.mean()) if len(labels) else 0.5
        even = np.arange(len(labels)) % 2 == 0
        if len({*labels[even]}) < 2 or len({*labels[~even]}) < 2:
            return cls(None, np.array([1.0, 0.0]), share)
        lines, size, counts = features(texts)
        row = np.repeat(even, counts)
        if not row.any():
            return cls(None, np.array([1.0, 0.0]), share)
        chain = Chain.fit(lines[row], counts[even], labels[even])
        good, _ = chain.marginals(lines[~row], counts[~even])
        x, y = _logit(weighted(good, size[~row], counts[~even], share)), labels[~even].astype(float)
        curve = np.array([1.0, 0.0])
        design = np.column_stack([x, np.ones(len(x))])
        for _ in range(50):  # Newton, with a slight pull to the raw quality
            p = 1 / (1 + np.exp(-design @ curve))
            slope = design.T @ (y - p) - 0.1 * (curve - [1.0, 0.0])
            bend = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
            curve = curve + np.clip(np.linalg.solve(bend, slope), -1, 1)
        return cls(chain, curve, share)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on a bounded sample of labelled documents."""
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    marks = marks.groupBy("id").agg(F.min("y").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.length("text") <= FIT_CHARS)
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(sample)  # a bounded table: two numbers for each of ``sample`` rows
    found = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.any_value("y").alias("y")).toArrow()
    order = np.argsort(found.column("id").to_numpy().astype(np.uint64) * _BASE)  # another order than any that the ids have
    found = found.take(pa.array(order))
    return Model.fit(found.column("text").combine_chunks(), found.column("y").to_numpy())


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([0, *pc.binary_length(batch.column(1)).fill_null(0).to_pylist()])
            k = 0
            while k < batch.num_rows:  # a few texts at a time, so a batch needs little memory
                to = max(k + 1, int(np.searchsorted(sizes, sizes[k] + SLICE, side="right")) - 1)
                part = batch.slice(k, to - k)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1)))], names=["id", "score"])
                k = to

    return run


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document's whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(_scorer(model), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))


def document_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Fit on the labels that may be learned from and score every document."""
    return score_quality(docs, fit_quality(docs, labels, sample))
