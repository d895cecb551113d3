"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of kinds of characters,
lengths, a closing mark, words that echo the one before, whether the line
occurs again in the document, and
the same of the lines before and after. The chain adds weights for two
following labels. Forward and backward sums give each line's probability of
being good; weighted by the lines' lengths they make the document's mean,
which a logistic curve turns into the score.

Labels are of documents, lines have none. Fitting starts with a document's
label on all its lines; then, ``ROUNDS`` times, lines of bad documents that the
field takes for good are relabelled (the worst line of a bad document stays
bad) and the field is fitted again.

Fitting uses at most ``SAMPLE_DOCS`` labelled documents that are not held out,
of at most ``SAMPLE_LINES`` lines each, in the order of a hash of the id.
Scoring reads every document whole.

Cases: null and empty texts are one empty line; without labels of both kinds
every score is that share (0.5 with none); repeated rows get one result each;
columns beside id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsky.llm.common import bounds, chunks, held_out, table
from roadsky.llm.toxicity import sample_labels

SAMPLE_DOCS = 4000
SAMPLE_LINES = 2000
ROUNDS = 2
STEPS = 120
THRESHOLD = 0.3
PENALTY = 1e-3

# Kinds of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 prose marks, 6 symbols, 7 bar, 8 exclamation, 9 other scripts
_KINDS = 10
_KIND = np.zeros(256, np.int64)
for _kind, _bytes in enumerate(
    [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".,;:'\"?-()", b"#$%&*@~^_=+<>/\\{}[]`", b"|", b"!"], 1
):
    _KIND[list(_bytes)] = _kind
_KIND[128:] = 9
_OWN = 15
_NEAR = [1, 2, 4, 5, 6, 7, 8, 9, 11, 12, 14]
#: Number of features of a line: its own, two neighbours' and whether there are neighbours.
WIDTH = _OWN + 2 * len(_NEAR) + 2


def line_features(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, where each text's lines start, length of each line in bytes)."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    first = np.searchsorted(starts, bounds(np.array([len(r) + 1 for r in raw], np.int64)))
    line = np.repeat(np.arange(len(starts)), size + 1)
    counts = np.bincount(line * _KINDS + _KIND[data], minlength=len(starts) * _KINDS).reshape(-1, _KINDS).astype(float)
    counts[:, 0] -= 1  # the line's end
    n = np.maximum(size, 1)[:, None]
    share = counts / n
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    words = counts[:, 4] + 1
    last = data[np.maximum(ends - 1, 0)]
    closed = np.isin(last, list(b".!?\"'")) & (size > 0)
    # the same line again in the document: sums over bytes weighed by their place stand for its content
    place = np.arange(len(data)) - starts[line]
    content = np.bincount(line, weights=(data * 1.0) * np.cos(place * 1.7 + data * 0.37) + data * data * np.sin(place * 0.6180339), minlength=len(starts))
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((content, size, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (size[order][1:] == size[order][:-1]) & (np.abs(np.diff(content[order])) < 1e-6)
    again = np.zeros(len(starts), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    # words that repeat the one before them
    letter = np.isin(data, list(b" \t\n"), invert=True)
    begin = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
    word = np.cumsum(letter & ~np.concatenate([[False], letter[:-1]])) - 1
    inside = np.flatnonzero(letter)
    offset = inside - begin[word[inside]]
    spelt = np.bincount(word[inside], weights=(data[inside] + 7.0) * np.cos(offset * 1.3 + data[inside] * 0.71), minlength=len(begin))
    twice = np.zeros(len(begin), bool)
    twice[1:] = (np.abs(np.diff(spelt)) < 1e-9) & (line[begin[1:]] == line[begin[:-1]])
    echo = np.bincount(line[begin[twice]], minlength=len(starts)) / words
    own = np.column_stack(
        [
            np.ones(len(starts)),
            np.log1p(size) / 5,
            np.minimum(counts[:, 2] / letters, 1),
            share[:, 3],
            share[:, 5] * 5,
            share[:, 6] * 5,
            share[:, 7] * 10,
            share[:, 8] * 10,
            share[:, 0] * 5,
            np.minimum(size / words, 30) / 10,
            share[:, 9],
            closed,
            again & (size > 0),
            size == 0,
            echo * 3,
        ]
    )
    near = own[:, _NEAR]
    has_before, has_after = np.ones(len(own), bool), np.ones(len(own), bool)
    has_before[first[:-1]] = False
    has_after[first[1:] - 1] = False
    before = np.where(has_before[:, None], np.roll(near, 1, 0), 0)
    after = np.where(has_after[:, None], np.roll(near, -1, 0), 0)
    return np.column_stack([own, before, after, has_before, has_after]), first, size


class Chains:
    """Forward and backward sums of many chains side by side, longest first."""

    def __init__(self, first: np.ndarray):
        self.length = np.diff(first)
        self.order = np.argsort(-self.length, kind="stable")
        self.start = first[:-1][self.order]
        sorted_length = self.length[self.order]
        # how many chains have a line at each step
        self.live = np.searchsorted(-sorted_length, -np.arange(sorted_length[0] if len(sorted_length) else 0), "left")

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of good per line, expected counts of label pairs); ``pair[a, b]`` weighs a followed by b, 1 is good."""
        forward = np.zeros((len(unary), 2))
        backward = np.zeros((len(unary), 2))
        local = np.column_stack([np.zeros(len(unary)), unary])
        for t, live in enumerate(self.live.tolist()):
            at = self.start[:live] + t
            if t:
                # log-sum-exp over the label before
                before = forward[at - 1]
                for b in (0, 1):
                    forward[at, b] = np.logaddexp(before[:, 0] + pair[0, b], before[:, 1] + pair[1, b]) + local[at, b]
            else:
                forward[at] = local[at]
        for t in range(len(self.live) - 2, -1, -1):
            at = self.start[: self.live[t + 1]] + t
            after = backward[at + 1] + local[at + 1]
            for a in (0, 1):
                backward[at, a] = np.logaddexp(pair[a, 0] + after[:, 0], pair[a, 1] + after[:, 1])
        both = forward + backward
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        total = np.logaddexp(both[:, 0], both[:, 1])
        inner = np.ones(len(unary), bool)
        inner[self.start] = False
        at = np.flatnonzero(inner)
        counts = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                counts[a, b] = np.exp(forward[at - 1, a] + pair[a, b] + local[at, b] + backward[at, b] - total[at]).sum()
        return good, counts


@dataclass
class Field:
    """Weights of the lines' features and of label pairs, and the curve from a document's mean to its score."""

    weights: np.ndarray
    pair: np.ndarray
    slope: float
    intercept: float

    def means(self, texts: list) -> np.ndarray:
        """Length-weighted mean probability of good lines, per text."""
        features, first, size = line_features(texts)
        good, _ = Chains(first).marginals(features @ self.weights, self.pair)
        return document_means(good, first, size)

    def scores(self, texts: list) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(self.means(texts)) + self.intercept)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 0.002, 0.998)
    return np.log(p / (1 - p))


def document_means(good: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    weight = size + 1.0
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def _ascend(features: np.ndarray, first: np.ndarray, labels: np.ndarray, line_weight: np.ndarray, start: tuple, steps: int) -> tuple:
    """Weights of greatest penalised likelihood of the labelled chains, by Adam steps."""
    chains = Chains(first)
    inner = np.ones(len(labels), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1].astype(int), labels[at].astype(int)), 1.0)
    value = np.concatenate([start[0], start[1].ravel()])
    mean, square = np.zeros_like(value), np.zeros_like(value)
    n, links = line_weight.sum(), max(1, len(at))
    for step in range(1, steps + 1):
        good, expected = chains.marginals(features @ value[:-4], value[-4:].reshape(2, 2))
        up = np.concatenate([features.T @ ((labels - good) * line_weight) / n, ((seen - expected) / links).ravel()]) - PENALTY * value
        mean, square = 0.9 * mean + 0.1 * up, 0.99 * square + 0.01 * up * up
        value += 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return value[:-4], value[-4:].reshape(2, 2)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number, by Newton steps."""
    a, b = 0.0, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * x).sum() - 0.1 * a, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        da, db = np.linalg.solve(h, g)
        a, b = a + da, b + db
    return float(a), float(b)


def fit_field(features: np.ndarray, first: np.ndarray, size: np.ndarray, y: np.ndarray) -> Field:
    """A field from labelled documents."""
    owner = np.repeat(np.arange(len(y)), np.diff(first))
    labels = y[owner].astype(float)
    # either label weighs as much as the other, and a document no more than ten lines
    line_weight = np.minimum(1.0, 10 / np.diff(first))[owner] / np.where(y == 1, max(y.mean(), 1e-6), max(1 - y.mean(), 1e-6))[owner]
    weights, pair = np.zeros(features.shape[1]), np.zeros((2, 2))
    for done in range(ROUNDS + 1):
        weights, pair = _ascend(features, first, labels, line_weight, (weights, pair), STEPS if not done else STEPS // 2)
        good, _ = Chains(first).marginals(features @ weights, pair)
        if done < ROUNDS:
            worst = np.minimum.reduceat(good, first[:-1])[owner]
            labels = np.where(y[owner] == 1, 1.0, (good > 0.5) & (good > worst)).astype(float)
    slope, intercept = _curve(_logit(document_means(good, first, size)), y.astype(float))
    return Field(weights, pair, slope, intercept)


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE_DOCS) -> Field:
    """A field fitted on a bounded sample of labelled documents; only their lines' features come to the driver."""
    chosen = F.broadcast(sample_labels(labels, target, sample))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.xxhash64("doc_id").alias("h"), "text", "y")

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in chunks(frame["text"].tolist(), 1_000_000):
                piece = frame.iloc[part]
                x, first, size = line_features(piece["text"].tolist())
                kept = np.flatnonzero(np.diff(first) <= SAMPLE_LINES)
                yield pd.DataFrame(
                    {
                        "h": piece["h"].to_numpy()[kept],
                        "y": piece["y"].to_numpy()[kept],
                        "x": [x[first[i] : first[i + 1]].astype("<f4").tobytes() for i in kept],
                        "size": [size[first[i] : first[i + 1]].astype("<i4").tobytes() for i in kept],
                    }
                )

    data = rows.mapInPandas(features, "h long, y int, x binary, size binary").collect()
    data.sort(key=lambda r: (r["h"], r["y"], r["x"]))
    y = np.array([r["y"] == 1 for r in data], int)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    x = np.concatenate([np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH) for r in data]).astype(float)
    size = np.concatenate([np.frombuffer(r["size"], "<i4") for r in data]).astype(float)
    return fit_field(x, bounds(np.array([len(r["size"]) // 4 for r in data], np.int64)), size, y)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    field = fit(docs, labels)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            scores = [field.scores(texts[part]) for part in chunks(texts, 1_000_000)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": np.concatenate(scores) if scores else np.zeros(0)})

    rows = docs.select("doc_id", "text")
    schema = docs.select("doc_id").schema.add("score", "double")
    return rows.mapInPandas(run, schema).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
