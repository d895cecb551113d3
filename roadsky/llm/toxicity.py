"""Toxicity: words hidden by leetspeak, spacing or repetition are restored, then the text is scored.

The noisy channel: a writer meant letters, the text shows symbols. For each
token that may hide a word, a lattice holds the letters every symbol may stand
for (``LEET``), each repeated letter once or twice, no letter for a separator
inside a token, and for a separator between single letters the choice of no
letter or of a word's end. Viterbi takes the likeliest path under a character
trigram model, half counted over *all* documents, half over the words that the
classifier weighs. Training and scoring read a text in the same way
(``Reader``): words as they stand, and restored ones beside them.

Features are words and their beginnings of ``STEMS`` letters, as toxic words
are inflected; each counts by the logarithm of how often it stands there, so
that repetition adds, but less and less. A feature is weighed only if the G
test of its presence against the label reaches ``LEAST_G``: words that merely
happen to stand in more documents of one label have no say. The weights are a
logistic regression's, found by Newton steps until the gradient vanishes.

Training reads labels of rows that are not held out only, ``SAMPLE_DOCS`` of
them at most, in the order of a hash of the id. The character counts cover
every document.

Cases: null and empty texts get the score of a text without any known word;
repeated rows get one result each; without labels every score is 0; texts of
any length are read whole, and so are their tokens. Columns beside id and text
are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsky.llm.common import held_out, table

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE_DOCS = 20_000
#: Features that may carry a weight, at most; the strongest by the G statistic.
VOCABULARY = 1024
#: Labelled documents a feature must occur in, and the G statistic it must reach (one in 1,900 does by chance).
LEAST_DOCS = 3
LEAST_G = 12.0
#: Lengths of the beginnings of words that are features beside the words.
STEMS = (4, 5, 6)
#: Squared penalty of the weights.
PENALTY = 0.3
#: Different words a training task counts before it hands them on.
HELD_WORDS = 200_000
#: Disguised words whose restored form a worker remembers, at most.
REMEMBERED = 200_000

# Letters that a symbol commonly stands for.
LEET = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "li",
    "+": "t",
}
_CUT = re.compile(r"[^\w@$!|+]+|_+")
_EDGES = "!|+,.;:?$%&*#-_()[]{}\"'"
_SPACED = re.compile(r"(?<![\w@$!|+])[\w@$!|+](?:[ ._*\-][\w@$!|+]){2,}(?![\w@$!|+])")
_TWICE = re.compile(r"(.)\1")
_LETTERS = 28


def _letter_codes() -> np.ndarray:
    """Per byte: 1 to 26 for a letter in either case, 27 for part of another script's letter, 0 for the rest."""
    codes = np.zeros(256, np.int64)
    for i in range(26):
        codes[ord("a") + i] = codes[ord("A") + i] = i + 1
    codes[128:] = 27
    return codes


def trigram_counts(texts: list) -> np.ndarray:
    """Counts of three following letter codes over whole texts, each text between two blanks."""
    codes = _letter_codes()[np.frombuffer(b"  " + b"  ".join((t or "").encode() for t in texts) + b"  ", np.uint8)]
    grams = (codes[:-2] * _LETTERS + codes[1:-1]) * _LETTERS + codes[2:]
    return np.bincount(grams, minlength=_LETTERS**3)


def letter_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts over all documents: a table per task, added up by Spark; as many rows as the alphabet has trigrams."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_LETTERS**3, np.int64)
        for frame in frames:
            for at in range(0, len(frame), 500):
                total += trigram_counts(frame.iloc[at : at + 500, 0].tolist())
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"gram": seen, "n": total[seen]})

    rows = docs.select(text).mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(_LETTERS**3)
    for row in rows.collect():
        out[row["gram"]] = row["n"]
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a letter after two others, smoothed by the pair and the single letter."""
    three = counts.reshape(_LETTERS, _LETTERS, _LETTERS)
    two, one = three.sum(0), three.sum((0, 1))
    single = (one + 1) / (one.sum() + _LETTERS)
    pair = (two + 5 * single) / (two.sum(1, keepdims=True) + 5)
    return np.log((three + 5 * pair) / (three.sum(2, keepdims=True) + 5))


#: A separator between single letters: nothing, or the end of a word.
_GAP = ["", " "]


def lattice(symbols: str) -> list[list[str]]:
    """Per run of an equal symbol the letter strings it may stand for; separators stand for nothing, a blank for a gap."""
    out, i = [], 0
    while i < len(symbols):
        j = i
        while j < len(symbols) and symbols[j] == symbols[i]:
            j += 1
        letters = LEET.get(symbols[i], symbols[i] if symbols[i].isalpha() else "")
        if symbols[i] == " ":
            out.append(_GAP)
        elif letters:
            out.append([x * n for x in letters for n in ((1,) if j == i + 1 else (1, 2))])
        i = j
    return out


def decode(symbols: str, model: np.ndarray) -> str:
    """The likeliest letters for ``symbols``: Viterbi over the lattice, the last two letters as the state."""
    paths: dict = {(0, 0): (0.0, None)}
    for choices in lattice(symbols):
        following: dict = {}
        for (a, b), (score, path) in paths.items():
            for letters in choices:
                p, q, s = a, b, score
                for x in letters:
                    c = ord(x) - 96 if "a" <= x <= "z" else 0 if x == " " else 27
                    s += model[p, q, c]
                    p, q = q, c
                if (p, q) not in following or following[p, q][0] < s:
                    following[p, q] = (s, (path, letters))
        paths = following
    _, path = max(((s + model[a, b, 0], path) for (a, b), (s, path) in paths.items()), key=lambda x: x[0])
    found = []
    while path is not None:
        path, letters = path
        found.append(letters)
    return "".join(reversed(found))


def disguised(word: str) -> bool:
    """Whether a word without blanks shows letters that may stand for others: symbols or digits among them, or one repeated."""
    if len(word) < 3:
        return False
    if not word.isalpha():
        return any(x.isalpha() for x in word) and any(x in LEET for x in word)
    return len(word) >= 4 and _TWICE.search(word) is not None


def in_symbols(word: str) -> bool:
    """Whether a word may be written in symbols and digits alone."""
    return len(word) >= 3 and all(x in LEET for x in word)


def plain_words(token: str) -> tuple[list[str], list[str]]:
    """Of a token between blanks, lower-case: the words that stand there, and what may hide others."""
    if token.isalpha():
        return [token], [token] if disguised(token) else []
    parts = [x for x in _CUT.split(token) if x]
    if len(parts) >= 3 and all(len(x) == 1 for x in parts):
        return [], ["".join(parts)]
    plain, hidden = [], []
    for part in parts:
        core = part.strip(_EDGES)
        (plain if core.isalpha() else hidden).append(core)
        if core != part and not part[len(part.rstrip(_EDGES)) :][2:]:
            hidden.append(part)  # a symbol at the edge may be a letter too
    if len(parts) > 1:
        hidden.append("".join(parts))  # separators may cut a word
    joined = len(parts) > 1
    return plain, [x for x in [*plain, *hidden] if disguised(x) or in_symbols(x) or (joined and x.isalpha() and x not in plain)]


def skeleton(word: str) -> str:
    """A word with each repeated letter once."""
    return "".join(x for i, x in enumerate(word) if i == 0 or x != word[i - 1])


class Reader:
    """Words of a text, restored where they are hidden; what was decoded is remembered.

    ``wanted``: skeletons of all words and beginnings that matter, if known. A
    word of letters alone keeps its skeleton when it is restored, so one whose
    skeleton begins with none of these need not be decoded.
    """

    def __init__(self, model: np.ndarray, wanted: set[str] | None = None):
        self.model, self.wanted = model, wanted
        self.longest = max(map(len, wanted), default=0) if wanted is not None else 0
        self.restored: dict[str, list[str]] = {}

    def restore(self, symbols: str) -> list[str]:
        """The words that ``symbols`` most likely stand for."""
        if symbols not in self.restored:
            if len(self.restored) >= REMEMBERED:
                self.restored.clear()
            self.restored[symbols] = decode(symbols, self.model).split()
        return self.restored[symbols]

    def matters(self, symbols: str) -> bool:
        if self.wanted is None or not symbols.isalpha():
            return True
        bare = skeleton(symbols)
        return any(bare[:k] in self.wanted for k in range(1, min(len(bare), self.longest) + 1))

    def of_token(self, token: str) -> list[str]:
        """Its words and the restored ones that do not stand there already."""
        plain, hidden = plain_words(token)
        if not hidden:
            return plain
        found = dict.fromkeys(w for h in hidden if self.matters(h) for w in self.restore(h))
        return [*plain, *(w for w in found if w not in plain)]

    def spaced(self, lowered: str, tokens: Counter) -> Iterator[tuple[str, int]]:
        """Words written letter by letter, and how often."""
        if sum(n for x, n in tokens.items() if len(x) == 1 and x != "|") >= 3:
            for run, n in Counter(_SPACED.findall(lowered)).items():
                for word in self.restore(re.sub(r"[ ._*\-]", " ", run)):
                    if len(word) > 1:
                        yield word, n

    def words(self, text: str | None) -> Counter:
        """How often each word stands in a whole text."""
        lowered = (text or "").lower()
        out, tokens = Counter(), Counter(lowered.split())
        for token, n in tokens.items():
            for word in self.of_token(token):
                out[word] += n
        for word, n in self.spaced(lowered, tokens):
            out[word] += n
        return out


def features_of(word: str) -> list[str]:
    """A word, and its beginnings (marked by what no word holds)."""
    return [word, *(f"{word[:k]}-" for k in STEMS if len(word) >= k)]


@dataclass
class Scorer:
    """Weights of words and beginnings, and the character model."""

    words: dict[str, float]
    intercept: float
    model: np.ndarray

    def reader(self) -> FeatureReader:
        return FeatureReader(self)

    def score(self, reader: FeatureReader, text: str | None) -> float:
        z = self.intercept + sum(self.words[x] * value for x, value in sorted(reader.features(text).items()))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


class FeatureReader:
    """The weighed features of texts, with what a worker remembers of tokens: most have none."""

    def __init__(self, scorer: Scorer):
        self.weighed = scorer.words
        self.read = Reader(scorer.model, {skeleton(w.rstrip("-")) for w in scorer.words})
        self.tokens: dict[str, tuple[str, ...]] = {}

    def of_words(self, words: list[str]) -> tuple[str, ...]:
        return tuple(x for word in words for x in features_of(word) if x in self.weighed)

    def features(self, text: str | None) -> dict[str, float]:
        """Weighed features in a whole text, by the logarithm of their counts."""
        total: dict[str, int] = {}
        lowered = (text or "").lower()
        tokens = Counter(lowered.split())
        if len(self.tokens) > 2 * REMEMBERED:
            self.tokens.clear()
        known = self.tokens.get
        for token, n in tokens.items():
            own = known(token)
            if own is None:
                own = self.tokens[token] = self.of_words(self.read.of_token(token))
            for x in own:
                total[x] = total.get(x, 0) + n
        for word, n in self.read.spaced(lowered, tokens):
            for x in self.of_words([word]):
                total[x] = total.get(x, 0) + n
        return {x: math.log2(1 + n) for x, n in total.items()}


def sample_labels(labels: DataFrame, target: str, size: int) -> DataFrame:
    """At most ``size`` labelled ids that are not held out, in hash order: (doc_id, y)."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out("doc_id"))
    one = rows.groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("y"))
    return one.orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id").limit(size)


def _sample_words(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """(word, y, n): in how many of the sample's documents of a label a feature stands, counted in the task first."""

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, total = Reader(model), {}

        def counted() -> pd.DataFrame:
            return pd.DataFrame([(w, int(y), n) for (w, y), n in total.items() if w], columns=["word", "y", "n"])

        for frame in frames:
            for text, y in zip(frame["text"], frame["y"], strict=True):
                for feature in {x for word in reader.words(text) for x in features_of(word)}:
                    total[feature, y] = total.get((feature, y), 0) + 1
                if len(total) >= HELD_WORDS:
                    yield counted()
                    total.clear()
        yield counted()

    return rows.mapInPandas(words, "word string, y int, n long")


def g_statistic(a: Column, b: Column, n1: int, n0: int) -> Column:
    """G of a feature in ``a`` of ``n1`` and ``b`` of ``n0`` documents: presence and absence against the label."""
    with_it, share = a + b, n1 / (n1 + n0)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    without = F.lit(float(n1 + n0)) - with_it
    return 2 * (
        part(a, with_it * share)
        + part(b, with_it * (1 - share))
        + part(F.lit(float(n1)) - a, without * share)
        + part(F.lit(float(n0)) - b, without * (1 - share))
    )


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = SAMPLE_DOCS) -> Scorer:
    """A scorer fitted on a bounded sample of labelled rows and the letters of all documents."""
    counts = letter_counts(docs)
    chosen = F.broadcast(sample_labels(labels, target, sample))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "y")
    corpus = language_model(counts)
    by_y = {r["y"]: r["n"] for r in rows.groupBy("y").count().withColumnRenamed("count", "n").collect()}
    n1, n0 = by_y.get(1, 0), sum(n for y, n in by_y.items() if y != 1)
    if not n1 or not n0:
        return Scorer({}, -500.0 if not n1 else 500.0, corpus)
    per_word = _sample_words(rows, corpus).groupBy("word").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).cast("double").alias("a"),
        F.sum(F.when(F.col("y") == 1, 0).otherwise(F.col("n"))).cast("double").alias("b"),
    )
    strong = per_word.filter(F.col("a") + F.col("b") >= LEAST_DOCS).withColumn("g", g_statistic(F.col("a"), F.col("b"), n1, n0))
    best = strong.filter(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "word").limit(VOCABULARY)
    strongest = [r["word"] for r in best.select("word").collect()]
    if not strongest:
        return Scorer({}, math.log(n1 / n0), corpus)
    lexicon = trigram_counts([w for w in strongest if not w.endswith("-")]).astype(float)
    mixed = np.log(0.5 * np.exp(corpus) + 0.5 * np.exp(language_model(lexicon)))
    scorer = Scorer(dict.fromkeys(strongest, 0.0), 0.0, mixed)
    ids = {w: i for i, w in enumerate(strongest)}

    def present(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = scorer.reader()
        for frame in frames:
            found = [sorted((ids[w], v) for w, v in reader.features(t).items()) for t in frame["text"]]
            yield pd.DataFrame({"y": frame["y"], "words": [[i for i, _ in f] for f in found], "values": [[v for _, v in f] for f in found]})

    data = rows.mapInPandas(present, "y int, words array<int>, values array<double>").collect()
    y = np.array([r["y"] == 1 for r in data], float)
    doc = np.repeat(np.arange(len(data)), [len(r["words"]) for r in data])
    word = np.array([w for r in data for w in r["words"]], np.int64)
    value = np.array([v for r in data for v in r["values"]], float)
    weights, intercept = _logistic(y, doc, word, value, len(strongest))
    return Scorer({w: float(x) for w, x in zip(strongest, weights, strict=True)}, intercept, mixed)


def _logistic(y: np.ndarray, doc: np.ndarray, word: np.ndarray, value: np.ndarray, n: int, penalty: float = PENALTY) -> tuple:
    """Logistic regression with a squared penalty on the weights, not on the intercept.

    Newton steps, each halved until the loss falls; the penalised loss is
    strictly convex, so they end at its least value: when no part of the
    gradient is above 1e-9 of the number of documents.
    """
    m, lots = len(y), 2000
    rest = np.append(np.full(n, penalty), 1e-9)
    order = np.argsort(doc, kind="stable")
    doc, word, value = doc[order], word[order], value[order]
    edges = np.searchsorted(doc, np.append(np.arange(0, m, lots), m))

    def out(v: np.ndarray) -> np.ndarray:
        return v[n] + np.bincount(doc, weights=v[word] * value, minlength=m)

    def loss(v: np.ndarray, z: np.ndarray) -> float:
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (rest * v * v).sum())

    v = np.zeros(n + 1)
    v[n] = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    z = out(v)
    now = loss(v, z)
    while True:
        chance = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        up = np.append(np.bincount(word, weights=(chance - y)[doc] * value, minlength=n), (chance - y).sum()) + rest * v
        if np.abs(up).max() <= 1e-9 * m:
            break
        curve, weight = np.diag(rest), chance * (1 - chance)
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            x = np.zeros((min(lots, m - i * lots), n + 1))
            x[doc[a:b] - i * lots, word[a:b]] = value[a:b]
            x[:, n] = 1.0
            curve += x.T @ (x * weight[i * lots : i * lots + len(x), None])
        step, size = np.linalg.solve(curve, up), 1.0
        while size > 1e-8:
            ahead = v - size * step
            z_ahead = out(ahead)
            if (then := loss(ahead, z_ahead)) < now:
                break
            size /= 2
        else:
            break  # no step lowers the loss any more: rounding
        v, z, now = ahead, z_ahead, then
    return v[:n], float(v[n])


def score_documents(docs: DataFrame, scorer: Scorer, text: str = "text", score: str = "score") -> DataFrame:
    """Every row with the score of its whole text in a further column."""
    kept = [c for c in docs.columns if c != score]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = scorer.reader()
        for frame in frames:
            scores = [scorer.score(reader, x) for x in frame[text]]
            yield frame.assign(**{score: np.array(scores, float)})

    schema = docs.select(*kept).schema.add(score, "double")
    return docs.select(*kept).mapInPandas(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
