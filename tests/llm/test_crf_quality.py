import itertools
import random

import numpy as np

from roadsky.llm import crf_quality as crf


def sample(n=300, seed=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "the", "re", "ing", "on"]) for _ in range(r.randint(1, 3)))
    good = lambda: " ".join(word() for _ in range(r.randint(5, 12))).capitalize() + "."
    bad = lambda: r.choice(
        [" | ".join(word() for _ in range(8)), " ".join(word().upper() + "!!" for _ in range(8)), " ".join([word()] * 12), "$$$ ".join(word() for _ in range(8))]
    )
    docs, labels = [], []
    for i in range(n):
        quality = int(i % 3 > 0)
        lines = [good() for _ in range(r.randint(2, 6))]
        if not quality:
            lines += [bad() for _ in range(r.randint(3, 6))]
        docs.append((i, "\n".join(lines)))
        labels.append((i, quality, 0))
    return docs, labels


def test_marginals_match_enumeration():
    r = np.random.default_rng(1)
    lengths = [4, 1, 3, 4]
    first = np.concatenate([[0], np.cumsum(lengths)])
    unary, pair = r.normal(size=sum(lengths)), r.normal(size=(2, 2))
    good, counts = crf.Chains(first).marginals(unary, pair)
    total = np.zeros((2, 2))
    for a, n in zip(first[:-1], lengths, strict=True):
        weights, sums = 0.0, np.zeros(n)
        pairs = np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(unary[a + i] * s for i, s in enumerate(states)) + sum(pair[x, y] for x, y in itertools.pairwise(states)))
            weights += w
            sums += w * np.array(states)
            for x, y in itertools.pairwise(states):
                pairs[x, y] += w
        assert np.allclose(good[a : a + n], sums / weights)
        total += pairs / weights
    assert np.allclose(counts, total)


def test_line_features_mark_lines():
    x, first, size = crf.line_features(["One two.\nAB!!\nOne two.", None, "", "the the the the"])
    assert first.tolist() == [0, 3, 4, 5, 6] and size.tolist() == [8, 4, 8, 0, 0, 15]
    assert x.shape[1] == crf.WIDTH
    assert x[:, 12].tolist() == [1, 0, 1, 0, 0, 0]
    assert x[3, 13] == 1 and x[5, 14] > 2 and x[0, 14] == 0


def test_quality_on_held_out_rows(spark, documents, labels):
    docs, known = sample()
    edge = [(5000, None), (5001, ""), (None, "A line."), (5002, "One fine line here.\n" * 30000), (5002, "One fine line here.\n" * 30000)]
    rows = crf.quality_scores(documents(docs + edge), labels(known)).collect()
    assert len(rows) == len(docs) + len(edge)
    got = {r["doc_id"]: r for r in rows}
    held = [(i, q) for i, q, _ in known if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == q for i, q in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert got[5000]["score"] == got[5001]["score"]


def test_without_labels_or_rows(spark, documents, labels):
    docs, known = sample(12)
    assert {r["score"] for r in crf.quality_scores(documents(docs), labels([])).collect()} == {0.5}
    assert {r["predicted"] for r in crf.quality_scores(documents(docs), labels([(i, 1, 0) for i in range(12)])).collect()} == {1}
    assert crf.quality_scores(documents([]), labels(known)).count() == 0
