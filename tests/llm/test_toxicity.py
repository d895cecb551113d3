import itertools
import random

import numpy as np

from roadsky.llm import toxicity

CALM = ["river", "stone", "walking", "garden", "music", "window", "paper", "silent", "green", "mountain", "letter", "story"]
HARSH = ["idiot", "moron", "loser", "pathetic"]


def sample(n=400, seed=2):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(CALM) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[r.randrange(30)] = r.choice(HARSH)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_disguised_words_are_restored():
    model = toxicity.language_model(toxicity.trigram_counts([*CALM, *HARSH] * 50).astype(float))
    for seen, meant in (("1d10t", "idiot"), ("m0r0n", "moron"), ("l0$er", "loser"), ("iddddiot", "idiot"), ("p@the7ic", "pathetic")):
        assert toxicity.decode(seen, model) == meant
    assert toxicity.plain_words("m.o.r.o.n") == ([], ["moron"])
    assert not toxicity.disguised("garden") and toxicity.disguised("gaaarden") and not toxicity.disguised("2024")
    assert toxicity.decode("m o r o n", model) == "moron" and toxicity.in_symbols("455") and not toxicity.in_symbols("4x5")


def test_probes_are_restored():
    """Hidden beside other single letters, stretched beyond any word, in symbols alone, by doubling, by separators."""
    counts = toxicity.trigram_counts([*CALM, *HARSH, "you", "what", "stupid", "ass", "a", "a", "i"] * 50)
    reader = toxicity.Reader(toxicity.language_model(counts.astype(float)))
    probes = {
        "what a m o r o n": "moron", "y o u i d i o t": "idiot", "you l o s e r a": "loser", "st" + "u" * 30 + "pid": "stupid",
        "@$$": "ass", "455": "ass", "iidiot": "idiot", "idioot": "idiot", "id-iot": "idiot", "m-o-r-o-n": "moron", "l.0.s.3.r": "loser",
        "i d i o t " + "m o r o n " * 20: "moron",
    }
    for text, word in probes.items():
        assert word in reader.words(text), text
    assert reader.words("moron moron MORON")["moron"] == 3


def test_decoding_takes_the_best_of_all_paths():
    model = toxicity.language_model(toxicity.trigram_counts([*CALM, *HARSH]).astype(float))
    r = random.Random(12)
    for _ in range(300):
        symbols = "".join(r.choice("aabiot013@$! ") for _ in range(r.randint(1, 7)))
        best = -np.inf
        for path in itertools.product(*toxicity.lattice(symbols)):
            codes = [0, 0, *(0 if x == " " else ord(x) - 96 for x in "".join(path)), 0]
            best = max(best, sum(model[codes[k - 2], codes[k - 1], codes[k]] for k in range(2, len(codes))))
        found = toxicity.decode(symbols, model)
        codes = [0, 0, *(0 if x == " " else ord(x) - 96 for x in found), 0]
        assert np.isclose(sum(model[codes[k - 2], codes[k - 1], codes[k]] for k in range(2, len(codes))), best)


def test_logistic_ends_where_the_gradient_vanishes():
    r = np.random.default_rng(3)
    x = (r.random((500, 12)) < 0.2) * r.uniform(0.5, 3, (500, 12))
    y = (r.random(500) < 1 / (1 + np.exp(1 - x @ r.normal(size=12)))).astype(float)
    doc, word = np.nonzero(x)
    by = r.permutation(len(doc))
    weights, intercept = toxicity._logistic(y, doc[by], word[by], x[doc, word][by], 12, 0.3)
    wrong = 1 / (1 + np.exp(-(x @ weights + intercept))) - y
    assert np.abs(x.T @ wrong + 0.3 * weights).max() < 1e-6 and abs(wrong.sum()) < 1e-6
    # labels that a feature tells apart completely still have a finite answer
    weights, _ = toxicity._logistic(np.array([1.0, 1, 0, 0]), np.array([0, 1]), np.array([0, 0]), np.array([1.0, 1.0]), 1)
    assert 0 < weights[0] < 50


def test_scores_plain_and_disguised(spark, documents, labels):
    docs, known = sample()
    hidden = [(1001, "green river you 1d10t and m0r0n story"), (1002, "paper window l o s e r music i d i o t"), (1003, "idiooot looooser stone")]
    edge = [(2000, None), (2001, ""), (None, "garden music"), (2002, "green " * 20000 + "idiot moron loser"), (2003, "river 0x1F 12:30 $$$ !!! ### |||")]
    rows = toxicity.toxicity_scores(documents(docs + hidden + edge + edge[-1:]), labels(known)).collect()
    assert len(rows) == len(docs) + len(hidden) + len(edge) + 1
    got = {r["doc_id"]: r for r in rows}
    assert all(got[i]["predicted"] == y for i, _, y in known)
    assert [got[i]["predicted"] for i in (1001, 1002, 1003, 2000, 2001, 2002, 2003, None)] == [1, 1, 1, 0, 0, 1, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_rows_teach_nothing(spark, documents, labels):
    docs, known = sample(200)
    frame = documents(docs)
    held = {r["doc_id"] for r in frame.filter(toxicity.held_out("doc_id")).collect()}
    turned = [(i, q, 1 - t if i in held else t) for i, q, t in known]
    a, b = (toxicity.fit(frame, labels(x)) for x in (known, turned))
    assert a.words == b.words and np.isclose(a.intercept, b.intercept)
    assert held


def test_without_labels_or_rows(spark, documents, labels):
    docs, known = sample(20)
    assert {r["predicted"] for r in toxicity.toxicity_scores(documents(docs), labels([])).collect()} == {0}
    assert toxicity.toxicity_scores(documents([]), labels(known)).count() == 0


def test_what_need_not_be_decoded_changes_nothing():
    r = random.Random(4)
    model = toxicity.language_model(toxicity.trigram_counts([*CALM, *HARSH] * 20).astype(float))
    weighed = {x: 1.0 for w in [*HARSH, "letter", "bass"] for x in toxicity.features_of(w)}
    reader = toxicity.Scorer(weighed, 0.0, model).reader()
    every = toxicity.Reader(model)
    for _ in range(400):
        words = [r.choice([*CALM, *HARSH, "letter", "bass", "i", "d", "0"]) for _ in range(8)]
        text = " ".join("".join(x * r.choice([1, 1, 1, 2, 3]) for x in w) for w in words)
        expected = {}
        for word, n in every.words(text).items():
            for x in toxicity.features_of(word):
                if x in weighed:
                    expected[x] = expected.get(x, 0) + n
        assert reader.features(text) == {x: np.log2(1 + n) for x, n in expected.items()}, text
