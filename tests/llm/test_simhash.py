import random
import re

import numpy as np
import pytest
import xxhash

from roadsky.llm import simhash

WORDS = [f"w{i}" for i in range(400)]


def slow_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(pairs):
    above = {}

    def find(x):
        above.setdefault(x, x)
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        above[max(a, b)] = min(a, b)
    return {x: find(x) for x in above}


def corpus(seed=1, n=60):
    r = random.Random(seed)
    rows = [(100, None), (101, ""), (102, " \t\x0b"), (103, "One"), (104, "one"), (105, "a b c"), (106, "É x Y z é"), (None, "one")]
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(r.randint(40, 300))]
        rows.append((200 + 10 * i, " ".join(words)))
        for k in range(r.choice([0, 0, 2, 5])):
            changed = list(words)
            for _ in range(r.choice([0, 1, 2])):
                changed[r.randrange(len(changed))] = r.choice(WORDS)
            rows.append((201 + 10 * i + k, "  ".join(changed)))
    return [*rows, rows[-1], rows[-1]]


def test_fingerprints_match_plain_ones():
    for _, text in corpus():
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(" ".join(WORDS * 5)) == slow_fingerprint(" ".join(WORDS * 5))


@pytest.mark.parametrize("full", [simhash.FULL_PART, 2])
def test_components_match_brute_force(spark, documents, monkeypatch, full):
    monkeypatch.setattr(simhash, "FULL_PART", full)
    rows = corpus()
    prints = [simhash.fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i + 1) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    roots = roots_of(links)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(roots[i], []).append(rows[i][0])
    least = {k: min(x for x in v if x is not None) for k, v in groups.items()}
    want = sorted((str(rows[i][0]), least[roots[i]]) for i in range(len(rows)))
    found = simhash.near_duplicates(documents(rows)).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in found) == want
    assert any(len(v) > 2 for v in groups.values())


def test_near_fingerprints_are_linked_for_every_flip(spark):
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 30).astype(np.uint64)
    rows = []
    for x in base.tolist():
        rows.append(x)
        for bits in (1, 2, 3, 4, 4, 4):
            rows.append(x ^ sum(1 << int(b) for b in r.choice(64, bits, replace=False)))
    signed = sorted({int(np.uint64(x).view(np.int64)) for x in rows})
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {x["node"]: x["root"] for x in simhash.components(simhash.near_links(frame)).collect()}
    values = np.array(signed, np.int64).view(np.uint64)
    near = [(signed[i], signed[j]) for i in range(len(signed)) for j in range(i) if np.bitwise_count(values[i] ^ values[j]) <= 4]
    assert roots == {k: v for k, v in roots_of(near).items()}


def test_chain_and_hub(spark):
    chain = [(i + 1, i) for i in range(40)] + [(1000 + i, 999) for i in range(300)]
    frame = spark.createDataFrame(chain, "u long, v long")
    roots = {r["node"]: r["root"] for r in simhash.components(frame).collect()}
    assert roots == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(999, 1300), 999)}


def test_keep_one(spark, documents):
    same = "the same words in each of these rows, over and over again " * 3
    docs = documents([(5, same), (3, same), (3, same), (None, same), (9, "other words here"), (None, "alone without an id"), (None, "alone without an id")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "9", "None"]
    assert simhash.keep_one(documents([])).count() == 0


def test_two_texts_under_one_id_are_two_documents(documents):
    a = " ".join(f"first{i}" for i in range(60))
    b = " ".join(f"second{i}" for i in range(60))
    c = " ".join(f"third{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, b), (3, a), (3, c), (3, c), (None, c), (None, None), (None, "")]
    kept = simhash.keep_one(documents(rows)).select("doc_id", "text").collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], (r["text"] or "")[:5]) for r in kept) == [(-1, ""), (1, "first"), (1, "secon"), (3, "third")]
