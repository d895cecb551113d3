import hashlib
import random

import numpy as np
import pytest

from roadsky.llm import runlength


def brute(rows, length):
    """Rows of different ids; equal rows once."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        hit = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            window = raw[k : k + length]
            if window in seen:
                hit[k : k + length] = True
            seen.add(window)
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out[doc] = (len(raw), int(hit.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~hit])).hexdigest())
    return out


def case(seed=8):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(["an", "thé", "ring", "on", "ea", "日"]) + str(r.randrange(50)) for _ in range(n))
    passage, base = say(60), say(200)
    rows = [(i, f"{say(r.randint(0, 80))} {passage} {say(r.randint(0, 80))}") for i in range(12)]
    for i in range(12):
        words = base.split(" ")
        words[r.randrange(200)] = "CHANGED"
        rows.append((50 + i, " ".join(words)))
    rows += [(100 + i, base) for i in range(5)]
    rows += [(200, "ab" * 400), (201, "ab" * 300), (202, "x" * 99), (203, "x" * 100), (204, "x" * 101), (205, None), (206, "")]
    rows += [(300, passage + say(30) + passage + "\n" + passage), (-5, passage[:250]), (None, base), (301, "\0" * 300 + passage[:120] + "\0" * 200)]
    r.shuffle(rows)
    return rows


def check(spark, documents, rows, tmp_path):
    documents(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = runlength.op5_runlength(spark, str(tmp_path)).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}
    assert len(found) == len(rows)
    assert got == brute(rows, 100)


def test_matches_brute_force(spark, documents, tmp_path):
    check(spark, documents, case(), tmp_path)


def test_hot_anchors_give_the_same(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(runlength, "HOT_SPANS", 2)
    check(spark, documents, case(9), tmp_path)


def test_many_shards_give_the_same(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(runlength, "SHARD_SPANS", 3)
    check(spark, documents, case(10), tmp_path)


@pytest.mark.parametrize("length", [3, 5, 8, 100])
def test_index_finds_repeats(length):
    r = random.Random(length)
    texts = [bytes(r.choice(b"ab\0\xff") for _ in range(r.randint(0, 40))) for _ in range(40)]
    texts += [b"abab" * 30, b"abab" * 30, b""]
    index = runlength.RunLengthIndex(texts, length)
    again = index.repeats()
    seen, want, at = set(), [], 0
    for t in texts:
        for k in range(len(t) - length + 1):
            if t[k : k + length] in seen:
                want.append(at + k)
            seen.add(t[k : k + length])
        at += len(t) + 1
    assert np.flatnonzero(again).tolist() == want


def test_repeated_rows_and_ids(spark, documents, tmp_path):
    a, b = "first words " * 30 + "tail", "x" + "second thing " * 30
    documents([(1, a), (1, a), (1, b), (2, a)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = runlength.op5_runlength(spark, str(tmp_path)).collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in rows)
    period_a, period_b = len("first words "), len("second thing ")
    own_a = len(a) - len("tail") - period_a
    assert [x for x in got if x[0] == 2] == [(2, len(a), len(a))]
    assert got[0][:2] == got[1][:2] and {g[2] for g in got if g[0] == 1 and g[1] == len(a)} == {own_a}
    assert {g[2] for g in got if g[0] == 1 and g[1] == len(b)} == {len(b) - 1 - period_b}


def test_empty(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert runlength.op5_runlength(spark, str(tmp_path)).count() == 0


def test_many_rows_without_an_id(spark, documents, tmp_path):
    """Each keeps its own text: nothing is taken from one for what stands twice in another."""
    r = random.Random(6)
    say = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    rows = [(None, say(r.randint(90, 260))) for _ in range(2000)]
    passage = say(150)
    rows += [(None, say(40) + passage + say(40)) for _ in range(6)] + [(2**63 - 1, passage), (3, passage)]
    documents(rows).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = runlength.op5_runlength(spark, str(tmp_path)).collect()
    got = sorted((-1 if x["doc_id"] is None else x["doc_id"], x["kept_sha256"], x["n_removed"]) for x in found)
    ordered = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, runlength.text_tag(x[1].encode(), x[0] is None)))
    named = [(i, text) for i, (_, text) in enumerate(ordered)]
    want = brute(named, 100)
    expected = sorted((-1 if ordered[i][0] is None else ordered[i][0], sha, removed) for i, (_, removed, _, sha) in want.items())
    assert got == expected and sum(x[2] > 0 for x in got) == 7


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_judging_does_not_depend_on_frames(limit, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(runlength, "HOT_SPANS", limit)
    r = random.Random(limit)
    rows = sorted((0, r.randrange(12) ** 2 // 9, r.randrange(4), r.randrange(6), r.randrange(2), r.randrange(3)) for _ in range(400))
    frame = pd.DataFrame([(*x, 1) for x in rows], columns=["kind", "key", "span", "doc", "tag", "at", "n"])
    spans = {}
    for _, key, span, *place in rows:
        spans.setdefault(key, {}).setdefault(span, []).append(tuple(place))
    expected = set()
    for key, own in spans.items():
        for span, places in own.items():
            expected |= {(1, key, span, *p) for p in places if p != min(places)}
            if len(own) > 1:
                expected.add((3 if len(own) > limit else 2, key, span, *min(places)))
    for size in (1, 2, 7, 50, 1000):
        parts = [frame.iloc[a : a + size] for a in range(0, len(frame), size)]
        out = pd.concat(list(runlength.judge(iter(parts))))
        assert {tuple(x[:-1]) for x in out.itertuples(index=False)} == expected
