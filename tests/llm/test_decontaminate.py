import hashlib
import random
import re

import pytest

from roadsky.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add("null" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case():
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(40)] + ["É", "ß", "日本"]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.choice([0, 2, 3, 9, 10, 11, 40]))) for i in range(30)] + [(None, say(12)), (7, say(15)), (8, None), (9, "...")]
    docs = [(None, say(5)), (1, None), (2, ""), (3, "!?")]
    for i in range(60):
        parts = [say(r.randint(0, 60))]
        if i % 2:
            item = r.choice(items)[1] or ""
            parts += [item.upper().replace(" ", ", "), say(r.randint(0, 20)), " ".join(item.split()[:12])]
        docs.append((10 + i, "-".join(parts)))
    return [*docs, docs[-1], docs[-1]], items


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 40])
def test_hits_match_brute_force(spark, documents, tmp_path, monkeypatch, block_words):
    docs, items = case()
    monkeypatch.setattr(decontaminate.write_blocks, "__defaults__", (decontaminate.WINDOW, block_words))
    documents(docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = decontaminate.op6_decontaminate(spark, str(tmp_path)).collect()
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r[c] for c in names) for r in rows), key=str) == brute(docs, items)


def test_longest_match_and_place(spark, documents):
    item = " ".join(f"q{i}" for i in range(30))
    docs = documents([(1, f"a b {item} c {' '.join(item.split()[:12])}"), (2, "nothing")])
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.matched(docs, bench, ["doc_id"]).collect()}
    assert [rows[1][c] for c in ("longest_item", "longest_item_word", "longest_doc_word", "longest_words", "n_hit")] == ["5", 0, 2, 30, 42]
    assert rows[2]["longest_item"] is None


def test_keep_clean(spark, documents):
    item = " ".join(f"q{i}" for i in range(12))
    docs = documents([(1, f"x {item}"), (2, "fine"), (2, "fine"), (None, None)])
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, docs.filter("doc_id is null or doc_id <> 1").collect()), key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.keep_clean(docs, none).count() == 4
    assert decontaminate.keep_clean(documents([]), bench).count() == 0
