import itertools
import random
import re

import pytest

from roadsky.llm import filter_audit as A


def brute(rows, labels):
    """Every order applied document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    docs = []
    for i, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ""
        fails += "A" * (len(words) < 200)
        fails += "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t))
        fails += "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * (i is not None and first[t] < i)
        docs.append((lang or "", fails, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = mine, []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left = [d for d in left if f not in d[1]]
                gone = gone + removed
                only = sum(d[1] == f for d in mine)
                out[part, order, step] = (len(left), len(removed), redundant, only, sum(d[2] for d in removed), sum(d[3] for d in removed))
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(frame):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = frame.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    pool = [
        None, "", " \t\n", "Short TEXT here", "a" * 20, "word " * 300, "plain words with $ sign",
        " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(250)) + " | x",
        "é ü x\x0by\x1cz " * 120, " ".join(f"t{i % 100}" for i in range(200)), " ".join(f"u{i % 99}" for i in range(200)),
        "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, "x" * 100_000,
    ]
    out = [(i, r.choice(pool), r.choice(["en", "de", None, ""])) for i in range(160)]
    out += [(None, "Short TEXT here", "en"), (None, None, "fr"), (3, "other text", "en"), (5, None, "de"), (5, "", "de")]
    return out + [(-7, "plain words with $ sign", "es"), (2**63 - 1, "a" * 20, "es")] * 2


def test_equals_every_order_applied_document_by_document(spark, rows):
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 150, 2)] + [(4, 0, 0), (4, 1, None), (None, 1, 1), (9999, 1, 1), (-7, None, 1)]
    labels = [(i, q, int(t) if t is not None else None) for i, q, t in labels]
    docs = spark.createDataFrame([(i, t, lang, 1, "x") for i, t, lang in rows], "doc_id long, text string, lang string, n int, mask string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert found(A.audit(A.cells(docs, marks))) == brute(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(A.cells(docs, marks)).count() == 0
    docs = spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string")
    assert A.audit(A.cells(docs, marks)).count() == 600


def test_no_python_and_no_text_is_shuffled(spark, rows):
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    plan = A.features(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
