import random
import re
import zlib

import pytest

from roadsky.llm import spelling as S


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows):
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in words.items():
        around = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = around[0] if around and -around[0][0] >= 10 * n else None
        out[w] = [n, len(around), form[1] if form else None, -form[0] if form else None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def found(frame):
    rows = frame.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def edited(r, word):
    kind, at = r.randrange(3), r.randrange(len(word))
    letter = r.choice("abcdeéßxyz")
    return word[:at] + (letter + word[at:], letter + word[at + 1 :], word[at + 1 :])[kind]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base = ["".join(r.choice("abcdé") for _ in range(r.randint(6, 12))) for _ in range(40)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abcdefg" * 40, "×÷×÷×÷×÷", "Straßenbahn", "ABCDEFGÀÉ"]
    texts = []
    for i in range(300):
        words = []
        for _ in range(r.randint(0, 60)):
            w = r.choice(base) if r.random() < 0.9 else edited(r, r.choice(base))
            words.append(edited(r, w) if r.random() < 0.05 else w)
        texts.append((i, r.choice(" ,0\n-").join(words)))
    # counts that make chains of forms
    chain = [("tttttttt", 2), ("ttttttttt", 40), ("tttttttttt", 500)]
    texts += [(1000 + i, " ".join([w] * n)) for i, (w, n) in enumerate(chain)]
    return texts + [(None, "abcdefgh abcdefgh"), (7, None), (8, ""), (9, "x" * 5000), (9, "x" * 5000), (9, "x" * 4999 + " " + "x" * 4999)]


def test_equals_all_pairs_compared(documents, rows):
    expected = brute(rows)
    assert found(S.group_variants(documents(rows))) == expected
    assert any(v[2] for v in expected.values())
    assert expected["tttttttt"][4] == "tttttttttt" or expected["tttttttt"][2] is None


def test_chains_are_followed_to_the_last(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("v", "w5")]
    links = spark.createDataFrame(forms, "word string, form string")
    assert {r["word"]: r["root"] for r in S.roots(links).collect()} == {w: "w13" for w, _ in forms}


def test_every_edit_shares_a_signature():
    r = random.Random(8)
    for size in list(range(7, 15)) * 60:
        a = "".join(r.choice("abcdeéß") for _ in range(size))
        b = edited(r, a)
        if a == b or len(b) < 7:
            continue
        at, sig = S.signatures([a, b])
        assert set(sig[at == 0].tolist()) & set(sig[at == 1].tolist()), (a, b)


def test_signatures_of_a_word_do_not_depend_on_its_company():
    words = ["abcdefg", "ééééééé", "zzzzzzzzzzzz"]
    at, sig = S.signatures(words)
    for i, w in enumerate(words):
        assert sorted(S.signatures([w])[1].tolist()) == sorted(sig[at == i].tolist())


def test_empty_table(documents):
    assert S.group_variants(documents([])).count() == 0
    assert S.group_variants(documents([(1, None), (2, "ab cd")])).count() == 0
