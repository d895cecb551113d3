import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from roadsky.llm import packing as P


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.TOKENIZER)


def texts(n=400):
    r = random.Random(2)
    odd = [None, "", " \t\r\n", "x<|endoftext|>y <|startoftext|>", "a\x1cb\x85c d e", "don't 'll x", "̀ é", "İI ǅ ΑΣ ΑΣ.", "á ́b", "日本 語", "😀 x"]
    words = ["hello", "World", "été", "12,5", "http://x.y/z", "don't", "\n", "\t", "…", "Straße"]
    return odd + [" ".join(r.choice(words) for _ in range(int(r.lognormvariate(5, 1.5)))) for _ in range(n)]


def test_ids_are_those_of_the_library(library):
    with open(P.TOKENIZER, encoding="utf-8") as source:
        encoder = P.Encoder(source.read())
    rows = texts()
    r = random.Random(5)
    rows += ["".join(r.choice("abzAZ09'.,-_<|>\x7f\x01\u00e9 ") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    rows += ["It's DON'T we'Re they'LL I'd 'tis 's''s", "<|EndOfText|> <|endoftext|>x a<|b"]
    ids, at = encoder.encode(pa.array(rows))
    for i, text in enumerate(rows):
        assert ids[at[i] : at[i + 1]].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_around_every_kind_of_character(library):
    with open(P.TOKENIZER, encoding="utf-8") as source:
        encoder = P.Encoder(source.read())
    points = [*range(1, 0x600), *range(0x1E00, 0x2200), 0x3042, 0x65E5, 0xAC00, 0xFB01, 0xFF21, 0x1F600]
    rows = [f"aB{chr(c)}c's {chr(c)}' '{chr(c)} {chr(c)}é É{chr(c)}" for c in points]
    r = random.Random(7)
    pool = ["a", "S", "t", "re", "LL", "d", "'", "'", "0", "9", ".", "<", "|", "<|", " ", " ", "\n", "\x1c", "\x7f", "é", "É", "ß", "Þ", "×", "÷", "\u0301", "\u00a0", "ſ", "İ", "日", "<|endoftext|>"]
    rows += [None if r.random() < 0.02 else "".join(r.choices(pool, k=r.randint(0, 20))) for _ in range(4000)]
    for start in range(0, len(rows), 999):
        some = rows[start : start + 999]
        # a slice of a longer array, as steps are
        ids, at = encoder.encode(pa.array(["x", *some, "y"]).slice(1, len(some)))
        for i, text in enumerate(some):
            assert ids[at[i] : at[i + 1]].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 0]


def test_a_word_is_encoded_once_whatever_stands_around_it():
    with open(P.TOKENIZER, encoding="utf-8") as source:
        encoder = P.Encoder(source.read())
    words = ["hello", "été", "straße", "world", "don't"]
    marks = ["", ",", ".", "!", "?", ";", ":", ")", "\"", "..."]
    rows = [f"({w}{m} {w.capitalize()}{m}{n}" for w in words for m in marks for n in range(100)]

    class Model:
        """The tokenizer's model alone."""

        def __init__(self, model):
            self.model = model

    encoder.tokenizer = Model(encoder.tokenizer.model)
    ids, at = encoder.encode(pa.array(rows))
    assert len(at) == len(rows) + 1 and at[-1] == len(ids)
    # five words ("don't" is two units), marks alone or joined, ten digits, the end mark
    assert len(encoder.index) <= 6 + len(marks) + 10 + 1


def check(rows, found, library, length):
    """Pieces cut from whole documents, each in one place, sequences without gaps."""
    expected = {}
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), length)):
            own = ids[start : start + length]
            key = (i, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
            expected[key] = expected.get(key, 0) + 1
    held, sequences = {}, {}
    for r in found:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        held[key] = held.get(key, 0) + 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert held == expected
    for places in sequences.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= length
    return len(sequences)


def fitted(sizes, length):
    return len(P.best_fit(np.sort(np.array(sizes))[::-1], length))


def test_packs_every_piece_once(spark, documents, library):
    rows = list(enumerate(texts())) + [(None, "x"), (3, "again"), (3, "again")]
    made = P.pieces(documents(rows).repartition(5), length=256)
    found = P.pack(made, 256, 64, 24).collect()
    n = check(rows, found, library, 256)
    sizes = [r["length"] for r in found]
    assert n <= 1.02 * fitted(sizes, 256) + 2 and n >= sum(sizes) / 256


def test_few_rows_and_empty_table(documents, library):
    for rows in ([], [(1, None)], [(1, "a"), (2, "word " * 3000)], [(1, "word " * 2047)]):
        found = P.pack(P.pieces(documents(rows))).collect()
        assert check(rows, found, library, 2048) == (fitted([r["length"] for r in found], 2048) if found else 0)


@pytest.mark.parametrize("seed", range(6))
def test_steps_of_small_pieces_are_best_fit(seed):
    r = np.random.default_rng(seed)
    room = np.bincount(r.integers(0, 101, 30), minlength=101)
    counts = np.bincount(r.integers(1, 41, 300), minlength=41)
    counts[0] = 0
    steps = P.fit_small(counts, room, 100)
    left = [*np.repeat(np.arange(101), room).tolist()] + [100] * (steps.slots - int(room.sum()))
    for size in range(40, 0, -1):
        own = steps.length == size
        for rank in range(int(counts[size])):
            at = np.flatnonzero(own)[np.searchsorted(steps.first[own], rank, "right") - 1]
            left[int(steps.slot[at] + (rank - steps.first[at]) // steps.each[at])] -= size
    assert min(left) >= 0
    # the same number of new sequences as one piece after the other
    rooms, new = sorted(np.repeat(np.arange(101), room).tolist()), 0
    for size in np.repeat(np.arange(41), counts)[::-1].tolist():
        fits = [i for i, x in enumerate(rooms) if x >= size]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= size
        else:
            rooms.append(100 - size)
            new += 1
    assert steps.slots - int(room.sum()) == new


def test_configurations_reach_the_least_total():
    # halves, thirds and a size that only fits alone: the least is known
    sizes, demand = np.array([33, 50, 70]), np.array([30.0, 20.0, 9.0])
    chosen, amounts = P.configurations(sizes, demand, 100)
    assert (chosen @ sizes <= 100).all() and np.allclose(chosen.T @ amounts, demand)
    assert amounts.sum() == pytest.approx(10 + 10 + 9 - 0.0, abs=9 * 1 + 1e-6) and amounts.sum() >= (sizes @ demand) / 100 - 1e-9
    r = np.random.default_rng(4)
    sizes = np.unique(r.integers(26, 100, 12))
    demand = r.integers(1, 50, len(sizes)).astype(float)
    chosen, amounts = P.configurations(sizes, demand, 100)
    assert (chosen @ sizes <= 100).all() and np.allclose(chosen.T @ amounts, demand)
    # duality: no configuration is worth more than one, so the total is the least
    prices = np.linalg.solve(chosen.astype(float), np.ones(len(sizes)))
    every = [c for c in np.ndindex(4, 4, 4)]
    for i, j, k in [(i, j, k) for i in range(len(sizes)) for j in range(i, len(sizes)) for k in range(j, len(sizes))]:
        for held in every:
            count = np.zeros(len(sizes))
            for at, n in zip((i, j, k), held, strict=True):
                count[at] = n
            if count @ sizes <= 100:
                assert count @ prices <= 1 + 1e-4


def test_groups_hold_about_equal_numbers():
    counts = np.zeros(101, np.int64)
    counts[30:91] = 10
    grouped = P.linear_groups(counts, 12)
    assert len(grouped) == 12 and grouped[0][0] == 30 and grouped[-1][1] == 90
    assert all(a[1] < b[0] for a, b in zip(grouped, grouped[1:], strict=False))
    held = [counts[a : b + 1].sum() for a, b in grouped]
    assert max(held) <= 60 and min(held) >= 40
