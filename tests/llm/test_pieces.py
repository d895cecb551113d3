import random

import numpy as np
import pytest

from roadsky.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def texts():
    r = random.Random(1)
    letters = "abcdefg AEé▁ß\n.,'\"-01 中ض"
    out = [None, "", " ", "  ", "a  b", "\n\n x", "😀 x😀y", "▁▁a", "foo\0bar", "   lead", "x" * 200, "hello" * 30, "日本語", "\t\r\n", "▁"]
    return out + ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(1500)]


def test_ids_are_those_of_the_library(library, vocabulary):
    encoder, rows = pieces.Encoder(vocabulary), texts()
    for part in (rows[:700], rows[700:], rows[:20]):
        ids, at = encoder.encode(part)
        for i, text in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(text or ""), text


def test_merges_agree_with_relaxation(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    for word in ("▁internationalization", "▁abababababab", "▁thththth", "▁éêèë"):
        encoder.learn([word])
        ids = np.concatenate(encoder.flat)[-int(encoder.sizes[-1][-1]) :].tolist()
        assert ids == [i for p in pieces.merge(word, vocabulary.rank) for i in encoder._ids_of(p)]


def test_round_trip_over_documents(spark, documents, library):
    rows = list(enumerate(t for t in texts() if t is None or "▁" not in t)) + [(None, "again"), (1, ""), (1, "")]
    found = pieces.encode_documents(documents(rows)).collect()
    assert len(found) == len(rows)
    assert all(r["round_trip"] for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[0]["ids"] is None and by_id[0]["n_pieces"] == 0
    assert all(library.decode(by_id[i]["ids"]) == t for i, t in rows[10:60])
    assert pieces.encode_documents(documents([])).count() == 0
