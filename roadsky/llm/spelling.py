"""Spelling variants grouped by PartEnum signatures.

Words are counted over the whole corpus first; everything after works on the
different words. Two words are near if one code point inserted, deleted or
replaced turns one into the other.

A word's letters are a multiset, seen as a binary vector: one place for the
first ``a``, one for the second, and so on. One edit changes at most two
places, so near words have Hamming distance at most two. The places are dealt
to ``PARTS`` parts (letters by their usual frequency, so that parts weigh
about the same) and every choice of ``PARTS - 2`` parts is a signature: two
changed places spoil at most two parts, so near words agree on one signature
at least. Words are equi-joined on signatures and verified by edit distance
within the join.

A vocabulary of syllables has many words of nearly the same letters, and
plain signature groups grow with it. So each signature is joined with one half
of the word: one edit leaves the first or the last ``l // 2`` letters (the
shorter word's, rounded either way where lengths are odd) as they are. Near
words agree on a signature and on a half; no pair is lost.

Cases: a null text has no words; a null doc_id is written as empty in the
hash; a run of which a code point is deleted counts as what is left; ties for
a form go to the smallest word in code-point order; repeated rows count each;
empty tables give no rows; very long words are one word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsky.llm.common import bounds, ranges, stored, table

MIN_LENGTH = 7
MIN_COUNT = 2
#: One run in so many loses a code point.
DAMAGE = 31
#: A form is at least so many times as frequent as the word.
FORM_RATIO = 10
#: Parts of the vector; signatures leave out two of them.
PARTS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters by frequency, dealt to parts in turn; all others follow behind by code point.
_BY_FREQUENCY = "eanirstlodumcghpvbfzkwjyqx"


def runs(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word) of every run of at least ``min_length`` code points, damaged ones as what is left."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    pattern = f"[a-zÀ-ÿ]{{{min_length},}}"
    found = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(pattern), F.lit(0))).alias("run"),
    )
    hashed = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    found = found.select("run", hashed.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    left = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return found.select(F.when(F.col("h") % DAMAGE == 0, left).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n)."""
    counted = runs(docs, min_length).filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(hashes: np.ndarray) -> np.ndarray:
    """Sums of all hashes in front of each place."""
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes, out=out[1:])
    return out


def signatures(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, signature) of all signatures: each choice of parts, with each half that an edit may leave."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = bounds(sizes)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    own = np.repeat(np.arange(len(words)), sizes)

    # the vector: each letter with the how-manieth of its kind it is
    order = np.lexsort((flat, own))
    letters = flat[order]
    fresh = np.ones(len(letters), bool)
    fresh[1:] = (letters[1:] != letters[:-1]) | (own[1:] != own[:-1])
    places = np.arange(len(letters))
    nth = places - np.maximum.accumulate(np.where(fresh, places, 0))
    rank = letters + len(_BY_FREQUENCY)
    for i, letter in enumerate(_BY_FREQUENCY):
        rank[letters == ord(letter)] = i
    part = (rank + nth) % PARTS
    weight = mixed(letters * (1 << 32) + nth + 1)
    # a part's content is a set of places: the sum of their hashes tells it
    parts = np.zeros((PARTS, len(words)), np.uint64)
    np.add.at(parts, (part, own), weight)
    chosen = []
    for i, choice in enumerate(combinations(range(PARTS), PARTS - 2)):
        total = np.full(len(words), i + 1, np.uint64)
        for p in choice:
            total = mixed(total + parts[p] * np.uint64(2 * p + 3))
        chosen.append(total)

    # halves, by sums of hashes of (letter, place from the front or from the back)
    inside = ranges(np.zeros(len(words), np.int64), sizes)
    front = running(mixed(flat * (1 << 32) + inside))
    back = running(mixed(flat * (1 << 32) + np.repeat(sizes, sizes) - inside + (1 << 31)))
    odd = np.flatnonzero(sizes % 2)
    at = np.concatenate([np.arange(len(words)), odd])
    half = np.concatenate([sizes // 2, (sizes[odd] + 1) // 2])
    first, last = starts[:-1][at], starts[1:][at]
    halves = [mixed(front[first + half] - front[first] + half.astype(np.uint64)), mixed(back[last] - back[last - half] - half.astype(np.uint64))]
    keys = [mixed(total[at] ^ h) for total in chosen for h in halves]
    return np.tile(at, len(keys)), np.concatenate(keys).view(np.int64)


def signed(words: DataFrame) -> DataFrame:
    """(sig, word, n): every word under each of its signatures."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, n = frame["word"].to_numpy(), frame["n"].to_numpy()
            at, sig = signatures(list(texts))
            for start in range(0, len(at), 100_000):
                own = at[start : start + 100_000]
                yield pd.DataFrame({"sig": sig[start : start + 100_000], "word": texts[own], "n": n[own]})

    return words.mapInPandas(run, "sig long, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of near words in both directions, once."""
    rows = signed(words)
    a = rows.toDF("sig", "word", "n")
    b = rows.toDF("sig", "near", "near_n")
    # a pair may share several signatures; it is verified in the join and folded after it
    verified = (F.col("word") < F.col("near")) & (F.levenshtein("word", "near", 1) == 1)
    found = a.join(b, (a["sig"] == b["sig"]) & verified).select("word", "n", "near", "near_n")
    both = F.explode(
        F.array(
            F.struct("word", "n", "near", "near_n"),
            F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
        )
    )
    return found.distinct().select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form (word, form), followed to the last.

    Each link multiplies the count by ``FORM_RATIO`` at least, so chains are
    short; each round halves what is left of them.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        # only words whose root has a form itself move on
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = now.join(ahead, "root", "left")
        now = stored(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    words = stored(vocabulary(docs, min_length, min_count), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left")
    fits = -F.col("best.order") >= ratio * F.col("n")
    known = stored(
        known.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(fits, F.col("best.near")).alias("form"),
            F.when(fits, -F.col("best.order")).alias("form_n"),
        ),
        "forms",
    )
    found = roots(known.filter("form IS NOT NULL"))
    return known.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE
runs AS (
    SELECT CAST(doc_id AS VARCHAR) AS id,
        unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents
),
keyed AS (
    SELECT run, count(*) AS c, coalesce(id, '') || ':' || run AS key FROM runs WHERE length(run) >= 7 GROUP BY id, run
),
-- crc32 as the shift register it is: a table of 256 entries, then byte by byte
bits(i, v, k) AS (
    SELECT range, range, 0 FROM range(256)
    UNION ALL
    SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
),
crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
crc(key, h, place, v) AS (
    SELECT key, hex(encode(key)), 0, CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT key FROM keyed)
    UNION ALL
    SELECT key, h, place + 1,
        xor(v >> 8, (SELECT t FROM crc_table)[1 + (xor(v, CAST('0x' || substr(h, 2 * place + 1, 2) AS BIGINT)) & 255)])
    FROM crc WHERE place < length(h) // 2
),
hashed AS (SELECT key, xor(v, 4294967295) AS h FROM crc WHERE place = length(h) // 2),
counted AS (
    SELECT CASE WHEN h.h % 31 = 0 THEN left(k.run, CAST(h.h % length(k.run) AS INTEGER)) || substr(k.run, CAST(h.h % length(k.run) AS INTEGER) + 2)
        ELSE k.run END AS word, k.c
    FROM keyed k JOIN hashed h ON h.key = k.key
),
words AS MATERIALIZED (
    SELECT word, CAST(sum(c) AS BIGINT) AS n FROM counted WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
),
-- each word with one code point left out: near words share that place and rest, or one is the other's rest
rests AS MATERIALIZED (
    SELECT word, n, place, left(word, CAST(place - 1 AS INTEGER)) || substr(word, CAST(place + 1 AS INTEGER)) AS rest
    FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)
),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM rests a JOIN rests b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
    UNION
    SELECT r.word, w.word, w.n FROM rests r JOIN words w ON w.word = r.rest
    UNION
    SELECT w.word, r.word, r.n FROM rests r JOIN words w ON w.word = r.rest
),
best AS (
    SELECT word, count(*) AS n_near, min((-near_n, near)) AS top FROM pairs GROUP BY word
),
forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
        CASE WHEN -b.top[1] >= 10 * w.n THEN b.top[2] END AS form,
        CASE WHEN -b.top[1] >= 10 * w.n THEN -b.top[1] END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word
),
chains(word, last, next) AS (
    SELECT word, word, form FROM forms
    UNION ALL
    SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON f.word = c.next
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.last AS root
FROM forms f JOIN chains c ON c.word = f.word AND c.next IS NULL
"""
