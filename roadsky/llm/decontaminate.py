"""Benchmark decontamination with suffix arrays over the training text.

Each task builds a suffix array over the words of the documents it holds, a
block of documents at a time: the positions whose suffix can begin a benchmark
window, sorted by their next words. Every benchmark suffix of window length is
searched in it by bisection; the range found holds all its places. Windows
that follow one another on a diagonal join to the longest verbatim match.

Only positions whose first words begin some window enter the array; the others
can match nothing. A window is ``n`` consecutive words of an item, or the
whole of a shorter item.

The benchmark is the stated query set. It reaches the tasks in blocks of at
most ``BLOCK_WORDS`` words (or of one longer item), packed by tasks, written to
the shared folder and read one at a time: no task holds more than one block,
and the driver only their names.

Words are compared by a 64-bit hash of their bytes; a match needs every word
of a window to agree.

Cases: null texts have no words; items without words have no window; items of
equal id count once; a null item id reads as ``null``; an empty benchmark
hits nothing; repeated documents get one result each.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsky.llm.common import bounds, chunks, fresh, ranges, read_bytes, table, write_bytes
from roadsky.session import scratch_path

WINDOW = 10
#: Words of benchmark items that are held at once.
BLOCK_WORDS = 1_000_000
#: Characters of text that are searched at once.
STEP_CHARS = 500_000
_BASE = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93
#: Words that lead a window and decide which positions enter the suffix array.
_LEAD = 3


def _fold() -> np.ndarray:
    """Per byte the lower-case word byte, or 0 where no word can hold it."""
    fold = np.zeros(256, np.uint8)
    for a, b in (("0", "9"), ("a", "z")):
        fold[ord(a) : ord(b) + 1] = np.arange(ord(a), ord(b) + 1)
    fold[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    fold[128:] = np.arange(128, 256)
    return fold


_FOLD = _fold()
_VALUE = np.random.default_rng(10).integers(1, 1 << 63, 256).astype(np.uint64)
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def words_of(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and where each text's words start (with the end behind)."""
    raw = [(t or "").encode() for t in texts]
    data = _FOLD[np.frombuffer(b"\n".join([*raw, b""]) or b"\n", np.uint8)]
    inside = np.concatenate([[False], data > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers = np.full(len(data) + 1, _BASE, np.uint64)
    powers[0] = 1
    inverse = np.full(len(data), _INVERSE, np.uint64)
    inverse[:1] = 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * np.cumprod(inverse, out=inverse), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * np.cumprod(powers, out=powers)[starts]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(_MIX)
    hashes ^= hashes >> np.uint64(32)
    first = bounds(np.array([len(r) + 1 for r in raw], np.int64))
    return hashes, np.searchsorted(starts, first)


def _windows(hashes: np.ndarray, at: np.ndarray, n: int) -> dict:
    """By window length: rows of (item, start) as two arrays."""
    lengths = np.diff(at)
    out = {}
    for size in sorted({min(int(x), n) for x in lengths if x}):
        chosen = np.flatnonzero(lengths >= n) if size == n else np.flatnonzero(lengths == size)
        counts = lengths[chosen] - size + 1
        out[size] = (np.repeat(chosen, counts), ranges(at[chosen], counts))
    return out


def _keys(ranks: np.ndarray, positions: np.ndarray, size: int) -> np.ndarray:
    """The next ``size`` ranks as bytes whose order is the order of the ranks."""
    rows = ranks[positions[:, None] + np.arange(size)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * size}").ravel()


def _lead(ranks: np.ndarray, positions: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(positions), np.uint64)
    for j in range(min(size, _LEAD)):
        out = (out << np.uint64(21)) | ranks[positions + j].astype(np.uint64)
    return out


def pack_block(items: list[tuple], n: int) -> bytes:
    """A block of (item_id, text): vocabulary, window keys by length, and the items' names."""
    hashes, at = words_of([t for _, t in items])
    vocabulary = np.unique(hashes)
    ranks = np.searchsorted(vocabulary, hashes).astype(np.uint32) + 1
    parts = {"vocabulary": vocabulary, "names": np.array([str(i) if i is not None else "null" for i, _ in items] or [""])}
    sizes = []
    for size, (item, start) in _windows(hashes, at, n).items():
        keys = _keys(ranks, start, size)
        order = np.argsort(keys, kind="stable")
        sizes.append(size)
        parts |= {
            f"keys{size}": keys[order],
            f"item{size}": item[order],
            f"word{size}": (start - at[item])[order],
            f"lead{size}": np.unique(_lead(ranks, start, size)),
        }
    parts["sizes"] = np.array(sizes, np.int64)
    out = io.BytesIO()
    np.savez(out, **parts)
    return out.getvalue()


def write_blocks(benchmark: DataFrame, n: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """The benchmark in blocks in the shared folder, packed by tasks; only the blocks' paths reach the driver."""
    folder = scratch_path(benchmark.sparkSession, "benchmark")
    items = benchmark.select("item_id", "text")
    words = F.floor(F.length(F.coalesce("text", F.lit(""))) / 2) + 1
    total = items.agg(F.sum(words).alias("words")).first()["words"] or 0
    parts = max(1, -(-total // block_words))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, written, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pd.DataFrame:
            # a name of its own for each attempt of a task
            path = f"{folder}/block-{part:06d}-{written:06d}-{uuid.uuid4().hex}.npz"
            write_bytes(path, pack_block(held, n))
            return pd.DataFrame({"path": [path]})

        for frame in frames:
            for item, text in zip(frame["item"], frame["text"], strict=True):
                held.append((item, text))
                size += len(text or "") // 2 + 1
                if size >= block_words:
                    yield flush()
                    held, size, written = [], 0, written + 1
        if held:
            yield flush()

    dealt = items.select(F.col("item_id").cast("string").alias("item"), "text").repartition(parts, F.xxhash64("item", "text"))
    packed = dealt.sortWithinPartitions("item", "text").mapInPandas(pack, "path string")
    return sorted(row["path"] for row in packed.collect())  # a row a block


def _load(path: str, cache: dict) -> dict:
    """A block; the one read last is kept."""
    if path not in cache:
        cache.clear()
        with np.load(io.BytesIO(read_bytes(path))) as block:
            cache[path] = {k: block[k] for k in block.files}
    return cache[path]


def block_hits(hashes: np.ndarray, at: np.ndarray, block: dict) -> tuple[np.ndarray, ...]:
    """(document word, item, item word, window length) of every place where a window of the block stands."""
    vocabulary = block["vocabulary"]
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(vocabulary):
        return none, none, none, none
    found = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    ranks = np.where(vocabulary[found] == hashes, found + 1, 0).astype(np.uint32)
    # how many known words stand in a row, within the document
    stop = np.where(ranks == 0, np.arange(len(ranks)), len(ranks))
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    stop = np.minimum(stop, np.repeat(at[1:], np.diff(at)))
    row = stop - np.arange(len(ranks))
    out = []
    for size in block["sizes"].tolist():
        places = np.flatnonzero(row >= size)
        leads = block[f"lead{size}"]
        mine = _lead(ranks, places, size)
        near = np.minimum(np.searchsorted(leads, mine), len(leads) - 1)
        places = places[leads[near] == mine]
        if not len(places):
            continue
        keys = _keys(ranks, places, size)
        order = np.argsort(keys, kind="stable")
        suffixes, keys = places[order], keys[order]
        low = np.searchsorted(keys, block[f"keys{size}"], "left")
        count = np.searchsorted(keys, block[f"keys{size}"], "right") - low
        word = suffixes[ranges(low, count)]
        out.append((word, np.repeat(block[f"item{size}"], count), np.repeat(block[f"word{size}"], count), np.full(len(word), size)))
    if not out:
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def longest_matches(doc: np.ndarray, word: np.ndarray, item: np.ndarray, item_word: np.ndarray, size: np.ndarray) -> dict:
    """Per document (item, item word, document word, words) of its longest verbatim match, the first of equals."""
    if not len(doc):
        return {}
    shift = word - item_word
    order = np.lexsort((word, shift, item, doc))
    doc, word, item, item_word, size, shift = (x[order] for x in (doc, word, item, item_word, size, shift))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (word[1:] > word[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    length = word[last] + size[last] - word[first]
    best: dict = {}
    for i in np.lexsort((word[first], -length)).tolist():
        best.setdefault(int(doc[first[i]]), (int(item[first[i]]), int(item_word[first[i]]), int(word[first[i]]), int(length[i])))
    return best


_FOUND = [
    ("n_words", T.LongType()),
    ("n_hit", T.LongType()),
    ("items", T.ArrayType(T.StringType())),
    ("longest_item", T.StringType()),
    ("longest_item_word", T.LongType()),
    ("longest_doc_word", T.LongType()),
    ("longest_words", T.LongType()),
]


def find_matches(texts: list, paths: list[str], cache: dict) -> list[tuple]:
    """For each text the values of ``_FOUND``."""
    hashes, at = words_of(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    cover = np.zeros(len(hashes) + 1, np.int64)
    items: list[set] = [set() for _ in texts]
    longest: dict = {}
    for path in paths:
        block = _load(path, cache)
        word, item, item_word, size = block_hits(hashes, at, block)
        np.add.at(cover, word, 1)
        np.add.at(cover, word + size, -1)
        doc = owner[word]
        for pair in np.unique(doc * (len(block["names"]) + 1) + item).tolist():
            d, i = divmod(pair, len(block["names"]) + 1)
            items[d].add(str(block["names"][i]))
        for d, (i, a, b, length) in longest_matches(doc, word, item, item_word, size).items():
            if d not in longest or longest[d][3] < length:
                longest[d] = (str(block["names"][i]), a, b - int(at[d]), length)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    n_hit = hit[at[1:]] - hit[at[:-1]]
    return [
        (int(n), int(h), sorted(items[d]), *longest.get(d, (None, None, None, None)))
        for d, (n, h) in enumerate(zip(np.diff(at).tolist(), n_hit.tolist(), strict=True))
    ]


def matched(docs: DataFrame, benchmark: DataFrame, columns: list[str], n: int = WINDOW) -> DataFrame:
    """``columns`` of every document with what was found in its text; clashing names of documents give way."""
    paths = write_blocks(benchmark, n)
    kept = [c for c in columns if c not in {x for x, _ in _FOUND}]
    schema = docs.select(*kept).schema
    for name, kind in _FOUND:
        schema = schema.add(name, kind)
    names = [x for x, _ in _FOUND]
    own = fresh(kept, "_text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for frame in frames:
            for part in chunks(frame[own].tolist(), STEP_CHARS):
                piece = frame.iloc[part]
                found = find_matches(piece[own].tolist(), paths, cache)
                columns_found = dict(zip(names, map(list, zip(*found, strict=True)), strict=True))
                for name in names[4:]:
                    columns_found[name] = pd.array(columns_found[name], "Int64")
                yield piece[kept].assign(**columns_found)

    return docs.select(*kept, docs["text"].alias(own)).mapInPandas(run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Documents without any window of the benchmark, with all their columns."""
    columns = docs.columns
    names = {x for x, _ in _FOUND} & set(columns)
    safe = docs.withColumnsRenamed({c: f"_doc_{c}" for c in names})
    clean = matched(safe, benchmark, safe.columns, n).filter("n_hit = 0").select(*safe.columns)
    return clean.withColumnsRenamed({f"_doc_{c}": c for c in names}).select(*columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest_words",
    )


_SQL_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: Every window of every document joined to those of the items.
OP6_SQL = f"""
WITH docs AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
items AS (
    SELECT item_id, w, least({WINDOW}, len(w)) AS n
    FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0
),
windows AS (
    SELECT item_id, n, s AS item_at, array_to_string(w[s:s + n - 1], ' ') AS words
    FROM items, unnest(range(1, len(w) - n + 2)) t(s)
),
spots AS (
    SELECT doc_id, n, s AS doc_at, array_to_string(w[s:s + n - 1], ' ') AS words
    FROM docs JOIN (SELECT DISTINCT n FROM windows) ON len(w) >= n, unnest(range(1, len(w) - n + 2)) t(s)
),
hits AS (SELECT doc_id, item_id, n, doc_at, item_at FROM spots JOIN windows USING (n, words)),
covered AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM hits, unnest(range(doc_at, doc_at + n)) t(place) GROUP BY doc_id
),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id
),
runs AS (
    SELECT doc_id, max(doc_at) + any_value(n) - min(doc_at) AS words
    FROM (
        SELECT *, doc_at - row_number() OVER (PARTITION BY doc_id, item_id, doc_at - item_at ORDER BY doc_at) AS run
        FROM hits
    ) GROUP BY doc_id, item_id, doc_at - item_at, run
),
longest AS (SELECT doc_id, max(words) AS longest_words FROM runs GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       longest_words::BIGINT AS longest_words
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
