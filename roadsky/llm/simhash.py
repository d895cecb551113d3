"""SimHash near-duplicates by meeting in the middle.

Two fingerprints at most ``2 r`` bits apart have a point within ``r`` bits of
both. So every distinct fingerprint emits all its variants within ``r`` bits
(2,081 for r = 2), and fingerprints that emit one variant are linked. All who
share a variant are within ``2 r`` of one another, so a chain through them
loses no component.

Variants are not shuffled one by one. They are dealt out by the parities of
``G`` groups of bits: flips of at most two bits reach ``1 + G + G (G - 1) / 2``
of the 2^G parts, so a fingerprint goes to each of those once, as eight bytes,
and the task makes that part's variants from it. ``G`` follows the logarithm
of the number of fingerprints. A part that still gets many (a dense group of
near copies has nearly equal parities) is split once more by a random linear
hash of all bits, under which every single flip leads elsewhere.

Documents of equal fingerprints are folded first. Links and components stay
distributed; components come from rounds of large and small stars, each
written to the shared folder.

Cases: null or empty texts and texts without words have fingerprint zero,
linked like any other; fewer words than a shingle make one shingle; a null id
takes part but is never a component's id (null where a component has no
other); repeated rows are copies of one another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsky.llm.common import fresh, spread_lookup, stored, table

SHINGLE = 4
MAX_BITS = 4
#: Fingerprints that a part should get, about; sets the number of parts.
PART_FINGERPRINTS = 32_768
#: A part that gets more than this is split by a second hash.
FULL_PART = 32_768
_SEED = 42
_BITS = np.arange(64, dtype=np.uint64)
_UPPER = bytes(range(65, 91)), bytes(range(97, 123))
_SPACES = re.compile(rb"[\x09-\x0D]")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: each is 1 if set in over half of the shingles' XXH64."""
    lowered = (text or "").encode().translate(bytes.maketrans(*_UPPER))
    words = [w for w in _SPACES.sub(b" ", lowered).split(b" ") if w]
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(line[a:b], _SEED) for a, b in zip(starts.tolist(), last, strict=False)), np.uint64, len(last))
    return majority(hashes)


#: Bits of each byte value, lowest first.
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    if n < 512:
        counts = ((hashes[:, None] >> _BITS) & np.uint64(1)).sum(0, dtype=np.int64)
    else:
        columns = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
        counts = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = np.array([fingerprint(t, shingle) for t in frame["_text"]], np.uint64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": values.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def flip_masks(radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of the 64 bits."""
    return np.array([sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(64), n)], np.uint64)


def parity_groups(rows: int, radius: int) -> int:
    """The number of groups of bits for so many fingerprints."""
    groups = 8
    while groups < 24 and rows * len(_reached(groups, radius)) > PART_FINGERPRINTS << groups:
        groups += 1
    return groups


def _reached(groups: int, radius: int) -> np.ndarray:
    """What flips of at most ``radius`` bits do to the parities of groups: all sums of so many of them."""
    out = np.zeros(1, np.int64)
    for _ in range(radius):
        out = np.unique(np.concatenate([out, *((out ^ (1 << g)) for g in range(groups))]))
    return out


def parity_codes(groups: int) -> np.ndarray:
    return np.int64(1) << (np.arange(64) % groups)


#: A code per bit for the second hash.
SPLIT_CODES = np.random.default_rng(64).integers(1, 1 << 11, 64)


def linear_code(values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Exclusive or of the codes of a value's set bits. Linear: code(a ^ b) = code(a) ^ code(b)."""
    out = np.zeros(len(values), np.int64)
    for i in range(64):
        out ^= np.where((values >> np.uint64(i)) & np.uint64(1), codes[i], 0)
    return out


def part_links(values: np.ndarray, codes: np.ndarray, part: int, masks: np.ndarray, mask_codes: np.ndarray) -> tuple:
    """Links of fingerprints that share a variant of this part: each with the least one it is connected to here."""
    variants, owners = [], []
    for code in np.unique(codes):
        mine = np.flatnonzero(codes == code)
        flips = masks[mask_codes == (code ^ part)]
        if len(flips):
            variants.append((values[mine][:, None] ^ flips[None, :]).ravel())
            owners.append(np.repeat(mine.astype(np.int32), len(flips)))
    none = np.zeros(0, np.uint64)
    if not variants:
        return none, none
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    variants.clear(), owners.clear()
    order = np.argsort(variant, kind="stable")
    variant, owner = variant[order], owner[order]
    del order
    same = np.flatnonzero(variant[1:] == variant[:-1])
    a, b = owner[same], owner[same + 1]
    del variant, owner
    if not len(a):
        return none, none
    near = np.bitwise_count(values[a] ^ values[b]) <= 2 * int(np.bitwise_count(masks).max())
    a, b = a[near], b[near]
    # the least fingerprint reached within this part, by passing labels along links and along labels
    rank = np.argsort(np.argsort(values, kind="stable"), kind="stable")
    back = np.argsort(values, kind="stable")
    u, v = rank[a], rank[b]
    label = np.arange(len(values))
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        np.minimum.at(label, before[u], low)
        np.minimum.at(label, before[v], low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[back[moved]], values[back[label[moved]]]


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v), u > v as signed numbers: links that connect all distinct ``fp`` at most ``max_bits`` apart."""
    radius = (max_bits + 1) // 2
    masks = flip_masks(radius)
    groups = parity_groups(distinct.count(), radius)
    parities = parity_codes(groups)
    reached = _reached(groups, radius)
    mask_part, mask_split = linear_code(masks, parities), linear_code(masks, SPLIT_CODES)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 20_000):
                fp = frame["fp"].to_numpy()[at : at + 20_000]
                code = linear_code(fp.view(np.uint64), parities)
                yield pd.DataFrame({"part": (code[:, None] ^ reached[None, :]).ravel(), "fp": np.repeat(fp, len(reached))})

    def link(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        part, split, bits = (int(x) for x in key)
        values = np.unique(frame["fp"].to_numpy().view(np.uint64))
        low = (1 << bits) - 1
        # both hashes side by side in one number
        codes = linear_code(values, parities) << 11 | (linear_code(values, SPLIT_CODES) & low)
        u, v = part_links(values, codes, part << 11 | split, masks, mask_part << 11 | (mask_split & low))
        u, v = u.view(np.int64), v.view(np.int64)
        return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    dealt = distinct.select("fp").mapInPandas(deal, "part long, fp long")
    full = dealt.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > FULL_PART)
    bits = F.least(F.ceil(F.log2(F.col("n") / FULL_PART)), F.lit(11)).cast("int")
    full = stored(full.select("part", bits.alias("bits")), "full-parts")
    # rows of 16 bytes: broadcast when counted to be few, otherwise dealt like the parts
    few = full.count() <= 100_000
    split = dealt.join(F.broadcast(full), "part", "left") if few else spread_lookup(dealt, full, ["part"], [F.col("fp")])
    split = split.na.fill(0, ["bits"])
    splits = F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("bits")) - 1))
    parts = split.select("part", splits.alias("split"), "bits", "fp")
    return parts.groupBy("part", "split", "bits").applyInPandas(link, "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root the least (signed) one reached; nodes that are roots included.

    Large stars hang greater neighbours on the least neighbour, small stars the
    lesser ones; when nothing changes the links are stars. The least neighbour
    is an aggregate with a map-side combine, and it is joined back by dealing
    the rows of a node, so a hub's links never meet in one task.
    """
    links = stored(links.select("u", "v"), "links")

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s")).first()
        return row["n"], row["s"]

    now = state(links)
    while now[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread_lookup(both, least, ["u"], [F.col("v")]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = spread_lookup(large, least, ["u"], [F.col("v")])
        small = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = stored(small.filter("u <> v").distinct(), "links")
        before, now = now, state(links)
        if now == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(near_links(distinct, max_bits))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = spread_lookup(rooted.select("fp", "root"), least, ["root"], [F.col("fp")]).select("fp", "component_id")
    return spread_lookup(rows, by_fp, ["fp"], [F.col("doc_id")])


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group: that with the smallest id; rows without an id stand behind all others.

    Rows are told apart by id and text together, so of two texts under one id
    each stays or goes with its own group.
    """
    own = fresh(docs.columns, "_row")
    gone = F.col("doc_id").isNull().cast("int")
    key = F.xxhash64(gone, F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.coalesce("text", F.lit("")))
    named = docs.withColumn(own, key)
    found = near_duplicates(named.select(F.col(own).alias("doc_id"), "text"), shingle, max_bits)
    group = found.groupBy(F.col("doc_id").alias("key")).agg(F.min("component_id").alias("group"))
    ids = named.groupBy(F.col(own).alias("key")).agg(F.min(gone).alias("gone"), F.min(F.col("doc_id").cast("long")).alias("id"))
    first = group.join(ids, "key").groupBy("group").agg(F.min(F.struct("gone", "id", "key")).alias("first"))
    kept = first.select(F.col("first.key").alias(own))
    return named.join(kept, own).dropDuplicates([own]).select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")
