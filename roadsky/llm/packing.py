"""Packing documents into sequences: linear grouping for the long pieces, best fit for the short ones.

Tokens. Each task cuts its texts into the public tokenizer's units, many texts
at once, has every different unit encoded once by the tokenizer, and puts the
ids together; the tokenizer drops blanks and never looks across them. A
document's ids and the end mark are cut every ``LENGTH`` tokens; pieces are
rows of a few numbers from here on.

Plan. There are at most ``LENGTH`` different lengths, so a histogram of them
is bounded by that at any size of the corpus, and the plan is made from
histograms alone:

1. Pieces of full length are sequences by themselves. The other pieces longer
   than ``SMALL`` are sorted by length and cut into ``GROUPS`` groups of equal
   number; each is rounded up to the longest of its group.
2. With so few sizes, the best mix of configurations (multisets of sizes that
   fit) is a linear program, solved by column generation: a knapsack finds the
   configuration that would help most, until none does. Configurations are
   used a whole number of times; what rounding down leaves is laid out by best
   fit.
3. Actual pieces take the places of their group, by their rank in it.
4. Small pieces, longest first, go where least room is left that still
   suffices: counted out on the histogram of the room that is really left,
   one step for all sequences of equal room; new sequences open when none has
   room. A step is a row (length, ranks, sequences), so a piece finds its
   sequence by its rank alone.

Ranks are made without a sort of the table: a task numbers its own pieces per
length as it makes them, and counts per (task, length) give the offsets.

Cases: a null or empty text is the end mark alone; whole texts are read; rows
of equal doc_id are documents of their own, each packed; a null doc_id stays
null; other columns of the table are not used; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadsky.llm.common import bounds, ranges, stored, table

#: Where the public vocabulary file lies; only the driver opens it.
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
LENGTH = 2048
END_ID = 0
#: Pieces up to this length are small.
SMALL = 512
#: Sizes that long pieces are rounded up to, at most.
GROUPS = 192
#: Column generation stops after so many steps; any stop gives a valid packing.
MOST_COLUMNS = 4000
#: Column generation ends where the total is within this share of the least one.
GAP = 1e-5
#: Bytes of text that are encoded at once; a longer text is one step.
STEP_BYTES = 4_000_000
#: Different units that a task remembers, about.
REMEMBERED = 400_000
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, number long"


#: Kinds of bytes: blanks, letters, digits, other printable ASCII, and those that only the whole tokenizer reads.
_BLANK, _LETTER, _DIGIT, _OTHER, _ALIEN = range(5)
_KIND, _LOWER = np.full(256, _ALIEN, np.uint8), np.arange(256, dtype=np.uint8)
_KIND[33:127], _KIND[[*range(9, 14), 32]], _KIND[48:58] = _OTHER, _BLANK, _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_LOWER[65:91] += 32
#: Bytes as the characters that the tokenizer's model knows them by, in UTF-16: Latin-1's, but for those that do not print.
_BYTE_LEVEL = np.arange(256, dtype="<u2")
_BYTE_LEVEL[[*range(0x7F, 0xA1), 0xAD]] = 256 + 33 + np.arange(35)
#: Stands behind each text; cut out as a unit, it is the end mark.
_END = "\n"


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What the tokenizer's pre-tokenizer cuts ``texts`` into, lower-cased; which are end marks; which are left whole.

    The rules are fixed by the vocabulary file and tested against it: runs of
    letters, runs of other characters, single digits, and ``'s 't 're 've 'm
    'll 'd`` where a run of others would start. Printable ASCII and Latin-1
    letters, which normalization leaves as they are but for their case, are cut
    here, on bytes. A stretch between blanks that holds anything else, or may
    hold a special token, is one unit, left whole.
    """
    ended = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), ""), pa.array([""], pa.large_string())])
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(ended)], ended), pa.scalar(_END, pa.large_string()))
    raw = np.frombuffer(joined.buffers()[2], np.uint8)[: int(pc.binary_length(joined)[0].as_py())]
    ends = np.cumsum(pc.binary_length(ended).to_numpy()[:-1] + 1) - 1
    kind, low = _KIND[raw], _LOWER[raw]
    lead = np.flatnonzero(raw == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # no signs of multiplication and division
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead + 1] |= 0x20 * (raw[lead + 1] < 0x9F).astype(np.uint8)
    blank = kind == _BLANK
    starts = kind == _DIGIT
    starts[:1] = True
    starts[1:] |= kind[1:] != kind[:-1]
    starts &= ~blank

    mark = np.flatnonzero(low == ord("'"))
    mark = mark[starts[mark]]
    one, two = low[mark + 1], low[np.minimum(mark + 2, len(low) - 1)]
    suffix = np.isin(one, [*b"stmd"]) + 2 * (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    mark, suffix = mark[suffix > 0], suffix[suffix > 0]
    starts[mark + 1] = False
    behind = mark + suffix + 1
    starts[behind[kind[behind] == _LETTER]] = True

    strange = np.flatnonzero(kind == _ALIEN)
    special = np.flatnonzero(raw == ord("<"))
    strange = np.append(strange, special[raw[special + 1] == ord("|")])
    blanks = np.flatnonzero(blank)
    after = np.unique(np.searchsorted(blanks, strange))
    whole = np.where(after > 0, blanks[after - 1] + 1, 0)
    own = ranges(whole, blanks[after] - whole)
    low[own], starts[own] = raw[own], False
    starts[whole] = True

    inside = ~blank
    inside[ends] = starts[ends] = True
    stops = inside.copy()
    stops[:-1] &= starts[1:] | ~inside[1:]
    first = np.flatnonzero(starts)
    sizes = np.flatnonzero(stops) + 1 - first
    held = [None, pa.py_buffer(bounds(sizes)), pa.py_buffer(low[inside])]
    return pa.Array.from_buffers(pa.large_string(), len(first), held), np.searchsorted(first, ends), np.searchsorted(first, whole)


class Encoder:
    """Ids of many texts at once: every different unit is encoded once by the tokenizer's model, and remembered.

    Units that ``units`` left whole go through the whole tokenizer.
    """

    def __init__(self, data: str, end_id: int = END_ID):
        self.tokenizer = Tokenizer.from_str(data)
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        """Back to the end mark alone, which is entry 0."""
        self.index: dict[str, int] = {_END: 0}
        self.flat, self.sizes = np.array([self.end_id], np.uint32), np.array([1])

    def learn(self, plain: list[str], whole: list[str]) -> None:
        tokenize = self.tokenizer.model.tokenize
        as_bytes = _BYTE_LEVEL[np.frombuffer(" ".join(plain).encode(), np.uint8)].tobytes().decode("utf-16-le").split(" ")
        self.add(plain, *flattened([[token.id for token in tokenize(u)] for u in as_bytes if u]))
        for start in range(0, len(whole), 2000):
            some = whole[start : start + 2000]
            found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            self.add(some, *flattened([encoding.ids for encoding in found]))

    def add(self, new: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.sizes)
        self.index.update(zip(new, range(at, at + len(new)), strict=True))
        self.flat, self.sizes = np.append(self.flat, ids), np.append(self.sizes, sizes)

    @contextmanager
    def without_collector(self) -> Iterator[None]:
        """Learning makes very many small lists and no cycles: the collector would only walk them again and again."""
        was = gc.isenabled()
        gc.disable()
        try:
            yield
        finally:
            if was:
                gc.enable()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end mark, and where each text's ids start."""
        if len(self.index) > REMEMBERED:
            self.forget()
        found, ends, whole = units(texts)
        coded = found.dictionary_encode()
        codes = coded.indices.to_numpy()
        different = coded.dictionary.to_numpy(zero_copy_only=False)
        as_is = np.zeros(len(different), bool)
        as_is[codes[whole]] = True
        with self.without_collector():
            self.learn(*([u for u in own.tolist() if u not in self.index] for own in (different[~as_is], different[as_is])))
        entry = np.fromiter(map(self.index.__getitem__, different.tolist()), np.int64, len(different))
        sizes, starts = self.sizes[entry], bounds(self.sizes)[entry]
        counts = sizes[codes]
        at = bounds(counts)
        return self.flat[ranges(starts[codes], counts)], at[np.append(0, ends + 1)]


def steps_of(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of rows of about ``limit`` bytes each."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield slice(start, stop)
        start = stop


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Pieces of every document, with the task that made them and their number among its pieces of that length."""
    with open(tokenizer, encoding="utf-8") as source:
        data = source.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        encoder, part = Encoder(data, end_id), TaskContext.get().partitionId()
        made = np.zeros(length + 1, np.int64)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for own in steps_of(sizes, STEP_BYTES):
                ids, at = encoder.encode(texts.slice(own.start, own.stop - own.start))
                raw = ids.astype("<u4").tobytes()
                total = np.diff(at)
                cuts = -(-total // length)
                doc = np.repeat(np.arange(len(total)), cuts)
                piece = ranges(np.zeros(len(total), np.int64), cuts)
                start = piece * length
                size = np.minimum(total[doc] - start, length)
                first = at[:-1][doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + size).tolist(), strict=True)]
                order = np.argsort(size, kind="stable")
                ranked = size[order]
                number = np.empty(len(size), np.int64)
                number[order] = made[ranked] + np.arange(len(size)) - np.searchsorted(ranked, ranked)
                made += np.bincount(size, minlength=length + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(own.start, len(total)).take(pa.array(doc)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(size.astype(np.int32)),
                        pa.array(np.array(crc, np.int64)),
                        pa.array(np.full(len(size), part, np.int32)),
                        pa.array(number),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _PIECES)


# ---- the plan, from histograms ----------------------------------------------


def linear_groups(counts: np.ndarray, groups: int) -> list[tuple[int, int]]:
    """(shortest, longest) of groups of about equal number, over the lengths that occur; a length is never split."""
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    behind = np.cumsum(counts[lengths])
    label = np.minimum((behind - 1) * groups // behind[-1], groups - 1)
    last = np.append(np.flatnonzero(np.diff(label)), len(lengths) - 1)
    first = np.concatenate([[0], last[:-1] + 1])
    return [(int(lengths[a]), int(lengths[b])) for a, b in zip(first, last, strict=True)]


class Knapsack:
    """Multisets of ``sizes`` within ``length`` whose values sum up highest, for changing values."""

    def __init__(self, sizes: np.ndarray, length: int):
        self.length, self.most = length, int(length // sizes.min())
        room = np.arange(length + 1)[:, None] - sizes[None, :]
        self.fits, self.room = room >= 0, np.maximum(room, 0)

    def best(self, values: np.ndarray) -> np.ndarray:
        """How often to take each size."""
        held, best = [], np.zeros(self.length + 1)
        for _ in range(self.most):
            # one item more, or stay
            gain = np.where(self.fits, best[self.room] + values, -1.0)
            item = gain.argmax(1)
            more = gain[np.arange(len(item)), item]
            held.append(np.where(more > best, item, -1))
            best = np.maximum(more, best)
        out, room = np.zeros(len(values), np.int64), self.length
        for items in reversed(held):
            if items[room] >= 0:
                out[items[room]] += 1
                room = self.room[room, items[room]]
        return out


def configurations(sizes: np.ndarray, demand: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(configurations as rows, how often each) of least total that meet ``demand``; fractional, by column generation.

    ``sizes`` ascend. The basis starts with each size alone, as often as it
    fits, and stays feasible throughout. The best configuration's worth bounds
    how far the total is from the least: the end is at ``GAP``.
    """
    basis = np.diag((length // sizes).astype(float))
    inverse = np.linalg.inv(basis)
    amounts = inverse @ demand
    knapsack = Knapsack(sizes, length)
    for step in range(1, MOST_COLUMNS):
        prices = np.maximum(inverse.sum(0), 0.0)
        column = knapsack.best(prices).astype(float)
        if prices @ column <= 1 + GAP:
            break
        change = inverse @ column
        rising = change > 1e-9
        if not rising.any():
            break
        ratio = np.full(len(amounts), np.inf)
        ratio[rising] = np.maximum(amounts[rising], 0) / change[rising]
        out = int(ratio.argmin())
        basis[:, out] = column
        # the inverse follows by one row operation, and is made anew now and then
        row = inverse[out] / change[out]
        inverse = inverse - np.outer(change, row)
        inverse[out] = row
        if step % 50 == 0:
            inverse = np.linalg.inv(basis)
        amounts = inverse @ demand
    amounts = np.linalg.solve(basis, demand)
    return basis.T.round().astype(np.int64), np.maximum(amounts, 0.0)


def best_fit(items: np.ndarray, length: int) -> list[list[int]]:
    """Places of ``items`` (longest first) in bins, each in the fullest that still holds it."""
    room: list[int] = []
    held: list[list[int]] = []
    for i, item in enumerate(items.tolist()):
        fits = [(r, b) for b, r in enumerate(room) if r >= item]
        if fits:
            b = min(fits)[1]
            room[b] -= item
            held[b].append(i)
        else:
            room.append(length - item)
            held.append([i])
    return held


@dataclass
class Layout:
    """Where long pieces go: ``group`` of each length (-1: none), and per group blocks of places.

    A block holds the pieces of ranks ``first`` to ``last`` of its group, one a
    sequence, from ``sequence`` on, or down from the block's last sequence where
    ``down`` is 1. Ranks follow the length; blocks of a configuration take turns
    in direction, so that its shorter pieces meet longer ones.
    """

    group: np.ndarray
    blocks: list[dict[str, np.ndarray]]
    sequences: int

    def sequence_of(self, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(group), np.int64)
        for g in np.unique(group):
            own, b = group == g, self.blocks[g]
            at = np.searchsorted(b["last"], rank[own], "right")
            up, down = rank[own] - b["first"][at], b["last"][at] - 1 - rank[own]
            out[own] = b["sequence"][at] + np.where(b["down"][at] == 1, down, up)
        return out


def lay_out(counts: np.ndarray, length: int = LENGTH, small: int = SMALL, groups: int = GROUPS) -> Layout:
    """Sequences for all pieces longer than ``small``, from the number of pieces of each length."""
    group = np.full(length + 1, -1)
    whole = int(counts[length])
    middle = counts.copy()
    middle[: small + 1] = 0
    middle[length] = 0
    grouped = linear_groups(middle, groups)
    for g, (low, high) in enumerate(grouped):
        group[low : high + 1] = g
    group[length] = len(grouped)
    rows: list[list[tuple]] = [[] for _ in range(len(grouped) + 1)]
    used = np.zeros(len(grouped) + 1, np.int64)
    sequences = 0

    def place(members: list[int], count: int) -> None:
        for turn, g in enumerate(members):
            rows[g].append((used[g], used[g] + count, sequences, turn % 2))
            used[g] += count

    if whole:
        place([len(grouped)], whole)
        sequences += whole
    if grouped:
        sizes = np.array([high for _, high in grouped], np.int64)
        demand = np.array([middle[low : high + 1].sum() for low, high in grouped], np.int64)
        chosen, amounts = configurations(sizes, demand.astype(float), length)
        for config, amount in zip(chosen, np.floor(amounts + 1e-7).astype(np.int64), strict=True):
            # never more places than pieces
            amount = min([int(amount), *((demand[g] - used[g]) // config[g] for g in np.flatnonzero(config))])
            if amount > 0 and config.any():
                place(np.repeat(np.arange(len(sizes)), config).tolist(), amount)
                sequences += amount
        # what is left is less than a configuration's worth for each of them: a number bounded by the groups
        rest = np.repeat(np.arange(len(sizes))[::-1], (demand - used[:-1])[::-1])
        for held in best_fit(sizes[rest], length):
            place(rest[held].tolist(), 1)
            sequences += 1
    names = ("first", "last", "sequence", "down")
    blocks = [{n: np.array([r[i] for r in own], np.int64) for i, n in enumerate(names)} for own in rows]
    return Layout(group, blocks, sequences)


@dataclass
class Steps:
    """Best fit of small pieces, one row a step: pieces of ``length`` with ranks from ``first`` on go ``each`` to a slot,
    from slot ``slot`` on. Slots number the sequences by the room they have left, and new sequences behind them."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    slot: np.ndarray
    slots: int


def fit_small(counts: np.ndarray, room: np.ndarray, length: int = LENGTH) -> Steps:
    """``counts`` of small pieces by length and ``room``: sequences by room left. Slots follow the room, least first."""
    starts = bounds(room)
    spans: list[list[tuple[int, int]]] = [[(int(starts[r]), int(n))] if n else [] for r, n in enumerate(room)]
    slots = int(room.sum())
    rows = []
    for size in range(len(counts) - 1, 0, -1):
        left, rank = int(counts[size]), 0
        at = size
        while left:
            while at <= length and not spans[at]:
                at += 1
            if at > length:
                # new sequences, as many as it takes
                opened = -(-left // (length // size))
                spans[length].append((slots, opened))
                slots += opened
                at = length
            slot, n = spans[at].pop()
            each = at // size
            filled = min(n, left // each)
            if filled:
                rows.append((size, rank, each, slot))
                spans[at - each * size].append((slot, filled))
                rank, left = rank + filled * each, left - filled * each
            if filled < n:
                # the last pieces of this length share one more sequence
                if left:
                    rows.append((size, rank, left, slot + filled))
                    spans[at - left * size].append((slot + filled, 1))
                    rank, left, filled = rank + left, 0, filled + 1
                if filled < n:
                    spans[at].append((slot + filled, n - filled))
    held = np.array(rows, np.int64).reshape(-1, 4).T
    return Steps(*held, slots)


# ---- the plan applied ---------------------------------------------------------


def _numbered(rows: DataFrame, kind: str, rank: str) -> DataFrame:
    """``rank`` from 0 among all rows of one ``kind``, from a row's ``number`` among those of its ``part``."""
    counted = rows.groupBy(kind, "part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(kind).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(kind, "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(offsets, [kind, "part"]).withColumn(rank, F.col("_before") + F.col("number")).drop("_before")


def _histogram(rows: DataFrame, kind: str, size: int) -> np.ndarray:
    """How many rows have each number of ``kind``: at most ``size`` rows reach the driver."""
    out = np.zeros(size, np.int64)
    for row in rows.groupBy(kind).agg(F.count("*").alias("n")).collect():
        out[row[0]] = row["n"]
    return out


def _place_long(layout: Layout, found: DataFrame) -> DataFrame:
    """``sequence_id`` of long pieces by their group's blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence = layout.sequence_of(frame["grp"].to_numpy(), frame["rank"].to_numpy())
            yield frame.drop(columns=["grp", "rank"]).assign(sequence_id=sequence)

    schema = found.drop("grp", "rank").schema.add("sequence_id", "long")
    return found.mapInPandas(run, schema)


def _place_small(steps: Steps, found: DataFrame) -> DataFrame:
    """``slot`` of small pieces by the steps of their length."""
    descending = -steps.length

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size, rank = frame["length"].to_numpy(), frame["rank"].to_numpy()
            slot = np.zeros(len(frame), np.int64)
            for s in np.unique(size):
                own = size == s
                a, b = np.searchsorted(descending, [-s]).item(), np.searchsorted(descending, [-s], "right").item()
                at = a + np.searchsorted(steps.first[a:b], rank[own], "right") - 1
                slot[own] = steps.slot[at] + (rank[own] - steps.first[at]) // steps.each[at]
            yield frame.drop(columns=["rank"]).assign(slot=slot)

    return found.mapInPandas(run, found.drop("rank").schema.add("slot", "long"))


def _slotted(rooms: DataFrame, room: np.ndarray, length: int) -> DataFrame:
    """``slot`` of each sequence (sequence_id, room): numbered by room, the least first."""

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for frame in frames:
            by = frame.groupby("room").cumcount().to_numpy()
            own = frame["room"].to_numpy()
            yield frame.assign(part=part, number=made[own] + by)
            made += np.bincount(own, minlength=length + 1)

    schema = "sequence_id long, room int, part int, number long"
    numbered = _numbered(stored(rooms.mapInPandas(number, schema), "sequence-rooms"), "room", "rank")
    starts = bounds(room)[:-1].tolist()
    start = F.element_at(F.array(*map(F.lit, starts)), F.col("room") + 1).cast("long")
    return numbered.select("sequence_id", (start + F.col("rank")).alias("slot"))


def pack(made: DataFrame, length: int = LENGTH, small: int = SMALL, groups: int = GROUPS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all ``pieces``."""
    made = stored(made, "pieces")
    counts = _histogram(made, "length", length + 1)
    layout = lay_out(counts, length, small, groups)
    grp = F.element_at(F.array(*map(F.lit, layout.group.tolist())), F.col("length") + 1)
    ranked = _numbered(made, "length", "in_length")
    # pieces of a group stand behind the shorter ones of their group
    before = np.zeros(length + 1, np.int64)
    for g in range(layout.group.max() + 1):
        own = np.flatnonzero(layout.group == g)
        before[own] = bounds(counts[own])[:-1]
    start = F.element_at(F.array(*map(F.lit, before.tolist())), F.col("length") + 1)
    ranked = stored(ranked.withColumn("grp", grp).withColumn("rank", F.col("in_length") + start).drop("in_length"), "ranked-pieces")

    long_ones = stored(_place_long(layout, ranked.filter("grp >= 0")), "long-pieces")
    rooms = long_ones.groupBy("sequence_id").agg((F.lit(length) - F.sum("length")).cast("int").alias("room"))
    rooms = stored(rooms, "rooms")
    room = _histogram(rooms, "room", length + 1)
    steps = fit_small(counts[: small + 1], room, length)
    small_ones = _place_small(steps, ranked.filter("grp < 0").drop("grp"))
    slots = _slotted(rooms, room, length)
    opened = int(room.sum())
    # a slot behind the sequences of long pieces is a sequence of its own; slots and sequences are as many
    own = F.coalesce("sequence_id", F.when(F.col("slot") >= opened, F.col("slot")))
    small_ones = small_ones.join(slots, "slot", "left").withColumn("sequence_id", own).drop("slot")
    rows = long_ones.unionByName(small_ones)
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "part", "number")
    before_it = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("offset", F.coalesce(before_it, F.lit(0)).cast("long"))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
