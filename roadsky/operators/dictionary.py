"""Ratings by the entries of a dictionary table that stand inside a text.

Entries and texts are read as UTF-8, eight bytes a step. The entries become a
tree of such steps: a step leads from a node and its eight bytes to the next
node, an end from a node and the last one to eight bytes of an entry to the
place of its rating. Every position of a text is looked up, whatever the number
of entries: a table of marks leaves out nearly all positions at which no entry
can begin, the others go down the tree together. Bytes are compared themselves,
so nothing but an entry is found.

The tree is a few sorted arrays of numbers, some 25 bytes a step and an end,
and the marks take 16 to 32 bytes a first step.
The dictionary is written to the shared folder once, where its size is checked
and tasks read it; neither it nor the tree goes through the driver. The
earliest place met decides, and a text at the first place is left alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsky.functions.conditions import is_missing_text
from roadsky.functions.weather_words import UNKNOWN
from roadsky.session import bounded_batches, scratch_path

#: Entries of a dictionary, and characters of all of them, at most: trees of some 250 MB.
MOST_ENTRIES = 4_000_000
MOST_CHARACTERS = 32_000_000
#: Bytes of a step, and positions that are looked up at once.
STEP = 8
POSITIONS = 1 << 18
#: A place beyond all: no entry.
NONE = np.iinfo(np.int16).max


def entries_of(table: DataFrame, ratings: Sequence[str]) -> str | None:
    """Path of (lower-case entry, place of its best rating); raises where the table is too large for tasks to hold.

    Empty entries, null ones and those of other ratings are left out. ``None`` without entries.
    """
    spark = table.sparkSession
    place = F.array_position(F.array(*[F.lit(r) for r in ratings]), F.col("rating")).cast("int") - 1
    rows = table.select(F.lower("entry").alias("entry"), place.alias("place"))
    rows = rows.filter((F.length("entry") > 0) & (F.col("place") >= 0)).groupBy("entry").agg(F.min("place").alias("place"))
    path = scratch_path(spark, "dictionary")
    rows.write.parquet(path)
    size = spark.read.schema("entry string, place int").parquet(path).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.length("entry")), F.lit(0)).alias("characters")
    ).first()
    if size["n"] > MOST_ENTRIES or size["characters"] > MOST_CHARACTERS:
        raise ValueError(f"a dictionary of {size['n']} entries and {size['characters']} characters is too large to be held by tasks")
    return path if size["n"] else None


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 of all texts with eight zeros behind, where each begins and the last ends)."""
    held = texts.cast(pa.large_binary())
    starts = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = np.zeros(starts[-1] - starts[0] + STEP, np.uint8)
    if len(data) > STEP:
        data[:-STEP] = np.frombuffer(held.buffers()[2], np.uint8)[starts[0] : starts[-1]]
    return data, starts - starts[0]


def words_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, without a copy."""
    return np.ndarray(len(data) - STEP + 1, "<u8", data, strides=(1,))


def first_bytes(words: np.ndarray, n: int) -> np.ndarray:
    return words if n == STEP else words & np.uint64((1 << (8 * n)) - 1)


class Steps:
    """A number for each (node, eight bytes or fewer): sorted by a mix of both, and both compared."""

    def __init__(self, nodes: np.ndarray, words: np.ndarray, values: np.ndarray):
        """Pairs differ from each other."""
        self.salt = 0
        while True:
            mixed = self.mix(nodes, words)
            at = np.argsort(mixed)
            self.mixed = mixed[at]
            if (self.mixed[1:] != self.mixed[:-1]).all():
                break
            self.salt += 1  # two pairs met in one number
        self.nodes, self.words, self.values = nodes[at], words[at], values[at]

    def mix(self, nodes, words: np.ndarray) -> np.ndarray:
        mixed = words ^ ((np.asarray(nodes).astype(np.uint64) + np.uint64(self.salt << 32)) * np.uint64(0x9E3779B97F4A7C15))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return mixed ^ (mixed >> np.uint64(32))

    def look_up(self, nodes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which pairs are there, where their values stand)."""
        place = np.searchsorted(self.mixed, self.mix(nodes, words))
        place[place == len(self.mixed)] = 0
        found = np.flatnonzero((self.words[place] == words) & (self.nodes[place] == nodes))
        return found, place[found]


def next_nodes(nodes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, Steps | None]:
    """The node that each (node, eight bytes) leads to, equal pairs to one, and the steps that say so."""
    if not len(nodes):
        return nodes, None
    order = np.lexsort((words, nodes))
    nodes, words = nodes[order], words[order]
    new = np.concatenate([[True], (nodes[1:] != nodes[:-1]) | (words[1:] != words[:-1])])
    reached = np.empty(len(order), np.int32)
    reached[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    first = np.flatnonzero(new)
    return reached, Steps(nodes[first], words[first], np.arange(len(first), dtype=np.int32))


class Marks:
    """Marks of the words at which something can begin; a few others have them too."""

    def __init__(self, words: np.ndarray):
        bits = max(10, int(16 * len(words) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.there = np.zeros(1 << bits, bool)
        self.there[self.places(words)] = True

    def places(self, words: np.ndarray) -> np.ndarray:
        return ((words * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def marked(self, words: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.there[self.places(words)])


class Tree:
    """Per step: ends by their number of bytes, and the steps that lead on. Entries differ from each other."""

    def __init__(self, entries: pa.Array, places: np.ndarray):
        places = places.astype(np.int16, copy=False)
        data, starts = bytes_of(entries)
        words, at, ends = words_of(data), starts[:-1].copy(), starts[1:]
        nodes = np.zeros(len(at), np.int32)
        self.levels: list[tuple[dict[int, Steps], Steps | None]] = []
        while len(at):
            own, left = words[at], ends - at
            last = {}
            for n in range(1, STEP + 1):
                these = np.flatnonzero(left == n)
                if len(these):
                    last[n] = Steps(nodes[these], first_bytes(own[these], n), places[these])
            further = np.flatnonzero(left > STEP)
            nodes, on = next_nodes(nodes[further], own[further])
            self.levels.append((last, on))
            at, ends, places = at[further] + STEP, ends[further], places[further]
        last, on = self.levels[0]
        # by number of bytes: where an end of the first step, or a way on from it, can begin
        self.marks = {n: Marks(steps.words) for n, steps in last.items() if n < STEP}
        whole = [steps.words for steps in (last.get(STEP), on) if steps is not None]
        if whole:
            self.marks[STEP] = Marks(np.concatenate(whole))

    def best_places(self, texts: pa.Array) -> np.ndarray:
        """The least place of an entry inside each text; ``NONE`` without one."""
        best = np.full(len(texts), NONE, np.int16)
        data, starts = bytes_of(texts)
        words = words_of(data)
        for start in range(0, len(data) - STEP, POSITIONS):
            some = words[start : min(start + POSITIONS, len(data) - STEP)].astype(np.uint64)
            for n, marks in self.marks.items():
                at = marks.marked(first_bytes(some, n)) + start
                text = np.searchsorted(starts, at, side="right") - 1
                open_ = np.flatnonzero(best[text] > 0)
                self._descend(words, starts, at[open_], text[open_], best, n)
        return best

    def _descend(self, words: np.ndarray, starts: np.ndarray, at: np.ndarray, text: np.ndarray, best: np.ndarray, n: int) -> None:
        """From positions ``at`` down the tree, as far as texts and entries go; at the first step, ends of ``n`` bytes only."""
        nodes = np.zeros(len(at), np.int32)
        for depth, (last, on) in enumerate(self.levels):
            if not len(at):
                return
            own, left = words[at].astype(np.uint64), starts[text + 1] - at
            for length, steps in last.items():
                if depth or length == n:
                    found, number = steps.look_up(nodes, first_bytes(own, length))
                    inside = left[found] >= length
                    np.minimum.at(best, text[found[inside]], steps.values[number[inside]])
            if on is None or n < STEP:
                return
            found, number = on.look_up(nodes, own)
            inside = left[found] > STEP
            found = found[inside]
            at, text, nodes = at[found] + STEP, text[found], on.values[number[inside]]


def tree_of(path: str | None) -> Tree | None:
    """The tree over a written dictionary; ``None`` without entries."""
    if path is None:
        return None
    files, inner = fs.FileSystem.from_uri(path)
    table = ds.dataset(inner, filesystem=files, format="parquet").to_table(columns=["entry", "place"])
    entries, places = pa.concat_arrays([x.cast(pa.large_binary()) for x in table["entry"].chunks]), table["place"].to_numpy().astype(np.int16)
    del table
    tree = Tree(entries, places)
    del entries
    pa.default_memory_pool().release_unused()
    return tree


def rating_from_entries(df: DataFrame, text: str, table: DataFrame, ratings: Sequence[str], out: str) -> DataFrame:
    """``df`` with the first rating, in the order of ``ratings``, of which an entry of ``table`` (entry, rating) is inside the text.

    Letter case does not matter. Missing texts and texts without an entry are ``unknown``.
    """
    bounded_batches(df.sparkSession)
    path, ratings = entries_of(table, ratings), list(ratings)
    lowered = F.when(~is_missing_text(F.col(text)), F.lower(F.col(text)))
    names = [name for name in df.columns if name != out]
    rows = df.select(*names, lowered.alias("_lowered"))
    schema = df.select(*names).schema.add(out, "string")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = tree_of(path)
        told = pa.array([*ratings, UNKNOWN], pa.string())
        for batch in batches:
            best = np.full(batch.num_rows, NONE) if tree is None else tree.best_places(batch.column(len(names)))
            rated = told.take(pa.array(np.minimum(best, len(ratings))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], rated], [*names, out])

    return rows.mapInArrow(rate, schema)
