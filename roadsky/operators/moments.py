"""Exact cross-product sums of the model columns, from one pass over the data.

Every ordinary least squares fit over any subset of columns follows from the
sums of z z' with z = (1, columns, products of column pairs). A task adds up
its own rows and hands on one table; Spark sums the tables.

Sums are exact. Every number is cut at fixed places (multiples of 2^20) into
pieces of 20 bits. Products of pieces are whole numbers below 2^40, so a
matrix product over 8,192 rows loses nothing in doubles, in whatever order it
adds. Only columns that have a piece of a weight enter its products: whole
numbers below 2^20 have one. Pieces of one weight are added as whole numbers
(``Limbs``). What comes
out does not depend on the number of partitions, their order, or the blocks,
down to the last bit, and sums about the mean are formed without losing digits,
however far the mean lies: there is no second pass.

Rows may lack values. Sums are kept apart by *which* columns a row lacks (a
bit set of any width), so the rows complete for one model are the sets that
miss none of its columns, and per-model deletion needs no further pass.

Two exchanges lead from tables to models. The plan goes once to each of
``PARTS`` parts, and every table to one of them; sorted, a part reads its
share of the plan first and then streams its tables, adding each set of
missing columns up and giving every model its small block. Blocks go to the
task that solves their model and are added there as they come. No table, block
or plan reaches the driver, no task holds more than its share of the plan, and
no group is handed to Python as one frame.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a piece, and rows of a block: products of pieces over a block stay below 2^53.
PIECE = 20
ROWS = 1 << 13
#: Parts that tables are dealt to, at most.
PARTS = 64
#: Bytes of tables a task holds before it hands them on.
HELD_BYTES = 1 << 26


def read_blocks(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[np.ndarray]:
    """Arrow batches as blocks of columns x rows, missing values as NaN.

    Columns are contiguous, so picking some of them is a plain copy, and a
    block of about ``rows`` rows stays in the processor's cache.
    """
    for batch in batches:
        columns = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(batch.num_columns)]
        for start in range(0, batch.num_rows, rows):
            yield np.array([column[start : start + rows] for column in columns], float)


def extend(block: np.ndarray, pairs: Sequence[tuple[int, int]]) -> np.ndarray:
    """Columns followed by the products of the given column pairs."""
    if not pairs:
        return block
    left, right = (list(side) for side in zip(*pairs))
    return np.vstack([block, block[left] * block[right]])


def sources(columns: int, pairs: Sequence[tuple[int, int]], basis: Sequence[int]) -> list[int]:
    """Source columns behind some basis columns."""
    found: set[int] = set()
    for i in basis:
        found.update([i] if i < columns else pairs[i - columns])
    return sorted(found)


# ---- exact sums --------------------------------------------------------------


@dataclass
class Limbs:
    """Whole numbers as sums of ``data[l] * 2^(20 (low + l))``; any number of them side by side."""

    low: int
    data: np.ndarray

    def spread(self, low: int, high: int) -> Limbs:
        """The same numbers with room for the weights from ``low`` up to ``high``."""
        low, high = min(low, self.low), max(high, self.low + len(self.data))
        if low == self.low and high == self.low + len(self.data):
            return self
        data = np.zeros((high - low, *self.data.shape[1:]), np.int64)
        data[self.low - low : self.low - low + len(self.data)] = self.data
        return Limbs(low, data)

    def plus(self, other: Limbs) -> Limbs:
        """Sum of both, into own memory where it has room."""
        out = self.spread(other.low, other.low + len(other.data))
        out.data[other.low - out.low : other.low - out.low + len(other.data)] += other.data
        return out

    def carried(self) -> Limbs:
        """The same numbers with 20 bits a limb, but for the sign in the highest."""
        data = [row.copy() for row in self.data]
        at = 0
        while at < len(data) - 1 or np.any(np.abs(data[at]) >= 1 << PIECE):
            if at == len(data) - 1:
                data.append(np.zeros_like(data[0]))
            carry = data[at] >> PIECE
            data[at] -= carry << PIECE
            data[at + 1] += carry
            at += 1
        return Limbs(self.low, np.array(data))

    def whole(self) -> list[int]:
        """Each number over 2^(20 low), as a whole number of any size."""
        data = self.carried().data
        data = data.reshape(len(data), -1)
        out = [0] * data.shape[1]
        # three limbs at a time fit in 64 bits
        for start in range(0, len(data), 3):
            held = sum(row << (PIECE * i) for i, row in enumerate(data[start : start + 3]))
            out = [x + (v << (PIECE * start)) for x, v in zip(out, held.tolist(), strict=True)]
        return out


def cut(block: np.ndarray) -> tuple[int, list[tuple[np.ndarray, np.ndarray]], int]:
    """(weight of the first, pieces, columns): whole numbers below 2^20 of falling weights 2^(20 s) that add up to ``block``.

    A piece holds only the columns (rows of ``block``) in which it is not zero: their places, and their numbers.
    """
    most = float(np.abs(block).max(initial=0.0))
    weight = -(-int(np.frexp(most)[1]) // PIECE) - 1
    at, rest, found, first = np.arange(len(block)), block.copy(), [], weight
    while True:
        # powers of two: nothing is rounded; beyond 2^±1000 ldexp keeps them in range
        if abs(weight) < 50:
            piece = np.trunc(rest * 2.0 ** (-PIECE * weight))
            rest -= piece * 2.0 ** (PIECE * weight)
        else:
            piece = np.trunc(np.ldexp(rest, -PIECE * weight))
            rest -= np.ldexp(piece, PIECE * weight)
        there, left = piece.any(1), rest.any(1)
        found.append((at[there], piece[there]))
        if not left.any():
            return first, found, len(block)
        at, rest = at[left], rest[left]
        weight -= 1


def products(first: int, pieces: Sequence[tuple[np.ndarray, np.ndarray]], size: int) -> Limbs:
    """Exact sums of z z', upper triangle, of at most ``ROWS`` columns of z given in pieces."""
    count = len(pieces)
    ends = np.cumsum([0, *(len(at) for at, _ in pieces)])
    stack = np.concatenate([piece for _, piece in pieces])
    both = (stack @ stack.T).astype(np.int64)
    levels = np.zeros((2 * count - 1, size, size), np.int64)
    for a, (down, _) in enumerate(pieces):
        for b, (across, _) in enumerate(pieces):
            levels[2 * (count - 1) - a - b][np.ix_(down, across)] += both[ends[a] : ends[a + 1], ends[b] : ends[b + 1]]
    upper = np.triu_indices(size)
    return Limbs(2 * (first - count + 1), levels[:, upper[0], upper[1]]).carried()


def triangle(size: int) -> np.ndarray:
    """Place of each (row, column) in an upper triangle told row by row; either way round."""
    at = np.zeros((size, size), np.int64)
    upper = np.triu_indices(size)
    at[upper] = np.arange(len(upper[0]))
    return np.maximum(at, at.T)


def about_means(sums: Limbs, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, products about the means) of z = (1, ``size - 1`` columns); each rounded once."""
    numbers, down = sums.whole(), -PIECE * sums.low
    at = triangle(size)
    rows = numbers[0] >> down if down >= 0 else numbers[0] << -down
    means, table = np.zeros(size - 1), np.zeros((size - 1, size - 1))
    if not rows:
        return 0, means, table

    def ratio(a: int, b: int, shift: int) -> float:
        """a / b / 2^shift."""
        try:
            return a / (b << shift) if shift >= 0 else (a << -shift) / b
        except OverflowError:
            return float("inf") if a > 0 else float("-inf")

    total = [numbers[at[0, i]] for i in range(size)]
    for i in range(1, size):
        means[i - 1] = ratio(total[i], rows, down)
        for j in range(i, size):
            # (n Sij - Si Sj) / n in units of 2^(-2 down)
            held = (numbers[at[i, j]] * rows << down if down >= 0 else numbers[at[i, j]] * rows >> -down) - total[i] * total[j]
            table[i - 1, j - 1] = table[j - 1, i - 1] = ratio(held, rows, 2 * down)
    return rows, means, table


# ---- tables ------------------------------------------------------------------

_TABLE = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("mask", T.BinaryType()),
        T.StructField("low", T.IntegerType()),
        T.StructField("table", T.BinaryType()),
        T.StructField("bad", T.BinaryType()),
    ]
)


def partial_tables(frame: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[int, int]], parts: int) -> DataFrame:
    """(part, mask, low, table, bad): each task's sums per set of missing columns, and which basis columns overflowed."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, Limbs] = {}
        bad: dict[bytes, np.ndarray] = {}
        part = TaskContext.get().partitionId() % parts

        def out() -> pa.RecordBatch:
            held = {mask: each.carried() for mask, each in sums.items()}
            return pa.RecordBatch.from_pydict(
                {
                    "part": np.full(len(held), part, np.int32),
                    "mask": pa.array(list(held), pa.binary()),
                    "low": np.array([each.low for each in held.values()], np.int32),
                    "table": pa.array([each.data.astype(np.int32).tobytes() for each in held.values()], pa.binary()),
                    "bad": pa.array([np.packbits(bad[mask]).tobytes() for mask in held], pa.binary()),
                }
            )

        for block in read_blocks(batches):
            missing = np.isnan(block)
            if missing.any():
                packed = np.ascontiguousarray(np.packbits(missing, axis=0).T)
                keys, group = np.unique(packed.view(f"V{packed.shape[1]}").ravel(), return_inverse=True)
                # rows that lack the same columns stand together
                block = block[:, np.argsort(group, kind="stable")]
                ends = np.cumsum([0, *np.bincount(group, minlength=len(keys))])
                groups = [(key.tobytes(), slice(*own)) for key, own in zip(keys, zip(ends, ends[1:]), strict=True)]
            else:
                groups = [(bytes(-(-len(block) // 8)), slice(None))]
            with np.errstate(over="ignore"):
                basis = extend(block, pairs)
            infinite = np.isinf(basis)
            z = np.ones((len(basis) + 1, basis.shape[1]))
            z[1:] = np.where(np.isfinite(basis), basis, 0.0)
            first, pieces, size = cut(z)
            for mask, rows in groups:
                found = products(first, [(at, piece[:, rows]) for at, piece in pieces], size)
                overflowed = infinite[:, rows].any(1)
                if mask in sums:
                    sums[mask], bad[mask] = sums[mask].plus(found), bad[mask] | overflowed
                else:
                    sums[mask], bad[mask] = found, overflowed
            if sum(each.data.nbytes for each in sums.values()) > HELD_BYTES:
                yield out()
                sums, bad = {}, {}
        if sums:
            yield out()

    return frame.select(*columns).mapInArrow(partial, _TABLE)


class Blocks:
    """A share of the plan: every model's block, filled from tables as they come."""

    def __init__(self, columns: int, pairs: Sequence[tuple[int, int]], bases: list[list[int]]):
        self.columns, self.size = columns, 1 + columns + len(pairs)
        self.at = triangle(self.size)
        by_width = defaultdict(list)
        for model, basis in enumerate(bases):
            by_width[len(basis)].append(model)
        self.groups = []
        for width, models in by_width.items():
            index = np.array([[0, *(i + 1 for i in bases[m])] for m in models], np.int64).reshape(len(models), width + 1)
            needed = np.zeros((len(models), columns), bool)
            for row, m in enumerate(models):
                needed[row, sources(columns, pairs, bases[m])] = True
            upper = np.triu_indices(width + 1)
            places = self.at[index[:, upper[0]], index[:, upper[1]]]
            used = index[:, 1:] - 1
            self.groups.append([np.array(models), np.packbits(needed, axis=1), places, used, None, np.zeros((len(models), 2), bool)])

    def add(self, mask: bytes, sums: Limbs, bad: np.ndarray) -> None:
        lacking = np.frombuffer(mask, np.uint8)
        for group in self.groups:
            _, needed, places, used, held, met = group
            fits = np.flatnonzero(~(needed & lacking).any(1))
            if not len(fits):
                continue
            high = sums.low + len(sums.data)
            held = Limbs(sums.low, np.zeros((len(sums.data), *places.shape), np.int64)) if held is None else held.spread(sums.low, high)
            start = sums.low - held.low
            held.data[start : start + len(sums.data), fits] += sums.data[:, places[fits]]
            met[fits, 0] = True
            met[fits, 1] |= bad[used[fits]].any(1)
            group[4] = held

    def rows(self) -> Iterator[tuple[int, int, bytes, bool]]:
        """(model, low, block, overflowed) of the models that have rows."""
        for models, _, _, _, held, met in self.groups:
            there = np.flatnonzero(met[:, 0])
            for some in np.array_split(there, -(-len(there) // 10_000) or 1):
                if not len(some):
                    continue
                blocks = Limbs(held.low, held.data[:, some]).carried()
                data = np.ascontiguousarray(blocks.data.transpose(1, 0, 2)).astype(np.int32)
                for model, block, bad in zip(models[some].tolist(), data, met[some, 1].tolist(), strict=True):
                    yield model, blocks.low, block.tobytes(), bad


def in_lots(rows: Iterable, size: int) -> Iterator[list]:
    rows = iter(rows)
    while some := list(islice(rows, size)):
        yield some


def runs_of(batch: pa.RecordBatch) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(part, whether rows of the plan, rows) of a batch sorted that way."""
    part = batch.column("part").to_numpy()
    plan = np.asarray(batch.column("mask").is_null())
    ends = np.flatnonzero((part[1:] != part[:-1]) | (plan[1:] != plan[:-1])) + 1
    for a, b in zip([0, *ends], [*ends, len(part)], strict=True):
        if b > a:
            yield int(part[a]), bool(plan[a]), batch.slice(a, b - a)


def with_blocks(models: pa.Table, held: Sequence[list]) -> Iterator[pa.RecordBatch]:
    for name, kind, values in zip(("low", "block", "overflowed"), (pa.int32(), pa.binary(), pa.bool_()), held, strict=True):
        models = models.append_column(name, pa.array(values, kind))
    yield from models.combine_chunks().to_batches()


def model_sums(frame: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[int, int]], plan: DataFrame, basis_of) -> DataFrame:
    """Rows of ``plan`` with (low, block, overflowed), several a model, to be added up; a model's first row may have none.

    ``basis_of`` tells the basis columns of a plan row. Model ids are unique.
    """
    columns, pairs = list(columns), list(pairs)
    parts = min(PARTS, int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = plan.columns
    tables = partial_tables(frame, columns, pairs, parts)
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in (*_TABLE[1:], *plan.schema)}
    shares = plan.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), *[none[n] for n in _TABLE.names[1:]], *names
    )
    both = shares.unionByName(tables.select("*", *[none[n] for n in names]))
    # the plan's rows have no mask, and nulls come first
    dealt = both.repartition("part").sortWithinPartitions("part", "mask")
    schema = T.StructType([*plan.schema, *T.StructType.fromDDL("low int, block binary, overflowed boolean")])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, models, blocks, current = None, [], None, None

        def flush() -> None:
            nonlocal current
            if current is not None:
                blocks.add(*current)
                current = None

        def finished() -> Iterator[pa.RecordBatch]:
            flush()
            own = pa.Table.from_batches(models)
            found = [] if blocks is None else blocks.rows()
            seen = np.zeros(len(own), bool)
            for some in in_lots(found, 5_000):
                at = [model for model, *_ in some]
                seen[at] = True
                yield from with_blocks(own.take(pa.array(at)), [list(x) for x in zip(*some, strict=True)][1:])
            if part == 0 and not seen.all():
                # a model without any row is told once
                left = own.filter(pa.array(~seen))
                yield from with_blocks(left, [[None] * len(left), [None] * len(left), [False] * len(left)])

        for batch in batches:
            for own, first, some in runs_of(batch):
                if own != part:
                    if part is not None:
                        yield from finished()
                    part, models, blocks = own, [], None
                if first:
                    models.append(some.select(names))
                    continue
                if blocks is None:
                    bases = [basis_of(Row(**row)) for held in models for row in held.to_pylist()]
                    blocks = Blocks(len(columns), pairs, bases)
                width = blocks.size * (blocks.size + 1) // 2
                for mask, low, table, bad in zip(*(some.column(n).to_pylist() for n in _TABLE.names[1:]), strict=True):
                    sums = Limbs(low, np.frombuffer(table, np.int32).reshape(-1, width).astype(np.int64))
                    overflowed = np.unpackbits(np.frombuffer(bad, np.uint8), count=blocks.size - 1).astype(bool)
                    if current is not None and current[0] == mask:
                        current = (mask, current[1].plus(sums), current[2] | overflowed)
                    else:
                        flush()
                        current = (mask, sums, overflowed)
        if part is not None:
            yield from finished()

    return dealt.mapInArrow(share, schema)


def summed_models(rows: Iterable[pd.DataFrame], width_of) -> Iterator[tuple[object, Limbs | None, bool]]:
    """(row, sums, overflowed) of each model, from rows of ``model_sums`` that stand together by model."""
    held, sums, overflowed = None, None, False
    for frame in rows:
        for row in frame.itertuples(index=False):
            if held is None or row.model_id != held.model_id:
                if held is not None:
                    yield held, sums, overflowed
                held, sums, overflowed = row, None, False
            if row.block is not None:
                size = width_of(row) + 1
                own = Limbs(int(row.low), np.frombuffer(row.block, np.int32).reshape(-1, size * (size + 1) // 2).astype(np.int64))
                sums = own if sums is None else sums.plus(own)
                overflowed |= bool(row.overflowed)
    if held is not None:
        yield held, sums, overflowed


@dataclass
class Moments:
    """Means of basis columns, each over the rows that have it."""

    frame: DataFrame
    columns: list[str]
    pairs: list[tuple[int, int]]

    def column_means(self) -> tuple[np.ndarray, bool]:
        """The means, and whether they lie too far from zero for the sums' digits: never, sums being exact."""
        size = len(self.columns) + len(self.pairs)
        plan = self.frame.sparkSession.range(size).select(F.col("id").alias("model_id"))
        rows = model_sums(self.frame, self.columns, self.pairs, plan, lambda row: [row.model_id])

        def means(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for row, sums, _ in summed_models(frames, lambda row: 1):
                mean = about_means(sums, 2)[1][0] if sums is not None else np.nan
                yield pd.DataFrame({"model_id": [row.model_id], "mean": [mean]})

        sorted_rows = rows.repartition("model_id").sortWithinPartitions("model_id")
        found = np.full(size, np.nan)
        for row in sorted_rows.mapInPandas(means, "model_id long, mean double").collect():  # one row a column
            found[row["model_id"]] = row["mean"]
        return found, False


def moments_of(frame: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[int, int]] = ()) -> Moments:
    return Moments(frame, list(columns), list(pairs))
