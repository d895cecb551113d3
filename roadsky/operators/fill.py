"""Fill missing values along time within a group.

``forward``       last value at or before the row
``backward``      next value at or after the row
``forward_then_backward``  forward, then backward for what is still missing
``first_seen``    earliest value of the group up to the row

Rows are ordered by time, then by the ``tie`` columns, and last by a hash of
the whole row. So the order does not depend on how the rows are partitioned;
rows that are equal in every column change places freely without effect.

One way serves all sizes. The rows are dealt into ranges of (group, order) and
written once; each range of a group is filled by itself, and what the ranges
before and after it hold is carried over, at most two small rows a range. A
group of any size falls into as many ranges as its rows need, and no row is
looked up by its key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsky.session import scratch_path

METHODS = ("forward", "backward", "forward_then_backward", "first_seen")
_ROW, _OTHER, _RANGE = "_row_hash", "_row_check", "_range"


def fill_missing(
    df: DataFrame,
    values: Sequence[str],
    group: Sequence[str],
    time: str,
    tie: Sequence[str] = (),
    method: str = "forward",
    ranges: int | None = None,
) -> DataFrame:
    """Fill ``values`` within ``group`` along ``time``.

    ``ranges`` is the number of ranges, by default that of shuffle partitions;
    the result is the same for any number.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    order = [time, *tie, _ROW, _OTHER]
    parts = [*group, _RANGE]
    whole = [F.col(f"`{name}`") for name in df.columns]
    hashed = df.withColumns({_ROW: F.xxhash64(*whole), _OTHER: F.hash(*whole)})
    keys = [*group, *order]
    dealt = hashed.repartitionByRange(ranges, *keys) if ranges else hashed.repartitionByRange(*keys)
    # The bounds come from a sample and the rows are read twice below: written once, they stay as they are.
    path = scratch_path(df.sparkSession, "fill")
    dealt = dealt.withColumn(_RANGE, F.spark_partition_id())
    if method in ("backward", "forward_then_backward"):
        # looking ahead is looking back over the reversed order
        against = dealt.sortWithinPartitions(*group, *[F.desc(name) for name in order])
        dealt = _locally(against, values, group, "_bwd_")
    if method != "backward":
        along = dealt.sortWithinPartitions(*group, *order)
        dealt = _locally(along, values, group, "_first_" if method == "first_seen" else "_fwd_")
    dealt.write.option("compression", "zstd").parquet(path)
    rows = df.sparkSession.read.schema(dealt.schema).parquet(path)

    carry = _carried(rows, values, group, order)
    same_part = reduce(and_, [F.col(name).eqNullSafe(F.col(f"_c_{name}")) for name in parts])
    found = {v: _pick(method, v).alias(v) for v in values}
    joined = rows.join(F.broadcast(carry), same_part, "left")
    return joined.select(*[found.get(name, F.col(f"`{name}`")) for name in df.columns])


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal, and so are NaNs."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    if pa.types.is_nested(column.type):
        return np.array([x != y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], bool)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(column.type):
        both = pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False))
        differ = differ & ~both.to_numpy(zero_copy_only=False)
    none = [pc.is_null(x).to_numpy(zero_copy_only=False) for x in (a, b)]
    return differ | (none[0] != none[1])


def _locally(ordered: DataFrame, values: Sequence[str], group: Sequence[str], prefix: str) -> DataFrame:
    """``<prefix><value>`` of each row: the last value of its group so far in its range, or the first one for ``_first_``.

    Rows come sorted, so a range needs no exchange of its own and only the last row's state is held.
    """
    own = ordered.schema
    schema = T.StructType([*own.fields, *[T.StructField(f"{prefix}{v}", own[v].dataType) for v in values]])
    names = ordered.columns
    group_at, value_at = [names.index(g) for g in group], [names.index(v) for v in values]
    first_only = prefix == "_first_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, carried = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = np.arange(n)
            columns = [batch.column(i) for i in group_at]
            new = np.zeros(n, bool)
            for i, column in enumerate(columns):
                if before is None:
                    new[1:] |= _changes(column)
                else:
                    new |= _changes(pa.concat_arrays([before[i], column]))
            if before is None:
                new[0] = True
            before = [column.slice(n - 1, 1) for column in columns]
            begun = np.maximum.accumulate(np.where(new, at, -1))  # -1: the group goes on from the batch before
            made = []
            for k, i in enumerate(value_at):
                column = batch.column(i)
                held = pa.nulls(1, column.type) if carried is None else carried[k]
                there = pc.is_valid(column).to_numpy(zero_copy_only=False)
                # place 0 is what was held, a row's own value is one further on
                if first_only:
                    seen = np.maximum.accumulate(np.where(there, at, -1))
                    earlier = np.append(-1, seen[:-1]) >= np.maximum(begun, 0)
                    there &= ~earlier & ((begun >= 0) | (held.null_count == 1))
                found = np.maximum.accumulate(np.where(there, at, -1))
                known = found >= np.maximum(begun, 0)
                place = pa.array(np.where(known, found + 1, 0), mask=~known & (begun >= 0))
                made.append(pa.concat_arrays([held, column]).take(place))
            carried = [column.slice(n - 1, 1) for column in made]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema.names)

    return ordered.mapInArrow(run, schema)


def _carried(rows: DataFrame, values: Sequence[str], group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """What each range of a group gets from the ranges before and behind it.

    Only a group's ranges take part here, not its rows. A range is entered by
    one group from before and left by one, so at most two rows a range remain.
    """
    parts = [*group, _RANGE]
    moment = F.struct(*order)
    ends = rows.groupBy(*parts).agg(
        *[F.min_by(F.col(v), F.when(F.col(v).isNotNull(), moment)).alias(f"_head_{v}") for v in values],
        *[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), moment)).alias(f"_tail_{v}") for v in values],
    )
    before = Window.partitionBy(*group).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*group).orderBy(F.desc(_RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    carried = {}
    for v in values:
        carried[f"_from_before_{v}"] = F.last(f"_tail_{v}", ignorenulls=True).over(before)
        carried[f"_from_behind_{v}"] = F.last(f"_head_{v}", ignorenulls=True).over(behind)
        carried[f"_earliest_{v}"] = F.first(f"_head_{v}", ignorenulls=True).over(before)
    useful = reduce(or_, [F.col(name).isNotNull() for name in carried])
    carry = ends.withColumns(carried).select(*parts, *carried).filter(useful)
    return carry.withColumnsRenamed({name: f"_c_{name}" for name in parts})


def _pick(method: str, v: str) -> Column:
    near, ahead, first = (f"`{name}_{v}`" for name in ("_fwd", "_bwd", "_first"))
    before, behind, earliest = (f"`{name}_{v}`" for name in ("_from_before", "_from_behind", "_earliest"))
    if method == "forward":
        return F.coalesce(near, before)
    if method == "backward":
        return F.coalesce(ahead, behind)
    if method == "first_seen":
        return F.coalesce(f"`{v}`", earliest, first)
    return F.coalesce(near, before, ahead, behind)
