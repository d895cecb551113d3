"""Exact-size repeatable samples and splits."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PREFIX = 5  # hex digits that decide a split
_DIGITS = 3  # hex digits of one counting pass: at most 4,096 counts reach the driver
# At most this many rows around the end of a sample are told to the driver by their hashes.
EDGE_ROWS = 10_000


def row_hash(keys: Sequence[str], seed: int = 0) -> Column:
    """md5 of the key columns and the seed; equal in other engines too."""
    parts = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


@dataclass
class Edge:
    """Where the ``wanted`` smallest texts of a column end.

    Texts below ``bound`` belong to them, and ``left`` rows of those that
    begin with it (all of them if ``left`` is None).
    """

    bound: str
    left: int | None


def smallest(rows: DataFrame, name: str, wanted: Callable[[int], int], edge_rows: int = EDGE_ROWS) -> Edge | None:
    """The edge of the ``wanted(number of rows)`` smallest texts of hex digits, all of one length; None if there are none.

    Selection by counting: rows are counted by their next digits, the digits
    in which the sample ends are fixed, and only rows that begin with them are
    counted again. What all of them have in common is skipped, so a group of
    equal texts costs no passes. Every pass is a plain aggregate; no rows are
    sorted, and what reaches the driver is bounded.
    """
    prefix, left, column = "", None, F.col(name)
    while True:
        at = F.substring(column, 1, len(prefix) + _DIGITS).alias("level")
        inside = rows.filter(column.startswith(prefix)) if prefix else rows
        counted = inside.groupBy(at).agg(F.count("*").alias("n"), F.min(name).alias("least"), F.max(name).alias("most"))
        levels = sorted(counted.collect())  # at most 16 ** _DIGITS
        if left is None:
            left = wanted(sum(level["n"] for level in levels))
        if not left:
            return None
        for level in levels:
            if level["n"] >= left:
                break
            left -= level["n"]
        else:
            return Edge("g", None)  # beyond all digits: every row
        prefix = os.path.commonprefix([level["least"], level["most"]])
        if level["n"] == left:
            return Edge(prefix, None)
        if level["least"] == level["most"]:
            return Edge(prefix, left)
        if level["n"] <= edge_rows:
            break
    for row in sorted(rows.filter(column.startswith(prefix)).groupBy(name).count().collect()):  # at most edge_rows
        if row["count"] >= left:
            return Edge(row[name], left if row["count"] > left else None)
        left -= row["count"]


def sample_exact(
    df: DataFrame,
    fraction: float,
    keys: Sequence[str] | None = None,
    seed: int = 0,
    edge_rows: int = EDGE_ROWS,
) -> DataFrame:
    """Exactly ``int(rows * fraction)`` rows: those with the smallest key hash.

    Rows with equal keys follow in the order of the hash of the whole row. The
    sample grows with the data, so there is no sort and no top-k: its end in
    the order of the two hashes is found by counting (:func:`smallest`), and
    rows below it pass a plain filter. Only of the row at the edge itself are
    copies folded and the last ones cut off.
    """
    keys, names = list(keys or df.columns), df.columns
    hashed = df.withColumn("_hash", F.concat(row_hash(keys, seed), row_hash(names, seed)))
    edge = smallest(hashed.select("_hash"), "_hash", lambda rows: math.floor(rows * fraction), edge_rows)
    if edge is None:
        return df.limit(0)
    below = hashed.filter(F.substring("_hash", 1, len(edge.bound)) <= edge.bound if edge.left is None else F.col("_hash") < edge.bound)
    if edge.left is None:
        return below.select(*names)
    # rows of equal hashes are copies of one row
    at_edge = hashed.filter(F.col("_hash") == edge.bound).groupBy("_hash", *names).agg(F.count("*").alias("_copies"))
    order = Window.partitionBy("_hash").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        at_edge.withColumn("_upto", F.sum("_copies").over(order))
        .withColumn("_take", F.least("_copies", F.lit(edge.left) - F.col("_upto") + F.col("_copies")))
        .filter(F.col("_take") > 0)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_take"))))
        .select(*names)
    )
    return below.select(*names).unionByName(cut)


def sample_approximate(df: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """About ``fraction`` of the rows in one pass."""
    return df.sample(fraction=fraction, seed=seed)


def split_random(df: DataFrame, share: float = 0.7, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Random train and test parts."""
    train, test = df.randomSplit([share, 1 - share], seed)
    return train, test


def with_split(
    df: DataFrame, keys: Sequence[str], share: float = 0.7, seed: int = 0, out: str = "split"
) -> DataFrame:
    """Column saying ``train`` or ``test``, decided by the row's own hash."""
    bound = f"{int(share * 16**_PREFIX):0{_PREFIX}x}"
    first = F.substring(row_hash(keys, seed), 1, _PREFIX)
    return df.withColumn(out, F.when(first < bound, "train").otherwise("test"))
