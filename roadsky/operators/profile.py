"""Column profiles: missing share, most frequent values, summary numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsky.functions.conditions import is_missing_text
from roadsky.session import scratch_path

#: Characters of a value that travel with its hashes while values are counted.
PREFIX = 48
#: Candidates of a column whose values are fetched by a broadcast of their hashes.
MOST_CANDIDATES = 10_000


def _missing(df: DataFrame, name: str) -> Column:
    column, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return is_missing_text(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def missing_share(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Percent of null, empty or blank values per column: one pass, one row per task shuffled."""
    names = list(names or df.columns)
    shares = df.agg(
        *[
            (100.0 * F.avg(F.when(_missing(df, name), 1.0).otherwise(0.0))).alias(f"m{i}")
            for i, name in enumerate(names)
        ]
    )
    rows = [
        F.struct(F.lit(name).alias("Column"), F.col(f"m{i}").alias("Missing_Percentage"))
        for i, name in enumerate(names)
    ]
    return shares.select(F.inline(F.array(*rows)))


def _cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(Column, Value) of every present value, as text."""
    texts = df.select(
        *[F.when(~_missing(df, name), F.col(name).cast("string")).alias(name) for name in names]
    )
    return texts.unpivot([], list(names), "Column", "Value").filter(F.col("Value").isNotNull())


def value_counts(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Count of every present value of every column, values as text."""
    return _cells(df, list(names or df.columns)).groupBy("Column", "Value").agg(F.count("*").alias("Count"))


def _key() -> Column:
    """A value of up to ``PREFIX`` characters is its own key; that of a longer one is its beginning and its hash. Keys
    order like values but for longer values of one beginning."""
    hashed = F.concat(F.substring("Value", 1, PREFIX), F.lit("\0"), F.md5("Value"))
    return F.when(F.length("Value") <= PREFIX, F.col("Value")).otherwise(hashed)


def _keyed_counts(cells: DataFrame) -> DataFrame:
    """(Column, key, Count): long texts are not what an exchange deals by."""
    return cells.select("Column", _key().alias("key")).groupBy("Column", "key").agg(F.count("*").alias("Count"))


def _best(counts: DataFrame, top_n: int, value: str = "Value") -> DataFrame:
    """The first ``top_n`` of each column by count, then value, with their ``rank``."""
    order = Window.partitionBy("Column").orderBy(F.desc("Count"), value)
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def _with_share(best: DataFrame, counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("Column").agg(F.sum("Count").alias("present"))
    return best.join(F.broadcast(totals), "Column").select(
        "Column",
        "Value",
        "Count",
        (100.0 * F.col("Count") / F.col("present")).alias("Percentage"),
        "rank",
    )


def top_values(df: DataFrame, names: Sequence[str] | None = None, top_n: int = 20) -> DataFrame:
    """The ``top_n`` values per column with their percent of the present values.

    The counts are shuffled by (column, value) after a map-side combine. The
    rank filter becomes a window group limit: each task passes on at most
    ``top_n`` rows per column, so an all-distinct column never meets in one
    task. Totals come from the same counts, one row per column. Columns with
    values of more than ``PREFIX`` characters are counted by hashes
    (:func:`_top_long_values`); a pass over the text columns tells which.
    """
    names = list(names or df.columns)
    texts = [name for name in names if isinstance(df.schema[name].dataType, T.StringType)]
    long_ones = []
    if texts:
        longest = df.agg(*[F.max(F.length(name)).alias(f"l{i}") for i, name in enumerate(texts)]).first()
        long_ones = [name for i, name in enumerate(texts) if (longest[i] or 0) > PREFIX]
    short_ones = [name for name in names if name not in long_ones]
    found = [_top_long_values(df, long_ones, top_n)] if long_ones else []
    if short_ones:
        counts = value_counts(df, short_ones)
        found.append(_with_share(_best(counts, top_n), counts))
    return reduce(DataFrame.unionByName, found)


def _top_long_values(df: DataFrame, names: Sequence[str], top_n: int) -> DataFrame:
    """:func:`top_values` of columns with long values, by two passes.

    Values are counted by their keys. The candidates are the best by count and
    beginning, and those that tie with the last one in both; a second pass
    fetches their values. A column with more than ``MOST_CANDIDATES`` (very
    many values of one count and one beginning) is counted by its whole values
    instead.
    """
    cells = _cells(df, names)
    path = scratch_path(df.sparkSession, "key-counts")
    _keyed_counts(cells).write.parquet(path)
    counts = df.sparkSession.read.parquet(path)
    beginning = F.substring("key", 1, PREFIX)
    edge = F.max_by(F.struct("Count", beginning.alias("prefix")), "rank").alias("edge")
    # a row a column
    near = counts.join(F.broadcast(_best(counts, top_n, "key").groupBy("Column").agg(edge)), "Column")
    tied = (F.col("Count") == F.col("edge.Count")) & (beginning <= F.col("edge.prefix"))
    near = near.filter((F.col("Count") > F.col("edge.Count")) | tied).select("Column", "key", "Count")
    many = {row["Column"] for row in near.groupBy("Column").count().filter(F.col("count") > MOST_CANDIDATES).collect()}
    few = near.filter(~F.col("Column").isin(*many)) if many else near
    # at most MOST_CANDIDATES rows a column
    named = cells.withColumn("key", _key()).join(F.broadcast(few), ["Column", "key"]).select("Column", "Value", "Count").distinct()
    if many:
        named = named.unionByName(value_counts(df, sorted(many)))
    return _with_share(_best(named, top_n), counts)


def describe_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Count, mean, sample standard deviation, min and max per column, typed."""
    measures = {
        "count": lambda c: F.count(c),
        "mean": lambda c: F.avg(c),
        "stddev": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
    }
    summary = df.agg(
        *[
            measure(F.col(name)).alias(f"{key}_{i}")
            for i, name in enumerate(names)
            for key, measure in measures.items()
        ]
    )
    rows = [
        F.struct(F.lit(name).alias("column"), *[F.col(f"{key}_{i}").alias(key) for key in measures])
        for i, name in enumerate(names)
    ]
    return summary.select(F.inline(F.array(*rows)))
