"""What each weather rating does to traffic: grouped means, shares, crosstab, correlation.

Every result is one grouped aggregation with map-side combine: what is
shuffled is one row per task and rating, so a rating that holds most rows
costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadsky.functions import speed
from roadsky.functions.speed import SPEED_LEVELS
from roadsky.operators.clean import with_rating

DELAY_TYPICAL = "DelayFromTypicalTraffic(mins)"
DELAY_FREE_FLOW = "DelayFromFreeFlowSpeed(mins)"


def with_impact_columns(df: DataFrame, words=None) -> DataFrame:
    """Speed digits, speed category, numeric delays and rating of raw incidents."""
    return _with_text_columns(
        df.withColumns(
            {name: F.col(name).try_cast("double") for name in (DELAY_TYPICAL, DELAY_FREE_FLOW)}
        ),
        words,
    )


def _with_text_columns(df: DataFrame, words=None) -> DataFrame:
    text = F.col("Congestion_Speed")
    df = df.withColumns(
        {"speed_numeric": speed.speed_digits(text), "speed_category": speed.speed_category(text)}
    )
    return with_rating(df, words=words) if words else with_rating(df)


def incidents_by_text(df: DataFrame, words=None) -> DataFrame:
    """Raw incidents folded to one row per condition and speed text, then rated.

    The texts repeat a few hundred values, so each task folds its rows before
    the exchange and the text functions run once per distinct text, not once
    per row. Kept are the row count and, per delay, sum and count.
    """
    number = {
        "typical": F.col(DELAY_TYPICAL).try_cast("double"),
        "freeflow": F.col(DELAY_FREE_FLOW).try_cast("double"),
    }
    folded = df.groupBy("Weather_Conditions", "Congestion_Speed").agg(
        F.count("*").alias("rows"),
        *[F.sum(value).alias(f"sum_{name}") for name, value in number.items()],
        *[F.count(value).alias(f"n_{name}") for name, value in number.items()],
    )
    return _with_text_columns(folded, words)


def impact_by_rating(df: DataFrame, words=None, group: str = "weather_rating") -> DataFrame:
    """Per rating: rows, mean speed and delays, share of speed levels, share of total."""
    rows, number = F.col("rows"), F.col("speed_numeric")

    def mean_of(name: str) -> Column:
        return F.round(F.try_divide(F.sum(f"sum_{name}"), F.sum(f"n_{name}")), 2)

    def share_of(level: str) -> Column:
        of_level = F.when(F.col("speed_category") == level, rows).otherwise(0)
        return F.round(100.0 * F.sum(of_level) / F.sum(rows), 2)

    speeds = F.when(number.isNotNull(), rows)
    grouped = incidents_by_text(df, words).groupBy(group).agg(
        F.sum(rows).alias("total_incidents"),
        F.round(F.try_divide(F.sum(number * rows), F.sum(speeds)), 2).alias("avg_speed"),
        mean_of("typical").alias("avg_delay_typical"),
        mean_of("freeflow").alias("avg_delay_freeflow"),
        share_of("Fast").alias("pct_fast"),
        share_of("Moderate").alias("pct_moderate"),
        share_of("Slow").alias("pct_slow"),
    )
    return with_share_of_total(grouped, "total_incidents", "percentage_of_total")


def with_share_of_total(grouped: DataFrame, count: str, out: str) -> DataFrame:
    """Percent each group's count has of all; runs on the grouped rows only."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum(count).over(everything)
    return grouped.withColumn(out, F.round(100.0 * F.col(count) / total, 2))


def crosstab_share(
    df: DataFrame,
    rows: str = "weather_rating",
    columns: str = "speed_category",
    levels: Sequence[str] = SPEED_LEVELS,
    count: str | None = None,
) -> DataFrame:
    """Percent of each column level within each row group, two decimals.

    ``count`` names a column of row counts where the frame is already folded.
    """
    measure = F.sum(count) if count else F.count(F.lit(1))
    counts = df.groupBy(rows).pivot(columns, list(levels)).agg(measure).na.fill(0, list(levels))
    total = sum((F.col(level) for level in levels), F.lit(0))
    return counts.select(
        # a group that has none of the levels has no share of them
        rows,
        *[F.round(F.coalesce(F.try_divide(100.0 * F.col(level), total), F.lit(0.0)), 2).alias(level) for level in levels],
    )


def pearson_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of column pairs over the complete rows, one row per pair."""
    names = list(dict.fromkeys(name for pair in pairs for name in pair))
    numbers = df.select(*[F.col(name).try_cast("double").alias(name) for name in names])
    found = numbers.na.drop().agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{i}").alias("pearson"))
        for i, (a, b) in enumerate(pairs)
    ]
    return found.select(F.inline(F.array(*rows)))
