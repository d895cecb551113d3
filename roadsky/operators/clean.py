"""Raw incident rows to model-ready features.

Everything here is a native expression, so a whole cleaning run is one
scan-filter-project stage: no shuffle, no Python, columns pruned at the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsky.functions import conditions, speed, times
from roadsky.functions.weather_words import RATING_LEVELS, WEATHER_WORDS

DAY_MINUTES = 1440


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fail before any job runs if a column is absent."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def ensure_columns(df: DataFrame, names: Sequence[str], default: int = 0) -> DataFrame:
    """Add the absent ones of these columns with a constant."""
    absent = {name: F.lit(default) for name in names if name not in df.columns}
    return df.withColumns(absent) if absent else df


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns that are costly and that later filters test.

    Catalyst moves a filter below a projection by copying the projected
    expression into it, so a parsed time would be parsed again for every
    filter. It does not copy an expression out of a generator: ``inline`` over
    one struct yields the same row with each column computed once.
    """
    cells = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = [F.col(name) for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(F.array(cells)))


def with_times(df: DataFrame, *names: str, parser=times.parse_offset_time) -> DataFrame:
    """Parse the text ones of these columns; time columns stay as they are."""
    texts = [name for name in names if isinstance(df.schema[name].dataType, T.StringType)]
    return computed_once(df, {name: parser(F.col(name)) for name in texts}) if texts else df


def with_duration(
    df: DataFrame,
    out: str = "TrafficJamDuration(mins)",
    start: str = "StartTime",
    end: str = "EndTime",
    exact: bool = False,
) -> DataFrame:
    """Span in minutes; ``exact`` keeps fractions of a second."""
    span = times.minutes_between_exact if exact else times.minutes_between
    return df.withColumn(out, span(F.col(start), F.col(end)))


def valid_durations(
    df: DataFrame, duration: str = "TrafficJamDuration(mins)", max_minutes: float = DAY_MINUTES
) -> DataFrame:
    """Rows that last more than nothing and at most ``max_minutes``."""
    return df.filter((F.col(duration) > 0) & (F.col(duration) <= max_minutes))


def duration_counts(
    df: DataFrame, duration: str = "TrafficJamDuration(mins)", max_minutes: float = DAY_MINUTES
) -> DataFrame:
    """Rows before and after :func:`valid_durations`, in one pass."""
    valid = (F.col(duration) > 0) & (F.col(duration) <= max_minutes)
    return df.agg(F.count("*").alias("n_before"), F.count_if(valid).alias("n_after"))


def with_speed_number(df: DataFrame, text: str = "Congestion_Speed") -> DataFrame:
    """``SpeedNumeric`` by exact word."""
    return df.withColumn("SpeedNumeric", speed.speed_number(F.col(text)))


def with_speed_info(df: DataFrame, text: str = "Congestion_Speed") -> DataFrame:
    """``speed_category`` and ``speed_numeric`` by word found inside the text."""
    info = speed.speed_info(F.col(text))
    return df.withColumns({"speed_category": info["category"], "speed_numeric": info["numeric"]})


def with_weather_flags(
    df: DataFrame, text: str = "Weather_Conditions", words=WEATHER_WORDS
) -> DataFrame:
    """``GoodWeather``, ``NeutralWeather``, ``BadWeather``: 0/1 by exact condition."""
    key = conditions.stripped(F.col(text))
    names = {"good": "GoodWeather", "neutral": "NeutralWeather", "bad": "BadWeather"}
    return df.withColumns(
        {
            out: F.coalesce(key.isin(*words[level]), F.lit(False)).cast("int")
            for level, out in names.items()
        }
    )


def with_rating(
    df: DataFrame, text: str = "Weather_Conditions", mode: str = "substring", words=WEATHER_WORDS
) -> DataFrame:
    """``weather_rating``: good, bad, neutral or unknown."""
    modes = {"substring": conditions.rating_substring, "exact": conditions.rating_exact}
    return df.withColumn("weather_rating", modes[mode](F.col(text), words))


def with_rating_dummies(df: DataFrame, rating: str = "weather_rating") -> DataFrame:
    """One 0/1 column per rating level; every level is always present."""
    return df.withColumns(
        {f"weather_{level}": conditions.rating_flag(F.col(rating), level) for level in RATING_LEVELS}
    )


def to_doubles(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cast columns to double; text that is no number becomes null."""
    return df.withColumns({name: F.col(name).try_cast("double") for name in names})


def is_complete(df: DataFrame, names: Sequence[str]) -> Column:
    """Whether a row has a value in all of these columns: no null, no NaN, no infinity."""
    kinds = dict(df.dtypes)
    held = []
    for name in names:
        held.append(F.col(name).isNotNull())
        if kinds[name] in ("double", "float"):
            held.append(F.abs(F.col(name)) < float("inf"))
    return reduce(and_, held)


def complete_rows(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Rows that are complete in these columns (all columns by default)."""
    return df.filter(is_complete(df, list(names or df.columns)))


def not_null_rows(df: DataFrame, *names: str) -> DataFrame:
    """Rows where every one of these columns has a value."""
    return df.filter(reduce(and_, [F.col(name).isNotNull() for name in names]))


def without_underscores(df: DataFrame) -> DataFrame:
    """Column names with underscores taken out."""
    return df.withColumnsRenamed({name: name.replace("_", "") for name in df.columns})


def renamed(df: DataFrame, names: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Drop some columns and rename others."""
    return df.drop(*drop).withColumnsRenamed(dict(names))


def clean_exact(df: DataFrame, max_minutes: float = DAY_MINUTES) -> DataFrame:
    """Duration, exact speed word, exact condition flags; over-long rows removed."""
    df = with_duration(with_times(df, "StartTime", "EndTime"))
    df = valid_durations(df, max_minutes=max_minutes)
    return with_weather_flags(with_speed_number(df))


def clean_substring(df: DataFrame, max_minutes: float = DAY_MINUTES, exact: bool = False) -> DataFrame:
    """Duration, speed and rating found inside the text, one dummy per rating."""
    duration = "Traffic Jam Duration"
    df = with_times(df, "StartTime", "EndTime", parser=times.parse_any_time)
    df = valid_durations(with_duration(df, duration, exact=exact), duration, max_minutes)
    return with_rating_dummies(with_rating(with_speed_info(df)))


def model_frame(df: DataFrame, predictors: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """The complete rows of the model columns, all as double."""
    names = list(dict.fromkeys([*predictors, *targets]))
    require_columns(df, names)
    numbers = {name: F.col(name).try_cast("double") for name in names}
    return complete_rows(computed_once(df.select(*names), numbers))
