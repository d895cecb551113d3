"""Weather condition text to rating, flags and ordinals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadsky.functions.weather_words import UNKNOWN, WEATHER_WORDS

Words = Mapping[str, Sequence[str]]

_BLANKS = " \t\n\r\x0b\x0c"


def stripped(text: Column) -> Column:
    """Text without blanks of any kind at both ends."""
    return F.trim(text, F.lit(_BLANKS))


def is_missing_text(text: Column) -> Column:
    """Null, empty or blank."""
    return text.isNull() | (stripped(text) == "")


def rating_exact(text: Column, words: Words = WEATHER_WORDS) -> Column:
    """Rating of the stripped text, letter case kept.

    ``isin`` over literals is a hash-set probe inside the scan stage: no join.
    """
    key = stripped(text)
    result = F.lit(UNKNOWN)
    for rating in reversed(list(words)):
        result = F.when(key.isin(*words[rating]), F.lit(rating)).otherwise(result)
    return result


def needles(words: Words = WEATHER_WORDS) -> dict[str, list[str]]:
    """Lower-cased entries that can still decide a substring match.

    An entry that holds another entry of the same or an earlier rating is
    never needed: every text that contains it contains the shorter one too.
    """
    kept: dict[str, list[str]] = {}
    for rating, entries in words.items():
        lowered = {entry.lower() for entry in entries}
        rivals = lowered.union(*kept.values())
        kept[rating] = sorted(
            entry
            for entry in lowered
            if not any(rival in entry for rival in rivals if rival != entry)
            and not any(entry in earlier for earlier in kept.values())
        )
    return kept


def rating_substring(text: Column, words: Words = WEATHER_WORDS) -> Column:
    """First rating, in the order of ``words``, with an entry inside the text."""
    lowered = F.lower(text)
    result = F.lit(UNKNOWN)
    for rating, entries in reversed(list(needles(words).items())):
        if entries:
            hit = reduce(or_, [F.contains(lowered, F.lit(entry)) for entry in entries])
            result = F.when(hit, F.lit(rating)).otherwise(result)
    return F.when(is_missing_text(text), F.lit(UNKNOWN)).otherwise(result)


def rating_from_table(df: DataFrame, text: str, table: DataFrame, out: str) -> DataFrame:
    """Exact lookup in a dictionary *table* with columns ``entry`` and ``rating``.

    For dictionaries that live in storage. The table's size is not known here,
    so the join carries no hint: Catalyst broadcasts it if its statistics allow.
    """
    rated = table.select(F.col("entry").alias("_entry"), F.col("rating").alias(out))
    joined = df.join(rated, stripped(F.col(text)) == F.col("_entry"), "left").drop("_entry")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(UNKNOWN)))


def rating_ordinal(rating: Column) -> Column:
    """good 1, bad -1, anything else 0."""
    return F.when(rating == "good", 1).when(rating == "bad", -1).otherwise(0)


def rating_flag(rating: Column, level: str) -> Column:
    """1 where the rating has the level, else 0."""
    return F.when(rating == level, 1).otherwise(0)
