"""Traffic speed words as numbers, categories and ordinals, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number that stands for each speed word.
SPEED_NUMBERS = {"fast": 60.0, "moderate": 40.0, "slow": 20.0}
SPEED_LEVELS = ("Fast", "Moderate", "Slow", "Unknown")


def _chain(branches: list[tuple[Column, Column]], default: Column) -> Column:
    """CASE over (condition, value) pairs, first match wins."""
    result = default
    for condition, value in reversed(branches):
        result = F.when(condition, value).otherwise(result)
    return result


def speed_number(text: Column) -> Column:
    """Number of a speed word in any letter case; anything else is null."""
    word = F.lower(text)
    branches = [(word == key, F.lit(number)) for key, number in SPEED_NUMBERS.items()]
    return _chain(branches, F.lit(None).cast("double"))


def speed_info(text: Column) -> Column:
    """Struct (category, numeric) of the first speed word found inside the text."""
    word = F.lower(F.trim(text))

    def found(value_of) -> list[tuple[Column, Column]]:
        return [(F.contains(word, F.lit(key)), value_of(key)) for key in SPEED_NUMBERS]

    category = _chain(found(F.lit), F.lit("Unknown"))
    numeric = _chain(found(lambda key: F.lit(SPEED_NUMBERS[key])), F.lit(None).cast("double"))
    return F.struct(category.alias("category"), numeric.alias("numeric"))


def speed_category(text: Column) -> Column:
    """Fast / Moderate / Slow where the capitalised word occurs in the text."""
    branches = [(F.contains(text, F.lit(level)), F.lit(level)) for level in SPEED_LEVELS[:-1]]
    return _chain(branches, F.lit(SPEED_LEVELS[-1]))


def speed_digits(text: Column) -> Column:
    """The digits and dots of the text as one number; null where that is no number."""
    return F.regexp_replace(text, "[^0-9.]", "").try_cast("double")


def speed_ordinal(text: Column) -> Column:
    """fast 1, slow -1, everything else 0."""
    word = F.lower(text)
    return _chain([(word == "fast", F.lit(1)), (word == "slow", F.lit(-1))], F.lit(0))
