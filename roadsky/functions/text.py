"""Model labels and formulas as column expressions over predictor arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def formula(target: Column, predictors: Column) -> Column:
    """``target ~ (a + b)``"""
    return F.concat(target, F.lit(" ~ ("), F.array_join(predictors, " + "), F.lit(")"))


def formula_plain(target: Column, predictors: Column) -> Column:
    """``target ~ a + b``"""
    return F.concat(target, F.lit(" ~ "), F.array_join(predictors, " + "))


def quoted_name(name: Column) -> Column:
    """``Q("name")`` where the name holds a space or a parenthesis."""
    return F.when(
        name.rlike("[ ()]"), F.concat(F.lit('Q("'), name, F.lit('")'))
    ).otherwise(name)


def formula_interactions(target: Column, predictors: Column) -> Column:
    """``target ~ (a + b)**2``: main effects and all pairwise products."""
    terms = F.array_join(F.transform(predictors, quoted_name), " + ")
    return F.concat(quoted_name(target), F.lit(" ~ ("), terms, F.lit(")**2"))


def model_label(target: Column, predictors: Column, prefix: str = "weather_to") -> Column:
    """``weather_to_target_a_b``"""
    return F.concat_ws("_", F.lit(prefix), target, F.array_join(predictors, "_"))


def list_from_text(text: Column) -> Column:
    """``['a', 'b']`` as an array, without evaluating the text."""
    return F.split(F.regexp_replace(text, r"[\[\]'\"]", ""), ", ")


def list_to_text(items: Column) -> Column:
    """``[a, b]``: the list form of the ranking reports, without quotes."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def without_quotes(text: Column) -> Column:
    """Text with single and double quotes removed."""
    return F.translate(text, "'\"", "")


def four_decimals(number: Column) -> Column:
    """Number as text with four decimals, for reports only."""
    return F.format_string("%.4f", number)


def run_label(moment: Column | None = None) -> Column:
    """Month, day, hour and minute of a moment, by default the query's start."""
    return F.date_format(F.current_timestamp() if moment is None else moment, "MMddHHmm")


def log_label(value: Column) -> Column:
    """``log1p`` of a regression target; null where it has no value."""
    return F.when(value > -1, F.log1p(value))


def log_value(value: Column) -> Column:
    """Natural log; null where it has no value."""
    return F.when(value > 0, F.log(value))
