"""The complete analyses, each from raw incident rows to its result.

``raw`` has the columns of :data:`roadsky.schemas.INCIDENT`, as text or typed.
A sweep study returns the sweep and its plan; run them with
:func:`roadsky.operators.ols.run_sweep` or
:func:`roadsky.operators.robust.run_robust_sweep`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsky.functions import conditions, speed
from roadsky.operators import clean, fill, impact, ols, profile, ranking
from roadsky.plans.subsets import plan_models
from roadsky.schemas import (
    JAM_TARGETS,
    TRAFFIC_TARGETS,
    WEATHER_DUMMIES,
    WEATHER_NUMERIC,
    WEATHER_PREDICTORS,
)

# Predictors and targets of the small robust sweep.
HC3_PREDICTORS = ["Temperature(F)", "Humidity(%)", "Pressure(in)"]
HC3_TARGETS = [
    "Distance(mi)", "Traffic Jam Duration", "DelayFromTypicalTraffic(mins)",
    "DelayFromFreeFlowSpeed(mins)", "speed_numeric",
]
WEATHER_TARGETS = ["Temperature(F)", "WindSpeed(mph)", "Humidity(%)", "Precipitation(in)"]
DURATION = "Traffic Jam Duration"

Study = tuple[ols.Sweep, DataFrame]


def placed_incidents(raw: DataFrame) -> DataFrame:
    """Rows with a state and a start time."""
    return clean.not_null_rows(clean.with_times(raw, "StartTime"), "State", "StartTime")


def filled_incidents(raw: DataFrame, method: str = "first_seen") -> DataFrame:
    """Rows with a state and a start time, missing conditions filled along time per state."""
    return fill.fill_missing(placed_incidents(raw), ["Weather_Conditions"], ["State"], "StartTime", ["ID"], method)


def log_study(
    raw: DataFrame,
    predictors: Sequence[str] = WEATHER_PREDICTORS,
    targets: Sequence[str] = TRAFFIC_TARGETS,
    max_predictors: int = 3,
) -> Study:
    """Log targets over rows complete in every model column: 645 models by default."""
    frame = clean.model_frame(clean.clean_exact(raw), predictors, targets)
    sweep = ols.prepare(frame, predictors, targets, log_label=True)
    return sweep, plan_models(raw.sparkSession, targets, predictors, max_predictors)


def reversed_log_study(raw: DataFrame) -> Study:
    """The six numeric predictors in reverse order, at most two: 105 models."""
    return log_study(raw, WEATHER_PREDICTORS[5::-1], TRAFFIC_TARGETS[::-1], 2)


def _substring_numbers(raw: DataFrame, names: Sequence[str], exact: bool = False) -> DataFrame:
    df = clean.clean_substring(raw, exact=exact)
    return clean.to_doubles(df, [name for name in names if name not in WEATHER_DUMMIES])


def standardised_study(raw: DataFrame) -> Study:
    """Standardised predictors, raw targets, the duration in every model: 330 models."""
    predictors = [*WEATHER_NUMERIC, *WEATHER_DUMMIES][::-1]
    targets = JAM_TARGETS[::-1]
    df = _substring_numbers(raw, [*WEATHER_NUMERIC, *JAM_TARGETS])
    sweep = ols.prepare(
        df, [*predictors, DURATION], targets, log_label=False, missing="per_model", standardised=True
    )
    plan = plan_models(raw.sparkSession, targets, predictors, 2, always_include=[DURATION])
    return sweep, plan


def interaction_study(
    raw: DataFrame,
    targets: Sequence[str] = JAM_TARGETS,
    predictors: Sequence[str] = (*WEATHER_NUMERIC, *WEATHER_DUMMIES),
    max_predictors: int = 3,
) -> Study:
    """Main effects and pairwise products, per-model deletion: 1,050 models by default."""
    sweep = ols.prepare(
        _substring_numbers(raw, [*targets, *predictors], exact=True),
        predictors,
        targets,
        log_label=False,
        missing="per_model",
        interactions=True,
        collinear="shortest",
    )
    plan = plan_models(raw.sparkSession, targets, predictors, max_predictors, interactions=True)
    return sweep, plan


def hc3_study(raw: DataFrame, max_predictors: int = 3) -> Study:
    """The small sweep that always takes robust errors: 35 models by default."""
    return interaction_study(raw, HC3_TARGETS, HC3_PREDICTORS, max_predictors)


def weather_from_traffic_study(raw: DataFrame, max_predictors: int = 3) -> Study:
    """The other direction. A set of predictors has one fit in any order."""
    df = _substring_numbers(raw, [*JAM_TARGETS, *WEATHER_TARGETS])
    sweep = ols.prepare(df, JAM_TARGETS, WEATHER_TARGETS, log_label=False, missing="per_model")
    return sweep, plan_models(raw.sparkSession, WEATHER_TARGETS, JAM_TARGETS, max_predictors)


def single_study(raw: DataFrame, target: str, predictor: str) -> Study:
    """One predictor, raw target."""
    sweep = ols.prepare(clean.to_doubles(raw, [target, predictor]), [predictor], [target], log_label=False)
    return sweep, plan_models(raw.sparkSession, [target], [predictor], 1)


def correlations(raw: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pearson correlations; ``weather_ordinal`` and ``speed_ordinal`` may be in the pairs."""
    df = clean.with_rating(raw).withColumns(
        {
            "weather_ordinal": conditions.rating_ordinal(F.col("weather_rating")),
            "speed_ordinal": speed.speed_ordinal(F.col("Congestion_Speed")),
        }
    )
    return impact.pearson_pairs(df, pairs)


def impact_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Impact by rating, and the share of speed levels per rating."""
    crosstab = impact.crosstab_share(impact.incidents_by_text(raw), count="rows")
    return impact.impact_by_rating(raw), crosstab


def profile_tables(df: DataFrame, top_n: int = 20) -> tuple[DataFrame, DataFrame]:
    """Missing share per column, and its most frequent values."""
    return profile.missing_share(df), profile.top_values(df, top_n=top_n)


def ranking_tables(models: DataFrame, top: int = 10, bottom: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Best and worst models per target, predictor counts per target, and over all targets."""
    ranked = ranking.top_and_bottom(models, top, bottom)
    influence = ranking.predictor_influence(ranked.filter(F.col("section") == "top"))
    return ranking.ranking_report(ranked), influence, ranking.influence_over_targets(influence)
