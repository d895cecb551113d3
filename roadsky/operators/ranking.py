"""Rank finished models and count which predictors the best ones use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadsky.functions import text


def best_models(models: DataFrame, measure: str = "adj_r2", top_n: int = 100) -> DataFrame:
    """The ``top_n`` models over all targets."""
    return models.filter(F.col(measure).isNotNull()).orderBy(F.desc(measure), "formula").limit(top_n)


def top_and_bottom(
    models: DataFrame, top: int = 10, bottom: int = 5, measure: str = "r2", then: str = "model_id"
) -> DataFrame:
    """Best and worst models per target; ``section`` says which, ``place`` the rank by measure.

    Equal measures keep the order of ``then``. A model can be in both sections
    where a target has few models.
    """
    order = Window.partitionBy("target").orderBy(F.desc_nulls_last(measure), then)
    against = Window.partitionBy("target").orderBy(F.asc_nulls_first(measure), F.desc(then))
    best = models.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    worst = models.withColumn("place", F.row_number().over(against)).filter(F.col("place") <= bottom)
    return best.withColumn("section", F.lit("top")).unionByName(
        worst.withColumn("section", F.lit("bottom"))
    )


def predictor_influence(top_models: DataFrame) -> DataFrame:
    """Per target: how many of its best models use each predictor."""
    used = top_models.select("target", F.explode("predictors").alias("predictor"))
    counts = used.groupBy("target", "predictor").agg(F.count("*").alias("frequency"))
    return counts.orderBy("target", F.desc("frequency"), "predictor")


def influence_over_targets(influence: DataFrame) -> DataFrame:
    """The same counts summed over all targets."""
    counts = influence.groupBy("predictor").agg(F.sum("frequency").alias("frequency"))
    return counts.orderBy(F.desc("frequency"), "predictor")


def robust_summary(models: DataFrame) -> DataFrame:
    """How many fitted models needed robust errors."""
    fitted = models.filter(F.col("estimation").isNotNull())
    counts = fitted.agg(
        F.count("*").alias("total_models"),
        F.count_if(F.col("estimation") == "HC3").alias("hc3_models"),
    )
    plain = F.col("total_models") - F.col("hc3_models")
    return counts.select(
        "total_models",
        "hc3_models",
        plain.alias("ols_models"),
        F.when(F.col("total_models") > 0, 100.0 * F.col("hc3_models") / F.col("total_models"))
        .otherwise(0.0)
        .alias("hc3_percentage"),
        F.when(plain > 0, F.col("hc3_models") / plain)
        .otherwise(F.lit(float("inf")))
        .alias("hc3_ratio"),
    )


def ranking_report(models: DataFrame) -> DataFrame:
    """Report columns of :func:`top_and_bottom`, predictors as text without quotes."""
    return models.select(
        F.col("target").alias("traffictarget"),
        text.list_to_text(F.col("predictors")).alias("predictorslist"),
        F.col("n_sig_with_intercept").alias("significantvars"),
        F.col("rmse").alias("RMSE"),
        F.col("r2").alias("R2"),
        F.col("adj_r2").alias("AdjR2"),
        "section",
        "place",
    )


def numeric_log(log: DataFrame, measures: tuple[str, ...] = ("rmse", "r2", "adj_r2")) -> DataFrame:
    """A text model log with numbers as numbers and predictors as arrays."""
    present = [name for name in measures if name in log.columns]
    return log.withColumns(
        {
            **{name: F.col(name).try_cast("double") for name in present},
            "significant_vars": F.col("significant_vars").try_cast("int"),
            "predictors": text.list_from_text(F.col("predictors")),
        }
    )
