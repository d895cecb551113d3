"""The plan of a sweep: every target with every predictor subset up to a size."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsky.functions import text


def _names(names: Sequence[str]):
    return F.array(*[F.lit(name) for name in names])


def _model_id(targets: int, width: int, max_predictors: int) -> Column:
    """Ids of ``t`` and ``subset``, target first, then size, then the subset itself.

    Small plans tell the subset by its digits of base 1000. Others count: the
    subsets of a size that come before, by binomial numbers, so that ids are
    0, 1, 2, ... over the whole plan.
    """
    size, t = F.size("subset"), F.col("t").cast("long")
    if max_predictors <= 5 and width <= 1000:
        digits = F.aggregate("subset", F.lit(0).cast("long"), lambda acc, i: acc * 1000 + i)
        return (t * 10 + size) * 10**15 + digits
    sizes = [comb(width, k) for k in range(max_predictors + 1)]
    if targets * sum(sizes) >= 1 << 63:
        raise ValueError("more models than a 64-bit id can tell apart")
    # chosen[k][m]: subsets of k out of m
    chosen = F.array(*[F.array(*[F.lit(comb(m, k)).cast("long") for m in range(width + 1)]) for k in range(max_predictors + 1)])
    smaller = F.array(*[F.lit(sum(sizes[1:k])).cast("long") for k in range(max_predictors + 1)])
    # those behind: per place, subsets that go on from a later predictor
    behind = F.aggregate(
        F.transform("subset", lambda i, place: chosen[size - place][F.lit(width - 1) - i]), F.lit(0).cast("long"), lambda acc, n: acc + n
    )
    return t * sum(sizes[1:]) + smaller[size] + (chosen[size][width] - 1 - behind)


def plan_models(
    spark: SparkSession,
    targets: Sequence[str],
    predictors: Sequence[str],
    max_predictors: int,
    always_include: Sequence[str] = (),
    interactions: bool = False,
) -> DataFrame:
    """One row per model: ``model_id, target, predictors, formula``.

    Each level extends the subsets below it by a later predictor, so every
    subset appears once and in enumeration order, without any join.
    ``always_include`` names are appended, except where one is the target.
    Ids rise by target, size and subset.
    """
    width = len(predictors)
    max_predictors = min(max_predictors, width)
    start = spark.range(len(targets) * width)
    level = start.select(
        (F.col("id") / width).cast("int").alias("t"),
        F.array((F.col("id") % width).cast("int")).alias("subset"),
    )
    plan = level
    for _ in range(1, max_predictors):
        last = F.element_at("subset", -1)
        level = (
            level.filter(last < width - 1)
            .withColumn("next", F.explode(F.sequence(last + 1, F.lit(width - 1))))
            .select("t", F.concat("subset", F.array("next")).alias("subset"))
        )
        plan = plan.union(level)

    target = F.element_at(_names(targets), F.col("t") + 1)
    chosen = F.transform("subset", lambda i: F.element_at(_names(predictors), i + 1))
    if always_include:
        extra = F.filter(_names(always_include), lambda name: name != target)
        chosen = F.concat(chosen, extra)
    if interactions:
        formula = text.formula_interactions(F.col("target"), F.col("predictors"))
    elif always_include:
        formula = text.formula_plain(F.col("target"), F.col("predictors"))
    else:
        formula = text.formula(F.col("target"), F.col("predictors"))
    return (
        plan.withColumns(
            {
                "model_id": _model_id(len(targets), width, max_predictors),
            "target": target,
                "predictors": chosen,
            }
        )
        .withColumn("formula", formula)
        .select("model_id", "target", "predictors", "formula")
    )


def pending_models(plan: DataFrame, finished: DataFrame) -> DataFrame:
    """The planned models that have no finished (target, formula) yet."""
    done = finished.select("target", "formula").distinct()
    return plan.join(done, ["target", "formula"], "left_anti")


def count_experiments(models: DataFrame) -> DataFrame:
    """Planned or finished models per target and number of predictors."""
    return models.groupBy("target", F.size("predictors").alias("n_predictors")).agg(
        F.count("*").alias("n_models")
    )


def with_valid_predictors(models: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """``valid_predictors``: the predictors are distinct and all in the vocabulary."""
    distinct = F.size(F.array_distinct("predictors")) == F.size("predictors")
    known = F.size(F.array_except("predictors", _names(vocabulary))) == 0
    return models.withColumn("valid_predictors", distinct & known)


def check_models(models: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target: rows, repeated rows, rows off the plan, and planned models absent."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("target", F.array_join(F.array_sort("predictors"), "|").alias("key"))

    rows = keyed(models).groupBy("target", "key").agg(F.count("*").alias("copies"))
    wanted = keyed(plan).withColumn("planned", F.lit(True))
    both = rows.join(wanted, ["target", "key"], "full_outer")
    return both.groupBy("target").agg(
        F.sum(F.coalesce("copies", F.lit(0))).alias("n_rows"),
        F.sum(F.greatest(F.coalesce("copies", F.lit(0)) - 1, F.lit(0))).alias("n_repeated"),
        F.count_if(F.col("planned").isNull()).alias("n_off_plan"),
        F.count_if(F.col("copies").isNull()).alias("n_absent"),
    )
