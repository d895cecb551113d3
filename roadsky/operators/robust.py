"""Breusch-Pagan test and HC3 errors for every model of a plan.

Both need the residuals, so the data is read a second time, once for all
models. Per task and model a handful of sums is kept: of e², e⁴, x e² and of
the squared HC3 influence of each coefficient. Models with the same terms
share the leverage, so the cost per row is one small matrix product for each
predictor subset, not for each model.

The solved models are written to the shared folder by the tasks that solved
them, and read from there by the tasks of the second pass: about half a
kilobyte a model in each. The driver sees neither plan nor fits.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsky.functions import tails
from roadsky.operators import moments as M
from roadsky.operators import ols
from roadsky.schemas import MODEL_RESULT
from roadsky.session import scratch_path
from roadsky.sources.shared import read_parquet

_TESTED = T.StructType(
    [
        T.StructField("model_id", T.LongType()),
        T.StructField("bp_stat", T.DoubleType()),
        T.StructField("bp_pvalue", T.DoubleType()),
        T.StructField("hc3_pvalues", T.ArrayType(T.DoubleType())),
    ]
)


def bundles_of(path: str, layout: ols.Layout, columns: int, pairs: list) -> list[dict]:
    """Solved models of ``path``, grouped by equal terms and equal leverage. Read in tasks, file by file."""
    grouped = defaultdict(list)
    for rows in read_parquet(path, ["model_id", "target", "predictors", "fit"]):
        for row in rows:
            fit = ols.Fit(**pickle.loads(row["fit"]))
            if fit.beta is not None:
                terms = tuple(layout.terms(row["predictors"]))
                grouped[(terms, fit.n, fit.mean.tobytes())].append((row["model_id"], row["target"], fit))
    bundles = []
    for (terms, n, _), members in grouped.items():
        first = members[0][2]
        labels = [layout.label(target) for _, target, _ in members]
        slopes = np.column_stack([fit.beta[1:] for _, _, fit in members])
        bundles.append(
            {
                "terms": list(terms),
                # with one label its gaps are part of the mask, else zeroed later
                "needed": M.sources(columns, pairs, [*terms, *([labels[0]] if len(labels) == 1 else [])]),
                "gaps": len(labels) > 1,
                "labels": labels,
                "ids": [model_id for model_id, _, _ in members],
                "n": n,
                "mean": first.mean,
                "inverse": first.slopes_inverse,
                "projector": first.projector,
                "slopes": slopes,
                "centre": np.array([fit.beta[0] + fit.mean @ fit.beta[1:] for _, _, fit in members]),
            }
        )
    return bundles


def _bundle_sums(basis: np.ndarray, missing: np.ndarray, bundle: dict) -> np.ndarray:
    """Sums of one block for one bundle: one column per model."""
    x, y = basis[bundle["terms"]], basis[bundle["labels"]]
    lacking = missing[bundle["needed"]].any(axis=0)
    if lacking.any():
        there = ~lacking
        x, y = x[:, there], y[:, there]
    mean, n = bundle["mean"], bundle["n"]
    centred = x - mean[:, None]
    lever = bundle["inverse"] @ centred
    rest = (1.0 - 1.0 / n) - (lever * centred).sum(axis=0)
    influence = np.vstack([1.0 / n - mean @ lever, lever])
    if bundle["projector"] is not None:
        influence = bundle["projector"] @ influence
    squared = y - bundle["centre"][:, None] - bundle["slopes"].T @ centred
    np.square(squared, out=squared)
    if bundle["gaps"]:
        np.nan_to_num(squared, copy=False, nan=0.0)
    np.square(influence, out=influence)
    return np.vstack(
        [
            squared.sum(axis=1),
            np.einsum("ij,ij->i", squared, squared),
            centred @ squared.T,
            influence @ (squared / np.square(rest)).T,
        ]
    )


def _second_pass(sweep: ols.Sweep, path: str) -> DataFrame:
    """Sums per model, as an array, over the whole frame."""
    columns, pairs, layout = sweep.columns, sweep.pairs, sweep.layout()

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles: list[dict] | None = None
        sums: list[np.ndarray | None] = []
        for block in M.read_blocks(batches):
            if bundles is None:
                bundles = bundles_of(path, layout, len(columns), pairs)
                sums = [None] * len(bundles)
            missing, basis = np.isnan(block), M.extend(block, pairs)
            for i, bundle in enumerate(bundles):
                part = _bundle_sums(basis, missing, bundle)
                sums[i] = part if sums[i] is None else sums[i] + part
        for bundle, table in zip(bundles or [], sums, strict=True):
            depth = len(table)
            yield pa.RecordBatch.from_pydict(
                {
                    "model_id": np.repeat(np.array(bundle["ids"], np.int64), depth),
                    "position": np.tile(np.arange(depth, dtype=np.int32), table.shape[1]),
                    "v": table.T.ravel(),
                }
            )

    parts = sweep.frame.select(*columns).mapInArrow(partial, "model_id long, position int, v double")
    # one exchange: what is dealt by model serves both groupings
    summed = parts.groupBy("model_id", "position").agg(F.sum("v").alias("v"))
    return summed.groupBy("model_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "v"))).alias("sums")
    ).select("model_id", F.col("sums.v").alias("sums"))


def _tested(sweep: ols.Sweep, solved: DataFrame, path: str) -> DataFrame:
    """Test statistic, its p-value and HC3 p-values per model."""

    def finish(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for model_id, sums, data in zip(frame["model_id"], frame["sums"], frame["fit"]):
                fit = ols.Fit(**pickle.loads(data))
                n, beta = fit.n, fit.beta
                sums = np.asarray(sums, float)
                size = len(beta) - 1
                cross, spread = sums[2 : 2 + size], sums[1] - sums[0] ** 2 / n
                statistic = n * float(cross @ fit.slopes_inverse @ cross) / spread if spread > 0 else np.nan
                with np.errstate(divide="ignore", invalid="ignore"):
                    pvalues = tails.normal_two_sided(beta / np.sqrt(sums[2 + size :]))
                rows.append(
                    {
                        "model_id": model_id,
                        "bp_stat": None if np.isnan(statistic) else statistic,
                        "bp_pvalue": None if np.isnan(statistic) else tails.chi2_tail(statistic, size),
                        "hc3_pvalues": [
                            None if np.isnan(pvalues[i]) else float(pvalues[i])
                            for i in [*range(1, size + 1), 0]
                        ],
                    }
                )
            yield pd.DataFrame(rows, columns=_TESTED.names)

    both = solved.select("model_id", "fit").join(_second_pass(sweep, path), "model_id")
    return both.select("model_id", "sums", "fit").mapInPandas(finish, _TESTED)


def run_robust_sweep(sweep: ols.Sweep, plan: DataFrame, estimation: str = "tested") -> DataFrame:
    """A sweep with heteroskedasticity test, in the result schema.

    ``estimation="tested"`` takes HC3 p-values where the test rejects constant
    variance at 5 %, else the ordinary ones; ``"hc3"`` always takes HC3.
    """
    if estimation not in ("tested", "hc3"):
        raise ValueError("estimation must be tested or hc3")
    spark = plan.sparkSession
    # raw rows are read and parsed once: both passes run over the written model columns
    sweep = ols.staged(sweep, scratch_path(spark, "robust-frame"))
    path = scratch_path(spark, "robust-fits")
    solved = ols.solve_plan(sweep, plan, keep_fit=True)
    solved.write.parquet(path)
    solved = spark.read.schema(solved.schema).parquet(path)
    tested = _tested(sweep, solved, path)
    plain = ols.with_measures(solved.drop("fit")).drop("bp_stat", "bp_pvalue")
    joined = plain.join(tested, "model_id", "left")
    robust = F.col("hc3_pvalues").isNotNull()
    if estimation == "tested":
        robust = robust & (F.col("bp_pvalue") < ols.SIGNIFICANT)
    joined = joined.withColumn("_robust", F.coalesce(robust, F.lit(False)))
    chosen = F.when(F.col("_robust"), F.col("hc3_pvalues")).otherwise(F.col("pvalues"))
    joined = joined.withColumn("pvalues", chosen).withColumns(
        {
            "n_sig_with_intercept": F.when(
                F.col("estimation").isNotNull(), ols.count_significant(F.col("pvalues"))
            ),
            "n_sig_predictors": F.when(
                F.col("estimation").isNotNull(),
                ols.count_significant(F.slice("pvalues", 1, F.size("pvalues") - 1)),
            ),
            "estimation": F.when(F.col("_robust"), F.lit("HC3")).otherwise(F.col("estimation")),
        }
    )
    return joined.select(*MODEL_RESULT.names)
