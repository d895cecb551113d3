"""Every regression of a plan from one pass over the data.

The data pass (:mod:`roadsky.operators.moments`) yields exact sums, a small
block a model. The task that adds a model's blocks up solves it; the fit
measures are ordinary column expressions over what the solver returns.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsky.functions import tails, text
from roadsky.operators import moments as M
from roadsky.schemas import MODEL_RESULT
from roadsky.session import compiled_projections

# Relative size below which a direction of the scaled design counts as absent,
# and spread relative to the mean below which a column counts as constant.
RANK_TOLERANCE = 1e-10
CONSTANT = 1e-12
SIGNIFICANT = 0.05
NONZERO = 1e-8

_SOLVED = T.StructType(
    [
        T.StructField("model_id", T.LongType()),
        T.StructField("target", T.StringType()),
        T.StructField("predictors", T.ArrayType(T.StringType())),
        T.StructField("formula", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("coefficients", T.ArrayType(T.DoubleType())),
        T.StructField("intercept", T.DoubleType()),
        T.StructField("std_errors", T.ArrayType(T.DoubleType())),
        T.StructField("pvalues", T.ArrayType(T.DoubleType())),
        T.StructField("sse", T.DoubleType()),
        T.StructField("sst", T.DoubleType()),
    ]
)


@dataclass
class Sweep:
    """What a plan is run against.

    ``frame``        double columns of predictors and labels
    ``predictors``   predictor columns
    ``labels``       target name to label column of the frame
    ``interactions`` add the products of a model's predictor pairs
    ``standardised`` predictors scaled to mean 0 and sample deviation 1
    ``collinear``    "null": no measures for a rank-deficient model;
                     "shortest": the solution of least length
    """

    frame: DataFrame
    predictors: list[str]
    labels: dict[str, str]
    interactions: bool = False
    standardised: bool = False
    collinear: str = "null"

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.predictors, *self.labels.values()]))

    @property
    def pairs(self) -> list[tuple[int, int]]:
        if not self.interactions:
            return []
        at = {name: i for i, name in enumerate(self.columns)}
        return [(at[a], at[b]) for a, b in combinations(self.predictors, 2)]

    def layout(self) -> Layout:
        at = {name: i for i, name in enumerate(self.columns)}
        pair_at = {pair: len(at) + i for i, pair in enumerate(self.pairs)}
        return Layout(at, pair_at, self.labels, self.standardised, self.collinear)


@dataclass
class Layout:
    """Where a model's terms sit among the basis columns."""

    at: dict[str, int]
    pair_at: dict[tuple[int, int], int]
    labels: dict[str, str]
    standardised: bool
    collinear: str

    def terms(self, predictors: Sequence[str]) -> list[int]:
        single = [self.at[name] for name in predictors]
        if not self.pair_at:
            return single
        both = [tuple(sorted(pair)) for pair in combinations(single, 2)]
        return single + [self.pair_at[pair] for pair in both]

    def label(self, target: str) -> int:
        return self.at[self.labels[target]]


def finite(number: Column) -> Column:
    """NaN and infinities hold no measurement: they count as missing."""
    return F.when(F.abs(number) < float("inf"), number)


def prepare(
    df: DataFrame,
    predictors: Sequence[str],
    targets: Sequence[str],
    *,
    log_label: bool,
    missing: str = "global",
    interactions: bool = False,
    standardised: bool = False,
    collinear: str = "null",
) -> Sweep:
    """Model frame and labels.

    ``missing="global"`` drops a row that lacks any model column;
    ``"per_model"`` drops it only for the models that use the column.
    """
    compiled_projections(df.sparkSession)
    predictors, targets = list(predictors), list(targets)
    for name in targets:
        if isinstance(df.schema[name].dataType, T.StringType):
            raise ValueError(f"target is not numeric: {name}")
    names = list(dict.fromkeys([*predictors, *targets]))
    frame = df.select(*[finite(F.col(name).try_cast("double")).alias(name) for name in names])
    if missing == "global":
        frame = frame.na.drop()
    labels = {name: name for name in targets}
    if log_label:
        labels = {name: f"log1p {name}" for name in targets}
        logs = {out: text.log_label(F.col(name)) for name, out in labels.items()}
        frame = frame.withColumns(logs).select(*predictors, *logs)
    return Sweep(frame, predictors, labels, interactions, standardised, collinear)


def staged(sweep: Sweep, path: str) -> Sweep:
    """The same sweep over a written copy of its frame.

    Worth it where several passes or several runs follow: the copy holds the
    model columns only, as doubles, so raw rows are read and parsed once.
    """
    sweep.frame.write.mode("overwrite").parquet(path)
    copy = sweep.frame.sparkSession.read.schema(sweep.frame.schema).parquet(path)
    return replace(sweep, frame=copy)


@dataclass
class Fit:
    """One solved model in raw coordinates; index 0 is the intercept."""

    status: str
    n: int
    rank: int = 0
    beta: np.ndarray | None = None
    inverse: np.ndarray | None = None  # (pseudo-)inverse of X'X
    mean: np.ndarray | None = None
    slopes_inverse: np.ndarray | None = None
    projector: np.ndarray | None = None
    spread: np.ndarray | None = None
    sse: float = np.nan
    sst: float = np.nan


def solve(n: int, mean: np.ndarray, table: np.ndarray, collinear: str) -> Fit:
    """Least squares from the means of a model's terms and its label, and their products about them."""
    size = len(mean) - 1
    if not (np.isfinite(table).all() and np.isfinite(mean).all()):
        # sums beyond the range of doubles: no measure of this model can be told
        return Fit("OVERFLOW", n)
    if n < size + 2:
        return Fit("INSUFFICIENT", n)
    inner, cross, sst = table[:-1, :-1], table[:-1, -1], table[-1, -1]
    constant = np.diag(table) <= n * np.square(CONSTANT * mean)
    variance, flat = np.diag(inner).copy(), constant[:-1]
    scale = np.sqrt(np.where(flat, 1.0, variance))
    scaled = inner / np.outer(scale, scale)
    scaled[flat, :] = 0.0
    scaled[:, flat] = 0.0
    values, vectors = np.linalg.eigh(scaled)
    kept = values > RANK_TOLERANCE
    rank = int(kept.sum())
    fit = Fit("OK", n, rank, sst=sst)
    if constant[-1]:
        fit.status = "CONSTANT_TARGET"
        return fit
    if rank < size:
        if collinear != "shortest":
            fit.status = "SINGULAR"
            return fit
        fit.status = "RANK_DEFICIENT"
    basis = vectors[:, kept]
    slopes_inverse = (basis / values[kept]) @ basis.T / np.outer(scale, scale)
    slopes = slopes_inverse @ np.where(flat, 0.0, cross)
    mean, label_mean = mean[:-1], mean[-1]
    beta = np.concatenate([[label_mean - mean @ slopes], slopes])
    corner = slopes_inverse @ mean
    inverse = np.empty((size + 1, size + 1))
    inverse[0, 0] = 1.0 / n + mean @ corner
    inverse[0, 1:] = inverse[1:, 0] = -corner
    inverse[1:, 1:] = slopes_inverse
    if rank < size:
        # Directions the data cannot tell apart, in raw coordinates; the
        # shortest solution has no part along them.
        lost = vectors[:, ~kept] / scale[:, None]
        null = np.vstack([-(mean @ lost), lost])
        projector = np.eye(size + 1) - null @ np.linalg.pinv(null)
        projector[np.abs(projector) < 1e-12] = 0.0
        beta = projector @ beta
        inverse = projector @ inverse @ projector
        fit.projector = projector
    fit.beta, fit.inverse, fit.mean, fit.slopes_inverse = beta, inverse, mean, slopes_inverse
    fit.spread = np.sqrt(variance / (n - 1))
    fit.sse = max(sst - cross @ slopes, 0.0)
    return fit


def _row(fit: Fit, standardised: bool) -> dict:
    row = {"status": fit.status, "n": fit.n, "rank": fit.rank, "sst": fit.sst}
    if fit.beta is None:
        return row
    beta, inverse = fit.beta, fit.inverse
    if standardised:
        # the same fit told in predictors of mean 0 and deviation 1
        to_scaled = np.zeros((len(beta), len(beta)))
        to_scaled[0, 0] = 1.0
        to_scaled[0, 1:] = fit.mean
        to_scaled[1:, 1:] = np.diag(fit.spread)
        beta, inverse = to_scaled @ beta, to_scaled @ inverse @ to_scaled.T
    freedom = fit.n - fit.rank - 1
    variance = np.clip(np.diag(inverse), 0.0, None) * fit.sse / freedom
    with np.errstate(divide="ignore", invalid="ignore"):
        errors = np.sqrt(variance)
        pvalues = tails.t_two_sided(beta / errors, freedom)
    order = [*range(1, len(beta)), 0]  # intercept last
    row |= {
        "coefficients": beta[1:].tolist(),
        "intercept": float(beta[0]),
        "std_errors": errors[order].tolist(),
        "pvalues": [None if np.isnan(p) else float(p) for p in pvalues[order]],
        "sse": fit.sse,
    }
    return row


def solve_plan(sweep: Sweep, plan: DataFrame, keep_fit: bool = False) -> DataFrame:
    """Solved models of a plan: coefficients, errors, p-values and sums of squares.

    ``keep_fit`` adds the whole fit, for what is computed from it later.
    """
    layout = sweep.layout()
    schema = T.StructType([*_SOLVED.fields, *([T.StructField("fit", T.BinaryType())] if keep_fit else [])])

    def basis_of(row) -> list[int]:
        return [*layout.terms(list(row.predictors)), layout.label(row.target)]

    def fitted(model, sums: M.Limbs | None, overflowed: bool) -> Fit:
        if sums is None:
            return Fit("INSUFFICIENT", 0)
        n, mean, table = M.about_means(sums, len(basis_of(model)) + 1)
        return Fit("OVERFLOW", n) if overflowed else solve(n, mean, table, layout.collinear)

    def solver(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = M.summed_models(frames, lambda row: len(basis_of(row)))
        for some in M.in_lots(models, 1000):
            rows = []
            for model, sums, overflowed in some:
                fit = fitted(model, sums, overflowed)
                # arrays of unfitted models must be None, not a missing key
                row = dict.fromkeys(schema.names) | _row(fit, layout.standardised)
                row |= {
                    "model_id": model.model_id,
                    "target": model.target,
                    "predictors": list(model.predictors),
                    "formula": model.formula,
                }
                if keep_fit:
                    row["fit"] = pickle.dumps(vars(fit))
                rows.append(row)
            yield pd.DataFrame(rows, columns=schema.names)

    wanted = plan.select("model_id", "target", "predictors", "formula")
    rows = M.model_sums(sweep.frame, sweep.columns, sweep.pairs, wanted, basis_of)
    return rows.repartition("model_id").sortWithinPartitions("model_id").mapInPandas(solver, schema)


def r2_of(sse: Column, sst: Column) -> Column:
    """Share of the label's variance that the model explains."""
    return 1 - sse / sst


def adjusted_r2(r2: Column, n: Column, rank: Column) -> Column:
    """R² with the loss of degrees of freedom taken out."""
    return 1 - (1 - r2) * (n - 1) / (n - rank - 1)


def count_significant(pvalues: Column) -> Column:
    """Entries below the significance level; missing ones do not count."""
    return F.size(F.filter(pvalues, lambda p: p.isNotNull() & (p < SIGNIFICANT)))


def count_nonzero(coefficients: Column) -> Column:
    """Coefficients further than 1e-8 from zero."""
    return F.size(F.filter(coefficients, lambda c: F.abs(c) > NONZERO))


def with_measures(solved: DataFrame) -> DataFrame:
    """Fit measures as column expressions, in the result schema."""
    n, rank = F.col("n"), F.col("rank")
    fitted = F.col("sse").isNotNull()
    slope_pvalues = F.slice("pvalues", 1, F.size("pvalues") - 1)
    measured = solved.withColumn("r2", F.when(fitted, r2_of(F.col("sse"), F.col("sst"))))
    return measured.withColumns(
        {
            "rmse": F.when(fitted, F.sqrt(F.col("sse") / n)),
            "adj_r2": F.when(fitted, adjusted_r2(F.col("r2"), n, rank)),
            "n_sig_with_intercept": F.when(fitted, count_significant(F.col("pvalues"))),
            "n_sig_predictors": F.when(fitted, count_significant(slope_pvalues)),
            "n_nonzero": F.when(fitted, count_nonzero(F.col("coefficients"))),
            "bp_stat": F.lit(None).cast("double"),
            "bp_pvalue": F.lit(None).cast("double"),
            "estimation": F.when(fitted, F.lit("OLS")),
        }
    ).select(*[F.col(field.name).cast(field.dataType) for field in MODEL_RESULT])


def run_sweep(sweep: Sweep, plan: DataFrame) -> DataFrame:
    """All models of the plan in the result schema; one row per model, failed ones included."""
    return with_measures(solve_plan(sweep, plan))


def with_residuals(df: DataFrame, label: str, predictors: Sequence[str], model) -> DataFrame:
    """``prediction`` and ``residual`` of one solved model row, as plain expressions."""
    prediction = F.lit(float(model["intercept"]))
    for name, coefficient in zip(predictors, model["coefficients"]):
        prediction = prediction + F.lit(float(coefficient)) * F.col(name)
    return df.withColumn("prediction", prediction).withColumn(
        "residual", F.col(label) - F.col("prediction")
    )
