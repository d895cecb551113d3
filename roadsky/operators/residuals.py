"""Residuals of every model of a plan, summed up in one pass.

The solved models lie in the shared folder; a task reads them once and holds
the coefficients of models with equal terms as one matrix, so a block of rows
is one matrix product for each term set. Per model it keeps a few sums and a
sketch of the residuals: counts per logarithmic bucket, sign apart. Buckets
are fixed (powers of ``GROWTH``), so sketches merge by adding counts, in any
order, to the same result; a quantile is told to within one per cent of its
value.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadsky.operators import moments as M
from roadsky.operators import ols
from roadsky.operators.robust import bundles_of
from roadsky.session import scratch_path

GROWTH = 1.02
#: Added to a bucket's power, so that buckets of positive residuals are above zero for all doubles.
MIDDLE = 40_000


def buckets_of(e: np.ndarray) -> np.ndarray:
    """Bucket of each residual: rising with it, 0 for zero."""
    size = np.abs(e)
    with np.errstate(divide="ignore"):
        power = np.ceil(np.log(size) / np.log(GROWTH))
    return np.where(size == 0, 0, np.sign(e) * (np.where(size == 0, 0, power) + MIDDLE)).astype(np.int32)


def bucket_value(bucket: Column) -> Column:
    """The number that is within one per cent of all in a bucket."""
    middle = F.pow(F.lit(GROWTH), F.abs(bucket) - MIDDLE) * 2 / (1 + GROWTH)
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * middle)


def _pass(sweep: ols.Sweep, path: str) -> DataFrame:
    """(model_id, bucket, n, total, size, square, least, most): a task's residuals of a model in a bucket."""
    columns, pairs, layout = sweep.columns, sweep.pairs, sweep.layout()

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles = None
        for block in M.read_blocks(batches):
            if bundles is None:
                bundles = bundles_of(path, layout, len(columns), pairs)
            missing, basis = np.isnan(block), M.extend(block, pairs)
            for bundle in bundles:
                there = ~missing[bundle["needed"]].any(axis=0)
                if not there.any():
                    continue
                x, y = basis[bundle["terms"]][:, there], basis[bundle["labels"]][:, there]
                e = y - bundle["centre"][:, None] - bundle["slopes"].T @ (x - bundle["mean"][:, None])
                model, row = np.nonzero(~np.isnan(e))
                if len(model):
                    yield from _counted(np.array(bundle["ids"], np.int64), model, e[model, row])

    schema = "model_id long, bucket int, n long, total double, size double, square double, least double, most double"
    return sweep.frame.select(*columns).mapInArrow(partial, schema)


def _counted(ids: np.ndarray, model: np.ndarray, e: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's residuals folded by (model, bucket)."""
    bucket = buckets_of(e)
    order = np.lexsort((bucket, model))
    model, bucket, e = model[order], bucket[order], e[order]
    first = np.flatnonzero(np.append(True, (model[1:] != model[:-1]) | (bucket[1:] != bucket[:-1])))
    yield pa.RecordBatch.from_pydict(
        {
            "model_id": ids[model[first]],
            "bucket": bucket[first],
            "n": np.diff(np.append(first, len(e))),
            "total": np.add.reduceat(e, first),
            "size": np.add.reduceat(np.abs(e), first),
            "square": np.add.reduceat(e * e, first),
            "least": np.minimum.reduceat(e, first),
            "most": np.maximum.reduceat(e, first),
        }
    )


def residual_summary(sweep: ols.Sweep, plan: DataFrame, quantiles: Sequence[float] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Per model: ``n, mean, mean_size, rmse, least, most`` of its residuals, and ``quantiles`` as an array.

    Models that cannot be fitted are left out. A quantile is the value of the
    first bucket that reaches its share of the rows.
    """
    spark = plan.sparkSession
    sweep = ols.staged(sweep, scratch_path(spark, "residual-frame"))
    path = scratch_path(spark, "residual-fits")
    ols.solve_plan(sweep, plan, keep_fit=True).write.parquet(path)
    sums = [F.sum(name).alias(name) for name in ("n", "total", "size", "square")]
    counted = _pass(sweep, path).groupBy("model_id", "bucket").agg(*sums, F.min("least").alias("least"), F.max("most").alias("most"))
    # at most a few thousand buckets a model, whatever the number of rows
    whole = Window.partitionBy("model_id")
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.repartition("model_id").withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(whole)})
    reached = [
        F.min(F.when(F.col("upto") >= F.ceil(F.lit(float(q)) * F.col("all")), F.col("bucket"))) for q in quantiles
    ]
    found = ranked.groupBy("model_id").agg(
        *sums, F.min("least").alias("least"), F.max("most").alias("most"), F.array(*[bucket_value(r) for r in reached]).alias("quantiles")
    )
    return found.select(
        "model_id",
        "n",
        (F.col("total") / F.col("n")).alias("mean"),
        (F.col("size") / F.col("n")).alias("mean_size"),
        F.sqrt(F.col("square") / F.col("n")).alias("rmse"),
        "least",
        "most",
        "quantiles",
    )
