"""Feature vectors for ``pyspark.ml``, for models beyond least squares.

The sweeps of this package do not need them: they work on plain columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame


def assemble(
    df: DataFrame, predictors: Sequence[str], out: str = "features", invalid: str = "error"
) -> DataFrame:
    """Predictors as one vector; ``invalid`` is "error" or "skip" for rows that lack a value."""
    assembler = VectorAssembler(inputCols=list(predictors), outputCol=out, handleInvalid=invalid)
    return assembler.transform(df)


def standardise(df: DataFrame, features: str = "features", out: str = "scaled_features") -> DataFrame:
    """Vectors with mean 0 and sample deviation 1; the fit is one aggregation pass."""
    scaler = StandardScaler(inputCol=features, outputCol=out, withMean=True, withStd=True)
    return scaler.fit(df).transform(df)
