"""Random Fourier features: a Gaussian kernel for linear solvers."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.vectors import vector_width

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def frequencies(places: int, gamma: float, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slopes, shifts) of the features; fixed by the seed."""
    rng = np.random.default_rng(seed)
    return rng.normal(scale=np.sqrt(2 * gamma), size=(places, width)), rng.uniform(0, 2 * np.pi, width)


def fourier_features(
    df: DataFrame, vector: str = "vector", gamma: float = 1.0, width: int = 500, seed: int = 5, out: str = "features"
) -> DataFrame:
    """Add ``out``: ``width`` cosines whose inner products estimate exp(-gamma |x - y|^2).

    The error of the estimate falls with the root of the width. Row by row, without a
    shuffle; a linear classifier on these features is a Gaussian-kernel classifier on the
    vectors, for any number of rows. The slopes (places x width) travel with the tasks. A
    null vector has null features.
    """
    slopes, shifts = frequencies(vector_width(df.where(F.col(vector).isNotNull()), vector), gamma, width, seed)
    scale = np.sqrt(2.0 / width)

    @F.pandas_udf("array<double>")
    def waves(column: pd.Series) -> pd.Series:
        there = column.notna().to_numpy()
        found = [None] * len(column)
        if there.any():
            x = np.stack(column[there].to_numpy()).astype(np.float64)
            for i, row in zip(np.flatnonzero(there), scale * np.cos(x @ slopes + shifts), strict=True):
                found[i] = row
        return pd.Series(found, dtype=object)

    found = df.withColumn(out, waves(F.col(vector).cast("array<double>")))
    return found.withColumn(out, F.when(F.col(out).isNotNull(), array_to_vector(out)))
