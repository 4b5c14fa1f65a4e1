"""Local quadratic smoother for weekly series."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def smooth(series: DataFrame, keys: Sequence[str], value: str, span: float = 0.2) -> DataFrame:
    """Series with `smoothed`, one group per key; a group is a series, bounded by its weeks."""
    if not keys:
        raise ValueError("give a key column, a constant one for a single series")
    schema = T.StructType([*series.schema.fields, T.StructField("smoothed", T.DoubleType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("week")
        weeks = pd.to_datetime(pdf["week"]).to_numpy().astype("datetime64[D]").astype(float) / 7.0
        return pdf.assign(smoothed=local_quadratic(weeks, pdf[value].to_numpy(dtype=float), span))

    return series.groupBy(*keys).applyInPandas(fit, schema)


def local_quadratic(x: np.ndarray, y: np.ndarray, span: float) -> np.ndarray:
    """Fit a quadratic around each x over the nearest `span` of the points, tricube weights."""
    known = ~np.isnan(y)
    xs, ys = x[known], y[known]
    fitted = np.full(len(x), np.nan)
    nearest = int(np.floor(len(xs) * span + 1e-5))
    if nearest < 4:
        return fitted
    for i, x0 in enumerate(x):
        gap = np.abs(xs - x0)
        reach = np.partition(gap, nearest - 1)[nearest - 1]
        inside = gap < reach
        if np.count_nonzero(inside) < 3:
            continue
        u = (xs[inside] - x0) / reach
        root = np.sqrt((1 - np.abs(u) ** 3) ** 3)
        design = np.stack([np.ones_like(u), u, u * u], axis=1)
        fitted[i] = np.linalg.lstsq(design * root[:, None], ys[inside] * root, rcond=None)[0][0]
    return fitted
