"""Trend, yearly Fourier pairs and dummies by normal equations: one aggregate per key, solved in expressions.

Every series adds up its products of two columns in one aggregation with partial sums, so neither the number of series nor that of
weeks binds a task. The small system of a key is then swept column by column; a column whose rest beside the swept ones is
(nearly) nothing depends on them and is left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekband.operators.common import join_on_keys
from weekband.operators.series import add_regressors, future_frame
from weekband.schema import Study, monday

WEEKS_PER_YEAR = 365.25 / 7.0
DUMMIES = ("new_system", "hmic_changes", "bank_holiday")
#: Part of a column's own square below which its rest counts as nothing.
PIVOT = 1e-9
#: Training weeks beyond the number of columns that a fit needs.
SPARE_WEEKS = 8


def design(study: Study, pairs: int) -> list[Column]:
    """Intercept, trend in years, sines, cosines, dummies; columns of a table with `week` and the dummies."""
    t = F.date_diff("week", F.lit(monday(study.cutoff))) / F.lit(7.0)
    turns = [t * (2 * math.pi * i / WEEKS_PER_YEAR) for i in range(1, pairs + 1)]
    dummies = [F.col(c).cast("double") for c in DUMMIES]
    return [F.lit(1.0), t / WEEKS_PER_YEAR, *(F.sin(a) for a in turns), *(F.cos(a) for a in turns), *dummies]


def swept(matrix: Column, size: int) -> Column:
    """(m, kept): the matrix after Gauss-Jordan steps on its first `size` columns; column j of the solution where kept[j]."""

    def step(state: Column, j: Column) -> Column:
        m = state["m"]
        pivot = F.element_at(F.element_at(m, j), j)
        fine = pivot > PIVOT * F.greatest(F.lit(1.0), F.element_at(F.element_at(matrix, j), j))
        row = F.transform(F.element_at(m, j), lambda v: v / pivot)
        done = F.transform(
            m,
            lambda r, i: F.when(i + 1 == j, row).otherwise(F.zip_with(r, row, lambda a, b: a - F.element_at(r, j) * b)),
        )
        return F.struct(F.when(fine, done).otherwise(m).alias("m"), F.concat(state["kept"], F.array(fine)).alias("kept"))

    start = F.struct(matrix.alias("m"), F.array().cast("array<boolean>").alias("kept"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(size)), start, step)


def coefficients(known: DataFrame, keys: Sequence[str], value: str, study: Study, pairs: int = 3) -> DataFrame:
    """(keys, n, beta, sigma) of each series; `known` has the regressors, and rows with NULL in `value` are left out.

    `beta` is 0 for columns left out; `sigma` and `beta` are NULL where there are fewer than `SPARE_WEEKS` weeks beyond the columns.
    """
    x = [*design(study, pairs), F.col(value).cast("double")]
    size = len(x) - 1
    named = known.where(F.col(value).isNotNull()).select(*keys, *(c.alias(f"_x{i}") for i, c in enumerate(x)))
    sums = [
        F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_{i}_{j}") for i in range(size + 1) for j in range(i, size + 1)
    ]
    gram = named.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    entry = lambda i, j: F.col(f"_{min(i, j)}_{max(i, j)}")
    matrix = F.array(*[F.array(*[entry(i, j) for j in range(size + 1)]) for i in range(size + 1)])
    solved = gram.select(*keys, "n", matrix.alias("_g")).withColumn("_s", swept(F.col("_g"), size))
    used = F.size(F.filter("_s.kept", lambda k: k))
    enough = F.col("n") >= used + SPARE_WEEKS
    last = F.transform(F.slice("_s.m", 1, size), lambda r: F.element_at(r, size + 1))
    beta = F.zip_with(last, F.col("_s.kept"), lambda b, k: F.when(k, b).otherwise(F.lit(0.0)))
    left = F.greatest(F.element_at(F.element_at("_s.m", size + 1), size + 1), F.lit(0.0))
    sigma = F.sqrt(left / F.nullif(F.col("n") - used, F.lit(0)))
    return solved.select(*keys, "n", F.when(enough, beta).alias("beta"), F.when(enough, sigma).alias("sigma"))


def predicted(study: Study, pairs: int = 3) -> Column:
    """The fitted value of a row with `week`, the dummies and `beta`."""
    terms = [F.element_at("beta", i + 1) * c for i, c in enumerate(design(study, pairs))]
    return reduce(Column.__add__, terms)


def harmonic_forecast(train: DataFrame, keys: Sequence[str], value: str, study: Study, half: float) -> DataFrame:
    """(keys, week, mean, lower, upper) for the horizon weeks of every key."""
    known = add_regressors(train.select(*keys, "week", value), study)
    fit = coefficients(known, keys, value, study)
    ahead = join_on_keys(future_frame(fit, keys, study), fit.drop("n"), keys, "inner")
    reach = F.lit(half) * F.col("sigma")
    banded = ahead.withColumn("mean", predicted(study))
    return banded.select(*keys, "week", "mean", (F.col("mean") - reach).alias("lower"), (F.col("mean") + reach).alias("upper"))


def harmonic_fitted(train: DataFrame, keys: Sequence[str], value: str, study: Study) -> DataFrame:
    """(keys, week, fitted) over the training weeks."""
    known = add_regressors(train.select(*keys, "week", value), study)
    fit = coefficients(known, keys, value, study).drop("n", "sigma")
    return join_on_keys(known, fit, keys, "inner").select(*keys, "week", predicted(study).alias("fitted"))
