"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by(keys: Sequence[str]) -> WindowSpec:
    """Window over `keys`, or over the whole (small, aggregated) table when there are none."""
    return Window.partitionBy(*(keys or [F.lit(0)]))


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys where NULL equals NULL; key columns appear once."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = reduce(Column.__and__, (left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys))
    joined = left.join(renamed, match, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how == "full":
        joined = joined.withColumns({k: F.coalesce(k, f"_right_{k}") for k in keys})
    return joined.drop(*(f"_right_{k}" for k in keys))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(Column.__or__, conditions)
