"""Exact quantiles and positions that never gather a whole group in one task.

Values are first counted per (group, value). Positions then come from a running sum over coarse
buckets of the value, and only the few buckets that hold a wanted position are sorted in full. A
hot group is spread over tasks by value, and a bucket holds no more rows than it has values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekband.operators.common import any_of, by, join_on_keys


def values_at(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    positions: Mapping[str, Column],
    width: float,
    weight: str | None = None,
) -> DataFrame:
    """One row per group: `n` non-null values, their `total`, and the value at each 0-based position.

    `positions` maps an output name to an expression over `n` and the keys. `width` is the bucket width:
    any positive number gives the same result, it only balances the two steps. A group whose
    values are all NULL keeps a row with NULLs.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = (
        df.groupBy(*keys, F.col(value).alias("_v"))
        .agg(rows.alias("_rows"))
        .withColumn("_m", F.when(F.col("_v").isNotNull(), F.col("_rows")).otherwise(0))
        .withColumn("_b", F.floor(F.col("_v") / F.lit(float(width))))
    )
    mass = F.sum(F.col("_m") * F.col("_v").cast("double"))
    upto = F.sum("_m").over(by(keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    buckets = (
        counted.groupBy(*keys, "_b")
        .agg(F.sum("_m").alias("_m"), mass.alias("_mass"))
        .select(
            *keys,
            "_b",
            (upto - F.col("_m")).alias("_before"),
            upto.alias("_upto"),
            F.sum("_m").over(by(keys)).alias("n"),
            F.sum("_mass").over(by(keys)).alias("total"),
        )
        .withColumns({f"_p_{name}": p.cast("bigint") for name, p in positions.items()})
    )
    wanted = any_of(
        [(F.col("_before") <= F.col(f"_p_{p}")) & (F.col(f"_p_{p}") < F.col("_upto")) for p in positions]
        + [(F.col("n") == 0) & F.col("_b").isNull()]
    )
    picked = buckets.where(wanted).drop("_upto")
    inside = join_on_keys(counted.select(*keys, "_v", "_m", "_b"), picked, [*keys, "_b"], "inner")
    end = F.col("_before") + F.sum("_m").over(
        by([*keys, "_b"]).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = inside.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("_m"))

    def at(position: str) -> Column:
        here = (F.col("_start") <= F.col(f"_p_{position}")) & (F.col(f"_p_{position}") < F.col("_end"))
        return F.max(F.when(here, F.col("_v"))).alias(position)

    return ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("total").alias("total"), *(at(p) for p in positions)
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    width: float,
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation between the two closest ranks."""
    spot = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in probs.items()}
    positions: dict[str, Column] = {}
    for name, h in spot.items():
        positions[f"_lo_{name}"] = F.floor(h)
        positions[f"_hi_{name}"] = F.ceil(h)
    found = values_at(df, keys, value, positions, width, weight)

    def interpolate(name: str) -> Column:
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        h = spot[name]
        return (lo + (hi - lo) * (h - F.floor(h))).alias(name)

    return found.select(*keys, "n", "total", *(interpolate(p) for p in probs))


def median(
    df: DataFrame, keys: Sequence[str], value: str, width: float, weight: str | None = None
) -> DataFrame:
    """Exact median; NULLs dropped, the mean of the two middle values for an even count."""
    return quantiles(df, keys, value, {"median": 0.5}, width, weight).drop("total")


def global_position(
    df: DataFrame, order: Sequence[str], buckets: Sequence[Column], name: str
) -> DataFrame:
    """1-based position of each row in the order of `order` over the whole table.

    `buckets` run from coarse to fine, and no bucket may split a run of the order. Rows are
    numbered within the finest buckets, whose sizes are summed up level by level, each level
    within its parent, so no task orders more than one bucket's rows or children.
    """
    levels = [f"_bucket_{i}" for i in range(len(buckets))]
    rows = df.withColumns(dict(zip(levels, buckets)))
    sizes = rows.groupBy(*levels).agg(F.count(F.lit(1)).alias("_size"))
    offsets: DataFrame | None = None
    for depth, level in enumerate(levels):
        parents, path = levels[:depth], levels[: depth + 1]
        summed = sizes.groupBy(*path).agg(F.sum("_size").alias("_size"))
        upto = F.sum("_size").over(
            by(parents).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
        )
        own = summed.select(*path, (upto - F.col("_size")).alias("_own"))
        if offsets is not None:
            own = join_on_keys(own, offsets, parents, "inner").withColumn(
                "_own", F.col("_own") + F.col("_before")
            )
        offsets = own.select(*path, F.col("_own").alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*levels).orderBy(*order))
    return (
        join_on_keys(rows, offsets, levels, "inner")
        .withColumn(name, F.col("_before") + inside)
        .drop(*levels, "_before")
    )


def tile(position: Column, total: Column, tiles: int) -> Column:
    """Tile of a 1-based position when `total` rows are cut into nearly equal tiles."""
    size, longer = F.floor(total / F.lit(tiles)), F.pmod(total, F.lit(tiles))
    edge = longer * (size + 1)
    head = F.ceil(position / (size + 1))
    tail = longer + F.ceil((position - edge) / F.nullif(size, F.lit(0)))
    return F.when(position <= edge, head).otherwise(tail)
