"""Uniform shuffle of rows into shards of exactly equal size, by a hypergeometric communication matrix.

Rows are first written once, so that every row has a fixed place (file, number in the file). A *cell* is a run of at most `CELL`
such places. How many rows of each cell go to each shard is drawn before any row moves: the matrix of cells by shards has the
law that a uniform permutation of all rows would give it, with the sizes of the shards as column sums and those of the cells as
row sums. It is drawn down a tree over the numbers of the cells: a node deals what its parent got to its children, one multivariate
hypergeometric draw per child, so no task sees more than `FAN` children and no counts pass through the driver.

Within a cell a permutation decides which rows go to which shard. It follows from the seed and the cell alone, so every task
computes it for the rows that it has, and a repeated task gives the same rows. Rows then move to their shard once, keyed by a
random number whose high bits cut the shard into parts of a few thousand rows; they are put in random order again within it,
and the part's offset makes the slot.

Defined results: shards differ by one row at most, the first `rows % shards` ones are larger; slots run from 0 without gaps.
Repeated rows and rows with NULL ids are rows like others, since no value is looked at. An empty table gives no rows. The same
seed on the same files, read in the same splits, gives the same shards. Any columns are carried whole, also such named like
those used here.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekband.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a cell, and children of a node of the tree.
CELL, FAN_BITS = 1 << 16, 8
#: Rows that are put in order together at the end.
PART_ROWS = 4096
#: Above this population numpy does not draw.
NUMPY_POPULATION = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among `drawn` out of `good + bad`, for any population.

    Large populations are drawn by inversion over 40 deviations to either side of the mode; what lies beyond has a
    probability of less than 1e-300.
    """
    if good + bad < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, drawn))
    low, high = max(0, drawn - bad), min(good, drawn)
    total = good + bad
    mode = min(max((drawn + 1) * (good + 1) // (total + 2), low), high)
    share = good / total
    deviation = (drawn * share * (1 - share) * (total - drawn) / max(total - 1, 1)) ** 0.5
    reach = int(40 * deviation) + 40
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)  # log of p(k + 1) / p(k)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def deal(rng: np.random.Generator, left: np.ndarray, drawn: int) -> np.ndarray:
    """How many of `drawn` rows each shard takes, if they fill the places `left` at random."""
    taken = np.zeros_like(left)
    rest = int(left.sum())
    for j, places in enumerate(left.tolist()):
        if not drawn:
            break
        rest -= places
        taken[j] = hypergeometric(rng, places, rest, drawn)
        drawn -= int(taken[j])
    return taken


def communication_matrix(cells: DataFrame, shards: int, seed: int) -> DataFrame:
    """`cell`, `counts`: rows of each cell for each shard. `cells` has `cell` (long, 0 or more) and `rows`."""
    spark = cells.sparkSession
    total, last = cells.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("cell"), F.lit(0))).first()
    levels = max(1, -(-int(last).bit_length() // FAN_BITS))
    sizes = [total // shards + (j < total % shards) for j in range(shards)]

    def dealt(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        left = np.array(group["places"].iloc[0], dtype=np.int64)
        rng = np.random.default_rng([seed, int(group["level"].iloc[0]), int(group["parent"].iloc[0])])
        counts = []
        for drawn in group["rows"]:
            counts.append(deal(rng, left, int(drawn)))
            left = left - counts[-1]
        return pd.DataFrame({"parent": group["node"], "places": [c.tolist() for c in counts]})

    above = spark.createDataFrame([(0, sizes)], "parent long, places array<long>")
    for level in range(levels - 1, -1, -1):
        node = F.shiftright("cell", FAN_BITS * level)
        below = cells.groupBy(node.alias("node")).agg(F.sum("rows").alias("rows"))
        below = below.withColumn("parent", F.shiftright("node", FAN_BITS)).withColumn("level", F.lit(level))
        drawn = below.join(above, "parent").groupBy("parent").applyInPandas(dealt, "parent long, places array<long>")
        above = materialize(drawn)
    return above.select(F.col("parent").alias("cell"), F.col("places").alias("counts"))


def permuted(seed: int, cells: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """The place of a row in the permutation of its cell, from `cell`, the row's number in it, and the cell's rows."""
    known: dict[int, np.ndarray] = {}
    for cell, place, rows in cells:
        out = np.empty(len(cell), dtype=np.int64)
        ids, places = cell.to_numpy(), place.to_numpy()
        for one in np.unique(ids):
            here = ids == one
            if one not in known:
                if len(known) >= 32:
                    known.clear()
                known[one] = np.random.default_rng([seed, 1 << 20, int(one)]).permutation(int(rows.to_numpy()[here][0]))
            out[here] = known[one][places[here]]
        yield pd.Series(out)


def placed(df: DataFrame) -> DataFrame:
    """The rows as `_row`, each with its `_cell` and its `_place` in the cell; written once, so that places stay."""
    written = materialize(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")))
    name, index = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    file = F.regexp_extract(name, r"part-(\d+)", 1).cast("long")
    piece = F.coalesce(F.regexp_extract(name, r"-c(\d+)\.", 1).try_cast("long"), F.lit(0))
    block = F.expr(f"_metadata.row_index div {CELL}")
    last = written.agg(*[F.coalesce(F.max(c), F.lit(0)) for c in (piece, block)]).first()
    low, high = last[1].bit_length(), last[0].bit_length() + last[1].bit_length()
    cell = F.shiftleft(file, high) + F.shiftleft(piece, low) + block
    return written.select("_row", cell.alias("_cell"), (index % CELL).cast("long").alias("_place"))


def shuffled(df: DataFrame, shards: int, seed: int = 1) -> DataFrame:
    """All rows of `df` as `row`, with `shard` and `slot`: a uniform shuffle with exact sizes."""
    rows = placed(df)
    cells = materialize(rows.groupBy(F.col("_cell").alias("cell")).agg(F.count("*").alias("rows")))
    matrix = communication_matrix(cells, shards, seed)
    running = F.transform("counts", lambda _, i: F.aggregate(F.slice("counts", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    known = materialize(cells.join(matrix, "cell").select(F.col("cell").alias("_cell"), F.col("rows").alias("_rows"), running.alias("_ends")))

    @F.pandas_udf("long")
    def moved(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return permuted(seed, parts)

    moved = moved.asNondeterministic()  # computed once, not again in a pushed filter
    total = cells.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    parts = max(1, total // (shards * PART_ROWS))
    dealt = (
        rows.join(known, "_cell")
        .withColumn("_to", moved("_cell", "_place", "_rows"))
        .select(
            "_row",
            F.size(F.filter("_ends", lambda e: e <= F.col("_to"))).alias("shard"),
            F.pmod(F.xxhash64(F.lit(seed + 1), "_cell", "_place"), F.lit(parts)).alias("_part"),
            F.struct(F.xxhash64(F.lit(seed), "_cell", "_place").alias("key"), "_cell", "_place").alias("_order"),
        )
    )
    sizes = dealt.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(sizes.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    again = W.partitionBy("shard", "_part").orderBy("_order")
    return (
        dealt.withColumn("_rank", F.row_number().over(again))
        .join(starts, ["shard", "_part"])
        .select(F.col("_row").alias("row"), "shard", (F.col("_start") + F.col("_rank") - 1).alias("slot"))
    )


def write_shards(df: DataFrame, shards: int, folder: str, seed: int = 1) -> None:
    """Write the rows below `folder`, a subfolder `shard=K` each; files in the order of their names hold ascending slots."""
    out = shuffled(df, shards, seed)
    ordered = out.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("shard", "slot", "row").write.partitionBy("shard").parquet(folder)
