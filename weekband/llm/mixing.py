"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the number of times it should appear. Of all rates that meet the token
target of each source, the balanced ones are nearest to 1 in relative entropy. They are
exponentially tilted by the size of a document: the odds of rate against headroom, `r / (cap - r)`,
are those of rate 1 times `exp(lambda * size)`. One multiplier per source solves the convex dual; all
are found together by safeguarded Newton steps over a histogram of sizes, so an iteration costs as much
as there are distinct (source, size) pairs.

Rates become copies by systematic rounding in the order of size, the largest documents first; what whole
copies of them miss is made up by smaller ones. What is left at the end, in words, is settled by a few copies more or fewer of chosen sizes:
`PER_OCTAVE` sizes of each octave of sizes, smallest first, so at most some hundred for a source however large it is. Of the changes tried, largest
size first, the `BEAM` that leave the least are followed up. A source with a handful of documents meets its target to
the word where whole copies allow it and the search finds them.

Defined results: a NULL text has size 0; documents of size 0 get rate 1 and take nothing; a NULL source is a source of its own;
repeated rows are separate documents; an empty table gives an empty result. Columns of the input are not carried along
except those named, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weekband.llm.common import materialize

#: Key of the NULL source; keys of the others begin with another sign.
NO_SOURCE = "-"
#: Slices of a hot (source, size) group; each is ranked on its own.
SLICES = 256
#: Sizes of a source in each octave that may settle what rounding left, and changes that are followed up at once.
PER_OCTAVE, BEAM = 4, 128


def exact_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on the order of the rows: in whole billionths."""
    return (F.sum(F.round(value * F.lit(1e9)).cast("decimal(38,0)")) / F.lit(1e9)).cast("double")


def water_fill(totals: DataFrame, cap: float) -> DataFrame:
    """`target` per source: shares of the sum of `size` by `weight`, at most `cap` times its own size.

    The excess of capped sources is shared by weight until none is above its cap. Sources are
    filled in the order in which they reach their caps, so one pass of prefix sums finds the level.
    `totals` has one row per source.
    """
    order = W.orderBy(F.col("_limit") / F.col("weight"), "rank")
    whole = W.partitionBy()
    ratio = F.col("_limit") / F.col("weight")
    filled = (
        totals.withColumn("_limit", F.col("size") * F.lit(cap))
        .withColumn("_open", F.sum("weight").over(whole) - F.sum("weight").over(order) + F.col("weight"))
        .withColumn("_left", F.sum("size").over(whole) - F.sum("_limit").over(order) + F.col("_limit"))
        .withColumn("_level", F.col("_left") / F.col("_open"))
        .withColumn("_under", F.col("_level") * F.col("weight") < F.col("_limit"))
        # The first source that stays under its cap fixes the level of all that do.
        .withColumn("_final", F.min_by("_level", F.when(F.col("_under"), ratio)).over(whole))
    )
    target = F.least(F.col("_limit"), F.coalesce(F.col("weight") * F.col("_final"), F.col("_limit")))
    return filled.withColumn("target", target.cast("double")).select(*totals.columns, "target")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """One row per source: `key`, `size`, `target`. Weights repeat over sources in code point order, NULL last."""
    totals = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("size"))
    rank = F.row_number().over(W.orderBy(F.col("key") == NO_SOURCE, "key")) - 1
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighted = totals.withColumn("rank", rank).withColumn("weight", cycle[F.col("rank") % len(weights)])
    return water_fill(weighted, cap).select("key", "size", "target")


def tilted_rate(multiplier: Column, size: Column, cap: float) -> Column:
    """Rate between 0 and `cap`, 1 at multiplier 0."""
    exponent = F.least(F.greatest(multiplier * size, F.lit(-700.0)), F.lit(700.0))
    return F.lit(cap) / (1 + F.lit(cap - 1) * F.exp(-exponent))


def balance(sizes: DataFrame, targets: DataFrame, cap: float, tolerance: float, max_steps: int) -> DataFrame:
    """`multiplier` per source, by Newton steps on the dual; `closed` marks targets at 0 or at the cap.

    A step that leaves the bracket around the solution is replaced by its middle; while one side of
    the bracket is open a step at most doubles the multiplier. Every step is written to the shared
    folder, so the plan stays short and a lost executor repeats one step only.
    """
    positive = sizes.where("size > 0")
    words = F.col("size") * F.col("n")
    scale = positive.groupBy("key").agg((exact_sum(words.cast("double") * F.col("size")) / F.sum(words)).alias("scale"))
    closed = (F.col("target") <= 0) | (F.col("target") >= F.lit(cap) * F.col("size") * (1 - 1e-12))
    state = materialize(
        targets.join(scale, "key", "left").select(
            "key",
            "size",
            "target",
            F.coalesce("scale", F.lit(1.0)).alias("scale"),
            F.lit(0.0).alias("m"),
            F.lit(-math.inf).alias("lo"),
            F.lit(math.inf).alias("hi"),
            closed.alias("closed"),
            closed.alias("done"),
        )
    )
    rows = positive.select("key", F.col("size").alias("_size"), "n")
    for _ in range(max_steps):
        if state.where("NOT done").isEmpty():
            break
        open_sources = state.where("NOT done")
        rate = tilted_rate(F.col("m") / F.col("scale"), F.col("_size"), cap)
        words = F.col("_size") * F.col("n")
        slope = words * F.col("_size") / F.col("scale") * rate * (1 - rate / F.lit(cap))
        sums = (
            rows.join(open_sources, "key")
            .groupBy("key")
            .agg(exact_sum(words * rate).alias("got"), exact_sum(slope).alias("slope"))
        )
        off = F.col("got") - F.col("target")
        low = F.when(off < 0, F.col("m")).otherwise(F.col("lo"))
        high = F.when(off > 0, F.col("m")).otherwise(F.col("hi"))
        newton = F.col("m") - off / F.greatest(F.col("slope"), F.lit(1e-300))
        reach = F.greatest(F.lit(1.0), F.abs("m"))
        bounded = F.least(F.greatest(newton, F.col("m") - reach), F.col("m") + reach)
        middle = (low + high) / 2
        inside = (bounded > low) & (bounded < high)
        met = F.abs(off) <= F.lit(tolerance) * F.col("target") + 1e-6
        step = F.when(met, F.col("m")).when(inside, bounded).when(F.abs(middle) < math.inf, middle).otherwise(bounded)
        state = materialize(
            state.join(sums, "key", "left").select(
                "key",
                "size",
                "target",
                "scale",
                F.when(F.col("done"), F.col("m")).otherwise(step).alias("m"),
                F.when(F.col("done"), F.col("lo")).otherwise(low).alias("lo"),
                F.when(F.col("done"), F.col("hi")).otherwise(high).alias("hi"),
                "closed",
                (F.col("done") | F.coalesce(met, F.lit(True))).alias("done"),
            )
        )
    multiplier = F.col("m") / F.col("scale")
    return state.select(
        "key", F.col("size").alias("source_size"), "target", multiplier.alias("multiplier"), "closed", F.col("done").alias("converged")
    )


def rounded_by_level(rated: DataFrame, cap: float, levels: int = 4, factor: int = 8) -> DataFrame:
    """`key`, `size`, `rate`, `owed`: the rates that are rounded, and the copies owed to smaller sizes of the level.

    Large documents come first. What their whole copies miss or exceed, in words, is spread over the rates of the
    next level, whose documents are smaller by `factor`; so the error left at the end is that of small documents.
    All of this is arithmetic on the histogram: a group of `n` equal documents gets
    `floor(owed + n * rate + 1/2) - floor(owed + 1/2)` copies.
    """
    largest = W.partitionBy("key")
    level = F.floor(F.log(F.max("size").over(largest) / F.greatest("size", F.lit(1))) / math.log(factor))
    rows = materialize(
        rated.withColumn("level", F.least(level, F.lit(levels - 1))).select(
            "key", "size", "n", "rate", "level"
        )
    )
    by_size = W.partitionBy("key").orderBy("size").rowsBetween(W.unboundedPreceding, W.currentRow)
    words = F.col("size") * F.col("n")
    carry: DataFrame | None = None
    done: DataFrame | None = None
    for at in range(levels):
        here = rows.where(F.col("level") == at)
        if carry is not None:
            spread = here.groupBy("key").agg(F.sum(words).alias("_words")).join(carry, "key")
            shift = spread.select("key", (F.col("_carry") / F.greatest("_words", F.lit(1))).alias("_shift"))
            shifted = F.col("rate") + F.coalesce("_shift", F.lit(0.0))
            bounded = F.when(F.col("size") == 0, F.col("rate")).otherwise(F.least(F.greatest(shifted, F.lit(0.0)), F.lit(float(cap))))
            here = here.join(shift, "key", "left").withColumn("used", bounded).drop("_shift")
        else:
            here = here.withColumn("used", F.col("rate"))
        all_copies = F.col("used") * F.col("n")
        here = materialize(here.withColumn("owed", F.sum(all_copies).over(by_size) - all_copies))
        done = here if done is None else done.unionByName(here)
        copies = F.floor(F.col("owed") + all_copies + 0.5) - F.floor(F.col("owed") + 0.5)
        carry = done.groupBy("key").agg(exact_sum((F.col("rate") * F.col("n") - copies) * F.col("size")).alias("_carry"))
    named = done.withColumn("copies", F.floor(F.col("owed") + all_copies + 0.5) - F.floor(F.col("owed") + 0.5))
    return settled(named.drop("rate").withColumnRenamed("used", "rate"), carry, cap).select("key", "size", "rate", "owed")


def settled(rounded: DataFrame, carry: DataFrame, cap: float) -> DataFrame:
    """`rounded` with the rates of some sizes changed so that the words in `carry` are spent; a changed size owes nothing.

    `copies` are those of all `n` documents of a size. A change keeps them between 0 and `cap * n`.
    """
    octave = W.partitionBy("key", F.floor(F.log2("size"))).orderBy("size")
    chosen = rounded.where("size > 0").withColumn("_place", F.row_number().over(octave)).where(F.col("_place") <= PER_OCTAVE)
    change = F.struct("size", F.col("copies").cast("long").alias("down"), (F.col("n") * int(cap) - F.col("copies")).cast("long").alias("up"))
    items = chosen.groupBy("key").agg(F.sort_array(F.collect_list(change), asc=False).alias("items"))
    left = F.round("_carry").cast("long")
    moves = (
        items.join(carry, "key")
        .select("key", F.arrays_zip(F.col("items.size").alias("size"), best_moves("items", left).alias("extra")).alias("moves"))
        .select("key", F.inline("moves"))
        .where("extra != 0")
    )
    whole = (F.col("copies") + F.col("extra")).cast("double") / F.col("n")
    return (
        rounded.join(moves, ["key", "size"], "left")
        .withColumn("rate", F.when(F.col("extra").isNull(), F.col("rate")).otherwise(whole))
        .withColumn("owed", F.when(F.col("extra").isNull(), F.col("owed")).otherwise(F.lit(0.0)))
    )


def best_moves(items: str, left: Column) -> Column:
    """Change of copies per item that leaves the fewest of `left` words, of these the one with the fewest copies changed.

    A state is what is left, and the changes so far. For every item each state goes on with no change, one copy more or fewer, and
    as many as fit into what is left; of states that leave equally much one stays, and of all the `BEAM` with the least left.
    """
    state = "array<struct<off:bigint,cost:bigint,left:bigint,moves:array<bigint>>>"
    start = F.array(F.struct(F.abs(left), F.lit(0), left, F.array().cast("array<bigint>"))).cast(state)

    def moved(s: Column, item: Column, by: Column) -> Column:
        rest = s["left"] - by * item["size"]
        return F.struct(
            F.abs(rest).alias("off"),
            (s["cost"] + F.abs(by)).alias("cost"),
            rest.alias("left"),
            F.concat(s["moves"], F.array(by)).alias("moves"),
        )

    def step(states: Column, item: Column) -> Column:
        def follow(s: Column) -> Column:
            fits = (s["left"] / item["size"]).cast("long")
            tried = F.array(F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(-1).cast("long"), fits, fits + F.signum(s["left"]).cast("long"))
            bounded = F.transform(tried, lambda by: F.least(F.greatest(by, -item["down"]), item["up"]))
            return F.transform(F.array_distinct(bounded), lambda by: moved(s, item, by))

        every = F.array_sort(F.flatten(F.transform(states, follow)))
        # Bound to a name by a transform over one element, so that it is sorted once and not for every state.
        return F.element_at(F.transform(F.array(every), different), 1)

    def different(states: Column) -> Column:
        first = lambda s, i: (i == 0) | (F.get(states, i - 1)["left"] != s["left"])
        return F.slice(F.filter(states, first), 1, BEAM)

    return F.aggregate(items, start, step, lambda states: F.element_at(states, 1)["moves"])


def mix(
    docs: DataFrame,
    doc_id: str,
    source: str,
    size: Column,
    weights: Sequence[float] = (1.0, 2.0, 3.0),
    cap: float = 3.0,
    carry: Sequence[str] = (),
    tolerance: float = 1e-9,
    max_steps: int = 80,
) -> DataFrame:
    """One row per document: `doc_id`, `source`, `size`, `source_size`, `target`, `rate`, `copies`, `converged` and `carry`.

    `converged` says whether the rates of the document's source met its target within `max_steps` Newton steps; where
    they did not, rounding starts from the nearest rates found.

    No document gets more than `cap` copies; equal inputs give equal copies on every run. `cap` must be a whole number above 1.
    """
    if cap <= 1 or cap != int(cap):
        raise ValueError("cap must be a whole number above 1")
    name = F.col(source).cast("string")
    known = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), name), F.lit(NO_SOURCE)).alias("key"),
        size.cast("long").alias("size"),
        *(F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)),
    ).withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)))
    slices = materialize(known.groupBy("key", "size", "slice").agg(F.count(F.lit(1)).alias("n")))
    sizes = materialize(slices.groupBy("key", "size").agg(F.sum("n").alias("n")))
    targets = materialize(source_targets(sizes, weights, cap))
    solved = balance(sizes, targets, cap, tolerance, max_steps)

    tilt = (
        F.when(F.col("size") == 0, F.lit(1.0))
        .when(F.col("closed") & (F.col("target") <= 0), F.lit(0.0))
        .when(F.col("closed"), F.lit(float(cap)))
        .otherwise(tilted_rate(F.col("multiplier"), F.col("size"), cap))
    )
    rounded = materialize(rounded_by_level(sizes.join(solved, "key").withColumn("rate", tilt), cap))
    owed = rounded.join(solved.select("key", "source_size", "target", "converged"), "key")
    # Documents of equal size in earlier slices: at most SLICES rows per group.
    in_group = W.partitionBy("key", "size").orderBy("slice")
    before = slices.withColumn("before", F.sum("n").over(in_group) - F.col("n")).drop("n")
    start = materialize(before.join(owed, ["key", "size"]))
    in_slice = W.partitionBy("key", "size", "slice").orderBy("doc_id")
    place = F.col("before") + F.col("_n")
    upto = F.floor(F.col("owed") + F.col("rate") * place + 0.5)
    copies = upto - F.floor(F.col("owed") + F.col("rate") * (place - 1) + 0.5)
    return (
        known.withColumn("_n", F.row_number().over(in_slice))
        .join(start, ["key", "size", "slice"])
        .select(
            "doc_id",
            F.when(F.col("key") != NO_SOURCE, F.substr("key", F.lit(2))).alias("source"),
            "size",
            "source_size",
            "target",
            "rate",
            F.least(F.greatest(copies, F.lit(0)), F.lit(int(cap))).cast("long").alias("copies"),
            "converged",
            *(F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)),
        )
    )
