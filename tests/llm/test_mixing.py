"""Mixing: targets by hand, tilted rates, whole copies."""

import random

import pytest
from odd_rows import ODD, docs_of
from pyspark.sql import functions as F

from weekband.llm import mixing
from weekband.llm.common import word_count


def filled(sizes, weights, cap):
    """Targets by reshaping step by step, as the definition says."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        share = {s: left * weight[s] / total for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def corpus(spark, counts, seed=1):
    draw = random.Random(seed)
    rows, i = [], 0
    for source, (n, top) in counts.items():
        for _ in range(n):
            rows.append((i, source, draw.randint(0, top) if draw.random() < 0.9 else top))
            i += 1
    return rows, spark.createDataFrame(rows, "doc_id long, source string, size long")


def test_targets_rates_and_copies(spark):
    rows, docs = corpus(spark, {"b": (400, 300), "a": (30, 900), None: (200, 50), "é": (5, 20), "tiny": (3, 2), "": (100, 100)})
    mixed = mixing.mix(docs, "doc_id", "source", F.col("size")).collect()
    sizes = {}
    for _, s, z in rows:
        sizes[s] = sizes.get(s, 0) + z
    targets = filled(sizes, [1, 2, 3], 3.0)
    assert len(mixed) == len(rows)
    for s in sizes:
        own = [r for r in mixed if r["source"] == s]
        assert own[0]["target"] == pytest.approx(targets[s]) and own[0]["source_size"] == sizes[s]
        assert all(0 <= r["copies"] <= 3 for r in own)
        small = max(2, max(r["size"] for r in own) / 16)
        assert abs(sum(r["copies"] * r["size"] for r in own) - targets[s]) <= small


def reachable(sizes, cap, target):
    """Nearest sum of whole copies to the target, by all sums there are."""
    sums = 1
    for z in sizes:
        for _ in range(cap):
            sums |= sums << z
    return min(abs(i - target) for i in range(sums.bit_length()) if sums >> i & 1)


def test_small_sources_meet_their_targets(spark):
    draw = random.Random(9)
    rows = [(20 * s + i, f"s{s:02}", draw.randint(1, 900) if draw.random() < 0.8 else draw.randint(1, 30)) for s in range(12) for i in range(draw.randint(3, 14))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = {}
    for r in mixing.mix(docs, "doc_id", "source", F.col("size")).collect():
        assert 0 <= r["copies"] <= 3 and r["converged"]
        got.setdefault(r["source"], [r["target"], 0, []])
        got[r["source"]][1] += r["copies"] * r["size"]
        got[r["source"]][2].append(r["size"])
    for source, (target, taken, sizes) in got.items():
        assert abs(taken - target) <= reachable(sizes, 3, target) + 3, source


def test_rates_are_tilted_exponentially(spark):
    """The odds of a rate against its headroom are 1/2 times exp(multiplier * size), before rounding shifts them."""
    _, docs = corpus(spark, {"a": (300, 100), "b": (300, 100)}, 3)
    sizes = docs.groupBy(F.concat(F.lit("="), "source").alias("key"), "size").agg(F.count("*").alias("n"))
    targets = mixing.source_targets(sizes, [1, 3], 3.0)
    solved = mixing.balance(sizes, targets, 3.0, 1e-9, 80)
    rated = sizes.join(solved, "key").withColumn("rate", mixing.tilted_rate(F.col("multiplier"), F.col("size"), 3.0))
    got = rated.groupBy("key").agg(F.sum(F.col("rate") * F.col("n") * F.col("size")).alias("w"), F.first("target").alias("t"))
    for r in got.collect():
        assert r["w"] == pytest.approx(r["t"], rel=1e-6)


def test_same_copies_on_every_run(spark):
    _, docs = corpus(spark, {"a": (200, 40), "b": (100, 40)})
    first = sorted(map(tuple, mixing.mix(docs, "doc_id", "source", F.col("size")).collect()))
    again = sorted(map(tuple, mixing.mix(docs.repartition(7), "doc_id", "source", F.col("size")).collect()))
    assert first == again


def test_odd_rows(spark):
    docs = docs_of(spark, ODD)
    mixed = mixing.mix(docs, "doc_id", "source", word_count(F.col("text")), carry=("size", "n"))
    assert mixed.count() == len(ODD)
    assert mixing.mix(docs.limit(0), "doc_id", "source", word_count(F.col("text"))).count() == 0
    blank = mixing.mix(docs_of(spark, [(1, ""), (2, None)]), "doc_id", "source", word_count(F.col("text"))).collect()
    assert {(r["size"], r["target"], r["copies"] * r["size"]) for r in blank} == {(0, 0.0, 0)}


def test_hot_group_of_equal_sizes(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 15_000, "a").otherwise("b").alias("source"), F.lit(7).alias("size"))
    mixed = mixing.mix(docs, "doc_id", "source", F.col("size"))
    for r in mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("w"), F.first("target").alias("t")).collect():
        assert abs(r["w"] - r["t"]) <= 7
