"""Sharding: exact sizes, gapless slots, the law of the draws, repeated runs."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import TESTDATA
from odd_rows import ODD, docs_of
from pyspark.sql import functions as F

from weekband.llm import queries as q
from weekband.llm import sharding


def held(df):
    """Slots and rows by shard."""
    found = defaultdict(list)
    for r in df.collect():
        found[r["shard"]].append((r["slot"], r["row"]))
    return {k: sorted(v, key=lambda x: x[0]) for k, v in found.items()}


def test_exact_sizes_and_gapless_slots(spark):
    docs = spark.range(10_007).select(F.col("id").alias("doc_id"), F.lit("x").alias("shard"), F.lit(1).alias("slot")).repartition(5)
    got = held(sharding.shuffled(docs, 16))
    sizes = [len(got[k]) for k in range(16)]
    assert sizes == [626] * 7 + [625] * 9
    assert all([s for s, _ in v] == list(range(len(v))) for v in got.values())
    assert Counter(r["doc_id"] for v in got.values() for _, r in v) == Counter(range(10_007))
    assert set(got[0][0][1].asDict()) == {"doc_id", "shard", "slot"}


def test_same_rows_on_every_run_and_another_seed(spark):
    docs = spark.range(3000, numPartitions=6).select(F.col("id").alias("doc_id"))
    first, again, other = (held(sharding.shuffled(docs, 4, seed)) for seed in (3, 3, 4))
    assert first == again and first != other


def test_places_look_uniform(spark):
    """Where rows were in their cell, in which cell, and where they end up are independent."""
    docs = spark.range(60_000, numPartitions=6).select(F.col("id").alias("doc_id"))
    got = sharding.shuffled(docs, 8).select("row.doc_id", "shard", "slot").collect()
    seen = np.zeros((60, 8 * 5))
    for r in got:
        seen[r["doc_id"] // 1000, r["shard"] * 5 + r["slot"] // 1500] += 1
    chi = ((seen - 25) ** 2 / 25).sum()
    assert abs(chi - 59 * 39) < 5 * (2 * 59 * 39) ** 0.5  # chi-square of a table with fixed margins


def test_matrix_has_its_margins(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN_BITS", 2)  # a deeper tree
    cells = [(0, 5), (3, 7), (4, 1), (9, 12), (13, 25)]
    df = spark.createDataFrame(cells, "cell long, rows long")
    got = {r["cell"]: r["counts"] for r in sharding.communication_matrix(df, 4, 1).collect()}
    assert {c: sum(v) for c, v in got.items()} == dict(cells)
    assert np.array(list(got.values())).sum(axis=0).tolist() == [13, 13, 12, 12]


def test_law_of_the_deal():
    """Means and variances of the multivariate hypergeometric law."""
    rng, left = np.random.default_rng(1), np.array([13, 13, 12, 12])
    drawn = np.array([sharding.deal(rng, left, 12) for _ in range(4000)])
    assert (drawn.sum(axis=1) == 12).all()
    share = left / 50
    assert np.abs(drawn.mean(axis=0) - 12 * share).max() < 0.1
    assert np.abs(drawn.var(axis=0) - 12 * share * (1 - share) * 38 / 49).max() < 0.15


@pytest.mark.parametrize("good, bad, drawn", [(3, 5, 4), (500, 20, 60), (10, 0, 4), (0, 10, 4), (6, 6, 12), (6, 6, 0)])
def test_own_draws_have_the_law_of_numpy(monkeypatch, good, bad, drawn):
    monkeypatch.setattr(sharding, "NUMPY_POPULATION", 0)
    rng = np.random.default_rng(5)
    own = np.bincount([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(4000)], minlength=drawn + 1) / 4000
    other = np.bincount(rng.hypergeometric(good, bad, drawn, 40_000), minlength=drawn + 1) / 40_000
    assert np.abs(own - other).max() < 0.04


def test_large_population():
    rng = np.random.default_rng(2)
    draws = np.array([sharding.hypergeometric(rng, 3 * 10**10, 5 * 10**10, 10**6) for _ in range(300)])
    assert abs(draws.mean() - 375_000) < 5 * (234_375 / 300) ** 0.5 and 0.7 < draws.var() / 234_375 < 1.4


def test_odd_rows(spark):
    docs = docs_of(spark, ODD)
    got = held(sharding.shuffled(docs, 5))
    assert sorted(len(v) for v in got.values()) == sorted(len(ODD) // 5 + (i < len(ODD) % 5) for i in range(5))
    back = Counter((r["doc_id"], r["text"]) for v in got.values() for _, r in v)
    assert back == Counter(ODD)
    assert sharding.shuffled(docs.limit(0), 5).count() == 0
    assert sharding.shuffled(docs.limit(3), 7).count() == 3


def test_written_shards_read_back(spark, tmp_path):
    docs = docs_of(spark, [(i, f"text {i}") for i in range(500)])
    sharding.write_shards(docs, 4, str(tmp_path / "out"), seed=9)
    back = spark.read.parquet(str(tmp_path / "out"))
    expected = held(sharding.shuffled(docs, 4, seed=9))
    assert {k: [r["doc_id"] for _, r in v] for k, v in held(back).items()} == {k: [r["doc_id"] for _, r in v] for k, v in expected.items()}


@pytest.mark.skipif(not TESTDATA.exists(), reason="test tables are not here")
def test_query_columns(spark):
    folder = str(TESTDATA / "sf0.001")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = q.shards(spark, folder).collect()
    assert len(got) == len(texts)
    by = defaultdict(list)
    for r in got:
        own = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(own) + 1, zlib.crc32(own), "rows", None)
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
