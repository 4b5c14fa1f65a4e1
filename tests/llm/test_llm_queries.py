"""The queries against their SQL twins, labels and the tables, and the pipeline."""

import glob
import os
import zlib

import duckdb
import pytest
from conftest import TESTDATA, rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from weekband.llm import queries as q

SMALL, MEDIUM = str(TESTDATA / "sf0.001"), str(TESTDATA / "sf0.01")

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="test tables are not here")


def test_all_operators_are_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert set(q.ORACLE) <= set(q.QUERIES) <= set(names)


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{MEDIUM}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cursor = con.execute(q.ORACLE[name])
    columns = [c[0] for c in cursor.description]
    expected = sorted(cursor.fetchall(), key=str)
    df = q.QUERIES[name](spark, MEDIUM)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == expected


def test_held_out_languages(spark):
    found = q.language_id(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [r for r in found.collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found.collect())
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.97


def test_quality_agrees_with_labels(spark):
    """Labels are not used by the operator; apart from the base rules nearly all agree."""
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    got = q.quality_rules(spark, MEDIUM).join(labels, "doc_id").where("NOT base_failed")
    right, agree, n = got.agg(
        F.avg((F.col("kept") == (F.col("quality") >= 0.5)).cast("double")),
        F.avg((F.col("kept").cast("int") == F.col("label")).cast("double")),
        F.count("*"),
    ).first()
    assert n > 100 and right == 1.0 and agree >= 0.97


def test_path_of_the_twin_of_url_filters(spark):
    """A url in the query or fragment of another one is no path, in the operator and in its SQL."""
    urls = ["https://example.net?u=https://b.com/en/x", "http://a.org#b://c/fr/", "http://A.example.NET/en/?q", "x", None, "a://b"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if u is None else repr(u)})" for i, u in enumerate(urls)) + ") t(page_id, url)")
    expected = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({q.ORACLE['op7_url_filters']}) ORDER BY 1").fetchall()
    rules = spark.createDataFrame(q.RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    assert rows(q.urls.judge(pages, rules), "page_id", "host", "path", "rule", "verdict") == expected
    assert expected[0][1:3] == ("example.net", "") and expected[1][1:3] == ("a.org", "")


def test_pipeline_stages_follow_from_one_another(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL))
        assert docs.columns == columns, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids and ids <= before, name
        before = ids
    copies = docs.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert 1 <= copies <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert last.count() == docs.count() and last.agg(F.min("start")).first()[0] == 0
    again = rows(corpus_pipeline.run(spark, SMALL))
    assert again == rows(last)
