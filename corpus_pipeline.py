"""The corpus pipeline: stages that run one after the other, each on all that the one before it kept.

Defined results: NULL, empty and blank texts have no words, so the quality rules reject them; very long texts are judged
whole. Repeated rows are near duplicates of each other, and one stays, that with the smallest id; a NULL id gives
way to any other.
Columns of `documents` that no stage reads are carried along to the mixture, whatever their names. An empty
table passes through all stages and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekband.llm import contamination, mixing, near_dup, quality, token_files
from weekband.llm.common import materialize, table, word_count


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the voting rules find good."""
    return quality.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id."""
    return near_dup.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return contamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix of sources takes."""
    rows = docs.withColumn("_row", F.struct(*docs.columns))
    mixed = mixing.mix(rows, "doc_id", "source", word_count(F.col("text")), carry=("_row",))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").select("_row", copies).select("_row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents written to token files; their places and checksums as read back."""
    import public_tokenizers

    return token_files.write_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token output", token_output),
]

#: Several stages (Order MinHash, Newton steps, a tokenizer) cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
