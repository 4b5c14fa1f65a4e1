"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekband.session import materialize

__all__ = ["WORD", "doc_key", "materialize", "table", "word_count"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_key(doc_id: Column) -> Column:
    """Integer id for joins; NULL is the smallest number."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))
