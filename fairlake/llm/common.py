"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlake.session import shared_dir

#: The ASCII white space that separates words, as a regular expression class.
BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, which cuts its lineage. ``rows_a_file``: at most so many, 0 for any number."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
