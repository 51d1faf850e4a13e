"""Readers of the Parquet tables and the shared shapes derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a directory; extra columns are kept, callers select what they need."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def bounded(rows: DataFrame, bound: int, what: str) -> list:
    """All rows on the driver; more of them than ``bound`` are an error, never cut."""
    found = rows.limit(bound + 1).collect()
    if len(found) > bound:
        raise ValueError(f"{what} has more than {bound} rows")
    return found


def normalised_path(column) -> F.Column:
    """``\\`` becomes ``/`` and leading ``./`` go; null stays null."""
    return F.regexp_replace(F.translate(F.col(column) if isinstance(column, str) else column, "\\", "/"), r"^(\./)+", "")


def header_profiles(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, profile)`` once per header path; a path listed as both counts as ``c``."""
    headers = table(spark, directory, "header_languages")
    return headers.filter(F.col("path").isNotNull()).groupBy("path").agg(F.min("profile").alias("profile"))
