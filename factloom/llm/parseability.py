"""Source files that do not parse (problem 1).

Each delivery is lexed and reduced by a pushdown stack in one Arrow pass (:mod:`factloom.functions.grammar`); contents are never
shuffled, only the verdicts are.  Null contents are not judged, empty files are valid, a file delivered repeatedly counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.grammar import syntax_problem
from factloom.llm.common import keep_header_language, managed_files, repository, scan, variants

_SCHEMA = "file_id bigint, relative_path string, language string, reason string"


def _judge(columns: dict[str, list]):
    for file_id, path, content in zip(columns["file_id"], columns["relative_path"], columns["content"]):
        for language in variants(path):
            yield file_id, path, language, syntax_problem(content, language)


def judged_files(spark: SparkSession, directory: str, only_damaged: bool = False) -> DataFrame:
    """``(file_id, relative_path, language, reason)`` of each managed file; reason is null for a valid file."""
    verdicts = scan(managed_files(spark, directory), _judge, _SCHEMA)
    if only_damaged:
        verdicts = verdicts.filter(F.col("reason").isNotNull())
    kept = keep_header_language(verdicts, spark, directory)
    return kept.groupBy("file_id").agg(F.min("relative_path").alias("relative_path"), F.min("language").alias("language"), F.min("reason").alias("reason"))


def found(spark: SparkSession, directory: str) -> DataFrame:
    """``p1_found(file_id)``."""
    return judged_files(spark, directory, only_damaged=True).select("file_id")


def reasons(spark: SparkSession, directory: str) -> DataFrame:
    """Damaged files with the reason of the verdict."""
    return judged_files(spark, directory, only_damaged=True)


def rates(spark: SparkSession, directory: str) -> DataFrame:
    """Files, damaged files and their rate per repository and language."""
    return (
        judged_files(spark, directory)
        .groupBy(repository().alias("repo"), "language")
        .agg(F.count(F.lit(1)).alias("files"), F.count("reason").alias("damaged"))
        .withColumn("rate", F.round(F.col("damaged") / F.col("files"), 6))
    )
