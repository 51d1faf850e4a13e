"""Shared plumbing: one Arrow pass per file, header languages joined to its small results rather than to the contents."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.lexing import EXTENSION_LANGUAGE
from factloom.plans.shipping import checkpointed
from factloom.sources.tables import header_profiles, table

#: Rows handled together inside a Python worker; bounds its memory when texts are long.
SLICE_ROWS = 256


def scan(frame: DataFrame, per_slice: Callable[[dict[str, list]], Iterable[tuple]], schema: str) -> DataFrame:
    """``mapInArrow`` with Python rows: ``per_slice`` gets a dict of column lists of at most SLICE_ROWS rows and yields output tuples."""
    target = frame.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # models and compiled patterns stay for good, and a file's tokens are freed by their counts: few searches for cycles are due
        gc.freeze()
        gc.set_threshold(50_000, 20, 100)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows = list(per_slice({name: part.column(k).to_pylist() for k, name in enumerate(part.schema.names)}))
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return frame.mapInArrow(run, target)


def managed_language(path: str | None) -> str | None:
    """``h`` for headers whose language the facts decide, the language for other managed files, ``None`` otherwise."""
    name = (path or "").rpartition("/")[2]
    extension = name.rpartition(".")[2] if "." in name else ""
    return "h" if extension == "h" else EXTENSION_LANGUAGE.get(extension)


def variants(path: str | None) -> tuple[str, ...]:
    """Languages under which a file is to be looked at: both for a header, because its fact is joined only afterwards."""
    language = managed_language(path)
    return () if language is None else ("c", "cpp") if language == "h" else (language,)


def managed_files(spark: SparkSession, directory: str, *more: str) -> DataFrame:
    """Deliveries of managed files with their contents, filtered at the scan; a file may still come more than once."""
    extensions = "|".join(["h", *EXTENSION_LANGUAGE])
    rows = table(spark, directory, "source_documents").select("file_id", "relative_path", "content", *more)
    return rows.filter(F.col("file_id").isNotNull() & F.col("relative_path").rlike(rf"\.({extensions})$"))


def keep_header_language(results: DataFrame, spark: SparkSession, directory: str) -> DataFrame:
    """Drop, of a header's two variants, the one that the header facts do not name (``c`` where they are silent)."""
    is_header = F.col("relative_path").endswith(".h")
    profiles = header_profiles(spark, directory).select(F.col("path").alias("_path"), F.col("profile").alias("_profile"))
    joined = results.join(profiles, F.when(is_header, F.col("relative_path")) == F.col("_path"), "left")
    return joined.filter(~is_header | (F.col("language") == F.when(F.col("_profile") == "cpp", "cpp").otherwise("c"))).drop("_path", "_profile")


def repository(column: str = "relative_path") -> F.Column:
    """First component of a path."""
    return F.substring_index(F.col(column), "/", 1)


__all__ = ["checkpointed", "keep_header_language", "managed_files", "managed_language", "repository", "scan", "variants"]
