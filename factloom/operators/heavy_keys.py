"""Per-key results when a few keys hold most records (problem 2).

Rows are range-partitioned on (key, secondary order) with Spark's sampled quantiles, so a heavy key is spread over many partitions and each
partition holds a contiguous run of the order.  Every partition reduces its runs to partial states; only these, at most one per key and
partition, are shuffled again and stitched at their boundaries in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.tables import normalised_path, table

#: A key is heavy when it holds this part of the distinct findings.
HEAVY_NUMERATOR, HEAVY_DENOMINATOR = 4, 100
KEY_FIELDS = ("rule", "path")


def keyed_findings(spark: SparkSession, directory: str) -> DataFrame:
    """``(key_field, key_text, finding_id, reported_at)``: a row per finding delivery and key; null keys and ids have none."""
    findings = table(spark, directory, "findings").filter(F.col("finding_id").isNotNull())
    keys = F.array(F.struct(F.lit("rule").alias("key_field"), F.col("rule").alias("key_text")), F.struct(F.lit("path").alias("key_field"), normalised_path("path").alias("key_text")))
    return findings.select("finding_id", "reported_at", F.inline(keys)).filter(F.col("key_text").isNotNull()).select("key_field", "key_text", "finding_id", "reported_at")


def _ranged(spark: SparkSession, directory: str) -> DataFrame:
    """One row per key and finding, range-partitioned on the composite key; the de-duplication reuses that partitioning."""
    ranged = keyed_findings(spark, directory).repartitionByRange("key_field", "key_text", "finding_id")
    return ranged.groupBy("key_field", "key_text", "finding_id").agg(F.min("reported_at").alias("reported_at"))


def key_counts(spark: SparkSession, directory: str) -> DataFrame:
    """``(key_field, key_text, findings)``: distinct findings per rule and per normalised path."""
    return _ranged(spark, directory).groupBy("key_field", "key_text").agg(F.count(F.lit(1)).alias("findings"))


def heavy_keys(spark: SparkSession, directory: str) -> DataFrame:
    """``p2_found(key_field, key_text)``: values that hold at least 4 of 100 distinct findings; an empty table has none."""
    counts = key_counts(spark, directory)
    total = table(spark, directory, "findings").agg(F.countDistinct("finding_id").alias("total"))
    return (
        counts.join(F.broadcast(total), F.col("findings") * HEAVY_DENOMINATOR >= F.col("total") * HEAVY_NUMERATOR)
        .select("key_field", "key_text")
    )


def key_gaps(spark: SparkSession, directory: str) -> DataFrame:
    """``(key_field, key_text, findings, longest_gap_us)``: findings of a key in report order and the longest pause between neighbours.

    The order (reported_at, finding_id) crosses partitions for a heavy key: each partition yields first, last, count and longest inner gap,
    and stitching adds the gap between one partition's last and the next one's first.  Nulls in reported_at sort first and open no gap.
    """
    micros = F.unix_micros(F.col("reported_at").cast("timestamp"))
    once = keyed_findings(spark, directory).groupBy("key_field", "key_text", "finding_id").agg(F.min(micros).alias("at"))
    ranged = once.repartitionByRange("key_field", "key_text", "at", "finding_id").sortWithinPartitions("key_field", "key_text", "at", "finding_id")

    def partials(batches):
        import pandas as pd
        import pyarrow as pa

        state: dict[tuple, list] = {}
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for batch in batches:
            pdf = batch.select(["key_field", "key_text", "at"]).to_pandas()
            for key, own in pdf.groupby(["key_field", "key_text"], sort=False)["at"]:
                at = own.dropna().astype("int64")
                known = state.setdefault(key, [None, None, 0, 0])
                known[2] += len(own)
                if len(at):
                    inner = at.diff().max()
                    gaps = [known[3], 0 if pd.isna(inner) else int(inner)] + ([int(at.iloc[0]) - known[1]] if known[1] is not None else [])
                    known[0] = int(at.iloc[0]) if known[0] is None else known[0]
                    known[1], known[3] = int(at.iloc[-1]), max(gaps)
            # keys come in order: all but the last seen are complete
            done = list(state)[:-1]
            if done:
                rows = [(*k, part, *state.pop(k)) for k in done]
                yield pa.RecordBatch.from_arrays([pa.array(c) if n < 2 else pa.array(c, pa.int64()) for n, c in enumerate(zip(*rows))], names=_PARTIAL)
        if state:
            rows = [(*k, part, *v) for k, v in state.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) if n < 2 else pa.array(c, pa.int64()) for n, c in enumerate(zip(*rows))], names=_PARTIAL)

    states = ranged.mapInArrow(partials, "key_field string, key_text string, part bigint, first bigint, last bigint, n bigint, gap bigint")
    order = Window.partitionBy("key_field", "key_text").orderBy("part")
    before = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    stitched = states.withColumn("gap", F.greatest("gap", F.coalesce(F.col("first") - before, F.lit(0))))
    return stitched.groupBy("key_field", "key_text").agg(F.sum("n").alias("findings"), F.max("gap").alias("longest_gap_us"))


_PARTIAL = ["key_field", "key_text", "part", "first", "last", "n", "gap"]

ORACLE = {
    "p2_found": r"""
WITH f AS (SELECT finding_id, rule, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path FROM findings WHERE finding_id IS NOT NULL),
k AS (SELECT 'rule' AS key_field, rule AS key_text, finding_id FROM f UNION ALL SELECT 'path', path, finding_id FROM f)
SELECT key_field, key_text FROM k WHERE key_text IS NOT NULL GROUP BY 1, 2
HAVING count(DISTINCT finding_id) * 100 >= 4 * (SELECT count(DISTINCT finding_id) FROM f)""",
    "p2_key_counts": r"""
WITH f AS (SELECT finding_id, rule, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path FROM findings WHERE finding_id IS NOT NULL),
k AS (SELECT 'rule' AS key_field, rule AS key_text, finding_id FROM f UNION ALL SELECT 'path', path, finding_id FROM f)
SELECT key_field, key_text, count(DISTINCT finding_id)::BIGINT AS findings FROM k WHERE key_text IS NOT NULL GROUP BY 1, 2""",
    "p2_key_gaps": r"""
WITH f AS (SELECT finding_id, rule, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path, reported_at FROM findings WHERE finding_id IS NOT NULL),
k AS (SELECT 'rule' AS key_field, rule AS key_text, finding_id, reported_at FROM f UNION ALL SELECT 'path', path, finding_id, reported_at FROM f),
o AS (SELECT key_field, key_text, finding_id, min(epoch_us(reported_at)) AS t FROM k WHERE key_text IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT *, t - lag(t) OVER (PARTITION BY key_field, key_text ORDER BY t, finding_id) AS gap FROM o)
SELECT key_field, key_text, count(*)::BIGINT AS findings, coalesce(max(gap), 0)::BIGINT AS longest_gap_us FROM g GROUP BY 1, 2""",
}

QUERIES = {"p2_found": heavy_keys, "p2_key_counts": key_counts, "p2_key_gaps": key_gaps}
