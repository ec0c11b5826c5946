"""Benchmark and usage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def benchmark_report(runs: DataFrame, by: list[str], measure: str, cost: str, failed: Column, run_id: Column, version: str) -> DataFrame:
    """Per tier: runs, extremes and sum of a measure, least margin, failures with their ids, and distinct versions."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(failed, run_id))), lambda x: x.cast("string")), ",")
    versions = F.array_join(F.sort_array(F.collect_set(version)), ",")
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), F.max(measure).alias("max_measure"), F.min(measure).alias("min_measure"), F.sum(measure).alias("sum_measure"), F.min(F.col(cost)).alias("min_cost"), F.count_if(failed).alias("n_failed"), ids.alias("failed_ids"), versions.alias("versions"))


def usage_totals(rows: DataFrame, *columns: str) -> DataFrame:
    """Sums with nulls as zero, one row also for no rows."""
    return rows.agg(*(F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(f"total_{c}") for c in columns))


def segment_summary(segments: DataFrame, units: DataFrame, segment_id: str = "segment_id") -> DataFrame:
    """Per segment: candidates, units and ready proxies; segments without any are 'empty'."""
    counted = units.groupBy(segment_id).agg(F.count_distinct("candidate_id").alias("n_candidates"), F.count(F.lit(1)).alias("n_units"), F.count_if("proxy_ready").alias("n_ready"))
    out = segments.select(segment_id).join(counted, segment_id, "left").fillna(0, ["n_candidates", "n_units", "n_ready"])
    status = F.when(F.col("n_candidates") == 0, "empty").when(F.col("n_ready") == F.col("n_units"), "ready").when(F.col("n_ready") > 0, "partial").otherwise("pending")
    return out.withColumn("status", status)


def markdown_table(rows: DataFrame, most: int = 1000) -> str:
    """A report table of at most ``most`` rows, rendered on the driver."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " - |" * len(rows.columns)]
    for row in rows.limit(most).collect():
        lines.append("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in row) + " |")
    return "\n".join(lines) + "\n"
