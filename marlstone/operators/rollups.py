"""Pre-aggregates as mergeable partial rows, built in one pass and appended to.

Sums and counts add up, least and greatest merge, so late rows need no watermark: each batch appends its
partial rows, readers merge, and compaction replaces a bucket's rows by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import bucket

COUNT_KEYS = ("tenant_id", "resource_id", "severity", "bucket")
METRIC_KEYS = ("tenant_id", "resource_id", "metric", "bucket")


def log_counts(logs: DataFrame, seconds: int = 300) -> DataFrame:
    """Logs counted by resource, severity and bucket."""
    return logs.groupBy("tenant_id", "resource_id", "severity", bucket(F.col("observed_at"), seconds).alias("bucket")).agg(F.count(F.lit(1)).alias("cnt"))


def merge_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*COUNT_KEYS).agg(F.sum("cnt").alias("cnt"))


def metric_rollup(metrics: DataFrame, seconds: int = 300) -> DataFrame:
    """Least, greatest, sum and number of a metric's values by resource and bucket; labels are dropped."""
    return metrics.groupBy("tenant_id", "resource_id", "metric", bucket(F.col("observed_at"), seconds).alias("bucket")).agg(
        F.min("value").alias("min_v"), F.max("value").alias("max_v"), F.sum("value").alias("sum_v"), F.count("value").alias("cnt"))


def merge_metrics(parts: DataFrame, seconds: int | None = None) -> DataFrame:
    """Partial rows merged, into wider buckets if ``seconds`` is given: an hour's mean is weighted by counts."""
    at = bucket(F.col("bucket"), seconds) if seconds else F.col("bucket")
    return parts.groupBy("tenant_id", "resource_id", "metric", at.alias("bucket")).agg(
        F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v"), F.sum("sum_v").alias("sum_v"), F.sum("cnt").alias("cnt"))


def hourly(five_minutes: DataFrame) -> DataFrame:
    return merge_metrics(five_minutes, 3600)


#: Days that tables are kept.
RETENTION = {"logs": 365, "logs_counts_5m": 365, "metrics": 30, "metrics_5m": 365, "metrics_1h": 1095, "events": 365, "states": 1095}


def retained(df: DataFrame, table: str, now) -> DataFrame:
    """Rows of a table that are within its retention at ``now``."""
    at = F.col("bucket" if "bucket" in df.columns else "observed_at")
    floor = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(RETENTION[table]))
    kept = df.where(at >= floor)
    return kept.where(F.col("d") >= F.to_date(floor)) if "d" in df.columns else kept


def expired_days(df: DataFrame, table: str, now) -> DataFrame:
    """Day partitions of which every row is past the retention; dropping them drops no other row."""
    floor = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(RETENTION[table]))
    return df.select("d").distinct().where(F.col("d") < F.to_date(floor))
