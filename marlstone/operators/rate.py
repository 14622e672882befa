"""Rates of counters.

A rate is the step from the sample before in the same series, where both time and value go forward; any other
step, a wrap or a reset as much as the first sample, has none.  Filters are applied before, so they decide
which samples are next to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.columns import label_key

SERIES = ("tenant_id", "resource_id", "metric")


def _series(df: DataFrame) -> tuple[DataFrame, Window]:
    keyed = df.withColumn("_labels", label_key(F.col("labels"))) if "labels" in df.columns else df.withColumn("_labels", F.lit(0))
    ties = [c for c in ("ingested_at",) if c in df.columns]
    return keyed, Window.partitionBy(*[c for c in SERIES if c in df.columns], "_labels").orderBy("observed_at", *ties, "value")


def with_rate(df: DataFrame) -> DataFrame:
    """``df`` with ``rate`` per second, null where there is none."""
    keyed, series = _series(df)
    before, at = F.lag("value").over(series), F.lag("observed_at").over(series)
    lagged = keyed.withColumns({"_before": before, "_at": at})
    return lagged.withColumn("rate", step(F.col("_before"), F.col("_at"), F.col("value"), F.col("observed_at"))).drop("_before", "_at", "_labels")


def step(before: Column, at: Column, value: Column, now: Column) -> Column:
    elapsed = (F.unix_millis(now) - F.unix_millis(at)) / F.lit(1000.0)
    return F.when((now > at) & (value >= before) & (elapsed > 0), (value - before) / elapsed)


def with_delta(df: DataFrame, modulus: float = 2.0**32, interval_seconds: float = 60.0) -> DataFrame:
    """``df`` with ``delta``: first, rate, wrapped, reset or no_time, and ``rate`` where it is a rate.

    A step back is a wrap if the counter could have passed its width within two intervals, else a reset;
    neither has a rate.
    """
    keyed, series = _series(df)
    lagged = keyed.withColumns({"_before": F.lag("value").over(series), "_at": F.lag("observed_at").over(series)})
    elapsed = (F.unix_millis("observed_at") - F.unix_millis("_at")) / F.lit(1000.0)
    back = F.col("value") < F.col("_before")
    within = (elapsed <= F.lit(2.0 * interval_seconds)) & (F.col("_before") < F.lit(modulus))
    delta = (
        F.when(F.col("_at").isNull(), "first").when(elapsed <= 0, "no_time").when(~back, "rate")
        .when(within, "wrapped").otherwise("reset")
    )
    return lagged.withColumns({
        "delta": delta, "rate": step(F.col("_before"), F.col("_at"), F.col("value"), F.col("observed_at")),
    }).drop("_before", "_at", "_labels")
