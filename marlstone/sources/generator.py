"""A synthetic estate: logs and metrics of any size by arithmetic on a range, in the JVM.

Needle words occur at exact intervals, so searches have known answers.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.columns import millis

NEEDLES = {"needlecommon": 100, "needlemid": 10_000, "needlerare": 1_000_000, "needleultra": 100_000_000}
WHEEL = ("info", "info", "info", "notice", "info", "warn", "info", "info", "debug", "info", "error", "info", "notice", "critical")
BODIES = (
    "interface %d changed state to up", "interface %d changed state to down", "session %d opened for user admin", "session %d closed", "fan %d speed normal",
    "temperature sensor %d reads high", "neighbor %d lost", "neighbor %d found", "configuration changed from console %d", "route %d withdrawn",
)
VENDORS = ("cisco", "juniper", "arista", "mikrotik")
METRICS = ("cpu.utilization", "memory.usage", "network.io.receive", "network.io.transmit", "temperature")


def _u(i: Column, seed: int, name: str) -> Column:
    """A number from [0, 1) by hash."""
    return F.pmod(F.xxhash64(i, F.lit(seed), F.lit(name)), F.lit(1_000_000)) / F.lit(1_000_000.0)


def _pick(i: Column, of: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, of)), (F.pmod(i, F.lit(len(of))) + 1).cast("int"))


def logs(spark: SparkSession, rows: int, start: datetime, days: int = 7, tenants: int = 3, resources: int = 5000, seed: int = 42) -> DataFrame:
    """Log rows spread evenly over the days."""
    i = F.col("id")
    r = F.floor(_u(i, seed, "resource") * resources).cast("long")
    observed = F.timestamp_micros(F.lit(int(start.timestamp() * 1e6)) + F.floor(i * F.lit(days * 86_400_000_000.0 / max(rows, 1))).cast("long"))
    lag = F.when(_u(i, seed, "late") < 0.01, 1000 + _u(i, seed, "lag") * 9000).otherwise(_u(i, seed, "lag") * 900)
    body = F.element_at(F.array(*[F.format_string(b, F.pmod(i, F.lit(48)).cast("int")) for b in BODIES]), (F.floor(_u(i, seed, "body") * len(BODIES)) + 1).cast("int"))
    for word, every in NEEDLES.items():
        body = F.when(i % every == 0, F.concat(body, F.lit(f" {word}"))).otherwise(body)
    host = F.format_string("host-%05d", r)
    out = spark.range(rows).select(
        F.format_string("tenant-%d", i % tenants).alias("tenant_id"), F.format_string("resource-%05d", r).alias("resource_id"), F.format_string("site-%02d", r % 12).alias("site_id"),
        millis(observed).alias("observed_at"), F.timestamp_millis(F.unix_millis(observed) + lag.cast("long")).alias("ingested_at"), _pick(r, ("syslog", "syslog", "otlp")).alias("source_kind"),
        _pick(r, VENDORS).alias("source_vendor"), _pick(i, WHEEL).alias("severity"), (i % 24).cast("smallint").alias("facility"), body.alias("body"),
        F.create_map(F.lit("host.name"), host, F.lit("network.protocol.name"), _pick(i, ("tcp", "udp")), F.lit("service.name"), _pick(r, ("sshd", "snmpd", "bgpd"))).alias("attributes"),
        F.lit("").alias("trace_id"), F.lit("").alias("span_id"),
    )
    return out.withColumns({"host_name": F.col("attributes")["host.name"], "service_name": F.col("attributes")["service.name"]})


def metrics(spark: SparkSession, rows: int, start: datetime, days: int = 7, tenants: int = 3, resources: int = 5000, seed: int = 42) -> DataFrame:
    """Metric rows: a base for each resource, a slow ramp, and noise."""
    i = F.col("id")
    r = F.floor(_u(i, seed, "resource") * resources).cast("long")
    at = millis(F.timestamp_micros(F.lit(int(start.timestamp() * 1e6)) + F.floor(i * F.lit(days * 86_400_000_000.0 / max(rows, 1))).cast("long")))
    value = _u(r, seed, "base") * 100 + i / F.lit(float(max(rows, 1))) * 10 + _u(i, seed, "noise") * 5
    return spark.range(rows).select(
        F.format_string("tenant-%d", i % tenants).alias("tenant_id"), F.format_string("resource-%05d", r).alias("resource_id"), F.format_string("site-%02d", r % 12).alias("site_id"),
        _pick(i, METRICS).alias("metric"), at.alias("observed_at"), at.alias("ingested_at"), value.alias("value"), F.lit("1").alias("unit"),
        F.create_map(F.lit("interface"), F.format_string("Gi0/%d", i % 8), F.lit("host.name"), F.format_string("host-%05d", r)).alias("labels"),
    )
