"""The driver's tables as telemetry and inventory, so that every operator runs on them.

Each view has a SQL twin (a common table expression) with the same columns, for the oracles.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.columns import SEVERITIES
from marlstone.operators.rollups import hourly, log_counts, metric_rollup
from marlstone.sources.stored import Stored, stored

TENANT = "tenant-1"
_START = "2024-01-01 00:00:00"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    return _read(spark, sf_dir, "events").select(
        F.concat(F.lit("tenant-"), F.col("user_id") % 3).alias("tenant_id"), F.concat(F.lit("user-"), "user_id").alias("resource_id"),
        F.concat(F.lit("site-"), F.col("user_id") % 12).alias("site_id"), F.col("event_type").alias("metric"), at.alias("observed_at"),
        F.timestamp_micros(F.unix_micros(at) + (F.col("event_id") % 5) * 1_000_000).alias("ingested_at"), F.col("value"), F.lit("1").alias("unit"),
        F.create_map(F.lit("k"), k).alias("labels"),
    )


METRICS = (
    "m AS (SELECT 'tenant-' || (user_id % 3) AS tenant_id, 'user-' || user_id AS resource_id, 'site-' || (user_id % 12) AS site_id, event_type AS metric, "
    "ts AS observed_at, ts + to_seconds(event_id % 5) AS ingested_at, value, coalesce(json_extract_string(props, '$.k'), '') AS k, event_id FROM events)"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return _read(spark, sf_dir, "events").select(
        F.concat(F.lit("tenant-"), F.col("user_id") % 3).alias("tenant_id"), F.concat(F.lit("user-"), "user_id").alias("resource_id"),
        F.concat(F.lit("site-"), F.col("user_id") % 12).alias("site_id"), at.alias("observed_at"), at.alias("ingested_at"), F.lit("syslog").alias("source_kind"), F.lit("").alias("source_vendor"),
        F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.col("event_id") % 9 + 1).cast("int")).alias("severity"), F.substring("event_type", 1, 1).alias("event_category"), "event_type",
        F.col("props").alias("summary"), F.create_map(F.lit("host.name"), F.concat(F.lit("host-"), F.col("user_id") % 20)).alias("attributes"),
        F.concat(F.lit("host-"), F.col("user_id") % 20).alias("host_name"), F.lit("").alias("service_name"),
    )


EVENTS = (
    "e AS (SELECT 'tenant-' || (user_id % 3) AS tenant_id, 'user-' || user_id AS resource_id, ts AS observed_at, "
    f"[{', '.join(repr(s) for s in SEVERITIES)}][event_id % 9 + 1] AS severity, substr(event_type, 1, 1) AS event_category, event_type, props AS summary, "
    "'host-' || (user_id % 20) AS host_name FROM events)"
)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(F.unix_seconds(F.lit(_START).cast("timestamp")) + F.col("doc_id") % 40_000 * 60)
    return _read(spark, sf_dir, "documents").select(
        F.concat(F.lit("tenant-"), F.col("doc_id") % 3).alias("tenant_id"), F.concat(F.lit("user-"), F.col("doc_id") % 150).alias("resource_id"),
        F.concat(F.lit("site-"), F.col("doc_id") % 12).alias("site_id"), at.alias("observed_at"), F.timestamp_seconds(F.unix_seconds(at) + F.col("doc_id") % 7).alias("ingested_at"),
        F.lit("syslog").alias("source_kind"), F.lit("").alias("source_vendor"), F.element_at(F.array(*map(F.lit, SEVERITIES)), (F.col("doc_id") % 9 + 1).cast("int")).alias("severity"),
        (F.col("doc_id") % 24).cast("smallint").alias("facility"), F.col("text").alias("body"),
        F.create_map(F.lit("host.name"), F.col("source"), F.lit("service.name"), F.col("lang"), F.when(F.col("doc_id") % 4 == 0, F.lit("device.role")).otherwise(F.lit("device.kind")), (F.col("n_chars") % 10).cast("string")).alias("attributes"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("abc")).otherwise(F.lit("")).alias("trace_id"), F.lit("").alias("span_id"), F.col("source").alias("host_name"), F.col("lang").alias("service_name"),
        F.col("doc_id"),
    )


LOGS = (
    "l AS (SELECT doc_id, 'tenant-' || (doc_id % 3) AS tenant_id, 'user-' || (doc_id % 150) AS resource_id, 'site-' || (doc_id % 12) AS site_id, "
    f"TIMESTAMP '{_START}' + to_minutes(doc_id % 40000) AS observed_at, TIMESTAMP '{_START}' + to_minutes(doc_id % 40000) + to_seconds(doc_id % 7) AS ingested_at, "
    f"[{', '.join(repr(s) for s in SEVERITIES)}][doc_id % 9 + 1] AS severity, doc_id % 9 + 1 AS severity_ord, doc_id % 24 AS facility, text AS body, source AS host_name, lang AS service_name, "
    "CASE WHEN doc_id % 4 = 0 THEN (n_chars % 10)::VARCHAR ELSE '' END AS role, doc_id % 4 = 0 AS has_role, CASE WHEN doc_id % 2 = 0 THEN 'abc' ELSE '' END AS trace_id FROM documents)"
)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marlstone.operators.views import transitions

    orders = _read(spark, sf_dir, "orders").select(F.concat(F.lit("user-"), "o_custkey").alias("resource_id"), F.col("o_custkey"), F.col("o_orderdate").cast("timestamp").alias("observed_at"), "o_orderkey", F.col("o_orderstatus").alias("status"))
    return transitions(orders, "o_custkey", "status", ["observed_at", "o_orderkey"])


def state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitions in the stored shape."""
    k = F.col("o_custkey")
    severity = F.when(F.col("current_status") == "F", "critical").when(F.col("current_status") == "P", "warn").otherwise("info")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return states(spark, sf_dir).select(
        F.concat(F.lit("tenant-"), k % 3).alias("tenant_id"), "resource_id", F.concat(F.lit("site-"), k % 12).alias("site_id"), "observed_at", F.col("observed_at").alias("ingested_at"),
        severity.alias("severity"), "previous_status", "current_status", F.lit("").alias("reason"), none.alias("attributes"))


STATES = (
    "s0 AS (SELECT o_custkey, o_orderdate AS observed_at, o_orderstatus AS current_status, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_status FROM orders), "
    "s AS (SELECT 'tenant-' || (o_custkey % 3) AS tenant_id, 'user-' || o_custkey AS resource_id, observed_at, CASE current_status WHEN 'F' THEN 'critical' WHEN 'P' THEN 'warn' ELSE 'info' END AS severity, "
    "previous_status, current_status FROM s0 WHERE previous_status IS DISTINCT FROM current_status)"
)


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("up", "down", "degraded", "maintenance", "decommissioned"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    return _read(spark, sf_dir, "customer").select(
        F.concat(F.lit("tenant-"), F.col("c_custkey") % 3).alias("tenant_id"), F.concat(F.lit("user-"), "c_custkey").alias("resource_id"), F.lower("c_mktsegment").alias("kind"),
        F.concat(F.lit("site-"), "c_nationkey").alias("site_id"), status.alias("status"), F.col("c_name").alias("name"), F.col("c_name").alias("display_name"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("tags"), F.concat(F.lit("vendor-"), F.col("c_custkey") % 4).alias("vendor"),
    )


RESOURCES = (
    "r AS (SELECT 'tenant-' || (c_custkey % 3) AS tenant_id, 'user-' || c_custkey AS resource_id, lower(c_mktsegment) AS kind, 'site-' || c_nationkey AS site_id, "
    "['up', 'down', 'degraded', 'maintenance', 'decommissioned'][c_custkey % 5 + 1] AS status, c_name AS name, c_mktsegment AS segment, 'vendor-' || (c_custkey % 4) AS vendor, c_custkey FROM customer)"
)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers depend on nations, nations on regions, and a region on a nation: a tree with a cycle."""
    nation = _read(spark, sf_dir, "nation")
    up = nation.select(F.concat(F.lit("n-"), "n_nationkey").alias("source_id"), F.concat(F.lit("r-"), "n_regionkey").alias("target_id"))
    back = nation.where("n_nationkey = n_regionkey").select(F.concat(F.lit("r-"), "n_regionkey").alias("source_id"), F.concat(F.lit("n-"), "n_nationkey").alias("target_id"))
    own = _read(spark, sf_dir, "customer").select(F.concat(F.lit("user-"), "c_custkey").alias("source_id"), F.concat(F.lit("n-"), "c_nationkey").alias("target_id"))
    return up.unionByName(back).unionByName(own).select("source_id", "target_id", F.lit("depends_on").alias("kind"))


EDGES = (
    "g AS (SELECT 'n-' || n_nationkey AS source_id, 'r-' || n_regionkey AS target_id FROM nation UNION ALL "
    "SELECT 'r-' || n_regionkey, 'n-' || n_nationkey FROM nation WHERE n_nationkey = n_regionkey UNION ALL SELECT 'user-' || c_custkey, 'n-' || c_nationkey FROM customer)"
)


class Views(Mapping):
    """Telemetry tables by name, each built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        own = {"logs": logs, "metrics": metrics, "events": events, "states": state_rows}
        self._build = {n: (lambda f=f: f(spark, sf_dir)) for n, f in own.items()}
        self._build |= {"logs_counts_5m": lambda: log_counts(self["logs"]), "metrics_5m": lambda: metric_rollup(self["metrics"]), "metrics_1h": lambda: hourly(self["metrics_5m"])}

    def __getitem__(self, name: str) -> DataFrame:
        return self._build[name]()

    def __iter__(self):
        return iter(self._build)

    def __len__(self) -> int:
        return len(self._build)


def tables(spark: SparkSession, sf_dir: str) -> Views:
    return Views(spark, sf_dir)


def stored_tables(spark: SparkSession, sf_dir: str) -> Stored:
    """The same as they are stored: by tenant and day, sorted, with rollups; times to the millisecond."""
    own = {"logs": logs, "metrics": metrics, "events": events, "states": state_rows}
    return stored(spark, sf_dir, {n: (lambda f=f: f(spark, sf_dir)) for n, f in own.items()})
