"""Schemas of the telemetry tables, and how they are written and read.

Tables are Parquet by tenant and day, sorted within files by resource and time, so a tenant, a window and a
resource prune partitions and row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.columns import millis, ordered_map
from marlstone.operators.rollups import log_counts, metric_rollup

_COMMON = "tenant_id string, resource_id string, site_id string"
SCHEMAS = {
    "logs": f"{_COMMON}, observed_at timestamp, ingested_at timestamp, source_kind string, source_vendor string, severity string, facility smallint, body string, attributes map<string,string>, trace_id string, span_id string, host_name string, service_name string",
    "metrics": f"{_COMMON}, metric string, observed_at timestamp, ingested_at timestamp, value double, unit string, labels map<string,string>",
    "states": f"{_COMMON}, observed_at timestamp, ingested_at timestamp, severity string, previous_status string, current_status string, reason string, attributes map<string,string>",
    "events": f"{_COMMON}, observed_at timestamp, ingested_at timestamp, source_kind string, source_vendor string, severity string, event_category string, event_type string, summary string, attributes map<string,string>, host_name string, service_name string",
    "logs_counts_5m": "tenant_id string, resource_id string, severity string, bucket timestamp, cnt bigint",
    "metrics_5m": "tenant_id string, resource_id string, metric string, bucket timestamp, min_v double, max_v double, sum_v double, cnt bigint",
    # declared so that their rows have a shape; nothing is stored or queried yet
    "traces": f"{_COMMON}, trace_id string, span_id string, parent_span_id string, name string, started_at timestamp, duration_ns bigint, attributes map<string,string>",
    "flows": f"{_COMMON}, observed_at timestamp, source_address string, target_address string, source_port int, target_port int, bytes bigint, packets bigint",
}
SCHEMAS["metrics_1h"] = SCHEMAS["metrics_5m"]
TIME = {"logs_counts_5m": "bucket", "metrics_5m": "bucket", "metrics_1h": "bucket"}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Rows in a table's columns and types: times to milliseconds, maps in order, named columns from attributes."""
    out = df
    if table in ("logs", "events"):
        for name, key in (("host_name", "host.name"), ("service_name", "service.name")):
            if name not in out.columns:
                out = out.withColumn(name, F.coalesce(F.try_element_at("attributes", F.lit(key)), F.lit("")))
    cols = []
    for f in schema(table):
        c = F.col(f.name) if f.name in out.columns else F.lit(None)
        if isinstance(f.dataType, T.TimestampType):
            c = millis(c.cast("timestamp"))
        elif isinstance(f.dataType, T.MapType):
            c = ordered_map(c)
        cols.append(c.cast(f.dataType).alias(f.name))
    return out.select(*cols)


def write(df: DataFrame, path: str, table: str, mode: str = "append", within: str = "", parts: int = 16) -> None:
    """Append rows (to the folder ``within`` the table's). Rows are dealt by tenant, day and one of ``parts`` of the
    resources, so a day of a tenant is as many files, each written by one task."""
    at = F.col(TIME.get(table, "observed_at"))
    out = conform(df, table).withColumn("d", F.to_date(at))
    sort = [c for c in ("resource_id", "metric", "severity") if c in out.columns and (c != "severity" or table == "logs_counts_5m")]
    out = out.repartition("tenant_id", "d", F.pmod(F.xxhash64("resource_id"), F.lit(parts))).sortWithinPartitions("tenant_id", "d", *sort, TIME.get(table, "observed_at"))
    out.write.mode(mode).partitionBy("tenant_id", "d").parquet(f"{path}/{table}{within}")


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A written table, with its day as ``d``."""
    declared = T.StructType([*schema(table), T.StructField("d", T.DateType())])
    return spark.read.schema(declared).parquet(f"{path}/{table}")


def read_all(spark: SparkSession, path: str, names=("logs", "metrics", "states", "events", "logs_counts_5m", "metrics_5m", "metrics_1h")) -> dict[str, DataFrame]:
    return {n: read(spark, path, n) for n in names}


def with_rollups(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables with those pre-aggregates that are not stored, computed from the base tables."""
    from marlstone.operators.rollups import hourly

    out = dict(tables)
    if "logs" in out:
        out.setdefault("logs_counts_5m", log_counts(out["logs"]))
    if "metrics" in out:
        out.setdefault("metrics_5m", metric_rollup(out["metrics"]))
        out.setdefault("metrics_1h", hourly(out["metrics_5m"]))
    return out


def from_json_lines(df: DataFrame, table: str) -> DataFrame:
    """Rows of JSON texts (column value): both time forms are read; what isn't JSON is dropped and can be counted
    by :func:`unreadable`."""
    declared = schema(table)
    loose = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in declared])
    parsed = df.select(F.from_json("value", loose, {"mode": "PERMISSIVE"}).alias("r")).where("r.tenant_id IS NOT NULL").select("r.*")
    from marlstone.functions.columns import parse_instant

    return parsed.withColumns({f.name: parse_instant(F.col(f.name)) for f in declared if isinstance(f.dataType, T.TimestampType)})


def unreadable(df: DataFrame) -> DataFrame:
    return df.where(F.get_json_object("value", "$.tenant_id").isNull())


def to_json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON texts, times as they are stored."""
    from marlstone.functions.columns import instant_text

    cols = [instant_text(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*cols)).alias("value"))
