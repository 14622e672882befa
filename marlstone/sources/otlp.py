"""OpenTelemetry in its JSON form: logs and metrics as rows, traces counted."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.columns import NIL

MAP = "map<string,string>"


def flatten(value) -> str:
    """An attribute value as text: lists as [a,b], maps as {k=v}, bytes as hex."""
    if not isinstance(value, dict) or not value:
        return ""
    kind, v = next(iter(value.items()))
    if kind == "boolValue":
        return "true" if v in (True, "true") else "false"
    if kind == "doubleValue":
        return repr(float(v)).removesuffix(".0")
    if kind == "bytesValue":
        import base64

        return base64.b64decode(v or "").hex()
    if kind == "arrayValue":
        return "[" + ",".join(map(flatten, (v or {}).get("values", []))) + "]"
    if kind == "kvlistValue":
        return "{" + ",".join(f"{e.get('key', '')}={flatten(e.get('value'))}" for e in (v or {}).get("values", [])) + "}"
    return "" if v is None else str(v)


def flat_value(value: Column) -> Column:
    """A JSON attribute value as text. Values nest without bound, so not by expressions."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else flatten(json.loads(v)) for v in values], dtype=object)

    return run(value)


def flat_attributes(pairs: Column) -> Column:
    """A JSON list of keys and values as an ordered map."""

    @F.pandas_udf(MAP)
    def run(lists: pd.Series) -> pd.Series:
        out = []
        for text in lists:
            own = json.loads(text) if text else []
            out.append(dict(sorted((e["key"], flatten(e.get("value"))) for e in own if e.get("key"))))
        return pd.Series(out, dtype=object)

    return run(pairs)


def overlay(below: Column, above: Column) -> Column:
    """Two maps as one; the second's values win."""
    kept = F.map_filter(below, lambda k, _: ~F.map_contains_key(above, k))
    return F.map_concat(kept, above)


def severity(number: Column) -> Column:
    """A severity number as a name; what is out of range is info."""
    return (
        F.when(number.between(1, 4), "trace").when(number.between(5, 8), "debug").when(number.between(13, 16), "warn").when(number.between(17, 20), "error")
        .when(number == 21, "critical").when(number == 22, "alert").when(number.between(23, 24), "emergency").otherwise("info")
    )


def instant(nanos: Column) -> Column:
    """Nanoseconds since the epoch as a time; 0 is none."""
    n = nanos.try_cast("long")
    return F.when(n > 0, F.timestamp_micros(F.floor(n / 1000).cast("long")))


def hex_id(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _entries(df: DataFrame, payload: str, top: str, scope: str, leaf: str) -> DataFrame:
    """(resource attributes as JSON, entry as JSON) of all scopes of all resources."""
    arr = "array<string>"
    outer = df.withColumn("_res", F.explode(F.from_json(F.get_json_object(payload, f"$.{top}"), arr)))
    own = outer.withColumn("_attributes", F.get_json_object("_res", "$.resource.attributes"))
    inner = own.withColumn("_scope", F.explode(F.from_json(F.get_json_object("_res", f"$.{scope}"), arr)))
    return inner.withColumn("_entry", F.explode(F.from_json(F.get_json_object("_scope", f"$.{leaf}"), arr))).drop("_res", "_scope")


def log_rows(requests: DataFrame, payload: str = "payload", received_at: str = "received_at") -> DataFrame:
    """Log rows of export requests (JSON texts): record attributes over those of the resource; a missing time is
    the observed one, else that of receipt, which is marked."""
    e = _entries(requests, payload, "resourceLogs", "scopeLogs", "logRecords")
    get = lambda p: F.get_json_object("_entry", f"$.{p}")
    at = F.coalesce(instant(get("timeUnixNano")), instant(get("observedTimeUnixNano")))
    missing = F.when(at.isNull(), F.create_map(F.lit("otlp.timestamp.missing"), F.lit("true"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    e = e.withColumns({"_below": flat_attributes(F.col("_attributes")), "_above": flat_attributes(get("attributes"))})
    attributes = overlay(overlay(F.col("_below"), F.col("_above")), missing)
    return e.select(
        *_given(requests), F.coalesce(at, F.col(received_at)).alias("observed_at"), F.col(received_at).alias("ingested_at"), F.lit("otlp").alias("source_kind"),
        F.lit("").alias("source_vendor"), severity(F.coalesce(get("severityNumber").try_cast("int"), F.lit(0))).alias("severity"), F.lit(1).cast("smallint").alias("facility"),
        F.coalesce(flat_value(get("body")), F.lit("")).alias("body"), attributes.alias("attributes"), hex_id(get("traceId")).alias("trace_id"), hex_id(get("spanId")).alias("span_id"),
    )


def _given(df: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c), F.lit(NIL)).alias(c) if c in df.columns else F.lit(NIL).alias(c) for c in ("tenant_id", "resource_id", "site_id")]


def metric_rows(requests: DataFrame, payload: str = "payload", received_at: str = "received_at") -> DataFrame:
    """Metric rows of gauges and sums; whether a sum only grows is a label."""
    e = _entries(requests, payload, "resourceMetrics", "scopeMetrics", "metrics")
    arr = "array<string>"
    get = lambda p: F.get_json_object("_entry", f"$.{p}")
    points = F.coalesce(F.from_json(get("gauge.dataPoints"), arr), F.from_json(get("sum.dataPoints"), arr))
    p = e.withColumn("_point", F.explode(points))
    at = lambda x: F.get_json_object("_point", f"$.{x}")
    mono = F.when(get("sum").isNotNull(), F.create_map(F.lit("otlp.monotonic"), F.coalesce(get("sum.isMonotonic"), F.lit("false")))).otherwise(
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    p = p.withColumns({"_below": flat_attributes(F.col("_attributes")), "_above": flat_attributes(at("attributes"))})
    labels = overlay(overlay(F.col("_below"), F.col("_above")), mono)
    value = F.coalesce(at("asDouble").try_cast("double"), at("asInt").try_cast("double"))
    return p.where(value.isNotNull()).select(
        *_given(requests), get("name").alias("metric"), F.coalesce(instant(at("timeUnixNano")), F.col(received_at)).alias("observed_at"), F.col(received_at).alias("ingested_at"),
        value.alias("value"), F.coalesce(get("unit"), F.lit("")).alias("unit"), labels.alias("labels"),
    )


def unsupported_metrics(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """(kind, n) of metrics that have no rows: histograms and summaries."""
    e = _entries(requests, payload, "resourceMetrics", "scopeMetrics", "metrics")
    kind = F.when(F.get_json_object("_entry", "$.histogram").isNotNull(), "histogram").when(
        F.get_json_object("_entry", "$.exponentialHistogram").isNotNull(), "exponential_histogram").when(F.get_json_object("_entry", "$.summary").isNotNull(), "summary")
    return e.select(kind.alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def rejected_spans(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """(n): spans of trace requests, none of which is stored."""
    return _entries(requests, payload, "resourceSpans", "scopeSpans", "spans").agg(F.count(F.lit(1)).alias("n"))


def identifiers(attributes: Column) -> Column:
    """Observed identifiers of resource attributes, as an array of (kind, value); names in lower case."""
    own = F.array(*[F.struct(F.lit(kind).alias("kind"), v.alias("value")) for kind, v in (
        ("otel_host_id", F.try_element_at(attributes, F.lit("host.id"))), ("hostname", F.lower(F.try_element_at(attributes, F.lit("host.name")))),
        ("service_name", F.try_element_at(attributes, F.lit("service.name"))))])
    return F.filter(own, lambda x: F.coalesce(x["value"], F.lit("")) != "")
