"""Registered queries of the telemetry engine and their SQL twins, on the driver's tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import columns as fx
from marlstone.operators import alerts, identity, inventory, maintenance, rollups, topology, views
from marlstone.operators.lower import Engine
from marlstone.operators.rate import with_delta
from marlstone.operators.resolve import Catalog, canonical_ids
from marlstone.plans.ast import Field, Query
from marlstone.plans.scope import TenantScope
from marlstone.sources import adapters as ad
from marlstone.sources import otlp, polling, syslog
from marlstone.sources.registry_files import Pattern, subject

SCOPE = TenantScope(ad.TENANT)
MONTH = {"start": "2024-01-01T00:00:00Z", "end": "2024-01-31T00:00:00Z"}
DAY = {"start": "2024-01-05T00:00:00Z", "end": "2024-01-06T00:00:00Z"}
SIX_HOURS = {"start": "2024-01-05T00:00:00Z", "end": "2024-01-05T06:00:00Z"}
YEAR = {"start": "2023-06-01T00:00:00Z", "end": "2024-06-01T00:00:00Z"}
IN_MONTH = "tenant_id = 'tenant-1' AND observed_at >= TIMESTAMP '2024-01-01' AND observed_at < TIMESTAMP '2024-01-31'"
IN_DAY = "tenant_id = 'tenant-1' AND observed_at >= TIMESTAMP '2024-01-05' AND observed_at < TIMESTAMP '2024-01-06'"
IN_SIX = "tenant_id = 'tenant-1' AND observed_at >= TIMESTAMP '2024-01-05' AND observed_at < TIMESTAMP '2024-01-05 06:00:00'"

QUERIES: dict[str, tuple] = {}


def naive(df: DataFrame) -> DataFrame:
    """Times without a zone, as the oracle has them; doubles to six places."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType)
        else F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def register(name: str, sql: str | None):
    def add(run):
        QUERIES[name] = (lambda spark, sf_dir: naive(run(spark, sf_dir)), sql)
        return run

    return add


def engine_of(spark: SparkSession, sf_dir: str, signal: str = "log", raw: bool = False) -> Engine:
    """Queries read the stored tables; raw rows of metrics and events, which have finer times than are stored, the views."""
    return Engine(ad.tables(spark, sf_dir) if raw and signal != "log" else ad.stored_tables(spark, sf_dir))


def ask(name: str, sql: str | None, keep: tuple[str, ...] = (), **query) -> None:
    """Register a query in its JSON form; ``keep`` are the columns of raw rows that are compared."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        needs = query.get("resources", {}).get("type", "all") not in ("all", "ids")
        catalog = Catalog(ad.resources(spark, sf_dir)) if needs else None
        engine = engine_of(spark, sf_dir, query["signal"], bool(keep))
        engine.catalog = catalog
        out = engine.query(query, SCOPE).df
        return out.select(*keep) if keep else out

    QUERIES[name] = (lambda spark, sf_dir: naive(run(spark, sf_dir)), sql)


def _f(name, **more):
    return {"field": name, **more}


def _cmp(field, cmp, value):
    return {"op": "compare", "field": field if isinstance(field, dict) else _f(field), "cmp": cmp, "value": value}


def _text(mode, *terms):
    return {"op": "text", "field": _f("body"), "mode": mode, "terms": list(terms)}


def _agg(func, alias, field=None):
    return {"func": func, "alias": alias, "field": field and _f(field)}


COUNT = [_agg("count", "c")]
B300 = _f("time_bucket", seconds=300)
_B = "make_timestamp((epoch_us({0}) // {1}000000) * {1}000000)".format

# --- logs: routing, filters, text, groups, order ---
ask("log_histogram", f"WITH {ad.LOGS} SELECT {_B('observed_at', 300)} AS g0, severity AS g1, count(*) AS c FROM l WHERE {IN_MONTH} GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 10000",
    signal="log", time=MONTH, aggregations=COUNT, group_by=[B300, _f("severity")], limit=10000)
ask("log_histogram_base", f"WITH {ad.LOGS} SELECT {_B('observed_at', 450)} AS g0, host_name AS g1, count(*) AS c FROM l WHERE {IN_MONTH} GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 10000",
    signal="log", time=MONTH, aggregations=COUNT, group_by=[_f("time_bucket", seconds=450), _f("attr", key="host.name")], limit=10000)
ask("log_rows_recent", f"WITH {ad.LOGS} SELECT resource_id, observed_at, severity, body FROM l WHERE {IN_MONTH} ORDER BY resource_id, observed_at DESC LIMIT 200",
    keep=("resource_id", "observed_at", "severity", "body"), signal="log", time=MONTH, limit=200)
ask("log_rows_page", f"WITH {ad.LOGS} SELECT resource_id, observed_at, facility::SMALLINT AS facility FROM l WHERE {IN_MONTH} ORDER BY observed_at, resource_id LIMIT 50 OFFSET 25",
    keep=("resource_id", "observed_at", "facility"), signal="log", time=MONTH, limit=50, offset=25, order_by=[{"key": {"by": "field", "field": _f("observed_at")}}])
for _op, _sign in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    ask(f"log_severity_{_op}", f"WITH {ad.LOGS} SELECT severity AS g0, count(*) AS c FROM l WHERE {IN_MONTH} AND severity_ord {_sign} 5 AND facility {_sign} 7 GROUP BY 1",
        signal="log", time=MONTH, filter={"op": "and", "of": [_cmp("severity", _op, "warn"), _cmp("facility", _op, 7)]}, aggregations=COUNT, group_by=[_f("severity")])
ask("log_in_not_exists", f"WITH {ad.LOGS} SELECT resource_id AS g0, count(*) AS c FROM l WHERE {IN_MONTH} AND severity IN ('critical', 'alert', 'emergency') AND NOT trace_id <> '' GROUP BY 1",
    signal="log", time=MONTH, filter={"op": "and", "of": [_cmp("severity", "in", ["critical", "alert", "emergency"]), {"op": "not", "of": {"op": "exists", "field": _f("trace_id")}}]},
    aggregations=COUNT, group_by=[_f("resource_id")], limit=10000)
ask("log_or_not_in", f"WITH {ad.LOGS} SELECT service_name AS g0, count(*) AS c FROM l WHERE {IN_MONTH} AND (host_name NOT IN ('src1', 'src2') OR severity = 'error') GROUP BY 1",
    signal="log", time=MONTH, filter={"op": "or", "of": [_cmp(_f("attr", key="host.name"), "not_in", ["src1", "src2"]), _cmp("severity", "eq", "error")]}, aggregations=COUNT, group_by=[_f("attr", key="service.name")])
_TOK = r"regexp_extract_all(body, '[\p{L}\p{N}]+')"
ask("log_any_token", f"WITH {ad.LOGS} SELECT count(*) AS c FROM l WHERE {IN_MONTH} AND list_has_any({_TOK}, ['stupid', 'License'])",
    signal="log", time=MONTH, filter=_text("any_token", "stupid", "License"), aggregations=COUNT)
ask("log_all_token", f"WITH {ad.LOGS} SELECT count(*) AS c FROM l WHERE {IN_MONTH} AND list_has_all({_TOK}, ['the', 'License'])",
    signal="log", time=MONTH, filter=_text("all_token", "the", "License"), aggregations=COUNT)
ask("log_substring", f"WITH {ad.LOGS} SELECT host_name AS g0, count(*) AS c FROM l WHERE {IN_MONTH} AND contains(lower(body), 'icensed un') GROUP BY 1",
    signal="log", time=MONTH, filter=_text("substring", "ICENSED", "un"), aggregations=COUNT, group_by=[_f("attr", key="host.name")])
ask("log_phrase", f"WITH {ad.LOGS} SELECT count(*) AS c FROM l WHERE {IN_MONTH} AND contains(lower(body), 'under the mit') AND list_has_all({_TOK}, ['under', 'the', 'MIT'])",
    signal="log", time=MONTH, filter=_text("phrase", "under", "the", "MIT"), aggregations=COUNT)
ask("log_group_attribute", f"WITH {ad.LOGS} SELECT role AS g0, count(*) AS c FROM l WHERE {IN_MONTH} GROUP BY 1 ORDER BY c DESC, 1 LIMIT 20",
    signal="log", time=MONTH, aggregations=COUNT, group_by=[_f("attr", key="device.role")], order_by=[{"key": {"by": "alias", "alias": "c"}, "desc": True}], limit=20)
ask("log_exists_attribute", f"WITH {ad.LOGS} SELECT count(*) AS c, count(DISTINCT resource_id) AS d FROM l WHERE {IN_MONTH} AND has_role",
    signal="log", time=MONTH, filter={"op": "exists", "field": _f("attr", key="device.role")}, aggregations=[*COUNT, _agg("count_distinct", "d", "resource_id")])
ask("log_nothing_matched", f"WITH {ad.LOGS} SELECT severity AS g0, count(*) AS c FROM l WHERE false GROUP BY 1",
    signal="log", time=MONTH, resources={"type": "ids", "ids": []}, filter=_cmp("facility", "gte", 0), aggregations=COUNT, group_by=[_f("severity")])
ask("log_by_kind", f"WITH {ad.LOGS}, {ad.RESOURCES} SELECT count(*) AS c FROM l WHERE {IN_MONTH} AND resource_id IN (SELECT resource_id FROM r WHERE kind = 'building' AND tenant_id = 'tenant-1') AND facility >= 0",
    signal="log", time=MONTH, resources={"type": "kind", "kind": "building"}, filter=_cmp("facility", "gte", 0), aggregations=COUNT)
ask("log_by_site", f"WITH {ad.LOGS}, {ad.RESOURCES} SELECT count(*) AS c FROM l WHERE {IN_MONTH} AND resource_id IN (SELECT resource_id FROM r WHERE site_id = 'site-7' AND tenant_id = 'tenant-1') AND facility >= 0",
    signal="log", time=MONTH, resources={"type": "site", "site": "site-7"}, filter=_cmp("facility", "gte", 0), aggregations=COUNT)
ask("log_by_tag", f"WITH {ad.LOGS}, {ad.RESOURCES} SELECT count(*) AS c FROM l WHERE {IN_MONTH} AND resource_id IN (SELECT resource_id FROM r WHERE segment = 'MACHINERY' AND tenant_id = 'tenant-1') AND facility >= 0",
    signal="log", time=MONTH, resources={"type": "tagged", "key": "segment", "value": "MACHINERY"}, filter=_cmp("facility", "gte", 0), aggregations=COUNT)

# --- metrics: aggregates, percentiles, rates, rollups ---
ask("metric_aggregates", f"WITH {ad.METRICS} SELECT metric AS g0, count(*) AS c, count(DISTINCT resource_id) AS d, round(sum(value), 6) AS s, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS a FROM m WHERE {IN_SIX} GROUP BY 1",
    signal="metric", time=SIX_HOURS, aggregations=[*COUNT, _agg("count_distinct", "d", "resource_id"), _agg("sum", "s", "value"), _agg("min", "lo", "value"), _agg("max", "hi", "value"), _agg("avg", "a", "value")], group_by=[_f("metric")])
ask("metric_percentiles", f"WITH {ad.METRICS} SELECT metric AS g0, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM m WHERE {IN_SIX} GROUP BY 1",
    signal="metric", time=SIX_HOURS, aggregations=[_agg(p, p, "value") for p in ("p50", "p95", "p99")], group_by=[_f("metric")])
ask("metric_raw_rows", f"WITH {ad.METRICS} SELECT resource_id, metric, observed_at, round(value, 6) AS value FROM m WHERE {IN_DAY} AND metric = 'click' AND k <> '' ORDER BY resource_id, observed_at DESC LIMIT 1000",
    keep=("resource_id", "metric", "observed_at", "value"), signal="metric", time=DAY, filter={"op": "and", "of": [_cmp("metric", "eq", "click"), _cmp(_f("attr", key="k"), "ne", "")]}, limit=1000)
_RATE = (f"WITH {ad.METRICS}, x AS (SELECT *, lag(value) OVER w AS pv, lag(observed_at) OVER w AS pt FROM m WHERE {{0}} WINDOW w AS (PARTITION BY tenant_id, resource_id, metric, k ORDER BY observed_at, ingested_at, value)), "
         "y AS (SELECT *, CASE WHEN observed_at > pt AND value >= pv AND (epoch_us(observed_at) // 1000) > (epoch_us(pt) // 1000) THEN (value - pv) / (((epoch_us(observed_at) // 1000) - (epoch_us(pt) // 1000)) / 1000.0) END AS rate FROM x) ")
ask("metric_rate", _RATE.format(IN_SIX) + f"SELECT {_B('observed_at', 300)} AS g0, resource_id AS g1, round(avg(rate), 6) AS mean, round(max(rate), 6) AS peak FROM y GROUP BY 1, 2 ORDER BY peak DESC NULLS LAST, 1, 2 LIMIT 10000",
    signal="metric", time=SIX_HOURS, aggregations=[_agg("avg", "mean", "rate"), _agg("max", "peak", "rate")], group_by=[B300, _f("resource_id")], order_by=[{"key": {"by": "alias", "alias": "peak"}, "desc": True}], limit=10000)
ask("metric_rollup_5m", f"WITH {ad.METRICS} SELECT metric AS g0, {_B('observed_at', 3600)} AS g1, count(*) AS c, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS a FROM m WHERE {IN_DAY} GROUP BY 1, 2",
    signal="metric", time=DAY, aggregations=[*COUNT, _agg("min", "lo", "value"), _agg("max", "hi", "value"), _agg("avg", "a", "value")], group_by=[_f("metric"), _f("time_bucket", seconds=3600)], limit=10000)
ask("metric_rollup_1h", f"WITH {ad.METRICS} SELECT {_B('observed_at', 86400)} AS g0, round(avg(value), 6) AS a, max(value) AS hi FROM m WHERE tenant_id = 'tenant-1' AND metric = 'view' GROUP BY 1",
    signal="metric", time=YEAR, filter=_cmp("metric", "eq", "view"), aggregations=[_agg("avg", "a", "value"), _agg("max", "hi", "value")], group_by=[_f("time_bucket", seconds=86400)], limit=1000)


@register("metric_delta_kinds", f"WITH {ad.METRICS}, x AS (SELECT *, lag(value) OVER w AS pv, lag(observed_at) OVER w AS pt FROM m WINDOW w AS (PARTITION BY tenant_id, resource_id, metric, k ORDER BY observed_at, ingested_at, value)) "
          "SELECT CASE WHEN pt IS NULL THEN 'first' WHEN (epoch_us(observed_at) // 1000) <= (epoch_us(pt) // 1000) THEN 'no_time' WHEN value >= pv THEN 'rate' WHEN ((epoch_us(observed_at) // 1000) - (epoch_us(pt) // 1000)) / 1000.0 <= 120 THEN 'wrapped' ELSE 'reset' END AS delta, count(*) AS n FROM x GROUP BY 1")
def _deltas(spark, sf_dir):
    return with_delta(ad.metrics(spark, sf_dir)).groupBy("delta").agg(F.count(F.lit(1)).alias("n"))


@register("rollup_logs_5m", f"WITH {ad.LOGS} SELECT tenant_id, resource_id, severity, {_B('observed_at', 300)} AS bucket, count(*) AS cnt FROM l GROUP BY ALL")
def _counts(spark, sf_dir):
    return rollups.merge_counts(rollups.log_counts(ad.logs(spark, sf_dir)))


@register("rollup_metrics_5m", f"WITH {ad.METRICS} SELECT tenant_id, resource_id, metric, {_B('observed_at', 300)} AS bucket, min(value) AS min_v, max(value) AS max_v, round(sum(value), 6) AS sum_v, count(*) AS cnt FROM m GROUP BY ALL")
def _five(spark, sf_dir):
    return rollups.metric_rollup(ad.metrics(spark, sf_dir))


@register("rollup_metrics_1h", f"WITH {ad.METRICS} SELECT tenant_id, resource_id, metric, {_B('observed_at', 3600)} AS bucket, min(value) AS min_v, max(value) AS max_v, round(sum(value), 6) AS sum_v, count(*) AS cnt FROM m GROUP BY ALL")
def _hour(spark, sf_dir):
    return rollups.hourly(rollups.metric_rollup(ad.metrics(spark, sf_dir))).withColumn("cnt", F.col("cnt").cast("long"))


@register("retained_metrics", f"WITH {ad.METRICS} SELECT count(*) AS n FROM m WHERE observed_at >= TIMESTAMP '2024-02-09 12:00:00' - INTERVAL 30 DAY")
def _retained(spark, sf_dir):
    return rollups.retained(ad.metrics(spark, sf_dir), "metrics", datetime(2024, 2, 9, 12, tzinfo=UTC)).agg(F.count(F.lit(1)).alias("n"))


ask("events_by_category", f"WITH {ad.EVENTS} SELECT event_category AS g0, count(*) AS n FROM e WHERE {IN_MONTH} AND severity IN ('error', 'critical', 'alert', 'emergency') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 25",
    signal="event", time=MONTH, filter=_cmp("severity", "gte", "error"), aggregations=[_agg("count", "n")], group_by=[_f("event_category")], order_by=[{"key": {"by": "alias", "alias": "n"}, "desc": True}], limit=25)
ask("events_by_type_host", f"WITH {ad.EVENTS} SELECT event_type AS g0, host_name AS g1, count(*) AS n FROM e WHERE {IN_DAY} GROUP BY 1, 2",
    signal="event", time=DAY, aggregations=[_agg("count", "n")], group_by=[_f("event_type"), _f("attr", key="host.name")], limit=10000)


@register("state_transitions", "WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus AS current_status, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_status, o_orderdate AS observed_at FROM orders) "
          "SELECT o_custkey, o_orderkey, observed_at, previous_status, current_status FROM s WHERE previous_status IS DISTINCT FROM current_status")
def _transitions(spark, sf_dir):
    return ad.states(spark, sf_dir).select("o_custkey", "o_orderkey", "observed_at", "previous_status", "current_status")


# --- tail, views ---
NOW = datetime(2024, 1, 5, 12, tzinfo=UTC)
_NOW = "TIMESTAMP '2024-01-05 12:00:00'"


@register("tail_page", f"WITH {ad.LOGS} SELECT resource_id, observed_at, ingested_at FROM l WHERE tenant_id = 'tenant-1' AND ingested_at >= {_NOW} - INTERVAL 30 MINUTE AND ingested_at < {_NOW} "
          f"AND observed_at >= {_NOW} - INTERVAL 90 MINUTE AND observed_at < {_NOW} + INTERVAL 5 MINUTE ORDER BY observed_at DESC LIMIT 1000")
def _tail(spark, sf_dir):
    q = {"signal": "log", "time": MONTH, "limit": 5000}
    from datetime import timedelta

    return engine_of(spark, sf_dir).tail(q, SCOPE, NOW, NOW - timedelta(minutes=30)).result.df.select("resource_id", "observed_at", "ingested_at")


def _answer(spark, sf_dir, q):
    return engine_of(spark, sf_dir).query(q, SCOPE).df


def _logs_of_month(**more):
    return Query.from_json({"signal": "log", "time": MONTH, **more})


@register("view_facet", f"WITH {ad.LOGS} SELECT host_name AS g0, count(*) AS n FROM l WHERE {IN_MONTH} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8")
def _facet(spark, sf_dir):
    return _answer(spark, sf_dir, views.facet_query(_logs_of_month(), Field("attr", key="host.name")))


@register("view_noisy_hosts", f"WITH {ad.LOGS} SELECT host_name AS g0, count(*) AS n FROM l WHERE {IN_MONTH} AND severity_ord >= 6 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8")
def _noisy(spark, sf_dir):
    q = _logs_of_month()
    return _answer(spark, sf_dir, views.noisy_hosts_query(q.time.start, q.time.end))


@register("view_volume", f"WITH {ad.LOGS} SELECT {_B('observed_at', 43200)} AS g0, severity AS g1, count(*) AS n FROM l WHERE {IN_MONTH} GROUP BY 1, 2")
def _volume(spark, sf_dir):
    q = _logs_of_month()
    return _answer(spark, sf_dir, views.volume_query(q.time.start, q.time.end))


@register("view_reporting", f"WITH {ad.METRICS} SELECT count(*) AS n FROM (SELECT resource_id FROM m WHERE {IN_DAY} AND metric = 'view' GROUP BY 1)")
def _reporting(spark, sf_dir):
    q = Query.from_json({"signal": "metric", "time": DAY})
    return views.reporting(engine_of(spark, sf_dir), SCOPE, "view", q.time.start, q.time.end)


@register("view_dense_histogram", f"WITH {ad.METRICS}, h AS (SELECT {_B('observed_at', 600)} AS g0, count(*) AS n FROM m WHERE {IN_DAY} AND metric = 'error' GROUP BY 1) "
          "SELECT b.g0, coalesce(n, 0) AS n FROM (SELECT TIMESTAMP '2024-01-05' + to_seconds(600 * i) AS g0 FROM range(144) t(i)) b LEFT JOIN h USING (g0)")
def _dense(spark, sf_dir):
    q = Query.from_json({"signal": "metric", "time": DAY, "filter": _cmp("metric", "eq", "error")})
    return views.densify(_answer(spark, sf_dir, views.histogram_query(q, 600)), q.time.start, q.time.end, 600)


@register("view_series", f"WITH {ad.METRICS} SELECT {_B('observed_at', 3600)} AS at, metric AS series, round(avg(value), 6) AS value FROM m WHERE {IN_DAY} GROUP BY 1, 2")
def _series(spark, sf_dir):
    q = {"signal": "metric", "time": DAY, "aggregations": [_agg("avg", "a", "value")], "group_by": [_f("time_bucket", seconds=3600), _f("metric")], "limit": 10000}
    return views.series(_answer(spark, sf_dir, q))


@register("view_around", f"WITH {ad.LOGS}, {ad.METRICS}, {ad.EVENTS}, {ad.STATES}, x AS (SELECT 'log' AS signal, tenant_id, resource_id, observed_at, body AS text FROM l UNION ALL SELECT 'event', tenant_id, resource_id, observed_at, summary FROM e "
          "UNION ALL SELECT 'state', tenant_id, resource_id, observed_at, concat_ws(' to ', previous_status, current_status) FROM s UNION ALL SELECT 'metric', tenant_id, resource_id, observed_at, metric || ' ' || value FROM m) "
          f"SELECT signal, observed_at, text FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY observed_at DESC, text) AS n FROM x WHERE tenant_id = 'tenant-1' AND resource_id = 'user-4' AND observed_at >= {_NOW} - INTERVAL 5 MINUTE AND observed_at < {_NOW} + INTERVAL 5 MINUTE) WHERE n <= 25")
def _around(spark, sf_dir):
    return views.around(ad.tables(spark, sf_dir), ad.TENANT, "user-4", NOW)


@register("site_overview", f"WITH {ad.RESOURCES} SELECT 'site-' || n_nationkey AS site_id, count(r.resource_id) AS resources, count(*) FILTER (status = 'up') AS up, count(*) FILTER (status = 'down') AS down, "
          "count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'maintenance') AS maintenance, count(*) FILTER (status = 'unknown') AS unknown "
          "FROM nation LEFT JOIN r ON r.site_id = 'site-' || n_nationkey AND status <> 'decommissioned' GROUP BY 1")
def _sites(spark, sf_dir):
    sites = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("site-"), "n_nationkey").alias("site_id"))
    return views.site_overview(sites, ad.resources(spark, sf_dir))


# --- inventory, topology, identity ---
@register("descendants", f"WITH RECURSIVE {ad.EDGES}, w AS (SELECT 'r-2' AS resource_id, 0 AS depth, ['r-2'] AS path UNION ALL SELECT g.source_id, depth + 1, list_append(path, g.source_id) FROM w JOIN g ON g.target_id = w.resource_id "
          "WHERE depth < 2 AND NOT list_contains(path, g.source_id)) SELECT resource_id, min(depth)::INTEGER AS depth FROM w GROUP BY 1")
def _descendants(spark, sf_dir):
    root = spark.range(1).select(F.lit("r-2").alias("resource_id"))
    return topology.descendants(ad.edges(spark, sf_dir), root, 2)


_ALIAS = "a AS (SELECT 'old-' || s_suppkey AS historical_id, 'user-' || (s_suppkey * 3 + 1) AS current_id FROM supplier)"


def _alias(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit(ad.TENANT).alias("tenant_id"), F.concat(F.lit("old-"), "s_suppkey").alias("historical_id"), F.concat(F.lit("user-"), F.col("s_suppkey") * 3 + 1).alias("current_id"))


@register("canonical_ids", f"WITH {ad.RESOURCES}, {_ALIAS}, i AS (SELECT 'old-' || s_suppkey AS id FROM supplier UNION ALL SELECT 'user-' || s_suppkey FROM supplier UNION ALL SELECT 'foreign') "
          "SELECT DISTINCT r.resource_id FROM i LEFT JOIN a ON id = historical_id JOIN r ON r.resource_id = coalesce(current_id, id)")
def _canonical(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    ids = s.select(F.concat(F.lit("old-"), "s_suppkey").alias("id")).unionByName(s.select(F.concat(F.lit("user-"), "s_suppkey").alias("id"))).unionByName(spark.range(1).select(F.lit("foreign").alias("id")))
    return canonical_ids(ids, ad.resources(spark, sf_dir), _alias(spark, sf_dir))


@register("enrichment", f"WITH {ad.METRICS}, {ad.RESOURCES} SELECT coalesce(r.site_id, '{fx.NIL}') AS site_id, coalesce(vendor, '') AS source_vendor, count(*) AS n FROM m LEFT JOIN r USING (tenant_id, resource_id) GROUP BY 1, 2")
def _enriched(spark, sf_dir):
    out = identity.enrich(ad.metrics(spark, sf_dir).drop("site_id"), ad.resources(spark, sf_dir))
    return out.groupBy("site_id", "source_vendor").agg(F.count(F.lit(1)).alias("n"))


@register("resource_page", f"WITH {ad.RESOURCES} SELECT resource_id, name FROM r WHERE tenant_id = 'tenant-1' AND kind = 'building' AND contains(lower(name), '00001') AND resource_id > 'user-1' ORDER BY 1 LIMIT 51")
def _page(spark, sf_dir):
    return inventory.resource_page(ad.resources(spark, sf_dir), ad.TENANT, kind="building", search="00001", after="user-1")[0].select("resource_id", "name")


def _identifiers(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("rid", F.concat(F.lit("user-"), F.col("s_suppkey") % 50))
    kinds = F.array(F.struct(F.lit("mgmt_ip").alias("kind"), F.concat(F.lit("10.0.0."), "s_suppkey").alias("value")), F.struct(F.lit("hostname").alias("kind"), F.lower("s_name").alias("value")),
                    F.struct(F.lit("serial").alias("kind"), F.concat(F.lit("S"), F.col("s_suppkey") % 50).alias("value")))
    return s.select(F.lit(ad.TENANT).alias("tenant_id"), F.col("rid").alias("resource_id"), F.inline(kinds)).dropDuplicates(["tenant_id", "kind", "value"])


def _observed(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    kinds = F.array(
        F.struct(F.lit("mgmt_ip").alias("kind"), F.concat(F.lit("10.0.0."), "s_suppkey").alias("value")), F.when(F.col("s_suppkey") % 2 == 0, F.struct(F.lit("hostname").alias("kind"), F.upper("s_name").alias("value"))),
        F.when(F.col("s_suppkey") % 3 == 0, F.struct(F.lit("serial").alias("kind"), F.concat(F.lit("S"), F.col("s_suppkey") % 50 + F.col("s_suppkey") % 2).alias("value"))), F.when(F.col("s_suppkey") % 5 == 0, F.struct(F.lit("service_name").alias("kind"), F.lit("x").alias("value"))))
    return s.select(F.col("s_suppkey").alias("obs_id"), F.lit(ad.TENANT).alias("tenant_id"), F.inline(F.filter(kinds, lambda x: x.isNotNull())))


_IDENTITY = (
    "s AS (SELECT s_suppkey AS k, s_name FROM supplier), "
    "ids AS (SELECT 'user-' || (k % 50) AS resource_id, 'mgmt_ip' AS kind, '10.0.0.' || k AS value FROM s UNION ALL SELECT 'user-' || (k % 50), 'hostname', lower(s_name) FROM s UNION ALL SELECT DISTINCT 'user-' || (k % 50), 'serial', 'S' || (k % 50) FROM s), "
    "obs AS (SELECT k AS obs_id, 'mgmt_ip' AS kind, '10.0.0.' || k AS value FROM s UNION ALL SELECT k, 'hostname', lower(s_name) FROM s WHERE k % 2 = 0 UNION ALL SELECT k, 'serial', 'S' || (k % 50 + k % 2) FROM s WHERE k % 3 = 0 UNION ALL SELECT k, 'service_name', 'x' FROM s WHERE k % 5 = 0), "
    "conf AS (SELECT * FROM (VALUES ('serial', 1.0), ('mgmt_ip', 0.8), ('hostname', 0.65), ('service_name', 0.6)) t(kind, c)), "
    "hit AS (SELECT o.obs_id, o.kind, o.value, i.resource_id, c FROM obs o JOIN ids i USING (kind, value) JOIN conf USING (kind)), "
    "cand AS (SELECT obs_id, resource_id, 1 - product(1 - c) AS confidence FROM hit GROUP BY 1, 2), "
    "contra AS (SELECT cand.obs_id, cand.resource_id FROM cand JOIN obs o ON o.obs_id = cand.obs_id AND o.kind = 'serial' JOIN ids i ON i.resource_id = cand.resource_id AND i.kind = 'serial' GROUP BY 1, 2 HAVING NOT bool_or(o.value = i.value)) "
)


@register("identity_candidates", f"WITH {_IDENTITY} SELECT cand.obs_id, cand.resource_id, round(confidence, 6) AS confidence, contra.obs_id IS NOT NULL AS contradicted FROM cand LEFT JOIN contra USING (obs_id, resource_id)")
def _candidates(spark, sf_dir):
    out = identity.candidates(_observed(spark, sf_dir), _identifiers(spark, sf_dir))
    return out.select("obs_id", "resource_id", "confidence", F.col("contradiction").isNotNull().alias("contradicted"))


@register("identity_outcomes", f"WITH {_IDENTITY}, best AS (SELECT * FROM (SELECT cand.*, contra.obs_id IS NOT NULL AS bad, row_number() OVER (PARTITION BY cand.obs_id ORDER BY contra.obs_id IS NOT NULL, confidence DESC, cand.resource_id) AS n FROM cand LEFT JOIN contra USING (obs_id, resource_id)) WHERE n = 1), "
          "cnt AS (SELECT obs_id, count(*) AS asked FROM obs GROUP BY 1), h AS (SELECT obs_id, count(DISTINCT kind) AS hit, count(DISTINCT resource_id) AS rs FROM hit GROUP BY 1), "
          "o AS (SELECT cnt.obs_id, CASE WHEN best.resource_id IS NULL THEN 'create' WHEN NOT bad AND rs = 1 AND hit = asked THEN 'match' WHEN bad THEN 'create' WHEN confidence >= 0.95 THEN 'match' WHEN confidence >= 0.6 THEN 'review' ELSE 'create' END AS outcome, best.resource_id "
          "FROM cnt LEFT JOIN h USING (obs_id) LEFT JOIN best USING (obs_id)) SELECT obs_id, outcome, CASE WHEN outcome <> 'create' THEN resource_id END AS resource_id FROM o")
def _outcomes(spark, sf_dir):
    return identity.resolve_observations(_observed(spark, sf_dir), _identifiers(spark, sf_dir)).select("obs_id", "outcome", "resource_id")


@register("profile_match", "WITH d AS (SELECT p_partkey AS device_id, '1.3.6.1.4.1.' || (p_partkey % 12) || '.' || p_size AS oid, CASE WHEN p_partkey % 10 = 0 THEN 'p1' END AS explicit FROM part), "
          "p AS (SELECT * FROM (VALUES ('p1', '1.3.6.1.4.1.1'), ('p9', '1.3.6.1.4.1.9'), ('p9x', '1.3.6.1.4.1.9.1'), ('pall', '1.3.6.1.4')) t(id, prefix)), "
          "m AS (SELECT device_id, max_by(id, length(prefix)) AS by_oid FROM d JOIN p ON starts_with(oid || '.', prefix || '.') GROUP BY 1) SELECT d.device_id, coalesce(explicit, by_oid, 'generic-snmp') AS profile_id FROM d LEFT JOIN m USING (device_id)")
def _profiles(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("device_id"), F.when(F.col("p_partkey") % 10 == 0, "p1").alias("explicit"), F.concat(F.lit("1.3.6.1.4.1."), F.col("p_partkey") % 12, F.lit("."), "p_size").alias("sysobjectid"))
    p = spark.createDataFrame([("p1", "1.3.6.1.4.1.1"), ("p9", "1.3.6.1.4.1.9"), ("p9x", "1.3.6.1.4.1.9.1"), ("pall", "1.3.6.1.4")], "profile_id string, prefix string")
    return topology.match_profiles(d, p).select("device_id", "profile_id")


@register("mac_vendor", "WITH d AS (SELECT p_partkey AS k, printf('%02x%02x%02x%06x', (p_partkey % 8)::INT, 10, (p_partkey % 5)::INT, p_partkey::INT) AS mac FROM part), v AS (SELECT * FROM (VALUES ('000a00', 'A'), ('040a01', 'B'), ('000a000', 'C'), ('000a00000', 'D'), ('020a00', 'E')) t(prefix, org)) "
          "SELECT k AS device_id, CASE WHEN (k % 8) & 3 = 0 THEN coalesce(c.org, b.org, a.org) END AS vendor FROM d LEFT JOIN v a ON a.prefix = mac[1:6] LEFT JOIN v b ON b.prefix = mac[1:7] LEFT JOIN v c ON c.prefix = mac[1:9]")
def _vendor(spark, sf_dir):
    k = F.col("p_partkey").cast("int")
    d = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("device_id"), F.format_string("%02X:0a-%02x.%06x", k % 8, k % 5, k).alias("mac"))
    v = spark.createDataFrame([("000a00", "A"), ("040a01", "B"), ("000a000", "C"), ("000a00000", "D"), ("020a00", "E")], "prefix string, organisation string")
    return topology.with_vendor(d, v).select("device_id", "vendor")


@register("group_counts", "SELECT 'g-' || n_nationkey AS group_id, count(c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _groups(spark, sf_dir):
    g = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("t").alias("tenant_id"), F.concat(F.lit("g-"), "n_nationkey").alias("group_id"))
    m = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lit("t").alias("tenant_id"), F.concat(F.lit("g-"), "c_nationkey").alias("group_id"), F.concat(F.lit("user-"), "c_custkey").alias("resource_id"))
    return inventory.groups_with_counts(g, m).select("group_id", "members")


@register("undirected_edges", "SELECT least(l_partkey % 40, l_suppkey % 40) AS source_id, greatest(l_partkey % 40, l_suppkey % 40) AS target_id, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem WHERE l_partkey % 40 <> l_suppkey % 40 GROUP BY 1, 2")
def _edges(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_partkey") % 40).alias("a"), (F.col("l_suppkey") % 40).alias("b"), F.col("l_shipdate").alias("seen_at"))
    return topology.undirected(e)


@register("sweep_hosts", "SELECT '10.1.' || (i // 256) || '.' || (i % 256) AS address FROM range(1, 1023) t(i)")
def _sweep(spark, sf_dir):
    return polling.sweep(spark, ["10.1.0.0/22"])


# --- alerts, maintenance ---
@register("alert_threshold", f"WITH {ad.METRICS} SELECT resource_id, 'rule-1/' || resource_id || '/metric=' || metric AS dedup_key, round(avg(value), 6) AS value, avg(value) > 50 AS breaching FROM m WHERE tenant_id = 'tenant-1' AND observed_at >= {_NOW} - INTERVAL 6 HOUR AND observed_at < {_NOW} GROUP BY resource_id, metric")
def _threshold(spark, sf_dir):
    q = Query.from_json({"signal": "metric", "time": SIX_HOURS, "aggregations": [_agg("avg", "v", "value")], "group_by": [_f("time_bucket", seconds=60), _f("metric")]})
    c = alerts.Condition("threshold", "gt", 50.0, 300)
    alerts.check_rule(q, c)
    whole = Engine(ad.tables(spark, sf_dir)).query(alerts.evaluation_query(q, c, NOW), SCOPE, whole=True).df
    got = alerts.read_threshold(whole, "rule-1", ["metric"])
    return got.select("resource_id", "dedup_key", "value", alerts.breached(c, F.col("value")).alias("breaching"))


@register("alert_absence", f"WITH {ad.METRICS}, {ad.RESOURCES}, h AS (SELECT resource_id, greatest(0, epoch_us({_NOW}) // 1000 - epoch_us(max(observed_at)) // 1000) / 1000.0 AS value FROM m WHERE tenant_id = 'tenant-1' AND observed_at >= {_NOW} - INTERVAL 3 HOUR AND observed_at < {_NOW} GROUP BY 1), "
          "x AS (SELECT resource_id FROM r WHERE tenant_id = 'tenant-1') SELECT coalesce(h.resource_id, x.resource_id) AS resource_id, round(coalesce(value, 10801.0), 6) AS value FROM x FULL JOIN h ON x.resource_id = h.resource_id")
def _absence(spark, sf_dir):
    c = alerts.Condition("absence", after_seconds=10_800)
    q = alerts.evaluation_query(Query.from_json({"signal": "metric", "time": DAY}), c, NOW)
    expected = ad.resources(spark, sf_dir).where("tenant_id = 'tenant-1'")
    heard = Engine(ad.tables(spark, sf_dir)).query(q, SCOPE, base=True, whole=True).df
    return alerts.read_absence(heard, "rule-2", NOW, expected, c.after_seconds).select("resource_id", "value")


def _evaluations(spark, sf_dir):
    m = ad.metrics(spark, sf_dir).where("tenant_id = 'tenant-1'")
    own = m.groupBy(F.concat(F.lit("r/"), "resource_id").alias("dedup_key"), fx.bucket(F.col("observed_at"), 3600).alias("at")).agg((F.max("value") > 60).alias("breaching"))
    return own.withColumns({"hold_seconds": F.lit(7200.0), "suppressed": F.lit(False), "muted": F.lit(False)})


_FOLD = (f"WITH RECURSIVE {ad.METRICS}, e AS (SELECT 'r/' || resource_id AS k, {_B('observed_at', 3600)} AS ti, max(value) > 60 AS b FROM m WHERE tenant_id = 'tenant-1' GROUP BY 1, 2), "
         "n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ti) AS rn FROM e), "
         "w AS (SELECT k, rn, ti, CASE WHEN b THEN 'pending' ELSE 'ok' END AS phase, ti AS since, false AS notify FROM n WHERE rn = 1 UNION ALL "
         "SELECT n.k, n.rn, n.ti, CASE WHEN n.b AND (w.phase = 'firing' OR w.phase = 'pending' AND epoch(n.ti) - epoch(w.since) >= 7200) THEN 'firing' WHEN n.b THEN 'pending' WHEN w.phase = 'firing' THEN 'resolved' ELSE 'ok' END, "
         "CASE WHEN n.b AND (w.phase = 'firing' OR w.phase = 'pending' AND epoch(n.ti) - epoch(w.since) < 7200) THEN w.since ELSE n.ti END, "
         "CASE WHEN n.b THEN w.phase = 'pending' AND epoch(n.ti) - epoch(w.since) >= 7200 ELSE w.phase = 'firing' END FROM w JOIN n ON n.k = w.k AND n.rn = w.rn + 1) ")


@register("alert_replay", _FOLD + "SELECT k AS dedup_key, ti AS \"at\", phase, since, notify FROM w")
def _replayed(spark, sf_dir):
    return alerts.replay(_evaluations(spark, sf_dir))


@register("alert_cycle", f"WITH {ad.METRICS}, b AS (SELECT 'r/' || resource_id AS dedup_key, max(value) > 60 AS breaching FROM m WHERE tenant_id = 'tenant-1' GROUP BY 1), "
          "s AS (SELECT 'r/user-' || c_custkey AS dedup_key, ['ok', 'pending', 'firing', 'resolved'][c_custkey % 4 + 1] AS was, TIMESTAMP '2024-01-05 11:00:00' + to_minutes(c_custkey % 60) AS since FROM customer), "
          f"p AS (SELECT b.*, was, since, CASE WHEN breaching THEN CASE WHEN was = 'firing' THEN 'firing' WHEN was = 'pending' AND epoch({_NOW}) - epoch(since) >= 1800 THEN 'firing' ELSE 'pending' END WHEN was = 'firing' THEN 'resolved' ELSE 'ok' END AS phase FROM b LEFT JOIN s USING (dedup_key)) "
          f"SELECT dedup_key, phase, CASE WHEN breaching AND (was = 'firing' OR was = 'pending' AND phase = 'pending') THEN since ELSE {_NOW} END AS since, (phase = 'firing' AND was IS DISTINCT FROM 'firing') OR phase = 'resolved' AS notify, phase IN ('pending', 'firing') OR coalesce(was IN ('pending', 'firing'), false) AS write FROM p")
def _cycle(spark, sf_dir):
    readings = ad.metrics(spark, sf_dir).where("tenant_id = 'tenant-1'").groupBy(F.concat(F.lit("r/"), "resource_id").alias("dedup_key")).agg((F.max("value") > 60).alias("breaching"))
    readings = readings.withColumns({"hold_seconds": F.lit(1800.0), "suppressed": F.lit(False), "muted": F.lit(False)})
    k = F.col("c_custkey")
    states = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("r/user-"), k).alias("dedup_key"), F.element_at(F.array(*map(F.lit, alerts.PHASES)), (k % 4 + 1).cast("int")).alias("phase"),
        F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-05 11:00:00").cast("timestamp")) + k % 60 * 60).alias("since"))
    return alerts.advance(states, readings, NOW)


@register("maintenance_open", "WITH w AS (SELECT o_orderkey AS k, o_orderdate AS s, ['once', 'daily', 'weekly', 'monthly'][o_orderkey % 4 + 1] AS rec, o_orderkey % 300 + 30 AS mins, o_orderkey % 7 AS wd, o_orderkey % 31 + 1 AS dom, TIMESTAMP '1998-06-17 01:30:00' AS t0 FROM orders), "
          "c AS (SELECT w.*, d, (t0::DATE - d::INTEGER)::TIMESTAMP + (s - s::DATE::TIMESTAMP) AS st, (t0::DATE - d::INTEGER) AS day FROM w, range(2) t(d)), "
          "o AS (SELECT k, d, t0 < st + to_minutes(mins) AS open, day >= s::DATE AND t0 >= st AND CASE rec WHEN 'once' THEN day = s::DATE WHEN 'daily' THEN true WHEN 'weekly' THEN isodow(day) - 1 = wd ELSE day(day) = dom END AS began FROM c) "
          "SELECT w.k AS window_id, w.t0 >= w.s AND coalesce((SELECT arg_min(open, d) FROM o WHERE o.k = w.k AND began), false) AS open FROM w")
def _open(spark, sf_dir):
    k = F.col("o_orderkey")
    w = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("window_id"), F.col("o_orderdate").cast("timestamp").alias("starts_at"), F.element_at(F.array(*map(F.lit, maintenance.RECURRENCES)), (k % 4 + 1).cast("int")).alias("recurrence"), (k % 300 + 30).alias("duration_minutes"),
        (k % 7).alias("weekday"), (k % 31 + 1).alias("day"), F.lit("UTC").alias("timezone"), F.lit(None).cast("timestamp").alias("until"))
    return w.select("window_id", maintenance.is_open(F.lit("1998-06-17 01:30:00").cast("timestamp")).alias("open"))


@register("suppressions", "WITH w AS (SELECT s_suppkey AS k, ['resource', 'site'][s_suppkey % 2 + 1] AS kind, CASE WHEN s_suppkey % 2 = 0 THEN 'user-' || s_suppkey ELSE 'site-' || (s_suppkey % 25) END AS target, s_suppkey % 3 = 0 AS a, s_suppkey % 5 = 0 AS n FROM supplier), "
          f"{ad.RESOURCES} SELECT resource_id, bool_or(a) AS alerts, bool_or(n) AS notifications FROM w JOIN r ON (w.kind = 'resource' AND r.resource_id = target) OR (w.kind = 'site' AND r.site_id = target) GROUP BY 1")
def _quiet(spark, sf_dir):
    k = F.col("s_suppkey")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k.alias("window_id"), F.lit("t").alias("tenant_id"), F.when(k % 2 == 0, "resource").otherwise("site").alias("target_kind"), F.when(k % 2 == 0, F.concat(F.lit("user-"), k)).otherwise(F.concat(F.lit("site-"), k % 25)).alias("target_id"),
        (k % 3 == 0).alias("suppress_alerts"), (k % 5 == 0).alias("suppress_notifications"))
    r = ad.resources(spark, sf_dir).withColumn("tenant_id", F.lit("t"))
    none = spark.createDataFrame([], "tenant_id string, group_id string, resource_id string")
    return alerts.suppressions(maintenance.silenced(s, r, none))


_BUDGET = ("WITH RECURSIVE a AS (SELECT event_id AS attempt_id, user_id % 3 AS t, user_id % 2 AS c, ts AS ti, row_number() OVER (PARTITION BY user_id % 3, ts::DATE ORDER BY ts, event_id) AS rn, ts::DATE AS day FROM events), "
           "s AS (SELECT DISTINCT t, day FROM a), "
           "w AS (SELECT t, day, 0::BIGINT AS rn, NULL::BIGINT AS attempt_id, NULL::VARCHAR AS outcome, 0 AS sent, []::STRUCT(c BIGINT, ti TIMESTAMP)[] AS recent FROM s UNION ALL "
           "SELECT t, day, rn, attempt_id, o, sent + (o = 'sent')::INT, CASE WHEN o = 'sent' THEN list_append(near, {c: c, ti: ti}) ELSE near END FROM (SELECT *, CASE WHEN sent >= 50 THEN 'over_budget' WHEN len(list_filter(near, lambda x: x.c = cc)) >= 2 THEN 'rate_limited' ELSE 'sent' END AS o FROM "
           "(SELECT a.t, a.day, a.rn, a.attempt_id, a.c, a.c AS cc, a.ti, w.sent, list_filter(w.recent, lambda x: x.ti > a.ti - INTERVAL 1 MINUTE) AS near FROM w JOIN a ON a.t = w.t AND a.day = w.day AND a.rn = w.rn + 1))) ")


@register("notification_budget", _BUDGET + "SELECT attempt_id, outcome FROM w WHERE attempt_id IS NOT NULL")
def _budget(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    a = e.select(F.col("event_id").alias("attempt_id"), F.concat(F.lit("t-"), F.col("user_id") % 3).alias("tenant_id"), F.concat(F.lit("c-"), F.col("user_id") % 3, F.lit("-"), F.col("user_id") % 2).alias("channel_id"), F.col("ts").cast("timestamp").alias("at"))
    ch = a.select("tenant_id", "channel_id").distinct().withColumns({"enabled": F.lit(True), "max_per_minute": F.lit(2)})
    return alerts.reserve(a, ch, a.select("tenant_id").distinct().withColumn("budget_per_day", F.lit(50)))


# --- ingest ---
@register("syslog_parse", "SELECT event_id, (event_id % 24)::SMALLINT AS facility, ['emergency', 'alert', 'critical', 'error', 'warn', 'notice', 'info', 'debug'][event_id % 8 + 1] AS severity, date_trunc('second', ts) AS timestamp, 'host-' || user_id AS hostname, event_type AS app_name, (user_id)::VARCHAR AS proc_id, 'value ' || user_id AS body FROM events")
def _syslog(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pri = (F.col("event_id") % 24 * 8 + F.col("event_id") % 8).cast("int")
    old = F.concat(F.format_string("<%d>", pri), F.date_format("ts", "MMM"), F.format_string(" %2d ", F.dayofmonth("ts")), F.date_format("ts", "HH:mm:ss"), F.format_string(" host-%d %s[%d]: value %d", "user_id", "event_type", "user_id", "user_id"))
    new = F.concat(F.format_string("<%d>1 ", pri), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.format_string(' host-%d %s %d - [a@1 k="v\\]"] value %d', "user_id", "event_type", "user_id", "user_id"))
    raw = e.select("event_id", F.when(F.col("event_id") % 2 == 0, old).otherwise(new).alias("raw"), F.lit("2024-02-01").cast("timestamp").alias("received_at"))
    return syslog.parse(raw).select("event_id", "facility", "severity", "timestamp", "hostname", "app_name", "proc_id", "body")


@register("otlp_logs", "SELECT date_trunc('second', ts) AS observed_at, CASE WHEN event_id % 25 BETWEEN 1 AND 4 THEN 'trace' WHEN event_id % 25 BETWEEN 5 AND 8 THEN 'debug' WHEN event_id % 25 BETWEEN 13 AND 16 THEN 'warn' WHEN event_id % 25 BETWEEN 17 AND 20 THEN 'error' "
          "WHEN event_id % 25 = 21 THEN 'critical' WHEN event_id % 25 = 22 THEN 'alert' WHEN event_id % 25 >= 23 THEN 'emergency' ELSE 'info' END AS severity, event_type AS body, 'host-' || user_id AS host FROM events")
def _otlp(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    payload = F.format_string(
        '{"resourceLogs":[{"resource":{"attributes":[{"key":"host.name","value":{"stringValue":"host-%d"}}]},"scopeLogs":[{"logRecords":[{"timeUnixNano":"%d000000000","severityNumber":%d,"body":{"stringValue":"%s"},"attributes":[]}]}]}]}',
        "user_id", F.unix_seconds(F.col("ts").cast("timestamp")), F.col("event_id") % 25, "event_type")
    rows = otlp.log_rows(e.select(payload.alias("payload"), F.lit("2024-02-01").cast("timestamp").alias("received_at")))
    return rows.select("observed_at", "severity", "body", F.col("attributes")["host.name"].alias("host"))


@register("interface_rows", "SELECT l_suppkey AS device_id, l_orderkey || '.' || l_linenumber AS idx, round(l_quantity, 6) AS value FROM lineitem WHERE l_partkey % 2 = 0")
def _interfaces(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias("device_id"), F.concat(F.when(F.col("l_partkey") % 2 == 0, "1.3.6.1.2.1.31.1.1.1.6.").otherwise("1.3.6.1.2.1.31.1.1.1.66."), "l_orderkey", F.lit("."), "l_linenumber").alias("oid"),
        F.col("l_quantity").alias("value"), F.col("l_shipdate").alias("observed_at"))
    return polling.interface_rows("1.3.6.1.2.1.31.1.1.1.6", "in", r).select("device_id", F.col("labels")["network.interface.index"].alias("idx"), "value")


@register("reachability", "SELECT l_orderkey AS check_id, bool_or(l_quantity > 25) AS up, min(CASE WHEN l_quantity > 25 THEN l_linenumber END) AS attempt FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1")
def _reachable(spark, sf_dir):
    a = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("check_id"), F.col("l_linenumber").alias("attempt"), (F.col("l_quantity") > 25).alias("ok"))
    return polling.reachability(a, 3)


@register("subject_filter", "SELECT 'telemetry.t' || (user_id % 3) || '.' || event_type || '.syslog' AS subject, count(*) AS n FROM events WHERE user_id % 3 = 1 GROUP BY 1")
def _subjects(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/events.parquet").select(subject(F.concat(F.lit("t"), F.col("user_id") % 3), F.col("event_type"), F.lit("syslog")).alias("subject"))
    return s.where(Pattern("telemetry.t1.*.>").matches(F.col("subject"))).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


def queries():
    from marlstone import registry_control  # noqa: F401  registers its own

    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql():
    queries()
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
