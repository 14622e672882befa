"""Registered queries of the control plane, of ingest, and of what surrounds a query, with their SQL twins."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from marlstone.functions import columns as fx
from marlstone.operators import alerts, identity, inventory, maintenance, topology, views
from marlstone.operators.lower import Engine, compiles
from marlstone.operators.resolve import Catalog
from marlstone.plans import planner
from marlstone.plans.ast import Query
from marlstone.plans.errors import QueryError
from marlstone.plans.scope import TenantScope
from marlstone.registry import _B, _IDENTITY, _NOW, IN_DAY, IN_MONTH, MONTH, NOW, SCOPE, _agg, _alias, _ALIAS, _cmp, _f, _identifiers, _observed, _text, ask, register
from marlstone.sources import adapters as ad
from marlstone.sources import generator, otlp, polling, registry_files, syslog, tables


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _c(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _of(k, *names):
    """One of some names by a number."""
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _list(*names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


# --- signals, selectors, windows ---
ask("state_rows", f"WITH {ad.STATES} SELECT resource_id, observed_at, severity, previous_status, current_status FROM s WHERE tenant_id = 'tenant-1' AND observed_at >= TIMESTAMP '1996-01-01' AND observed_at < TIMESTAMP '1996-07-01' "
    "AND current_status <> 'O' ORDER BY resource_id, observed_at DESC, severity LIMIT 5000",
    keep=("resource_id", "observed_at", "severity", "previous_status", "current_status"), signal="state", time={"start": "1996-01-01T00:00:00Z", "end": "1996-07-01T00:00:00Z"}, filter=_cmp("current_status", "ne", "O"), limit=5000)
ask("state_counts", f"WITH {ad.STATES} SELECT severity AS g0, current_status AS g1, count(*) AS c FROM s WHERE tenant_id = 'tenant-1' AND observed_at >= TIMESTAMP '1992-01-01' AND observed_at < TIMESTAMP '1999-01-01' GROUP BY 1, 2",
    signal="state", time={"start": "1992-01-01T00:00:00Z", "end": "1999-01-01T00:00:00Z"}, aggregations=[_agg("count", "c")], group_by=[_f("severity"), _f("current_status")])
ask("log_counts_from_within_a_bucket", f"WITH {ad.LOGS} SELECT severity AS g0, count(*) AS c FROM l WHERE tenant_id = 'tenant-1' AND observed_at >= TIMESTAMP '2024-01-02 10:10:00' AND observed_at < TIMESTAMP '2024-01-09 07:03:00' GROUP BY 1",
    signal="log", time={"start": "2024-01-02T10:13:30Z", "end": "2024-01-09T07:03:00Z"}, aggregations=[_agg("count", "c")], group_by=[_f("severity")])
ask("log_rows_whole", f"WITH {ad.LOGS} SELECT tenant_id, resource_id, site_id, observed_at, ingested_at, 'syslog' AS source_kind, '' AS source_vendor, severity, facility::SMALLINT AS facility, body, trace_id, '' AS span_id FROM l WHERE {IN_DAY} ORDER BY resource_id, observed_at DESC LIMIT 500",
    keep=("tenant_id", "resource_id", "site_id", "observed_at", "ingested_at", "source_kind", "source_vendor", "severity", "facility", "body", "trace_id", "span_id"), signal="log",
    time={"start": "2024-01-05T00:00:00Z", "end": "2024-01-06T00:00:00Z"}, limit=500)


def _members(spark, sf_dir):
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(_c("tenant-", k % 3).alias("tenant_id"), _c("g-", k % 4).alias("group_id"), _c("user-", k).alias("resource_id"))


def _asked(spark, sf_dir, resources, **query):
    catalog = Catalog(ad.resources(spark, sf_dir), _alias(spark, sf_dir), _members(spark, sf_dir))
    return Engine(ad.tables(spark, sf_dir), catalog).query({"signal": "log", "time": MONTH, "resources": resources, "aggregations": [_agg("count", "c")], **query}, SCOPE).df


@register("log_by_group", f"WITH {ad.LOGS} SELECT severity AS g0, count(*) AS c FROM l WHERE {IN_MONTH} AND resource_id IN (SELECT 'user-' || c_custkey FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 4 = 2 "
          "UNION SELECT 'old-' || s_suppkey FROM supplier WHERE (s_suppkey * 3 + 1) % 4 = 2) GROUP BY 1")
def _by_group(spark, sf_dir):
    return _asked(spark, sf_dir, {"type": "group", "group": "g-2"}, group_by=[_f("severity")])


@register("log_by_unknown_group", "SELECT 0::BIGINT AS c")
def _by_unknown(spark, sf_dir):
    return _asked(spark, sf_dir, {"type": "group", "group": "none"})


@register("log_by_ids", f"WITH {ad.LOGS}, {ad.RESOURCES}, {_ALIAS}, i AS (SELECT DISTINCT coalesce(current_id, id) AS id FROM (VALUES ('old-1'), ('user-4'), ('user-10'), ('old-9'), ('user-2'), ('x')) t(id) LEFT JOIN a ON historical_id = id) "
          f"SELECT resource_id AS g0, count(*) AS c FROM l WHERE {IN_MONTH} AND (resource_id IN (SELECT id FROM i) OR resource_id IN (SELECT historical_id FROM a JOIN i ON id = current_id)) "
          "AND resource_id IN (SELECT resource_id FROM r WHERE tenant_id = 'tenant-1') GROUP BY 1")
def _by_ids(spark, sf_dir):
    return _asked(spark, sf_dir, {"type": "ids", "ids": ["old-1", "user-4", "user-10", "old-9", "user-2", "x"]}, group_by=[_f("resource_id")])


# --- what is refused, and what is told ---
REFUSED = {
    "trace signal": ({"signal": "trace"}, "Unsupported"), "flow signal": ({"signal": "flow"}, "Unsupported"), "capital alias": ({"aggregations": [_agg("count", "Bad")]}, "Invalid"),
    "empty list": ({"filter": _cmp("body", "in", [])}, "Invalid"), "list for one value": ({"filter": _cmp("body", "eq", ["a"])}, "Invalid"), "not a number": ({"filter": _cmp("facility", "eq", float("nan"))}, "Invalid"),
    "text on a severity": ({"filter": {"op": "text", "field": _f("severity"), "mode": "any_token", "terms": ["x"]}}, "Invalid"), "blank terms": ({"filter": _text("any_token", " ")}, "Invalid"),
    "exists on a time": ({"filter": {"op": "exists", "field": _f("observed_at")}}, "Invalid"), "filter on a rate": ({"signal": "metric", "filter": _cmp("rate", "gt", 1)}, "Invalid"),
    "rate of logs": ({"aggregations": [_agg("avg", "a", "rate")]}, "FieldNotAvailable"), "bucket of no time": ({"aggregations": [_agg("count", "c")], "group_by": [_f("time_bucket", seconds=0)]}, "Invalid"),
    "bucket of two days": ({"aggregations": [_agg("count", "c")], "group_by": [_f("time_bucket", seconds=172_800)]}, "Invalid"), "no rows": ({"limit": 0}, "Invalid"), "body of a metric": ({"signal": "metric", "filter": _cmp("body", "eq", "x")}, "FieldNotAvailable"),
    "median of a rollup": ({"signal": "metric", "aggregations": [_agg("p50", "p", "value")]}, "RollupCannotServe"), "group without an aggregate": ({"group_by": [_f("severity")]}, "Invalid"),
}


@register("refused_queries", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{e}')" for n, (_, e) in REFUSED.items()) + ") t(query, error)")
def _refused(spark, sf_dir):
    out = []
    for name, (more, _) in REFUSED.items():
        try:
            compiles(Query.from_json({"signal": "log", "time": MONTH, **more}))
            out.append((name, "none"))
        except QueryError as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "query string, error string")


@register("warnings_told", "SELECT * FROM (VALUES ('whole tenant', 'full_tenant_scan'), ('attribute', 'attribute_not_materialised'), ('attribute', 'full_tenant_scan'), ('phrase', 'full_tenant_scan'), ('phrase', 'not_index_accelerated'), "
          "('too many', 'full_tenant_scan'), ('too many', 'limit_clamped'), ('rollup', 'downsampled'), ('nobody', 'selector_matched_nothing')) t(query, warning)")
def _warned(spark, sf_dir):
    count = [_agg("count", "c")]
    asked = {
        "whole tenant": {}, "attribute": {"aggregations": count, "group_by": [_f("attr", key="device.role")]}, "phrase": {"filter": _text("phrase", "a b")}, "too many": {"limit": 20_000},
        "rollup": {"signal": "metric", "aggregations": count}, "counts": {"aggregations": count}, "nobody": {"resources": {"type": "ids", "ids": []}},
    }
    engine = Engine(ad.tables(spark, sf_dir))
    out = [(name, w.kind) for name, more in asked.items() for w in engine.query({"signal": "log", "time": MONTH, **more}, SCOPE).warnings]
    return spark.createDataFrame(out, "query string, warning string")


@register("rows_read", "SELECT count(*) AS rows_read, true AS bytes_read FROM events")
def _rows_read(spark, sf_dir):
    got = Engine(ad.tables(spark, sf_dir)).query({"signal": "metric", "time": {"start": "2024-01-05T00:00:00Z", "end": "2024-01-05T06:00:00Z"}, "aggregations": [_agg("max", "m", "value")]}, SCOPE)
    got.rows()
    read = got.read()
    return spark.createDataFrame([(read["rows_read"], read["bytes_read"] > 0)], "rows_read long, bytes_read boolean")


@register("fingerprints", "SELECT * FROM (VALUES ('rows', 'log:logs'), ('found', 'log:logs+filter'), ('counted', 'log:logs_counts_5m+agg'), ('both', 'metric:metrics_1h+filter+agg')) t(query, fingerprint)")
def _fingerprints(spark, sf_dir):
    from marlstone.plans.ast import fingerprint

    year = {"start": "2023-06-01T00:00:00Z", "end": "2024-06-01T00:00:00Z"}
    asked = {"rows": {}, "found": {"filter": _text("any_token", "x")}, "counted": {"aggregations": [_agg("count", "c")]},
             "both": {"signal": "metric", "time": year, "filter": _cmp("metric", "eq", "view"), "aggregations": [_agg("avg", "a", "value")]}}
    own = {n: Query.from_json({"signal": "log", "time": MONTH, **more}) for n, more in asked.items()}
    return spark.createDataFrame([(n, fingerprint(q, planner.plan(q)[0].table)) for n, q in own.items()], "query string, fingerprint string")


_UNITS = " ".join(f"WHEN s >= {n} THEN (s // {n}) || ' {u}' || CASE WHEN s // {n} = 1 THEN '' ELSE 's' END" for u, n in (("day", 86_400), ("hour", 3600), ("minute", 60)))


@register("duration_phrases", f"SELECT s, CASE {_UNITS} ELSE s || ' second' || CASE WHEN s = 1 THEN '' ELSE 's' END END AS duration, "
          "CASE WHEN s >= 86400 THEN (s // 86400) || 'd' WHEN s >= 3600 THEN (s // 3600) || 'h' WHEN s >= 60 THEN (s // 60) || 'm' ELSE s || 's' END AS age FROM (SELECT i * i AS s FROM range(600) t(i))")
def _phrases(spark, sf_dir):
    return spark.createDataFrame([(i * i, alerts.duration_phrase(i * i), alerts.age_phrase(i * i)) for i in range(600)], "s long, duration string, age string")


@register("bucket_widths", f"SELECT i AS hours, coalesce(min(w) FILTER (w >= i * 3600 / 60.0), 86400)::BIGINT AS seconds FROM range(1, 400) t(i), (SELECT unnest({list(views.BUCKET_STEPS)}) AS w) GROUP BY 1")
def _widths(spark, sf_dir):
    at = datetime(2024, 1, 1, tzinfo=UTC)
    return spark.createDataFrame([(i, views.bucket_seconds(at, at + timedelta(hours=i))) for i in range(1, 400)], "hours long, seconds long")


# --- views ---
_AROUND = f"tenant_id = 'tenant-1' AND resource_id = 'user-4' AND observed_at >= {_NOW} - INTERVAL 5 MINUTE AND observed_at < {_NOW} + INTERVAL 5 MINUTE"


@register("view_around_row", f"WITH {ad.LOGS}, {ad.METRICS}, {ad.EVENTS}, {ad.STATES}, x AS (SELECT 'log' AS signal, tenant_id, resource_id, observed_at, body AS text FROM l UNION ALL SELECT 'event', tenant_id, resource_id, observed_at, summary FROM e "
          "UNION ALL SELECT 'state', tenant_id, resource_id, observed_at, concat_ws(' to ', previous_status, current_status) FROM s UNION ALL SELECT 'metric', tenant_id, resource_id, observed_at, metric || ' ' || value FROM m), "
          "p AS (SELECT resource_id, observed_at FROM l WHERE tenant_id = 'tenant-1' ORDER BY observed_at LIMIT 1), "
          "o AS (SELECT x.*, row_number() OVER (PARTITION BY signal ORDER BY x.observed_at DESC, text) AS n FROM x JOIN p ON x.resource_id = p.resource_id AND tenant_id = 'tenant-1' AND x.observed_at >= p.observed_at - INTERVAL 5 MINUTE AND x.observed_at < p.observed_at + INTERVAL 5 MINUTE) "
          "SELECT signal, observed_at, text FROM o WHERE n <= 25")
def _around_row(spark, sf_dir):
    logs = ad.logs(spark, sf_dir).where("tenant_id = 'tenant-1'").select("resource_id", F.unix_seconds("observed_at").alias("at"), "observed_at").orderBy("observed_at", "resource_id").first()
    return views.around(ad.tables(spark, sf_dir), ad.TENANT, logs.resource_id, datetime.fromtimestamp(logs["at"], UTC))


@register("stat_latest", f"WITH {ad.METRICS} SELECT arg_max(a, g0) AS value FROM (SELECT {_B('observed_at', 3600)} AS g0, round(avg(value), 6) AS a FROM m WHERE {IN_DAY} AND metric = 'view' GROUP BY 1)")
def _latest(spark, sf_dir):
    q = {"signal": "metric", "time": {"start": "2024-01-05T00:00:00Z", "end": "2024-01-06T00:00:00Z"}, "filter": _cmp("metric", "eq", "view"), "aggregations": [_agg("avg", "a", "value")], "group_by": [_f("time_bucket", seconds=3600)]}
    return views.latest(Engine(ad.tables(spark, sf_dir)).query(q, SCOPE).df)


@register("panel_other_window", f"WITH {ad.LOGS} SELECT {_B('observed_at', 3600)} AS g0, severity AS g1, count(*) AS c FROM l WHERE tenant_id = 'tenant-1' AND observed_at >= TIMESTAMP '2024-01-04' AND observed_at < TIMESTAMP '2024-01-06' GROUP BY 1, 2")
def _panel(spark, sf_dir):
    q = Query.from_json({"signal": "log", "time": MONTH, "aggregations": [_agg("count", "c")], "group_by": [_f("time_bucket", seconds=43_200), _f("severity")], "limit": 10_000})
    return Engine(ad.tables(spark, sf_dir)).query(views.panel_query(q, datetime(2024, 1, 4, tzinfo=UTC), datetime(2024, 1, 6, tzinfo=UTC)), SCOPE).df


@register("tail_after_a_pause", f"WITH {ad.LOGS} SELECT resource_id, observed_at, ingested_at, true AS skipped FROM l WHERE tenant_id = 'tenant-1' AND ingested_at >= {_NOW} - INTERVAL 1 HOUR AND ingested_at < {_NOW} "
          f"AND observed_at >= {_NOW} - INTERVAL 2 HOUR AND observed_at < {_NOW} + INTERVAL 5 MINUTE ORDER BY observed_at DESC LIMIT 1000")
def _paused(spark, sf_dir):
    page = Engine(ad.tables(spark, sf_dir)).tail({"signal": "log", "time": MONTH, "limit": 5000}, SCOPE, NOW, NOW - timedelta(hours=3))
    return page.result.df.select("resource_id", "observed_at", "ingested_at", F.lit(page.skipped).alias("skipped"))


@register("metric_percentiles_sketched", f"WITH {ad.METRICS} SELECT metric AS g0, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.99), 6) AS p99 FROM m WHERE tenant_id = 'tenant-1' AND observed_at >= TIMESTAMP '2024-01-05' AND observed_at < TIMESTAMP '2024-01-05 06:00:00' GROUP BY 1")
def _sketched(spark, sf_dir):
    q = {"signal": "metric", "time": {"start": "2024-01-05T00:00:00Z", "end": "2024-01-05T06:00:00Z"}, "aggregations": [_agg(p, p, "value") for p in ("p50", "p99")], "group_by": [_f("metric")]}
    return Engine(ad.tables(spark, sf_dir), approximate=True).query(q, SCOPE).df


# --- inventory ---
@register("pollable", f"WITH {ad.RESOURCES}, i AS (SELECT 'user-' || s_suppkey AS resource_id, min('10.0.0.' || (s_suppkey + x)) AS mgmt_ip FROM supplier, range(2) t(x) GROUP BY 1) "
          "SELECT r.resource_id, mgmt_ip, CASE WHEN c_custkey % 4 = 0 THEN 'p-' || (c_custkey % 7) END AS profile_id FROM r JOIN i USING (resource_id) WHERE status <> 'decommissioned'")
def _pollable(spark, sf_dir):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    ids = _table(spark, sf_dir, "supplier").select(_c("tenant-", k % 3).alias("tenant_id"), _c("user-", k).alias("resource_id"), F.explode(F.array(
        F.struct(F.lit("mgmt_ip").alias("kind"), _c("10.0.0.", k).alias("value")), F.struct(F.lit("mgmt_ip").alias("kind"), _c("10.0.0.", k + 1).alias("value")), F.struct(F.lit("hostname").alias("kind"), F.col("s_name").alias("value")))).alias("i")).select("tenant_id", "resource_id", "i.*")
    profiles = _table(spark, sf_dir, "customer").where(c % 2 == 0).select(_c("tenant-", c % 3).alias("tenant_id"), _c("user-", c).alias("resource_id"), _c("p-", c % 7).alias("profile_id"), (c % 4 == 0).alias("enabled"))
    return inventory.pollable(ad.resources(spark, sf_dir), ids, profiles).select("resource_id", "mgmt_ip", "profile_id")


@register("effective_profiles", "WITH p AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'tenant-' || (p_partkey % 3) END AS tenant_id, p_brand AS profile_key, p_partkey AS version FROM part) "
          "SELECT profile_key, tenant_id, version FROM (SELECT *, row_number() OVER (PARTITION BY profile_key ORDER BY tenant_id IS NULL, version DESC) AS n FROM p WHERE tenant_id IS NULL OR tenant_id = 'tenant-1') WHERE n = 1")
def _effective(spark, sf_dir):
    k = F.col("p_partkey")
    p = _table(spark, sf_dir, "part").select(F.when(k % 3 != 0, _c("tenant-", k % 3)).alias("tenant_id"), F.col("p_brand").alias("profile_key"), k.alias("version"))
    return inventory.effective_profiles(p, "tenant-1").select("profile_key", "tenant_id", "version")


_CAND = ("s AS (SELECT 'f-' || s_suppkey AS fingerprint, ['new', 'promoted', 'ignored'][s_suppkey % 3 + 1] AS status, CASE WHEN s_suppkey % 2 = 0 THEN 'a-' || s_suppkey END AS address, TIMESTAMP '2024-01-01' AS first_seen, TIMESTAMP '2024-01-02' AS last_seen FROM supplier), "
         "n AS (SELECT 'f-' || (o_custkey % 300) AS fingerprint, arg_max(CASE WHEN o_orderkey % 2 = 0 THEN 'b-' || o_orderkey END, o_orderkey) FILTER (o_orderkey % 2 = 0) AS address, arg_max(o_orderkey % 2 = 0, o_orderkey) AS given, "
         "max(TIMESTAMP '2023-12-31' + to_minutes(o_orderkey)) AS last_seen, max(o_orderkey) AS k FROM orders GROUP BY 1)")


@register("upsert_candidates", f"WITH {_CAND} SELECT coalesce(s.fingerprint, n.fingerprint) AS fingerprint, coalesce(status, 'new') AS status, "
          "coalesce(CASE WHEN k % 2 = 0 THEN 'b-' || k END, s.address) AS address, coalesce(s.first_seen, n.last_seen) AS first_seen, greatest(s.last_seen, n.last_seen) AS last_seen FROM s FULL JOIN n ON s.fingerprint = n.fingerprint")
def _candidates_upsert(spark, sf_dir):
    k, o = F.col("s_suppkey"), F.col("o_orderkey")
    stored = _table(spark, sf_dir, "supplier").select(F.lit("t").alias("tenant_id"), _c("f-", k).alias("fingerprint"), _of(k, "new", "promoted", "ignored").alias("status"), F.when(k % 2 == 0, _c("a-", k)).alias("address"),
        F.lit("2024-01-01").cast("timestamp").alias("first_seen"), F.lit("2024-01-02").cast("timestamp").alias("last_seen"))
    seen = _table(spark, sf_dir, "orders").select(F.lit("t").alias("tenant_id"), _c("f-", F.col("o_custkey") % 300).alias("fingerprint"), F.when(o % 2 == 0, _c("b-", o)).alias("address"),
        F.timestamp_seconds(F.unix_seconds(F.lit("2023-12-31").cast("timestamp")) + o * 60).alias("last_seen"))
    return inventory.upsert_candidates(stored, seen).drop("tenant_id")


@register("upsert_children", "WITH s AS (SELECT 'p-' || (s_suppkey % 20) AS parent, 'c-' || s_suppkey AS name, 's' || s_suppkey AS a, 'old' AS b FROM supplier), n AS (SELECT 'p-' || (k % 20) AS parent, 'c-' || k AS name, 'new' || k AS b FROM (SELECT DISTINCT l_suppkey * 2 AS k FROM lineitem)) "
          "SELECT coalesce(s.parent, n.parent) AS parent_id, coalesce(s.name, n.name) AS name, s.a AS a, coalesce(n.b, s.b) AS b FROM s FULL JOIN n ON s.parent = n.parent AND s.name = n.name")
def _children(spark, sf_dir):
    k = F.col("s_suppkey")
    own = lambda k, m: [F.lit("t").alias("tenant_id"), _c("p-", k % 20).alias("parent_id"), _c("c-", k).alias("name"), m.alias("attributes")]
    stored = _table(spark, sf_dir, "supplier").select(*own(k, F.create_map(F.lit("a"), _c("s", k), F.lit("b"), F.lit("old"))))
    found = _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).alias("k")).distinct().select(*own(F.col("k"), F.create_map(F.lit("b"), _c("new", F.col("k")))))
    out = inventory.upsert_children(stored, found)
    return out.select("parent_id", "name", F.try_element_at("attributes", F.lit("a")).alias("a"), F.try_element_at("attributes", F.lit("b")).alias("b"))


@register("group_members_added", "SELECT 'g-' || (c_custkey % 4) AS group_id, 'user-' || c_custkey AS resource_id FROM customer UNION SELECT 'g-' || (o_custkey % 6), 'user-' || o_custkey FROM orders")
def _added(spark, sf_dir):
    new = _table(spark, sf_dir, "orders").select(F.lit("t").alias("tenant_id"), _c("g-", F.col("o_custkey") % 6).alias("group_id"), _c("user-", F.col("o_custkey")).alias("resource_id"))
    return inventory.add_members(_members(spark, sf_dir).withColumn("tenant_id", F.lit("t")), new).select("group_id", "resource_id")


@register("group_members_removed", "SELECT 'user-' || c_custkey AS resource_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 6 = o_custkey % 4)")
def _removed(spark, sf_dir):
    gone = _table(spark, sf_dir, "orders").select(F.lit("t").alias("tenant_id"), _c("g-", F.col("o_custkey") % 6).alias("group_id"), _c("user-", F.col("o_custkey")).alias("resource_id"))
    return inventory.remove_members(_members(spark, sf_dir).withColumn("tenant_id", F.lit("t")), gone).select("resource_id")


@register("facts_recorded", "SELECT 'user-' || c_custkey AS resource_id, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, 'vendor-' || (c_custkey % 4)) AS vendor FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND s_suppkey % 3 = c_custkey % 3")
def _facts(spark, sf_dir):
    k = F.col("s_suppkey")
    facts = _table(spark, sf_dir, "supplier").select(_c("tenant-", k % 3).alias("tenant_id"), _c("user-", k).alias("resource_id"), F.when(k % 2 == 0, F.col("s_name")).alias("vendor"))
    return inventory.record_facts(ad.resources(spark, sf_dir), facts, ("vendor",)).select("resource_id", "vendor")


@register("statuses_set", f"WITH {ad.RESOURCES} SELECT resource_id, CASE WHEN status IN ('maintenance', 'decommissioned') OR s_suppkey IS NULL THEN status ELSE 'down' END AS status FROM r LEFT JOIN supplier ON s_suppkey = c_custkey")
def _statuses(spark, sf_dir):
    k = F.col("s_suppkey")
    return inventory.set_status(ad.resources(spark, sf_dir), _table(spark, sf_dir, "supplier").select(_c("tenant-", k % 3).alias("tenant_id"), _c("user-", k).alias("resource_id"), F.lit("down").alias("status"))).select("resource_id", "status")


# --- topology ---
_N = ("SELECT 'd-' || (p_partkey % 40) AS seen_from, ['lldp', 'cdp', 'arp'][p_partkey % 3 + 1] AS protocol, CASE WHEN p_partkey % 3 = 0 THEN 'CH:' || (p_partkey % 90) WHEN p_partkey % 3 = 2 THEN 'm-' || (p_partkey % 30) END AS chassis_id, "
      "CASE WHEN p_partkey % 3 <> 2 AND p_partkey % 5 > 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'SW-' ELSE 'sw-' END || (p_partkey % 90 // 3) ELSE ' ' END AS sys_name, CASE WHEN p_partkey % 3 > 0 THEN '10.0.' || (p_partkey % 25) END AS mgmt_ip, 'port-' || p_partkey AS port, "
      "CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS platform FROM part")
_MERGED = (f"n AS ({_N}), c AS (SELECT seen_from, protocol, nullif(trim(chassis_id), '') AS chassis_id, nullif(trim(sys_name), '') AS sys_name, nullif(trim(mgmt_ip), '') AS mgmt_ip, port, platform FROM n), "
           "t AS (SELECT *, lower(sys_name) AS nm FROM c WHERE protocol <> 'arp' AND (chassis_id IS NOT NULL OR sys_name IS NOT NULL OR mgmt_ip IS NOT NULL)), "
           "nc AS (SELECT seen_from, nm, min(lower(chassis_id)) AS ch FROM t WHERE chassis_id IS NOT NULL AND nm IS NOT NULL GROUP BY 1, 2), "
           "k AS (SELECT t.*, coalesce(lower(t.chassis_id), ch, 'name:' || t.nm, 'ip:' || mgmt_ip) AS ky, CASE WHEN protocol = 'lldp' THEN '0' ELSE '1' END || port AS o FROM t LEFT JOIN nc ON nc.seen_from = t.seen_from AND nc.nm = t.nm), "
           "g AS (SELECT seen_from, max(protocol) AS protocol, arg_min(chassis_id, o) FILTER (chassis_id IS NOT NULL) AS chassis_id, arg_min(sys_name, o) FILTER (sys_name IS NOT NULL) AS sys_name, arg_min(mgmt_ip, o) FILTER (mgmt_ip IS NOT NULL) AS mgmt_ip, "
           "arg_min(port, o) AS port, arg_min(platform, o) FILTER (platform IS NOT NULL) AS platform FROM k GROUP BY seen_from, ky), "
           "a AS (SELECT seen_from, mgmt_ip, chassis_id FROM c WHERE protocol = 'arp' GROUP BY ALL), "
           "mg AS (SELECT seen_from, protocol, chassis_id, sys_name, mgmt_ip, port, platform FROM g UNION ALL SELECT seen_from, 'arp', chassis_id, NULL, mgmt_ip, NULL, NULL FROM a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.seen_from = a.seen_from AND g.mgmt_ip = a.mgmt_ip))")


def _neighbours(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when((k % 3 != 2) & (k % 5 > 0), _c(F.when(k % 2 == 0, "SW-").otherwise("sw-"), F.floor(k % 90 / 3))).otherwise(" ")
    return _table(spark, sf_dir, "part").select(
        _c("d-", k % 40).alias("seen_from"), _of(k, "lldp", "cdp", "arp").alias("protocol"), F.when(k % 3 == 0, _c("CH:", k % 90)).when(k % 3 == 2, _c("m-", k % 30)).alias("chassis_id"), name.alias("sys_name"),
        F.when(k % 3 > 0, _c("10.0.", k % 25)).alias("mgmt_ip"), _c("port-", k).alias("port"), F.when(k % 3 == 1, F.col("p_brand")).alias("platform"))


@register("neighbours_merged", f"WITH {_MERGED} SELECT seen_from, protocol, chassis_id, sys_name, mgmt_ip, CASE WHEN protocol <> 'arp' THEN port END AS port, platform FROM mg")
def _merged(spark, sf_dir):
    out = topology.merge_neighbours(_neighbours(spark, sf_dir))
    return out.withColumn("port", F.when(F.col("protocol") != "arp", F.col("port")))


_ON_RECORD = "ids AS (SELECT 'chassis_id' AS kind, 'ch:' || (i * 9) AS value, 'd-' || i AS rid FROM range(10) t(i) UNION ALL SELECT 'mgmt_ip', '10.0.' || i, 'd-' || (i + 3) FROM range(20) t(i) UNION ALL SELECT 'hostname', 'sw-' || i, 'd-' || (i % 7) FROM range(25) t(i))"
_IDENTIFIED = (f"{_MERGED}, {_ON_RECORD}, x AS (SELECT *, row_number() OVER () AS rn FROM mg), q AS (SELECT rn, 'chassis_id' AS kind, lower(chassis_id) AS value FROM x WHERE protocol <> 'arp' UNION ALL SELECT rn, 'mgmt_ip', mgmt_ip FROM x UNION ALL SELECT rn, 'hostname', lower(sys_name) FROM x), "
               "h AS (SELECT rn, min(rid) FILTER (kind = 'chassis_id') AS sure, count(DISTINCT rid) AS k, min(rid) AS one FROM q JOIN ids USING (kind, value) GROUP BY 1), "
               "d AS (SELECT x.*, CASE WHEN sure IS NOT NULL OR k = 1 THEN 'known' WHEN k > 1 THEN 'ambiguous' ELSE 'unknown' END AS match, coalesce(sure, one) AS rid FROM x LEFT JOIN h USING (rn))")


def _identified(spark, sf_dir):
    on_record = [("chassis_id", f"CH:{i * 9}", f"d-{i}") for i in range(10)] + [("mgmt_ip", f"10.0.{i}", f"d-{i + 3}") for i in range(20)] + [("hostname", f"sw-{i}", f"d-{i % 7}") for i in range(25)]
    return topology.identify_neighbours(topology.merge_neighbours(_neighbours(spark, sf_dir)), spark.createDataFrame(on_record, "kind string, value string, resource_id string"))


@register("neighbours_identified", f"WITH {_IDENTIFIED} SELECT seen_from, protocol, chassis_id, sys_name, mgmt_ip, match, CASE WHEN match = 'known' THEN rid END AS resource_id FROM d")
def _identified_neighbours(spark, sf_dir):
    return _identified(spark, sf_dir).drop("port", "platform")


@register("neighbour_edges", f"WITH {_IDENTIFIED} SELECT DISTINCT least(seen_from, rid) AS source_id, greatest(seen_from, rid) AS target_id, protocol FROM d WHERE match = 'known' AND rid <> seen_from")
def _neighbour_edges(spark, sf_dir):
    return topology.neighbour_edges(_identified(spark, sf_dir))


@register("edges_upserted", "WITH s AS (SELECT s_suppkey % 30 AS a, 30 + s_suppkey % 20 AS b, TIMESTAMP '1995-01-01' AS f, TIMESTAMP '1995-06-01' AS l FROM supplier GROUP BY ALL), "
          "n AS (SELECT least(l_partkey % 50, l_suppkey % 50) AS a, greatest(l_partkey % 50, l_suppkey % 50) AS b, min(l_shipdate) AS f, max(l_shipdate) AS l FROM lineitem WHERE l_partkey % 50 <> l_suppkey % 50 GROUP BY 1, 2) "
          "SELECT a AS source_id, b AS target_id, min(f) AS first_seen, max(l) AS last_seen FROM (SELECT * FROM s UNION ALL SELECT * FROM n) GROUP BY 1, 2")
def _edges_upserted(spark, sf_dir):
    k = F.col("s_suppkey")
    stored = _table(spark, sf_dir, "supplier").select((k % 30).alias("source_id"), (30 + k % 20).alias("target_id"), F.lit("1995-01-01").cast("timestamp_ntz").alias("first_seen"), F.lit("1995-06-01").cast("timestamp_ntz").alias("last_seen")).distinct()
    found = topology.undirected(_table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b"), F.col("l_shipdate").alias("seen_at")))
    return topology.upsert_edges(stored, found)


@register("descendants_in_sql", f"WITH RECURSIVE {ad.EDGES}, w AS (SELECT 'r-1' AS resource_id, 0 AS depth, ['r-1'] AS path UNION ALL SELECT g.source_id, depth + 1, list_append(path, g.source_id) FROM w JOIN g ON g.target_id = w.resource_id "
          "WHERE depth < 2 AND NOT list_contains(path, g.source_id)) SELECT resource_id, depth::INTEGER AS depth FROM w")
def _descendants_sql(spark, sf_dir):
    ad.edges(spark, sf_dir).createOrReplaceTempView("edges")
    spark.range(1).select(F.lit("r-1").alias("resource_id")).createOrReplaceTempView("roots")
    return topology.descendants_sql(spark, 2).select("resource_id", F.col("depth").cast("int").alias("depth"))


# --- identity ---
@register("identity_repeats", f"WITH {_IDENTITY}, h AS (SELECT o.obs_id, count(DISTINCT o.kind) AS asked, count(DISTINCT CASE WHEN i.resource_id IS NOT NULL THEN o.kind END) AS hit, min(i.resource_id) AS a, max(i.resource_id) AS b FROM obs o LEFT JOIN ids i USING (kind, value) GROUP BY 1) "
          "SELECT obs_id, a AS resource_id FROM h WHERE hit = asked AND a = b AND NOT EXISTS (SELECT 1 FROM contra WHERE contra.obs_id = h.obs_id)")
def _repeats(spark, sf_dir):
    return identity.resolve_observations(_observed(spark, sf_dir), _identifiers(spark, sf_dir)).where("reason = 'repeat'").select("obs_id", "resource_id")


_DECIDED = "d AS (SELECT 'user-' || o_custkey AS resource_id, ['review', 'merge', 'note', 'review', 'dismiss'][o_orderkey % 5 + 1] AS outcome, 'o-' || (o_custkey % 97) AS observed, o_orderdate AS decided_at, o_orderkey FROM orders)"


def _decisions(spark, sf_dir):
    o = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(F.lit(ad.TENANT).alias("tenant_id"), _c("user-", F.col("o_custkey")).alias("resource_id"), _of(o, "review", "merge", "note", "review", "dismiss").alias("outcome"),
        _c("o-", F.col("o_custkey") % 97).alias("observed"), F.col("o_orderdate").cast("timestamp").alias("decided_at"), o)


@register("pending_reviews", f"WITH {_DECIDED} SELECT o_orderkey, resource_id, observed, decided_at FROM d WHERE outcome = 'review' AND NOT EXISTS (SELECT 1 FROM d x WHERE x.outcome IN ('merge', 'split', 'dismiss', 'match', 'create') "
          "AND x.observed = d.observed AND x.decided_at >= d.decided_at) AND resource_id NOT IN (SELECT 'user-' || (s_suppkey * 3) FROM supplier)")
def _pending(spark, sf_dir):
    alias = _table(spark, sf_dir, "supplier").select(F.lit(ad.TENANT).alias("tenant_id"), _c("user-", F.col("s_suppkey") * 3).alias("historical_id"), F.lit("x").alias("current_id"))
    return identity.pending_reviews(_decisions(spark, sf_dir), alias).select("o_orderkey", "resource_id", "observed", "decided_at")


@register("same_observations", "WITH s AS (SELECT l_orderkey AS k, list(DISTINCT [l_returnflag, l_linestatus]) AS ids, list([l_linestatus, l_returnflag] ORDER BY l_linenumber) AS back FROM lineitem GROUP BY 1) "
          "SELECT k, list_sort(list_distinct(ids)) = list_sort(list_distinct(list_transform(back, lambda x: [x[2], x[1]]))) AND len(ids) = len(list_distinct(back)) AS same, list_sort(list_distinct(ids)) = list_sort(list_distinct(back)) AS swapped FROM s")
def _same(spark, sf_dir):
    pair = lambda a, b: F.struct(F.col(a).alias("kind"), F.col(b).alias("value"))
    s = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.collect_set(pair("l_returnflag", "l_linestatus")).alias("ids"), F.collect_list(pair("l_returnflag", "l_linestatus")).alias("again"), F.collect_list(pair("l_linestatus", "l_returnflag")).alias("back"))
    return s.select("k", identity.same_observation(F.col("ids"), F.col("again")).alias("same"), identity.same_observation(F.col("ids"), F.col("back")).alias("swapped"))


@register("resources_merged", "WITH i AS (SELECT 'mgmt_ip' AS kind, '10.0.0.' || s_suppkey AS value, 'user-' || (s_suppkey % 50) AS rid FROM supplier) SELECT value, CASE WHEN rid = 'user-3' THEN 'user-7' ELSE rid END AS resource_id FROM i")
def _resources_merged(spark, sf_dir):
    moved, _ = identity.merge_resources(_identifiers(spark, sf_dir).where("kind = 'mgmt_ip'"), _alias(spark, sf_dir), "user-3", "user-7", ad.TENANT)
    return moved.select("value", "resource_id")


@register("aliases_collapsed", "WITH a AS (SELECT 'old-' || s_suppkey AS historical_id, 'user-' || (s_suppkey * 3 + 1) AS current_id FROM supplier) SELECT historical_id, CASE WHEN current_id = 'user-4' THEN 'user-10' ELSE current_id END AS current_id FROM a UNION ALL SELECT 'user-4', 'user-10'")
def _collapsed(spark, sf_dir):
    return identity.add_alias(_alias(spark, sf_dir), ad.TENANT, "user-4", "user-10").select("historical_id", "current_id")


@register("resources_split", f"WITH {_IDENTITY} SELECT kind, value, CASE WHEN resource_id = 'user-2' AND kind = 'serial' THEN 'fresh' ELSE resource_id END AS resource_id FROM ids")
def _split(spark, sf_dir):
    return identity.split_resource(_identifiers(spark, sf_dir), ad.TENANT, "user-2", [("serial", "S2"), ("serial", "S3")], "fresh").select("kind", "value", "resource_id")


@register("provisional_names", f"WITH {_IDENTITY}, p AS (SELECT obs_id, max(value) FILTER (kind = 'hostname') AS h, max(value) FILTER (kind = 'serial') AS s, max(value) FILTER (kind = 'mgmt_ip') AS ip, max(value) FILTER (kind = 'service_name') AS sv FROM obs GROUP BY 1) "
          "SELECT obs_id, coalesce(upper(h), s, ip) AS name, 'device' AS kind FROM p")
def _provisional(spark, sf_dir):
    return identity.provisional(_observed(spark, sf_dir).withColumn("source", F.lit("syslog")))


@register("attributed_rows", f"WITH {ad.METRICS} SELECT CASE WHEN event_id % 4 = 0 THEN 'res-' || event_id ELSE '{fx.NIL}' END AS resource_id, metric FROM m")
def _attributed(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    outcomes = e.where("event_id % 4 = 0").select(F.col("event_id").alias("obs_id"), _c("res-", F.col("event_id")).alias("resource_id"))
    return identity.attribute(e.select(F.col("event_id").alias("obs_id"), F.lit("").alias("resource_id"), F.col("event_type").alias("metric")), outcomes).select("resource_id", "metric")


# --- alerts ---
_STATES = "s AS (SELECT 'r/user-' || c_custkey AS dedup_key, ['ok', 'pending', 'firing', 'resolved'][c_custkey % 4 + 1] AS phase, TIMESTAMP '2024-01-05 11:00:00' + to_minutes(c_custkey % 60) AS since, CASE WHEN c_custkey % 3 = 0 THEN 'me' END AS acknowledged_by, c_custkey FROM customer)"


def _states(spark, sf_dir):
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(_c("r/user-", k).alias("dedup_key"), _of(k, *alerts.PHASES).alias("phase"), F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-05 11:00:00").cast("timestamp")) + k % 60 * 60).alias("since"),
        F.when(k % 3 == 0, "me").alias("acknowledged_by"), F.lit("2024-01-05").cast("timestamp").alias("evaluated_at"), _c("rule-", k % 5).alias("rule_id"), _c("user-", k).alias("resource_id"))


@register("active_alerts", f"WITH {_STATES}, {ad.RESOURCES} SELECT dedup_key, phase, since, 'Rule ' || (s.c_custkey % 5) AS rule, ['warn', 'error'][s.c_custkey % 5 % 2 + 1] AS severity, name AS resource FROM s LEFT JOIN r ON r.c_custkey = s.c_custkey AND r.c_custkey % 2 = 0 "
          "WHERE phase IN ('pending', 'firing') ORDER BY CASE WHEN phase = 'firing' THEN 0 ELSE 1 END, since, dedup_key LIMIT 40")
def _active(spark, sf_dir):
    rules = spark.createDataFrame([(f"rule-{i}", f"Rule {i}", ("warn", "error")[i % 2]) for i in range(5)], "rule_id string, name string, severity string")
    named = ad.resources(spark, sf_dir).where(F.substring("resource_id", 6, 20).cast("long") % 2 == 0)
    return alerts.active_alerts(_states(spark, sf_dir), rules, named).select("dedup_key", "phase", "since", "rule", "severity", "resource").limit(40)


_QUIET = f"""b AS (SELECT 'r/' || resource_id AS dedup_key, max(value) > 60 AS breaching, max(user_id) AS u FROM (SELECT *, split_part(resource_id, '-', 2)::BIGINT AS user_id FROM m) WHERE tenant_id = 'tenant-1' GROUP BY 1),
p AS (SELECT b.*, phase AS was, since, CASE WHEN breaching THEN CASE WHEN phase = 'firing' THEN 'firing' WHEN phase = 'pending' AND epoch({_NOW}) - epoch(since) >= 1800 THEN 'firing' ELSE 'pending' END WHEN phase = 'firing' THEN 'resolved' ELSE 'ok' END AS now_phase FROM b LEFT JOIN s USING (dedup_key) WHERE u % 5 <> 0),
t AS (SELECT dedup_key, now_phase AS phase, CASE WHEN breaching AND (was = 'firing' OR was = 'pending' AND now_phase = 'pending') THEN since ELSE {_NOW} END AS since, ((now_phase = 'firing' AND was IS DISTINCT FROM 'firing') OR now_phase = 'resolved') AND u % 7 <> 0 AS notify, now_phase IN ('pending', 'firing') OR coalesce(was IN ('pending', 'firing'), false) AS write FROM p)"""


def _quiet_cycle(spark, sf_dir):
    u = F.substring("resource_id", 6, 20).cast("long")
    m = ad.metrics(spark, sf_dir).where("tenant_id = 'tenant-1'").groupBy(_c("r/", F.col("resource_id")).alias("dedup_key"), u.alias("u")).agg((F.max("value") > 60).alias("breaching"))
    readings = m.select("dedup_key", "breaching", F.lit(1800.0).alias("hold_seconds"), (F.col("u") % 5 == 0).alias("suppressed"), (F.col("u") % 7 == 0).alias("muted"))
    return alerts.advance(_states(spark, sf_dir), readings, NOW)


@register("alert_cycle_quiet", f"WITH {ad.METRICS}, {_STATES}, {_QUIET} SELECT * FROM t")
def _cycle_quiet(spark, sf_dir):
    return _quiet_cycle(spark, sf_dir)


@register("alert_states_upserted", f"WITH {ad.METRICS}, {_STATES}, {_QUIET} SELECT coalesce(s.dedup_key, t.dedup_key) AS dedup_key, coalesce(t.phase, s.phase) AS phase, coalesce(t.since, s.since) AS since, CASE WHEN t.phase IS NULL OR t.phase = s.phase THEN acknowledged_by END AS acknowledged_by, "
          f"CASE WHEN t.phase IS NULL THEN TIMESTAMP '2024-01-05' ELSE {_NOW} END AS evaluated_at FROM s FULL JOIN (SELECT * FROM t WHERE write) t ON s.dedup_key = t.dedup_key")
def _states_upserted(spark, sf_dir):
    return alerts.upsert_states(_states(spark, sf_dir), _quiet_cycle(spark, sf_dir), NOW).select("dedup_key", "phase", "since", "acknowledged_by", "evaluated_at")


_EVAL = (("hot", "view", "avg", "gt", ">", 50.0, 6), ("many", "click", "count", "gte", ">=", 2.0, 6), ("low", "view", "min", "lt", "<", 10.0, 6), ("peak", "view", "max", "lte", "<=", 90.0, 24), ("sum", "view", "sum", "ne", "<>", 0.0, 6))


@register("alert_evaluation", f"WITH {ad.METRICS}, {ad.RESOURCES}, x AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS rule_id, resource_id, {fn}({'*' if fn == 'count' else 'value'})::DOUBLE AS value, {fn}({'*' if fn == 'count' else 'value'}) {sign} {bound} AS breaching FROM m WHERE tenant_id = 'tenant-1' AND metric = '{metric}' AND observed_at >= {_NOW} - INTERVAL {h} HOUR AND observed_at < {_NOW} GROUP BY 2"
    for n, metric, fn, _, sign, bound, h in _EVAL) + f" UNION ALL SELECT 'gone', r.resource_id, coalesce((epoch_us({_NOW}) // 1000 - epoch_us(seen) // 1000) / 1000.0, 3601.0), coalesce((epoch_us({_NOW}) // 1000 - epoch_us(seen) // 1000) / 1000.0, 3601.0) > 3600 FROM r LEFT JOIN (SELECT resource_id, max(observed_at) AS seen "
    f"FROM m WHERE tenant_id = 'tenant-1' AND observed_at >= {_NOW} - INTERVAL 1 HOUR AND observed_at < {_NOW} GROUP BY 1) h USING (resource_id) WHERE r.tenant_id = 'tenant-1' AND kind = 'building') SELECT rule_id, resource_id, rule_id || '/' || resource_id || '/' AS dedup_key, round(value, 6) AS value, breaching FROM x")
def _evaluated(spark, sf_dir):
    def window(hours):
        return {"start": (NOW - timedelta(hours=hours)).isoformat(), "end": NOW.isoformat()}

    rules = [alerts.Rule(n, Query.from_json({"signal": "metric", "time": window(h), "filter": _cmp("metric", "eq", metric), "aggregations": [_agg(fn, "v", None if fn == "count" else "value")]}), alerts.Condition("threshold", op, bound)) for n, metric, fn, op, _, bound, h in _EVAL if h == 6]
    # a window of more than six hours is served by a rollup
    rules += [alerts.Rule(n, Query.from_json({"signal": "metric", "time": window(h), "filter": _cmp("metric", "eq", metric), "aggregations": [_agg(fn, "v", "value")]}), alerts.Condition("threshold", op, bound)) for n, metric, fn, op, _, bound, h in _EVAL if h > 6]
    rules.append(alerts.Rule("gone", Query.from_json({"signal": "metric", "time": window(1), "resources": {"type": "kind", "kind": "building"}}), alerts.Condition("absence", after_seconds=3600)))
    return alerts.evaluate(Engine(ad.tables(spark, sf_dir), Catalog(ad.resources(spark, sf_dir))), TenantScope(ad.TENANT), rules, NOW).select("rule_id", "resource_id", "dedup_key", "value", "breaching")


@register("suppressions_by_group", "WITH w AS (SELECT s_suppkey AS k, 'g-' || (s_suppkey % 4) AS target, s_suppkey % 3 = 0 AS a, s_suppkey % 5 = 0 AS n FROM supplier WHERE s_suppkey % 4 < 2) "
          "SELECT 'user-' || c_custkey AS resource_id, bool_or(a) AS alerts, bool_or(n) AS notifications FROM w JOIN customer ON target = 'g-' || (c_custkey % 4) GROUP BY 1")
def _quiet_groups(spark, sf_dir):
    k = F.col("s_suppkey")
    w = _table(spark, sf_dir, "supplier").where(k % 4 < 2).select(k.alias("window_id"), F.lit("t").alias("tenant_id"), F.lit("group").alias("target_kind"), _c("g-", k % 4).alias("target_id"), (k % 3 == 0).alias("suppress_alerts"), (k % 5 == 0).alias("suppress_notifications"))
    return alerts.suppressions(maintenance.silenced(w, ad.resources(spark, sf_dir).withColumn("tenant_id", F.lit("t")), _members(spark, sf_dir).withColumn("tenant_id", F.lit("t"))))


# --- polling and discovery ---
_READ = "q AS (SELECT s_suppkey AS device_id, '1.3.6.' || m AS oid, 'm' || m AS metric FROM supplier, range(3) t(m)), g AS (SELECT l_suppkey AS device_id, '1.3.6.' || (l_linenumber % 4) || CASE WHEN l_partkey % 2 = 0 THEN '.0' ELSE '' END AS oid, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def _scalars(spark, sf_dir):
    k = F.col("s_suppkey")
    asked = _table(spark, sf_dir, "supplier").select(k.alias("device_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("m")).select("device_id", _c("m", F.col("m")).alias("metric"), _c("1.3.6.", F.col("m")).alias("oid"), F.lit("1").alias("unit"))
    readings = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("device_id"), _c("1.3.6.", F.col("l_linenumber") % 4, F.when(F.col("l_partkey") % 2 == 0, ".0").otherwise("")).alias("oid")).agg(F.max("l_quantity").alias("value"))
    return polling.scalar_rows(asked, readings.withColumn("observed_at", F.lit("2024-01-01").cast("timestamp")))


@register("scalar_rows", f"WITH {_READ} SELECT q.device_id, metric, round(coalesce(a.value, b.value), 6) AS value FROM q LEFT JOIN g a ON a.device_id = q.device_id AND a.oid = q.oid LEFT JOIN g b ON b.device_id = q.device_id AND b.oid = q.oid || '.0' WHERE a.value IS NOT NULL OR b.value IS NOT NULL")
def _scalar_rows(spark, sf_dir):
    return _scalars(spark, sf_dir)[0].select("device_id", "metric", "value")


@register("scalars_skipped", f"WITH {_READ} SELECT q.device_id, metric FROM q WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.device_id = q.device_id AND g.oid IN (q.oid, q.oid || '.0'))")
def _scalars_skipped(spark, sf_dir):
    return _scalars(spark, sf_dir)[1].select("device_id", "metric")


@register("latency_rank", "SELECT quantile_disc(value, 0.95) AS value FROM events")
def _rank(spark, sf_dir):
    return polling.nearest_rank(_table(spark, sf_dir, "events"), "value", 95)


@register("check_sentences", "SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_partkey % 2 = 0 THEN 'TCP port ' || l_suppkey ELSE 'ping' END || CASE WHEN l_quantity <= 10 THEN ' without an answer' WHEN l_linenumber > 1 THEN ' answered, attempt ' || l_linenumber ELSE ' answered' END AS said FROM lineitem")
def _sentences(spark, sf_dir):
    said = polling.check_sentence(F.when(F.col("l_partkey") % 2 == 0, "tcp").otherwise("icmp"), F.col("l_suppkey"), F.col("l_quantity") > 10, F.col("l_linenumber"))
    return _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), said.alias("said"))


@register("sighting_identifiers", "SELECT c_custkey AS k, 'mgmt_ip' AS kind, '10.1.' || c_custkey AS value FROM customer UNION ALL SELECT c_custkey, 'hostname', lower(c_name) FROM customer WHERE c_custkey % 3 > 0")
def _sightings(spark, sf_dir):
    k = F.col("c_custkey")
    own = polling.sighting_identifiers(_c("10.1.", k), F.when(k % 3 > 0, _c(" ", F.col("c_name"))).otherwise(" "))
    return _table(spark, sf_dir, "customer").select(k.alias("k"), F.inline(own))


@register("sweep_outcomes", "SELECT CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 9 = 0 THEN 'candidate' WHEN s_suppkey % 5 = 1 THEN 'merged' WHEN s_suppkey % 5 = 2 THEN 'for_review' ELSE 'created' END AS outcome, count(*) AS n FROM supplier GROUP BY 1")
def _swept(spark, sf_dir):
    k = F.col("s_suppkey")
    s = _table(spark, sf_dir, "supplier")
    return polling.sweep_outcomes(s.select(k.alias("obs_id"), (k % 4 != 0).alias("named"), (k % 9 == 0).alias("refused")), s.where(k % 5 > 0).select(k.alias("obs_id"), _of(k % 5 - 1, "match", "review", "create", "create").alias("outcome")))


@register("schedule_runs", "SELECT s_suppkey AS job_id, true AS spread, true AS apart FROM supplier")
def _schedule(spark, sf_dir):
    jobs = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("job_id"), F.lit(60).cast("long").alias("every"))
    own = polling.schedule(jobs, 600).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("tick")).alias("ticks"))
    gaps = F.transform(F.slice("ticks", 2, F.size("ticks")), lambda x, i: x - F.get("ticks", i))
    return own.select("job_id", F.col("n").between(9, 10).alias("spread"), F.forall(gaps, lambda g: g.between(60 - 12, 60 + 12)).alias("apart"))


@register("registry_of_addresses", "SELECT lower(printf('%06x', n_nationkey)) AS prefix, ['L', 'M'][n_nationkey % 2 + 1] AS registry, n_name AS organisation FROM nation WHERE n_nationkey % 5 > 0")
def _oui(spark, sf_dir):
    k = F.col("n_nationkey")
    lines = _table(spark, sf_dir, "nation").select(F.concat_ws("\t", F.when(k % 5 > 0, F.format_string("%06X", k)).otherwise("zz"), _of(k, "L", "M"), F.col("n_name")).alias("value"))
    return registry_files.oui_rows(lines)


# --- ingest ---
@register("otlp_metrics", "SELECT event_type AS metric, date_trunc('second', ts) AS observed_at, round(value, 6) AS value, 'host-' || user_id AS host, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'true' ELSE 'false' END END AS monotonic, CASE WHEN event_id % 3 = 0 THEN 'point' ELSE 'resource' END AS k FROM events WHERE event_id % 5 > 0")
def _otlp_metrics(spark, sf_dir):
    i = F.col("event_id")
    attr = lambda k, v: _c('{"key":"', F.lit(k), '","value":{"stringValue":"', v, '"}}')
    point = _c('{"timeUnixNano":"', F.unix_seconds(F.col("ts").cast("timestamp")), '000000000","asDouble":', F.col("value"), ',"attributes":[', F.when(i % 3 == 0, attr("k", F.lit("point"))).otherwise(""), "]}")
    body = F.when(i % 5 == 0, F.lit('"histogram":{"dataPoints":[]}')).when(i % 2 == 0, _c('"sum":{"isMonotonic":', F.when(i % 4 == 0, "true").otherwise("false"), ',"dataPoints":[', point, "]}")).otherwise(_c('"gauge":{"dataPoints":[', point, "]}"))
    payload = _c('{"resourceMetrics":[{"resource":{"attributes":[', attr("host.name", _c("host-", F.col("user_id"))), ",", attr("k", F.lit("resource")), ']},"scopeMetrics":[{"metrics":[{"name":"', F.col("event_type"), '",', body, "}]}]}]}")
    rows = otlp.metric_rows(_table(spark, sf_dir, "events").select(payload.alias("payload"), F.lit("2024-02-01").cast("timestamp").alias("received_at")))
    label = lambda k: F.try_element_at("labels", F.lit(k))
    return rows.select("metric", "observed_at", "value", label("host.name").alias("host"), label("otlp.monotonic").alias("monotonic"), label("k").alias("k"))


@register("otlp_unsupported", "SELECT ['histogram', 'exponential_histogram', 'summary'][event_id % 3 + 1] AS kind, count(*) AS n FROM events WHERE event_id % 4 > 0 GROUP BY 1")
def _unsupported(spark, sf_dir):
    i = F.col("event_id")
    body = F.when(i % 4 == 0, F.lit("gauge")).otherwise(_of(i, "histogram", "exponentialHistogram", "summary"))
    return otlp.unsupported_metrics(_table(spark, sf_dir, "events").select(_c('{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"x","', body, '":{"dataPoints":[]}}]}]}]}').alias("payload")))


@register("otlp_spans_rejected", "SELECT sum(event_id % 3)::BIGINT AS n FROM events")
def _spans(spark, sf_dir):
    payload = _c('{"resourceSpans":[{"scopeSpans":[{"spans":[', F.array_join(F.array_repeat(F.lit('{"name":"s"}'), (F.col("event_id") % 3).cast("int")), ","), "]}]}]}")
    return otlp.rejected_spans(_table(spark, sf_dir, "events").select(payload.alias("payload")))


@register("otlp_values", "SELECT event_id, '[' || event_id || ',' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ',{k=' || event_type || '}]' AS body, lower(printf('%032X', event_id)) AS trace_id, CASE WHEN event_id % 3 = 0 THEN 'record' ELSE 'resource' END AS k FROM events")
def _values(spark, sf_dir):
    i = F.col("event_id")
    body = _c('{"arrayValue":{"values":[{"intValue":"', i, '"},{"boolValue":', F.when(i % 2 == 0, "true").otherwise("false"), '},{"kvlistValue":{"values":[{"key":"k","value":{"stringValue":"', F.col("event_type"), '"}}]}}]}}')
    record = _c('{"timeUnixNano":"1","traceId":"', F.format_string("%032X", i), '","body":', body, ',"attributes":[', F.when(i % 3 == 0, F.lit('{"key":"k","value":{"stringValue":"record"}}')).otherwise(""), "]}")
    payload = _c('{"resourceLogs":[{"resource":{"attributes":[{"key":"k","value":{"stringValue":"resource"}}]},"scopeLogs":[{"logRecords":[', record, "]}]}]}")
    rows = otlp.log_rows(_table(spark, sf_dir, "events").select(payload.alias("payload"), F.lit("2024-02-01").cast("timestamp").alias("received_at")))
    return rows.select(F.conv(F.substring("trace_id", 17, 16), 16, 10).cast("long").alias("event_id"), "body", "trace_id", F.col("attributes")["k"].alias("k"))


def _messages(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("no priority here")).otherwise(F.format_string("<13>Jan  5 10:00:00 Host-%d %s[%d]: value", "user_id", "event_type", "user_id"))
    return syslog.parse(e.select("event_id", raw.alias("raw"), _c("10.0.0.", F.col("user_id")).alias("peer"), F.lit("2024-02-01").cast("timestamp").alias("received_at")))


@register("syslog_attributes", "SELECT event_id % 10 > 0 AS ok, CASE WHEN event_id % 10 > 0 THEN 'Host-' || user_id END AS host, CASE WHEN event_id % 10 > 0 THEN event_type END AS service, CASE WHEN event_id % 10 > 0 THEN user_id::VARCHAR END AS pid, '10.0.0.' || user_id AS peer, "
          "CASE WHEN event_id % 10 = 0 THEN 'no priority' END AS error, CASE WHEN event_id % 10 = 0 THEN 'true' END AS missing, '1' AS facility, CASE WHEN event_id % 10 = 0 THEN 'no priority here' ELSE 'value' END AS body FROM events")
def _attributes(spark, sf_dir):
    a = lambda k: F.try_element_at("attributes", F.lit(k))
    return syslog.log_rows(_messages(spark, sf_dir)).select(
        a("parse.error").isNull().alias("ok"), a("host.name").alias("host"), a("service.name").alias("service"), a("process.pid").alias("pid"), a("syslog.source.address").alias("peer"), a("parse.error").alias("error"),
        a("syslog.timestamp.missing").alias("missing"), a("syslog.facility").alias("facility"), "body")


@register("syslog_identifiers", "SELECT event_id AS obs_id, 'mgmt_ip' AS kind, '10.0.0.' || user_id AS value FROM events UNION ALL SELECT event_id, 'hostname', 'host-' || user_id FROM events WHERE event_id % 10 > 0")
def _syslog_identifiers(spark, sf_dir):
    return syslog.identifiers(_messages(spark, sf_dir), "event_id")


@register("syslog_framed", "SELECT user_id, event_id, '<13>' || event_type AS raw FROM events")
def _framed(spark, sf_dir):
    """Each user's messages as one stream, octet-counted for even users and lines for others."""
    e = _table(spark, sf_dir, "events")
    m = _c("<13>", F.col("event_type"), " ", F.col("event_id"))
    each = F.when(F.col("user_id") % 2 == 0, _c(F.length(m), " ", m)).otherwise(_c(m, "\r\n\n"))
    streams = e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(each)), "").cast("binary").alias("data"))
    return syslog.framed(streams).select("user_id", F.substring_index("raw", " ", -1).cast("long").alias("event_id"), F.substring_index("raw", " ", 1).alias("raw"))


@register("materialised_columns", f"WITH {ad.LOGS} SELECT doc_id % 7 AS k, host_name, service_name, count(*) AS n FROM l GROUP BY ALL")
def _materialised(spark, sf_dir):
    rows = ad.logs(spark, sf_dir).withColumn("trace_id", (F.col("doc_id") % 7).cast("string")).drop("host_name", "service_name")
    return tables.conform(rows, "logs").groupBy(F.col("trace_id").cast("long").alias("k"), F.nullif("host_name", F.lit("-")).alias("host_name"), "service_name").agg(F.count(F.lit(1)).alias("n"))


@register("json_lines", f"WITH {ad.METRICS} SELECT resource_id, metric, date_trunc('millisecond', observed_at) AS observed_at, round(value, 6) AS value, k FROM m WHERE {IN_DAY}")
def _json_lines(spark, sf_dir):
    own = ad.metrics(spark, sf_dir).where("tenant_id = 'tenant-1' AND observed_at >= TIMESTAMP '2024-01-05' AND observed_at < TIMESTAMP '2024-01-06'")
    back = tables.from_json_lines(tables.to_json_lines(tables.conform(own, "metrics")), "metrics")
    return back.select("resource_id", "metric", "observed_at", "value", F.col("labels")["k"].alias("k"))


@register("generated_logs", f"SELECT 'tenant-' || (i % 3) AS tenant_id, {list(generator.WHEEL)}[i % 14 + 1] AS severity, (i % 24)::SMALLINT AS facility, i % 100 = 0 AS common, i % 10000 = 0 AS mid, count(*) AS n FROM range(50000) t(i) GROUP BY ALL")
def _generated(spark, sf_dir):
    rows = generator.logs(spark, 50_000, datetime(2024, 1, 1, tzinfo=UTC))
    return rows.groupBy("tenant_id", "severity", "facility", F.contains("body", F.lit("needlecommon")).alias("common"), F.contains("body", F.lit("needlemid")).alias("mid")).agg(F.count(F.lit(1)).alias("n"))
