from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.operators import identity, rollups, topology, views
from marlstone.operators.lower import Engine
from marlstone.operators.rate import with_delta, with_rate
from marlstone.operators.resolve import Catalog, already
from marlstone.plans.errors import Invalid, TenantMismatch
from marlstone.plans.scope import TenantScope
from marlstone.sources.tables import schema, with_rollups

T0 = datetime(2026, 9, 1, tzinfo=UTC)
A, B = TenantScope("a"), TenantScope("b")
DAY = {"start": "2026-09-01T00:00:00Z", "end": "2026-09-02T00:00:00Z"}


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def logs(spark, rows):
    """rows: (tenant, resource, seconds, ingest lag, severity, body)"""
    data = [(t, r, "s", at(s), at(s + lag), "syslog", "", sev, 1, body, {"host.name": r}, "", "", r, "") for t, r, s, lag, sev, body in rows]
    return spark.createDataFrame(data, schema("logs"))


def metrics(spark, rows):
    """rows: (tenant, resource, metric, seconds, value, labels)"""
    return spark.createDataFrame([(t, r, "s", m, at(s), at(s), float(v), "1", labels) for t, r, m, s, v, labels in rows], schema("metrics"))


@pytest.fixture(scope="module")
def engine(spark):
    bodies = ["%LINK-3-UPDOWN: changed state to down", "%SYS-5-CONFIG_I: configured from console", "interface reset", "Zoë_x"]
    own = [("a", f"r{i}", 60 * i, 1, s, b) for i, (s, b) in enumerate(zip(("error", "info", "warn", "emergency"), bodies, strict=True))]
    return Engine(with_rollups({"logs": logs(spark, [*own, ("b", "r0", 0, 1, "error", "changed state to down")])}))


def bodies(engine, scope=A, **more):
    return sorted(r.body for r in engine.query({"signal": "log", "time": DAY, **more}, scope).df.collect())


def text(mode, *terms):
    return {"op": "text", "field": {"field": "body"}, "mode": mode, "terms": list(terms)}


def test_text_modes(engine):
    assert len(bodies(engine, filter=text("all_token", "changed", "down"))) == 1
    assert bodies(engine, filter=text("any_token", "zzqx")) == []
    assert bodies(engine, filter=text("substring", "TERFACE res")) == ["interface reset"]
    assert bodies(engine, filter=text("any_token", "interf")) == []
    assert len(bodies(engine, filter=text("phrase", "state to", "down"))) == 1
    assert bodies(engine, filter=text("phrase", "to state")) == []
    assert bodies(engine, filter=text("any_token", "Zoë")) == ["Zoë_x"]
    got = engine.query({"signal": "log", "time": DAY, "filter": text("substring", "x")}, A)
    assert {w.kind for w in got.warnings} == {"full_tenant_scan", "not_index_accelerated"}


def test_tenants_are_apart_and_severities_ordered(engine):
    assert bodies(engine, B) == ["changed state to down"]
    cmp = lambda op, v: {"op": "compare", "field": {"field": "severity"}, "cmp": op, "value": v}
    assert len(bodies(engine, filter=cmp("gte", "warn"))) == 3 and len(bodies(engine, filter=cmp("lt", "warn"))) == 1
    with pytest.raises(Invalid):
        bodies(engine, filter=cmp("gt", "loud"))
    from marlstone.operators.lower import lower
    from marlstone.plans.ast import Query

    with pytest.raises(TenantMismatch):
        lower(Query.from_json({"signal": "log", "time": DAY}), A, already(B, ["r0"]), engine.tables)


def test_selector_that_matches_nothing_reads_nothing(engine):
    got = engine.query({"signal": "log", "time": DAY, "resources": {"type": "ids", "ids": []}}, A)
    assert got.df.count() == 0 and [w.kind for w in got.warnings] == ["selector_matched_nothing"]
    assert len(bodies(engine, resources={"type": "ids", "ids": ["r1", "r1", "r2"]})) == 2


def test_limits_offsets_and_columns(engine):
    got = engine.query({"signal": "log", "time": DAY, "limit": 20_000, "offset": 1, "order_by": [{"key": {"by": "field", "field": {"field": "observed_at"}}}]}, A)
    assert [r.resource_id for r in got.df.collect()] == ["r1", "r2", "r3"] and len(got.df.columns) == 13
    assert "limit_clamped" in {w.kind for w in got.warnings}
    assert got.to_json()["table"] == "logs"


def test_histogram_from_counts_keeps_the_first_bucket(engine):
    q = {"signal": "log", "time": {"start": "2026-09-01T00:02:00Z", "end": "2026-09-02T00:00:00Z"}, "aggregations": [{"func": "count", "alias": "c"}], "group_by": [{"field": "time_bucket", "seconds": 300}]}
    got = engine.query(q, A)
    assert got.table == "logs_counts_5m" and [r.c for r in got.df.collect()] == [4]


def test_tail_delivers_each_row_once(spark):
    e = Engine({"logs": logs(spark, [("a", "r", 0, 0, "info", "1"), ("a", "r", 5, 0, "info", "2"), ("a", "r", 10, 0, "info", "3"), ("a", "r", -115, 120, "info", "late"), ("b", "r", 1, 0, "info", "b")])})
    q = {"signal": "log", "time": DAY, "limit": 100}
    body = lambda p: [r[9] for r in p.rows()]
    one = e.tail(q, A, at(10), at(0))
    assert body(one) == ["2", "1", "late"] and one.complete and not one.skipped
    two = e.tail(q, A, at(20), one.next_since)
    assert body(two) == ["3"]
    assert body(e.tail(q, A, at(20), two.next_since)) == []
    assert e.tail(q, A, at(3 * 3600), at(0)).skipped
    with pytest.raises(Invalid):
        from marlstone.operators.lower import lower
        from marlstone.operators.resolve import whole_tenant
        from marlstone.plans.ast import Query

        lower(Query.from_json({**q, "aggregations": [{"func": "count", "alias": "c"}]}), A, whole_tenant(A), e.tables, tail=True)


def test_weighted_rollups(spark):
    m = metrics(spark, [("a", "r", "cpu", 120 * i, i + 1, {}) for i in range(24)])
    five = rollups.metric_rollup(m)
    hour = rollups.hourly(five).agg(F.sum("sum_v") / F.sum("cnt"), F.min("min_v"), F.max("max_v"), F.sum("cnt")).first()
    assert tuple(hour) == (12.5, 1.0, 24.0, 24)
    again = rollups.merge_metrics(five.unionByName(rollups.metric_rollup(metrics(spark, [("a", "r", "cpu", 1, 25, {})]))))
    assert again.agg(F.sum("cnt")).first()[0] == 25
    points = metrics(spark, [("a", "r", "cpu", 300 * i, i + 1, {}) for i in range(12)])
    q = {"signal": "metric", "time": {"start": "2026-08-01T00:00:00Z", "end": "2026-09-30T00:00:00Z"}, "aggregations": [{"func": "avg", "alias": "a", "field": {"field": "value"}}]}
    got = Engine(with_rollups({"metrics": points})).query(q, A)
    assert got.table == "metrics_1h" and got.df.first().a == 6.5 and got.warnings[0].kind == "downsampled"


def test_rates_never_go_back(spark):
    top = 2**32 - 1
    m = metrics(spark, [("a", "r", "if", 60 * i, v, {"i": "1"}) for i, v in enumerate((top - 3000, top - 1000, 1000, 3000))])
    rates = [r.rate for r in with_rate(m).orderBy("observed_at").collect()]
    assert rates[0] is None and rates[2] is None and rates[1] == rates[3] == pytest.approx(33.3333, abs=1e-3)
    two = metrics(spark, [("a", "r", "if", s, v, {"i": i}) for i, s, v in (("1", 0, 1000), ("1", 60, 2000), ("2", 0, 900_000), ("2", 60, 901_000))])
    assert two.count() == 4 and sorted(r.rate for r in with_rate(two).where("rate IS NOT NULL").collect()) == pytest.approx([16.6667] * 2, abs=1e-3)
    kinds = {r.delta for r in with_delta(m).collect()}
    assert kinds == {"first", "rate", "wrapped"}
    odd = metrics(spark, [("a", f"{x}-{y}-{gap}", "if", s, v, {}) for x in (0, 1, top) for y in (0, 5, top, 2.0**60) for gap in (0, 1, 600) for s, v in ((0, x), (gap, y))])
    assert with_rate(odd).where("rate < 0 OR isnan(rate)").count() == 0


def test_descendants_end_in_cycles(spark):
    e = spark.createDataFrame([("b", "a", "hosts"), ("c", "b", "runs"), ("a", "c", "depends_on"), ("d", "c", "member_of"), ("x", "a", "connected_to")], "source_id string, target_id string, kind string")
    root = spark.createDataFrame([("a",)], "resource_id string")
    depth = lambda n: {r.resource_id: r.depth for r in topology.descendants(e, root, n).collect()}
    assert depth(10) == {"a": 0, "b": 1, "c": 2, "d": 3} and depth(1) == {"a": 0, "b": 1}
    e.createOrReplaceTempView("edges")
    root.createOrReplaceTempView("roots")
    assert {r.resource_id: r.depth for r in topology.descendants_sql(spark, 10).collect()} == depth(10)


def test_catalog_resolves_aliases_groups_and_tags(spark):
    res = spark.createDataFrame([("a", "new", "device", "s1", {"env": "prod"}), ("a", "other", "host", "s2", {"env": "dev"}), ("b", "foreign", "device", "s1", {"env": "prod"})], "tenant_id string, resource_id string, kind string, site_id string, tags map<string,string>")
    alias = identity.add_alias(spark.createDataFrame([("a", "older", "old")], "tenant_id string, historical_id string, current_id string"), "a", "old", "new")
    assert sorted((r.historical_id, r.current_id) for r in alias.collect()) == [("old", "new"), ("older", "new")]
    members = spark.createDataFrame([("a", "g", "other")], "tenant_id string, group_id string, resource_id string")
    c = Catalog(res, alias, members)
    from marlstone.operators.resolve import resolve
    from marlstone.plans.ast import Selector

    ids = lambda sort, **args: resolve(Selector(sort, tuple(args.items())), A, c).ids
    assert ids("ids", ids=("old", "foreign", "nobody")) == ("new", "old", "older")
    assert ids("kind", kind="device") == ("new", "old", "older") and ids("group", group="g") == ("other",) and ids("group", group="none") == ()
    assert ids("tagged", key="env", value="dev") == ("other",) and ids("site", site="s2") == ("other",) and ids("all") is None
    for bad in (("tagged", {"key": "", "value": "x"}), ("descendants", {"root": "new", "max_depth": 0})):
        with pytest.raises(Invalid):
            ids(bad[0], **bad[1])
    with pytest.raises(ValueError, match="itself"):
        identity.add_alias(alias, "a", "x", "x")


def test_a_cycle_of_rules_is_one_table(spark):
    from marlstone.operators import alerts
    from marlstone.plans.ast import Query

    m = metrics(spark, [("a", "r1", "cpu", 0, 95, {}), ("a", "r2", "cpu", 0, 20, {}), ("b", "r9", "cpu", 0, 99, {})])
    e = Engine(with_rollups({"metrics": m}))
    q = Query.from_json({"signal": "metric", "time": DAY, "aggregations": [{"func": "max", "alias": "v", "field": {"field": "value"}}], "group_by": [{"field": "metric"}]})
    silent = Query.from_json({"signal": "metric", "time": DAY, "resources": {"type": "ids", "ids": ["r1", "r3"]}})
    rules = [alerts.Rule("hot", q, alerts.Condition("threshold", "gt", 90, 60)), alerts.Rule("gone", silent, alerts.Condition("absence", after_seconds=8 * 3600))]
    quiet = spark.createDataFrame([("r3", True, False)], "resource_id string, alerts boolean, notifications boolean")
    got = {(r.rule_id, r.resource_id): (r.breaching, r.suppressed) for r in alerts.evaluate(e, A, rules, at(60), quiet).collect()}
    assert got == {("hot", "r1"): (True, False), ("hot", "r2"): (False, False), ("gone", "r1"): (False, False), ("gone", "r3"): (True, True)}
    assert alerts.evaluate(e, A, rules[:1], at(60)).first().dedup_key == "hot/r1/metric=cpu"


def test_windows_that_end_within_a_bucket_have_nothing_after_it(spark):
    """the bucket of the end was counted whole."""
    steps = [0, 299, 300, 570, 599, 600, 3900, 4100, 4190, 4300]
    eng = Engine(with_rollups({"logs": logs(spark, [("a", "r", s, 1, "error", "x") for s in steps]), "metrics": metrics(spark, [("a", "r", "cpu", s, s, {}) for s in steps])}))
    for begin, end in ((310, 590), (0, 599), (0, 600), (0, 250), (120, 4195), (0, 4200)):
        q = {"signal": "log", "time": {"start": at(begin).isoformat(), "end": at(end).isoformat()}, "aggregations": [{"func": "count", "alias": "c"}]}
        assert eng.query(q, A).table == "logs_counts_5m"
        assert eng.query(q, A).df.first().c == sum(begin // 300 * 300 <= s < end for s in steps), (begin, end)
    for days, table, width in ((10, "metrics_5m", 300), (40, "metrics_1h", 3600)):
        for end in (250, 590, 3600, 4195, 4200, 4290):
            q = {"signal": "metric", "time": {"start": at(-days * 86_400).isoformat(), "end": at(end).isoformat()},
                 "aggregations": [{"func": "count", "alias": "c"}, {"func": "max", "alias": "m", "field": {"field": "value"}}, {"func": "avg", "alias": "a", "field": {"field": "value"}}]}
            got, want = eng.query(q, A), [s for s in steps if s < end]
            r = got.df.first()
            assert (got.table, r.c, r.m, r.a) == (table, len(want), max(want), sum(want) / len(want)), (days, end)
            q |= {"group_by": [{"field": "time_bucket", "seconds": width}], "aggregations": q["aggregations"][:1]}
            assert {int(x.g0.timestamp()) - int(T0.timestamp()): x.c for x in eng.query(q, A).df.collect()} == {b: sum(s // width * width == b for s in want) for b in {s // width * width for s in want}}


def test_all_that_report_are_counted(spark):
    """the number stopped at the greatest limit of a query's rows."""
    rows = spark.range(10_050).select(F.lit("a").alias("tenant_id"), F.concat(F.lit("r"), "id").alias("resource_id"), F.lit("cpu").alias("metric"), F.lit(at(5)).cast("timestamp").alias("observed_at"), F.lit(1.0).alias("value"))
    eng = Engine(with_rollups({"metrics": rows.unionByName(rows.limit(100))}))
    for end in (60, 7 * 86_400):
        assert views.reporting(eng, A, "cpu", T0, at(end)).first().n == 10_050
    assert views.reporting(eng, A, "mem", T0, at(60)).first().n == 0
