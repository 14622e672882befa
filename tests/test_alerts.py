"""Evaluation of many rules, against one rule at a time in plain Python."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.operators import alerts
from marlstone.operators.lower import Engine
from marlstone.operators.resolve import Catalog
from marlstone.plans.ast import Query
from marlstone.plans.errors import Invalid
from marlstone.plans.scope import TenantScope

NOW = datetime(2025, 3, 4, 5, 6, tzinfo=UTC)
SCOPE = TenantScope("t")


def rule(name, metric, minutes, func, op="gt", bound=0.0, hold=0, groups=()):
    q = {"signal": "metric", "time": {"start": (NOW - timedelta(minutes=minutes)).isoformat(), "end": NOW.isoformat()}, "aggregations": [{"func": func, "alias": "v", "field": None if func == "count" else {"field": "value"}}],
         "filter": {"op": "compare", "field": {"field": "metric"}, "cmp": "eq", "value": metric}, "group_by": [{"field": g} for g in groups]}
    return alerts.Rule(name, Query.from_json(q), alerts.Condition("threshold", op, bound, hold))


def silence(name, after, ids=None):
    q = {"signal": "metric", "time": {"start": (NOW - timedelta(hours=1)).isoformat(), "end": NOW.isoformat()}, "resources": {"type": "ids", "ids": ids} if ids is not None else {"type": "kind", "kind": "host"}}
    return alerts.Rule(name, Query.from_json(q), alerts.Condition("absence", after_seconds=after))


def engine(spark, samples, hosts):
    none = F.create_map().cast("map<string,string>")
    m = spark.createDataFrame(samples, "resource_id string, metric string, observed_at timestamp, value double")
    m = m.select(F.lit("t").alias("tenant_id"), "resource_id", F.lit("s").alias("site_id"), "metric", "observed_at", F.col("observed_at").alias("ingested_at"), "value", F.lit("").alias("unit"), none.alias("labels"))
    inventory = spark.createDataFrame([("t", h, "host", "s") for h in hosts] + [("u", "foreign", "host", "s")], "tenant_id string, resource_id string, kind string, site_id string")
    return Engine({"metrics": m}, Catalog(inventory))


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(8)
    samples = [(f"h{rng.randrange(12)}", rng.choice(["cpu", "mem"]), NOW - timedelta(seconds=rng.randrange(1, 3000)), float(rng.randrange(100))) for _ in range(600)]
    samples += [("old", "cpu", NOW - timedelta(minutes=40), 1.0)]
    return engine(spark, samples, [f"h{i}" for i in range(14)] + ["old"]), samples


OPS = {"gt": lambda x, y: x > y, "gte": lambda x, y: x >= y, "lt": lambda x, y: x < y, "lte": lambda x, y: x <= y, "eq": lambda x, y: x == y, "ne": lambda x, y: x != y}
FUNCS = {"count": len, "max": max, "min": min, "sum": sum, "avg": lambda v: sum(v) / len(v)}


def test_rules_read_as_one_by_one(some):
    eng, samples = some
    rules = [rule(f"r{i}", m, w, f, op, 50.0, 60) for i, (m, w, f, op) in enumerate((m, w, f, op) for m in ("cpu", "mem") for w in (5, 30) for f in FUNCS for op in OPS)]
    rules += [rule("by", "cpu", 30, "max", groups=("metric",)), silence("quiet", 600), silence("short", 10), silence("named", 600, ["h1", "h99", "foreign"])]
    assert len(alerts.shapes(rules, NOW)) == 4 + 1 + 3
    got = {}
    for r in alerts.evaluate(eng, SCOPE, rules, NOW).collect():
        got[r.rule_id, r.dedup_key] = (r.resource_id, r.value, r.breaching, r.hold_seconds, r.suppressed, r.muted)
    want = {}
    for r in rules[:-4]:
        a, c = r.query.aggregations[0], r.condition
        series = {}
        for h, m, at, v in samples:
            if m == r.query.filter.value and NOW - r.query.time.span <= at < NOW:
                series.setdefault(h, []).append(v)
        for h, v in series.items():
            x = float(FUNCS[a.func](v))
            want[r.rule_id, f"{r.rule_id}/{h}/"] = (h, pytest.approx(x), OPS[c.op](x, 50.0), 60.0, False, False)
    for h in {s[0] for s in samples if s[1] == "cpu" and s[2] >= NOW - timedelta(minutes=30)}:
        want["by", f"by/{h}/metric=cpu"] = got["by", f"by/{h}/metric=cpu"]
    for name, after, hosts in (("quiet", 600, [f"h{i}" for i in range(14)] + ["old"]), ("short", 10, [f"h{i}" for i in range(14)] + ["old"]), ("named", 600, ["h1"])):
        for h in hosts:
            ages = [(NOW - s[2]).total_seconds() for s in samples if s[0] == h and s[2] >= NOW - timedelta(seconds=max(after, 60))]
            age = min(ages) if ages else max(after, 60) + 1.0
            want[name, f"{name}/{h}/"] = (h, pytest.approx(age), age > after, 0.0, False, False)
    assert got == want


def test_many_rules_share_their_scans(some):
    eng, _ = some
    rules = [rule(f"r{i}", m, w, f, "gt", float(i)) for i, (m, w, f) in enumerate((m, w, f) for _ in range(20) for m in ("cpu", "mem") for w in (1, 2, 5, 10, 30) for f in FUNCS)]
    assert len(rules) == 1000 and len(alerts.shapes(rules, NOW)) == 10
    out = alerts.evaluate(eng, SCOPE, rules, NOW)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") <= 10 + 1
    assert out.select("rule_id").distinct().count() == 1000


def test_no_series_is_left_out(spark):
    hosts = [f"n{i:05}" for i in range(12_000)]
    samples = [(h, "cpu", NOW - timedelta(seconds=30), 1.0) for h in hosts]
    eng = engine(spark, samples, [*hosts, "gone"])
    out = alerts.evaluate(eng, SCOPE, [silence("quiet", 300), rule("busy", "cpu", 5, "max", "gte", 1.0), rule("few", "mem", 5, "max")], NOW)
    told = {r.rule_id: (r.series, r.breaching, r.truncated) for r in alerts.outcomes(out).collect()}
    assert told == {"quiet": (12_001, 1, True), "busy": (12_000, 12_000, True)}
    quiet = spark.createDataFrame([("n00007", True, False), ("n00008", False, True)], "resource_id string, alerts boolean, notifications boolean")
    under = alerts.evaluate(eng, SCOPE, [rule("busy", "cpu", 5, "max", "gte", 1.0)], NOW, quiet).where("suppressed OR muted").collect()
    assert {(r.resource_id, r.suppressed, r.muted) for r in under} == {("n00007", True, False), ("n00008", False, True)}
    with pytest.raises(Invalid):
        alerts.evaluate(eng, SCOPE, [], NOW)
