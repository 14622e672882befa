from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.operators import alerts, identity, inventory, maintenance, topology, views
from marlstone.plans.errors import Invalid

T0 = datetime(2026, 9, 1, tzinfo=UTC)


def test_noisy_or(spark):
    df = spark.createDataFrame([(1, 0.8), (1, 0.65), (2, 0.8), (2, 0.65), (2, 0.9), (3, 1.7)], "k int, c double")
    got = {r.k: r.p for r in df.groupBy("k").agg(identity.noisy_or(F.col("c")).alias("p")).collect()}
    assert got == pytest.approx({1: 0.93, 2: 0.993, 3: 1.0})
    assert df.select(identity.noisy_or_array(F.array(F.lit(0.8), F.lit(0.65)))).first()[0] == pytest.approx(0.93)


def observed(spark, rows):
    return spark.createDataFrame(rows, "obs_id string, tenant_id string, kind string, value string")


def test_identity_outcomes(spark):
    stored = spark.createDataFrame([("t", "mgmt_ip", "10.0.0.1", "r1"), ("t", "hostname", "rtr-01", "r1"), ("t", "serial", "S1", "r1"), ("t", "mac", "aa", "r2")], "tenant_id string, kind string, value string, resource_id string")
    rows = [("repeat", "mgmt_ip", "10.0.0.1"), ("repeat", "hostname", "RTR-01"), ("review", "mgmt_ip", "10.0.0.1"), ("review", "service_name", "x"), ("new", "mgmt_ip", "10.9.9.9"),
            ("replaced", "mgmt_ip", "10.0.0.1"), ("replaced", "serial", "S2"), ("merge", "mgmt_ip", "10.0.0.1"), ("merge", "hostname", "rtr-01"), ("merge", "serial", "S1"), ("merge", "service_name", "y")]
    obs = observed(spark, [(o, "t", k, v) for o, k, v in rows] + [("none", "t", None, None), ("foreign", "u", "serial", "S1")])
    got = {r.obs_id: (r.outcome, r.resource_id) for r in identity.resolve_observations(obs, stored).collect()}
    assert got == {"repeat": ("match", "r1"), "review": ("review", "r1"), "new": ("create", None), "replaced": ("create", None), "merge": ("match", "r1"), "none": ("create", None), "foreign": ("create", None)}
    batch = observed(spark, [("1", "t", "hostname", "sw-9"), ("2", "t", "hostname", "SW-9"), ("3", "t", "mac", "aa")])
    outcomes, after = identity.resolve_batch(batch, stored)
    ids = {r.obs_id: r.resource_id for r in outcomes.collect()}
    assert ids["1"] == ids["2"] and ids["3"] == "r2" and len(ids["1"]) == 36
    assert {r.resource_id for r in after.where("value = 'sw-9'").collect()} == {ids["1"]} and after.count() == 5
    moved, alias = identity.merge_resources(stored, spark.createDataFrame([], "tenant_id string, historical_id string, current_id string"), "r2", "r1", "t")
    assert {r.resource_id for r in moved.collect()} == {"r1"} and alias.first().historical_id == "r2"
    split = identity.split_resource(stored, "t", "r1", [("serial", "S1")], "r9")
    assert {(r.kind, r.resource_id) for r in split.collect()} == {("mgmt_ip", "r1"), ("hostname", "r1"), ("serial", "r9"), ("mac", "r2")}


def test_provisional_names(spark):
    rows = [("1", "service_name", "api", "otlp"), ("2", "otel_host_id", "h", "otlp"), ("3", "mgmt_ip", "1.2.3.4", "syslog"), ("3", "hostname", "sw", "syslog"), ("4", None, None, "snmp")]
    df = spark.createDataFrame(rows, "obs_id string, kind string, value string, source string")
    got = {r.obs_id: (r.name, r.kind) for r in identity.provisional(df).collect()}
    assert got == {"1": ("api", "service"), "2": ("h", "host"), "3": ("sw", "device"), "4": ("unidentified-snmp", "device")}


def test_pending_reviews(spark):
    d = spark.createDataFrame([("t", "r1", "review", "a", T0), ("t", "r1", "merge", "a", T0 + timedelta(1)), ("t", "r2", "review", "b", T0), ("t", "r3", "review", "c", T0)], "tenant_id string, resource_id string, outcome string, observed string, decided_at timestamp")
    alias = spark.createDataFrame([("t", "r3", "r2")], "tenant_id string, historical_id string, current_id string")
    assert [r.resource_id for r in identity.pending_reviews(d, alias).collect()] == ["r2"]


def test_neighbours_merge_and_are_identified(spark):
    rows = [("me", "lldp", "AA:01", "sw-1", None, "p1", None), ("me", "cdp", None, "SW-1", "10.0.0.1", "p2", "model"), ("me", "arp", "m1", None, "10.0.0.1", None, None), ("me", "arp", "m2", None, "10.0.0.7", None, None), ("me", "cdp", None, " ", None, "p", "x")]
    n = spark.createDataFrame(rows, "seen_from string, protocol string, chassis_id string, sys_name string, mgmt_ip string, port string, platform string")
    merged = {(r.protocol, r.chassis_id, r.mgmt_ip, r.port, r.platform) for r in topology.merge_neighbours(n).collect()}
    assert merged == {("lldp", "AA:01", "10.0.0.1", "p1", "model"), ("arp", "m2", "10.0.0.7", None, None)}
    ids = spark.createDataFrame([("chassis_id", "aa:01", "r1"), ("hostname", "sw-1", "r2"), ("mgmt_ip", "10.0.0.7", "r3")], "kind string, value string, resource_id string")
    got = {r.mgmt_ip: (r.match, r.resource_id) for r in topology.identify_neighbours(topology.merge_neighbours(n), ids).collect()}
    assert got == {"10.0.0.1": ("known", "r1"), "10.0.0.7": ("known", "r3")}
    two = ids.where("kind <> 'chassis_id'").withColumn("value", F.when(F.col("kind") == "mgmt_ip", "10.0.0.1").otherwise(F.col("value")))
    assert {r.match for r in topology.identify_neighbours(topology.merge_neighbours(n), two).collect()} == {"ambiguous", "unknown"}


def test_dedup_keys_escape(spark):
    labels = F.array(F.struct(F.lit("b").alias("k"), F.lit("x,y").alias("v")), F.struct(F.lit("a=").alias("k"), F.lit("\\").alias("v")))
    got = spark.range(1).select(alerts.dedup_key(F.lit("rule"), F.lit("res"), labels)).first()[0]
    assert got == "rule/res/a\\==\\\\,b=x\\,y"


def test_replay_agrees_with_the_cycle(spark):
    t = lambda s: T0 + timedelta(seconds=s)
    beats = [(0, True), (100, True), (299, True), (300, True), (400, True), (500, False), (600, False), (700, True), (710, False)]
    ev = spark.createDataFrame([("k", t(s), b, 300.0, False, False) for s, b in beats], "dedup_key string, at timestamp, breaching boolean, hold_seconds double, suppressed boolean, muted boolean")
    got = [(r.phase, r.notify) for r in alerts.replay(ev).orderBy("at").collect()]
    assert got == [("pending", False)] * 3 + [("firing", True), ("firing", False), ("resolved", True), ("ok", False), ("pending", False), ("ok", False)]
    quiet = alerts.replay(ev.withColumn("suppressed", F.col("at") >= F.lit(t(300)))).orderBy("at").collect()
    assert [r.phase for r in quiet] == ["pending"] * 3
    states = spark.createDataFrame([("k", "pending", t(0), "me", t(0))], "dedup_key string, phase string, since timestamp, acknowledged_by string, evaluated_at timestamp")
    moved = alerts.advance(states, ev.where("at = timestamp'2026-09-01 00:05:00'"), t(300))
    r = moved.first()
    assert (r.phase, r.notify, r.write) == ("firing", True, True)
    after = alerts.upsert_states(states, moved, t(300)).first()
    assert after.phase == "firing" and after.acknowledged_by is None


def test_notification_budget(spark):
    a = spark.createDataFrame([(i, "t", "c", T0 + timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 70, 200, 300))], "attempt_id long, tenant_id string, channel_id string, at timestamp")
    ch = spark.createDataFrame([("t", "c", True, 2)], "tenant_id string, channel_id string, enabled boolean, max_per_minute int")
    b = spark.createDataFrame([("t", 4)], "tenant_id string, budget_per_day int")
    got = [r.outcome for r in alerts.reserve(a, ch, b).orderBy("attempt_id").collect()]
    assert got == ["sent", "sent", "rate_limited", "sent", "sent", "over_budget"]
    assert alerts.reserve(a, ch.withColumn("enabled", F.lit(False)), b).count() == 0


def window(spark, **more):
    w = {"starts_at": datetime(2026, 3, 1, 1, 30, tzinfo=UTC), "duration_minutes": 60, "timezone": "Europe/London", "recurrence": "daily", "weekday": None, "day": None, "until": None} | more
    return spark.createDataFrame([tuple(w.values())], "starts_at timestamp, duration_minutes int, timezone string, recurrence string, weekday int, day int, until timestamp")


def is_open(spark, at, **more):
    return window(spark, **more).select(maintenance.is_open(F.lit(at).cast("timestamp"))).first()[0]


def test_maintenance_follows_local_time(spark):
    u = lambda *a: datetime(*a, tzinfo=UTC)
    assert is_open(spark, u(2026, 3, 10, 1, 45)) and not is_open(spark, u(2026, 3, 10, 2, 45))
    assert not is_open(spark, u(2026, 3, 29, 1, 45)), "01:30 does not happen that night"
    assert is_open(spark, u(2026, 7, 1, 0, 45)) and not is_open(spark, u(2026, 7, 1, 1, 45))
    assert is_open(spark, u(2026, 10, 25, 0, 45)), "the earlier of the two"
    assert not is_open(spark, u(2026, 2, 28, 1, 45))
    late = {"starts_at": u(2026, 3, 2, 23, 30), "duration_minutes": 120, "timezone": "UTC"}
    assert is_open(spark, u(2026, 3, 3, 0, 45), **late, recurrence="weekly", weekday=0) and not is_open(spark, u(2026, 3, 4, 0, 45), **late, recurrence="weekly", weekday=0)
    assert is_open(spark, u(2026, 3, 2, 23, 45), **late, recurrence="once") and not is_open(spark, u(2026, 3, 3, 23, 45), **late, recurrence="once")
    assert not is_open(spark, u(2026, 5, 2, 23, 45), **late | {"until": u(2026, 4, 1)})
    long = {"starts_at": u(2026, 3, 2), "duration_minutes": 7 * 24 * 60, "timezone": "UTC", "recurrence": "once"}
    assert is_open(spark, u(2026, 3, 3, 23), **long) and not is_open(spark, u(2026, 3, 5), **long), "only two days are looked at"
    for bad in ({"duration_minutes": 0}, {"duration_minutes": 8 * 24 * 60}, {"timezone": "Mars/Base"}, {"recurrence": "monthly", "day": 40}, {"until": u(2020, 1, 1)}):
        with pytest.raises(Invalid):
            maintenance.Schedule(**{"starts_at": u(2026, 3, 1), "duration_minutes": 60, "timezone": "UTC"} | bad).validate()


def test_upserts(spark):
    stored = spark.createDataFrame([("t", "f1", "ignored", "10.0.0.1", None, T0, T0)], "tenant_id string, fingerprint string, status string, address string, name string, first_seen timestamp, last_seen timestamp")
    seen = spark.createDataFrame([("t", "f1", None, "sw", T0 + timedelta(1)), ("t", "f2", "10.0.0.2", None, T0)], "tenant_id string, fingerprint string, address string, name string, last_seen timestamp")
    got = {r.fingerprint: (r.status, r.address, r.name) for r in inventory.upsert_candidates(stored, seen).collect()}
    assert got == {"f1": ("ignored", "10.0.0.1", "sw"), "f2": ("new", "10.0.0.2", None)}
    kids = spark.createDataFrame([("t", "p", "if1", {"a": "1", "b": "1"})], "tenant_id string, parent_id string, name string, attributes map<string,string>")
    new = spark.createDataFrame([("t", "p", "if1", {"b": "2"}), ("t", "p", "if2", {"c": "3"})], kids.schema)
    assert {r.name: r.attributes for r in inventory.upsert_children(kids, new).collect()} == {"if1": {"a": "1", "b": "2"}, "if2": {"c": "3"}}
    res = spark.createDataFrame([("t", "r", "v", None, None, "maintenance")], "tenant_id string, resource_id string, vendor string, model string, os_version string, status string")
    facts = spark.createDataFrame([("t", "r", None, "m", None)], "tenant_id string, resource_id string, vendor string, model string, os_version string")
    r = inventory.record_facts(res, facts).first()
    assert (r.vendor, r.model) == ("v", "m")
    assert inventory.set_status(res, spark.createDataFrame([("t", "r", "down")], "tenant_id string, resource_id string, status string")).first().status == "maintenance"
    m = spark.createDataFrame([("t", "g", "r1")], "tenant_id string, group_id string, resource_id string")
    more = spark.createDataFrame([("t", "g", "r1"), ("t", "g", "r2"), ("t", "g", "r2")], m.schema)
    assert inventory.add_members(m, more).count() == 2
    with pytest.raises(Invalid):
        inventory.check_tags({"": "x"})
    p = spark.createDataFrame([(None, "k", 3, "built-in"), ("t", "k", 1, "own"), ("t", "k", 2, "newer"), ("u", "k", 9, "foreign")], "tenant_id string, profile_key string, version int, body string")
    assert inventory.effective_profiles(p, "t").first().body == "newer"


def test_views_on_results(spark):
    counts = spark.createDataFrame([(T0, 2), (T0 + timedelta(minutes=10), 3)], "g0 timestamp, n long")
    dense = views.densify(counts, T0, T0 + timedelta(minutes=20), 300).orderBy("g0").collect()
    assert [r.n for r in dense] == [2, 0, 3, 0]
    res = spark.createDataFrame([(T0, "a", "x", 1.0), (T0, "b", "y", None)], "at timestamp, p string, q string, v double")
    assert [tuple(r)[1:] for r in views.series(res).collect()] == [("a · x", 1.0)]
    assert views.latest(res).first().value == 1.0


def test_windows_of_one_target_are_merged_before_its_resources(spark):
    """every window of a group was paired with every member."""
    w = spark.range(2_000).selectExpr("id AS window_id", "'t' AS tenant_id", "element_at(array('group', 'site', 'resource'), int(id % 3) + 1) AS target_kind",
        "CASE id % 3 WHEN 2 THEN concat('r', id % 40) ELSE concat('x', id % 2) END AS target_id", "id = 30 AS suppress_alerts", "nullif(id % 4 = 1, id % 5 = 0) AS suppress_notifications")
    res = spark.range(500).selectExpr("'t' AS tenant_id", "concat('r', id) AS resource_id", "concat('x', id % 3) AS site_id")
    members = spark.range(500).selectExpr("'t' AS tenant_id", "concat('x', id % 4) AS group_id", "concat('r', id) AS resource_id")
    merged = maintenance.silenced(w, res, members)
    assert merged.count() <= 3 * 500
    plain = lambda df: sorted(tuple(map(str, r)) for r in alerts.suppressions(df).collect())
    assert plain(merged) == plain(maintenance.covered(w, res, members))
