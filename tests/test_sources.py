import json
import socket
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.plans.errors import Invalid
from marlstone.sources import generator, otlp, polling, syslog
from marlstone.sources import tables as tb
from marlstone.sources.registry_files import Pattern, oui_registry, parse_yaml, profiles

T0 = datetime(2026, 1, 1, 0, 1, tzinfo=UTC)
DATA_START = T0


def parse(spark, *raws, now=T0):
    df = spark.createDataFrame([(i, r, now, "10.0.0.9") for i, r in enumerate(raws)], "i int, raw string, received_at timestamp, peer string")
    return syslog.parse(df).orderBy("i")


def test_syslog_messages(spark):
    raws = [
        "<34>Oct 11 22:14:15 mymachine su[123]: failed for lonvick", "<191>Jan  1 00:00:59 h app: x", "<192>x", "<034>x", "<>x", "no priority", "", None, "<13>short",
        "<13>2026-01-01T00:00:00 host x y", '<165>1 2003-10-11T22:14:15.003Z host.example.com evntslog - ID47 [ex@1 iut="3" p="a\\]b\\"c\\d"][k x="y"] ﻿An event',
        "<165>1 - - - - - - text only", "<165>1 nonsense h a p m - body", "<13>1 2026-01-01T00:00:00Z host app", '<13>1 2026-01-01T00:00:00Z h a p m [open x="y', "<13>Dec 31 23:59:59 old-host just words here",
    ]
    r = parse(spark, *raws).collect()
    assert (r[0].facility, r[0].severity, r[0].hostname, r[0].app_name, r[0].proc_id, r[0].body, r[0].parse_error) == (4, "critical", "mymachine", "su", "123", "failed for lonvick", None)
    assert r[0].timestamp == datetime(2025, 10, 11, 22, 14, 15) and (r[1].facility, r[1].severity, r[1].body) == (23, "debug", "x")
    assert [x.parse_error for x in r[2:6]] == ["no priority"] * 4 and r[2].body == "<192>x" and r[2].severity == "notice" and r[2].facility == 1
    assert [x.parse_error for x in r[6:10]] == ["empty message"] * 2 + ["rfc3164: too short for a timestamp", "rfc3164: unreadable timestamp"]
    assert r[10].structured_data == {"ex@1.iut": "3", "ex@1.p": 'a]b"c\\d', "k.x": "y"} and r[10].body == "An event" and r[10].msg_id == "ID47" and r[10].proc_id is None
    assert r[11].body == "text only" and r[11].timestamp is None and r[11].parse_error is None
    assert r[12].parse_error == "rfc5424: unreadable timestamp" and r[12].body == "body" and r[13].parse_error == "rfc5424: header ended early" and r[13].app_name == "app"
    assert r[14].parse_error == "rfc5424: unterminated structured data" and r[15].timestamp == datetime(2025, 12, 31, 23, 59, 59) and r[15].body == "just words here" and r[15].app_name is None
    rows = syslog.log_rows(parse(spark, *raws)).collect()
    assert rows[0].attributes["host.name"] == "mymachine" and rows[0].attributes["syslog.source.address"] == "10.0.0.9" and rows[10].attributes["syslog.sd.k.x"] == "y"
    assert rows[11].attributes["syslog.timestamp.missing"] == "true" and rows[2].attributes["parse.error"] == "no priority"
    ids = syslog.identifiers(parse(spark, raws[0].replace("mymachine", "MyMachine")), "i").collect()
    assert {(x.kind, x.value) for x in ids} == {("mgmt_ip", "10.0.0.9"), ("hostname", "mymachine")}


def test_framing(spark):
    assert syslog.frames(b"<3>up\n\r\n<4>down\r\nrest") == (["<3>up", "<4>down"], b"rest", None)
    assert syslog.frames(b"5 <3>up6 <4>dow3 <") == (["<3>up", "<4>dow"], b"3 <", None)
    for bad, error in ((b"12x y", "count"), (b"9" * 30, "count"), (b"70000 x", "long"), (b"x" * 70_000, "long"), (b"x" * 70_000 + b"\n<1>a\n", "long")):
        got, rest, why = syslog.frames(bad)
        assert got == [] and rest == bad and error in why
    # what comes before an error counts, and the loss is told
    assert syslog.frames(b"5 hello5 world99999999 x") == (["hello", "world"], b"99999999 x", "a frame is too long")
    rows = [(1, bytearray(b"<1>a\n<2>\xff\nlast")), (2, bytearray(b"5 hello5 worldx")), (3, bytearray(b"9 half")), (4, None)]
    df = spark.createDataFrame(rows, "i int, data binary")
    assert [(r.i, r.raw) for r in syslog.framed(df).orderBy("i").collect()] == [(1, "<1>a"), (1, "<2>\ufffd"), (1, "last"), (2, "hello"), (2, "world")]
    assert [tuple(r) for r in syslog.unframed(df).orderBy("i").collect()] == [(2, "ends within a frame", 1), (3, "ends within a frame", 6)]
    assert [tuple(r) for r in syslog.unframed(spark.createDataFrame([(5, bytearray(b"2 ab3x cd"))], df.schema)).collect()] == [(5, "not an octet count", 5)]


def test_otlp(spark):
    logs = {"resourceLogs": [{"resource": {"attributes": [{"key": "host.name", "value": {"stringValue": "H"}}, {"key": "k", "value": {"intValue": "1"}}]}, "scopeLogs": [{"logRecords": [
        {"timeUnixNano": "0", "observedTimeUnixNano": "1000000000", "severityNumber": 17, "body": {"kvlistValue": {"values": [{"key": "a", "value": {"arrayValue": {"values": [{"boolValue": True}, {"doubleValue": 1.5}]}}}]}},
         "attributes": [{"key": "k", "value": {"stringValue": "2"}}], "traceId": "ABCD"}, {"body": {"stringValue": "x"}}]}]}]}
    df = spark.createDataFrame([(json.dumps(logs), T0)], "payload string, received_at timestamp")
    r = otlp.log_rows(df).orderBy("severity").collect()
    assert (r[0].severity, r[0].body, r[0].trace_id, r[0].attributes) == ("error", "{a=[true,1.5]}", "abcd", {"host.name": "H", "k": "2"})
    assert r[0].observed_at == datetime(1970, 1, 1, 0, 0, 1) and r[1].attributes["otlp.timestamp.missing"] == "true" and r[1].severity == "info"
    metrics = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [
        {"name": "g", "unit": "1", "gauge": {"dataPoints": [{"asDouble": 2.5, "timeUnixNano": "1000000000"}]}}, {"name": "s", "sum": {"isMonotonic": True, "dataPoints": [{"asInt": "7"}]}}, {"name": "h", "histogram": {"dataPoints": []}}]}]}]}
    df = spark.createDataFrame([(json.dumps(metrics), T0)], "payload string, received_at timestamp")
    got = {r.metric: (r.value, r.labels) for r in otlp.metric_rows(df).collect()}
    assert got == {"g": (2.5, {}), "s": (7.0, {"otlp.monotonic": "true"})}
    assert [tuple(r) for r in otlp.unsupported_metrics(df).collect()] == [("histogram", 1)]
    spans = spark.createDataFrame([('{"resourceSpans":[{"scopeSpans":[{"spans":[{},{}]}]}]}',)], "payload string")
    assert otlp.rejected_spans(spans).first().n == 2
    ids = df.select(otlp.identifiers(F.create_map(F.lit("host.name"), F.lit("H"), F.lit("host.id"), F.lit("1"))).alias("x")).first().x
    assert {(i.kind, i.value) for i in ids} == {("hostname", "h"), ("otel_host_id", "1")}


def test_polling(spark):
    req = spark.createDataFrame([("d", "up", "1.3.1", "s"), ("d", "cpu", "1.3.2", "1")], "device_id string, metric string, oid string, unit string")
    rd = spark.createDataFrame([("d", "1.3.1.0", 5.0, T0), ("d", "1.3.10", 6.0, T0)], "device_id string, oid string, value double, observed_at timestamp")
    got, skipped = polling.scalar_rows(req, rd)
    assert [(r.metric, r.value) for r in got.collect()] == [("up", 5.0)] and [r.metric for r in skipped.collect()] == ["cpu"]
    assert sorted(r.address for r in polling.sweep(spark, ["10.0.0.0/30", "10.0.0.1/32"]).collect()) == ["10.0.0.1", "10.0.0.2"]
    assert polling.sweep(spark, ["10.0.0.0/31"]).count() == 2
    for bad in ([], ["10.0.0.0/8"], ["x"], ["10.0.0.0/16", "10.1.0.0/16"]):
        with pytest.raises(Invalid):
            polling.sweep(spark, bad)
    a = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 1, False), (2, 4, True)], "check_id int, attempt int, ok boolean")
    assert {r.check_id: (r.up, r.attempt) for r in polling.reachability(a).collect()} == {1: (True, 2), 2: (False, None)}
    jobs = spark.createDataFrame([(str(i), 60) for i in range(50)], "job_id string, every long")
    runs = polling.schedule(jobs, 600)
    assert 450 <= runs.count() <= 500 and runs.select("tick").distinct().count() > 100


def test_yaml_profiles_patterns_and_registry(spark, tmp_path):
    text = "id: cisco\nmatch:\n  sysobjectid:\n    - 1.3.6.1.4.1.9  # all\nmetrics:\n  - name: cpu\n    oid: '1.3.1'\n    interval: 60\n  - name: mem\n"
    y = parse_yaml(text)
    assert y == {"id": "cisco", "match": {"sysobjectid": ["1.3.6.1.4.1.9"]}, "metrics": [{"name": "cpu", "oid": "1.3.1", "interval": 60}, {"name": "mem"}]}
    assert [tuple(r)[:2] for r in profiles(spark, {"a.yaml": text}).collect()] == [("cisco", "1.3.6.1.4.1.9")]
    df = spark.createDataFrame([("telemetry.t.log.syslog",), ("telemetry.t.metric.snmp",), ("telemetry.t",)], "s string")
    n = lambda p: df.where(Pattern(p).matches(F.col("s"))).count()
    assert (n("telemetry.>"), n("telemetry.*.log.*"), n("telemetry.t"), n("telemetry.t.>")) == (3, 1, 1, 2)
    for bad in ("", "a..b", "a.>.b", "a.b*"):
        with pytest.raises(Invalid):
            Pattern(bad)
    (tmp_path / "oui.tsv").write_text("00000A\tL\tOne\nbad\n0000001\tM\tTwo\n")
    assert {tuple(r) for r in oui_registry(spark, str(tmp_path)).collect()} == {("00000a", "L", "One"), ("0000001", "M", "Two")}


def test_tables_round_trip_and_prune(spark, tmp_path):
    rows = generator.logs(spark, 500, DATA_START, days=3)
    tb.write(rows, str(tmp_path), "logs")
    back = tb.read(spark, str(tmp_path), "logs")
    assert back.count() == 500 and back.where("body LIKE '%needlecommon%'").count() == 5
    plan = back.where((F.col("tenant_id") == "tenant-1") & (F.col("d") == F.lit(DATA_START.date())))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan
    lines = tb.to_json_lines(back.drop("d"))
    again = tb.from_json_lines(lines.unionByName(spark.createDataFrame([("not json",)], "value string")), "logs")
    assert again.count() == 500 and again.select(F.max("observed_at")).first() == back.select(F.max("observed_at")).first()
    assert tb.unreadable(spark.createDataFrame([("not json",)], "value string")).count() == 1
    assert generator.metrics(spark, 100, DATA_START).where("value IS NULL").count() == 0


def test_udp_source(spark):
    from marlstone.sources.receiver import SyslogUdpReader

    r = SyslogUdpReader({"capacity": "2"})
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for i in range(3):
        out.sendto(b"<13>m%d\n" % i, ("127.0.0.1", r.port))
    end = time.time() + 5
    while r.dropped < 1 and time.time() < end:
        time.sleep(0.01)
    rows, offset = r.read(r.initialOffset())
    assert [x[0] for x in rows] == ["<13>m0", "<13>m1"] and offset == {"at": 2} and r.dropped == 1
    r.commit(offset)
    assert list(r.readBetweenOffsets(offset, offset)) == []
    r.socket.close()


def test_streams(spark, tmp_path):
    from marlstone.streaming import jobs

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    metric = generator.metrics(spark, 200, DATA_START, days=1)
    metric.limit(120).write.parquet(src)
    stream = spark.readStream.schema(metric.schema).parquet(src)
    jobs.ingest(stream, out, "metrics", str(tmp_path / "ck")).awaitTermination(120)
    metric.orderBy(F.col("observed_at").desc()).limit(80).write.mode("append").parquet(src)
    jobs.ingest(stream, out, "metrics", str(tmp_path / "ck")).awaitTermination(120)
    assert jobs.read_batches(spark, out, "metrics").count() == 200
    for t in ("metrics_5m", "metrics_1h"):
        assert jobs.read_batches(spark, out, t).agg(F.sum("cnt")).first()[0] == 200
    ev = spark.createDataFrame([("k", T0 + timedelta(seconds=s), b, 60.0, False, False) for s, b in ((0, True), (60, True), (120, False))], "dedup_key string, at timestamp, breaching boolean, hold_seconds double, suppressed boolean, muted boolean")
    ev.coalesce(1).write.parquet(str(tmp_path / "ev"))
    checks = spark.createDataFrame([("r", T0, "up"), ("r", T0 + timedelta(1), "up"), ("r", T0 + timedelta(2), "down")], "resource_id string, at timestamp, status string")
    checks.coalesce(1).write.parquet(str(tmp_path / "st"))
    for name, run, source, want in (
        ("al", jobs.alert_stream, ev, ["pending", "firing", "resolved"]), ("ch", jobs.status_stream, checks, ["up", "down"]),
    ):
        q = run(spark.readStream.schema(source.schema).parquet(str(tmp_path / {"al": "ev", "ch": "st"}[name]))).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert [r[0] for r in spark.sql(f"SELECT {'phase' if name == 'al' else 'current_status'} FROM {name} ORDER BY at").collect()] == want


def test_retention_drops_whole_days(spark, tmp_path):
    from marlstone.streaming import jobs

    tb.write(generator.metrics(spark, 60, datetime(2026, 1, 1, tzinfo=UTC), days=3, tenants=1), str(tmp_path), "metrics")
    gone = jobs.expire(spark, str(tmp_path), "metrics", datetime(2026, 2, 1, 12, tzinfo=UTC))
    assert len(gone) == 1 and tb.read(spark, str(tmp_path), "metrics").select("d").distinct().count() == 2


def test_compaction_keeps_the_rows_and_merges_rollups(spark, tmp_path):
    from marlstone.sources.stored import compact
    from marlstone.streaming import jobs

    out, rows = str(tmp_path / "tables"), generator.metrics(spark, 400, T0, days=1, resources=5)
    for k in range(3):
        part = rows.where(F.pmod(F.hash("value"), F.lit(3)) == k)
        for name, own in [("metrics", part), *jobs._rollups(part, "metrics")]:
            tb.write(own, out, name, mode="overwrite", within=f"/batch={k}", parts=1)
    want = {n: sorted(map(str, _merged(jobs.read_batches(spark, out, n), n).collect())) for n in ("metrics", "metrics_5m", "metrics_1h")}
    before = jobs.read_batches(spark, out, "metrics_1h").count()
    for n in want:
        assert compact(spark, out, n) == 3 and compact(spark, out, n) == 1
        assert sorted(map(str, _merged(jobs.read_batches(spark, out, n), n).collect())) == want[n]
    assert jobs.read_batches(spark, out, "metrics_1h").count() < before


def _merged(df, name):
    from marlstone.operators.rollups import merge_metrics

    return df.select("resource_id", "metric", "observed_at", "value") if name == "metrics" else merge_metrics(df).withColumn("sum_v", F.round("sum_v", 6))


def test_structured_data_by_expression_is_that_of_the_reader(spark):
    cases = ['[a@1 k="v"] m', '[a@1 k="v" j="w"][b x="y"]tail', '[a@1] m', '[a@1 k="v\\]"] m', '[a@1 k="x]y"] m', '[a@1 k="1" k="2"] m', '[a@1 k="1"][a@1 k="2"] m', '[a@1 k="v" m', '[a@1 k=""] ', '[a@1 k="é ü"]', '[a b="c"]  two', '[x y="a\nb"] z', '-', '- m', '[]', '[ a="b"] m']
    rows = parse(spark, *[f"<13>1 2026-01-01T00:00:00Z h a p i {c}" for c in cases]).collect()
    for r, c in zip(rows, cases, strict=True):
        data, body, error = syslog.structured(c)
        assert (r.structured_data, r.body, r.parse_error) == (data, body, error), c
