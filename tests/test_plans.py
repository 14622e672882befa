"""Planning as properties over generated queries; nothing here needs tables."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.operators import views
from marlstone.operators.alerts import Condition, age_phrase, check_rule, duration_phrase, evaluation_query, rule_sentence, shapes, step
from marlstone.operators.lower import compiles, tokenize
from marlstone.plans import planner, warnings
from marlstone.plans.ast import FUNCTIONS, PLAIN_FIELDS, Aggregation, Field, Query, attr, bucket, fingerprint, follow
from marlstone.plans.errors import FieldNotAvailable, Invalid, QueryError, RollupCannotServe, Unsupported

NOON = datetime(2021, 5, 17, 12, 41, 7, tzinfo=UTC)
SIGNALS = sorted(planner.BASE)
many = settings(max_examples=60, deadline=None)

names = st.text("abcdefgh_.", min_size=1, max_size=8)
aliases = st.from_regex("[a-z_][a-z0-9_]{0,6}", fullmatch=True)
scalars = st.one_of(st.integers(-9, 9), st.booleans(), names, st.floats(-1e6, 1e6))
moments = st.datetimes(datetime(2015, 1, 1), datetime(2030, 1, 1), timezones=st.just(UTC))


def fields(signal):
    plain = [f for f in PLAIN_FIELDS if (f in planner.EVERYWHERE or f in planner.OWN[signal]) and f != "rate"]
    return st.one_of(st.sampled_from(plain).map(lambda n: {"field": n}), names.map(lambda k: {"field": "attr", "key": k}))


def filters(signal):
    leaf = st.builds(lambda f, c, v: {"op": "compare", "field": f, "cmp": c, "value": v}, fields(signal), st.sampled_from(["eq", "ne"]), scalars)
    some = st.builds(lambda f, c, v: {"op": "compare", "field": f, "cmp": c, "value": v}, fields(signal), st.sampled_from(["in", "not_in"]), st.lists(scalars, min_size=1, max_size=3))
    known = names.map(lambda k: {"op": "exists", "field": {"field": "attr", "key": k}})
    leaves = [leaf, some, known]
    if signal == "log":
        leaves.append(st.builds(lambda m, t: {"op": "text", "field": {"field": "body"}, "mode": m, "terms": t}, st.sampled_from(["any_token", "all_token", "substring", "phrase"]), st.lists(names, min_size=1, max_size=2)))
    return st.recursive(st.one_of(leaves), lambda x: st.one_of(st.lists(x, min_size=1, max_size=3).flatmap(lambda of: st.sampled_from([{"op": "and", "of": of}, {"op": "or", "of": of}])), x.map(lambda e: {"op": "not", "of": e})), max_leaves=5)


selectors = st.one_of(
    st.just({"type": "all"}), st.lists(names, max_size=3).map(lambda x: {"type": "ids", "ids": x}), names.map(lambda k: {"type": "kind", "kind": k}), names.map(lambda k: {"type": "site", "site": k}),
    names.map(lambda k: {"type": "group", "group": k}), st.builds(lambda k, v: {"type": "tagged", "key": k, "value": v}, names, names), st.builds(lambda r, d: {"type": "descendants", "root": r, "max_depth": d}, names, st.integers(1, 5)),
)


@st.composite
def queries(draw, signal=None, counted=None):
    """A query that base tables can answer, in JSON."""
    signal = signal or draw(st.sampled_from(SIGNALS))
    start = draw(moments)
    q = {"signal": signal, "time": {"start": start.isoformat(), "end": (start + timedelta(seconds=draw(st.integers(1, 20_000)))).isoformat()}, "resources": draw(selectors), "limit": draw(st.integers(1, 30_000))}
    if draw(st.booleans()):
        q["filter"] = draw(filters(signal))
    if counted if counted is not None else draw(st.booleans()):
        q["aggregations"] = [{"func": "count", "alias": draw(aliases), "field": None}]
        groups = draw(st.lists(st.one_of(fields(signal), st.integers(1, 86_400).map(lambda s: {"field": "time_bucket", "seconds": s})), max_size=3))
        q["group_by"] = groups
        if draw(st.booleans()):
            q["order_by"] = [{"key": {"by": "alias", "alias": q["aggregations"][0]["alias"]}, "desc": draw(st.booleans())}]
    return q


def read(q, **more):
    return Query.from_json({**q, **more})


@many
@given(queries())
def test_json_and_back(q):
    own = read(q)
    assert Query.from_json(json.dumps(own.to_json())) == own
    planner.check(own)
    assert fingerprint(own, "t") == f"{q['signal']}:t" + ("+filter" if "filter" in q else "") + ("+agg" if "aggregations" in q else "")


@many
@given(queries(), st.sampled_from([{"signal": "weather"}, {"limit": -3}, {"limit": "many"}, {"filter": {"op": "nand"}}, {"resources": {"type": "nearby"}}, {"group_by": [{"field": "weight"}]}, {"order_by": [{"key": {"by": "mood"}}]},
                                   {"time": {"start": "noon", "end": "midnight"}}, {"aggregations": [{"func": "mode", "alias": "a", "field": None}]}]))
def test_what_is_no_query_is_invalid(q, wrong):
    with pytest.raises(Invalid):
        read(q, **wrong)


@many
@given(queries(counted=True), st.sampled_from(["limit", "alias", "bucket", "long bucket", "no groups", "order", "field of a count", "no field", "time"]))
def test_what_no_table_can_answer_is_refused(q, fault):
    count = q["aggregations"][0]
    wrong = {
        "limit": {"limit": 0}, "alias": {"aggregations": [count | {"alias": "Über"}], "order_by": []}, "bucket": {"group_by": [{"field": "time_bucket", "seconds": 0}]}, "long bucket": {"group_by": [{"field": "time_bucket", "seconds": 90_000}]},
        "no groups": {"aggregations": [], "order_by": [], "group_by": [{"field": "resource_id"}]}, "order": {"order_by": [{"key": {"by": "alias", "alias": count["alias"] + "x"}}]}, "field of a count": {"aggregations": [count | {"field": {"field": "resource_id"}}]},
        "no field": {"aggregations": [count | {"func": "sum"}]}, "time": {"time": {"start": q["time"]["end"], "end": q["time"]["start"]}},
    }[fault]
    with pytest.raises(QueryError):
        planner.check(read(q, **wrong))


def test_filters_that_say_nothing_are_refused(spark):
    base = {"signal": "log", "time": {"start": NOON.isoformat(), "end": (NOON + timedelta(hours=3)).isoformat()}}
    text = lambda f, *t: {"op": "text", "field": {"field": f}, "mode": "any_token", "terms": list(t)}
    compare = lambda f, c, v: {"op": "compare", "field": {"field": f}, "cmp": c, "value": v}
    for bad in (text("body", "  "), text("severity", "x"), compare("body", "in", []), compare("body", "lt", ["a"]), compare("rate", "gt", 1), compare("facility", "eq", float("inf")), compare("severity", "gt", "loud"),
                {"op": "exists", "field": {"field": "resource_id"}}, {"op": "or", "of": []}):
        with pytest.raises(QueryError):
            compiles(read(base, filter=bad))
    compiles(read(base, filter=compare("severity", "lte", "notice")))


@many
@given(st.sampled_from(SIGNALS), st.sampled_from(sorted(PLAIN_FIELDS)))
def test_a_field_is_on_its_signals_alone(signal, name):
    p = planner.TablePlan(planner.BASE[signal][0], "base", signal, "observed_at", planner.BASE[signal][1])
    if name in planner.EVERYWHERE or name in planner.OWN[signal]:
        assert planner.column_of(Field(name), p, []).name == name
    else:
        with pytest.raises(FieldNotAvailable):
            planner.column_of(Field(name), p, [])


@pytest.mark.parametrize("signal", ["trace", "flow"])
def test_signals_without_a_table(signal):
    with pytest.raises(Unsupported):
        planner.plan(read({"signal": signal, "time": {"start": NOON.isoformat(), "end": (NOON + timedelta(1)).isoformat()}}))


@many
@given(queries(signal="log", counted=True))
def test_counts_serve_what_they_have_and_nothing_else(q):
    own = read(q)
    used = [*own.group_by, *(own.filter.fields() if own.filter else ())]
    stored = all(f.name in ("resource_id", "severity") or f.name == "time_bucket" and f.seconds % 300 == 0 for f in used)
    p, told = planner.plan(own)
    assert p.table == ("logs_counts_5m" if stored else "logs") and not told
    start = p.window_start(own.time.start)
    assert start <= own.time.start and (own.time.start - start).total_seconds() < max(p.bucket_seconds, 1)
    assert not p.bucket_seconds or start.timestamp() % p.bucket_seconds == 0
    assert planner.plan(own, base=True)[0].table == "logs"


@many
@given(st.integers(1, 24 * 120), st.sampled_from(sorted(FUNCTIONS)), st.sampled_from(["value", "rate", "observed_at"]), st.sampled_from([None, 60, 300, 1800, 3600, 7200]), st.booleans())
def test_rollups_follow_the_window_or_refuse(hours, func, field, seconds, labelled):
    q = {"signal": "metric", "time": {"start": NOON.isoformat(), "end": (NOON + timedelta(hours=hours)).isoformat()}, "aggregations": [{"func": func, "alias": "a", "field": None if func == "count" else {"field": field}}],
         "group_by": [*([{"field": "time_bucket", "seconds": seconds}] if seconds else []), *([{"field": "attr", "key": "port"}] if labelled else [])]}
    table, width = ("metrics", 1) if hours <= 6 else ("metrics_5m", 300) if hours <= 720 else ("metrics_1h", 3600)
    can = hours <= 6 or func in planner.ROLLUP_FUNCTIONS and (func == "count" or field == "value") and not labelled and (seconds or width) % width == 0
    if can:
        p, told = planner.plan(read(q))
        assert p.table == table and [w.kind for w in told] == ([] if hours <= 6 else ["downsampled"])
    else:
        with pytest.raises(RollupCannotServe):
            planner.plan(read(q))


def test_warnings_speak():
    for w in (warnings.limit_clamped(12_345, 10_000), warnings.downsampled("metrics_1h", 3600), warnings.attribute_not_materialised("port"), warnings.not_index_accelerated("substring", "so"), warnings.FULL_TENANT_SCAN, warnings.SELECTOR_MATCHED_NOTHING):
        assert w.to_json()["warning"] == w.kind and len(w.message()) > 20


@many
@given(queries(signal="log"), moments, st.integers(1, 3000))
def test_following_windows_on_arrival(q, since, seconds):
    now = since + timedelta(seconds=seconds)
    own = follow(read(q), since, now)
    assert not own.is_aggregate and own.time.start <= since and own.time.end > now
    assert [f.name for f in own.filter.fields()].count("ingested_at") >= 2


@many
@given(moments, st.integers(0, 400 * 86_400))
def test_bars_fit_the_window(start, seconds):
    width = views.bucket_seconds(start, start + timedelta(seconds=seconds))
    assert width in views.BUCKET_STEPS and (seconds / width <= 60 or width == 86_400)
    assert width == 1 or seconds / views.BUCKET_STEPS[views.BUCKET_STEPS.index(width) - 1] > 60


@many
@given(queries(counted=True), moments, st.integers(1, 40 * 86_400))
def test_panels_and_facets_keep_the_rest(q, start, seconds):
    own, end = read(q), start + timedelta(seconds=seconds)
    panel = views.panel_query(own, start, end)
    assert panel.time.span == timedelta(seconds=seconds) and panel.filter == own.filter and panel.resources == own.resources
    assert all(f == bucket(views.bucket_seconds(start, end)) for f in panel.group_by if f.name == "time_bucket")
    facet = views.facet_query(own, attr("zone"))
    assert facet.group_by == (attr("zone"),) and facet.limit == views.FACET_LIMIT and facet.filter == own.filter
    assert views.histogram_query(own, 900).group_by == (bucket(900),)


def test_screens_order_and_buffer():
    assert views.display_order(["tenant_id", "weight", "severity", "summary"]) == ["severity", "summary", "weight"]
    shown = views.tail_buffer(list(range(900)), list(range(-300, 0)))
    assert len(shown) == 1000 and shown[:2] == [-300, -299] and views.tail_buffer([7], []) == [7]
    assert tokenize("eth0/1: größe=4kB") == ["eth0", "1", "größe", "4kB"]


@many
@given(st.lists(st.tuples(st.integers(1, 400), st.booleans()), min_size=1, max_size=30), st.integers(0, 900))
def test_a_breach_is_told_once_and_only_when_it_has_held(beats, hold):
    """The machine against the plain meaning: firing is being in breach for ``hold`` seconds without a break."""
    now, phase, since, begun, fired = NOON, None, None, None, False
    for wait, breaching in beats:
        now += timedelta(seconds=wait)
        begun = (begun or now) if breaching else None
        phase, since, told = step(phase, since, breaching, hold, now)
        held = breaching and (now - begun).total_seconds() >= hold
        assert (phase == "firing") == (held or breaching and fired)
        assert told == ((phase == "firing") != fired)
        assert phase == ("firing" if held or breaching and fired else "pending" if breaching else "resolved" if fired else "ok")
        fired = phase == "firing"


@many
@given(queries(signal="metric", counted=True), moments, st.integers(1, 7200))
def test_rules_read_up_to_now_by_resource(q, now, after):
    own = read(q, order_by=[])
    e = evaluation_query(own, Condition("threshold"), now)
    assert e.time.end == now and e.time.span == max(own.time.span, timedelta(minutes=1)) and e.group_by[0] == Field("resource_id")
    assert not any(f.name == "time_bucket" for f in e.group_by) and e.aggregations == own.aggregations
    a = evaluation_query(own, Condition("absence", after_seconds=after), now)
    assert a.aggregations == (Aggregation("max", "value", Field("observed_at")),) and a.time.span == timedelta(seconds=max(after, 60))


def test_rules_that_cannot_be_read_are_refused_and_others_described():
    day = {"signal": "log", "time": {"start": NOON.isoformat(), "end": (NOON + timedelta(1)).isoformat()}}
    two = [{"func": "count", "alias": x, "field": None} for x in "xy"]
    for q, c in ((read(day), Condition("absence", after_seconds=90)), (read(day, aggregations=two), Condition("threshold")), (read(day, resources={"type": "ids", "ids": ["a"]}), Condition("absence"))):
        with pytest.raises(Invalid):
            check_rule(q, c)
    with pytest.raises(Invalid):
        check_rule(read(day), Condition("threshold"), every_seconds=3)
    assert rule_sentence(read(day), Condition("threshold", "lte", 2.5, 7200)) == "number of log rows at most 2.5 for 2 hours"
    assert rule_sentence(read(day), Condition("absence", after_seconds=90)) == "no log for 1 minute"
    assert duration_phrase(59) == "59 seconds" and age_phrase(3 * 86_400 + 5) == "3d"
    assert shapes([], NOON) == []
