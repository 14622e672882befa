"""Alert rules: evaluation queries, the state machine, suppression, and notification budgets.

Rules of one shape (table, window, resources, filter, groups) share one scan and one aggregation, whatever they compute
and compare; the state machine is one pure function, folded over evaluations in order by the batch replay and by the
stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.lower import compiles
from marlstone.plans import planner
from marlstone.plans.ast import Aggregation, Field, Query, TimeRange
from marlstone.plans.errors import Invalid

VALUE = "value"
#: A rule that has as many series is told to be grouped too finely; none of them is left out.
MAX_SERIES = 10_000
LEAST_WINDOW = timedelta(minutes=1)
EPSILON = 2.220446049250313e-16
PHASES = ("ok", "pending", "firing", "resolved")


@dataclass(frozen=True)
class Condition:
    """A threshold on a value that must hold for some seconds, or absence for some seconds."""

    kind: str  # threshold or absence
    op: str = "gt"
    bound: float = 0.0
    for_seconds: int = 0
    after_seconds: int = 0

    @property
    def hold(self) -> int:
        return self.for_seconds if self.kind == "threshold" else 0


def holds(op: str, value: Column, bound: Column | float) -> Column:
    bound = bound if isinstance(bound, Column) else F.lit(float(bound))
    near = F.abs(value - bound) < EPSILON
    return {"gt": value > bound, "gte": value >= bound, "lt": value < bound, "lte": value <= bound, "eq": near, "ne": ~near}[op]


def breached(c: Condition, value: Column) -> Column:
    return holds(c.op, value, c.bound) if c.kind == "threshold" else value > F.lit(float(c.after_seconds))


def evaluation_query(q: Query, c: Condition, now: datetime) -> Query:
    """The stored query as it is evaluated: the same span up to now, one series a resource (and own groups).

    A query without an aggregate counts; groups by time go, as the window is the bucket.
    """
    span = timedelta(seconds=c.after_seconds) if c.kind == "absence" else q.time.span
    time = TimeRange(now - max(span, LEAST_WINDOW), now)
    if c.kind == "absence":
        aggregations, own = (Aggregation("max", VALUE, Field("observed_at")),), ()
    else:
        aggregations = q.aggregations or (Aggregation("count", VALUE),)
        own = tuple(f for f in q.group_by if f.name not in ("time_bucket", "observed_at", "ingested_at", "resource_id"))
    return replace(q, time=time, aggregations=aggregations, group_by=(Field("resource_id"), *own), order_by=(), limit=MAX_SERIES, offset=0)


def check_rule(q: Query, c: Condition, every_seconds: int = 60) -> None:
    """Raise what keeps a rule from being evaluated, when it is saved."""
    if not 10 <= every_seconds <= 86_400:
        raise Invalid("a rule is evaluated every 10 seconds to every day")
    if c.kind == "threshold" and len(q.aggregations) > 1:
        raise Invalid("a threshold needs one value: give one aggregation")
    if c.kind == "absence" and q.resources.type == "all":
        raise Invalid("absence needs named resources: the whole tenant has no fixed set")
    if c.kind == "absence" and c.after_seconds < 1:
        raise Invalid("absence needs a time")
    compiles(q)
    compiles(evaluation_query(q, c, q.time.end), base=c.kind == "absence")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    query: Query
    condition: Condition


@dataclass
class Shape:
    """Rules that are read off one query: what each computes is one of its aggregations."""

    query: Query
    absence: bool
    aggregations: list[Aggregation] = field(default_factory=list)
    rules: list[tuple[int, Rule]] = field(default_factory=list)

    def add(self, rule: Rule, a: Aggregation) -> None:
        a = replace(a, alias="")
        if a not in self.aggregations:
            self.aggregations.append(a)
        self.rules.append((self.aggregations.index(a), rule))

    @property
    def whole(self) -> Query:
        return replace(self.query, aggregations=tuple(replace(a, alias=f"v{i}") for i, a in enumerate(self.aggregations)))


def shapes(rules: list[Rule], now: datetime) -> list[Shape]:
    """Rules by what their evaluation reads, in the order in which shapes come up."""
    found: dict[tuple, Shape] = {}
    for r in rules:
        q, absence = evaluation_query(r.query, r.condition, now), r.condition.kind == "absence"
        key = (planner.plan(q, absence)[0].table, q.signal, q.time, q.resources, q.filter, q.group_by, absence)
        found.setdefault(key, Shape(q, absence)).add(r, q.aggregations[0])
    return list(found.values())


def evaluate(engine, scope, rules: list[Rule], now: datetime, quiet: DataFrame | None = None) -> DataFrame:
    """Readings of all rules as one table: (rule_id, resource_id, dedup_key, value, breaching, hold_seconds,
    suppressed, muted), for :func:`advance`.

    Each :class:`Shape` of rules is one branch of a union, which is joined with the rules once; a selector is resolved
    once. Every series counts, whatever their number; :func:`outcomes` tells which rules have too many. Absence reads base
    tables, whatever its window, as rollups keep no times. ``quiet`` are :func:`suppressions`.
    """
    from marlstone.operators.resolve import resolve

    if not rules:
        raise Invalid("no rules")
    out, table, resolved = None, [], {}
    for i, shape in enumerate(shapes(rules, now)):
        selector = shape.query.resources
        if selector not in resolved:
            resolved[selector] = resolve(selector, scope, engine.catalog)
        ids = resolved[selector].ids
        if shape.absence and ids is None:
            raise Invalid("absence needs named resources: the whole tenant has no fixed set")
        got = engine.query(shape.whole, scope, base=shape.absence, whole=True, ids=resolved[selector]).df
        table += [(i, a, r.rule_id, r.condition.kind, r.condition.op, float(r.condition.bound), float(r.condition.hold), float(r.condition.after_seconds)) for a, r in shape.rules]
        if shape.absence:
            expected = ids if isinstance(ids, DataFrame) else got.sparkSession.createDataFrame([(x,) for x in ids], "resource_id string")
            own = ages(got.select("g0", F.col("v0").alias(VALUE)), now, expected, shape.rules[0][1].condition.after_seconds)
            own = own.select("resource_id", _labels([]).alias("labels"), F.lit(0).alias("agg"), VALUE)
        else:
            values = F.array(*[F.col(f"v{k}").cast("double") for k in range(len(shape.aggregations))])
            own = got.select(F.col("g0").alias("resource_id"), _labels([f.label for f in shape.query.group_by[1:]]).alias("labels"), F.posexplode(values).alias("agg", VALUE))
            own = own.where(F.col(VALUE).isNotNull())
        own = own.withColumn("shape", F.lit(i))
        out = own if out is None else out.unionByName(own)
    # as many rows as there are rules, which are on the driver already
    known = out.sparkSession.createDataFrame(table, "shape int, agg int, rule_id string, kind string, op string, bound double, hold_seconds double, after double")
    c = F.col(VALUE)
    compared = F.when(F.col("kind") == "absence", c > F.col("after"))
    for op in ("gt", "gte", "lt", "lte", "eq", "ne"):
        compared = compared.when(F.col("op") == op, holds(op, c, F.col("bound")))
    out = out.join(F.broadcast(known), ["shape", "agg"]).select(
        "rule_id", "resource_id", dedup_key(F.col("rule_id"), F.col("resource_id"), F.col("labels")).alias("dedup_key"), VALUE, compared.alias("breaching"), "hold_seconds")
    if quiet is None:
        return out.withColumns({"suppressed": F.lit(False), "muted": F.lit(False)})
    out = out.join(quiet.select("resource_id", F.col("alerts").alias("suppressed"), F.col("notifications").alias("muted")), "resource_id", "left")
    return out.withColumns({"suppressed": F.coalesce("suppressed", F.lit(False)), "muted": F.coalesce("muted", F.lit(False))})


def outcomes(readings: DataFrame, most: int = MAX_SERIES) -> DataFrame:
    """(rule_id, series, breaching, suppressed, truncated) of :func:`evaluate`'s readings: ``truncated`` marks rules with so
    many series that a reader who takes ``most`` of them would see a part."""
    return readings.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("series"), F.count_if("breaching").alias("breaching"), F.count_if("suppressed").alias("suppressed"), (F.count(F.lit(1)) >= most).alias("truncated"))


def escape(c: Column) -> Column:
    for x in ("\\", "=", ","):
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def dedup_key(rule: Column, resource: Column, labels: Column) -> Column:
    """rule/resource/k=v,... with the labels (an array of structs k, v) in order."""
    return F.concat_ws("/", rule, resource, F.array_join(F.array_sort(F.transform(labels, lambda x: F.concat_ws("=", escape(x["k"]), escape(x["v"])))), ","))


def _labels(names: list[str]) -> Column:
    """The groups after the first as an array of (k, v); a null reads as the empty text."""
    if not names:
        return F.array().cast("array<struct<k:string,v:string>>")
    return F.array(*[F.struct(F.lit(n).alias("k"), F.coalesce(F.col(f"g{i + 1}").cast("string"), F.lit("")).alias("v")) for i, n in enumerate(names)])


def read_threshold(result: DataFrame, rule_id: str, labels: list[str]) -> DataFrame:
    """(rule_id, resource_id, dedup_key, value) of an evaluation's groups g0.. and value; null values say nothing."""
    value = result.columns[-1]
    return result.where(F.col(value).isNotNull()).select(
        F.lit(rule_id).alias("rule_id"), F.col("g0").alias("resource_id"), dedup_key(F.lit(rule_id), F.col("g0"), _labels(labels)).alias("dedup_key"), F.col(value).cast("double").alias("value"))


def ages(result: DataFrame, now: datetime, expected: DataFrame, after_seconds: int) -> DataFrame:
    """(resource_id, value): seconds since each resource was heard (g0 and value, its newest time); of those expected
    that were not heard in the window, a second more than it is long."""
    age = F.greatest(F.lit(0), F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col(VALUE))) / F.lit(1000.0)
    heard = result.where(F.col(VALUE).isNotNull()).select(F.col("g0").alias("resource_id"), age.alias(VALUE))
    silent = max(float(after_seconds), LEAST_WINDOW.total_seconds()) + 1.0
    every = expected.select("resource_id").distinct().join(heard, "resource_id", "full")
    return every.select("resource_id", F.coalesce(VALUE, F.lit(silent)).alias(VALUE))


def read_absence(result: DataFrame, rule_id: str, now: datetime, expected: DataFrame, after_seconds: int) -> DataFrame:
    """:func:`ages` of a whole evaluation (one without a limit) as readings of a rule."""
    key = dedup_key(F.lit(rule_id), F.col("resource_id"), _labels([]))
    return ages(result, now, expected, after_seconds).select(F.lit(rule_id).alias("rule_id"), "resource_id", key.alias("dedup_key"), VALUE)


def step(was: str | None, since, breaching: bool, hold_seconds: float, now):
    """(phase, since, notify) after an evaluation. ``since`` stays while a phase lasts; firing and resolving are
    told once; a breach that ends while pending is forgotten."""
    if breaching:
        if was == "firing":
            return "firing", since, False
        start = since if was == "pending" else now
        waited = (now - start).total_seconds() if hasattr(now - start, "total_seconds") else now - start
        return ("firing", now, True) if waited >= hold_seconds else ("pending", start, False)
    return ("resolved", now, True) if was == "firing" else ("ok", now, False)


def replay(evaluations: DataFrame) -> DataFrame:
    """Transitions of evaluations (dedup_key, at, breaching, hold_seconds, and optionally suppressed, muted).

    Each key's evaluations are folded in order of time; a suppressed one is skipped and leaves the phase
    alone, a muted one moves it without telling anyone. One key's history is one group, as it is one state.
    """
    given = set(evaluations.columns)
    rows = evaluations.select(
        "dedup_key", "at", "breaching", F.col("hold_seconds").cast("double").alias("hold_seconds"),
        (F.col("suppressed") if "suppressed" in given else F.lit(False)).alias("suppressed"), (F.col("muted") if "muted" in given else F.lit(False)).alias("muted"),
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        phase = since = None
        out = []
        for r in pdf.sort_values("at", kind="stable").itertuples(index=False):
            if r.suppressed:
                continue
            phase, since, notify = step(phase, since, bool(r.breaching), r.hold_seconds, r.at)
            out.append((r.dedup_key, r.at, phase, since, notify and not r.muted))
        return pd.DataFrame(out, columns=["dedup_key", "at", "phase", "since", "notify"])

    return rows.groupBy("dedup_key").applyInPandas(fold, "dedup_key string, at timestamp, phase string, since timestamp, notify boolean")


def advance(states: DataFrame, readings: DataFrame, now: datetime) -> DataFrame:
    """One cycle in expressions: stored states (dedup_key, phase, since) and readings (dedup_key, breaching,
    hold_seconds, suppressed, muted) to (dedup_key, phase, since, notify, write).

    A series without a reading keeps its state: missing data resolves nothing.
    """
    j = readings.join(states.select("dedup_key", F.col("phase").alias("was"), F.col("since").alias("_since")), "dedup_key", "left")
    at = F.lit(now).cast("timestamp")
    start = F.when(F.col("was") == "pending", F.col("_since")).otherwise(at)
    waited = (F.unix_micros(at) - F.unix_micros(start)) / F.lit(1e6)
    firing = F.col("was") == "firing"
    phase = (
        F.when(F.col("breaching") & F.coalesce(firing, F.lit(False)), "firing").when(F.col("breaching") & (waited >= F.col("hold_seconds")), "firing")
        .when(F.col("breaching"), "pending").when(F.coalesce(firing, F.lit(False)), "resolved").otherwise("ok")
    )
    same = F.col("breaching") & (F.coalesce(firing, F.lit(False)) | ((F.col("was") == "pending") & (phase == "pending")))
    out = j.where(~F.coalesce("suppressed", F.lit(False))).select(
        "dedup_key", phase.alias("phase"), F.when(F.coalesce(same, F.lit(False)), F.col("_since")).otherwise(at).alias("since"),
        (phase.isin("firing", "resolved") & ~(F.coalesce(firing, F.lit(False)) & (phase == "firing")) & ~F.coalesce("muted", F.lit(False))).alias("notify"),
        (phase.isin("pending", "firing") | F.coalesce(F.col("was").isin("pending", "firing"), F.lit(False))).alias("write"),
    )
    return out


def upsert_states(states: DataFrame, moved: DataFrame, now: datetime) -> DataFrame:
    """States (dedup_key, phase, since, acknowledged_by, evaluated_at) with what moved; an acknowledgement
    lasts as long as its phase."""
    new = moved.where("write").select("dedup_key", F.col("phase").alias("_phase"), F.col("since").alias("_since"))
    out = states.join(new, "dedup_key", "full")
    changed = F.col("_phase").isNotNull()
    return out.select(
        "dedup_key", F.coalesce("_phase", "phase").alias("phase"), F.coalesce("_since", "since").alias("since"),
        F.when(~changed | F.col("phase").eqNullSafe(F.col("_phase")), F.col("acknowledged_by")).alias("acknowledged_by"),
        F.when(changed, F.lit(now).cast("timestamp")).otherwise(F.col("evaluated_at")).alias("evaluated_at"),
    )


def active_alerts(states: DataFrame, rules: DataFrame, resources: DataFrame) -> DataFrame:
    """Pending and firing alerts with rule and resource names: firing first, then the longest-standing."""
    out = states.where("phase IN ('pending', 'firing')").join(rules.select("rule_id", F.col("name").alias("rule"), "severity"), "rule_id").join(
        resources.select("resource_id", F.col("name").alias("resource")), "resource_id", "left")
    return out.orderBy(F.when(F.col("phase") == "firing", 0).otherwise(1), "since", "dedup_key")


def suppressions(covered: DataFrame) -> DataFrame:
    """(resource_id, alerts, notifications): what any open window that covers a resource silences; ``covered`` is
    maintenance.silenced or, of few windows, maintenance.covered."""
    return covered.groupBy("resource_id").agg(F.bool_or("suppress_alerts").alias("alerts"), F.bool_or("suppress_notifications").alias("notifications"))


def reserve(attempts: DataFrame, channels: DataFrame, budgets: DataFrame) -> DataFrame:
    """Outcomes of notification attempts (attempt_id, tenant_id, channel_id, at), each decided after those before it.

    Over the tenant's daily budget comes first, then over the channel's rate a minute, else it is sent. Attempts
    on disabled channels or those of another tenant have no outcome. A tenant's attempts of one day are one
    group, which its budget bounds in effect but not in number.
    """
    ready = attempts.join(channels.where("enabled").select("tenant_id", "channel_id", "max_per_minute"), ["tenant_id", "channel_id"]).join(
        budgets.select("tenant_id", "budget_per_day"), "tenant_id").withColumn("_day", F.to_date("at"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, sent = [], 0
        recent: dict[str, list] = {}
        for r in pdf.sort_values(["at", "attempt_id"], kind="stable").itertuples(index=False):
            own = [t for t in recent.get(r.channel_id, []) if t > r.at - pd.Timedelta(minutes=1)]
            outcome = "over_budget" if sent >= r.budget_per_day else "rate_limited" if len(own) >= r.max_per_minute else "sent"
            if outcome == "sent":
                sent += 1
                own.append(r.at)
            recent[r.channel_id] = own
            out.append((r.attempt_id, outcome))
        return pd.DataFrame(out, columns=["attempt_id", "outcome"])

    rows = ready.select("attempt_id", "tenant_id", "channel_id", "at", "max_per_minute", "budget_per_day", "_day")
    return rows.groupBy("tenant_id", "_day").applyInPandas(fold, "attempt_id long, outcome string")


def duration_phrase(seconds: float) -> str:
    """A time in its largest unit, rounded down."""
    for unit, size in (("day", 86_400), ("hour", 3600), ("minute", 60)):
        if seconds >= size:
            n = int(seconds // size)
            return f"{n} {unit}{'s' * (n != 1)}"
    n = int(seconds)
    return f"{n} second{'s' * (n != 1)}"


def age_phrase(seconds: float) -> str:
    for unit, size in (("d", 86_400), ("h", 3600), ("m", 60)):
        if seconds >= size:
            return f"{int(seconds // size)}{unit}"
    return f"{int(seconds)}s"


def rule_sentence(q: Query, c: Condition) -> str:
    """A rule in words."""
    if c.kind == "absence":
        return f"no {q.signal} for {duration_phrase(c.after_seconds)}"
    a = q.aggregations[0] if q.aggregations else Aggregation("count", VALUE)
    what = f"{a.func} of {a.field.label}" if a.field else f"number of {q.signal} rows"
    sign = {"gt": "above", "gte": "at least", "lt": "below", "lte": "at most", "eq": "equal to", "ne": "other than"}[c.op]
    dwell = f" for {duration_phrase(c.for_seconds)}" if c.for_seconds else ""
    return f"{what} {sign} {c.bound:g}{dwell}"
