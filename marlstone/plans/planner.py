"""Choice of the table that answers a query, and of the column that a field stands for. No Spark here.

A count by bucket, severity or resource is served by the five-minute counts; aggregates over long windows of
metrics by a rollup.  What a pre-aggregate can't answer is refused, not approximated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from marlstone.plans import warnings as w
from marlstone.plans.ast import Aggregation, Expr, Field, Query
from marlstone.plans.errors import FieldNotAvailable, Invalid, RollupCannotServe, Unsupported

MAX_LIMIT, TAIL_LIMIT = 10_000, 1_000
MAX_BUCKET = 86_400
COUNTS_BUCKET = 300
#: Longest windows that aggregates of metrics read from points, and from the five-minute rollup.
RAW_SPAN, FIVE_MINUTE_SPAN = timedelta(hours=6), timedelta(days=30)

EVERYWHERE = ("resource_id", "site_id", "observed_at", "ingested_at")
OWN = {
    "log": ("severity", "source_kind", "source_vendor", "facility", "body", "trace_id", "span_id"),
    "event": ("severity", "source_kind", "source_vendor", "event_category", "event_type"),
    "state": ("severity", "previous_status", "current_status"),
    "metric": ("metric", "value", "unit", "rate"),
}
BASE = {"log": ("logs", "attributes"), "event": ("events", "attributes"), "state": ("states", "attributes"), "metric": ("metrics", "labels")}
MATERIALISED = {"host.name": "host_name", "service.name": "service_name"}
#: Columns of raw rows, in order; never all, as maps are wide.
RAW_COLUMNS = {
    "log": ("tenant_id", "resource_id", "site_id", "observed_at", "ingested_at", "source_kind", "source_vendor", "severity", "facility", "body", "attributes", "trace_id", "span_id"),
    "metric": ("tenant_id", "resource_id", "site_id", "metric", "observed_at", "ingested_at", "value", "unit", "labels"),
    "event": ("tenant_id", "resource_id", "site_id", "observed_at", "ingested_at", "source_kind", "source_vendor", "severity", "event_category", "event_type", "summary", "attributes"),
    "state": ("tenant_id", "resource_id", "site_id", "observed_at", "ingested_at", "severity", "previous_status", "current_status", "reason", "attributes"),
}
#: Text columns whose absence is an empty string.
TEXT_COLUMNS = frozenset("body trace_id span_id unit source_vendor host_name service_name summary reason".split())
ROLLUP_FUNCTIONS = ("count", "min", "max", "avg")
#: Pre-aggregates, and what their last bucket is built of if a window ends within it: tables with their widths, the base
#: table (no width) last. Rows that retention has taken from the finer ones are not in it.
FINER = {
    "logs_counts_5m": (("logs_counts_5m", 300), ("logs", 0)),
    "metrics_5m": (("metrics_5m", 300), ("metrics", 0)),
    "metrics_1h": (("metrics_1h", 3600), ("metrics_5m", 300), ("metrics", 0)),
}


def floored(at: datetime, seconds: int) -> datetime:
    """The start of the bucket that a time is in."""
    return at - timedelta(seconds=at.timestamp() % seconds)


@dataclass(frozen=True)
class TablePlan:
    table: str
    kind: str  # base, counts or rollup
    signal: str
    time_col: str
    map_col: str
    bucket_seconds: int = 0

    def window_start(self, start: datetime) -> datetime:
        """The start, floored to the stored bucket: a window that begins within a bucket has that bucket."""
        if not self.bucket_seconds:
            return start
        return floored(start, self.bucket_seconds)


@dataclass(frozen=True)
class Col:
    """A column, a key of the map column, or a bucket of a time column."""

    name: str
    key: str | None = None
    seconds: int | None = None


def plan(q: Query, base: bool = False) -> tuple[TablePlan, list[w.QueryWarning]]:
    """The table for a query and what that costs; with ``base`` never a pre-aggregate."""
    if q.signal not in BASE:
        raise Unsupported(f"{q.signal} queries are not supported")
    table, map_col = BASE[q.signal]
    if base:
        return TablePlan(table, "base", q.signal, "observed_at", map_col), []
    if q.signal == "log" and counts_serve(q):
        return TablePlan("logs_counts_5m", "counts", q.signal, "bucket", map_col, COUNTS_BUCKET), []
    if q.signal == "metric" and (rollup := rollup_for(q)):
        return TablePlan(rollup[0], "rollup", q.signal, "bucket", map_col, rollup[1]), [w.downsampled(*rollup)]
    return TablePlan(table, "base", q.signal, "observed_at", map_col), []


def counts_serve(q: Query) -> bool:
    """Whether the five-minute log counts have every column that the query needs."""
    if len(q.aggregations) != 1 or q.aggregations[0].func != "count" or q.aggregations[0].field:
        return False

    def there(f: Field) -> bool:
        if f.name == "time_bucket":
            return f.seconds >= COUNTS_BUCKET and f.seconds % COUNTS_BUCKET == 0
        return f.name in ("resource_id", "severity")

    used = [*q.group_by, *(q.filter.fields() if q.filter else ()), *(s.field for s in q.order_by if s.field)]
    return all(map(there, used))


def rollup_for(q: Query) -> tuple[str, int] | None:
    """The metric rollup that the window needs, if any; an error if it can't answer."""
    if not q.is_aggregate or q.time.span <= RAW_SPAN:
        return None
    table, seconds = ("metrics_5m", 300) if q.time.span <= FIVE_MINUTE_SPAN else ("metrics_1h", 3600)
    for a in q.aggregations:
        if a.func not in ROLLUP_FUNCTIONS:
            raise RollupCannotServe(a.func, table, "it keeps the least, the greatest, the sum and the number of values only")
        if a.field and a.field.name == "rate":
            raise RollupCannotServe("a rate", table, "differences of averaged counters are no rates; ask for a shorter window")
        if a.field and a.field.name != "value":
            raise RollupCannotServe(f"{a.func} of {a.field.label}", table, "it aggregates values only")
    for f in [*q.group_by, *(q.filter.fields() if q.filter else ())]:
        if f.name == "time_bucket" and f.seconds % seconds:
            raise RollupCannotServe(f.label, table, f"buckets must be multiples of {seconds} s")
        if f.name not in ("resource_id", "metric", "time_bucket"):
            raise RollupCannotServe(f.label, table, "it keeps resource, metric and bucket only")
    return table, seconds


def column_of(f: Field, p: TablePlan, warnings: list[w.QueryWarning]) -> Col:
    if p.kind != "base":
        own = {"counts": "severity", "rollup": "metric"}[p.kind]
        if f.name in ("resource_id", own):
            return Col(f.name)
        if f.name == "observed_at" or f.name == "time_bucket" and f.seconds == p.bucket_seconds:
            return Col(p.time_col)
        if f.name == "time_bucket":
            return Col(p.time_col, seconds=f.seconds)
        raise FieldNotAvailable(f.label, p.table)
    if f.name == "time_bucket":
        return Col(p.time_col, seconds=f.seconds)
    if f.name == "attr":
        if p.signal in ("log", "event") and f.key in MATERIALISED:
            return Col(MATERIALISED[f.key])
        warnings.append(w.attribute_not_materialised(f.key))
        return Col(p.map_col, key=f.key)
    if f.name in EVERYWHERE or f.name in OWN[p.signal]:
        return Col(f.name)
    raise FieldNotAvailable(f.label, p.signal)


def uses_rate(q: Query) -> bool:
    """Whether a rate is aggregated; an error where it is used in another place, or on another signal."""
    def mentions(e: Expr | None) -> bool:
        return bool(e) and any(f.name == "rate" for f in e.fields())

    for there, how in (
        (any(f.name == "rate" for f in q.group_by), "grouped by"), (any(s.field and s.field.name == "rate" for s in q.order_by), "sorted by"), (mentions(q.filter), "filtered on"),
    ):
        if there:
            raise Invalid(f"a rate can't be {how}; aggregate it over time buckets")
    used = any(a.field and a.field.name == "rate" for a in q.aggregations)
    if used and q.signal != "metric":
        raise FieldNotAvailable("rate", q.signal)
    return used


def check_alias(alias: str) -> str:
    if not re.fullmatch("[a-z_][a-z0-9_]{0,62}", alias):
        raise Invalid(f"not an output name: {alias!r}")
    return alias


def check_aggregation(a: Aggregation) -> None:
    check_alias(a.alias)
    if a.func == "count" and a.field:
        raise Invalid("count has no field; count_distinct counts values")
    if a.func != "count" and not a.field:
        raise Invalid(f"{a.func} needs a field")


def check(q: Query) -> None:
    """What holds for every query, whatever answers it."""
    if q.time.end <= q.time.start:
        raise Invalid("the time range is empty")
    if q.limit < 1:
        raise Invalid("a limit must be 1 or more")
    for a in q.aggregations:
        check_aggregation(a)
    if q.group_by and not q.is_aggregate:
        raise Invalid("groups need an aggregation")
    for f in q.group_by:
        if f.name == "time_bucket" and not 1 <= f.seconds <= MAX_BUCKET:
            raise Invalid("a bucket is from 1 second to 1 day")
    aliases = {a.alias for a in q.aggregations}
    for s in q.order_by:
        if s.alias is not None and s.alias not in aliases:
            raise Invalid(f"sorted by {s.alias!r}, which no aggregation is called")
        if s.field and q.is_aggregate and s.field not in q.group_by:
            raise Invalid(f"sorted by {s.field.label}, which is not grouped by")


def check_tail(q: Query, p: TablePlan) -> None:
    if q.is_aggregate or q.group_by:
        raise Invalid("a tail gives rows, not aggregates")
    if q.offset:
        raise Invalid("a tail has no pages")
    if p.kind != "base":
        raise Invalid("a tail reads rows only")
