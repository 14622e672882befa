"""Lowering of a planned query to a DataFrame, and the engine that answers queries.

The tenant and the time range are filtered first, on the scan, with the day partition where the table has one;
everything else is declared on top and left to the optimizer.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import columns as fx
from marlstone.operators.rate import with_rate
from marlstone.operators.resolve import Catalog, Resolved, resolve
from marlstone.operators.rollups import log_counts, merge_metrics, metric_rollup
from marlstone.plans import planner
from marlstone.plans import warnings as w
from marlstone.plans.ast import QUANTILES, Expr, Field, Query, follow
from marlstone.plans.errors import FieldNotAvailable, Invalid, TenantMismatch
from marlstone.plans.planner import Col, TablePlan
from marlstone.plans.scope import TenantScope

#: Resource sets up to this size are an IN list; larger ones a semi join.
IN_LIST = 1000
#: Sketches of percentiles are off by at most one in so many ranks.
ACCURACY = 10_000
#: Date column that tables may be partitioned by.
DAY = "d"


@dataclass(frozen=True)
class ResultSet:
    """A query's rows (not yet run), the table that answers, and warnings."""

    df: DataFrame
    table: str
    warnings: tuple[w.QueryWarning, ...] = ()

    @property
    def columns(self) -> list[tuple[str, str]]:
        return self.df.dtypes

    def rows(self) -> list[tuple]:
        """The rows; there are at most as many as the greatest limit."""
        return [tuple(r) for r in self.df.collect()]

    def read(self) -> dict[str, int]:
        """Rows and bytes that the scans of the last run read, as Spark's own metrics have them."""
        total = {"rows_read": 0, "bytes_read": 0}
        todo = [self.df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            kind = node.getClass().getSimpleName()
            if kind == "AdaptiveSparkPlanExec":
                todo.append(node.executedPlan())
            elif kind.endswith("QueryStageExec"):
                todo.append(node.plan())
            elif kind != "ReusedExchangeExec":
                children = node.children()
                todo += [children.apply(i) for i in range(children.size())]
                if not children.size():
                    for name, key in (("numOutputRows", "rows_read"), ("filesSize", "bytes_read")):
                        metric = node.metrics().get(name)
                        total[key] += metric.get().value() if metric.isDefined() else 0
        return total

    def to_json(self) -> dict:
        return {
            "columns": [{"name": n, "type": t} for n, t in self.columns], "rows": [list(r) for r in self.rows()], "table": self.table,
            "warnings": [x.to_json() for x in self.warnings], **self.read(),
        }


def _lit(value: Any) -> Column:
    if isinstance(value, tuple):
        raise Invalid("a list can't be within a list")
    if isinstance(value, uuid.UUID):
        return F.lit(str(value))
    if isinstance(value, datetime):
        return F.lit(value).cast("timestamp")
    if isinstance(value, float) and value != value or value in (float("inf"), float("-inf")):
        raise Invalid("a value must be finite")
    return F.lit(value)


def within(table: DataFrame, tenant_id: str, time_col: str, start: datetime, end: datetime) -> DataFrame:
    at = F.col(time_col)
    out = table.where(F.col("tenant_id") == tenant_id).where((at >= F.lit(start)) & (at < F.lit(end)))
    if DAY in table.columns:
        out = out.where((F.col(DAY) >= F.lit(start.date())) & (F.col(DAY) <= F.lit(end.date())))
    return out


class Lowering:
    def __init__(self, q: Query, p: TablePlan, found: list[w.QueryWarning], approximate: bool = False):
        self.q, self.plan, self.warnings, self.approximate = q, p, found, approximate

    def column(self, f: Field) -> Column:
        return self._of(planner.column_of(f, self.plan, self.warnings))

    def _of(self, c: Col) -> Column:
        if c.key is not None:
            return fx.attr(F.col(c.name), c.key)
        return fx.bucket(F.col(c.name), c.seconds) if c.seconds else F.col(c.name)

    def window(self, tables: Mapping[str, DataFrame], scope: TenantScope) -> DataFrame:
        """Rows of the tenant and the window. A pre-aggregate's bucket within which the window ends is built of the rows
        before the end: its stored row has what comes after, too."""
        start, end = self.plan.window_start(self.q.time.start), self.q.time.end
        if self.plan.kind == "base":
            return within(tables[self.plan.table], scope.tenant_id, "observed_at", start, end)
        out, seconds = None, self.plan.bucket_seconds
        for name, width in planner.FINER[self.plan.table]:
            cut = planner.floored(end, width) if width else end
            if cut > start:
                rows = within(tables[name], scope.tenant_id, self.plan.time_col if width else "observed_at", start, cut)
                if name != self.plan.table:
                    rows = log_counts(rows) if name == "logs" else metric_rollup(rows, seconds) if name == "metrics" else merge_metrics(rows, seconds)
                rows = rows.drop(DAY)
                out = rows if out is None else out.unionByName(rows)
                start = cut
        return out

    def scan(self, tables: Mapping[str, DataFrame], scope: TenantScope, ids: Resolved) -> DataFrame:
        """Rows of the tenant, the window, the resources and the filter."""
        if ids.tenant_id != scope.tenant_id:
            raise TenantMismatch
        out = self.window(tables, scope)
        if ids.ids is None:
            if self.plan.kind == "base":
                self.warnings.append(w.FULL_TENANT_SCAN)
        elif ids.empty:
            self.warnings.append(w.SELECTOR_MATCHED_NOTHING)
            out = out.where(F.lit(False))
        elif isinstance(ids.ids, DataFrame):
            out = out.join(ids.ids.select("resource_id"), "resource_id", "left_semi")
        else:
            out = out.where(F.col("resource_id").isin(list(ids.ids)))
        return out.where(self.expr(self.q.filter)) if self.q.filter else out

    def expr(self, e: Expr) -> Column:
        if e.op in ("and", "or"):
            if not e.of:
                raise Invalid("an and or or needs an operand")
            return reduce(lambda a, b: a & b if e.op == "and" else a | b, map(self.expr, e.of))
        if e.op == "not":
            return ~self.expr(e.of[0])
        return {"compare": self.compare, "text": self.text, "exists": self.exists}[e.op](e)

    def compare(self, e: Expr) -> Column:
        some = e.cmp in ("in", "not_in")
        if some and (not isinstance(e.value, tuple) or not e.value):
            raise Invalid(f"{e.cmp} needs a list of values")
        if not some and isinstance(e.value, tuple):
            raise Invalid(f"{e.cmp} compares with one value")
        col = self.column(e.field)
        values = [_lit(v) for v in (e.value if some else (e.value,))]
        if e.field.name == "severity" and e.cmp in ("lt", "lte", "gt", "gte"):
            if e.value not in fx.SEVERITIES:
                raise Invalid(f"no such severity: {e.value}")
            # a set of names can be pushed to the scan, an ordinal can't
            order = {"lt": -1, "lte": 0, "gt": 1, "gte": 0}[e.cmp]
            at = fx.SEVERITIES.index(e.value)
            names = fx.SEVERITIES[:at + (order == 0)] if e.cmp in ("lt", "lte") else fx.SEVERITIES[at + (order == 1):]
            return col.isin(*names) if names else F.lit(False)
        if some:
            return col.isin(*values) if e.cmp == "in" else ~col.isin(*values)
        v = values[0]
        return {"eq": col == v, "ne": col != v, "lt": col < v, "lte": col <= v, "gt": col > v, "gte": col >= v}[e.cmp]

    def text(self, e: Expr) -> Column:
        if e.field.name != "body":
            raise Invalid(f"{e.field.label} can't be searched as text")
        if self.plan.signal != "log":
            raise FieldNotAvailable("body", self.plan.signal)
        if not any(t.strip() for t in e.terms):
            raise Invalid("a text search needs a term")
        body, terms = self.column(e.field), list(e.terms)
        if e.mode == "any_token":
            return fx.any_token(body, terms)
        if e.mode == "all_token":
            return fx.all_tokens(body, terms)
        phrase = " ".join(terms)
        if e.mode == "substring":
            self.warnings.append(w.not_index_accelerated("substring", "it may begin within a token"))
            return fx.contains_any_case(body, phrase)
        self.warnings.append(w.not_index_accelerated("phrase", "the order of words is checked in the text"))
        words = tokenize(phrase)
        # the substring test is cheaper, and false for most rows
        near = fx.contains_any_case(body, phrase)
        return near & fx.all_tokens(body, words) if words else near

    def exists(self, e: Expr) -> Column:
        c = planner.column_of(e.field, self.plan, self.warnings)
        if c.key is not None:
            return F.coalesce(F.map_contains_key(F.col(c.name), c.key), F.lit(False))
        if c.name in planner.TEXT_COLUMNS and not c.seconds:
            return F.coalesce(F.col(c.name), F.lit("")) != ""
        raise Invalid(f"{e.field.label} is always there")

    def aggregate(self, a) -> Column:
        if self.plan.kind == "base":
            out = self._base_aggregate(a)
        elif self.plan.kind == "counts":
            out = F.sum("cnt")
        else:
            out = {"count": F.sum("cnt"), "min": F.min("min_v"), "max": F.max("max_v"), "avg": F.sum("sum_v") / F.sum("cnt")}[a.func]
        return (F.coalesce(out, F.lit(0)) if a.func == "count" else out).alias(a.alias)

    def _base_aggregate(self, a) -> Column:
        if a.func == "count":
            return F.count(F.lit(1))
        c = self.column(a.field)
        if a.func in QUANTILES:
            # an exact percentile holds every distinct value of a group; a sketch has a bounded state
            return F.percentile_approx(c, QUANTILES[a.func], ACCURACY) if self.approximate else F.percentile(c, F.lit(QUANTILES[a.func]))
        return {"count_distinct": F.count_distinct, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[a.func](c)

    def output(self, df: DataFrame, ceiling: int, whole: bool = False) -> DataFrame:
        """The rows asked for; ``whole`` is without order and limit, for what reads on in Spark."""
        q = self.q
        if q.is_aggregate:
            keys = [self.column(f).alias(f"g{i}") for i, f in enumerate(q.group_by)]
            aggregates = [self.aggregate(a) for a in q.aggregations]
            out = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
        else:
            out = df
        if whole:
            return out if q.is_aggregate else out.select(*[c for c in planner.RAW_COLUMNS[q.signal] if c in out.columns])
        order = self._order(out)
        if order:
            out = out.orderBy(*order)
        limit = min(q.limit, ceiling)
        if limit < q.limit:
            self.warnings.append(w.limit_clamped(q.limit, limit))
        if q.offset:
            out = out.offset(q.offset)
        out = out.limit(limit)
        return out if q.is_aggregate else out.select(*[c for c in planner.RAW_COLUMNS[q.signal] if c in out.columns])

    def _order(self, out: DataFrame) -> list[Column]:
        """The order asked for, then what makes it the same each time."""
        q = self.q
        if not q.is_aggregate:
            given = [self.column(s.field) for s in q.order_by]
            order = [c.desc() if s.desc else c.asc() for c, s in zip(given, q.order_by, strict=True)]
            order = order or [F.col("resource_id").asc(), F.col(self.plan.time_col).desc()]
            ties = [c for c in ("observed_at", "resource_id", "ingested_at", "metric", "severity", "body", "summary", "value") if c in out.columns]
            return [*order, *(F.col(c) for c in ties)]
        groups = [F.col(f"g{i}") for i in range(len(q.group_by))]
        named = [F.col(s.alias) if s.alias else groups[q.group_by.index(s.field)] for s in q.order_by]
        order = [c.desc() if s.desc else c.asc() for c, s in zip(named, q.order_by, strict=True)]
        first = [] if order else [g.asc() for g, f in zip(groups, q.group_by, strict=True) if f.name == "time_bucket"][:1]
        return [*order, *first, *groups]


def tokenize(text: str) -> list[str]:
    out, own = [], ""
    for c in text + " ":
        if c.isalnum():
            own += c
        elif own:
            out.append(own)
            own = ""
    return out


def lower(q: Query, scope: TenantScope, ids: Resolved, tables: Mapping[str, DataFrame], tail: bool = False, base: bool = False, whole: bool = False, approximate: bool = False) -> ResultSet:
    """The DataFrame that answers a query for a tenant, of the table that the planner chooses."""
    if ids.tenant_id != scope.tenant_id:
        raise TenantMismatch
    planner.check(q)
    rate = planner.uses_rate(q)
    p, found = planner.plan(q, base)
    if tail:
        planner.check_tail(q, p)
    own = Lowering(q, p, found, approximate)
    df = own.scan(tables, scope, ids)
    if rate:
        df = with_rate(df)
    if tail:
        df = df.orderBy(F.col("observed_at").desc(), "resource_id", "ingested_at")
        limit = min(q.limit, planner.TAIL_LIMIT)
        if limit < q.limit:
            found.append(w.limit_clamped(q.limit, limit))
        out = df.limit(limit).select(*[c for c in planner.RAW_COLUMNS[q.signal] if c in df.columns])
    else:
        out = own.output(df, planner.MAX_LIMIT, whole)
    return ResultSet(out, p.table, tuple(dict.fromkeys(found)))


def compiles(q: Query, base: bool = False) -> None:
    """Raise what answering the query would raise, without tables: the check on saving it."""
    planner.check(q)
    planner.uses_rate(q)
    p, found = planner.plan(q, base)
    own = Lowering(q, p, found)
    for f in [*q.group_by, *(a.field for a in q.aggregations if a.field and p.kind == "base")]:
        planner.column_of(f, p, found)
    if q.filter:
        own.expr(q.filter)


@dataclass
class TailPage:
    """A poll's rows, where the next one starts, whether all arrivals are in it, and whether some were skipped."""

    result: ResultSet
    next_since: datetime
    skipped: bool
    limit: int
    _rows: list | None = field(default=None, repr=False)

    def rows(self) -> list[tuple]:
        if self._rows is None:
            self._rows = self.result.rows()
        return self._rows

    @property
    def complete(self) -> bool:
        return len(self.rows()) < self.limit


@dataclass
class Engine:
    """Telemetry tables by name, and the inventory that selectors are resolved against; ``approximate`` takes percentiles
    from sketches, which large groups need."""

    tables: Mapping[str, DataFrame]
    catalog: Catalog | None = None
    approximate: bool = False

    def query(self, q: Query | dict | str, scope: TenantScope, base: bool = False, whole: bool = False, ids: Resolved | None = None) -> ResultSet:
        """``ids`` are the selector's resources where they are known already; ``whole`` is without order and limit."""
        q = q if isinstance(q, Query) else Query.from_json(q)
        return lower(q, scope, ids or resolve(q.resources, scope, self.catalog), self.tables, base=base, whole=whole, approximate=self.approximate)

    def tail(self, q: Query | dict | str, scope: TenantScope, now: datetime, since: datetime | None = None) -> TailPage:
        """One poll of a live tail; without a watermark the last minute, after a long pause the last hour."""
        from datetime import timedelta

        from marlstone.plans.ast import TAIL_LOOKBACK

        q = q if isinstance(q, Query) else Query.from_json(q)
        start = since or now - timedelta(minutes=1)
        floor = now - TAIL_LOOKBACK
        skipped, start = start < floor, max(start, floor)
        if start >= now:
            start = now - timedelta(milliseconds=1) if since is None else now
        tailed = follow(q, start, now) if start < now else follow(q, now - timedelta(milliseconds=1), now - timedelta(milliseconds=1))
        got = lower(tailed, scope, resolve(q.resources, scope, self.catalog), self.tables, tail=True)
        return TailPage(got, now, skipped, min(q.limit, planner.TAIL_LIMIT))
