"""The query tree, and its JSON form.

A query names a signal, a half-open time range, resources, a filter, and either raw rows or aggregations
by groups.  JSON tags: ``type`` in selectors, ``field`` in fields, ``op`` in expressions, ``by`` in sort keys.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime, timedelta
from typing import Any

from marlstone.plans.errors import Invalid

SIGNALS = ("metric", "log", "event", "state", "trace", "flow")
PLAIN_FIELDS = (
    "resource_id", "site_id", "observed_at", "ingested_at", "source_kind", "source_vendor", "severity", "facility", "body",
    "trace_id", "span_id", "metric", "value", "unit", "event_category", "event_type", "previous_status", "current_status", "rate",
)
COMPARISONS = ("eq", "ne", "lt", "lte", "gt", "gte", "in", "not_in")
TEXT_MODES = ("any_token", "all_token", "substring", "phrase")
FUNCTIONS = ("count", "count_distinct", "sum", "min", "max", "avg", "p50", "p95", "p99")
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
SELECTORS = ("all", "ids", "kind", "site", "descendants", "group", "tagged")
DEFAULT_LIMIT = 100
#: How far a tail looks behind and ahead of its arrival window, by the time observed.
TAIL_LOOKBACK, TAIL_SKEW = timedelta(hours=1), timedelta(minutes=5)


def parse_time(text: str) -> datetime:
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError as e:
        raise Invalid(f"not a time: {text!r}") from e
    if at.tzinfo is None:
        raise Invalid(f"a time needs a zone: {text!r}")
    return at.astimezone(UTC)


def time_text(at: datetime) -> str:
    return at.astimezone(UTC).isoformat().replace("+00:00", "Z")


@dataclass(frozen=True)
class Field:
    """A plain field by name, ``attr`` with a key, or ``time_bucket`` with seconds."""

    name: str
    key: str | None = None
    seconds: int | None = None

    @property
    def label(self) -> str:
        return f"attr[{self.key}]" if self.name == "attr" else f"time_bucket({self.seconds})" if self.name == "time_bucket" else self.name

    @classmethod
    def from_json(cls, x: Any) -> Field:
        name = _get(x, "field", str)
        if name == "attr":
            return cls("attr", key=_get(x, "key", str))
        if name == "time_bucket":
            return cls("time_bucket", seconds=_get(x, "seconds", int))
        if name not in PLAIN_FIELDS:
            raise Invalid(f"no such field: {name}")
        return cls(name)

    def to_json(self) -> dict:
        out: dict = {"field": self.name}
        if self.key is not None:
            out["key"] = self.key
        if self.seconds is not None:
            out["seconds"] = self.seconds
        return out


def attr(key: str) -> Field:
    return Field("attr", key=key)


def bucket(seconds: int) -> Field:
    return Field("time_bucket", seconds=seconds)


@dataclass(frozen=True)
class TimeRange:
    start: datetime
    end: datetime

    @property
    def span(self) -> timedelta:
        return self.end - self.start


@dataclass(frozen=True)
class Selector:
    type: str = "all"
    args: tuple = ()

    @classmethod
    def from_json(cls, x: Any) -> Selector:
        kind = _get(x, "type", str)
        names = {
            "all": (), "ids": ("ids",), "kind": ("kind",), "site": ("site",), "descendants": ("root", "max_depth"),
            "group": ("group",), "tagged": ("key", "value"),
        }
        if kind not in names:
            raise Invalid(f"no such selector: {kind}")
        return cls(kind, tuple((n, tuple(x[n]) if isinstance(x.get(n), list) else _get(x, n)) for n in names[kind]))

    def to_json(self) -> dict:
        return {"type": self.type, **{n: list(v) if isinstance(v, tuple) else v for n, v in self.args}}

    def __getitem__(self, name: str) -> Any:
        return dict(self.args)[name]


@dataclass(frozen=True)
class Expr:
    """``op`` is and, or, not, compare, text or exists; the other members go with it."""

    op: str
    of: tuple[Expr, ...] = ()
    field: Field | None = None
    cmp: str | None = None
    value: Any = None
    mode: str | None = None
    terms: tuple[str, ...] = ()

    def fields(self) -> list[Field]:
        return [self.field] if self.field else [f for e in self.of for f in e.fields()]

    @classmethod
    def from_json(cls, x: Any) -> Expr:
        op = _get(x, "op", str)
        if op in ("and", "or"):
            return cls(op, of=tuple(cls.from_json(e) for e in _get(x, "of", list)))
        if op == "not":
            return cls(op, of=(cls.from_json(_get(x, "of", dict)),))
        where = Field.from_json(_get(x, "field", dict))
        if op == "compare":
            cmp = _get(x, "cmp", str)
            if cmp not in COMPARISONS:
                raise Invalid(f"no such comparison: {cmp}")
            return cls(op, field=where, cmp=cmp, value=literal(_get(x, "value")))
        if op == "text":
            mode = _get(x, "mode", str)
            if mode not in TEXT_MODES:
                raise Invalid(f"no such text mode: {mode}")
            return cls(op, field=where, mode=mode, terms=tuple(map(str, _get(x, "terms", list))))
        if op == "exists":
            return cls(op, field=where)
        raise Invalid(f"no such expression: {op}")

    def to_json(self) -> dict:
        if self.op in ("and", "or"):
            return {"op": self.op, "of": [e.to_json() for e in self.of]}
        if self.op == "not":
            return {"op": "not", "of": self.of[0].to_json()}
        out = {"op": self.op, "field": self.field.to_json()}
        if self.op == "compare":
            out |= {"cmp": self.cmp, "value": literal_json(self.value)}
        if self.op == "text":
            out |= {"mode": self.mode, "terms": list(self.terms)}
        return out


def literal(x: Any) -> Any:
    """A JSON value as bool, int, float, UUID, time, string or a tuple of these, tried in that order."""
    if isinstance(x, list):
        return tuple(literal(v) for v in x)
    if isinstance(x, str):
        if len(x) in (32, 36):
            try:
                return uuid.UUID(x)
            except ValueError:
                pass
        if re.match(r"\d{4}-\d\d-\d\d[Tt ]", x):
            try:
                return parse_time(x)
            except Invalid:
                pass
        return x
    if isinstance(x, (bool, int, float)):
        return x
    raise Invalid(f"not a value: {x!r}")


def literal_json(x: Any) -> Any:
    if isinstance(x, tuple):
        return [literal_json(v) for v in x]
    return time_text(x) if isinstance(x, datetime) else str(x) if isinstance(x, uuid.UUID) else x


def compare(where: Field, cmp: str, value: Any) -> Expr:
    return Expr("compare", field=where, cmp=cmp, value=value)


def all_of(*of: Expr) -> Expr:
    return Expr("and", of=of)


@dataclass(frozen=True)
class Aggregation:
    func: str
    alias: str
    field: Field | None = None

    @classmethod
    def from_json(cls, x: Any) -> Aggregation:
        func = _get(x, "func", str)
        if func not in FUNCTIONS:
            raise Invalid(f"no such aggregate: {func}")
        return cls(func, _get(x, "alias", str), Field.from_json(x["field"]) if x.get("field") else None)

    def to_json(self) -> dict:
        return {"func": self.func, "field": self.field and self.field.to_json(), "alias": self.alias}


@dataclass(frozen=True)
class Sort:
    """Order by an aggregation's alias, or by a field."""

    alias: str | None = None
    field: Field | None = None
    desc: bool = False

    @classmethod
    def from_json(cls, x: Any) -> Sort:
        key = _get(x, "key", dict)
        by = _get(key, "by", str)
        if by == "alias":
            return cls(alias=_get(key, "alias", str), desc=bool(x.get("desc", False)))
        if by == "field":
            return cls(field=Field.from_json(_get(key, "field", dict)), desc=bool(x.get("desc", False)))
        raise Invalid(f"no such sort key: {by}")

    def to_json(self) -> dict:
        key = {"by": "alias", "alias": self.alias} if self.alias else {"by": "field", "field": self.field.to_json()}
        return {"key": key, "desc": self.desc}


@dataclass(frozen=True)
class Query:
    signal: str
    time: TimeRange
    resources: Selector = Selector()
    filter: Expr | None = None
    aggregations: tuple[Aggregation, ...] = ()
    group_by: tuple[Field, ...] = ()
    order_by: tuple[Sort, ...] = ()
    limit: int = DEFAULT_LIMIT
    offset: int = field(default=0)

    @property
    def is_aggregate(self) -> bool:
        return bool(self.aggregations)

    @classmethod
    def from_json(cls, x: Any) -> Query:
        if isinstance(x, (str, bytes)):
            try:
                x = json.loads(x)
            except ValueError as e:
                raise Invalid(f"not JSON: {e}") from e
        signal = _get(x, "signal", str)
        if signal not in SIGNALS:
            raise Invalid(f"no such signal: {signal}")
        time = _get(x, "time", dict)
        for n in ("limit", "offset"):
            if n in x and (not isinstance(x[n], int) or isinstance(x[n], bool) or x[n] < 0):
                raise Invalid(f"{n} must be a whole number")
        return cls(
            signal, TimeRange(parse_time(_get(time, "start", str)), parse_time(_get(time, "end", str))),
            Selector.from_json(x["resources"]) if x.get("resources") else Selector(),
            Expr.from_json(x["filter"]) if x.get("filter") else None,
            tuple(map(Aggregation.from_json, x.get("aggregations") or ())), tuple(map(Field.from_json, x.get("group_by") or ())),
            tuple(map(Sort.from_json, x.get("order_by") or ())), x.get("limit", DEFAULT_LIMIT), x.get("offset", 0),
        )

    def to_json(self) -> dict:
        out: dict = {"signal": self.signal, "time": {"start": time_text(self.time.start), "end": time_text(self.time.end)}, "resources": self.resources.to_json()}
        if self.filter:
            out["filter"] = self.filter.to_json()
        for n in ("aggregations", "group_by", "order_by"):
            if getattr(self, n):
                out[n] = [v.to_json() for v in getattr(self, n)]
        return out | {"limit": self.limit, "offset": self.offset}

    def where(self, *more: Expr) -> Query:
        return replace(self, filter=all_of(*([self.filter] if self.filter else []), *more))


def follow(q: Query, since: datetime, now: datetime) -> Query:
    """The query as a tail: rows that arrived in [since, now), with room around it for slow and fast clocks.

    Windowing on arrival partitions the rows among polls; the time observed only bounds the scan.
    """
    arrived = all_of(compare(Field("ingested_at"), "gte", since), compare(Field("ingested_at"), "lt", now))
    own = q.filter.of if q.filter and q.filter.op == "and" else (q.filter,) if q.filter else ()
    return replace(
        q, time=TimeRange(since - TAIL_LOOKBACK, now + TAIL_SKEW), filter=all_of(*own, arrived) if own else arrived,
        aggregations=(), group_by=(), order_by=(), offset=0,
    )


def fingerprint(q: Query, table: str) -> str:
    """A query's shape without its values."""
    return f"{q.signal}:{table}" + "+filter" * bool(q.filter) + "+agg" * q.is_aggregate


def _get(x: Any, name: str, kind: type | None = None) -> Any:
    if not isinstance(x, dict) or name not in x:
        raise Invalid(f"{name} is missing")
    if kind and (not isinstance(x[name], kind) or kind is int and isinstance(x[name], bool)):
        raise Invalid(f"{name} must be of type {kind.__name__}")
    if isinstance(x[name], float) and not math.isfinite(x[name]):
        raise Invalid(f"{name} must be finite")
    return x[name]
