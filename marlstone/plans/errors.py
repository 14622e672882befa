"""Errors of planning and lowering a query."""

from __future__ import annotations


class QueryError(Exception):
    """Base of everything that a query can be refused for."""

    status = 400


class TenantMismatch(QueryError):
    """The resolved resources are another tenant's; answered like something that isn't there."""

    status = 404

    def __init__(self):
        super().__init__("resources of another tenant")


class Invalid(QueryError):
    """The query is malformed."""


class FieldNotAvailable(QueryError):
    def __init__(self, field: str, signal: str):
        super().__init__(f"{signal} has no field {field}")
        self.field, self.signal = field, signal


class RollupCannotServe(QueryError):
    def __init__(self, what: str, table: str, why: str):
        super().__init__(f"{table} can't answer {what}: {why}")
        self.what, self.table, self.why = what, table, why


class Unsupported(QueryError):
    """A signal or feature that has no tables yet."""
