"""What a query's answer may be marked with; ``kind`` is the name on the wire."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class QueryWarning:
    kind: str
    details: dict = field(default_factory=dict, hash=False)

    def message(self) -> str:
        """One sentence for people."""
        return _SENTENCES[self.kind].format(**self.details)

    def to_json(self) -> dict:
        return {"warning": self.kind, **self.details, "message": self.message()}


_SENTENCES = {
    "not_index_accelerated": "a {mode} search scans every row of the window: {why}",
    "limit_clamped": "{requested} rows were asked for, at most {applied} are given",
    "downsampled": "answered from {table} in steps of {bucket_seconds} s, not from single points",
    "attribute_not_materialised": "attribute {key} has no column of its own, so the whole map is read",
    "selector_matched_nothing": "no resource fits the selector, so there is nothing to show",
    "full_tenant_scan": "all resources of the tenant are read; naming some is faster",
}


def not_index_accelerated(mode: str, why: str) -> QueryWarning:
    return QueryWarning("not_index_accelerated", {"mode": mode, "why": why})


def limit_clamped(requested: int, applied: int) -> QueryWarning:
    return QueryWarning("limit_clamped", {"requested": requested, "applied": applied})


def downsampled(table: str, bucket_seconds: int) -> QueryWarning:
    return QueryWarning("downsampled", {"table": table, "bucket_seconds": bucket_seconds})


def attribute_not_materialised(key: str) -> QueryWarning:
    return QueryWarning("attribute_not_materialised", {"key": key})


SELECTOR_MATCHED_NOTHING = QueryWarning("selector_matched_nothing")
FULL_TENANT_SCAN = QueryWarning("full_tenant_scan")
