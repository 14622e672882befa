"""The tenant that a query runs for. Nothing is planned without one."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class TenantScope:
    tenant_id: str
