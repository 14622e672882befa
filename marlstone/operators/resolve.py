"""Resolution of selectors to resources of one tenant, on the inventory tables."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.topology import descendants
from marlstone.plans.ast import Selector
from marlstone.plans.errors import Invalid
from marlstone.plans.scope import TenantScope

#: Explicit lists up to this length stay a list.
LISTED = 1000


@dataclass(frozen=True)
class Resolved:
    """Resource ids of a tenant: None for all of them, a tuple, or a DataFrame with resource_id."""

    tenant_id: str
    ids: Any = None

    @property
    def empty(self) -> bool:
        return isinstance(self.ids, tuple) and not self.ids


def whole_tenant(scope: TenantScope) -> Resolved:
    return Resolved(scope.tenant_id)


def already(scope: TenantScope, ids: list[str]) -> Resolved:
    return Resolved(scope.tenant_id, tuple(sorted(set(ids))))


@dataclass
class Catalog:
    """Inventory tables of all tenants: resource, alias, group_members, edges (each with tenant_id)."""

    resource: DataFrame
    alias: DataFrame | None = None
    members: DataFrame | None = None
    edges: DataFrame | None = None
    #: Whether a resource stands for its historical ids too, under which older telemetry is stored.
    with_history: bool = True

    def _own(self, df: DataFrame, scope: TenantScope) -> DataFrame:
        return df.where(F.col("tenant_id") == scope.tenant_id)

    def of_kind(self, scope: TenantScope, kind: str) -> DataFrame:
        return self._own(self.resource, scope).where(F.col("kind") == kind).select("resource_id")

    def at_site(self, scope: TenantScope, site: str) -> DataFrame:
        return self._own(self.resource, scope).where(F.col("site_id") == site).select("resource_id")

    def tagged(self, scope: TenantScope, key: str, value: str) -> DataFrame:
        if not key:
            raise Invalid("a tag needs a key")
        return self._own(self.resource, scope).where(F.try_element_at("tags", F.lit(key)) == value).select("resource_id")

    def in_group(self, scope: TenantScope, group: str) -> DataFrame:
        if self.members is None:
            return self._own(self.resource, scope).where(F.lit(False)).select("resource_id")
        return self._own(self.members, scope).where(F.col("group_id") == group).select("resource_id").distinct()

    def descendants(self, scope: TenantScope, root: str, max_depth: int) -> DataFrame:
        if max_depth < 1:
            raise Invalid("descendants need a depth of 1 or more")
        if self.edges is None:
            return self.canonical(scope, [root])
        roots = self.canonical(scope, [root])
        return descendants(self._own(self.edges, scope), roots, max_depth).select("resource_id").distinct()

    def canonical(self, scope: TenantScope, ids: list[str]) -> DataFrame:
        """The current resources of ids; ids of other tenants and unknown ones vanish."""
        spark = self.resource.sparkSession
        asked = spark.createDataFrame([(i,) for i in sorted(set(ids))], "id string")
        return canonical_ids(asked, self._own(self.resource, scope), self.alias and self._own(self.alias, scope))

    def expanded(self, scope: TenantScope, ids: DataFrame) -> DataFrame:
        """Current ids with the historical ones that became them."""
        if self.alias is None or not self.with_history:
            return ids
        old = self._own(self.alias, scope).select(F.col("historical_id").alias("old"), F.col("current_id").alias("resource_id"))
        return ids.unionByName(old.join(ids, "resource_id", "left_semi").select(F.col("old").alias("resource_id"))).distinct()


def canonical_ids(ids: DataFrame, resource: DataFrame, alias: DataFrame | None) -> DataFrame:
    """(resource_id) that ids (id) stand for today: through the alias map, and only where the resource is there."""
    if alias is not None:
        ids = ids.join(alias.select(F.col("historical_id").alias("id"), "current_id"), "id", "left")
        ids = ids.select(F.coalesce("current_id", "id").alias("resource_id"))
    else:
        ids = ids.select(F.col("id").alias("resource_id"))
    return ids.distinct().join(resource.select("resource_id").distinct(), "resource_id")


def resolve(s: Selector, scope: TenantScope, catalog: Catalog | None) -> Resolved:
    if s.type == "all":
        return whole_tenant(scope)
    if s.type == "descendants" and s["max_depth"] < 1:
        raise Invalid("descendants need a depth of 1 or more")
    if s.type == "tagged" and not s["key"]:
        raise Invalid("a tag needs a key")
    if catalog is None:
        if s.type == "ids":
            return already(scope, [str(i) for i in s["ids"]])
        raise Invalid(f"selector {s.type} needs an inventory")
    if s.type == "ids" and not s["ids"]:
        return already(scope, [])
    found = {
        "ids": lambda: catalog.canonical(scope, [str(i) for i in s["ids"]]), "kind": lambda: catalog.of_kind(scope, s["kind"]),
        "site": lambda: catalog.at_site(scope, s["site"]), "group": lambda: catalog.in_group(scope, s["group"]),
        "tagged": lambda: catalog.tagged(scope, s["key"], s["value"]), "descendants": lambda: catalog.descendants(scope, s["root"], s["max_depth"]),
    }[s.type]()
    found = catalog.expanded(scope, found)
    # few ids are read here, for an IN list that the scan can use and for the empty set's warning
    some = [r.resource_id for r in found.limit(LISTED + 1).collect()]
    return Resolved(scope.tenant_id, tuple(sorted(set(some))) if len(some) <= LISTED else found)
