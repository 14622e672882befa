"""Inventory tables: lists, upserts and joins of the control plane. Plain tables have no MERGE, so an upsert
gives the table's next state, to be written in its place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.plans.errors import Invalid

PAGE, MOST_PAGE = 50, 500
MOST_TAGS, MOST_TAG_BYTES = 64, 256


def resource_page(resources: DataFrame, tenant: str, kind: str | None = None, site: str | None = None, status: str | None = None, search: str | None = None, after: str | None = None, limit: int = PAGE) -> tuple[DataFrame, int]:
    """A page by key, one row more than ``limit`` to tell whether there is a next, and the limit applied."""
    limit = max(1, min(limit, MOST_PAGE))
    out = resources.where(F.col("tenant_id") == tenant)
    for c, v in (("kind", kind), ("site_id", site), ("status", status)):
        out = out.where(F.col(c) == v) if v is not None else out
    if search:
        low = F.lower(F.lit(search))
        out = out.where(F.contains(F.lower("name"), low) | F.coalesce(F.contains(F.lower("display_name"), low), F.lit(False)))
    if after is not None:
        out = out.where(F.col("resource_id") > after)
    return out.orderBy("resource_id").limit(limit + 1), limit


def pollable(resources: DataFrame, identifiers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Devices in use with a management address, and their enabled profile if they have one."""
    address = identifiers.where("kind = 'mgmt_ip'").groupBy("tenant_id", "resource_id").agg(F.min("value").alias("mgmt_ip"))
    enabled = profiles.where("enabled").select("tenant_id", "resource_id", "profile_id")
    live = resources.where("status <> 'decommissioned'")
    return live.join(address, ["tenant_id", "resource_id"]).join(enabled, ["tenant_id", "resource_id"], "left")


def groups_with_counts(groups: DataFrame, members: DataFrame) -> DataFrame:
    counted = members.groupBy("tenant_id", "group_id").agg(F.count_distinct("resource_id").alias("members"))
    return groups.join(counted, ["tenant_id", "group_id"], "left").withColumn("members", F.coalesce("members", F.lit(0)))


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    """Members with new ones; those already there stay as they are."""
    keys = ["tenant_id", "group_id", "resource_id"]
    return members.unionByName(new.dropDuplicates(keys).join(members.select(*keys), keys, "left_anti").select(*members.columns))


def remove_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone, ["tenant_id", "group_id", "resource_id"], "left_anti")


def check_tags(tags: dict[str, str]) -> None:
    if len(tags) > MOST_TAGS:
        raise Invalid(f"at most {MOST_TAGS} tags")
    for k, v in tags.items():
        if not k or not isinstance(v, str) or max(len(k.encode()), len(v.encode())) > MOST_TAG_BYTES:
            raise Invalid(f"a tag is a key and a text of at most {MOST_TAG_BYTES} bytes: {k!r}")


def upsert_candidates(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Discovery candidates by fingerprint with a new sighting: gaps are filled, promoted and ignored ones keep
    their status, first_seen stays and last_seen moves on."""
    keys = ["tenant_id", "fingerprint"]
    old = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in stored.columns if c not in keys])
    new = seen.groupBy(*keys).agg(*[F.max_by(c, "last_seen").alias(c) for c in seen.columns if c not in (*keys, "last_seen")], F.max("last_seen").alias("last_seen"))
    j = old.join(new, keys, "full")
    cols = []
    for c in stored.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c == "status":
            cols.append(F.when(F.col("_status").isin("promoted", "ignored"), F.col("_status")).otherwise(F.coalesce("status" if "status" in seen.columns else "_status", "_status", F.lit("new"))).alias(c))
        elif c == "first_seen":
            cols.append(F.coalesce("_first_seen", "last_seen").alias(c))
        elif c == "last_seen":
            cols.append(F.greatest("_last_seen", "last_seen").alias(c))
        else:
            cols.append(F.coalesce(c, f"_{c}").alias(c) if c in seen.columns else F.col(f"_{c}").alias(c))
    return j.select(*cols)


def upsert_children(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Child resources by (tenant, parent, name): attributes merge, the newly found winning; names that people
    gave stay."""
    keys = ["tenant_id", "parent_id", "name"]
    new = found.groupBy(*keys).agg(F.max_by("attributes", F.size("attributes")).alias("_attributes"))
    j = stored.join(new, keys, "full")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old_only = F.map_filter(F.coalesce("attributes", none), lambda k, _: ~F.map_contains_key(F.coalesce(F.col("_attributes"), none), k))
    return j.withColumn("attributes", F.map_concat(old_only, F.coalesce("_attributes", none))).drop("_attributes")


def record_facts(resources: DataFrame, facts: DataFrame, columns: tuple[str, ...] = ("vendor", "model", "os_version")) -> DataFrame:
    """Resources with facts of a device; a null fact leaves the column alone."""
    new = facts.select("tenant_id", "resource_id", *[F.col(c).alias(f"_{c}") for c in columns])
    j = resources.join(new, ["tenant_id", "resource_id"], "left")
    return j.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def effective_profiles(profiles: DataFrame, tenant: str) -> DataFrame:
    """One profile for each key: the tenant's own before the built-in, then the highest version."""
    usable = profiles.where(F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant))
    order = Window.partitionBy("profile_key").orderBy(F.col("tenant_id").isNull(), F.col("version").desc())
    return usable.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def set_status(resources: DataFrame, checks: DataFrame) -> DataFrame:
    """Resources with checked statuses; maintenance and decommissioned outrank a check."""
    j = resources.join(checks.select("tenant_id", "resource_id", F.col("status").alias("_status")), ["tenant_id", "resource_id"], "left")
    fixed = F.col("status").isin("maintenance", "decommissioned")
    return j.withColumn("status", F.when(fixed, F.col("status")).otherwise(F.coalesce("_status", "status"))).drop("_status")
