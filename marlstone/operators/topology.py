"""The resource graph: descendants, neighbours, edges, and prefix lookups of devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Edge kinds that descend: the source depends on, is in, is hosted by or runs on the target.
DESCENDING = ("depends_on", "member_of", "hosts", "runs")


def descendants(edges: DataFrame, roots: DataFrame, max_depth: int, kinds: tuple[str, ...] = DESCENDING) -> DataFrame:
    """(resource_id, depth): everything within ``max_depth`` steps of the roots, which have depth 0.

    A level is one join of the level before with the edges, without those of its own depth twice; what is reached again,
    as in a cycle, keeps its least depth. The depth bounds the walk, so nothing is run, kept or collected meanwhile, and the
    levels that the union names several times are one exchange each.
    """
    steps = edges.where(F.col("kind").isin(*kinds)).select(F.col("target_id").alias("resource_id"), F.col("source_id").alias("next")).distinct()
    level = roots.select("resource_id").distinct()
    every = level.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        level = level.join(steps, "resource_id").select(F.col("next").alias("resource_id")).distinct()
        every = every.unionByName(level.withColumn("depth", F.lit(depth)))
    return every.groupBy("resource_id").agg(F.min("depth").alias("depth"))


def descendants_sql(spark, max_depth: int, kinds: tuple[str, ...] = DESCENDING) -> DataFrame:
    """The same as one recursive query over the views ``edges`` and ``roots``: (resource_id, depth, path).

    Paths carry the cycle guard; a node reached on two paths has two rows.
    """
    return spark.sql(
        f"""WITH RECURSIVE walk(resource_id, depth, path) AS (
        SELECT resource_id, 0, array(resource_id) FROM roots
        UNION ALL SELECT e.source_id, w.depth + 1, array_append(w.path, e.source_id) FROM walk w JOIN edges e ON e.target_id = w.resource_id
        WHERE e.kind IN ({", ".join(f"'{k}'" for k in kinds)}) AND w.depth < {int(max_depth)} AND NOT array_contains(w.path, e.source_id))
        SELECT * FROM walk"""
    )


def undirected(edges: DataFrame, a: str = "a", b: str = "b", seen: str = "seen_at") -> DataFrame:
    """One row for each pair of ends, the lesser first, with the first and last time seen; no self-loops."""
    return (
        edges.where(F.col(a) != F.col(b)).groupBy(F.least(a, b).alias("source_id"), F.greatest(a, b).alias("target_id"))
        .agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))
    )


def upsert_edges(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored edges with the newly seen: last_seen moves on, first_seen stays."""
    both = stored.select("source_id", "target_id", "first_seen", "last_seen").unionByName(found.select("source_id", "target_id", "first_seen", "last_seen"))
    return both.groupBy("source_id", "target_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


NEIGHBOUR = ("seen_from", "protocol", "chassis_id", "sys_name", "mgmt_ip", "port", "platform")


def _usable(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def merge_neighbours(rows: DataFrame) -> DataFrame:
    """One row for each neighbour that a device reports over LLDP, CDP and ARP.

    Rows (NEIGHBOUR columns) that agree on the chassis, else on the system name (letter case aside), of one
    device are one neighbour; LLDP's values win and CDP's fill the gaps. ARP rows stand for themselves unless
    their address is already a neighbour's. Rows with neither address, chassis nor name are dropped.
    """
    clean = rows.select("seen_from", "protocol", *[_usable(c).alias(c) for c in NEIGHBOUR[2:]])
    clean = clean.where("chassis_id IS NOT NULL OR sys_name IS NOT NULL OR mgmt_ip IS NOT NULL")
    told, arp = clean.where("protocol <> 'arp'"), clean.where("protocol = 'arp'")
    # a CDP row without a chassis takes the one that LLDP gives for the same name
    names = told.where("chassis_id IS NOT NULL AND sys_name IS NOT NULL").groupBy("seen_from", F.lower("sys_name").alias("_name")).agg(F.min(F.lower("chassis_id")).alias("_chassis"))
    keyed = told.withColumn("_name", F.lower("sys_name")).join(names, ["seen_from", "_name"], "left")
    key = F.coalesce(F.lower("chassis_id"), "_chassis", F.concat(F.lit("name:"), "_name"), F.concat(F.lit("ip:"), "mgmt_ip"))
    order = F.struct(F.when(F.col("protocol") == "lldp", 0).otherwise(1), "port")
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    merged = keyed.groupBy("seen_from", key.alias("_key")).agg(F.max("protocol").alias("protocol"), *[first(c) for c in NEIGHBOUR[2:]]).drop("_key")
    heard = arp.dropDuplicates(["seen_from", "mgmt_ip", "chassis_id"]).join(
        merged.where("mgmt_ip IS NOT NULL").select("seen_from", "mgmt_ip").distinct(), ["seen_from", "mgmt_ip"], "left_anti")
    return merged.select(*NEIGHBOUR).unionByName(heard.select(*NEIGHBOUR))


def identify_neighbours(neighbours: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Each neighbour with ``match`` (known, ambiguous, unknown) and resource_id where known.

    A chassis that is on record decides alone; else every identifier that is on record must agree. Nothing is
    created. MAC addresses that ARP gives are no identifiers.
    """
    n = neighbours.withColumn("_n", F.xxhash64(*NEIGHBOUR))
    ids = F.array(
        F.struct(F.lit("chassis_id").alias("kind"), F.when(F.col("protocol") != "arp", F.lower("chassis_id")).alias("value")),
        F.struct(F.lit("mgmt_ip").alias("kind"), F.col("mgmt_ip").alias("value")), F.struct(F.lit("hostname").alias("kind"), F.lower("sys_name").alias("value")),
    )
    asked = n.select("_n", "seen_from", F.inline(F.filter(ids, lambda x: x["value"].isNotNull())))
    on_record = identifiers.select("kind", F.when(F.col("kind").isin("hostname", "chassis_id"), F.lower("value")).otherwise(F.col("value")).alias("value"), "resource_id")
    hits = asked.join(on_record, ["kind", "value"]).groupBy("_n").agg(
        F.min(F.when(F.col("kind") == "chassis_id", F.col("resource_id"))).alias("sure"), F.count_distinct("resource_id").alias("k"), F.min("resource_id").alias("one"),
    )
    out = n.join(hits, "_n", "left")
    match = F.when(F.col("sure").isNotNull() | (F.col("k") == 1), "known").when(F.col("k") > 1, "ambiguous").otherwise("unknown")
    return out.select(*NEIGHBOUR, match.alias("match"), F.when(match == "known", F.coalesce("sure", "one")).alias("resource_id"))


def neighbour_edges(identified: DataFrame) -> DataFrame:
    """Edges between a device and its known neighbours, without those to itself."""
    known = identified.where("match = 'known' AND resource_id <> seen_from")
    return known.select(F.least("seen_from", "resource_id").alias("source_id"), F.greatest("seen_from", "resource_id").alias("target_id"), "protocol").distinct()


def oid_starts(oid: Column, prefix: Column) -> Column:
    """Whether an OID is within another, arc by arc."""
    dotted = lambda c: F.concat(F.ltrim(c, F.lit(".")), F.lit("."))
    return F.startswith(dotted(oid), dotted(prefix))


def match_profiles(devices: DataFrame, profiles: DataFrame, fallback: str = "generic-snmp") -> DataFrame:
    """Each device (device_id, explicit, sysobjectid) with its profile: the one set explicitly, else that of
    the longest matching prefix (profiles: profile_id, prefix), ties by id, else the fallback if it exists.

    Every device's prefixes are looked up by equality, longest first, so no pair that doesn't match is made.
    """
    arcs = F.split(F.ltrim("sysobjectid", F.lit(".")), "\\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(arcs)), lambda i: F.array_join(F.slice(arcs, 1, i), "."))
    known = profiles.select(F.ltrim("prefix", F.lit(".")).alias("prefix"), "profile_id").groupBy("prefix").agg(F.min("profile_id").alias("profile_id"))
    tried = devices.where("sysobjectid IS NOT NULL AND sysobjectid <> ''").select("device_id", F.explode(prefixes).alias("prefix")).join(known, "prefix")
    best = tried.groupBy("device_id").agg(F.max_by("profile_id", F.length("prefix")).alias("by_oid"))
    named = profiles.select(F.col("profile_id").alias("explicit"), F.col("profile_id").alias("by_name")).distinct()
    rest = F.lit(fallback) if fallback else F.lit(None)
    chosen = F.coalesce("by_name", "by_oid", rest)
    reason = F.when(F.col("by_name").isNotNull(), "explicit").when(F.col("by_oid").isNotNull(), "sysobjectid").otherwise("fallback")
    return devices.join(named, "explicit", "left").join(best, "device_id", "left").select("device_id", chosen.alias("profile_id"), reason.alias("reason"))


def mac_hex(text: Column) -> Column:
    """Twelve lower-case hex digits of a MAC address in any of the usual notations; null for other texts."""
    plain = F.lower(F.translate(text, ":-. ", ""))
    return F.when(plain.rlike("^[0-9a-f]{12}$"), plain)


def mac_bits(mac: Column) -> tuple[Column, Column]:
    """Whether a MAC address (twelve hex digits) is locally administered, and whether multicast."""
    first = F.conv(F.substring(mac, 1, 2), 16, 10).cast("int")
    return first.bitwiseAND(F.lit(2)) != 0, first.bitwiseAND(F.lit(1)) != 0


def with_vendor(df: DataFrame, registry: DataFrame, mac: str = "mac") -> DataFrame:
    """``df`` with ``vendor``: the organisation of the longest of a MAC's 36, 28 and 24-bit prefixes on the
    registry (prefix, organisation). Locally administered and multicast addresses have none.

    The registry is a bounded public table of some 50 000 rows, which the optimizer may broadcast.
    """
    out = df.withColumn("_mac", mac_hex(F.col(mac)))
    local, multicast = mac_bits(F.col("_mac"))
    found = []
    for width in (9, 7, 6):
        side = registry.where(F.length("prefix") == width).groupBy(F.lower("prefix").alias(f"_p{width}")).agg(F.min("organisation").alias(f"_o{width}"))
        out = out.withColumn(f"_p{width}", F.substring("_mac", 1, width)).join(side, f"_p{width}", "left").drop(f"_p{width}")
        found.append(F.col(f"_o{width}"))
    vendor = F.when(~(local | multicast), F.coalesce(*found))
    return out.withColumn("vendor", vendor).drop("_mac", *[f"_o{w}" for w in (9, 7, 6)])
