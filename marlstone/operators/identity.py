"""Identity resolution: which resource an observation is of.

Observations carry identifiers; those on record vote for resources.  Confidence is the noisy-or of the
identifiers that match; an identifier that is unique by specification and differs is a contradiction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How sure a match on one identifier is, and which identifiers are unique by specification.
CONFIDENCE = {
    "serial": 1.0, "chassis_id": 1.0, "snmp_engine_id": 1.0, "otel_host_id": 1.0, "mac": 0.9,
    "mgmt_ip": 0.8, "flow_exporter": 0.8, "hostname": 0.65, "service_name": 0.6,
}
UNIQUE = ("serial", "chassis_id", "snmp_engine_id", "otel_host_id")
MERGE_FROM, REVIEW_FROM = 0.95, 0.60


def normal(kind: Column, value: Column) -> Column:
    """An identifier's value as it is compared: names in lower case, wherever they come from."""
    return F.when(kind.isin("hostname", "chassis_id", "mac"), F.lower(F.trim(value))).otherwise(F.trim(value))


def confidence_of(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), kind), F.lit(0.0))


def noisy_or(c: Column) -> Column:
    """Aggregate: one minus the product of the doubts."""
    return 1 - F.product(1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def noisy_or_array(c: Column) -> Column:
    return 1 - F.aggregate(c, F.lit(1.0), lambda acc, x: acc * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))))


def _sets(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The distinct (kind, value) of each of some keys, as one array."""
    return rows.groupBy(*keys).agg(F.collect_set(F.struct("kind", normal(F.col("kind"), F.col("value")).alias("value"))).alias(name))


def _of_kind(pairs: str, kind: str) -> Column:
    return F.filter(pairs, lambda x: x["kind"] == kind)


def _touched(asked: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(obs_id, tenant_id, ids, resource_id, confidence, pairs, contradiction) of every resource that observations
    (obs_id, tenant_id, ids) touch, by one join with the identifiers on record and one with those of the resource."""
    stored = identifiers.select("tenant_id", "kind", normal(F.col("kind"), F.col("value")).alias("value"), "resource_id").distinct()
    hits = asked.select("obs_id", "tenant_id", "ids", F.inline("ids")).join(stored, ["tenant_id", "kind", "value"])
    touched = hits.groupBy("obs_id", "tenant_id", "resource_id").agg(
        noisy_or(confidence_of(F.col("kind"))).alias("confidence"), F.collect_set(F.struct("kind", "value")).alias("pairs"), F.first("ids").alias("ids"))
    own = _sets(identifiers.where(F.col("kind").isin(*UNIQUE)), ["tenant_id", "resource_id"], "own")
    out = touched.join(own, ["tenant_id", "resource_id"], "left")
    against = []
    for kind in UNIQUE:
        seen, theirs = (_of_kind(c, kind) for c in ("ids", "own"))
        against.append(F.when((F.size(seen) > 0) & (F.size(theirs) > 0) & ~F.arrays_overlap(seen, theirs), kind))
    return out.withColumn("contradiction", F.array_min(F.array_compact(F.array(*against)))).drop("own")


def candidates(observed: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(obs_id, tenant_id, resource_id, confidence, matched, contradiction): resources that an observation touches.

    A contradiction is an observed unique identifier of which the resource has another value on record. An
    identifier that is observed or on record several times counts once.
    """
    named = observed.where("kind IS NOT NULL AND value IS NOT NULL")
    out = _touched(_sets(named, ["obs_id", "tenant_id"], "ids"), identifiers)
    matched = F.array_sort(F.array_distinct(F.transform("pairs", lambda x: x["kind"])))
    return out.select("obs_id", "tenant_id", "resource_id", "confidence", matched.alias("matched"), "contradiction")


def resolve_observations(observed: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Each observation's outcome: (obs_id, tenant_id, outcome, reason, resource_id, confidence).

    A repeat sighting (every identifier on record, all of one resource) is matched whatever it is worth; else
    the best candidate, those without a contradiction first, is matched from 0.95, reviewed from 0.60, and
    otherwise a new resource is made. Observations are the distinct obs_id of ``observed``; one without
    identifiers has a row with a null kind.
    """
    # a null kind or value is collected as such and left out of the array
    named = F.filter("ids", lambda x: x["kind"].isNotNull() & x["value"].isNotNull())
    asked = _sets(observed, ["obs_id", "tenant_id"], "ids").withColumn("ids", named)
    order = F.struct(F.col("contradiction").isNotNull().alias("bad"), (-F.col("confidence")).alias("less"), "resource_id", "contradiction", "confidence")
    best = _touched(asked, identifiers).groupBy("obs_id", "tenant_id").agg(
        F.min(order).alias("b"), F.count(F.lit(1)).alias("resources"), F.size(F.array_distinct(F.flatten(F.collect_list("pairs")))).alias("hit"))
    out = asked.select("obs_id", "tenant_id", F.size("ids").alias("asked")).join(best, ["obs_id", "tenant_id"], "left").select("*", "b.resource_id", "b.contradiction", "b.confidence")
    clear = F.col("contradiction").isNull()
    repeat = clear & (F.col("resources") == 1) & (F.col("hit") == F.col("asked"))
    outcome = (
        F.when(F.col("resource_id").isNull(), "create").when(repeat, "match").when(~clear, "create")
        .when(F.col("confidence") >= MERGE_FROM, "match").when(F.col("confidence") >= REVIEW_FROM, "review").otherwise("create")
    )
    reason = (
        F.when(F.col("resource_id").isNull(), "no_match").when(repeat, "repeat").when(~clear, "contradiction")
        .when(F.col("confidence") >= REVIEW_FROM, "confidence").otherwise("below_floor")
    )
    return out.select("obs_id", "tenant_id", outcome.alias("outcome"), reason.alias("reason"), F.when(outcome != "create", F.col("resource_id")).alias("resource_id"), "confidence")


def resolve_batch(observed: DataFrame, identifiers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes of a micro-batch and the identifiers that are then on record.

    Equal identifier sets of one tenant are one observation, decided once, so the first sighting creates a
    resource and the others are of it. A new resource's id follows from its identifiers, so a replayed batch
    makes the same one.
    """
    sets = observed.where("kind IS NOT NULL AND value IS NOT NULL").select("obs_id", "tenant_id", "kind", normal(F.col("kind"), F.col("value")).alias("value"))
    keyed = sets.groupBy("obs_id", "tenant_id").agg(F.array_sort(F.collect_set(F.struct("kind", "value"))).alias("ids"))
    one = keyed.select("tenant_id", "ids").distinct().withColumn("set_id", F.sha2(F.concat_ws("\x1f", "tenant_id", F.to_json("ids")), 256))
    asked = one.select(F.col("set_id").alias("obs_id"), "tenant_id", F.inline("ids"))
    done = resolve_observations(asked, identifiers)
    new_id = F.concat_ws("-", *[F.substring("obs_id", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    decided = done.withColumn("resource_id", F.coalesce("resource_id", F.when(F.col("outcome") == "create", new_id)))
    sets_of = keyed.withColumn("set_id", F.sha2(F.concat_ws("\x1f", "tenant_id", F.to_json("ids")), 256)).select("obs_id", "tenant_id", "set_id")
    outcomes = sets_of.join(decided.withColumnRenamed("obs_id", "set_id"), ["set_id", "tenant_id"])
    gained = asked.join(decided.where("outcome <> 'review'").select("obs_id", "tenant_id", "resource_id"), ["obs_id", "tenant_id"]).select("tenant_id", "kind", "value", "resource_id")
    after = attach(identifiers.select("tenant_id", "kind", "value", "resource_id"), gained)
    return outcomes, after


def attach(stored: DataFrame, gained: DataFrame) -> DataFrame:
    """Identifiers with newly observed ones: a (tenant, kind, value) belongs to one resource, the stored one first."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(gained.withColumn("_new", F.lit(1)))
    return both.groupBy("tenant_id", "kind", "value").agg(F.min(F.struct("_new", "resource_id"))["resource_id"].alias("resource_id"))


def merge_resources(identifiers: DataFrame, alias: DataFrame, historical: str, surviving: str, tenant: str) -> tuple[DataFrame, DataFrame]:
    """Identifiers moved to the surviving resource, and the alias map with the historical one, collapsed."""
    if historical == surviving:
        raise ValueError("a resource can't be merged with itself")
    ours = F.col("tenant_id") == tenant
    moved = identifiers.withColumn("resource_id", F.when(ours & (F.col("resource_id") == historical), F.lit(surviving)).otherwise(F.col("resource_id")))
    return moved, add_alias(alias, tenant, historical, surviving)


def add_alias(alias: DataFrame, tenant: str, historical: str, current: str) -> DataFrame:
    """The alias map (tenant_id, historical_id, current_id) with one more, each entry one step from the present."""
    if historical == current:
        raise ValueError("a resource is no alias of itself")
    spark = alias.sparkSession
    target = alias.where((F.col("tenant_id") == tenant) & (F.col("historical_id") == current)).select(F.col("current_id").alias("_further"))
    new = spark.createDataFrame([(tenant, historical, current)], "tenant_id string, historical_id string, current_id string")
    new = new.join(F.broadcast(target.limit(1)), how="left").select("tenant_id", "historical_id", F.coalesce("_further", "current_id").alias("current_id"))
    final = new.select(F.col("current_id").alias("_to"))
    pointed = alias.join(F.broadcast(final)).select(
        "tenant_id", "historical_id",
        F.when((F.col("tenant_id") == tenant) & (F.col("current_id") == historical), F.col("_to")).otherwise(F.col("current_id")).alias("current_id"),
    ).where(~((F.col("tenant_id") == tenant) & (F.col("historical_id") == historical)))
    return pointed.unionByName(new).where("historical_id <> current_id")


def split_resource(identifiers: DataFrame, tenant: str, source: str, taken: list[tuple[str, str]], new_id: str) -> DataFrame:
    """Identifiers with some of a resource's moved to a new one."""
    spark = identifiers.sparkSession
    moved = spark.createDataFrame([(tenant, k, v, source, new_id) for k, v in taken], "tenant_id string, kind string, value string, resource_id string, _to string")
    out = identifiers.join(F.broadcast(moved), ["tenant_id", "kind", "value", "resource_id"], "left")
    return out.withColumn("resource_id", F.coalesce("_to", "resource_id")).drop("_to")


def pending_reviews(decisions: DataFrame, alias: DataFrame) -> DataFrame:
    """Review decisions that no later decision on the same observation answers, of resources not merged away."""
    reviews = decisions.where("outcome = 'review'")
    answered = decisions.where("outcome IN ('merge', 'split', 'dismiss', 'match', 'create')").select(
        F.col("tenant_id").alias("_t"), F.col("observed").alias("_o"), F.col("decided_at").alias("_at"))
    open_ = reviews.join(answered, (F.col("tenant_id") == F.col("_t")) & (F.col("observed") == F.col("_o")) & (F.col("_at") >= F.col("decided_at")), "left_anti")
    return open_.join(alias.select("tenant_id", F.col("historical_id").alias("resource_id")), ["tenant_id", "resource_id"], "left_anti")


def same_observation(observed: Column, other: Column) -> Column:
    """Whether two arrays of (kind, value) structs hold the same set."""
    return F.array_sort(F.array_distinct(observed)) == F.array_sort(F.array_distinct(other))


def provisional(observed: DataFrame) -> DataFrame:
    """(obs_id, name, kind) of resources nobody has named: by hostname, serial, address, host id, else the first
    identifier, else the source."""
    named = observed.groupBy("obs_id").agg(
        *[F.min(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("hostname", "serial", "mgmt_ip", "otel_host_id", "service_name")],
        F.min_by("value", F.when(F.col("value").isNotNull(), F.coalesce(F.col("pos"), F.lit(0))) if "pos" in observed.columns else F.col("kind")).alias("_first"), F.min("source").alias("_source"),
    )
    kind = F.when(F.col("otel_host_id").isNotNull(), "host").when(
        F.col("service_name").isNotNull() & F.col("mgmt_ip").isNull() & F.col("hostname").isNull(), "service").otherwise("device")
    name = F.coalesce("hostname", "serial", "mgmt_ip", "otel_host_id", "_first", F.concat(F.lit("unidentified-"), F.col("_source")))
    return named.select("obs_id", name.alias("name"), kind.alias("kind"))


def enrich(rows: DataFrame, resource: DataFrame) -> DataFrame:
    """Telemetry rows with site and vendor of their resource; unknown resources keep the nil site and no vendor."""
    from marlstone.functions.columns import NIL

    own = resource.select("tenant_id", "resource_id", F.col("site_id").alias("_site"), F.col("vendor").alias("_vendor"))
    out = rows.join(own, ["tenant_id", "resource_id"], "left")
    return out.withColumns({"site_id": F.coalesce("_site", F.lit(NIL)), "source_vendor": F.coalesce("_vendor", F.lit("")), "enriched": F.col("_site").isNotNull() | F.col("_vendor").isNotNull()}).drop("_site", "_vendor")


def attribute(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows with the resource of their observation; what isn't resolved is stored under the nil resource."""
    from marlstone.functions.columns import NIL

    return rows.drop("resource_id").join(outcomes.select("obs_id", "resource_id"), "obs_id", "left").withColumn("resource_id", F.coalesce("resource_id", F.lit(NIL)))
