"""Polled devices: readings to metric rows, reachability checks, address sweeps, schedules."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.columns import NIL
from marlstone.plans.errors import Invalid

MOST_ADDRESSES, LEAST_PREFIX = 65_536, 16


def scalar_rows(requests: DataFrame, readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metric rows of requested scalars (device_id, metric, oid, unit), and those without a reading.

    Readings (device_id, oid, value, observed_at) are of the object itself or its instance 0; the exact one
    counts before the instance.
    """
    asked = requests.withColumn("_oid", F.explode(F.array("oid", F.concat("oid", F.lit(".0")))))
    j = asked.join(readings.select("device_id", F.col("oid").alias("_oid"), "value", "observed_at"), ["device_id", "_oid"])
    best = j.groupBy("device_id", "metric", "oid", "unit").agg(
        F.min_by("value", F.length("_oid")).alias("value"), F.min_by("observed_at", F.length("_oid")).alias("observed_at"))
    skipped = requests.join(best.select("device_id", "metric", "oid"), ["device_id", "metric", "oid"], "left_anti")
    return best, skipped


def interface_rows(request_oid: str, metric: str, readings: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Metric rows of one column: what follows the object id is the interface's index, a label; with
    ``names`` (device_id, idx, name) its name is another."""
    prefix = request_oid.rstrip(".") + "."
    own = readings.where(F.startswith("oid", F.lit(prefix))).select("device_id", F.substring("oid", len(prefix) + 1, 1 << 20).alias("idx"), "value", "observed_at")
    own = own.where(F.col("idx") != "")
    if names is not None:
        own = own.join(names.select("device_id", "idx", "name"), ["device_id", "idx"], "left")
    else:
        own = own.withColumn("name", F.lit(None).cast("string"))
    label = F.create_map(F.lit("network.interface.index"), F.col("idx"))
    named = F.create_map(F.lit("network.interface.index"), F.col("idx"), F.lit("network.interface.name"), F.col("name"))
    return own.select("device_id", F.lit(metric).alias("metric"), "value", "observed_at", F.when(F.col("name").isNull(), label).otherwise(named).alias("labels"))


def reachability(attempts: DataFrame, retries: int = 3) -> DataFrame:
    """(check_id, up, attempt): whether one of the first attempts (numbered from 1) succeeded, and which."""
    own = attempts.where(F.col("attempt") <= max(retries, 1))
    return own.groupBy("check_id").agg(F.bool_or("ok").alias("up"), F.min(F.when(F.col("ok"), F.col("attempt"))).alias("attempt"))


def check_sentence(kind: Column, port: Column, up: Column, attempt: Column) -> Column:
    """A check's outcome in words."""
    what = F.when(kind == "tcp", F.format_string("TCP port %d", port.cast("int"))).otherwise(F.lit("ping"))
    return F.when(~up, F.concat(what, F.lit(" without an answer"))).when(attempt > 1, F.format_string("%s answered, attempt %d", what, attempt.cast("int"))).otherwise(F.concat(what, F.lit(" answered")))


def check_ranges(ranges: list[str]) -> list[ipaddress.IPv4Network]:
    if not ranges:
        raise Invalid("a sweep needs a range")
    out = []
    for r in ranges:
        try:
            n = ipaddress.IPv4Network(r, strict=False)
        except ValueError as e:
            raise Invalid(f"not a range: {r}") from e
        if n.prefixlen < LEAST_PREFIX:
            raise Invalid(f"a range has a prefix of {LEAST_PREFIX} or more: {r}")
        out.append(n)
    if sum(n.num_addresses for n in out) > MOST_ADDRESSES:
        raise Invalid(f"a sweep has at most {MOST_ADDRESSES} addresses")
    return out


def sweep(spark: SparkSession, ranges: list[str]) -> DataFrame:
    """(address) of every host of the ranges, once; network and broadcast addresses are none, but in ranges of one
    or two addresses all are hosts."""
    out = None
    for n in check_ranges(ranges):
        edge = 0 if n.prefixlen >= 31 else 1
        first, last = int(n.network_address) + edge, int(n.broadcast_address) - edge
        own = spark.range(first, last + 1).select("id")
        out = own if out is None else out.unionByName(own)
    octet = lambda s: F.shiftright("id", s).bitwiseAND(F.lit(255)).cast("string")
    return out.distinct().select(F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)).alias("address"))


def sighting_identifiers(address: Column, name: Column) -> Column:
    """Identifiers of a device that answered a sweep."""
    both = F.array(F.struct(F.lit("mgmt_ip").alias("kind"), address.alias("value")), F.struct(F.lit("hostname").alias("kind"), F.lower(F.trim(name)).alias("value")))
    return F.filter(both, lambda x: F.coalesce(x["value"], F.lit("")) != "")


def sweep_outcomes(answers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(outcome, n): answers (obs_id, named, refused) of a sweep counted by what became of them; those that gave no
    name or refused are candidates."""
    j = answers.join(outcomes.select("obs_id", "outcome"), "obs_id", "left")
    became = F.when(~F.col("named") | F.col("refused"), "candidate").when(F.col("outcome") == "match", "merged").when(F.col("outcome") == "review", "for_review").otherwise("created")
    return j.groupBy(became.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def schedule(jobs: DataFrame, ticks: int) -> DataFrame:
    """(job_id, run, tick) of jobs (job_id, every) over so many ticks: each starts at an offset within its interval
    and is moved by up to a tenth of it, both by a hash, so that jobs don't run at once."""
    every = F.col("every")
    offset = F.pmod(F.xxhash64("job_id"), every)
    runs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.lit(ticks) - 1 - offset) / every).cast("int")))
    out = jobs.where(offset < ticks).select("job_id", "every", offset.alias("_offset"), F.explode(runs).alias("run"))
    tenth = F.greatest(F.lit(1), F.floor(every / 10).cast("long"))
    jitter = F.when(F.col("run") > 0, F.pmod(F.xxhash64("job_id", "run"), 2 * tenth + 1) - tenth).otherwise(0)
    tick = F.col("_offset") + F.col("run") * every + F.when(every >= 10, jitter).otherwise(0)
    return out.select("job_id", "run", tick.alias("tick")).where(F.col("tick") < ticks)


def nearest_rank(df: DataFrame, value: str, percent: int) -> DataFrame:
    """The value at a percentile by nearest rank."""
    return df.agg(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})").alias("value"))


def metric_table(rows: DataFrame, tenant: str, device_resource: DataFrame) -> DataFrame:
    """Metric rows in the stored columns, by the resource of each device."""
    j = rows.join(device_resource.select("device_id", "resource_id", "site_id"), "device_id", "left")
    have = set(rows.columns)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return j.select(
        F.lit(tenant).alias("tenant_id"), F.coalesce("resource_id", F.lit(NIL)).alias("resource_id"), F.coalesce("site_id", F.lit(NIL)).alias("site_id"), "metric", "observed_at",
        F.col("observed_at").alias("ingested_at"), F.col("value").cast("double").alias("value"), (F.col("unit") if "unit" in have else F.lit("")).alias("unit"),
        (F.col("labels") if "labels" in have else empty).alias("labels"),
    )
