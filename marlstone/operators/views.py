"""What screens derive from queries: histograms, facets, series, overviews."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.functions.columns import at_least, bucket
from marlstone.operators.lower import Engine
from marlstone.plans.ast import Aggregation, Field, Query, Sort, TimeRange, attr, compare
from marlstone.plans.ast import bucket as time_bucket
from marlstone.plans.scope import TenantScope

#: Bucket widths, in seconds, that charts use.
BUCKET_STEPS = (1, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400)
FACET_LIMIT = 8
AROUND, AROUND_LIMIT = timedelta(minutes=5), 25
MOST_BARS = 5000
PREFERRED = ("observed_at", "severity", "resource_id", "metric", "value", "host_name", "body", "summary", "reason")


def bucket_seconds(start: datetime, end: datetime, target: int = 60) -> int:
    """The least width that gives at most about ``target`` bars, and a day at most."""
    ideal = max(1, round((end - start).total_seconds())) / target
    return next((s for s in BUCKET_STEPS if s >= ideal), BUCKET_STEPS[-1])


def histogram_query(q: Query, seconds: int, split: Field | None = None) -> Query:
    """The same rows, counted by bucket (and by another field)."""
    at = time_bucket(seconds)
    return replace(q, aggregations=(Aggregation("count", "n"),), group_by=(at, *([split] if split else ())), order_by=(Sort(field=at),), limit=1000, offset=0)


def facet_query(q: Query, by: Field, limit: int = FACET_LIMIT) -> Query:
    """The same rows, counted by the most frequent values of a field."""
    return replace(q, aggregations=(Aggregation("count", "n"),), group_by=(by,), order_by=(Sort(alias="n", desc=True),), limit=limit, offset=0)


def panel_query(q: Query, start: datetime, end: datetime) -> Query:
    """A stored panel over another window, with bars that fit it."""
    width = bucket_seconds(start, end)
    swap = lambda f: time_bucket(width) if f.name == "time_bucket" else f
    return replace(q, time=TimeRange(start, end), group_by=tuple(map(swap, q.group_by)), order_by=tuple(replace(s, field=swap(s.field)) if s.field else s for s in q.order_by))


def reporting_query(metric: str, start: datetime, end: datetime) -> Query:
    """Rows of a metric by resource, as a screen lists them; :func:`reporting` is how many report."""
    return Query("metric", TimeRange(start, end), filter=compare(Field("metric"), "eq", metric), aggregations=(Aggregation("count", "n"),), group_by=(Field("resource_id"),), limit=10_000)


def reporting(engine: Engine, scope: TenantScope, metric: str, start: datetime, end: datetime) -> DataFrame:
    """(n): how many resources report a metric, without the limit of a query's rows."""
    return engine.query(reporting_query(metric, start, end), scope, whole=True).df.agg(F.count(F.lit(1)).alias("n"))


def noisy_hosts_query(start: datetime, end: datetime, floor: str = "error") -> Query:
    """The hosts with the most rows of a severity or worse."""
    q = Query("log", TimeRange(start, end), filter=compare(Field("severity"), "in", tuple(at_least(floor))))
    return facet_query(q, attr("host.name"))


def volume_query(start: datetime, end: datetime) -> Query:
    """Log rows by bucket and severity."""
    return histogram_query(Query("log", TimeRange(start, end)), bucket_seconds(start, end), Field("severity"))


def around_queries(resource_id: str, at: datetime, tenant_limit: int = AROUND_LIMIT) -> dict[str, Query]:
    """One query for each signal of a resource, five minutes around a row's time."""
    from marlstone.plans.ast import Selector

    ids = Selector("ids", (("ids", (resource_id,)),))
    return {s: Query(s, TimeRange(at - AROUND, at + AROUND), ids, order_by=(Sort(field=Field("observed_at"), desc=True),), limit=tenant_limit) for s in ("log", "event", "state", "metric")}


def around(tables: dict[str, DataFrame], tenant_id: str, resource_id: str, at: datetime, limit: int = AROUND_LIMIT) -> DataFrame:
    """The same as one table: (signal, observed_at, text), the newest of each signal."""
    text = {
        "logs": ("log", F.col("body")), "events": ("event", F.col("summary")), "states": ("state", F.concat_ws(" to ", "previous_status", "current_status")),
        "metrics": ("metric", F.concat_ws(" ", "metric", F.col("value").cast("string"))),
    }
    out = None
    for name, (signal, said) in text.items():
        if name not in tables:
            continue
        own = tables[name].where((F.col("tenant_id") == tenant_id) & (F.col("resource_id") == resource_id))
        own = own.where((F.col("observed_at") >= F.lit(at - AROUND)) & (F.col("observed_at") < F.lit(at + AROUND)))
        own = own.select(F.lit(signal).alias("signal"), "observed_at", said.alias("text")).orderBy(F.col("observed_at").desc(), "text").limit(limit)
        out = own if out is None else out.unionByName(own)
    return out


def densify(counts: DataFrame, start: datetime, end: datetime, seconds: int, at: str = "g0", n: str = "n") -> DataFrame:
    """A histogram with a row for every bucket of the window, empty ones as 0."""
    first = int(start.timestamp()) // seconds * seconds
    bars = min(MOST_BARS, -(-(int(end.timestamp()) - first) // seconds))
    spark = counts.sparkSession
    every = spark.range(bars).select(F.timestamp_seconds(F.lit(first) + F.col("id") * F.lit(seconds)).alias(at))
    return every.join(counts.groupBy(at).agg(F.sum(n).alias(n)), at, "left").select(at, F.coalesce(n, F.lit(0)).alias(n))


def series(result: DataFrame) -> DataFrame:
    """(at, series, value) of a result: time first, value last, what is between named together; nulls go."""
    first, *middle, last = result.columns
    name = F.concat_ws(" · ", *[F.col(c).cast("string") for c in middle]) if middle else F.lit(last)
    return result.where(F.col(last).isNotNull()).select(F.col(first).alias("at"), name.alias("series"), F.col(last).cast("double").alias("value"))


def latest(result: DataFrame) -> DataFrame:
    """The newest value that is not null, of a result with time first and value last."""
    first, last = result.columns[0], result.columns[-1]
    return result.agg(F.max_by(last, F.when(F.col(last).isNotNull(), F.col(first))).alias("value"))


def display_order(columns: list[str]) -> list[str]:
    """Columns as a table shows them: without the tenant, the telling ones first."""
    rest = [c for c in columns if c != "tenant_id"]
    return [c for c in PREFERRED if c in rest] + [c for c in rest if c not in PREFERRED]


def tail_buffer(shown: list, page: list, most: int = 1000) -> list:
    """What a live view holds after a poll: the newest first, ``most`` rows at most."""
    return [*page, *shown][:most]


def site_overview(sites: DataFrame, resources: DataFrame) -> DataFrame:
    """Every site with its resources by status; those out of use don't count."""
    live = resources.where("status <> 'decommissioned'").groupBy("site_id").agg(
        F.count(F.lit(1)).alias("resources"), *[F.count_if(F.col("status") == s).alias(s) for s in ("up", "down", "degraded", "maintenance", "unknown")])
    counted = [c for c in live.columns if c != "site_id"]
    return sites.join(live, "site_id", "left").select(*sites.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in counted])


def transitions(df: DataFrame, key: str, status: str, at: list[str]) -> DataFrame:
    """Rows at which a status differs from the one before; the first row is one, from null."""
    w = Window.partitionBy(key).orderBy(*at)
    return df.withColumn("previous_status", F.lag(status).over(w)).where(~F.col("previous_status").eqNullSafe(F.col(status))).withColumnRenamed(status, "current_status")


def tumbling(df: DataFrame, at: str, seconds: int):
    """Groups of a tumbling window."""
    return df.groupBy(bucket(F.col(at), seconds).alias("bucket"))


def bad_rows(q: Query, floor: str) -> Query:
    return q.where(compare(Field("severity"), "gte", floor))


