"""Maintenance windows: when they are open, in their own time zone, and which resources they cover."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.errors import Invalid

MAX_MINUTES = 7 * 24 * 60
RECURRENCES = ("once", "daily", "weekly", "monthly")


@dataclass(frozen=True)
class Schedule:
    starts_at: datetime
    duration_minutes: int
    timezone: str
    recurrence: str = "once"
    weekday: int | None = None  # Monday is 0
    day: int | None = None
    until: datetime | None = None

    def validate(self) -> None:
        try:
            ZoneInfo(self.timezone)
        except Exception as e:
            raise Invalid(f"no such time zone: {self.timezone}") from e
        if self.duration_minutes < 1:
            raise Invalid("a window lasts a minute or more")
        if self.duration_minutes > MAX_MINUTES:
            raise Invalid("a window lasts a week at most")
        if self.recurrence not in RECURRENCES:
            raise Invalid(f"no such recurrence: {self.recurrence}")
        if self.recurrence == "weekly" and not (self.weekday is not None and 0 <= self.weekday <= 6):
            raise Invalid("a weekly window needs a weekday")
        if self.recurrence == "monthly" and not (self.day is not None and 1 <= self.day <= 31):
            raise Invalid("a monthly window needs a day from 1 to 31")
        if self.until and self.until < self.starts_at:
            raise Invalid("a window can't end before it starts")


def is_open(at: Column) -> Column:
    """Whether a window (columns starts_at, duration_minutes, timezone, recurrence, weekday, day, until) is open.

    The occurrence that began today or yesterday, by the window's own calendar, is looked at. A local time that
    a clock change skips doesn't occur; of one that occurs twice, the earlier counts. An unknown time zone
    leaves the window shut.
    """
    zone = F.col("timezone")
    known = F.coalesce(F.try_to_timestamp(F.lit("2000-01-01")), F.lit(None)).isNotNull() & zone.rlike(r"^[A-Za-z][A-Za-z0-9_+\-/]*$")
    first = F.from_utc_timestamp(F.col("starts_at"), zone)
    today = F.to_date(F.from_utc_timestamp(at, zone))
    time_of_day = F.unix_micros(first) - F.unix_micros(F.date_trunc("day", first))

    def covers(day: Column) -> Column:
        local = F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + time_of_day)
        start = F.to_utc_timestamp(local, zone)
        happens = F.from_utc_timestamp(start, zone) == local
        recurs = (
            F.when(F.col("recurrence") == "once", day == F.to_date(first)).when(F.col("recurrence") == "daily", F.lit(True))
            .when(F.col("recurrence") == "weekly", F.weekday(day) == F.col("weekday")).when(F.col("recurrence") == "monthly", F.dayofmonth(day) == F.col("day"))
        )
        began = (day >= F.to_date(first)) & F.coalesce(recurs, F.lit(False)) & happens & (at >= start)
        return F.when(began, at < F.timestamp_micros(F.unix_micros(start) + F.col("duration_minutes").cast("long") * F.lit(60_000_000)))

    # the latest occurrence that has begun decides
    covered = F.coalesce(covers(today), covers(F.date_sub(today, 1)), F.lit(False))
    within = (at >= F.col("starts_at")) & (F.col("until").isNull() | (at <= F.col("until")))
    return F.when(known, within & covered).otherwise(F.lit(False))


def covered(windows: DataFrame, resources: DataFrame, members: DataFrame) -> DataFrame:
    """(window_id, resource_id, suppress_alerts, suppress_notifications) of windows by target: a resource, a
    group's members, or a site's resources. A device's children are not covered with it."""
    own = [*(c for c in ("window_id", "tenant_id", "suppress_alerts", "suppress_notifications"))]
    return _of_targets(windows, resources, members, own).drop("tenant_id").distinct()


def silenced(windows: DataFrame, resources: DataFrame, members: DataFrame) -> DataFrame:
    """(resource_id, suppress_alerts, suppress_notifications) of the same windows, without which one it is: those of one target
    are one before they meet its resources, so many windows of a large group aren't paired with all its members."""
    own = ["tenant_id", "suppress_alerts", "suppress_notifications"]
    targets = windows.groupBy("tenant_id", "target_kind", "target_id").agg(*[F.bool_or(c).alias(c) for c in own[1:]])
    return _of_targets(targets, resources, members, own).drop("tenant_id")


def _of_targets(windows: DataFrame, resources: DataFrame, members: DataFrame, own: list[str]) -> DataFrame:
    by = lambda kind: windows.where(F.col("target_kind") == kind)
    one = by("resource").select(*own, F.col("target_id").alias("resource_id")).join(resources.select("tenant_id", "resource_id"), ["tenant_id", "resource_id"], "left_semi")
    group = by("group").join(members.select("tenant_id", F.col("group_id").alias("target_id"), "resource_id"), ["tenant_id", "target_id"]).select(*own, "resource_id")
    site = by("site").join(resources.select("tenant_id", F.col("site_id").alias("target_id"), "resource_id"), ["tenant_id", "target_id"]).select(*own, "resource_id")
    return one.select(*own, "resource_id").unionByName(group).unionByName(site)
