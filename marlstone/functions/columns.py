"""Column expressions that several operators share. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from the least to the most severe; the ordinal starts at 1.
SEVERITIES = ("trace", "debug", "info", "notice", "warn", "error", "critical", "alert", "emergency")
#: "No site" and "no resource" in telemetry.
NIL = "00000000-0000-0000-0000-000000000000"
TOKEN = r"[\p{L}\p{N}]+"


def severity_ord(c: Column) -> Column:
    """1 to 9, null for anything else."""
    return F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), c), F.lit(0)).cast("int")


def at_least(floor: str) -> list[str]:
    """The severities from ``floor`` up."""
    return list(SEVERITIES[SEVERITIES.index(floor) :])


def attr(m: Column, key: str) -> Column:
    """A key of a map; a missing key, like a missing map, reads as the empty string."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(""))


def bucket(at: Column, seconds: int) -> Column:
    """The start of the bucket of a timestamp, in steps from the epoch."""
    return F.timestamp_seconds(F.floor(F.unix_micros(at) / F.lit(seconds * 1_000_000)) * F.lit(seconds))


def tokens(text: Column) -> Column:
    """Runs of letters and digits; other characters separate."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def any_token(text: Column, terms: list[str]) -> Column:
    """Whether a term is a token. A text without it as a substring is not split into tokens."""
    there = reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])
    return there & F.arrays_overlap(tokens(text), F.array(*map(F.lit, terms)))


def all_tokens(text: Column, terms: list[str]) -> Column:
    """Whether all terms are tokens. A text without one as a substring is not split into tokens."""
    there = reduce(lambda a, b: a & b, [F.contains(text, F.lit(t)) for t in terms])
    return there & (F.size(F.array_except(F.array(*map(F.lit, terms)), tokens(text))) == 0)


def contains_any_case(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(needle)))


def label_key(labels: Column) -> Column:
    """A map as something that can be grouped and partitioned by: its entries in order."""
    return F.array_sort(F.map_entries(labels))


def ordered_map(m: Column) -> Column:
    """A map with its keys in order, so that equal maps have equal bytes."""
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def millis(at: Column) -> Column:
    """A timestamp cut to milliseconds."""
    return F.timestamp_millis(F.unix_millis(at))


def parse_instant(text: Column) -> Column:
    """A stored or RFC 3339 timestamp; null if it is neither."""
    return millis(F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS")), F.try_to_timestamp(text)))


def instant_text(at: Column) -> Column:
    """A timestamp as it is stored."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS")


def ingest_lag(ingested: Column, observed: Column) -> Column:
    """Milliseconds from observation to arrival; negative where the device's clock is ahead."""
    return F.unix_millis(ingested) - F.unix_millis(observed)
