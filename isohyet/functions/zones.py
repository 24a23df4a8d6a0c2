"""Wall-clock times of a zone to instants, with explicit rules for the two hours of the year where that isn't one to one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def localize(wall: Column, zone: str, is_summer: Column) -> Column:
    """UTC wall time (timestamp_ntz) of a wall time (timestamp_ntz) in a zone with whole-hour offsets.

    A time that the clock skips becomes the first one after the gap. One that it shows twice is the first (summer time) if is_summer
    holds, else the second. Conversion gives the earlier of two, and moves a skipped time on by the gap; converting
    back shows which case it is. The session's own zone has no part in it.
    """
    at = F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)
    later = at + F.expr("INTERVAL 1 HOUR")
    skipped = at_zone(at, zone) != wall
    twice = at_zone(later, zone) == wall
    whole_hour = F.make_timestamp_ntz(F.year(at), F.month(at), F.dayofmonth(at), F.hour(at), F.lit(0), F.lit(0))
    return F.when(skipped, whole_hour).when(twice & ~is_summer, later).otherwise(at)


def at_zone(utc: Column, zone: str) -> Column:
    """Wall time (timestamp_ntz) in a zone of a UTC wall time (timestamp_ntz)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def floor_seconds(column: Column, step: int, kind: str) -> Column:
    """A time rounded down to a multiple of step seconds since 1970 (on the instant, so that no hour is ambiguous)."""
    return F.timestamp_seconds(F.floor(F.unix_micros(column.cast("timestamp")) / (step * 1_000_000)) * step).cast(kind)
