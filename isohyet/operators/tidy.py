"""From raw responses to the tidy wide table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from isohyet.functions import zones
from isohyet.functions.frequency import Frequency
from isohyet.operators.sensors import PROVINCE, Vocabulary


def dedupe_first(frame: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key by an explicit order: arrival order isn't reproducible."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("_n", first).filter("_n = 1").drop("_n")


def pivot_sensors(long: DataFrame, index: Sequence[str], sensor: str, value: str, codes: Sequence[str]) -> DataFrame:
    """One column per sensor code; the list is explicit, so no job is needed to find it."""
    return long.groupBy(*index).pivot(sensor, list(codes)).agg(F.first(value, ignorenulls=True))


def parse_local(text: Column, zone: str) -> Column:
    """UTC wall time of `yyyy-MM-ddTHH:mm:ss` followed by CET or CEST; NULL if it can't be read. The label only tells
    the two passes of the autumn hour apart, as parsers map both to one instant."""
    wall = F.try_to_timestamp(F.regexp_replace(text, "(CEST|CET)$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")
    return zones.localize(wall, zone, F.contains(text, F.lit("CEST")))


def drop_rows_without(frame: DataFrame, besides: Sequence[str], strict_compat: bool = False) -> DataFrame:
    """Drops rows where every column but these is missing. If there is no other column nothing is dropped; with
    strict_compat everything is."""
    subset = [c for c in frame.columns if c not in besides]
    if not subset:
        return frame.limit(0) if strict_compat else frame
    return frame.na.drop("all", subset=subset)


def range_filter(frame: DataFrame, column: str, start, end) -> DataFrame:
    """Rows in the closed range; a range predicate that is pushed to the scan."""
    kind = frame.schema[column].dataType.simpleString()
    return frame.filter(F.col(column).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def tidy_province(raw: DataFrame, target_zone: str = "UTC", source_zone: str = "Europe/Rome", step: str = "10min", vocabulary: Vocabulary = PROVINCE, codes: Sequence[str] | None = None, strict_compat: bool = False) -> DataFrame:
    """raw: DATE, VALUE, sensor, station_id, _seq (order of arrival). Wide rows by time and station, in the target zone's
    wall clock, rounded down to the provider's step; one shuffle for the first of each reading, one for the pivot."""
    own = list(codes) if codes is not None else list(vocabulary.sensors)
    first = raw.filter(F.col("sensor").isin(own)).groupBy("DATE", "station_id", "sensor").agg(F.min_by("VALUE", "_seq").alias("VALUE"))
    wide = vocabulary.rename(pivot_sensors(first, ["DATE", "station_id"], "sensor", "VALUE", own))
    utc = parse_local(F.col("datetime"), source_zone)
    timed = wide.withColumn("datetime", zones.at_zone(zones.floor_seconds(utc, Frequency.parse(step).seconds, "timestamp_ntz"), target_zone)).filter("datetime is not null")
    return drop_rows_without(timed, ("datetime", "station_id", "precipitation"), strict_compat)
