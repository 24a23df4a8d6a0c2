"""Checks that raise: of the observation table, of stations, of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of observations that are floating point if they are there.
OPTIONAL = ("tair_2m", "precipitation", "solar_radiation")


def validate_observations(frame: DataFrame, allow_additional_columns: bool = True) -> DataFrame:
    """The table with datetime as a timestamp, if it has the declared columns and no null key; one pass over the data."""
    if lacking := [c for c in ("datetime", "station_id") if c not in frame.columns]:
        raise ValueError(f"required columns not found: {lacking}")
    if bad := [c for c in OPTIONAL if c in frame.columns and not isinstance(frame.schema[c].dataType, (T.DoubleType, T.FloatType))]:
        raise ValueError(f"columns must be floating point: {bad}")
    if not isinstance(frame.schema["station_id"].dataType, T.StringType):
        raise ValueError("station_id must be text")
    extra = [c for c in frame.columns if c not in ("datetime", "station_id", *OPTIONAL)]
    if extra and not allow_additional_columns:
        raise ValueError(f"additional columns: {extra}")
    if not isinstance(frame.schema["datetime"].dataType, (T.TimestampType, T.TimestampNTZType)):
        frame = frame.withColumn("datetime", F.expr("try_cast(datetime AS timestamp)"))
    nulls = frame.agg(F.count_if(F.col("datetime").isNull()).alias("datetime"), F.count_if(F.col("station_id").isNull()).alias("station_id")).first().asDict()
    if any(nulls.values()):
        raise ValueError(f"missing values: {nulls}")
    return frame


def station_violations(stations: DataFrame) -> DataFrame:
    """Stations that break a rule, with the first rule broken: id, x, y, crs given; crs 4326; latitude and longitude in range; id and coordinates unique."""
    by_id = stations.groupBy("id").agg(F.count("*").alias("_ids"))
    by_place = stations.groupBy("x", "y").agg(F.count("*").alias("_places"))
    reason = (
        F.when(F.col("id").isNull() | F.col("x").isNull() | F.col("y").isNull() | F.col("crs").isNull(), "missing")
        .when(F.col("crs") != 4326, "crs").when(~F.col("y").between(-90, 90), "latitude").when(~F.col("x").between(-180, 180), "longitude")
        .when(F.col("_ids") > 1, "id twice").when(F.col("_places") > 1, "coordinates twice")
    )
    return stations.join(by_id, "id", "left").join(by_place, ["x", "y"], "left").withColumn("reason", reason).filter("reason is not null").select("id", "x", "y", "reason")


def require_valid_stations(stations: DataFrame) -> DataFrame:
    if bad := station_violations(stations).orderBy("id").limit(5).collect():
        raise ValueError("stations that are not valid: " + ", ".join(f"{r.id} ({r.reason})" for r in bad))
    return stations


def require_enough(n_stations: int, n_inside: int, require_in_aoi: bool = True, least: int = 3) -> None:
    """Guards of a run."""
    if n_stations == 0:
        raise ValueError("no station has data")
    if n_stations < least:
        raise ValueError(f"{n_stations} stations have data; at least {least} are needed")
    if require_in_aoi and n_inside == 0:
        raise ValueError("no station is in the area of interest")
