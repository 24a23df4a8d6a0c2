"""A collection of stations: one dimension table and one fact table, joined by station_id."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.functions.frequency import Frequency, bin_start
from isohyet.operators.resample import Resampler
from isohyet.operators.validate import require_valid_stations


def union_all(frames: Sequence[DataFrame | None]) -> DataFrame:
    """UNION ALL by name; a column that a part lacks is NULL there, parts that are None are skipped."""
    own = [f for f in frames if f is not None]
    if not own:
        raise ValueError("nothing to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)


@dataclass(frozen=True)
class MeteoData:
    """stations: id, x, y, elevation, crs. observations: station_id, datetime, one column per parameter."""

    stations: DataFrame
    observations: DataFrame
    crs: int = 4326

    @classmethod
    def build(cls, parts: Sequence[tuple[DataFrame, DataFrame] | None]) -> MeteoData:
        """One collection of several; ids become text, all must share one CRS."""
        own = [x for x in parts if x is not None]
        stations = union_all([s.withColumn("id", F.col("id").cast("string")) for s, _ in own])
        observations = union_all([o.withColumn("station_id", F.col("station_id").cast("string")) for _, o in own])
        systems = [r.crs for r in stations.select("crs").distinct().limit(2).collect()]
        if len(systems) > 1:
            raise ValueError("stations of more than one CRS")
        return cls(stations, observations, systems[0] if systems else 4326)

    def validated(self) -> MeteoData:
        require_valid_stations(self.stations)
        return self

    def flat(self, coordinates: bool = False) -> DataFrame:
        """Observations with their station's elevation (and coordinates)."""
        names = ["elevation", *(["x", "y"] if coordinates else [])]
        return self.observations.join(self.stations.select(F.col("id").alias("station_id"), *names), "station_id")

    def station(self, id_: str) -> DataFrame:
        return self.observations.filter(F.col("station_id") == id_)

    def points(self) -> DataFrame:
        return self.stations.select("id", "x", "y")

    def resampled(self, freq: str, min_sample_size: int = 1, resampler: Resampler | None = None) -> MeteoData:
        own = (resampler or Resampler()).apply(self.observations, freq, "datetime", ["station_id"], min_sample_size, origin_cols=["station_id"], sort=False)
        return replace(self, observations=own)

    def samples(self, parameters: Sequence[str], start, end, freq: str = "D") -> DataFrame:
        """(param, interp_date, station_id, elevation, y) for each date from start to before end, without missing values.
        A parameter that no station has is skipped."""
        return samples(self.flat(), [p for p in parameters if p in self.observations.columns], start, end, freq)


def date_spine(frame: DataFrame, start, end, freq: str, kind: str = "timestamp_ntz") -> DataFrame:
    """Column interp_date: bin labels from start to before end. A start inside a bin counts as the bin's start."""
    step = Frequency.parse(freq)
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    one = frame.sparkSession.range(1).select(bin_start(first, replace_n(step), kind).alias("a"), last.cast(kind).alias("b"))
    return one.select(F.explode(F.sequence("a", "b", step.interval())).alias("interp_date"), "b").filter("interp_date < b").select("interp_date")


def replace_n(step: Frequency) -> Frequency:
    return Frequency(1, step.unit) if step.needs_origin else step


def samples(flat: DataFrame, parameters: Sequence[str], start, end, freq: str = "D") -> DataFrame:
    if not parameters:
        raise ValueError("none of the parameters is there")
    kind = flat.schema["datetime"].dataType.simpleString()
    long = flat.unpivot(["station_id", "datetime", "elevation"], list(parameters), "param", "y").filter(F.col("y").isNotNull())
    spine = date_spine(flat, start, end, freq, kind)
    return long.join(spine, long["datetime"] == spine["interp_date"]).select("param", "interp_date", "station_id", "elevation", "y")
