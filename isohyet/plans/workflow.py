"""The whole run as one lazy plan: fetch, tidy, resample, fit, evaluate; then write."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.config import Runtime
from isohyet.operators.model import interpolate_all
from isohyet.operators.stations import MeteoData
from isohyet.operators.validate import require_enough
from isohyet.sinks import files

#: Values a day needs to count, of 144 ten-minute steps.
MIN_SAMPLES = 60
FREQ = "D"


@dataclass(frozen=True)
class Result:
    fits: DataFrame
    field: DataFrame
    scores: DataFrame | None
    written: object = None
    errors: DataFrame | None = None


def run_workflow(runtime: Runtime, min_samples: int = MIN_SAMPLES, freq: str = FREQ, overwrite: bool = False) -> Result:
    spark = runtime.spark
    observations = runtime.source.observations(spark, runtime.stations, runtime.start, runtime.end)
    if observations is None:
        raise ValueError("no station has data")
    errors = runtime.source.errors(runtime.source.landed)
    if errors is not None and (n := errors.count()):
        warnings.warn(f"{n} requests failed; the result's errors name them", stacklevel=2)
    observations = files.land(observations)
    stations = runtime.source.stations(spark).join(observations.select(F.col("station_id").alias("id")).distinct(), "id", "left_semi")
    inside = runtime.aoi.filter_points(stations, 4326).withColumn("_in", F.lit(1)).select("id", "_in")
    counts = stations.join(inside, "id", "left").agg(F.count("*").alias("n"), F.count("_in").alias("inside")).first()
    require_enough(counts["n"], counts["inside"], runtime.require_stations_in_aoi)
    data = MeteoData(stations, observations).validated()
    if runtime.gap_filler is not None:
        for p in runtime.parameters:
            if p in observations.columns:
                data = MeteoData(stations, runtime.gap_filler(data.observations, p))
    daily = data.resampled(freq, min_samples, runtime.resampler)
    start, end = (x.replace(tzinfo=None) for x in (runtime.start, runtime.end))
    samples = daily.samples(runtime.parameters, start, end, freq)
    fits, field, scores = interpolate_all(samples, runtime.grid.cells, runtime.model, cross_validator=runtime.cross_validator)
    written = None
    if runtime.writer is not None:
        written = runtime.writer.write(field.select(F.col("param").alias("var"), F.col("interp_date").alias("time"), "y_idx", "x_idx", "value"), runtime.grid.meta, overwrite=overwrite)
    if runtime.score_store is not None and scores is not None:
        runtime.score_store.append(scores, runtime.run_id)
    return Result(fits, field, scores, written, errors)
