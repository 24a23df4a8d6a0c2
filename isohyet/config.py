"""Configuration files (YAML) and what they are wired to."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession

from isohyet.operators.aoi import AOI
from isohyet.operators.grid import BaseGrid
from isohyet.operators.model import LeaveOneOut, VerticalModel, fill_gaps
from isohyet.operators.resample import Resampler
from isohyet.operators.sensors import normalize_codes
from isohyet.sinks.registry import Writer, create_writer
from isohyet.sinks.scores import ScoreStore
from isohyet.sources.registry import Source, create_source


def read_config(path: str) -> dict[str, Any]:
    import yaml

    if not os.path.isfile(path):
        raise ValueError(f"there is no configuration file {path}")
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def localize_time(value: Any, zone: str) -> datetime:
    """A time of a configuration, day first where it is text; naive ones are of the zone. Of a time that the clock shows twice the
    second is meant; one that it skips becomes the first after the gap."""
    if isinstance(value, datetime):
        at = value
    elif hasattr(value, "year"):
        at = datetime(value.year, value.month, value.day)
    else:
        at = _parse(str(value).strip())
    tz = ZoneInfo(zone)
    if at.tzinfo is not None:
        return at.astimezone(tz)
    at = at.replace(tzinfo=tz, fold=1)
    back = at.astimezone(ZoneInfo("UTC")).astimezone(tz)
    if back.replace(tzinfo=None) != at.replace(tzinfo=None):  # skipped
        later = max(back, at.replace(fold=0).astimezone(ZoneInfo("UTC")).astimezone(tz))
        return later.replace(minute=0, second=0, microsecond=0)
    return at


def _parse(text: str) -> datetime:
    """Day first, as in 01/02/2026 and 01.02.2026; ISO dates too are read with the day second where that is a date."""
    import warnings

    import pandas as pd

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # pandas warns where an ISO date is read day first
        return pd.to_datetime(text, dayfirst=True).to_pydatetime()


def _required(section: dict, name: str, *keys: str) -> None:
    if lacking := [k for k in keys if section.get(k) is None]:
        raise ValueError(f"{name} lacks {lacking}")


@dataclass
class Runtime:
    """Everything that a run needs, made from a configuration."""

    spark: SparkSession
    config: dict[str, Any]
    start: datetime
    end: datetime
    timezone: str
    aoi: AOI
    grid: BaseGrid
    source: Source
    resampler: Resampler
    model: VerticalModel
    stations: list[str] | None = None
    parameters: list[str] = field(default_factory=lambda: ["tair_2m"])
    require_stations_in_aoi: bool = True
    cross_validator: LeaveOneOut | None = None
    gap_filler: Any = None
    writer: Writer | None = None
    score_store: ScoreStore | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def from_config_file(cls, spark: SparkSession, path: str) -> Runtime:
        return cls.from_config(spark, read_config(path))

    @classmethod
    def from_config(cls, spark: SparkSession, config: dict[str, Any]) -> Runtime:
        general = config.get("general") or {}
        _required(general, "general", "timezone", "start", "end")
        _required(config.get("aoi") or {}, "aoi", "minx", "miny", "maxx", "maxy")
        _required(config.get("base_grid") or {}, "base_grid", "path")
        _required(config.get("meteo_input") or {}, "meteo_input", "handler")
        zone, aoi = general["timezone"], AOI(**config["aoi"])
        stations = general.get("stations")
        meteo = dict(config["meteo_input"])
        resampling, output = config.get("resampling") or {}, config.get("output")
        if output is not None:
            _required(output, "output", "format")
        gaps, database = config.get("gapfilling"), config.get("database")
        if database is not None:
            _required(database, "database", "path")
        return cls(
            spark, config, localize_time(general["start"], zone), localize_time(general["end"], zone), zone, aoi,
            BaseGrid(spark, aoi=aoi, **config["base_grid"]),
            create_source(meteo.pop("handler"), **{"target_zone": zone} | meteo),
            Resampler(resampling.get("resample_colmap"), resampling.get("default_aggfunc", "mean")),
            VerticalModel(**(config.get("vertical_model") or {})),
            None if stations is None else normalize_codes([str(x) for x in stations] if isinstance(stations, list) else str(stations)),
            [own] if isinstance(own := general.get("parameters") or ["tair_2m"], str) else list(own), general.get("require_stations_in_aoi", True),
            LeaveOneOut() if config.get("cross_validation") is not None else None,
            (lambda frame, column: fill_gaps(frame, column, **gaps)) if gaps is not None else None,
            create_writer(output["format"], **(output.get("options") or {})) if output is not None else None,
            ScoreStore(database["path"]) if database is not None else None,
        )

    def update(self, path: str) -> Runtime:
        """A new runtime of another file; nothing of this one is kept."""
        return type(self).from_config_file(self.spark, path)
