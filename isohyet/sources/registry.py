"""Sources by name: stations and observations as DataFrames."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from isohyet.operators.validate import validate_observations
from isohyet.sinks import files


class Source(ABC):
    """freq is the step of the source's data, inclusive which ends of a request its answers contain."""

    registry: dict[str, type[Source]] = {}
    name: str | None = None
    freq = "10min"
    inclusive = "both"
    landed: DataFrame | None = None

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        if cls.name is not None:
            Source.registry[cls.name] = cls

    @abstractmethod
    def stations(self, spark: SparkSession) -> DataFrame:
        """id, x, y, elevation, name, crs."""

    @abstractmethod
    def raw(self, spark: SparkSession, station_ids: Sequence[str] | None, start, end, sensors: Sequence[str] | None = None) -> DataFrame | None: ...

    def transform(self, raw: DataFrame) -> DataFrame | None:
        return raw

    def errors(self, raw: DataFrame) -> DataFrame | None:
        """Requests that failed, if the source reports them."""
        return None

    def observations(self, spark: SparkSession, station_ids: Sequence[str] | None, start, end, sensors: Sequence[str] | None = None) -> DataFrame | None:
        """raw, then transform, then validate; None if there is nothing. Answers are fetched once and kept as `landed`."""
        raw = self.raw(spark, station_ids, start, end, sensors)
        self.landed = raw = files.land(raw) if raw is not None else None
        tidy = self.transform(raw) if raw is not None else None
        return validate_observations(tidy) if tidy is not None else None


def create_source(name: str, **options) -> Source:
    from isohyet.sources import province  # noqa: F401  (it registers itself)

    if name not in Source.registry:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(sorted(Source.registry))}")
    return Source.registry[name](**options)
