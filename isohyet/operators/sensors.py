"""Vocabulary of sensors: provider codes and common names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Provider code -> common name.
PROVINCE_SENSORS = {
    "LT": "tair_2m",
    "LF": "relative_humidity",
    "N": "precipitation",
    "WG": "wind_speed",
    "WR": "wind_direction",
    "WG.BOE": "wind_gust",
    "LD.RED": "air_pressure",
    "SD": "sun_duration",
    "GS": "solar_radiation",
    "HS": "snow_height",
    "W": "water_level",
    "Q": "discharge",
}
#: Other columns of the provider.
PROVINCE_COLUMNS = {"DATE": "datetime"}


class Vocabulary:
    def __init__(self, sensors: Mapping[str, str], columns: Mapping[str, str] | None = None):
        if twice := sorted({n for n in sensors.values() if list(sensors.values()).count(n) > 1}):
            raise ValueError(f"common names given to more than one code: {twice}")
        self.sensors, self.columns = dict(sensors), dict(columns or {})
        self.codes = {name: code for code, name in self.sensors.items()}

    @property
    def names(self) -> list[str]:
        return sorted(set(self.sensors.values()))

    def rename(self, frame: DataFrame) -> DataFrame:
        """Common names for the columns that have one; others stay."""
        return frame.withColumnsRenamed({k: v for k, v in (self.sensors | self.columns).items() if k in frame.columns})

    def resolve(self, sensors: str | Iterable[str]) -> list[str]:
        """Provider codes of codes or common names, which must be all of one kind."""
        own = normalize_codes(sensors)
        if all(x in self.codes for x in own):
            return [self.codes[x] for x in own]
        if all(x in self.sensors for x in own):
            return own
        raise KeyError(f"unknown or mixed sensors: {[x for x in own if x not in self.codes and x not in self.sensors] or own}")

    def name_column(self, code: str = "sensor"):
        """Common name of a column's codes; NULL for an unknown one."""
        pairs = [F.lit(x) for pair in self.sensors.items() for x in pair]
        return F.element_at(F.create_map(*pairs), F.col(code))


def normalize_codes(codes: str | Iterable[str]) -> list[str]:
    """Stripped codes in order, without blanks and repeats."""
    own = [codes] if isinstance(codes, str) else list(codes)
    if bad := [x for x in own if not isinstance(x, str)]:
        raise ValueError(f"sensor codes must be text: {bad}")
    return list(dict.fromkeys(x.strip() for x in own if x.strip()))


def split_available(requested: DataFrame, available: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requested rows that are available, and those that are missing."""
    return requested.join(available, on, "left_semi"), requested.join(available, on, "left_anti")


PROVINCE = Vocabulary(PROVINCE_SENSORS, PROVINCE_COLUMNS)
