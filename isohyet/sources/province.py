"""The province's weather service: station list, sensor catalogue and time series, over HTTP or from saved answers.

Time series are a Spark data source: one input partition per station, sensor and date chunk, so that fetching is the executors' work
and the number of requests at a time is the number of running tasks (`max_concurrent_requests` limits the partitions' groups). A request that
fails becomes a row of `_error`, not silence.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
import warnings
from collections.abc import Sequence
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from isohyet.functions.frequency import Frequency
from isohyet.operators.sensors import PROVINCE, normalize_codes
from isohyet.operators.tidy import tidy_province
from isohyet.sources.chunks import date_chunks
from isohyet.sources.registry import Source

#: The service's address, and that of an elevation service for stations that lack theirs.
BASE_URL = "http://daten.buergernetz.bz.it/services/meteo/v1"
ELEVATION_URL = "https://api.opentopodata.org/v1/eudem25m?locations={lat},{lon}"

STATION_SCHEMA = "features array<struct<properties struct<SCODE string, LAT double, LONG double, ALT double, NAME_D string>>>"
SERIES_SCHEMA = "DATE string, VALUE double, sensor string, station_id string, _seq long, _error string"


def read_stations(frame: DataFrame) -> DataFrame:
    """Stations of GeoJSON answers (column features): id, x, y, elevation, name, crs."""
    p = F.col("f.properties")
    return frame.select(F.explode("features").alias("f")).select(
        p["SCODE"].alias("id"), p["LONG"].alias("x"), p["LAT"].alias("y"), p["ALT"].alias("elevation"), p["NAME_D"].alias("name"), F.lit(4326).alias("crs")
    )


def fill_elevation(stations: DataFrame, lookup: DataFrame) -> DataFrame:
    """Elevation from a table (id, elevation) where a station lacks it; it stays missing if the table lacks it too."""
    found = lookup.select("id", F.col("elevation").alias("_found"))
    return stations.join(found, "id", "left").withColumn("elevation", F.coalesce("elevation", "_found")).drop("_found")


def fetch(url: str, timeout: float) -> object:
    """The answer of an address, decoded. Files (file://) serve saved answers."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
        return json.load(answer)


def look_up_elevation(x: float, y: float, url: str, timeout: float) -> float | None:
    """Elevation of a place from a service; None, with a warning, if it doesn't say."""
    try:
        return float(fetch(url.format(lat=y, lon=x), timeout)["results"][0]["elevation"])
    except Exception as e:  # noqa: BLE001
        warnings.warn(f"no elevation for {x}, {y}: {type(e).__name__}: {e}", stacklevel=2)
        return None


class _Request(InputPartition):
    def __init__(self, queries: list[dict]):
        super().__init__(0)
        self.queries = queries


class _SeriesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        queries = json.loads(self.options["queries"])
        n = max(1, int(self.options.get("partitions", len(queries) or 1)))
        return [_Request(queries[i::n]) for i in range(min(n, len(queries)))] or [_Request([])]

    def read(self, partition: _Request):
        for q in partition.queries:
            try:
                rows = fetch(q["url"], float(self.options.get("timeout", 20))) or []
            except Exception as e:  # noqa: BLE001  (the row says what went wrong)
                yield (None, None, q["sensor"], q["station"], None, f"{type(e).__name__}: {e}")
            else:
                for i, r in enumerate(rows):
                    value = r.get("VALUE")
                    yield (r.get("DATE"), None if value is None else float(value), q["sensor"], q["station"], q["first"] + i, None)
            time.sleep(float(self.options.get("sleep_time", 0)))


class ProvinceSeries(DataSource):
    """spark.read.format("province_series"); options: queries (JSON), timeout, sleep_time, partitions."""

    @classmethod
    def name(cls) -> str:
        return "province_series"

    def schema(self) -> str:
        return SERIES_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _SeriesReader(dict(self.options))


class ProvinceSource(Source):
    name = "province_api"
    #: Fixed value: the zone in which the service's requests and answers name times.
    zone = "Europe/Rome"
    freq = "10min"
    inclusive = "both"

    def __init__(self, base_url: str = BASE_URL, chunk_size_days: int = 365, timeout: float = 20, max_concurrent_requests: int = 5, sleep_time: float = 1, target_zone: str = "UTC", elevation_table: DataFrame | None = None, elevation_url: str | None = ELEVATION_URL, address=None):
        if max_concurrent_requests < 1:
            raise ValueError("max_concurrent_requests must be at least 1")
        self.base_url, self.chunk_size_days, self.timeout = base_url.rstrip("/"), chunk_size_days, timeout
        self.max_concurrent_requests, self.sleep_time, self.target_zone = max_concurrent_requests, sleep_time, target_zone
        self.elevation_table, self.elevation_url, self.address = elevation_table, elevation_url, address or self._address
        self._stations: DataFrame | None = None
        self._sensors: dict[str, list[str]] = {}

    def _address(self, what: str, **query) -> str:
        return f"{self.base_url}/{what}" + (f"?{urllib.parse.urlencode(query)}" if query else "")

    def stations(self, spark: SparkSession) -> DataFrame:
        if self._stations is None:
            answer = fetch(self.address("stations"), self.timeout)
            if not (answer or {}).get("features"):
                raise ValueError("the station list is empty")
            found = read_stations(spark.createDataFrame([(json.dumps(answer),)], "a string").select(F.from_json("a", STATION_SCHEMA).alias("j")).select("j.*"))
            found = fill_elevation(found, self.elevation_table) if self.elevation_table is not None else found
            if self.elevation_url:
                asked = [(r.id, look_up_elevation(r.x, r.y, self.elevation_url, self.timeout)) for r in found.filter("elevation IS NULL").collect()]
                found = fill_elevation(found, spark.createDataFrame(asked, "id string, elevation double")) if asked else found
            self._stations = found.cache()
        return self._stations

    def station_codes(self, spark: SparkSession) -> list[str]:
        return [r.id for r in self.stations(spark).select("id").orderBy("id").toLocalIterator()]

    def sensor_codes(self, station_id: str) -> list[str]:
        """Sensors of a station, sorted; asked for once."""
        if station_id not in self._sensors:
            self._sensors[station_id] = sorted({x["TYPE"] for x in fetch(self.address("sensors", station_code=station_id), self.timeout) or []})
        return self._sensors[station_id]

    def requests(self, spark: SparkSession, station_ids: Sequence[str] | None, start: datetime, end: datetime, sensors=None, split_years: bool = True) -> tuple[list[dict], list[tuple[str, str]]]:
        """All requests, and (station, sensor) pairs that were asked for and aren't there. Times are turned into the service's zone (naive ones are of
        it); no request crosses a year's end there unless split_years is false."""
        start, end = (x if x.tzinfo is None else x.astimezone(ZoneInfo(self.zone)) for x in (start, end))
        known = self.station_codes(spark)
        ids = known if station_ids is None else normalize_codes(station_ids)
        if unknown := [x for x in ids if x not in known]:
            raise ValueError(f"unknown stations: {unknown}")
        wanted = PROVINCE.resolve(sensors) if sensors is not None else None
        last = end - timedelta(seconds=Frequency.parse(self.freq).seconds) if self.inclusive in ("right", "both") else end
        chunks, out, missing = date_chunks(start, last, self.freq, self.chunk_size_days, split_years), [], []
        for station in ids:
            there = self.sensor_codes(station)
            own = there if wanted is None else [x for x in wanted if x in there]
            missing += [] if wanted is None else [(station, x) for x in wanted if x not in there]
            for sensor in own:
                for a, b in chunks:
                    url = self.address("timeseries", station_code=station, sensor_code=sensor, date_from=f"{a:%Y%m%d%H%M}", date_to=f"{b:%Y%m%d%H%M}")
                    out.append({"url": url, "station": station, "sensor": sensor, "first": len(out) << 32})
        return out, missing

    def raw(self, spark: SparkSession, station_ids: Sequence[str] | None, start: datetime, end: datetime, sensors=None) -> DataFrame | None:
        """All answers, with `_error` rows for requests that failed; see errors()."""
        own, missing = self.requests(spark, station_ids, start, end, sensors)
        if missing:
            warnings.warn(f"sensors that stations don't have: {missing}", stacklevel=2)
        if not own:
            return None
        spark.dataSource.register(ProvinceSeries)
        return spark.read.format("province_series").option("queries", json.dumps(own)).option("timeout", self.timeout).option("sleep_time", self.sleep_time).option("partitions", min(len(own), self.max_concurrent_requests)).load()

    @staticmethod
    def errors(raw: DataFrame) -> DataFrame:
        return raw.filter("_error is not null").select("station_id", "sensor", "_error")

    def transform(self, raw: DataFrame) -> DataFrame:
        return tidy_province(raw.filter("_error is null"), self.target_zone, self.zone, step=self.freq)
