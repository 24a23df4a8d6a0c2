import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.config import Runtime, localize_time, read_config
from isohyet.operators.grid_meta import GridMeta
from isohyet.plans.workflow import run_workflow
from isohyet.sinks.cube import CubeWriter
from isohyet.sources.chunks import date_chunks
from isohyet.sources.province import ProvinceSource
from isohyet.sources.registry import create_source
from isohyet.streaming.cube_stream import append_to_cube, stream_resample


@pytest.fixture(scope="module")
def service(tmp_path_factory):
    """Saved answers of a service with five stations: temperature falls by 0.006 degrees a metre, day 1 is warmer."""
    folder = tmp_path_factory.mktemp("service")
    features = [{"properties": {"SCODE": f"S{i}", "LAT": 46.2 + 0.1 * i, "LONG": 10.4 + 0.2 * i, "ALT": 200.0 + 300 * i, "NAME_D": f"Station {i}"}} for i in range(5)]
    (folder / "stations.json").write_text(json.dumps({"features": features}))

    def address(what, **q):
        return f"file://{folder}/" + "_".join([what, *(str(v) for v in q.values())]) + ".json"

    for i in range(5):
        (folder / f"sensors_S{i}.json").write_text(json.dumps([{"TYPE": "LT"}, {"TYPE": "N"}, {"TYPE": "LT"}]))
        start = datetime(2025, 1, 1)
        for day in range(2):
            a, b = start + timedelta(days=day), start + timedelta(days=day + 1) - timedelta(minutes=10)
            for code in ("LT", "N"):
                rows = [{"DATE": f"{a + timedelta(minutes=10 * k):%Y-%m-%dT%H:%M:%S}CET", "VALUE": 20 - 5 * day - 0.006 * (200 + 300 * i) if code == "LT" else 0.1} for k in range(144)]
                if not (i == 4 and day == 1 and code == "N"):  # this one's answer is missing
                    (folder / f"timeseries_S{i}_{code}_{a:%Y%m%d%H%M}_{b:%Y%m%d%H%M}.json").write_text(json.dumps(rows))
    return address


def test_source(spark, service):
    own = create_source("province_api", address=service, sleep_time=0, chunk_size_days=1, target_zone="Europe/Rome")
    assert own.station_codes(spark) == [f"S{i}" for i in range(5)] and own.sensor_codes("S1") == ["LT", "N"]
    raw = own.raw(spark, None, datetime(2025, 1, 1), datetime(2025, 1, 3), ["tair_2m", "precipitation"])
    assert [(r.station_id, r.sensor) for r in ProvinceSource.errors(raw).collect()] == [("S4", "N")]
    assert raw.filter("_error is null").count() == (20 - 1) * 144
    _, missing = own.requests(spark, ["S1"], datetime(2025, 1, 1), datetime(2025, 1, 2), ["tair_2m", "snow_height"])
    assert missing == [("S1", "HS")]
    with pytest.raises(ValueError, match="unknown stations"):
        own.requests(spark, ["nowhere"], datetime(2025, 1, 1), datetime(2025, 1, 2))
    with pytest.raises(ValueError, match="at least 1"):
        ProvinceSource(max_concurrent_requests=0)
    with pytest.raises(ValueError, match="unknown source"):
        create_source("elsewhere")
    with pytest.warns(UserWarning, match="HS"):
        assert own.raw(spark, ["S1"], datetime(2025, 1, 1), datetime(2025, 1, 2), ["snow_height"]) is None


def test_elevation_of_stations_that_lack_it(spark, tmp_path):
    stations = [{"properties": {"SCODE": c, "LAT": 46.5, "LONG": x, "ALT": None, "NAME_D": c}} for c, x in (("A", 11.0), ("B", 12.0), ("C", 13.0))]
    (tmp_path / "stations.json").write_text(json.dumps({"features": stations}))
    (tmp_path / "46.5,12.0").write_text(json.dumps({"results": [{"elevation": 700}]}))
    table = spark.createDataFrame([("A", 300.0)], "id string, elevation double")
    own = ProvinceSource(elevation_table=table, elevation_url=f"file://{tmp_path}/{{lat}},{{lon}}", address=lambda what, **q: f"file://{tmp_path}/{what}.json")
    with pytest.warns(UserWarning, match="no elevation"):
        assert {r.id: r.elevation for r in own.stations(spark).collect()} == {"A": 300.0, "B": 700.0, "C": None}
    (tmp_path / "stations.json").write_text('{"features": []}')
    with pytest.raises(ValueError, match="empty"):
        ProvinceSource(address=lambda what, **q: f"file://{tmp_path}/{what}.json").stations(spark)


def test_workflow(spark, service, tmp_path):
    import yaml

    rng = np.random.default_rng(0)
    rows = [(10.0 + 0.1 * x, 47.0 - 0.1 * y, float(rng.uniform(0, 2000))) for y in range(11) for x in range(21)]
    spark.createDataFrame(rows, "lon double, lat double, orog double").write.parquet(str(tmp_path / "dem"))
    config = {
        "general": {"timezone": "Europe/Rome", "start": "01.01.2025", "end": "03.01.2025", "parameters": ["tair_2m"]},
        "aoi": {"minx": 10.2, "miny": 46.2, "maxx": 11.6, "maxy": 46.9},
        "base_grid": {"path": str(tmp_path / "dem"), "crs": 4326, "cache_folder": str(tmp_path / "cache")},
        "meteo_input": {"handler": "province_api", "sleep_time": 0, "chunk_size_days": 1, "address": None},
        "resampling": {"default_aggfunc": None}, "cross_validation": {}, "database": {"path": str(tmp_path / "scores")}, "gapfilling": {"most_rows": 2},
        "output": {"format": "zarr", "options": {"path": str(tmp_path / "cube"), "start": "2025-01-01", "end": "2025-01-31", "freq": "D", "variables": ["tair_2m"]}},
    }
    path = tmp_path / "config.yaml"
    path.write_text(yaml.safe_dump(config))
    runtime = Runtime.from_config_file(spark, str(path))
    runtime.source.address = service
    result = run_workflow(runtime)
    fits = {str(r.interp_date)[:10]: r for r in result.fits.collect()}
    assert sorted(fits) == ["2025-01-01", "2025-01-02"]
    for day, top in (("2025-01-01", 20.0), ("2025-01-02", 15.0)):
        assert fits[day].slope == pytest.approx(-0.006) and fits[day].intercept == pytest.approx(top)
    assert all(r.rmse == pytest.approx(0, abs=1e-6) for r in result.scores.collect())
    assert runtime.score_store.read(spark, runtime.run_id).count() == 2
    cube = runtime.writer.read(spark)
    assert cube.count() == 2 * runtime.grid.meta.nx * runtime.grid.meta.ny
    joined = cube.join(runtime.grid.cells.select("y_idx", "x_idx", F.col("value").alias("e")), ["y_idx", "x_idx"]).filter("time = timestamp_ntz'2025-01-02'").toPandas()
    assert np.allclose(joined.value, 15 - 0.006 * joined.e)
    config["output"]["format"], config["output"]["options"] = "tiff", {"path": str(tmp_path / "tif")}
    path.write_text(yaml.safe_dump(config))
    again = runtime.update(str(path))
    again.source.address = service
    assert run_workflow(again).written == ["tair_2m_2025_01_01_000000.tif", "tair_2m_2025_01_02_000000.tif"]


def test_config(tmp_path):
    with pytest.raises(ValueError, match="no configuration"):
        read_config(str(tmp_path / "none.yaml"))
    (tmp_path / "empty.yaml").write_text("")
    assert read_config(str(tmp_path / "empty.yaml")) == {}
    with pytest.raises(ValueError, match="timezone"):
        Runtime.from_config(None, {"general": {"start": 1}})
    assert localize_time("01/02/2026", "Europe/Rome").month == 2
    assert localize_time("2025-10-26 02:30", "Europe/Rome").utcoffset() == timedelta(hours=1)
    assert localize_time("2025-03-30 02:30", "Europe/Rome").hour == 3
    assert localize_time("2025-06-15T00:00:00+00:00", "Europe/Rome").hour == 2


def test_chunks():
    a = datetime(2024, 12, 30)
    got = date_chunks(a, datetime(2025, 1, 12, 23, 50), "10min", 7)
    assert got[0] == (a, datetime(2025, 1, 5, 23, 50)) and got[-1][1] == datetime(2025, 1, 12, 23, 50)
    assert all(b[0] - x[1] == timedelta(minutes=10) for x, b in zip(got, got[1:]))
    assert date_chunks(a, datetime(2025, 1, 12), "10min", 7, split_years=True)[0][1] == datetime(2024, 12, 31, 23, 50)
    assert date_chunks(a, a, "10min", 7) == [(a, a + timedelta(minutes=10))]
    with pytest.raises(ValueError, match="before"):
        date_chunks(a, a - timedelta(days=1), "10min", 7)


def test_stream(spark, tmp_path):
    source, cube = str(tmp_path / "in"), str(tmp_path / "cube")
    spark.sql("SELECT timestamp'2025-01-01' + make_interval(0,0,0,0,0,10 * int(id)) AS datetime, 'a' AS k, double(id) AS v FROM range(300)").write.parquet(source)
    events = spark.readStream.schema("datetime timestamp, k string, v double").parquet(source)
    q = stream_resample(events, "1 day", "1 hour", "datetime", ["k"], "v").writeStream.format("memory").queryName("daily").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.n, r["mean"]) for r in spark.sql("SELECT * FROM daily ORDER BY datetime").collect()] == [(144, 71.5), (144, 215.5)]
    meta = GridMeta(0.0, 0.0, 1.0, 1.0, 2, 1, 4326)
    writer = CubeWriter(cube, "2025-01-01", "2025-01-05", "D", ["v"])
    fields = events.filter("v % 144 = 0 AND v < 289").select(F.lit("v").alias("var"), F.col("datetime").cast("timestamp_ntz").alias("time"), F.lit(0).alias("y_idx"), F.explode(F.array(F.lit(0), F.lit(1))).alias("x_idx"), F.col("v").alias("value"))
    append_to_cube(fields, writer, meta, str(tmp_path / "check")).awaitTermination()
    assert sorted((str(r.time)[:10], r.x_idx, r.value) for r in writer.read(spark).collect()) == [(f"2025-01-0{d + 1}", x, 144.0 * d) for d in range(3) for x in range(2)]


class _Counted:
    """The saved answers of a folder by HTTP, and how often each was asked for."""

    def __init__(self, address):
        import threading
        import urllib.parse
        from collections import Counter
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        asked = self.asked = Counter()

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                what, _, query = self.path[1:].partition("?")
                path = address(what, **dict(urllib.parse.parse_qsl(query))).removeprefix("file://")
                asked[self.path] += 1
                try:
                    with open(path, "rb") as f:
                        body = f.read()
                except OSError:
                    self.send_error(404)
                    return
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


def test_every_answer_is_fetched_once(spark, service, tmp_path):
    rows = [(10.0 + 0.5 * x, 47.0 - 0.5 * y, 100.0 * (x + y)) for y in range(3) for x in range(5)]
    spark.createDataFrame(rows, "lon double, lat double, orog double").write.parquet(str(tmp_path / "dem"))
    served = _Counted(service)
    config = {
        "general": {"timezone": "UTC", "start": "31.12.2024 23:00", "end": "02.01.2025 23:00", "parameters": "tair_2m"}, "aoi": {"minx": 10.0, "miny": 46.0, "maxx": 12.0, "maxy": 47.0},
        "base_grid": {"path": str(tmp_path / "dem"), "crs": 4326, "cache": False}, "meteo_input": {"handler": "province_api", "sleep_time": 0, "chunk_size_days": 1, "base_url": served.url, "elevation_url": None},
        "output": {"format": "tiff", "options": {"path": str(tmp_path / "tif")}}, "cross_validation": {},
    }
    with pytest.warns(UserWarning, match="1 requests failed"):
        result = run_workflow(Runtime.from_config(spark, config), min_samples=2)
    # Requests name the service's own wall time, an hour ahead of the configuration's.
    series = {k: n for k, n in served.asked.items() if k.startswith("/timeseries")}
    assert len(series) == 20 and set(series.values()) == {1}
    assert all("date_from=20250101" in k or "date_from=20250102" in k for k in series)
    assert [(r.station_id, r.sensor) for r in result.errors.collect()] == [("S4", "N")]
    assert result.fits.count() == 3 and result.scores.count() == 3 and len(result.written) == 3  # days of UTC, the first of which has an hour
    assert set(series.values()) == {1} and sum(k.startswith("/timeseries") for k in served.asked) == 20
    served.server.shutdown()


def test_requests_of_years_and_zones(spark, service):
    own = ProvinceSource(address=service, chunk_size_days=365)
    first = lambda *a: [r["url"].rpartition("/")[2].split("_")[-2:] for r in own.requests(spark, ["S0"], *a, ["tair_2m"])[0]]
    utc = __import__("datetime").timezone.utc
    assert first(datetime(2024, 12, 1, tzinfo=utc), datetime(2025, 7, 1, tzinfo=utc)) == [["202412010100", "202412312350.json"], ["202501010000", "202507010150.json"]]
    assert first(datetime(2024, 12, 1), datetime(2025, 2, 1)) == [["202412010000", "202412312350.json"], ["202501010000", "202501312350.json"]]
    assert len(own.requests(spark, ["S0"], datetime(2024, 12, 1), datetime(2025, 2, 1), ["tair_2m"], split_years=False)[0]) == 1
