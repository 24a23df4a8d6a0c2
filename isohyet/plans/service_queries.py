"""Queries of the parts at the engine's edges: the weather service, rasters and their cache, configuration, cube and files.

The service is played by the nation table: each nation is a station whose answers are in the addresses themselves (data:), so that the executors fetch them
as they fetch real ones. What is written goes to a scratch folder and is read back.
"""

from __future__ import annotations

import json
import urllib.parse
from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.config import Runtime, localize_time, read_config
from isohyet.functions import proj
from isohyet.operators import grid, model, sensors, stations
from isohyet.operators.aoi import AOI
from isohyet.operators.grid_meta import GridMeta
from isohyet.operators.resample import Resampler
from isohyet.plans import queries as q
from isohyet.plans.queries import query, read, rounded
from isohyet.sinks import files
from isohyet.sinks.cube import CubeWriter
from isohyet.sinks.registry import Writer, create_writer
from isohyet.sinks.scores import ScoreStore
from isohyet.sinks.tiff import TiffWriter, read_tiff, tiff_files
from isohyet.sinks.zarr import export_zarr
from isohyet.sources.province import ProvinceSource
from isohyet.sources.raster import open_raster
from isohyet.sources.registry import Source, create_source
from isohyet.sources.zarr import read_cube

# Sources (S1-S15)

START, END = datetime(2024, 12, 30, tzinfo=timezone.utc), datetime(2025, 1, 4, tzinfo=timezone.utc)
#: Requests' windows of START to END in the service's zone: two days at most, none across the year's end.
WINDOWS = "(VALUES ('202412300100', '202412312350'), ('202501010000', '202501022350'), ('202501030000', '202501040050')) w(a, b)"
STATIONS = "SELECT 'N' || n_nationkey AS id, n_nationkey AS k, n_regionkey AS r, n_name AS name FROM nation"
SENSORS = f"SELECT id, k, r, sensor FROM ({STATIONS}) JOIN (VALUES ('LT', 0), ('N', 1)) s(sensor, needs) ON k % 2 >= needs"


def service(spark: SparkSession, sf_dir: str, **options) -> ProvinceSource:
    nations = {f"N{r.n_nationkey}": r for r in read(spark, sf_dir, "nation").collect()}

    def address(what: str, **asked) -> str:
        if what == "stations":
            answer = {"features": [{"properties": {"SCODE": k, "LAT": 46 + r.n_nationkey / 100, "LONG": 11 + r.n_nationkey / 50, "ALT": None if r.n_nationkey % 5 == 4 else 100.0 * r.n_regionkey, "NAME_D": r.n_name}} for k, r in nations.items()]}
        elif what == "sensors":
            answer = [{"TYPE": x} for x in (["LT", "N", "LT"] if nations[asked["station_code"]].n_nationkey % 2 else ["LT"])]
        else:
            r, first = nations[asked["station_code"]], datetime.strptime(asked["date_from"], "%Y%m%d%H%M")
            values = [r.n_regionkey + i / 4 for i in range(3)]
            answer = [{"DATE": f"{first + timedelta(minutes=10 * min(i, 1)):%Y-%m-%dT%H:%M:%S}CET", "VALUE": v} for i, v in enumerate(values)]  # the third repeats the second's time
        mark = "&".join(f"{k}={v}" for k, v in asked.items())
        return f"data:application/json;{mark}," + urllib.parse.quote(json.dumps(answer))

    return create_source("province_api", address=address, sleep_time=0, chunk_size_days=2, elevation_url=None, **options)


@query(f"""SELECT id, 11 + k / 50 AS x, 46 + k / 100 AS y, CASE WHEN k % 5 < 4 THEN 100.0 * r END::DOUBLE AS elevation, name, CAST(4326 AS INTEGER) AS crs FROM ({STATIONS})""")
def source_stations(spark, sf_dir):
    return rounded(service(spark, sf_dir).stations(spark), "x", "y", digits=9)


@query(f"""SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS place FROM ({STATIONS})""")
def source_station_codes(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(service(spark, sf_dir).station_codes(spark))), "place long, id string").select("id", "place")


@query(SENSORS.replace("id, k, r, sensor", "id, sensor"))
def source_sensor_codes(spark, sf_dir):
    own = service(spark, sf_dir)
    return spark.createDataFrame([(s, c) for s in own.station_codes(spark) for c in own.sensor_codes(s)], "id string, sensor string")


@query(f"""SELECT id AS station, sensor, a AS date_from, b AS date_to FROM ({SENSORS}), {WINDOWS}""")
def source_requests(spark, sf_dir):
    asked, _ = service(spark, sf_dir).requests(spark, None, START, END)
    rows = [(r["station"], r["sensor"], *(r["url"].partition(f"{k}=")[2][:12] for k in ("date_from", "date_to"))) for r in asked]
    return spark.createDataFrame(rows, "station string, sensor string, date_from string, date_to string")


@query(f"""SELECT id AS station, 'N' AS sensor FROM ({STATIONS}) WHERE k % 2 = 0""")
def source_missing_sensors(spark, sf_dir):
    _, missing = service(spark, sf_dir).requests(spark, None, START, END, ["tair_2m", "precipitation"])
    return spark.createDataFrame(missing, "station string, sensor string")


_READINGS = f"""SELECT id, sensor, strptime(a, '%Y%m%d%H%M') + to_minutes(CAST(10 * least(i, 1) AS BIGINT)) AS moment, i, CAST(r + i / 4 AS DOUBLE) AS v FROM ({SENSORS}), {WINDOWS}, range(3) n(i)"""


@query(f"""SELECT strftime(moment, '%Y-%m-%dT%H:%M:%S') || 'CET' AS "DATE", v AS "VALUE", sensor, id AS station_id FROM ({_READINGS})""")
def source_series(spark, sf_dir):
    return service(spark, sf_dir).raw(spark, None, START, END).select("DATE", "VALUE", "sensor", "station_id")


@query(f"""WITH one AS (SELECT id, sensor, moment, arg_min(v, i) AS v FROM ({_READINGS}) GROUP BY ALL)
    SELECT id AS station_id, (moment - INTERVAL 1 HOUR)::TIMESTAMP AS datetime, max(CASE WHEN sensor = 'LT' THEN v END) AS tair_2m, max(CASE WHEN sensor = 'N' THEN v END) AS precipitation FROM one GROUP BY ALL""")
def source_observations(spark, sf_dir):
    return service(spark, sf_dir).observations(spark, None, START, END).select("station_id", "datetime", "tair_2m", "precipitation")


@query(f"""SELECT id AS station_id, sensor, count(*) AS requests FROM ({SENSORS}), {WINDOWS} WHERE k % 3 = 1 GROUP BY ALL""")
def source_errors(spark, sf_dir):
    """Requests of every third station fail; they are rows, not silence."""
    own = service(spark, sf_dir)
    answer = own.address
    own.address = lambda what, **asked: "data:application/json,broken" if what == "timeseries" and int(asked["station_code"][1:]) % 3 == 1 else answer(what, **asked)
    return own.errors(own.raw(spark, None, START, END)).groupBy("station_id", "sensor").agg(F.count("*").alias("requests"))


@query("SELECT 'source' AS kind, 'province_api' AS name UNION ALL SELECT 'sink', unnest(['tiff', 'zarr']) UNION ALL SELECT 'refused', unnest(['sink', 'source'])")
def registries(spark, sf_dir):
    refused = []
    for kind, create in (("source", create_source), ("sink", create_writer)):
        try:
            create(read(spark, sf_dir, "region").first()[1])
        except ValueError:
            refused.append(("refused", kind))
    create_source("province_api"), create_writer("tiff", path="x")  # both register themselves
    return spark.createDataFrame([("source", "province_api")] * ("province_api" in Source.registry) + [("sink", k) for k in ("tiff", "zarr") if k in Writer.registry] + refused, "kind string, name string")


@query("""SELECT json_extract_string(props, '$.k')::VARCHAR AS k, count(*) AS n FROM events GROUP BY 1""")
def json_props(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT md5(c_name) AS name_md5, sha256(CAST(c_custkey AS VARCHAR)) AS key_sha256 FROM customer""")
def hashes(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.md5(F.col("c_name").cast("binary")).alias("name_md5"), F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256).alias("key_sha256"))


def stored_raster(spark: SparkSession, sf_dir: str) -> str:
    """The raster as a file in long form, with dimensions lon and lat and a CRS beside it."""
    path = f"{files.scratch_folder(spark)}/raster"
    q.raster(spark, sf_dir).select(F.round("x", 6).alias("lon"), F.round("y", 6).alias("lat"), F.col("value").alias("orog"), F.lit(0.0).alias("other")).write.parquet(path)
    files.write_text(spark, f"{path}.json", json.dumps({"crs": 4326}))
    return path


@query(f"WITH {q._RASTER} SELECT y_idx, x_idx, round(47.0 - y_idx * 0.01, 6) AS y, round(10.0 + x_idx * 0.01, 6) AS x, value FROM g")
def raster_open(spark, sf_dir):
    cells, _ = open_raster(spark, stored_raster(spark, sf_dir), "orog")
    return rounded(cells, "y", "x", digits=6)


@query(f"WITH {q._RASTER} SELECT round(47.0 - y_idx * 0.01, 6) AS y, round(10.0 + x_idx * 0.01, 6) AS x, value FROM g")
def grid_dims(spark, sf_dir):
    named = q.raster(spark, sf_dir).select(F.col("x").alias("LON"), F.col("y").alias("Latitude"), "value")
    return rounded(grid.normalize_dims(named), "y", "x", digits=6)


def _base_grid(spark, sf_dir, cache_folder, path=None, **options) -> grid.BaseGrid:
    return grid.BaseGrid(spark, path or stored_raster(spark, sf_dir), var="orog", cache_folder=cache_folder, **options)


@query(f"WITH {q._RASTER} SELECT CAST(g.y_idx // 2 AS INTEGER) AS y_idx, CAST(g.x_idx // 2 AS INTEGER) AS x_idx, round(avg(value), 6) AS value FROM g GROUP BY 1, 2")
def base_grid_cached(spark, sf_dir):
    """Regridded and kept; the second grid of the same settings comes from the cache, without the raster."""
    folder, path = files.scratch_folder(spark), stored_raster(spark, sf_dir)
    first = _base_grid(spark, sf_dir, folder, path, target_res=0.02, resampling_method="average")
    files.delete(spark, path)
    second = _base_grid(spark, sf_dir, folder, path, target_res=0.02, resampling_method="average")
    if (first.key, first.meta) != (second.key, second.meta):
        raise ValueError("the cache gave another grid")
    return rounded(second.cells.select("y_idx", "x_idx", "value"), "value", digits=6)


@query(f"""WITH {q._RASTER} SELECT y_idx, x_idx, value FROM g WHERE 10.0 + x_idx * 0.01 BETWEEN 10.1 - 0.005 AND 10.3 + 0.005 AND 47.0 - y_idx * 0.01 BETWEEN 45.0 - 0.005 AND 46.9 + 0.005""")
def base_grid_clipped(spark, sf_dir):
    return _base_grid(spark, sf_dir, files.scratch_folder(spark), aoi=AOI(10.1, 45.0, 10.3, 46.9)).cells.select("y_idx", "x_idx", "value")


@query(f"""SELECT {q.ROWS} AS ny, CAST(64 AS BIGINT) AS nx, 0.01::DOUBLE AS res, 'EPSG:4326' AS crs""")
def base_grid_metadata(spark, sf_dir):
    own = _base_grid(spark, sf_dir, files.scratch_folder(spark), cache=False)
    return spark.createDataFrame([(own.meta.ny, own.meta.nx, round(own.meta.res[0], 9), repr(own).rpartition(", ")[2].rstrip(")"))], "ny long, nx long, res double, crs string")


# Configuration (S15, T15), names (T7, T8)


@query("""SELECT n_nationkey AS k, (timezone('UTC', timezone('Europe/Rome', TIMESTAMP '2025-01-05 00:30:00' + to_days(CAST(13 * n_nationkey AS INTEGER)))))::TIMESTAMP AS utc FROM nation""")
def config_times(spark, sf_dir):
    """Times of a configuration, day first and of a zone."""
    rows = []
    for r in read(spark, sf_dir, "nation").collect():
        wall = datetime(2025, 1, 5, 0, 30) + timedelta(days=13 * r.n_nationkey)
        rows.append((r.n_nationkey, localize_time(f"{wall:%d.%m.%Y %H:%M}", "Europe/Rome").astimezone(timezone.utc).replace(tzinfo=None)))
    return spark.createDataFrame(rows, "k int, utc timestamp_ntz")


@query("""SELECT * FROM (VALUES ('parameters', 'tair_2m'), ('start', '2025-02-01T00:00:00+01:00'), ('stations', 'N1'), ('stations', 'N2'), ('sink', 'TiffWriter'), ('source', 'ProvinceSource'), ('empty', '{}'), ('missing file', 'refused')) t(name, value)""")
def config_wired(spark, sf_dir):
    """A configuration file and what it is wired to; a plain text is a list of one."""
    import os
    import tempfile

    raster = stored_raster(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:  # the file is the driver's
        path, empty = f"{folder}/config.yaml", f"{folder}/empty.yaml"
        own = {
            "general": {"timezone": "Europe/Rome", "start": "01.02.2025", "end": "03.02.2025", "parameters": "tair_2m", "stations": [" N1", "N2", "N1"]}, "aoi": {"minx": 10.1, "miny": 45.0, "maxx": 10.3, "maxy": 46.9},
            "base_grid": {"path": raster, "var": "orog", "cache": False}, "meteo_input": {"handler": "province_api"}, "output": {"format": "tiff", "options": {"path": f"{folder}/out"}},
        }
        with open(path, "w", encoding="utf-8") as f:
            json.dump(own, f)  # JSON is YAML too
        open(empty, "w").close()
        runtime = Runtime.from_config_file(spark, path)
        rows = [("empty", json.dumps(read_config(empty))), ("source", type(runtime.source).__name__), ("sink", type(runtime.writer).__name__), ("start", runtime.start.isoformat())]
        rows += [("parameters", x) for x in runtime.parameters] + [("stations", x) for x in runtime.stations]
        try:
            read_config(os.path.join(folder, "none.yaml"))
        except ValueError:
            rows.append(("missing file", "refused"))
    return spark.createDataFrame(rows, "name string, value string")


@query("""SELECT c_mktsegment AS code, CAST(row_number() OVER (ORDER BY min(c_custkey)) - 1 AS BIGINT) AS place FROM customer GROUP BY 1""")
def sensor_codes_normalised(spark, sf_dir):
    """Stripped codes in order, without blanks and repeats. The list is the driver's, as long as a request's list of sensors: each segment's first and last customer."""
    ends = read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b"))
    asked = [f"  {r.c_mktsegment} " for r in ends.select("c_mktsegment", F.explode(F.array("a", "b")).alias("k")).orderBy("k").collect()]
    return spark.createDataFrame(list(enumerate(sensors.normalize_codes([*asked, " ", ""]))), "place long, code string").select("code", "place")


@query("""SELECT * FROM (VALUES ('tair_2m', 'LT'), ('precipitation', 'N'), ('wind_gust', 'WG.BOE'), ('LT', 'LT'), ('N', 'N'), ('mixed', 'refused'), ('unknown', 'refused')) t(asked, code)""")
def sensor_codes_resolved(spark, sf_dir):
    rows = []
    for asked in (["tair_2m", "precipitation", "wind_gust"], ["LT", "N"]):
        rows += zip(asked, sensors.PROVINCE.resolve(asked))
    for name, asked in (("mixed", ["tair_2m", "N"]), ("unknown", [read(spark, sf_dir, "region").first()[1]])):
        try:
            sensors.PROVINCE.resolve(asked)
        except KeyError:
            rows.append((name, "refused"))
    return spark.createDataFrame(rows, "asked string, code string")


# Collections, guards, areas (M2, R11, A1, A2, G2, G3)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS elevation, n FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey""")
def collection_built(spark, sf_dir):
    """One collection of five parts by nation, whose ids are numbers, and of nothing."""
    own = q.customers(spark, sf_dir).withColumn("id", F.col("id").cast("long"))
    seen = q.events(spark, sf_dir).select(F.col("user_id").alias("station_id"), "datetime", F.col("value").alias("tair_2m"))
    parts = [(own.filter(F.col("id") % 5 == i), seen.filter(F.col("station_id") % 5 == i)) for i in range(5)]
    data = stations.MeteoData.build([*parts, None])
    counts = data.observations.groupBy(F.col("station_id").alias("id")).agg(F.count("*").alias("n"))
    return data.stations.join(counts, "id", "left").select("id", "elevation", "n")


@query("""SELECT * FROM (VALUES ('keys', true), ('missing column', true), ('samples', true), ('text', true), ('unknown aggregate', true)) t(name, refused) UNION ALL SELECT 'rows without a time', count(*) > 0 FROM events""")
def resample_guards(spark, sf_dir):
    """Inputs that are refused, and times that can't be read, which are left out."""
    data = q.events(spark, sf_dir).select("datetime", "event_type", "value")
    calls = {
        "missing column": lambda: Resampler().apply(data.drop("datetime"), "D"), "keys": lambda: Resampler().apply(data, "D", groupby_cols=["none"]),
        "samples": lambda: Resampler().apply(data, "D", min_sample_size=0), "text": lambda: Resampler({}).apply(data, "D"), "unknown aggregate": lambda: Resampler({"value": "mode"}),
    }
    bad = data.withColumn("datetime", F.concat(F.lit("no time "), F.col("datetime").cast("string")))
    left = Resampler({"value": "sum"}).apply(bad, "D", groupby_cols=["event_type"])
    rows = [("rows without a time", left.isEmpty())]
    return spark.createDataFrame(rows + refusals(calls, ValueError), "name string, refused boolean")


def refusals(calls: dict, *kinds) -> list[tuple[str, bool]]:
    out = []
    for name, call in calls.items():
        try:
            call()
        except kinds:
            out.append((name, True))
        else:
            out.append((name, False))
    return out


_MERCATOR = "6378137.0 * radians({x})", "6378137.0 * ln(tan(pi() / 4 + radians({y}) / 2))"


@query(f"""WITH b AS (SELECT n_nationkey AS k, n_nationkey * 2.0 AS x0, n_nationkey * 1.5 AS y0, n_nationkey * 2.0 + 1 + n_regionkey AS x1, n_nationkey * 1.5 + 2 AS y1 FROM nation)
    SELECT k, round({_MERCATOR[0].format(x="x0")} - 500, 3) AS minx, round({_MERCATOR[1].format(y="y0")} - 500, 3) AS miny, round({_MERCATOR[0].format(x="x1")} + 500, 3) AS maxx, round({_MERCATOR[1].format(y="y1")} + 500, 3) AS maxy FROM b""")
def aoi_transformed(spark, sf_dir):
    """Boxes in another system, and half a kilometre more on each side."""
    rows = []
    for r in read(spark, sf_dir, "nation").collect():
        box = AOI(r.n_nationkey * 2.0, r.n_nationkey * 1.5, r.n_nationkey * 2.0 + 1 + r.n_regionkey, r.n_nationkey * 1.5 + 2).to_crs(3857).buffer(500)
        rows.append((r.n_nationkey, *(round(x, 3) for x in box.bounds)))
    return spark.createDataFrame(rows, "k int, minx double, miny double, maxx double, maxy double")


@query("""SELECT n_nationkey AS k, true AS west, true AS east FROM nation""")
def aoi_buffered(spark, sf_dir):
    """A box in degrees, moved out by 10 km: both sides' middles are then about 10 km away, on the ellipsoid."""
    rows = []
    for r in read(spark, sf_dir, "nation").collect():
        box = AOI(9.0 + r.n_nationkey, 40.0 + r.n_nationkey, 9.4 + r.n_nationkey, 40.3 + r.n_nationkey)
        more, middle = box.buffer(10_000), 40.15 + r.n_nationkey
        near = [abs(proj.geodesic(a, middle, b, middle)[0] - 10_000) < 150 for a, b in ((box.minx, more.minx), (box.maxx, more.maxx))]
        rows.append((r.n_nationkey, *near))
    return spark.createDataFrame(rows, "k int, west boolean, east boolean")


_SYSTEMS = "SELECT n_nationkey AS k, CASE WHEN n_regionkey % 3 = 0 THEN 4326 WHEN n_regionkey % 3 = 1 THEN 3857 END AS f, CASE WHEN n_nationkey % 2 = 0 THEN 32632 END AS c FROM nation"


@query(f"""SELECT k, CAST(coalesce(f, c) AS INTEGER) AS crs, f IS NOT NULL AND c IS NOT NULL AS warned FROM ({_SYSTEMS})""")
def grid_crs_chosen(spark, sf_dir):
    rows = []
    for r in read(spark, sf_dir, "nation").collect():
        of_file, of_config = {0: 4326, 1: 3857, 2: None}[r.n_regionkey % 3], 32632 if r.n_nationkey % 2 == 0 else None
        try:
            crs, warning = grid.resolve_crs(of_file, of_config)
        except ValueError:
            crs, warning = None, None
        rows.append((r.n_nationkey, crs, warning is not None))
    return spark.createDataFrame(rows, "k int, crs int, warned boolean")


@query("""SELECT n_nationkey AS k, n_regionkey = 1 OR n_nationkey % 4 IN (1, 3) AS needed FROM nation""")
def grid_regrid_decision(spark, sf_dir):
    meta, rows = GridMeta(10.0, 47.0, 0.01, -0.01, 64, 500, 4326), []
    for r in read(spark, sf_dir, "nation").collect():
        res = (0.01 * (1 + 1e-12), 0.02, None, (0.01, 0.03))[r.n_nationkey % 4]
        rows.append((r.n_nationkey, grid.needs_regrid(meta, 3857 if r.n_regionkey == 1 else 4326, res)))
    return spark.createDataFrame(rows, "k int, needed boolean")


# The model (I4, I8, I10)


@query(f"""WITH {q._SAMPLES}, t AS (SELECT *, c_custkey % 4 AS region FROM s), f AS (SELECT param, interp_date, region, CASE WHEN var_pop(elevation) = 0 THEN 0.0 ELSE regr_slope(y, elevation) END AS b, avg(y) AS my, avg(elevation) AS mx FROM t GROUP BY ALL)
    SELECT param, interp_date, CAST(s_suppkey // 10 AS INTEGER) AS y_idx, CAST(s_suppkey % 10 AS INTEGER) AS x_idx, round(my - b * mx + b * s_acctbal, 3) AS value FROM supplier JOIN f ON s_suppkey % 4 = region""")
def regional_predict(spark, sf_dir):
    own = q.daily_samples(spark, sf_dir).withColumn("region", F.col("station_id").cast("long") % 4)
    cells = read(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 10).cast("int").alias("y_idx"), (F.col("s_suppkey") % 10).cast("int").alias("x_idx"), F.col("s_acctbal").alias("value"), (F.col("s_suppkey") % 4).alias("region"))
    return rounded(model.interpolate(own, cells, regions="region")[0].drop("region"), "value", digits=3)


@query("SELECT * FROM (VALUES ('fit_intercept', false), ('positive', true)) t(name, value)")
def model_parameters(spark, sf_dir):
    own = model.VerticalModel().set_params(positive=True).set_params(fit_intercept=False)
    return spark.createDataFrame(sorted(own.get_params().items()), "name string, value boolean")


@query("WITH a AS (" + q.ORACLE_SQL["cross_validation"] + ") SELECT run_id, a.* FROM a, (VALUES ('first'), ('second')) t(run_id)")
def scores_stored(spark, sf_dir):
    store = ScoreStore(f"{files.scratch_folder(spark)}/scores")
    scores = q.cross_validation(spark, sf_dir)
    for run in ("first", "second"):
        store.append(scores, run)
    return store.read(spark).drop("stored_at")


# The cube and files (K1-K14)

_DAYS = 5


def cube_cells(spark, sf_dir) -> tuple[DataFrame, GridMeta]:
    """The raster's rows as slices of five days, and the slices' grid; its last row may be there on some of the days only."""
    whole = q.raster_meta(spark, sf_dir)
    meta = GridMeta(10.0, 47.0, 0.01, -0.01, 64, -(-whole.ny // _DAYS), 4326)
    day = F.expr(f"timestamp_ntz'2025-01-01' + make_interval(0, 0, 0, y_idx % {_DAYS})")
    return q.raster(spark, sf_dir, whole).select(F.lit("tas").alias("var"), day.alias("time"), F.floor(F.col("y_idx") / _DAYS).cast("int").alias("y_idx"), "x_idx", "value"), meta


def cube(spark, **options) -> CubeWriter:
    return CubeWriter(f"{files.scratch_folder(spark)}/cube", "2025-01-01", "2025-01-31", "D", ["tas", "pr"], **options)


_CUBE = f"{q._RASTER}, c AS (SELECT CAST(g.y_idx % {_DAYS} AS INTEGER) AS day, CAST(g.y_idx // {_DAYS} AS INTEGER) AS y_idx, x_idx, value FROM g)"
_CUBE_TIME = "(TIMESTAMP '2025-01-01' + to_days(day))::TIMESTAMP AS time"


@query(f"WITH {_CUBE} SELECT 'tas' AS var, {_CUBE_TIME}, y_idx, x_idx, round(CASE WHEN day = 2 THEN value + 7 WHEN day = 4 AND x_idx < 9 THEN value - 1 ELSE value END, 5) AS value FROM c")
def cube_written(spark, sf_dir):
    """Days written one by one in any order, one of them twice, then a part of one; read back."""
    (cells, meta), own = cube_cells(spark, sf_dir), cube(spark)
    day = lambda i: cells.filter(F.dayofmonth("time") == i + 1)
    for i in (3, 0, 4, 2, 1):
        own.write(day(i), meta)
    own.write(day(2).withColumn("value", F.col("value") + 7), meta)
    own.write(day(4).filter("x_idx < 9").withColumn("value", F.col("value") - 1), meta)
    return rounded(own.read(spark), "value", digits=5)


@query(f"WITH {_CUBE} SELECT 'tas' AS var, {_CUBE_TIME}, y_idx, x_idx, CASE WHEN (y_idx + x_idx) % 11 > 0 THEN round(CAST(round_even(value / 0.01, 0) AS SMALLINT) * 0.01::DOUBLE, 6) END AS value FROM c")
def cube_packed(spark, sf_dir):
    (cells, meta), own = cube_cells(spark, sf_dir), cube(spark, dtype="int16", scale_factor=0.01, fill_value=-9999)
    own.write(cells.withColumn("value", F.when((F.col("y_idx") + F.col("x_idx")) % 11 > 0, F.col("value"))), meta)
    return rounded(own.read(spark, ["tas"]), "value", digits=6)


@query(f"WITH {_CUBE} SELECT 'tas' AS var, {_CUBE_TIME}, y_idx, x_idx, value FROM c")
def zarr_exported(spark, sf_dir):
    """A cube as a Zarr store, read back chunk by chunk."""
    (cells, meta), own = cube_cells(spark, sf_dir), cube(spark, chunks={"y": 16, "x": 40})
    own.write(cells, meta)
    path = f"{files.scratch_folder(spark)}/cube.zarr"
    export_zarr(spark, own, path)
    return read_cube(spark, path)


@query(q.ORACLE_SQL["grid_explode"])
def zarr_raster(spark, sf_dir):
    """The whole raster as a Zarr store of one day, opened as a base grid."""
    meta = GridMeta(10.0, 47.0, 0.01, -0.01, 64, q.raster_meta(spark, sf_dir).ny, 4326)
    path = files.scratch_folder(spark)
    own = CubeWriter(f"{path}/cube", "2025-01-01", "2025-01-01", "D", ["orog"], chunks={"y": 100, "x": 64})
    own.write(q.raster(spark, sf_dir).select(F.lit("2025-01-01").cast("timestamp_ntz").alias("time"), "y_idx", "x_idx", "value"), meta)
    export_zarr(spark, own, f"{path}/orog.zarr")
    cells, _ = open_raster(spark, f"{path}/orog.zarr", "orog")
    return rounded(cells, "x", "y", digits=6)


@query(f"""SELECT * FROM (VALUES ('steps', '31'), ('crs', '4326'), ('variables', 'tas,pr'), ('chunks x', '40,24'), ('title', 'first'), ('cells', '0')) t(name, value) UNION ALL SELECT 'rows', CAST({q.ROWS} // {_DAYS} AS VARCHAR)""")
def cube_created(spark, sf_dir):
    """A cube that is created without data; creating it again changes nothing, nor do later attributes."""
    (cells, meta), own = cube_cells(spark, sf_dir), cube(spark, chunks={"x": 40})
    meta = replace(meta, ny=q.raster_meta(spark, sf_dir).ny // _DAYS)  # the rows that all days have
    own.create(spark, meta, attributes={"title": "first"})
    made = own.create(spark, meta, attributes={"title": "second"})
    own.write(cells.limit(0), meta, attributes={"title": "third"})
    kept = own.manifest(spark)
    stamp = json.loads(kept.to_json())["attributes"]["crs"]
    n = own.read(spark).count()
    rows = [("steps", kept.axis(spark).count()), ("crs", stamp), ("variables", ",".join(kept.variables)), ("chunks x", ",".join(map(str, made.chunks["x"]))), ("title", kept.attributes["title"]), ("cells", n), ("rows", kept.grid.ny)]
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "name string, value string")


@query("""SELECT unnest(['chunks', 'coordinates', 'coords', 'crs', 'dimensions', 'existing file', 'mapping', 'no variables', 'other coordinates', 'scale', 'shape', 'time', 'variable']) AS name, true AS refused""")
def sink_refusals(spark, sf_dir):
    """What a cube and the file sink refuse, and leave as it was."""
    (cells, meta), own, exact = cube_cells(spark, sf_dir), cube(spark, chunks={"x": 32}), cube(spark, align=False)
    first = cells.filter("time = timestamp_ntz'2025-01-01'")
    own.write(first, meta), exact.create(spark, meta)
    tiff = TiffWriter(files.scratch_folder(spark).removeprefix("file:"))
    tiff.write(first, meta)
    new = lambda **x: CubeWriter("nowhere", "2025-01-01", "2025-01-31", "D", x.pop("variables", ["tas"]), **x)
    calls = {
        "shape": lambda: own.write(first, replace(meta, ny=meta.ny - 1)), "crs": lambda: own.write(first, replace(meta, crs=3857)), "coordinates": lambda: exact.write(first, replace(meta, x0=10.5)),
        "other coordinates": lambda: own.write(first, replace(meta, x0=10.5)), "chunks": lambda: own.write(first, meta, chunks={"x": 16}), "time": lambda: own.write(first.withColumn("time", F.lit("2026-01-01").cast("timestamp_ntz")), meta),
        "variable": lambda: own.write(first.withColumn("var", F.lit("other")), meta), "no variables": lambda: new(variables=[]), "mapping": lambda: new(chunks=[1]), "dimensions": lambda: new(shape={"y": 1}),
        "coords": lambda: new(shape={"y": 2, "x": 2}, coords={"y": [1.0], "x": [1.0, 2.0]}), "scale": lambda: new(dtype="int7"), "existing file": lambda: tiff.write(first, meta),
    }
    return spark.createDataFrame(refusals(calls, ValueError, NotImplementedError), "name string, refused boolean")


@query(q.ORACLE_SQL["vertical_predict"])
def tiff_read_back(spark, sf_dir):
    """The files' bytes, decoded: cells of all parameters and dates."""
    field = q.vertical_predict(spark, sf_dir).select(F.col("param").alias("var"), F.col("interp_date").alias("time"), "y_idx", "x_idx", "value")
    rows = read(spark, sf_dir, "supplier").agg(F.floor(F.max("s_suppkey") / 10) + 1).first()[0]
    meta = GridMeta(10.0, 47.0, 0.01, -0.01, 10, int(rows), 4326)

    def decode(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                width, height, values, tags = read_tiff(content)
                if tags[34735][-1] != 4326 or tuple(tags[33550][:2]) != (0.01, 0.01):
                    raise ValueError("the file lacks its place")
                at = np.flatnonzero(~np.isnan(values))
                yield pd.DataFrame({"name": name, "y_idx": at // width, "x_idx": at % width, "value": np.array(values)[at]})

    cells = tiff_files(field, meta).mapInPandas(decode, "name string, y_idx int, x_idx int, value double")
    time = F.to_timestamp_ntz(F.regexp_extract("name", r"_(\d{4}_.*)\.tif$", 1), F.lit("yyyy_MM_dd_HHmmss"))
    return cells.select(F.regexp_extract("name", r"^(.*?)_\d{4}_", 1).alias("param"), time.alias("interp_date"), "y_idx", "x_idx", "value")


@query("""SELECT event_type || '.tif' AS name, CAST(count(DISTINCT user_id) AS BIGINT) AS cells FROM events GROUP BY 1""")
def tiff_written(spark, sf_dir):
    """Files of rasters without a time, written by the tasks and listed with their bytes' cells: each user a cell."""
    folder = files.scratch_folder(spark)
    users = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("var"), "user_id").agg(F.sum("value").alias("value"))
    last = users.agg(F.max("user_id")).first()[0]
    meta = GridMeta(10.0, 47.0, 0.01, -0.01, 10, last // 10 + 1, 4326)
    data = users.select("var", F.floor(F.col("user_id") / 10).cast("int").alias("y_idx"), (F.col("user_id") % 10).cast("int").alias("x_idx"), "value")
    writer = create_writer("tiff", path=folder)
    writer.write(data, meta)
    writer.write(data, meta, overwrite=True)
    found = spark.read.format("binaryFile").load(f"{folder}/*.tif")

    def count(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"name": [p.rpartition("/")[2] for p in batch["path"]], "cells": [int((~np.isnan(read_tiff(c)[2])).sum()) for c in batch["content"]]})

    return found.select("path", "content").mapInPandas(count, "name string, cells long")
