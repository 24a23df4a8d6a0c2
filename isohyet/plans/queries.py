"""The engine's queries, each with the SQL that it must agree with.

The tables stand in for the engine's own: events are observations (user_id or event_type is the station or sensor, ts the time, value
the reading), customers stations (c_acctbal the elevation), suppliers an elevation grid, embeddings a raster (one array per grid row), lineitem and
orders long resampling inputs, parts points in a plane. Doubles are rounded on both sides, as sums depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions import proj, zones
from isohyet.operators import grid, model, sensors, stations, tidy, validate
from isohyet.operators.aoi import AOI
from isohyet.operators.grid_meta import GridMeta, GridValidator
from isohyet.operators.resample import Resampler
from isohyet.sinks.cube import Encoding, Manifest, unknown_times, upsert
from isohyet.sources.chunks import chunk_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Rows of the raster, in SQL.
ROWS = "(SELECT CAST(max(vec_id) + 1 AS BIGINT) FROM embeddings)"
CODES = ["click", "view", "purchase", "signup", "error"]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(frame: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return frame.withColumns({n: F.round(n, digits) for n in names})


def raster_meta(spark: SparkSession, sf_dir: str) -> GridMeta:
    """The raster's place in the plane: 64 columns, rows as many as the table has."""
    return GridMeta(10.0, 47.0, 0.01, -0.01, 64, read(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1, 4326)


def raster(spark: SparkSession, sf_dir: str, meta: GridMeta | None = None) -> DataFrame:
    return grid.explode_rows(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", meta or raster_meta(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("datetime"), "user_id", "event_type", "value")


# Resampling (R1-R13)


def resample_daily(spark: SparkSession, sf_dir: str, min_sample_size: int) -> DataFrame:
    data = events(spark, sf_dir).select("datetime", "event_type", "value")
    out = Resampler({"value": ["mean", "sum", "min", "max"]}).apply(data, "D", groupby_cols=["event_type"], min_sample_size=min_sample_size)
    return rounded(out, "value_mean", "value_sum", "value_min", "value_max")


_DAILY = """SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS datetime,
    CASE WHEN count(value) >= 60 THEN round(avg(value), 4) END AS value_mean, CASE WHEN count(value) >= 60 THEN round(sum(value), 4) END AS value_sum,
    CASE WHEN count(value) >= 60 THEN round(min(value), 4) END AS value_min, CASE WHEN count(value) >= 60 THEN round(max(value), 4) END AS value_max
    FROM events GROUP BY ALL"""


@query(_DAILY)
def resample_daily_masked(spark, sf_dir):
    return resample_daily(spark, sf_dir, 60)


@query("""SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS datetime, round(median(value), 4) AS value_median, round(arg_min(value, ts), 4) AS value_first,
    round(arg_max(value, ts), 4) AS value_last FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def resample_median_first_last(spark, sf_dir):
    data = events(spark, sf_dir).select("datetime", "event_type", "value")
    out = Resampler({"value": ["median", "first", " LAST "]}).apply(data, "1D", groupby_cols=["event_type"])
    return rounded(out, "value_median", "value_first", "value_last")


@query("""WITH b AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS d, sum(value) AS s, avg(value) AS m, count(value) AS n FROM events GROUP BY 1),
    r AS (SELECT unnest(generate_series((SELECT min(d) FROM b), (SELECT max(d) FROM b), INTERVAL '6 hours')) AS d)
    SELECT r.d::TIMESTAMP AS datetime, round(coalesce(s, 0.0), 4) AS value_sum, round(m, 4) AS value_mean FROM r LEFT JOIN b USING (d)""")
def resample_empty_bins(spark, sf_dir):
    data = events(spark, sf_dir).select("datetime", "value")
    return rounded(Resampler({"value": ["sum", "mean"]}).apply(data, "6h"), "value_sum", "value_mean")


@query("""SELECT user_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01')::TIMESTAMP AS datetime, round(avg(value), 4) AS value FROM events GROUP BY ALL""")
def resample_6h(spark, sf_dir):
    return rounded(Resampler({}).apply(events(spark, sf_dir).select("datetime", "user_id", "value"), "6h", groupby_cols=["user_id"]), "value")


@query("""WITH o AS (SELECT user_id, date_trunc('day', min(ts)) AS o FROM events GROUP BY 1)
    SELECT user_id AS station_id, (o + to_seconds(CAST(floor(epoch(ts - o) / 25200) AS BIGINT) * 25200))::TIMESTAMP AS datetime, round(sum(value), 4) AS value FROM events JOIN o USING (user_id) GROUP BY ALL""")
def resample_7h_by_station(spark, sf_dir):
    data = events(spark, sf_dir).select("datetime", F.col("user_id").alias("station_id"), "value")
    return rounded(Resampler({"value": "sum"}).apply(data, "7h", groupby_cols=["station_id"], origin_cols=["station_id"], sort=False), "value")


@query("""SELECT event_type, (date_trunc('week', ts) + INTERVAL 6 DAYS)::TIMESTAMP AS datetime, round(avg(value), 4) AS value_mean, round(max(value), 4) AS value_max FROM events GROUP BY ALL""")
def resample_week(spark, sf_dir):
    data = events(spark, sf_dir).select("datetime", "event_type", "value")
    return rounded(Resampler({"value": ["mean", "max"]}).apply(data, "W", groupby_cols=["event_type"]), "value_mean", "value_max")


@query("""SELECT l_returnflag, last_day(l_shipdate)::TIMESTAMP AS datetime, round(sum(l_quantity), 2) AS l_quantity, round(avg(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY ALL""")
def resample_month_end(spark, sf_dir):
    data = read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("datetime"), "l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(Resampler({"l_quantity": "sum"}).apply(data, "ME", groupby_cols=["l_returnflag"]), "l_quantity", "l_extendedprice", digits=2)


@query("""SELECT o_orderpriority, date_trunc('quarter', o_orderdate)::TIMESTAMP AS datetime, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(max(o_totalprice), 2) AS o_totalprice_max FROM orders GROUP BY ALL""")
def resample_quarter_start(spark, sf_dir):
    data = read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("datetime"), "o_orderpriority", "o_totalprice")
    return rounded(Resampler({"o_totalprice": ["sum", "max"]}).apply(data, "QS", groupby_cols=["o_orderpriority"]), "o_totalprice_sum", "o_totalprice_max", digits=2)


@query("""SELECT o_orderstatus, make_date(year(o_orderdate), 12, 31)::TIMESTAMP AS datetime, round(min(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY ALL""")
def resample_year_end(spark, sf_dir):
    data = read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("datetime"), "o_orderstatus", "o_totalprice")
    return rounded(Resampler({"o_totalprice": "min"}).apply(data, "YE", groupby_cols=["o_orderstatus"]), "o_totalprice", digits=2)


@query("""WITH m AS (SELECT min(year(o_orderdate) * 12 + month(o_orderdate) - 1) AS m FROM orders),
    b AS (SELECT m + CAST(floor((year(o_orderdate) * 12 + month(o_orderdate) - 1 - m) / 2) AS BIGINT) * 2 AS b, o_totalprice FROM orders, m)
    SELECT make_date(b // 12, b % 12 + 1, 1)::TIMESTAMP AS datetime, round(sum(o_totalprice), 2) AS o_totalprice FROM b GROUP BY 1""")
def resample_two_months(spark, sf_dir):
    data = read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("datetime"), "o_totalprice")
    return rounded(Resampler({"o_totalprice": "sum"}).apply(data, "2MS"), "o_totalprice", digits=2)


@query("""SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS datetime, round(max(value) - min(value), 4) AS value FROM events GROUP BY ALL""")
def resample_callable(spark, sf_dir):
    def spread(c: Column) -> Column:
        return F.max(c) - F.min(c)

    return rounded(Resampler({"value": spread}).apply(events(spark, sf_dir).select("datetime", "event_type", "value"), "D", groupby_cols=["event_type"]), "value")


@query("""SELECT DISTINCT event_type, ts AS datetime FROM events""")
def resample_keys_only(spark, sf_dir):
    return Resampler({}, None).apply(events(spark, sf_dir).select("datetime", "event_type", "value"), "D", groupby_cols=["event_type"])


# Tidy transforms (T1-T15), vocabulary


@query("""SELECT event_id, user_id, event_type, day FROM (SELECT event_id, user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS day,
    row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY event_id) AS n FROM events) WHERE n = 1""")
def dedupe_first(spark, sf_dir):
    data = events(spark, sf_dir).select("event_id", "user_id", "event_type", F.date_trunc("day", "datetime").cast("timestamp_ntz").alias("day"))
    return tidy.dedupe_first(data, ["user_id", "event_type", "day"], ["event_id"])


_PIVOT = ", ".join(f"max(CASE WHEN event_type = '{c}' THEN v END) AS \"{c}\"" for c in CODES)


@query(f"""WITH d AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, event_type, round(arg_min(value, event_id), 4) AS v FROM events GROUP BY ALL)
    SELECT user_id, day, {_PIVOT} FROM d GROUP BY ALL""")
def pivot_sensors(spark, sf_dir):
    data = events(spark, sf_dir).withColumn("day", F.date_trunc("day", "datetime").cast("timestamp_ntz"))
    first = data.groupBy("user_id", "day", "event_type").agg(F.round(F.min_by("value", "event_id"), 4).alias("v"))
    return tidy.pivot_sensors(first, ["user_id", "day"], "event_type", "v", CODES)


_NAMES = {"click": "tair_2m", "view": "precipitation", "purchase": "wind_speed"}


@query("""SELECT ts AS datetime, round(value, 4) AS tair_2m, user_id AS other FROM events""")
def harmonise_names(spark, sf_dir):
    words = sensors.Vocabulary({"click": "tair_2m", "view": "precipitation"}, {"ts": "datetime"})
    data = read(spark, sf_dir, "events").select("ts", F.round("value", 4).alias("click"), F.col("user_id").alias("other"))
    return words.rename(data)


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'tair_2m' WHEN 'view' THEN 'precipitation' WHEN 'purchase' THEN 'wind_speed' END AS name FROM events""")
def vocabulary_lookup(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", sensors.Vocabulary(_NAMES).name_column("event_type").alias("name"))


@query("""SELECT event_id, timezone('UTC', timezone('Europe/Rome', ts))::TIMESTAMP AS utc FROM events""")
def localize_zone(spark, sf_dir):
    text = F.concat(F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("CET"))
    whole = events(spark, sf_dir).withColumn("utc", tidy.parse_local(text, "Europe/Rome"))
    # the text has whole seconds; what is below comes back unchanged
    below = F.unix_micros(F.col("datetime").cast("timestamp")) % 1_000_000
    return whole.select("event_id", F.timestamp_micros(F.unix_micros(F.col("utc").cast("timestamp")) + below).cast("timestamp_ntz").alias("utc"))


@query("""SELECT event_id, time_bucket(INTERVAL '10 minutes', ts)::TIMESTAMP AS slot FROM events""")
def floor_10min(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", zones.floor_seconds(F.col("datetime"), 600, "timestamp_ntz").alias("slot"))


@query(f"""WITH d AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, event_type, round(arg_min(value, event_id), 4) AS v FROM events GROUP BY ALL),
    p AS (SELECT user_id, day, {_PIVOT} FROM d GROUP BY ALL) SELECT * FROM p WHERE click IS NOT NULL OR purchase IS NOT NULL OR error IS NOT NULL""")
def drop_all_missing(spark, sf_dir):
    return tidy.drop_rows_without(pivot_sensors(spark, sf_dir), ("user_id", "day", "view", "signup"))


@query("""SELECT event_id, ts, round(value, 4) AS value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-05 23:59:59'""")
def range_filter(spark, sf_dir):
    return rounded(tidy.range_filter(read(spark, sf_dir, "events"), "ts", "2024-01-05 00:00:00", "2024-01-05 23:59:59").select("event_id", "ts", "value"), "value")


_WANTED = "SELECT user_id, event_type FROM (SELECT c_custkey AS user_id FROM customer), (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error']) AS event_type)"


def _sensor_split(spark, sf_dir):
    data = events(spark, sf_dir)
    wanted = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).withColumn("event_type", F.explode(F.array(*map(F.lit, CODES))))
    return sensors.split_available(wanted, data.select("user_id", "event_type").distinct(), ["user_id", "event_type"])


@query(f"""SELECT w.* FROM ({_WANTED}) w SEMI JOIN events e USING (user_id, event_type)""")
def available_sensors(spark, sf_dir):
    return _sensor_split(spark, sf_dir)[0]


@query(f"""SELECT w.* FROM ({_WANTED}) w ANTI JOIN events e USING (user_id, event_type)""")
def missing_sensors(spark, sf_dir):
    return _sensor_split(spark, sf_dir)[1]


@query("""SELECT user_id AS station_id, list_sort(list(DISTINCT event_type)) AS codes FROM events GROUP BY 1""")
def sensor_catalogue(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("user_id").alias("station_id")).agg(F.array_sort(F.collect_set("event_type")).alias("codes"))


@query("""SELECT CAST(sum(CASE WHEN ts IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_times, CAST(sum(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_ids, count(*) AS n FROM events""")
def observation_check(spark, sf_dir):
    data = events(spark, sf_dir).select("datetime", F.col("user_id").cast("string").alias("station_id"), F.col("value").alias("tair_2m"))
    own = validate.validate_observations(data)
    return own.agg(F.count_if(F.col("datetime").isNull()).alias("null_times"), F.count_if(F.col("station_id").isNull()).alias("null_ids"), F.count("*").alias("n"))


# Collections of stations (M1-M9)


def customers(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 180).cast("double").alias("x"), (F.col("c_custkey") % 97).cast("double").alias("y"), F.col("c_acctbal").alias("elevation"), F.lit(4326).alias("crs"))


def collection(spark, sf_dir) -> stations.MeteoData:
    return stations.MeteoData(customers(spark, sf_dir), events(spark, sf_dir).select(F.col("user_id").cast("string").alias("station_id"), "datetime", F.col("value").alias("tair_2m")))


@query("""SELECT CAST(user_id AS VARCHAR) AS station_id, ts AS datetime, round(value, 4) AS tair_2m, c_acctbal AS elevation, CAST(c_custkey % 180 AS DOUBLE) AS x, CAST(c_custkey % 97 AS DOUBLE) AS y FROM events JOIN customer ON user_id = c_custkey""")
def flatten_stations(spark, sf_dir):
    return rounded(collection(spark, sf_dir).flat(coordinates=True), "tair_2m")


@query("""SELECT CAST(user_id AS VARCHAR) AS station_id, ts AS datetime, round(value, 4) AS tair_2m FROM events WHERE user_id = 42""")
def point_lookup(spark, sf_dir):
    return rounded(collection(spark, sf_dir).station("42"), "tair_2m")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey % 180 AS DOUBLE) AS x, CAST(c_custkey % 97 AS DOUBLE) AS y FROM customer""")
def points_layer(spark, sf_dir):
    return collection(spark, sf_dir).points()


@query("""WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey % 400 - 100 AS DOUBLE) AS x, CAST(c_custkey % 97 AS DOUBLE) AS y FROM customer)
    SELECT id, x, y, CASE WHEN y NOT BETWEEN -90 AND 90 THEN 'latitude' WHEN x NOT BETWEEN -180 AND 180 THEN 'longitude' WHEN n > 1 THEN 'coordinates twice' END AS reason
    FROM (SELECT *, count(*) OVER (PARTITION BY x, y) AS n FROM s) WHERE y > 90 OR x > 180 OR n > 1""")
def station_violations(spark, sf_dir):
    return validate.station_violations(customers(spark, sf_dir).withColumn("x", (F.col("id").cast("long") % 400 - 100).cast("double")))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal AS elevation, CAST(NULL AS VARCHAR) AS name FROM customer UNION ALL SELECT 's' || s_suppkey, s_acctbal, s_name FROM supplier""")
def union_all(spark, sf_dir):
    other = read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_acctbal").alias("elevation"), F.col("s_name").alias("name"))
    return stations.union_all([customers(spark, sf_dir).select("id", "elevation"), None, other])


@query("""SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END, s_acctbal) AS elevation FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def fill_elevation(spark, sf_dir):
    from isohyet.sources.province import fill_elevation as fill

    gaps = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("elevation"))
    return fill(gaps, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("elevation")))


@query("""SELECT count(*) AS n_stations, count(CASE WHEN c_custkey % 180 BETWEEN 10 AND 60 AND c_custkey % 97 BETWEEN 20 AND 50 THEN 1 END) AS n_inside FROM customer WHERE c_custkey IN (SELECT user_id FROM events)""")
def station_guards(spark, sf_dir):
    data = collection(spark, sf_dir)
    there = data.stations.join(data.observations.select(F.col("station_id").alias("id")).distinct(), "id", "left_semi")
    inside = AOI(10, 20, 60, 50).filter_points(there, 4326).select("id", F.lit(1).alias("i"))
    counts = there.join(inside, "id", "left").agg(F.count("*").alias("n_stations"), F.count("i").alias("n_inside"))
    first = counts.first()
    validate.require_enough(first["n_stations"], first["n_inside"])
    return counts


def daily_samples(spark, sf_dir) -> DataFrame:
    """One sample per event type, day and user: the mean of its values, on the user's elevation."""
    data = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("station_id"), "datetime", "event_type", "value")
    daily = Resampler({"value": "mean"}).apply(data, "D", groupby_cols=["station_id", "event_type"], sort=False)
    flat = daily.join(customers(spark, sf_dir).select(F.col("id").alias("station_id"), "elevation"), "station_id")
    return flat.select(F.col("event_type").alias("param"), F.col("datetime").alias("interp_date"), "station_id", "elevation", F.col("value").alias("y"))


_SAMPLES = """s AS (SELECT event_type AS param, date_trunc('day', ts)::TIMESTAMP AS interp_date, c_custkey, c_acctbal AS elevation, avg(value) AS y FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL)"""


@query("""WITH d AS (SELECT CAST(user_id AS VARCHAR) AS station_id, date_trunc('day', ts)::TIMESTAMP AS interp_date, avg(value) AS tair_2m, max(value) AS tair_2m_max FROM events GROUP BY ALL)
    SELECT 'tair_2m' AS param, interp_date, station_id, c_acctbal AS elevation, round(tair_2m, 4) AS y FROM d JOIN customer ON station_id = CAST(c_custkey AS VARCHAR) WHERE interp_date >= '2024-01-03' AND interp_date < '2024-01-11'
    UNION ALL SELECT 'tair_2m_max', interp_date, station_id, c_acctbal, round(tair_2m_max, 4) FROM d JOIN customer ON station_id = CAST(c_custkey AS VARCHAR) WHERE interp_date >= '2024-01-03' AND interp_date < '2024-01-11'""")
def sample_spine(spark, sf_dir):
    daily = collection(spark, sf_dir).resampled("D", resampler=Resampler({"tair_2m": ["mean", "max"]}))
    return rounded(daily.samples(["tair_2m", "tair_2m_max", "absent"], "2024-01-03 07:00:00", "2024-01-11"), "y")


# The model (I1-I10)


def _rounded_fits(fits):
    return rounded(fits, "slope", digits=8).withColumn("intercept", F.round("intercept", 4))


@query(f"""WITH {_SAMPLES} SELECT param, interp_date, count(*) AS n, round(CASE WHEN var_pop(elevation) = 0 THEN 0.0 ELSE regr_slope(y, elevation) END, 8) AS slope,
    round(avg(y) - CASE WHEN var_pop(elevation) = 0 THEN 0.0 ELSE regr_slope(y, elevation) END * avg(elevation), 4) AS intercept FROM s GROUP BY ALL""")
def vertical_fit(spark, sf_dir):
    return _rounded_fits(model.VerticalModel().fit(daily_samples(spark, sf_dir)))


@query(f"""WITH {_SAMPLES} SELECT param, interp_date, count(*) AS n, round(sum(elevation * y) / sum(elevation * elevation), 8) AS slope, 0.0::DOUBLE AS intercept FROM s GROUP BY ALL""")
def vertical_fit_no_intercept(spark, sf_dir):
    return _rounded_fits(model.VerticalModel(fit_intercept=False).fit(daily_samples(spark, sf_dir)))


@query(f"""WITH {_SAMPLES}, f AS (SELECT param, interp_date, count(*) AS n, greatest(CASE WHEN var_pop(elevation) = 0 THEN 0.0 ELSE regr_slope(y, elevation) END, 0.0) AS b, avg(y) AS my, avg(elevation) AS mx FROM s GROUP BY ALL)
    SELECT param, interp_date, n, round(b, 8) AS slope, round(my - b * mx, 4) AS intercept FROM f""")
def vertical_fit_positive(spark, sf_dir):
    return _rounded_fits(model.VerticalModel(positive=True).fit(daily_samples(spark, sf_dir)))


@query("""SELECT event_type AS param, count(*) AS n, 0.0::DOUBLE AS slope, round(avg(value), 4) AS intercept FROM events GROUP BY 1""")
def vertical_fit_degenerate(spark, sf_dir):
    data = events(spark, sf_dir).select(F.col("event_type").alias("param"), F.lit(500.0).alias("elevation"), F.col("value").alias("y"))
    return _rounded_fits(model.VerticalModel().fit(data, keys=("param",)))


_FITS = f"""{_SAMPLES}, f AS (SELECT param, interp_date, regr_slope(y, elevation) AS b, avg(y) - regr_slope(y, elevation) * avg(elevation) AS a FROM s GROUP BY ALL)"""


@query(f"""WITH {_FITS} SELECT param, interp_date, CAST(s_suppkey // 10 AS INTEGER) AS y_idx, CAST(s_suppkey % 10 AS INTEGER) AS x_idx, round(a + b * s_acctbal, 3) AS value FROM supplier, f""")
def vertical_predict(spark, sf_dir):
    cells = read(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 10).cast("int").alias("y_idx"), (F.col("s_suppkey") % 10).cast("int").alias("x_idx"), F.col("s_acctbal").alias("value"))
    field, _ = model.interpolate(daily_samples(spark, sf_dir), cells)
    return rounded(field, "value", digits=3)


@query(f"""WITH {_SAMPLES}, g AS (SELECT *, count(*) OVER w - 1 AS m, sum(elevation) OVER w - elevation AS sx, sum(y) OVER w - y AS sy, sum(elevation * elevation) OVER w - elevation * elevation AS sxx,
    sum(elevation * y) OVER w - elevation * y AS sxy FROM s WINDOW w AS (PARTITION BY param, interp_date)), e AS (SELECT param, interp_date, sy / m + (sxy - sx * sy / m) / (sxx - sx * sx / m) * (elevation - sx / m) - y AS e FROM g WHERE m > 1)
    SELECT param, interp_date, count(*) AS n, round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse FROM e GROUP BY ALL""")
def cross_validation(spark, sf_dir):
    own = daily_samples(spark, sf_dir)
    enough = own.groupBy("param", "interp_date").count().filter("count > 2").select("param", "interp_date")
    scores = model.LeaveOneOut().scores(own.join(enough, ["param", "interp_date"], "left_semi"))
    return rounded(scores.select("param", "interp_date", "n", "mae", "rmse"), "mae", "rmse", digits=3)


@query(f"""WITH {_SAMPLES}, t AS (SELECT *, CAST(c_custkey % 180 AS DOUBLE) AS sx, CAST(c_custkey % 97 AS DOUBLE) AS sy FROM s),
    f AS (SELECT param, interp_date, regr_slope(y, elevation) AS b, avg(y) - regr_slope(y, elevation) * avg(elevation) AS a FROM t GROUP BY ALL),
    r AS (SELECT param, interp_date, sx, sy, y - a - b * elevation AS r FROM t JOIN f USING (param, interp_date)),
    c AS (SELECT CAST(s_suppkey // 10 AS INTEGER) AS y_idx, CAST(s_suppkey % 10 AS INTEGER) AS x_idx, s_acctbal AS e, s_suppkey % 10 + 0.5 AS x, s_suppkey // 10 + 0.25 AS y FROM supplier),
    w AS (SELECT param, interp_date, y_idx, x_idx, sum(r / ((sx - x) ** 2 + (sy - y) ** 2)) / sum(1 / ((sx - x) ** 2 + (sy - y) ** 2)) AS moved FROM r, c GROUP BY ALL)
    SELECT param, interp_date, y_idx, x_idx, round(a + b * e + moved, 3) AS value FROM w JOIN f USING (param, interp_date) JOIN c USING (y_idx, x_idx)""")
def residual_correction(spark, sf_dir):
    own = daily_samples(spark, sf_dir)
    own = own.withColumn("station_x", (F.col("station_id").cast("long") % 180).cast("double")).withColumn("station_y", (F.col("station_id").cast("long") % 97).cast("double"))
    cells = read(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 10).cast("int").alias("y_idx"), (F.col("s_suppkey") % 10).cast("int").alias("x_idx"), F.col("s_acctbal").alias("value"))
    cells = cells.withColumn("x", F.col("x_idx") + 0.5).withColumn("y", F.col("y_idx") + 0.25)
    field, _ = model.interpolate(own, cells, residual_model=model.InverseDistance())
    return rounded(field, "value", digits=3)


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN round(value, 4) END AS v FROM events)
    SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS v FROM e""")
def gap_filling(spark, sf_dir):
    data = events(spark, sf_dir).select("event_id", "user_id", F.struct("datetime", "event_id").alias("at"), F.when(F.col("event_id") % 3 == 0, F.round("value", 4)).alias("v"))
    return model.fill_gaps(data, "v", "at", ("user_id",)).drop("at")


# Space (A1-A5, G1-G8, V1)


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part WHERE p_size BETWEEN 10 AND 30 AND p_retailprice BETWEEN 950.0 AND 1500.0""")
def aoi_points(spark, sf_dir):
    points = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return AOI(10, 950, 30, 1500, 3857).filter_points(points, 3857)


_RASTER = "g AS (SELECT CAST(vec_id AS INTEGER) AS y_idx, CAST(unnest(range(len(embedding))) AS INTEGER) AS x_idx, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


@query(f"""WITH {_RASTER} SELECT y_idx, x_idx, round(47.0::DOUBLE + y_idx * (-0.01::DOUBLE), 6) AS y, round(10.0::DOUBLE + x_idx * 0.01::DOUBLE, 6) AS x, value FROM g""")
def grid_explode(spark, sf_dir):
    return rounded(raster(spark, sf_dir), "y", "x", digits=6)


@query(f"""WITH {_RASTER} SELECT y_idx, x_idx, value FROM g WHERE 10.0 + x_idx * 0.01 BETWEEN 10.097 - 0.005 AND 10.143 + 0.005 AND 47.0 - y_idx * 0.01 BETWEEN 46.797 - 0.005 AND 46.893 + 0.005""")
def aoi_grid(spark, sf_dir):
    meta = raster_meta(spark, sf_dir)
    return AOI(10.097, 46.797, 10.143, 46.893).filter(raster(spark, sf_dir, meta), meta)[0].select("y_idx", "x_idx", "value")


def _regridded(spark, sf_dir, target: Callable[[GridMeta], GridMeta], method, **options) -> DataFrame:
    """The whole raster on a target grid made from its own."""
    meta = raster_meta(spark, sf_dir)
    return grid.regrid(raster(spark, sf_dir, meta), meta, target(meta), method, **options).drop("y", "x")


def _target_sql(x0: float, step: float, columns: str, rows: str) -> str:
    """Target cells with their places in source indices."""
    return f"t AS (SELECT i AS y_idx, j AS x_idx, {x0} + i * {step} AS fy, {x0} + j * {step} AS fx FROM (SELECT unnest(range({rows})) AS i), (SELECT unnest(range({columns})) AS j))"


def _kernel_sql(weight: str, reach: int, by: int = 1) -> str:
    """Weights of the source cells around each target cell, by a formula of the distance d."""
    own = lambda d: f"({weight.format(d=f'({d} / {by}.0)')})"
    far = reach * by
    return f"""n AS (SELECT y_idx, x_idx, floor(fy) + dy AS sy, floor(fx) + dx AS sx, abs(fy - floor(fy) - dy) AS ey, abs(fx - floor(fx) - dx) AS ex FROM t, range({1 - far}, {far + 1}) c(dy), range({1 - far}, {far + 1}) d(dx)),
    w AS (SELECT n.y_idx, n.x_idx, {own("ey")} * {own("ex")} AS w, g.value FROM n JOIN g ON g.y_idx = sy AND g.x_idx = sx)
    SELECT CAST(y_idx AS INTEGER) AS y_idx, CAST(x_idx AS INTEGER) AS x_idx, round(sum(w * value) / sum(w), 6) AS value FROM w WHERE w <> 0 GROUP BY ALL"""


_HALVES = _target_sql(0.25, 0.5, "127", f"2 * {ROWS} - 1")
_LINEAR = "greatest(0, 1 - {d})"
_CUBIC = "CASE WHEN {d} < 1 THEN (1.5 * {d} - 2.5) * {d} * {d} + 1 WHEN {d} < 2 THEN ((-0.5 * {d} + 2.5) * {d} - 4) * {d} + 2 ELSE 0 END"
_SPLINE = "CASE WHEN {d} < 1 THEN 2.0 / 3 - {d} * {d} * (1 - {d} / 2) WHEN {d} < 2 THEN (2 - {d}) ** 3 / 6 ELSE 0 END"
_LANCZOS = "CASE WHEN {d} = 0 THEN 1 WHEN {d} < 3 THEN 3 * sin(pi() * {d}) * sin(pi() * {d} / 3) / (pi() * {d}) ** 2 ELSE 0 END"


def _halved(meta: GridMeta) -> GridMeta:
    return GridMeta(10.0025, 46.9975, 0.005, -0.005, 127, 2 * meta.ny - 1, 4326)


def _quartered(meta: GridMeta) -> GridMeta:
    return GridMeta(10.015, 46.985, 0.04, -0.04, 16, -(-meta.ny // 4), 4326)


@query(f"WITH {_RASTER}, {_HALVES}, {_kernel_sql(_LINEAR, 1)}")
def grid_bilinear(spark, sf_dir):
    return rounded(_regridded(spark, sf_dir, _halved, "bilinear"), "value", digits=6)


@query(f"WITH {_RASTER}, {_HALVES}, {_kernel_sql(_CUBIC, 2)}")
def grid_cubic(spark, sf_dir):
    return rounded(_regridded(spark, sf_dir, _halved, "cubic"), "value", digits=6)


@query(f"WITH {_RASTER}, {_HALVES}, {_kernel_sql(_SPLINE, 2)}")
def grid_cubic_spline(spark, sf_dir):
    return rounded(_regridded(spark, sf_dir, _halved, "cubic_spline"), "value", digits=6)


@query(f"WITH {_RASTER}, {_HALVES}, {_kernel_sql(_LANCZOS, 3)}")
def grid_lanczos(spark, sf_dir):
    return rounded(_regridded(spark, sf_dir, _halved, "lanczos"), "value", digits=6)


@query(f"WITH {_RASTER}, {_target_sql(0.75, 2, '32', f'{ROWS} // 2')}, {_kernel_sql(_LINEAR, 1, 2)}")
def grid_bilinear_coarser(spark, sf_dir):
    return rounded(_regridded(spark, sf_dir, lambda m: GridMeta(10.0075, 46.9925, 0.02, -0.02, 32, m.ny // 2, 4326), "bilinear", widen=True), "value", digits=6)


@query(f"""WITH {_RASTER}, {_target_sql(0.33, 0.4, "157", f"CAST(floor(2.5 * {ROWS}) AS BIGINT) - 3")}
    SELECT CAST(t.y_idx AS INTEGER) AS y_idx, CAST(t.x_idx AS INTEGER) AS x_idx, round(value, 6) AS value FROM t JOIN g ON g.y_idx = CAST(floor(fy + 0.5) AS INTEGER) AND g.x_idx = CAST(floor(fx + 0.5) AS INTEGER)""")
def grid_nearest(spark, sf_dir):
    return rounded(_regridded(spark, sf_dir, lambda m: GridMeta(10.0033, 46.9967, 0.004, -0.004, 157, int(2.5 * m.ny) - 3, 4326), "nearest"), "value", digits=6)


_BLOCK_SQL = {"average": "avg(value)", "min": "min(value)", "max": "max(value)", "sum": "sum(value)", "rms": "sqrt(avg(value * value))", "med": "median(value)", "q1": "quantile_cont(value, 0.25)", "q3": "quantile_cont(value, 0.75)"}
_BLOCK = "CAST(g.y_idx // 4 AS INTEGER) AS y_idx, CAST(g.x_idx // 4 AS INTEGER) AS x_idx"


@query(f"""WITH {_RASTER} SELECT {_BLOCK}, {", ".join(f'round({e}, 5) AS "{k}"' for k, e in _BLOCK_SQL.items())} FROM g GROUP BY 1, 2""")
def grid_footprints(spark, sf_dir):
    return rounded(_regridded(spark, sf_dir, _quartered, list(_BLOCK_SQL)), *_BLOCK_SQL, digits=5)


@query(f"""WITH {_RASTER} SELECT {_BLOCK}, round(avg(value), 6) AS value FROM g GROUP BY 1, 2""")
def grid_average(spark, sf_dir):
    return rounded(_regridded(spark, sf_dir, _quartered, "average"), "value", digits=6)


@query(f"""WITH {_RASTER}, c AS (SELECT {_BLOCK}, floor(value * 4) / 4 AS value, count(*) AS n FROM g GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY y_idx, x_idx ORDER BY n DESC, value) AS k FROM c) SELECT y_idx, x_idx, value FROM r WHERE k = 1""")
def grid_mode(spark, sf_dir):
    meta = raster_meta(spark, sf_dir)
    steps = raster(spark, sf_dir, meta).withColumn("value", F.floor(F.col("value") * 4) / 4)
    return grid.regrid(steps, meta, _quartered(meta), "mode").select("y_idx", "x_idx", "value")


@query(f"""WITH {_RASTER}, p AS (SELECT value, 6378137.0 * radians(10.0 + x_idx * 0.01) AS mx, 6378137.0 * ln(tan(pi() / 4 + radians(47.0 - y_idx * 0.01) / 2)) AS my FROM g)
    SELECT CAST(floor((5944500.0 - my) / 5000 + 0.5) AS INTEGER) AS y_idx, CAST(floor((mx - 1115500.0) / 5000 + 0.5) AS INTEGER) AS x_idx, round(avg(value), 5) AS value FROM p GROUP BY 1, 2""")
def grid_reproject(spark, sf_dir):
    def target(meta: GridMeta) -> GridMeta:
        # Rows beyond the pole have no place, so the grid ends before it.
        _, lowest = proj.transform(10.0, min(y for y in meta.ys() if y > -90), 4326, 3857)
        return GridMeta(1115500.0, 5944500.0, 5000.0, -5000.0, 15, int((5944500.0 - lowest) / 5000 + 0.5) + 1, 3857)

    return rounded(_regridded(spark, sf_dir, target, "average"), "value", digits=5)


@query(f"""WITH {_RASTER}, h AS (SELECT * FROM g WHERE (y_idx * 64 + x_idx) % 97 <> 0) SELECT y_idx, x_idx FROM g WHERE (y_idx, x_idx) NOT IN (SELECT (y_idx, x_idx) FROM h)""")
def grid_missing(spark, sf_dir):
    meta = raster_meta(spark, sf_dir)
    return grid.missing_cells(raster(spark, sf_dir, meta).filter("(y_idx * 64 + x_idx) % 97 <> 0"), meta)


@query(f"""WITH {_RASTER} SELECT y_idx, x_idx FROM g WHERE y_idx % 50 = 7 AND x_idx < 3""")
def grid_validate(spark, sf_dir):
    own, meta = raster(spark, sf_dir), raster_meta(spark, sf_dir)
    GridValidator.from_grid(meta).validate(raster_meta(spark, sf_dir))
    moved = own.withColumn("x", F.when((F.col("y_idx") % 50 == 7) & (F.col("x_idx") < 3), F.col("x") + 1e-6).otherwise(F.col("x")))
    return grid.grid_differences(own, moved).select("y_idx", "x_idx")


# The cube (K3-K11)


@query(f"""WITH {_RASTER} SELECT 'tas' AS var, (TIMESTAMP '2025-01-01' + to_days(y_idx % 5))::TIMESTAMP AS time, y_idx, x_idx,
    CASE WHEN y_idx % 5 = 2 AND x_idx < 32 THEN round(value + 100, 5) ELSE round(value, 5) END AS value FROM g""")
def cube_upsert(spark, sf_dir):
    cells = raster(spark, sf_dir).select(F.lit("tas").alias("var"), F.expr("timestamp_ntz'2025-01-01' + make_interval(0, 0, 0, y_idx % 5)").alias("time"), "y_idx", "x_idx", "value")
    new = cells.filter("y_idx % 5 = 2 AND x_idx < 32").withColumn("value", F.col("value") + 100)
    return rounded(upsert(cells, new), "value", digits=5)


@query(f"""WITH {_RASTER} SELECT y_idx, x_idx, CASE WHEN x_idx % 7 = 0 THEN NULL ELSE round(CAST(round_even(value / 0.1, 0) AS SMALLINT) * 0.1::DOUBLE, 6) END AS value FROM g""")
def cube_encode_roundtrip(spark, sf_dir):
    own = Encoding("int16", 0.1, -9999)
    cells = raster(spark, sf_dir).select("y_idx", "x_idx", F.when(F.col("x_idx") % 7 != 0, F.col("value")).alias("value"))
    return rounded(cells.withColumn("value", own.encode(F.col("value"))).withColumn("value", own.decode(F.col("value"))), "value", digits=6)


@query("""SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS time FROM events WHERE date_trunc('day', ts) NOT BETWEEN TIMESTAMP '2024-01-04' AND TIMESTAMP '2024-01-20' OR dayofyear(ts) % 2 = 1""")
def cube_time_check(spark, sf_dir):
    axis = Manifest("2024-01-04", "2024-01-20", "2D", ("tas",), raster_meta(spark, sf_dir)).axis(spark)
    data = events(spark, sf_dir).select("event_id", F.date_trunc("day", "datetime").cast("timestamp_ntz").alias("time"))
    return unknown_times(data, axis).select("event_id", "time")


@query("""SELECT a::TIMESTAMP AS chunk_start, least(a + INTERVAL 7 DAYS - INTERVAL 10 MINUTES, TIMESTAMP '2024-01-30 23:50:00')::TIMESTAMP AS chunk_end
    FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:50:00', INTERVAL 7 DAYS)) AS a)""")
def date_chunks(spark, sf_dir):
    return chunk_table(spark, "2024-01-01 00:00:00", "2024-01-30 23:50:00", "10min", 7)


@query(f"""WITH {_FITS}, t AS (SELECT param, interp_date, CAST(s_suppkey // 10 AS INTEGER) AS y_idx, CAST(s_suppkey % 10 AS INTEGER) AS x_idx, a + b * s_acctbal AS v FROM supplier, f)
    SELECT param || '_' || strftime(interp_date, '%Y_%m_%d_%H%M%S') || '.tif' AS name, count(*) AS cells FROM t GROUP BY 1""")
def tiff_export(spark, sf_dir):
    from isohyet.sinks.tiff import tiff_files

    field = vertical_predict(spark, sf_dir).select(F.col("param").alias("var"), F.col("interp_date").alias("time"), "y_idx", "x_idx", "value")
    rows = read(spark, sf_dir, "supplier").agg(F.floor(F.max("s_suppkey") / 10) + 1).first()[0]
    return tiff_files(field, GridMeta(10.0, 47.0, 0.01, -0.01, 10, int(rows), 4326)).select("name", "cells")


from isohyet.plans import service_queries  # noqa: E402, F401  (it adds the queries of sources, sinks and configuration)
