import pandas as pd
from pyspark.sql import functions as F

from isohyet.functions import zones
from isohyet.operators.tidy import parse_local, tidy_province


def test_both_hours_of_the_clock_change_like_pandas(spark):
    walls = [*pd.date_range("2025-03-30 00:30", "2025-03-30 04:30", freq="7min"), *pd.date_range("2025-10-26 00:30", "2025-10-26 04:30", freq="7min"), *pd.date_range("2025-07-01", periods=20, freq="5h"), *pd.date_range("2025-01-01", periods=20, freq="5h")]
    rows = [(w.strftime("%Y-%m-%dT%H:%M:%S") + label, label) for w in walls for label in ("CET", "CEST")]
    got = spark.createDataFrame(rows, "t string, label string").select("t", parse_local(F.col("t"), "Europe/Rome").alias("u")).toPandas()
    for text, utc in zip(got.t, got.u):
        wall = pd.Timestamp(text.removesuffix("CEST").removesuffix("CET"))
        want = wall.tz_localize("Europe/Rome", ambiguous=text.endswith("CEST"), nonexistent="shift_forward").tz_convert("UTC").tz_localize(None)
        assert utc == want, text


def test_unreadable_times_are_null(spark):
    assert spark.createDataFrame([("soon",), (None,), ("2025-13-01T00:00:00CET",)], "t string").select(parse_local(F.col("t"), "Europe/Rome").alias("u")).filter("u is not null").count() == 0


def test_floor(spark):
    r = spark.sql("SELECT timestamp_ntz'2025-10-26 02:19:59.5' AS t").select(zones.floor_seconds(F.col("t"), 600, "timestamp_ntz").alias("t")).first()
    assert r.t == pd.Timestamp("2025-10-26 02:10:00")


def test_tidy(spark):
    raw = [
        ("2025-01-01T00:07:00CET", 1.0, "LT", "s", 0), ("2025-01-01T00:07:00CET", 9.0, "LT", "s", 1), ("2025-01-01T00:07:00CET", 0.2, "N", "s", 2),
        ("2025-01-01T00:12:00CET", 0.3, "N", "s", 3), ("bad", 3.0, "LT", "s", 4), ("2025-01-01T00:20:00CET", 7.0, "XX", "s", 5), ("2025-01-01T00:30:00CET", 4.0, "WG.BOE", "t", 6),
    ]
    data = spark.createDataFrame(raw, "DATE string, VALUE double, sensor string, station_id string, _seq long")
    out = tidy_province(data, "Europe/Rome", codes=["LT", "N", "WG.BOE"]).orderBy("station_id").collect()
    assert [(r.station_id, str(r.datetime), r.tair_2m, r.precipitation, r.wind_gust) for r in out] == [("s", "2025-01-01 00:00:00", 1.0, 0.2, None), ("t", "2025-01-01 00:30:00", None, None, 4.0)]
    only_rain = tidy_province(data, codes=["N"])
    assert only_rain.count() == 2
    assert tidy_province(data, codes=["N"], strict_compat=True).count() == 0
