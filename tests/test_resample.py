import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isohyet.functions.frequency import Frequency
from isohyet.operators.resample import Resampler, apply_resampling, resample_stations


@pytest.fixture(scope="module")
def hourly(spark):
    """Forty-eight hours of one station."""
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({
        "station_id": "s1", "model": "m1", "datetime": pd.date_range("2025-01-01", periods=48, freq="h"),
        "tair_2m": np.linspace(0, 20, 48), "weather_code": [0, 1, 2, 2] * 12, "wind_speed": rng.uniform(0, 10, 48),
    })
    return frame, spark.createDataFrame(frame).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


def test_daily_with_default_plan(hourly):
    frame, data = hourly
    out = apply_resampling(data, "1D", groupby_cols=["station_id", "model"], min_sample_size=10).toPandas()
    own = frame.groupby([pd.Grouper(key="datetime", freq="D"), "station_id", "model"])
    assert list(out.columns) == ["station_id", "model", "datetime", "tair_2m", "tair_2m_min", "tair_2m_max", "weather_code", "wind_speed"]
    assert np.allclose(out["tair_2m"], own["tair_2m"].mean())
    assert np.allclose(out["tair_2m_max"], own["tair_2m"].max())
    assert np.allclose(out["wind_speed"], own["wind_speed"].mean())


@pytest.mark.parametrize("freq", ["D", "6h", "10min", "7h", "3D", "W", "ME", "MS", "QS", "2MS", "YS", "QE"])
def test_bins_and_empty_bins_like_pandas(spark, freq):
    rng = np.random.default_rng(1)
    days = 700 if freq in ("QS", "2MS", "YS", "QE", "ME", "MS", "W") else 9
    step = 86400 * days // 60
    times = pd.Timestamp("2024-01-31 05:17") + pd.to_timedelta(np.sort(rng.integers(0, step, 60)) * 60, unit="s")
    times = times[[i for i, t in enumerate(times) if not (t.day in (3, 4))]]
    frame = pd.DataFrame({"datetime": times, "v": rng.normal(size=len(times))})
    data = spark.createDataFrame(frame).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    out = Resampler({"v": ["sum", "mean", "max"]}).apply(data, freq).toPandas()
    own = frame.groupby(pd.Grouper(key="datetime", freq=freq))["v"].agg(["sum", "mean", "max"])
    assert list(out["datetime"]) == list(own.index)
    assert np.allclose(out[["v_sum", "v_mean", "v_max"]].astype(float), own, equal_nan=True)


def test_missing_values(spark):
    data = spark.sql("""SELECT timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS datetime, 'a' AS k,
        CASE WHEN id = 0 THEN double('NaN') WHEN id = 1 THEN 5.0D WHEN id = 2 THEN NULL ELSE 7.0D END AS v, CAST(NULL AS DOUBLE) AS w FROM range(4)""").withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    r = Resampler({"v": ["first", "last", "mean", "sum", "median"], "w": ["sum", "mean"]}).apply(data, "D", groupby_cols=["k"]).first()
    assert (r.v_first, r.v_last, r.v_mean, r.v_sum, r.v_median) == (5.0, 7.0, 6.0, 12.0, 6.0)
    assert r.w_sum == 0.0 and r.w_mean is None
    masked = Resampler({"v": "sum", "w": "sum"}).apply(data, "D", groupby_cols=["k"], min_sample_size=2).first()
    assert masked.v == 12.0 and masked.w is None
    assert Resampler({"v": "sum", "w": "sum"}).apply(data, "D", groupby_cols=["k"], min_sample_size=3).first().v is None


def test_stations_have_their_own_origin(spark):
    frame = pd.DataFrame({"station_id": ["a"] * 3 + ["b"] * 3, "datetime": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-04"] + ["2024-01-02", "2024-01-03", "2024-01-05"]), "v": [1.0, 2, 3, 4, 5, 6]})
    data = spark.createDataFrame(frame).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    out = resample_stations(data, "3D", colmap={"v": "sum"}).toPandas().sort_values(["station_id", "datetime"])
    for name, own in frame.groupby("station_id"):
        assert list(out[out.station_id == name].v) == list(own.set_index("datetime").v.resample("3D").sum())


def test_guards(hourly):
    _, data = hourly
    with pytest.raises(ValueError, match="min_sample_size"):
        apply_resampling(data, "D", min_sample_size=0)
    with pytest.raises(ValueError, match="not found"):
        apply_resampling(data, "D", datetime_col="when")
    with pytest.raises(ValueError, match="unknown aggregate"):
        Resampler({"v": "mode"})
    with pytest.raises(ValueError, match="frequency"):
        Frequency.parse("fortnight")
    with pytest.raises(ValueError, match="string"):
        apply_resampling(data, "D")
    assert apply_resampling(data.limit(0).select("datetime", "tair_2m"), "D").count() == 0


def test_functions_as_aggregates(hourly):
    frame, data = hourly

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    def weighted(c, t):
        return F.max_by(c, t) - F.min_by(c, t)

    own = data.select("datetime", "station_id", "tair_2m")
    want = frame.groupby(frame.datetime.dt.date)["tair_2m"].agg(lambda v: v.max() - v.min())
    for f in (spread, weighted):
        out = Resampler({"tair_2m": f}).apply(own, "D", groupby_cols=["station_id"]).toPandas()
        assert np.allclose(out["tair_2m"], want)
    assert Resampler({"tair_2m": [weighted, lambda c: F.avg(c)]}).apply(own, "D", groupby_cols=["station_id"]).columns[2:] == ["tair_2m_weighted", "tair_2m_custom"]


def test_text_times_and_keys_only(spark):
    data = spark.createDataFrame([("2024-01-01 03:00:00", 1.0), ("no time", 2.0), (None, 3.0), ("2024-01-01T05:00:00", 5.0)], "datetime string, v double")
    out = Resampler({"v": "sum"}).apply(data, "D").collect()
    assert [r.v for r in out] == [6.0]
    assert Resampler({}, None).apply(data, "D").count() == 2
