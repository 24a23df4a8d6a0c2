import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isohyet.operators import model, stations, validate
from isohyet.operators.sensors import PROVINCE, Vocabulary, normalize_codes
from isohyet.operators.stations import MeteoData


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"param": rng.choice(["a", "b"], 60), "interp_date": pd.Timestamp("2025-01-01") + pd.to_timedelta(rng.integers(0, 3, 60), unit="D"), "elevation": rng.uniform(0, 3000, 60), "y": rng.normal(10, 5, 60)})
    frame.loc[len(frame)] = ["one", pd.Timestamp("2025-01-01"), 500.0, 3.0]
    for v in (1.0, 2.0, 6.0):
        frame.loc[len(frame)] = ["flat", pd.Timestamp("2025-01-01"), 500.0, v]
    return frame, spark.createDataFrame(frame).withColumn("interp_date", F.col("interp_date").cast("timestamp_ntz"))


@pytest.mark.parametrize("options", [{}, {"fit_intercept": False}, {"positive": True}])
def test_fit_like_least_squares(samples, options):
    frame, data = samples
    fits = {(r.param, r.interp_date): r for r in model.VerticalModel(**options).fit(data).collect()}
    assert len(fits) == frame.groupby(["param", "interp_date"]).ngroups
    for key, own in frame.groupby(["param", "interp_date"]):
        x, y = own.elevation.to_numpy(), own.y.to_numpy()
        shift = (x.mean(), y.mean()) if options.get("fit_intercept", True) else (0.0, 0.0)
        slope = np.linalg.lstsq((x - shift[0])[:, None], y - shift[1], rcond=None)[0][0]
        slope = max(slope, 0.0) if options.get("positive") else slope
        got = fits[key[0], key[1].to_pydatetime()]
        assert got.n == len(own) and got.slope == pytest.approx(slope, abs=1e-9)
        assert got.intercept == pytest.approx(shift[1] - slope * shift[0], abs=1e-6)


def test_missing_elevation(samples):
    _, data = samples
    holes = data.withColumn("elevation", F.when(F.col("elevation") > 300, F.col("elevation")))
    with pytest.raises(Exception, match="no elevation"):
        model.VerticalModel().fit(holes).collect()
    assert model.VerticalModel().fit(holes, skip_missing=True).count() > 0


def test_predict_both_ways(samples, spark, monkeypatch):
    _, data = samples
    cells = spark.range(20).selectExpr("int(id div 5) AS y_idx", "int(id % 5) AS x_idx", "id * 100.0 AS value")
    field, scores = model.interpolate(data, cells)
    assert scores is None
    first = {tuple(r)[:4]: r.value for r in field.collect()}
    monkeypatch.setattr(model, "MOST_BROADCAST_FITS", 0)
    second = {tuple(r)[:4]: r.value for r in model.interpolate(data, cells)[0].collect()}
    assert first == second and len(first) == 20 * model.VerticalModel().fit(data).count()


def test_leave_one_out_like_refits(samples):
    frame, data = samples
    got = model.LeaveOneOut().errors(data.filter("param = 'a'")).toPandas()
    for key, own in frame[frame.param == "a"].groupby("interp_date"):
        for i in own.index:
            rest = own.drop(i)
            want = np.polyval(np.polyfit(rest.elevation, rest.y, 1), own.elevation[i]) - own.y[i]
            assert got[(got.interp_date == key) & (got.y == own.y[i])].error.iloc[0] == pytest.approx(want, abs=1e-6)
    with pytest.raises(NotImplementedError):
        model.LeaveOneOut().scores(data, model.VerticalModel(positive=True))


def test_parameters():
    own = model.VerticalModel().set_params(positive=True)
    assert own.get_params() == {"fit_intercept": True, "positive": True}


def test_vocabulary():
    assert PROVINCE.resolve("tair_2m") == ["LT"] and PROVINCE.resolve(["LT", "N"]) == ["LT", "N"]
    for bad in (["LT", "precipitation"], ["nothing"]):
        with pytest.raises(KeyError):
            PROVINCE.resolve(bad)
    assert normalize_codes([" LT", "N", "", "LT "]) == ["LT", "N"]
    with pytest.raises(ValueError):
        normalize_codes([1])
    with pytest.raises(ValueError, match="more than one"):
        Vocabulary({"a": "x", "b": "x"})
    assert len(PROVINCE.names) == 12


def test_collections(spark):
    dim = spark.createDataFrame([("1", 11.0, 46.0, 300.0, 4326), ("2", 12.0, 46.5, None, 4326)], "id string, x double, y double, elevation double, crs int")
    obs = spark.createDataFrame([("1", "2025-01-01 10:00:00", 1.0), ("2", "2025-01-01 11:00:00", 2.0)], "station_id string, datetime string, tair_2m double").withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    data = MeteoData.build([(dim, obs), None]).validated()
    assert data.flat().count() == 2 and data.points().columns == ["id", "x", "y"] and data.station("1").count() == 1
    with pytest.raises(ValueError, match="more than one CRS"):
        MeteoData.build([(dim, obs), (dim.withColumn("crs", F.lit(3857)), obs)])
    for change, why in (({"y": 91.0}, "latitude"), ({"x": -181.0}, "longitude"), ({"crs": 3857}, "crs"), ({"id": None}, "missing")):
        bad = dim.filter("id = '1'").withColumns({k: F.lit(v).cast(dim.schema[k].dataType) for k, v in change.items()})
        with pytest.raises(ValueError, match=why):
            validate.require_valid_stations(bad)
    with pytest.raises(ValueError, match="coordinates twice"):
        validate.require_valid_stations(dim.unionByName(dim.filter("id = '1'").withColumn("id", F.lit("3"))))
    for n, inside, what in ((0, 0, "no station has"), (2, 1, "at least 3"), (5, 0, "area")):
        with pytest.raises(ValueError, match=what):
            validate.require_enough(n, inside)
    validate.require_enough(3, 0, require_in_aoi=False)
    with pytest.raises(ValueError, match="none of the parameters"):
        data.samples(["absent"], "2025-01-01", "2025-01-02")
    with pytest.raises(ValueError, match="unite"):
        stations.union_all([None])


def test_observation_schema(spark):
    good = spark.createDataFrame([("a", "2025-01-01", 1.0, 3)], "station_id string, datetime string, tair_2m double, extra int")
    assert validate.validate_observations(good).schema["datetime"].dataType.simpleString() == "timestamp"
    with pytest.raises(ValueError, match="additional"):
        validate.validate_observations(good, allow_additional_columns=False)
    with pytest.raises(ValueError, match="not found"):
        validate.validate_observations(good.drop("datetime"))
    with pytest.raises(ValueError, match="floating"):
        validate.validate_observations(good.withColumn("tair_2m", F.lit("x")))
    with pytest.raises(ValueError, match="missing values"):
        validate.validate_observations(good.withColumn("datetime", F.lit("soon")))


def test_blocks_of_fits_and_cells(spark):
    """Beyond the broadcast bound both sides are cut, and every pair is still there once."""
    fits = spark.range(70).selectExpr("concat('p', id % 2) AS param", "id AS interp_date", "1 AS n", "CAST(id AS DOUBLE) AS slope", "1.0D AS intercept")
    cells = spark.range(40).selectExpr("CAST(id AS INT) AS y_idx", "0 AS x_idx", "CAST(id AS DOUBLE) AS value")
    pairs = model.each_on_each(fits, cells, most=5)
    assert "Broadcast" not in pairs._jdf.queryExecution().analyzed().toString()
    got = sorted((r.param, r.interp_date, r.y_idx) for r in pairs.collect())
    assert got == sorted((f"p{i % 2}", i, c) for i in range(70) for c in range(40))


def test_residuals_by_blocks(spark, monkeypatch):
    """Stations of one place are summed, blocks of every size give the plain sums, and stations or cells without a place move nothing."""
    for name, n in (("MOST_CELLS", 7), ("MOST_FITS", 2), ("MOST_PLACES", 50)):
        monkeypatch.setattr(model, name, n)
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"param": rng.choice(list("abcde"), 300), "interp_date": 1, "elevation": rng.uniform(0, 3000, 300), "y": rng.normal(10, 5, 300), "station_x": rng.integers(0, 9, 300).astype(float), "station_y": rng.integers(0, 9, 300).astype(float)})
    data = spark.createDataFrame(frame).withColumn("station_x", F.when(F.col("station_x") < 8, F.col("station_x")))
    cells = spark.range(31).selectExpr("int(id) AS y_idx", "int(id % 3) AS x_idx", "CASE WHEN id < 30 THEN id % 8 + 0.5D END AS x", "id / 4 + 0.25D AS y", "id * 100.0D AS value")
    field, _ = model.interpolate(data, cells, residual_model=model.InverseDistance())
    assert "aggregate(" not in field._jdf.queryExecution().analyzed().toString()
    got = {(r.param, r.y_idx): r.value for r in field.collect()}
    assert len(got) == 5 * 31
    for r in cells.collect():
        for param, own in frame.groupby("param"):
            slope, intercept = np.polyfit(own.elevation, own.y, 1)
            there = own[own.station_x < 8]
            w = 1 / ((there.station_x - r.x) ** 2 + (there.station_y - r.y) ** 2) if r.x is not None else None
            want = None if w is None else intercept + slope * r.value + (w * (there.y - intercept - slope * there.elevation)).sum() / w.sum()
            assert got[param, r.y_idx] == (None if want is None else pytest.approx(want, abs=1e-6))
