from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators.grid_meta import GridMeta
from isohyet.sinks.cube import CubeWriter
from isohyet.sinks.registry import Writer, create_writer
from isohyet.sinks.tiff import TiffWriter, read_tiff

META = GridMeta(0.0, 0.0, 1.0, 1.0, 5, 4, 4326)
DAYS = [datetime(2025, 1, 1) + timedelta(days=i) for i in range(5)]


def dataset(spark, days=DAYS, seed=0, meta=META):
    """tas and pr on days x 4 x 5: seeded normal values plus the variable's number."""
    rng, rows = np.random.default_rng(seed), []
    for k, var in enumerate(("tas", "pr")):
        values = rng.standard_normal((len(days), meta.ny, meta.nx)) + k
        rows += [(var, d, y, x, float(values[i, y, x])) for i, d in enumerate(days) for y in range(meta.ny) for x in range(meta.nx)]
    return spark.createDataFrame(rows, "var string, time timestamp_ntz, y_idx int, x_idx int, value double")


def writer(path, **options):
    return CubeWriter(str(path), **{"start": "2025-01-01", "end": "2025-01-10", "freq": "D", "variables": ["tas", "pr"], "crs": 4326, "chunks": {"time": 1, "y": 2, "x": 2}} | options)


def values(frame):
    return {tuple(r)[:4]: r.value for r in frame.collect()}


def test_creates_and_persists(spark, tmp_path):
    w, data = writer(tmp_path / "c"), dataset(spark)
    m = w.write(data, META)
    assert m.chunks == {"y": (2, 2), "x": (2, 2, 1)} and m.grid.crs == 4326 and '"crs": 4326' in m.to_json()
    assert values(w.read(spark)) == values(data)
    assert w.manifest(spark) == m and m.axis(spark).count() == 10


def test_middle_slice_is_replaced(spark, tmp_path):
    w = writer(tmp_path / "c")
    w.write(dataset(spark, seed=1), META)
    new = dataset(spark, [DAYS[2]], seed=2)
    w.write(new, META)
    want = values(dataset(spark, seed=1)) | values(new)
    assert values(w.read(spark)) == want


def test_part_of_a_slice(spark, tmp_path):
    w, old = writer(tmp_path / "c"), dataset(spark)
    w.write(old, META)
    part = dataset(spark, [DAYS[1]], seed=3).filter("x_idx = 2 AND var = 'pr'")
    w.write(part, META)
    assert values(w.read(spark)) == values(old) | values(part)


def test_mismatches(spark, tmp_path):
    w, data = writer(tmp_path / "c", align=False), dataset(spark)
    w.write(data, META)
    with pytest.raises(ValueError, match="chunks"):
        w.write(data, META, chunks={"y": 4, "x": 2})
    shifted = GridMeta(0.5, 0.0, 1.0, 1.0, 5, 4, 4326)
    with pytest.raises(ValueError, match="coordinate values"):
        w.write(data, shifted)
    with pytest.raises(NotImplementedError):
        writer(tmp_path / "c").write(data, shifted)
    with pytest.raises(ValueError, match="shape does not match"):
        w.write(data, GridMeta(0.0, 0.0, 1.0, 1.0, 6, 4, 4326))
    with pytest.raises(ValueError, match="CRS"):
        w.write(data, GridMeta(0.0, 0.0, 1.0, 1.0, 5, 4, 3857))
    with pytest.raises(ValueError, match="unknown variables"):
        w.write(data.withColumn("var", F.lit("wind")), META)
    with pytest.raises(ValueError, match="axis"):
        w.write(dataset(spark, [datetime(2025, 2, 1)]), META)
    coords = {"y": META.ys(), "x": [v + 0.5 for v in META.xs()]}
    with pytest.raises(ValueError, match="coordinate values"):
        writer(tmp_path / "d", align=False, coords=coords).write(data, META)
    with pytest.raises(ValueError, match="shape does not match"):
        writer(tmp_path / "e", shape={"y": 4, "x": 6}).write(data, META)


def test_packed(spark, tmp_path):
    w, data = writer(tmp_path / "c", dtype="int16", scale_factor=0.1, fill_value=-9999), dataset(spark)
    w.write(data.withColumn("value", F.when(F.col("x_idx") != 3, F.col("value"))), META)
    got = values(w.read(spark))
    for k, v in values(data).items():
        assert got[k] is None if k[3] == 3 else abs(got[k] - v) <= 0.05 + 1e-12
    with pytest.raises(Exception, match="int16"):
        w.write(data.withColumn("value", F.lit(1e6)), META)


def test_day_by_day(spark, tmp_path):
    w, want = writer(tmp_path / "c"), {}
    for i in range(10):
        part = dataset(spark, [datetime(2025, 1, 1 + i)], seed=i)
        w.write(part, META)
        want |= values(part)
    assert values(w.read(spark)) == want
    plan = w.read(spark, ["tas"]).filter("time = timestamp_ntz'2025-01-03'")
    assert plan.count() == 20 and "PartitionFilters: [isnotnull(var" in plan._jdf.queryExecution().executedPlan().toString()


def test_overwrite_and_create(spark, tmp_path):
    w = writer(tmp_path / "c", coords={"y": META.ys(), "x": META.xs()})
    first = w.create(spark)
    assert w.create(spark) == first
    w.write(dataset(spark, seed=1), META)
    w.write(dataset(spark, [DAYS[0]], seed=2), META, overwrite=True)
    assert values(w.read(spark)) == values(dataset(spark, [DAYS[0]], seed=2))


def test_attributes(spark, tmp_path):
    w = writer(tmp_path / "c", drop_attrs=False)
    w.write(dataset(spark), META, attributes={"a": "1"})
    w.write(dataset(spark), META, attributes={"b": "2"})
    assert {"a": "1", "b": "2"}.items() <= dict(w.manifest(spark).attributes).items()
    kept = writer(tmp_path / "c")
    kept.write(dataset(spark), META, attributes={"c": "3"})
    assert "c" not in kept.manifest(spark).attributes


def test_constructor(tmp_path):
    for bad, what in (({"variables": []}, "variables"), ({"variables": "tas"}, "variables"), ({"shape": [4, 5]}, "mapping"), ({"shape": {"y": 4}}, "two dimensions"), ({"shape": {"y": 4, "x": 5}, "coords": {"y": [0], "x": [0]}}, "differ"), ({"append_dims": ("x",)}, "time"), ({"dtype": "text"}, "dtype")):
        with pytest.raises(ValueError, match=what):
            writer(tmp_path, **bad)
    with pytest.raises(ValueError, match="unknown output format"):
        create_writer("paper")
    assert isinstance(create_writer("tiff", path="x"), TiffWriter)
    with pytest.raises(ValueError, match="already"):
        type("Second", (Writer,), {}, key="tiff")


def test_tiff(spark, tmp_path):
    w, data = TiffWriter(str(tmp_path / "t")), dataset(spark)
    names = w.write(data, META)
    assert len(names) == 10 and names[0] == "pr_2025_01_01_000000.tif"
    width, height, got, tags = read_tiff((tmp_path / "t" / "tas_2025_01_03_000000.tif").read_bytes())
    own = values(data)
    assert (width, height) == (5, 4)
    assert got == [own["tas", DAYS[2], 3 - y, x] for y in range(4) for x in range(5)]  # rows from the top
    assert tags[33922][3:5] == (-0.5, 3.5) and 4326 in tags[34735]
    with pytest.raises(ValueError, match="exist already"):
        w.write(data, META)
    w.write(data, META, overwrite=True)
    assert TiffWriter(str(tmp_path / "u")).write(data.filter("var = 'tas' AND time = timestamp_ntz'2025-01-01'").drop("time", "var"), META) == ["var.tif"]


def test_large_files_have_long_offsets(monkeypatch):
    from isohyet.sinks import tiff

    values = np.arange(12, dtype="<f8")
    small = tiff.encode_tiff(values.tobytes(), 4, 3, 10.0, 47.0, 0.5, 0.5, 4326)
    monkeypatch.setattr(tiff, "SMALL_TIFF", 10)
    big = tiff.encode_tiff(values.tobytes(), 4, 3, 10.0, 47.0, 0.5, 0.5, 4326)
    assert (small[2], big[2]) == (42, 43)
    for blob in (small, big):
        width, height, cells, tags = tiff.read_tiff(blob)
        assert (width, height, cells) == (4, 3, values.tolist()) and tags[33550] == (0.5, 0.5, 0.0) and tags[34735][-1] == 4326


def test_partial_writes_leave_nothing_beside(spark, tmp_path):
    import os

    meta = GridMeta(10.0, 47.0, 1.0, -1.0, 4, 3, 4326)
    own = CubeWriter(str(tmp_path / "c"), "2025-01-01", "2025-01-02", "D", ["tas"])
    cells = spark.range(12).selectExpr("timestamp_ntz'2025-01-01' AS time", "CAST(id DIV 4 AS INT) AS y_idx", "CAST(id % 4 AS INT) AS x_idx", "CAST(id AS DOUBLE) AS value")
    own.write(cells, meta)
    own.write(cells.filter("x_idx = 1").withColumn("value", cells["value"] + 100), meta)
    assert sorted(r.value for r in own.read(spark).collect()) == sorted(float(i + 100 * (i % 4 == 1)) for i in range(12))
    assert sorted(os.listdir(tmp_path / "c")) == [".manifest.json.crc", "cells", "manifest.json"]


def test_slices_by_blocks(spark, tmp_path, monkeypatch):
    """A slice's rows are several tasks' work, also where a part of it is replaced."""
    from isohyet.sinks import cube as module

    monkeypatch.setattr(module, "MOST_CELLS", 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    whole, data = writer(tmp_path / "c"), dataset(spark, DAYS[:2])
    try:
        whole.write(data, META)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "c/cells").glob("var=tas/time_key=2025-01-01*/*.parquet"))) > 1
    changed = data.filter("y_idx = 3 AND var = 'pr'").withColumn("value", F.lit(9.0))
    whole.write(changed, META)
    assert values(whole.read(spark)) == {**values(data), **values(changed)}
