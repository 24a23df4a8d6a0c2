import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.functions import proj
from isohyet.operators import grid
from isohyet.operators.aoi import AOI
from isohyet.operators.grid import BaseGrid
from isohyet.operators.grid_meta import GridMeta, GridValidator

META = GridMeta(10.0, 47.0, 0.1, -0.1, 21, 11, 4326)


def cells(spark, meta, formula):
    return grid.with_coordinates(grid._cell_lattice(spark, meta).select("y_idx", "x_idx"), meta).withColumn("value", F.expr(formula))


def test_projections():
    assert proj.transform(9, 0, 4326, 32632) == pytest.approx((500000, 0), abs=1e-6)
    # A point of the central meridian: the meridian's arc, scaled.
    assert proj.transform(9, 45, 4326, 32632) == pytest.approx((500000, 4982950.4), abs=0.5)
    for epsg in (3857, 32632, 32732, 32633):
        assert proj.transform(*proj.transform(11.3, 46.4, 4326, epsg), epsg, 4326) == pytest.approx((11.3, 46.4), abs=1e-8)
    with pytest.raises(ValueError, match="32532"):
        proj.check(32532)


def test_projection_columns_agree(spark):
    r = spark.sql("SELECT 11.3D AS x, 46.4D AS y")
    for epsg in (3857, 32632, 32732):
        x, y = grid._from_lonlat_columns(F.col("x"), F.col("y"), epsg)
        there = r.select(x.alias("x"), y.alias("y"))
        assert tuple(there.first()) == pytest.approx(proj.transform(11.3, 46.4, 4326, epsg), abs=1e-6)
        x, y = grid._lonlat_columns(F.col("x"), F.col("y"), epsg)
        assert tuple(there.select(x.alias("a"), y.alias("b")).first()) == pytest.approx((11.3, 46.4), abs=1e-8)


def test_boxes():
    box = AOI(10, 46, 12, 47)
    moved = box.buffer(5000)
    assert proj.geodesic(10, 46, moved.minx, moved.miny)[0] == pytest.approx(5000 * math.sqrt(2), rel=0.02)
    assert AOI(0, 0, 1000, 1000, 3857).buffer(10).bounds == (-10, -10, 1010, 1010)
    utm = box.to_crs(32632)
    assert utm.minx == pytest.approx(proj.transform(10, 46, 4326, 32632)[0])
    assert box.to_crs(32632, densify=8).maxy >= utm.maxy
    with pytest.raises(ValueError, match="CRS"):
        box.filter_points(None, None)
    with pytest.raises(ValueError, match="filter"):
        box.filter(None, "grid")


def test_box_filters_reach_the_scan(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_retailprice").alias("y"), F.col("p_retailprice").alias("x"))
    plan = AOI(950, 950, 1200, 1500, 3857).filter_points(points, 3857)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "GreaterThanOrEqual(p_retailprice" in plan


def test_dims():
    assert grid.find_dims(["time", "LON", "lat"])[:2] == ("LON", "lat")
    x, y, warnings = grid.find_dims(["lon", "x", "y"])
    assert (x, y) == ("lon", "y") and len(warnings) == 1
    with pytest.raises(ValueError, match="none of"):
        grid.find_dims(["a", "b"])
    with pytest.raises(ValueError, match="not found"):
        grid.find_dims(["x", "y"], x_dim="east")


def test_crs_and_decisions():
    assert grid.resolve_crs(4326, None) == (4326, None)
    assert grid.resolve_crs(4326, 3857)[1]
    with pytest.raises(ValueError, match="no CRS"):
        grid.resolve_crs(None, None)
    assert not grid.needs_regrid(META, 4326, 0.1)
    assert grid.needs_regrid(META, 3857, None) and grid.needs_regrid(META, None, (0.1, 0.2))
    there = grid.target_grid(META, 32632, None)  # as many cells on the diagonal
    assert math.hypot(there.nx, there.ny) == pytest.approx(math.hypot(META.nx, META.ny), rel=0.05)


@pytest.mark.parametrize("method", ["bilinear", "cubic"])
def test_kernels_keep_a_plane(spark, method):
    source = cells(spark, META, "3 * x - 2 * y")
    target = GridMeta(10.43, 46.63, 0.03, -0.03, 12, 8, 4326)
    out = grid.regrid(source, META, target, method).toPandas()
    assert len(out) == 96 and np.allclose(out.value, 3 * out.x - 2 * out.y)


@pytest.mark.parametrize("method", grid.METHODS)
def test_methods_keep_a_constant(spark, method):
    out = grid.regrid(cells(spark, META, "5.0D"), META, GridMeta(10.5, 46.6, 0.2, -0.2, 4, 3, 4326), method).toPandas()
    assert len(out) == 12
    want = {"sum": 5.0 * 4}.get(method, 5.0)
    assert (np.allclose(out.value, want)) if method != "sum" else out.value.between(5, 45).all()


def test_reprojection_of_a_plane(spark):
    meta = GridMeta(10.0, 47.0, 0.01, -0.01, 101, 101, 4326)
    source = cells(spark, meta, "x + y")
    target = GridMeta(600000.0, 5180000.0, 2000.0, -2000.0, 10, 10, 32632)
    out = grid.regrid(source, meta, target, "bilinear").toPandas()
    assert len(out) == 100
    for x, y, v in zip(out.x, out.y, out.value):
        assert v == pytest.approx(sum(proj.transform(x, y, 32632, 4326)), abs=1e-6)
    with pytest.raises(ValueError, match="unknown resampling method"):
        grid.regrid(source, meta, target, "magic")


def test_missing(spark):
    own = cells(spark, META, "CASE WHEN y_idx = 3 AND x_idx = 4 THEN double('NaN') ELSE 1.0D END")
    assert [tuple(r) for r in grid.missing_cells(own, META).collect()] == [(3, 4)]
    with pytest.raises(ValueError, match="missing values"):
        grid.require_no_missing(own, META)


def test_validator():
    check = GridValidator.from_grid(META)
    check.validate(GridMeta(10.0, 47.0, 0.1, -0.1, 21, 11, 4326))
    for other, what in ((GridMeta(10.0, 47.0, 0.1, -0.1, 21, 11, 3857), "CRS"), (GridMeta(10.0, 47.0, 0.2, -0.1, 21, 11, 4326), "resolution"), (GridMeta(10.0, 47.0, 0.1, -0.1, 22, 11, 4326), "shape"), (GridMeta(10.5, 47.0, 0.1, -0.1, 21, 11, 4326), "values"), (GridMeta(10.0, 47.0, 0.1, -0.1, 21, 11, 4326, "lon"), "dimensions")):
        with pytest.raises(ValueError, match=what):
            check.validate(other)


def test_base_grid(spark, tmp_path):
    path = str(tmp_path / "dem")
    cells(spark, META, "100 * x + y").select(F.col("x").alias("lon"), F.col("y").alias("lat"), F.col("value").alias("orog")).write.parquet(path)
    (tmp_path / "dem.json").write_text('{"crs": 4326}')
    options = {"aoi": AOI(10.5, 46.4, 11.2, 46.8), "target_res": 0.05, "aoi_buffer_m": 20000, "cache_folder": str(tmp_path / "cache")}
    first = BaseGrid(spark, path, **options)
    again = BaseGrid(spark, path, **options)
    assert first.key == again.key and again.meta == first.meta and first.meta.res == pytest.approx((0.05, 0.05))
    assert again.cells.count() == first.meta.nx * first.meta.ny > 0
    out = again.cells.toPandas()
    assert np.allclose(out.value, 100 * out.x + out.y)
    assert out.x.between(10.47, 11.23).all()
    assert BaseGrid(spark, path, cache=False).meta.shape == (11, 21)
    (tmp_path / "dem.json").unlink()
    with pytest.raises(ValueError, match="no CRS"):
        BaseGrid(spark, path, cache=False)
    with pytest.raises(ValueError, match="unknown resampling"):
        BaseGrid(spark, path, resampling_method="magic")
    with pytest.raises(ValueError, match="not found"):
        BaseGrid(spark, path, var="slope", crs=4326, cache=False)


@pytest.mark.parametrize("method,by", [("bilinear", 1), ("lanczos", 1), ("cubic", 3), ("cubic_spline", 300)])
def test_kernels_by_tiles(spark, monkeypatch, method, by):
    """Tiles of every size give the plain sums, with holes, repeated cells and few cells at once; source cells are shuffled, not their weights."""
    monkeypatch.setattr(grid, "TILE", 8)
    monkeypatch.setattr(grid, "MOST_HELD", 30)
    meta = GridMeta(10.0, 47.0, 0.1, -0.1, 23, 19, 4326)
    source = cells(spark, meta, "CASE WHEN (y_idx * 23 + x_idx) % 7 > 0 THEN sin(y_idx * 3 + x_idx) END")
    source = source.unionByName(source.filter("y_idx = 5"))
    n = {1: (40, 30), 3: (8, 6), 300: (1, 1)}[by]
    target = GridMeta(10.03, 46.96, 0.1 * (by if by > 1 else 0.6), -0.1 * (by if by > 1 else 0.6), *n, 4326)
    out = grid.regrid(source, meta, target, method, widen=by > 1)
    assert "MapInArrow" in out._jdf.queryExecution().analyzed().toString()
    got = {(r.y_idx, r.x_idx): r.value for r in out.collect()}
    there = [r for r in source.collect() if r.value is not None]
    sy, sx, v = (np.array([getattr(r, k) for r in there]) for k in ("y_idx", "x_idx", "value"))
    weight, want = grid.KERNELS[method][1], {}
    for y in range(target.ny):
        for x in range(target.nx):
            fy, fx = (target.y0 + y * target.dy - meta.y0) / meta.dy, (target.x0 + x * target.dx - meta.x0) / meta.dx
            w = weight(np.abs(sy - fy) / by) * weight(np.abs(sx - fx) / by)
            if (w != 0).any():
                want[y, x] = (w * v).sum() / w.sum()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6) for k in want)


def test_rows_beyond_the_pole(spark, tmp_path):
    """They have no place in another system: left out, neither an error nor wrapped around the earth."""
    from isohyet.plans.queries import QUERIES

    for n, folder in ((13_700, "a"), (45_000, "b")):
        (tmp_path / folder).mkdir()
        spark.range(n).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> CAST(id + i AS FLOAT)) AS embedding").write.parquet(str(tmp_path / folder / "embeddings.parquet"))
    within, beyond = (sorted(map(tuple, QUERIES["grid_reproject"](spark, str(tmp_path / f)).collect())) for f in "ab")
    assert beyond == within and len(within) > 10_000
    for epsg in (3857, 32632):
        with pytest.raises(ValueError, match="latitude"):
            proj.transform(10, -313, 4326, epsg)
        assert spark.range(1).select(*grid._from_lonlat_columns(F.lit(10.0), F.lit(-313.0), epsg)).first()[1] is None
