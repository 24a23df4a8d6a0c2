"""Grids in long form (y_idx, x_idx, y, x, value): dimension names, clipping, regridding, checks, cache.

A cell's coordinates follow from its indices, so joins are on integers only; coordinates are columns so that box filters reach the scan.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import os
from collections.abc import Sequence
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions import proj
from isohyet.functions.missing import is_close, normalize_nan
from isohyet.operators.grid_meta import GridMeta

#: Names that horizontal dimensions may have, preferred first.
X_NAMES = ("lon", "longitude", "x")
Y_NAMES = ("lat", "latitude", "y")


def explode_rows(rows: DataFrame, row: str, values: str, meta: GridMeta | None = None) -> DataFrame:
    """Long form of a table with one array of cells per grid row."""
    out = rows.select(F.col(row).cast("int").alias("y_idx"), F.posexplode(values).alias("x_idx", "value")).withColumn("value", F.col("value").cast("double"))
    return with_coordinates(out, meta) if meta else out


def with_coordinates(cells: DataFrame, meta: GridMeta) -> DataFrame:
    return cells.withColumns({"y": F.lit(meta.y0) + F.col("y_idx") * F.lit(meta.dy), "x": F.lit(meta.x0) + F.col("x_idx") * F.lit(meta.dx)})


def find_dims(names: Sequence[str], x_dim: str | None = None, y_dim: str | None = None) -> tuple[str, str, list[str]]:
    """Names of the x and the y dimension, and warnings where more than one fits."""
    warnings, found = [], []
    for own, known in ((x_dim, X_NAMES), (y_dim, Y_NAMES)):
        if own is not None:
            if own not in names:
                raise ValueError(f"dimension {own!r} not found in {list(names)}")
            found.append(own)
            continue
        fits = [n for k in known for n in (k, k.upper(), k.capitalize()) if n in names]
        fits = list(dict.fromkeys(fits))
        if not fits:
            raise ValueError(f"none of {known} found in {list(names)}")
        if len(fits) > 1:
            warnings.append(f"{fits} found; {fits[0]} is used")
        found.append(fits[0])
    return found[0], found[1], warnings


def normalize_dims(cells: DataFrame, x_dim: str | None = None, y_dim: str | None = None, target_x: str = "x", target_y: str = "y") -> DataFrame:
    """Renames the horizontal dimensions. A column that already has a target's name is an error."""
    x, y, _ = find_dims(cells.columns, x_dim, y_dim)
    for own, target in ((x, target_x), (y, target_y)):
        if own != target and target in cells.columns:
            raise ValueError(f"can't rename {own!r}: there is a column {target!r} already")
    return cells.withColumnsRenamed({x: target_x, y: target_y})


def resolve_crs(of_file: int | None, of_config: int | None) -> tuple[int, str | None]:
    """The file's CRS wins over the configuration's; a warning if they differ."""
    if of_file is None and of_config is None:
        raise ValueError("no CRS, neither in the file nor in the configuration")
    if of_file is not None and of_config is not None and of_file != of_config:
        return proj.check(of_file), f"the file's CRS {of_file} is used, not the configuration's {of_config}"
    return proj.check(of_file if of_file is not None else of_config), None


def needs_regrid(meta: GridMeta, crs: int | None, res: float | tuple[float, float] | None) -> bool:
    if crs is not None and crs != meta.crs:
        return True
    if res is None:
        return False
    pair = (res, res) if isinstance(res, (int, float)) else tuple(res)
    return not all(is_close(a, b) for a, b in zip(meta.res, pair))


def target_grid(meta: GridMeta, crs: int | None, res: float | tuple[float, float] | None) -> GridMeta:
    """The grid that covers the source's box in another system and resolution. Without a resolution a change of system keeps
    the number of cells on the box's diagonal."""
    crs = meta.crs if crs is None else proj.check(crs)
    minx, miny, maxx, maxy = meta.bounds
    if crs != meta.crs:
        from isohyet.operators.aoi import AOI

        minx, miny, maxx, maxy = AOI(minx, miny, maxx, maxy, meta.crs).to_crs(crs, densify=16).bounds
        if res is None:
            res = math.hypot(maxx - minx, maxy - miny) / math.hypot(meta.nx, meta.ny)
    rx, ry = meta.res if res is None else (res, res) if isinstance(res, (int, float)) else res
    nx, ny = max(1, round((maxx - minx) / rx)), max(1, round((maxy - miny) / ry))
    return GridMeta(minx + rx / 2, maxy - ry / 2, rx, -ry, nx, ny, crs, meta.x_dim, meta.y_dim)


def _cell_lattice(spark: SparkSession, meta: GridMeta) -> DataFrame:
    """All cells' indices and coordinates, made where they are used."""
    cells = spark.range(meta.nx * meta.ny).select((F.floor(F.col("id") / meta.nx) + meta.first[0]).cast("int").alias("y_idx"), (F.col("id") % meta.nx + meta.first[1]).cast("int").alias("x_idx"))
    return with_coordinates(cells, meta)


def _source_place(target: DataFrame, source: GridMeta, crs: int | None) -> DataFrame:
    """Adds fx, fy: each target cell's centre in fractional source indices."""
    if crs == source.crs:
        x, y = F.col("x"), F.col("y")
    else:
        lonlat = _lonlat_columns(F.col("x"), F.col("y"), crs)
        x, y = _from_lonlat_columns(*lonlat, source.crs)
    return target.withColumn("fx", (x - source.x0) / source.dx).withColumn("fy", (y - source.y0) / source.dy)


#: The functions that projections use, for arrays.
NUMPY = SimpleNamespace(
    when=lambda there, v: np.where(there, v, np.nan), abs=np.abs, pi=lambda: np.pi, degrees=np.degrees, radians=np.radians, exp=np.exp, log=np.log, hypot=np.hypot, sin=np.sin, cos=np.cos, tan=np.tan, asin=np.arcsin, atan=np.arctan, atan2=np.arctan2,
    sinh=np.sinh, cosh=np.cosh, tanh=np.tanh, asinh=np.arcsinh, atanh=np.arctanh,
)


def _lonlat_columns(x: Column, y: Column, crs: int, m=F) -> tuple[Column, Column]:
    """m: the functions, of columns or (NUMPY) of arrays."""
    if crs == 4326:
        return x, y
    if crs == 3857:
        return m.degrees(x / proj.AXIS), m.degrees(2 * m.atan(m.exp(y / proj.AXIS)) - m.pi() / 2)
    zone, scale = crs % 100, proj.UTM_SCALE * proj._RADIUS
    xi, eta = (y - (proj.FALSE_NORTHING if crs >= 32700 else 0.0)) / scale, (x - proj.FALSE_EASTING) / scale
    own_xi, own_eta = xi, eta
    for j, b in enumerate(proj._BETA, 1):
        own_xi = own_xi - b * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        own_eta = own_eta - b * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
    sine = m.sin(own_xi) / m.cosh(own_eta)
    ecc = proj._ECC2**0.5
    step = lambda s: m.tanh(m.atanh(sine) + ecc * m.atanh(ecc * s))
    return 6 * zone - 183 + m.degrees(m.atan2(m.sinh(own_eta), m.cos(own_xi))), m.degrees(m.asin(step(step(step(step(sine))))))


def _from_lonlat_columns(lon: Column, lat: Column, crs: int, m=F) -> tuple[Column, Column]:
    if crs == 4326:
        return lon, lat
    lat = m.when(m.abs(lat) <= 90, lat)  # beyond the poles there is no place, though the formulas would go on
    if crs == 3857:
        return proj.AXIS * m.radians(lon), proj.AXIS * m.log(m.tan(m.pi() / 4 + m.radians(lat) / 2))
    zone, scale = crs % 100, proj.UTM_SCALE * proj._RADIUS
    ecc = 2 * proj._N**0.5 / (1 + proj._N)
    s = m.sin(m.radians(lat))
    t = m.sinh(m.atanh(s) - ecc * m.atanh(ecc * s))
    d = m.radians(lon - (6 * zone - 183))
    xi, eta = m.atan2(t, m.cos(d)), m.asinh(m.sin(d) / m.hypot(t, m.cos(d)))
    east, north = eta, xi
    for j, a in enumerate(proj._ALPHA, 1):
        east = east + a * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        north = north + a * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
    return proj.FALSE_EASTING + scale * east, scale * north + (proj.FALSE_NORTHING if crs >= 32700 else 0.0)


def _cubic(d: np.ndarray) -> np.ndarray:
    """Cubic convolution with a = -0.5."""
    return np.where(d < 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0.0))


def _spline(d: np.ndarray) -> np.ndarray:
    """Cubic B-spline."""
    return np.where(d < 1, 2 / 3 - d * d * (1 - d / 2), np.where(d < 2, (2 - d) ** 3 / 6, 0.0))


def _lanczos(d: np.ndarray) -> np.ndarray:
    """Lanczos window of three cells."""
    a = np.pi * np.where(d == 0, 1.0, d)
    return np.where(d == 0, 1.0, np.where(d < 3, 3 * np.sin(a) * np.sin(a / 3) / (a * a), 0.0))


#: Kernel methods: cells on each side that count, weight by distance in cells.
KERNELS = {"bilinear": (1, lambda d: np.maximum(0.0, 1 - d)), "cubic": (2, _cubic), "cubic_spline": (2, _spline), "lanczos": (3, _lanczos)}

#: Footprint methods: an aggregate of the source cells whose centres fall in a target cell.
FOOTPRINTS = {
    "average": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "med": F.median, "mode": lambda c: F.mode(c, True),
    "q1": lambda c: F.percentile(c, 0.25), "q3": lambda c: F.percentile(c, 0.75), "rms": lambda c: F.sqrt(F.avg(c * c)),
}
METHODS = ("nearest", *KERNELS, *FOOTPRINTS)


def coarsening(source: GridMeta, target: GridMeta) -> tuple[float, float]:
    """How many source cells a target cell covers in y and x; 1 at least."""
    if source.crs == target.crs:
        return max(1.0, target.res[1] / source.res[1]), max(1.0, target.res[0] / source.res[0])
    from isohyet.operators.aoi import AOI

    minx, miny, maxx, maxy = AOI(*target.bounds, target.crs).to_crs(source.crs, densify=16).bounds
    return max(1.0, (maxy - miny) / source.res[1] / target.ny), max(1.0, (maxx - minx) / source.res[0] / target.nx)


def regrid(cells: DataFrame, source: GridMeta, target: GridMeta, method: str | Sequence[str] = "bilinear", widen: bool = False) -> DataFrame:
    """Values on the target's cells (y_idx, x_idx, y, x, value); cells without any source cell are left out. With widen, kernels grow
    by as much as the target is coarser, so that all source cells count, as raster libraries do. Several footprint methods are one aggregation with a column each."""
    several = [] if isinstance(method, str) else list(method)
    if unknown := [m for m in several or [method] if m not in METHODS]:
        raise ValueError(f"unknown resampling method {unknown[0]!r}; known: {', '.join(METHODS)}")
    if kernels := [m for m in several if m not in FOOTPRINTS]:
        raise ValueError(f"several methods at once must be footprint methods, not {kernels}")
    values = cells.select(F.col("y_idx").alias("sy"), F.col("x_idx").alias("sx"), F.col("value").alias("v"))
    if several or method in FOOTPRINTS:
        placed = cells.select("x", "y", "value") if "x" in cells.columns else with_coordinates(cells, source).select("x", "y", "value")
        own = _source_place(placed, target, source.crs)
        at = own.select(F.floor(F.col("fy") + 0.5).cast("int").alias("y_idx"), F.floor(F.col("fx") + 0.5).cast("int").alias("x_idx"), "value")
        inside = at.filter(F.col("y_idx").between(target.first[0], target.first[0] + target.ny - 1) & F.col("x_idx").between(target.first[1], target.first[1] + target.nx - 1))
        found = [FOOTPRINTS[m](F.col("value")).alias(m) for m in several] or [FOOTPRINTS[method](F.col("value")).alias("value")]
        return with_coordinates(inside.groupBy("y_idx", "x_idx").agg(*found), target).select("y_idx", "x_idx", "y", "x", *(several or ["value"]))
    placed = _source_place(_cell_lattice(cells.sparkSession, target), source, target.crs)
    if method == "nearest":
        near = placed.withColumn("sy", F.floor(F.col("fy") + 0.5).cast("int")).withColumn("sx", F.floor(F.col("fx") + 0.5).cast("int"))
        return near.join(values, ["sy", "sx"]).select("y_idx", "x_idx", "y", "x", F.col("v").alias("value"))
    by = coarsening(source, target) if widen else (1.0, 1.0)
    return _by_tiles(values, placed, source, target, method, by)


#: Kernels: length of a target tile in cells of its source or its own, whichever is larger; source cells that a task holds at once.
TILE, MOST_HELD = 256, 1 << 20
#: Most tiles whose places are broadcast.
MOST_TILES = 50_000


def _by_tiles(values: DataFrame, placed: DataFrame, source: GridMeta, target: GridMeta, method: str, by: tuple[float, float]) -> DataFrame:
    """Kernels, by tiles of the target: each gets the source cells of the box that it needs, so that these are shuffled once or little more, and target cells never."""
    far = [math.ceil(KERNELS[method][0] * b) for b in by]
    coarse = coarsening(source, target) if source.crs == target.crs else by
    ty, tx = (max(1, int(TILE // c)) for c in coarse)
    n = -(-target.ny // ty) * -(-target.nx // tx)
    tile = [F.floor((F.col(f"{d}_idx") - first) / size).cast("int").alias(f"t{d}") for d, first, size in (("y", target.first[0], ty), ("x", target.first[1], tx))]
    there = placed.filter(F.col("fy").between(-2e9, 2e9) & F.col("fx").between(-2e9, 2e9))
    # One cell more on each side, as workers may round a place otherwise.
    ends = [f(F.floor(F.col(f"f{d}"))) + F.lit(sign * (reach + 1)) for d, reach in zip("yx", far) for f, sign in ((F.min, -1), (F.max, 1))]
    boxes = there.groupBy(*tile).agg(*(e.alias(k) for e, k in zip(ends, ("y0", "y1", "x0", "x1"))))
    block = lambda c: F.floor(c / TILE)
    boxes = boxes.withColumn("by", F.explode(F.sequence(block(F.col("y0")), block(F.col("y1"))))).withColumn("bx", F.explode(F.sequence(block(F.col("x0")), block(F.col("x1")))))
    own = values.filter("v is not null").withColumn("by", block(F.col("sy"))).withColumn("bx", block(F.col("sx")))
    joined = own.join(F.broadcast(boxes) if n <= MOST_TILES else boxes, ["by", "bx"]).filter("sy BETWEEN y0 AND y1 AND sx BETWEEN x0 AND x1").select("ty", "tx", "sy", "sx", "v")
    parts = max(1, min(n, max(2 * values.sparkSession.sparkContext.defaultParallelism, n // 32)))
    work = functools.partial(_tiles, source=source, target=target, method=method, by=by, size=(ty, tx))
    return joined.repartition(parts, "ty", "tx").sortWithinPartitions("ty", "tx", "sy").mapInArrow(work, "y_idx int, x_idx int, y double, x double, value double")


def _tiles(batches, **options):
    """On a worker: rows (ty, tx, sy, sx, v) in the order of tiles and source rows; a tile's cells are given out when its last row has come."""
    tile, held, n = None, [], 0
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        ends = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
        for a, b in zip([0, *ends], [*ends, batch.num_rows]):
            if a == b:
                continue
            at = int(columns[0][a]), int(columns[1][a])
            if tile is None or tile.at != at:
                if tile is not None:
                    tile.add(held)
                    yield tile.batch()
                tile, held, n = Tile(at, **options), [], 0
            held.append([c[a:b] for c in columns[2:]])
            n += b - a
            if n > MOST_HELD:
                tile.add(held)
                held, n = [], 0
    if tile is not None:
        tile.add(held)
        yield tile.batch()


class Tile:
    """Weighted sums of a tile of the target, to which source cells are added in parts."""

    def __init__(self, at: tuple[int, int], source: GridMeta, target: GridMeta, method: str, by: tuple[float, float], size: tuple[int, int]):
        self.at, self.target, self.by = at, target, by
        reach, self.weight = KERNELS[method]
        self.far = [math.ceil(reach * b) for b in by]
        own = [np.arange(i * s, min((i + 1) * s, m)) + first for i, s, m, first in zip(at, size, target.shape, target.first)]
        self.y, self.x = (v.reshape(-1) for v in np.meshgrid(*own, indexing="ij"))
        if source.crs == target.crs:
            # By indices, not coordinates: these are less exact the farther a cell is, and decimal steps differ from binary ones.
            place = lambda i, a, b, da, db: round((a - b) / db, 9) + i * (da / db)
            self.fy, self.fx = place(self.y, target.y0, source.y0, target.dy, source.dy), place(self.x, target.x0, source.x0, target.dx, source.dx)
        else:
            with np.errstate(all="ignore"):
                x, y = _from_lonlat_columns(*_lonlat_columns(target.x0 + self.x * target.dx, target.y0 + self.y * target.dy, target.crs, NUMPY), source.crs, NUMPY)
                self.fy, self.fx = (y - source.y0) / source.dy, (x - source.x0) / source.dx
            nowhere = ~(np.isfinite(self.fy) & np.isfinite(self.fx))
            self.fy[nowhere] = self.fx[nowhere] = -4e9
        self.row, self.col = (np.floor(f).astype("int64") for f in (self.fy, self.fx))
        self.cols = self.col[:, None] + np.arange(1 - self.far[1], self.far[1] + 1)
        self.wx = self.weight(np.abs(self.fx[:, None] - self.cols) / by[1])
        self.sum, self.weights, self.any = np.zeros(self.y.size), np.zeros(self.y.size), np.zeros(self.y.size, bool)

    def add(self, held: list) -> None:
        if not held:
            return
        sy, sx, v = (np.concatenate(c) for c in zip(*held))
        a, b, c, d = int(sy.min()), int(sy.max()), int(sx.min()), int(sx.max())
        width = d - c + 1
        place = (sy.astype("int64") - a) * width + (sx - c)
        n, s = np.bincount(place, minlength=(b - a + 1) * width), np.bincount(place, v, (b - a + 1) * width)
        for dy in range(max(1 - self.far[0], a - int(self.row.max())), min(self.far[0], b - int(self.row.min())) + 1):
            row = self.row + dy
            wy = self.weight(np.abs(self.fy - row) / self.by[0])
            at = np.flatnonzero((row >= a) & (row <= b) & (wy != 0))
            if not at.size:
                continue
            col, w = self.cols[at], wy[at, None] * self.wx[at]
            p = (row[at, None] - a) * width + np.clip(col - c, 0, width - 1)
            used = (col >= c) & (col <= d) & (w != 0) & (n[p] > 0)
            self.sum[at] += np.where(used, w * s[p], 0.0).sum(1)
            self.weights[at] += np.where(used, w * n[p], 0.0).sum(1)
            self.any[at] |= used.any(1)

    def batch(self) -> pa.RecordBatch:
        y, x, w = self.y[self.any], self.x[self.any], self.weights[self.any]
        value = pa.array(self.sum[self.any] / np.where(w == 0, 1, w), mask=w == 0)
        columns = [pa.array(y.astype("int32")), pa.array(x.astype("int32")), pa.array(self.target.y0 + y * self.target.dy), pa.array(self.target.x0 + x * self.target.dx), value]
        return pa.RecordBatch.from_arrays(columns, names=["y_idx", "x_idx", "y", "x", "value"])


def missing_cells(cells: DataFrame, meta: GridMeta) -> DataFrame:
    """Indices of the cells that a grid should have and that are absent or NULL."""
    there = cells.filter(F.col("value").isNotNull() & ~F.isnan("value")).select("y_idx", "x_idx")
    return _cell_lattice(cells.sparkSession, meta).select("y_idx", "x_idx").join(there, ["y_idx", "x_idx"], "left_anti")


def require_no_missing(cells: DataFrame, meta: GridMeta) -> DataFrame:
    if missing_cells(cells, meta).limit(1).count():
        raise ValueError("the grid has missing values; choose a smaller area or a source that covers it")
    return cells


def grid_differences(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Cells that only one of two grids has, or whose coordinates differ by more than tolerance."""
    left, right = (x.select("y_idx", "x_idx", F.col("y").alias(f"y_{n}"), F.col("x").alias(f"x_{n}")) for x, n in ((a, "a"), (b, "b")))
    both = left.join(right, ["y_idx", "x_idx"], "full_outer")
    return both.filter(F.col("y_a").isNull() | F.col("y_b").isNull() | (F.abs(F.col("y_a") - F.col("y_b")) > tolerance) | (F.abs(F.col("x_a") - F.col("x_b")) > tolerance))


def cache_key(**settings) -> str:
    """Sixteen hex digits of the settings that a prepared grid depends on."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


class BaseGrid:
    """A prepared elevation grid: read, renamed, clipped, regridded, clipped again, checked - or read from the cache."""

    def __init__(self, spark: SparkSession, path: str, aoi=None, var: str | None = None, squeeze: bool = True, crs: int | None = None, x_dim: str | None = None, y_dim: str | None = None,
                 target_crs: int | None = None, target_res=None, target_x_dim: str = "x", target_y_dim: str = "y", aoi_buffer_m: float = 0.0, resampling_method: str = "bilinear", cache: bool = True, cache_folder: str = "data"):
        from isohyet.sources.raster import open_raster

        if resampling_method not in METHODS:
            raise ValueError(f"unknown resampling method {resampling_method!r}; known: {', '.join(METHODS)}")
        stamp = [os.path.getsize(path), os.path.getmtime(path)] if os.path.isfile(path) else None
        area = [aoi.bounds, aoi.crs] if aoi else None
        self.key = cache_key(path=path, var=var, squeeze=squeeze, crs=crs, target_crs=target_crs, target_res=target_res, x_dim=x_dim, y_dim=y_dim, target_dims=[target_x_dim, target_y_dim], aoi=area, buffer=aoi_buffer_m, method=resampling_method, source=stamp)
        place = f"{cache_folder}/grid-{self.key}"
        self.warnings: list[str] = []
        if cache:
            from isohyet.sinks.files import exists, read_text

            if exists(spark, f"{place}/meta.json"):
                self.meta, self.cells = GridMeta.from_json(read_text(spark, f"{place}/meta.json")), spark.read.parquet(f"{place}/cells")
                return
        cells, meta = open_raster(spark, path, var=var, squeeze=squeeze, x_dim=x_dim, y_dim=y_dim, warnings=self.warnings)
        own_crs, warning = resolve_crs(meta.crs, crs)
        self.warnings += [warning] if warning else []
        meta, cells = replace(meta, crs=own_crs, x_dim=target_x_dim, y_dim=target_y_dim), normalize_nan(cells)
        if needs_regrid(meta, target_crs, target_res):
            if aoi is not None:
                cells, meta = aoi.filter_grid(cells, meta, buffer_m=aoi_buffer_m)
            target = target_grid(meta, target_crs, target_res)
            cells, meta = regrid(cells, meta, target, resampling_method, widen=True), target
        if aoi is not None:
            cells, meta = aoi.filter_grid(cells, meta)
        self.meta, self.cells = meta, require_no_missing(cells, meta)
        if cache:
            from isohyet.sinks.files import write_text

            self.cells.write.mode("overwrite").parquet(f"{place}/cells")
            write_text(spark, f"{place}/meta.json", meta.to_json())
            self.cells = spark.read.parquet(f"{place}/cells")

    def __repr__(self) -> str:
        return f"BaseGrid({self.meta})"
