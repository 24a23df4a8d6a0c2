"""Rasters: Parquet in long form or with one array per row; Zarr chunk by chunk; NetCDF by an optional library."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.operators.grid import find_dims, with_coordinates
from isohyet.operators.grid_meta import GridMeta
from isohyet.sinks import files
from isohyet.sources import zarr


def choose_variable(names: Sequence[str], var: str | None, warnings: list[str] | None = None) -> str:
    """The variable asked for, or the first with a warning."""
    if var is not None:
        if var not in names:
            raise ValueError(f"variable {var!r} not found in {list(names)}")
        return var
    if not names:
        raise ValueError("there is no variable")
    if len(names) > 1 and warnings is not None:
        warnings.append(f"variables {list(names)} found; {names[0]} is used")
    return names[0]


def _axis(frame: DataFrame, name: str) -> list[float]:
    """A dimension's coordinates: as many as the grid has columns or rows."""
    return [r[0] for r in frame.select(F.col(name).cast("double")).distinct().orderBy(name).collect()]


def open_raster(spark: SparkSession, path: str, var: str | None = None, squeeze: bool = True, x_dim: str | None = None, y_dim: str | None = None, warnings: list[str] | None = None) -> tuple[DataFrame, GridMeta]:
    """Cells (y_idx, x_idx, y, x, value) and metadata. path: Parquet in long form, one row per cell with coordinate
    columns and one column per variable; a file `<path>.json` may hold {"crs": EPSG}. `.nc` needs xarray."""
    if path.endswith(".zarr"):
        return _open_zarr(spark, path, var, squeeze, x_dim, y_dim, warnings)
    if path.endswith(".nc"):
        return _open_array(spark, path, var, squeeze, x_dim, y_dim, warnings)
    frame = spark.read.parquet(path)
    x, y, found = find_dims(frame.columns, x_dim, y_dim)
    if warnings is not None:
        warnings += found
    others = [c for c in frame.columns if c not in (x, y)]
    extra = [c for c in others if c in ("time", "band")]
    own = choose_variable([c for c in others if c not in extra and c not in ("y_idx", "x_idx")], var, warnings)
    if extra and squeeze and frame.select(*extra).distinct().limit(2).count() > 1:
        raise ValueError(f"dimensions {extra} have more than one value")
    xs, ys = _axis(frame, x), _axis(frame, y)
    import json

    crs = json.loads(files.read_text(spark, f"{path}.json")).get("crs") if files.exists(spark, f"{path}.json") else None
    step = lambda v: (v[-1] - v[0]) / (len(v) - 1) if len(v) > 1 else 1.0
    meta = GridMeta(xs[0], ys[-1], step(xs), -step(ys), len(xs), len(ys), crs, x, y)
    cells = frame.select(F.round((F.col(y) - meta.y0) / meta.dy).cast("int").alias("y_idx"), F.round((F.col(x) - meta.x0) / meta.dx).cast("int").alias("x_idx"), F.col(own).cast("double").alias("value"))
    return with_coordinates(cells, meta).select("y_idx", "x_idx", "y", "x", "value"), meta


def _open_zarr(spark: SparkSession, path: str, var: str | None, squeeze: bool, x_dim: str | None, y_dim: str | None, warnings: list[str] | None) -> tuple[DataFrame, GridMeta]:
    arrays, attributes = zarr.open_group(spark, path)
    own = arrays[choose_variable([n for n, a in arrays.items() if n not in a.dims and len(a.dims) > 1], var, warnings)]
    long = [d for d, n in zip(own.dims, own.shape) if n > 1 or not squeeze]
    x, y, found = find_dims(list(own.dims), x_dim, y_dim)
    if warnings is not None:
        warnings += found
    if extra := [d for d in long if d not in (x, y)]:
        raise ValueError(f"dimensions {extra} have more than one value")
    xs, ys = (zarr.read_axis(spark, arrays[d]) if d in arrays else [float(i) for i in range(own.shape[own.dims.index(d)])] for d in (x, y))
    step = lambda v: (v[-1] - v[0]) / (len(v) - 1) if len(v) > 1 else 1.0
    crs = attributes.get("crs", own.attributes.get("crs"))
    meta = GridMeta(xs[0], ys[0], step(xs), step(ys), len(xs), len(ys), None if crs is None else int(crs), x, y)
    cells = zarr.read_cells(spark, own).select(F.col(f"i{own.dims.index(y)}").alias("y_idx"), F.col(f"i{own.dims.index(x)}").alias("x_idx"), "value")
    return with_coordinates(cells, meta).select("y_idx", "x_idx", "y", "x", "value"), meta


def _open_array(spark: SparkSession, path: str, var: str | None, squeeze: bool, x_dim: str | None, y_dim: str | None, warnings: list[str] | None) -> tuple[DataFrame, GridMeta]:
    try:
        import xarray
    except ImportError as e:
        raise ImportError("reading NetCDF needs xarray; convert the raster to Parquet instead") from e
    data = xarray.open_dataset(path)
    own = data[choose_variable(list(data.data_vars), var, warnings)]
    own = own.squeeze() if squeeze else own
    x, y, found = find_dims(list(own.dims), x_dim, y_dim)
    if warnings is not None:
        warnings += found
    own = own.transpose(y, x)
    xs, ys = [float(v) for v in own[x].values], [float(v) for v in own[y].values]
    meta = GridMeta(xs[0], ys[0], xs[1] - xs[0] if len(xs) > 1 else 1.0, ys[1] - ys[0] if len(ys) > 1 else 1.0, len(xs), len(ys), own.attrs.get("crs"), x, y)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(own.values)], "y_idx int, v array<double>")
    cells = rows.select("y_idx", F.posexplode("v").alias("x_idx", "value"))
    return with_coordinates(cells, meta).select("y_idx", "x_idx", "y", "x", "value"), meta
