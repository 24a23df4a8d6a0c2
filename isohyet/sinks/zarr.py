"""A cube as a Zarr store (version 2 of the public format, consolidated), chunks written by the tasks that hold their cells.

Chunks are one time step by the manifest's lengths of y and x, zstd at level 3. Values are stored as the cube stores them; a chunk without cells has no file. The
metadata come last, so a store that can be opened is whole.
"""

from __future__ import annotations

import functools
import json
import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.sinks import files
from isohyet.sinks.cube import CubeWriter, Manifest

LEVEL = 3
#: A chunk's length where the manifest names none.
LONGEST = 512


def chunk_length(size: int, lengths: tuple[int, ...] | None) -> int:
    """The store's one chunk length of a dimension; only the last of its chunks may be shorter."""
    if not lengths:
        return min(size, LONGEST)
    if sum(lengths) != size or any(n != lengths[0] for n in lengths[:-1]) or not 0 < lengths[-1] <= lengths[0]:
        raise ValueError(f"a Zarr store can't have chunks of {lengths} of {size}")
    return lengths[0]


def compress(blob: bytes) -> bytes:
    return pa.Codec("zstd", LEVEL).compress(blob, asbytes=True)


def array_metadata(shape, chunks, dtype: str, fill, compressor: bool = True) -> dict:
    fill = "NaN" if isinstance(fill, float) and math.isnan(fill) else fill
    return {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype, "compressor": {"id": "zstd", "level": LEVEL} if compressor else None, "fill_value": fill, "order": "C", "filters": None}


def _blob(dtype: str, fill: float, shape: tuple[int, int], group: pd.DataFrame) -> pd.DataFrame:
    values = np.full(shape, fill, dtype)
    own = group["value"].to_numpy()
    there = ~pd.isna(own)
    values[group["y"].to_numpy()[there], group["x"].to_numpy()[there]] = own[there].astype(dtype)
    return pd.DataFrame({"name": [group["name"].iloc[0]], "content": [compress(values.tobytes())]})


def chunk_files(stored: DataFrame, axis: DataFrame, manifest: Manifest, dtype: str, fill: float, chunks: tuple[int, int]) -> DataFrame:
    """(name, content): one file per chunk that has cells. stored: var, time, y_idx, x_idx and the value as stored; axis: time and its place t."""
    cy, cx = chunks
    y, x = F.col("y_idx") - manifest.grid.first[0], F.col("x_idx") - manifest.grid.first[1]
    name = F.concat_ws(".", "t", F.floor(y / cy).cast("long"), F.floor(x / cx).cast("long"))
    cells = stored.join(F.broadcast(axis), "time").select(F.concat_ws("/", "var", name).alias("name"), (y % cy).alias("y"), (x % cx).alias("x"), "value")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        return _blob(dtype, fill, (cy, cx), group)

    return cells.groupBy("name").applyInPandas(one, "name string, content binary")


def export_zarr(spark: SparkSession, cube: CubeWriter, path: str, overwrite: bool = False) -> Manifest:
    """Writes a whole cube to `path`. An existing folder is an error unless overwrite. Integers need a fill value, as days without data are missing."""
    own = cube.manifest(spark)
    if own is None:
        raise ValueError(f"there is no cube at {cube.path}")
    dtype = np.dtype(own.encoding.dtype or "float64").newbyteorder("<")
    if own.encoding.fill_value is None and dtype.kind == "i":
        raise ValueError("a Zarr store of integers needs a fill value")
    fill = math.nan if own.encoding.fill_value is None else own.encoding.fill_value
    given = own.chunks or {}
    chunks = tuple(chunk_length(n, next((given[k] for k in names if k in given), None)) for n, names in ((own.grid.ny, ("y", own.grid.y_dim)), (own.grid.nx, ("x", own.grid.x_dim))))
    if files.exists(spark, path):
        if not overwrite:
            raise ValueError(f"{path} exists already")
        files.delete(spark, path)
    # The axis is an array of the store, so it is small enough for one.
    ends = own.axis(spark).agg(F.sort_array(F.collect_list("time")).alias("times"))
    axis = ends.select(F.posexplode("times").alias("t", "time"))
    # Wall-clock times have no zone; seconds are counted as if it were UTC.
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = [r[0] for r in axis.orderBy("t").select(F.timestamp_diff("SECOND", start, F.col("time"))).collect()]
    if files.exists(spark, f"{cube.path}/cells"):
        blobs = chunk_files(cube.stored(spark), axis, own, dtype.str, fill, chunks)
        blobs.mapInArrow(functools.partial(files.put_files, folder=path), "name string, size long").write.format("noop").mode("overwrite").save()
    _metadata(spark, path, own, seconds, dtype.str, fill, chunks)
    return own


def _metadata(spark: SparkSession, path: str, own: Manifest, seconds: list[int], dtype: str, fill: float, chunks: tuple[int, int]) -> None:
    dims = ["time", own.grid.y_dim, own.grid.x_dim]
    every = {".zgroup": {"zarr_format": 2}, ".zattrs": {**own.attributes, "crs": own.grid.crs}}
    for name, values, kind, code, attributes in (
        ("time", seconds, "<i8", "q", {"units": "seconds since 1970-01-01", "calendar": "proleptic_gregorian"}),
        (own.grid.y_dim, own.grid.ys(), "<f8", "d", {}), (own.grid.x_dim, own.grid.xs(), "<f8", "d", {}),
    ):
        files.write_bytes(spark, f"{path}/{name}/0", compress(struct.pack(f"<{len(values)}{code}", *values)))
        every[f"{name}/.zarray"] = array_metadata([len(values)], [len(values)], kind, None)
        every[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": [name], **attributes}
    stored_fill = int(fill) if "i" in dtype else float(fill)
    for var in own.variables:
        every[f"{var}/.zarray"] = array_metadata([len(seconds), own.grid.ny, own.grid.nx], [1, *chunks], dtype, stored_fill)
        every[f"{var}/.zattrs"] = {"_ARRAY_DIMENSIONS": dims} | ({} if own.encoding.scale_factor == 1 else {"scale_factor": own.encoding.scale_factor})
    for name, content in every.items():
        files.write_text(spark, f"{path}/{name}", json.dumps(content, indent=1))
    files.write_text(spark, f"{path}/.zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": every}, indent=1))
