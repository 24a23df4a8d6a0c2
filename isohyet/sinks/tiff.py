"""One GeoTIFF per variable and time step, written by the tasks that hold its cells."""

from __future__ import annotations

import functools
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.operators.grid_meta import GridMeta
from isohyet.sinks import files
from isohyet.sinks.registry import Writer


#: Bytes of cells up to which offsets of 32 bits reach.
SMALL_TIFF = (1 << 32) - (1 << 12)


def encode_tiff(values: bytes, width: int, height: int, x_edge: float, y_edge: float, dx: float, dy: float, epsg: int) -> bytes:
    """An uncompressed little-endian TIFF of 64-bit floats, one strip, with pixel scale, tie point and CRS; a BigTIFF where 32-bit offsets don't reach."""
    big = len(values) > SMALL_TIFF
    whole, head, entry = (16, 16, "<HHQQ") if big else (4, 8, "<HHII")
    geographic = epsg == 4326
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]
    blobs = {33550: struct.pack("<3d", dx, dy, 0.0), 33922: struct.pack("<6d", 0, 0, 0, x_edge, y_edge, 0), 34735: struct.pack(f"<{len(keys)}H", *keys)}
    # TIFF tags (number, type, count, value; None: stored behind the entries).
    entries = [
        (256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 64), (259, 3, 1, 1), (262, 3, 1, 1), (273, whole, 1, None), (277, 3, 1, 1),
        (278, 4, 1, height), (279, whole, 1, len(values)), (339, 3, 1, 3), (33550, 12, 3, None), (33922, 12, 6, None), (34735, 3, len(keys), None),
    ]
    places, at = {}, head + (8 + 20 * len(entries) + 8 if big else 2 + 12 * len(entries) + 4)
    for tag, blob in blobs.items():
        places[tag] = at
        at += len(blob)
    places[273] = at
    out = struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(entries)) if big else struct.pack("<2sHIH", b"II", 42, 8, len(entries))
    for tag, kind, count, value in entries:
        out += struct.pack(entry, tag, kind, count, places[tag] if value is None else value)
    return b"".join([out, struct.pack("<Q" if big else "<I", 0), *blobs.values(), values])


def read_tiff(blob: bytes) -> tuple[int, int, list[float], dict[int, tuple]]:
    """Width, height, values by row, and all tags of a file of encode_tiff()."""
    big = blob[2] == 43
    (n,), first, step, entry = (struct.unpack_from("<Q", blob, 16), 24, 20, "<HHQQ") if big else (struct.unpack_from("<H", blob, 8), 10, 12, "<HHII")
    tags = {}
    for i in range(n):
        tag, kind, count, value = struct.unpack_from(entry, blob, first + step * i)
        tags[tag] = struct.unpack_from(f"<{count}d", blob, value) if kind == 12 else struct.unpack_from(f"<{count}H", blob, value) if kind == 3 and count > 2 else (value,)
    width, height = tags[256][0], tags[257][0]
    return width, height, list(struct.unpack_from(f"<{width * height}d", blob, tags[273][0])), tags


def _file(meta: GridMeta, group: pd.DataFrame) -> pd.DataFrame:
    values = np.full((meta.ny, meta.nx), np.nan)
    values[group["y_idx"].to_numpy() - meta.first[0], group["x_idx"].to_numpy() - meta.first[1]] = group["value"].to_numpy()
    xs, ys = meta.xs(), meta.ys()
    if meta.dy > 0:  # files start at the top
        values, ys = values[::-1], ys[::-1]
    if meta.dx < 0:
        values, xs = values[:, ::-1], xs[::-1]
    rx, ry = meta.res
    blob = encode_tiff(np.ascontiguousarray(values, dtype="<f8").tobytes(), meta.nx, meta.ny, xs[0] - rx / 2, ys[0] + ry / 2, rx, ry, meta.crs or 0)
    return pd.DataFrame({"name": [group["name"].iloc[0]], "content": [blob], "cells": [len(group)]})


def file_name(data: DataFrame):
    """`var.tif`, or with a time `var_yyyy_MM_dd_HHmmss.tif`."""
    var = F.col("var") if "var" in data.columns else F.lit("var")
    return F.concat(var, F.lit(".tif")) if "time" not in data.columns else F.concat(var, F.lit("_"), F.date_format("time", "yyyy_MM_dd_HHmmss"), F.lit(".tif"))


def tiff_files(data: DataFrame, meta: GridMeta) -> DataFrame:
    """(name, content, cells): one file per variable and time. data: var (default `var`), time (optional), y_idx, x_idx,
    value. A group is one raster, so its size is the grid's."""
    def one(group: pd.DataFrame) -> pd.DataFrame:
        return _file(meta, group)

    own = data.select(file_name(data).alias("name"), "y_idx", "x_idx", F.col("value").cast("double").alias("value"))
    return own.groupBy("name").applyInPandas(one, "name string, content binary, cells long")


class TiffWriter(Writer, key="tiff"):
    def __init__(self, path: str):
        self.path = path

    def write(self, data: DataFrame, meta: GridMeta | None = None, overwrite: bool = False) -> list[str]:
        """Names of the written files. An existing file is an error unless overwrite."""
        if meta is None:
            raise ValueError("the grid's metadata is needed")
        names = [r.name for r in data.select(file_name(data).alias("name")).distinct().orderBy("name").toLocalIterator()]
        if not overwrite and (there := [n for n in names if files.exists(data.sparkSession, f"{self.path}/{n}")]):
            raise ValueError(f"files that exist already: {there[:3]}")
        tiff_files(data, meta).mapInArrow(functools.partial(files.put_files, folder=self.path), "name string, size long").write.format("noop").mode("overwrite").save()
        return names
