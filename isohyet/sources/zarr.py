"""Zarr stores, versions 2 and 3 of the public format, read chunk by chunk on the workers.

Read are arrays of numbers in C order, uncompressed or compressed by zstd, gzip or zlib; anything else is a clear error. A chunk without a file is missing throughout, or has
the fill value where an array's attributes name another one for missing cells.
"""

from __future__ import annotations

import base64
import functools
import json
import math
import zlib
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.sinks import files


@dataclass(frozen=True)
class ZarrArray:
    """An array's place and layout. separator and prefix make chunk names; missing: the stored value that stands for none."""

    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    codec: str | None
    fill: float | None
    missing: float | None
    dims: tuple[str, ...]
    attributes: Mapping[str, object]
    prefix: str = ""
    separator: str = "."

    @property
    def grid(self) -> tuple[int, ...]:
        """Number of chunks along each dimension."""
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks))

    def name(self, at: tuple[int, ...]) -> str:
        return f"{self.path}/{self.prefix}{self.separator.join(map(str, at)) or ('' if self.prefix else '0')}".rstrip("/")

    def decode(self, blob: bytes | None, at: tuple[int, ...]) -> np.ndarray:
        """The part of a chunk that lies inside the array, as doubles; nan where missing."""
        inside = tuple(slice(0, min(c, n - i * c)) for i, c, n in zip(at, self.chunks, self.shape))
        dtype = np.dtype(self.dtype)
        if blob is None:
            stored = np.full(self.chunks, math.nan if self.fill is None else self.fill, "<f8")
        else:
            if self.codec == "zstd":
                blob = pa.Codec("zstd").decompress(blob, math.prod(self.chunks) * dtype.itemsize, asbytes=True)
            elif self.codec is not None:
                blob = zlib.decompress(blob, 47)  # either header
            stored = np.frombuffer(blob, dtype).reshape(self.chunks).astype("<f8")
        values = stored[inside]
        if self.missing is not None and not math.isnan(self.missing):
            values = np.where(values == self.missing, np.nan, values)
        return values * float(self.attributes.get("scale_factor", 1)) + float(self.attributes.get("add_offset", 0))


def _number(value, dtype: str) -> float | None:
    if isinstance(value, str) and value not in ("NaN", "Infinity", "-Infinity"):
        return float(np.frombuffer(base64.b64decode(value), "<f8" if np.dtype(dtype).kind == "f" else "<i8")[0])
    return None if value is None else float(value)


def _version_2(path: str, own: dict, attributes: dict) -> ZarrArray:
    compressor = (own.get("compressor") or {}).get("id")
    if own.get("filters") or own.get("order", "C") != "C" or compressor not in (None, "zstd", "zlib", "gzip"):
        raise ValueError(f"{path}: filters, the order F and the compressor {compressor!r} can't be read")
    fill = _number(own.get("fill_value"), own["dtype"])
    named = attributes.get("_FillValue")
    dims = attributes.get("_ARRAY_DIMENSIONS") or [f"dim_{i}" for i in range(len(own["shape"]))]
    return ZarrArray(path, tuple(own["shape"]), tuple(own["chunks"]), own["dtype"], compressor, fill, fill if named is None else _number(named, own["dtype"]), tuple(dims), attributes, "", own.get("dimension_separator", "."))


def _version_3(path: str, own: dict) -> ZarrArray:
    codecs = {c["name"]: c.get("configuration", {}) for c in own["codecs"]}
    packed = [c for c in codecs if c in ("zstd", "gzip")]
    if set(codecs) - {"bytes", *packed} or len(packed) > 1 or own["chunk_grid"]["name"] != "regular":
        raise ValueError(f"{path}: the codecs {list(codecs)} can't be read")
    dtype = np.dtype(own["data_type"]).newbyteorder("<" if codecs.get("bytes", {}).get("endian", "little") == "little" else ">").str
    key = own.get("chunk_key_encoding", {"name": "default"})
    plain = key["name"] == "v2"
    separator = key.get("configuration", {}).get("separator", "." if plain else "/")
    attributes = own.get("attributes", {})
    dims = own.get("dimension_names") or [f"dim_{i}" for i in range(len(own["shape"]))]
    return ZarrArray(path, tuple(own["shape"]), tuple(own["chunk_grid"]["configuration"]["chunk_shape"]), dtype, packed[0] if packed else None, _number(own.get("fill_value"), dtype), _number(attributes.get("_FillValue"), dtype), tuple(dims), attributes, "" if plain else f"c{separator}", separator)


def open_group(spark: SparkSession, path: str) -> tuple[dict[str, ZarrArray], dict]:
    """A group's arrays by name, and its attributes."""
    read = lambda name: json.loads(files.read_text(spark, f"{path}/{name}")) if files.exists(spark, f"{path}/{name}") else None
    if (group := read("zarr.json")) is not None:
        inner = (group.get("consolidated_metadata") or {}).get("metadata") or {n: own for n in files.folders(spark, path) if (own := read(f"{n}/zarr.json"))}
        return {n: _version_3(f"{path}/{n}", own) for n, own in inner.items() if own["node_type"] == "array"}, group.get("attributes", {})
    if (whole := read(".zmetadata")) is not None:
        every = whole["metadata"]
    elif read(".zgroup") is not None:
        every = {f"{n}/{part}": own for n in files.folders(spark, path) for part in (".zarray", ".zattrs") if (own := read(f"{n}/{part}")) is not None} | {".zattrs": read(".zattrs") or {}}
    else:
        raise ValueError(f"there is no Zarr group at {path}")
    names = [k.removesuffix("/.zarray") for k in every if k.endswith("/.zarray")]
    return {n: _version_2(f"{path}/{n}", every[f"{n}/.zarray"], every.get(f"{n}/.zattrs", {})) for n in names}, every.get(".zattrs", {})


def read_axis(spark: SparkSession, array: ZarrArray) -> list[float]:
    """A coordinate's values, on the driver: as many as the dimension is long."""
    parts = []
    for i in range(array.grid[0]):
        name = array.name((i,))
        parts += array.decode(files.read_bytes(spark, name) if files.exists(spark, name) else None, (i,)).tolist()
    return parts


def _cells(batches, array: ZarrArray):
    store, names = None, [f"i{k}" for k in range(len(array.shape))] + ["value"]
    for batch in batches:
        for number in batch.column(0).to_pylist():
            at = tuple(int(i) for i in np.unravel_index(number, array.grid))
            store, blob = files.get_file(array.name(at), store)
            values = array.decode(blob, at)
            flat, step = values.reshape(-1), 1 << 18
            for s in range(0, flat.size, step):
                part = flat[s : s + step]
                places = np.unravel_index(np.arange(s, s + part.size), values.shape)
                own = [pa.array((p + i * c).astype("int32")) for p, i, c in zip(places, at, array.chunks)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(part, mask=np.isnan(part))], names=names)


def read_cells(spark: SparkSession, array: ZarrArray) -> DataFrame:
    """All cells: their indices i0, i1, ... and the value, null where missing."""
    n = math.prod(array.grid)
    schema = ", ".join([f"i{k} int" for k in range(len(array.shape))] + ["value double"])
    chunks = spark.range(0, n, 1, max(1, min(n, 8 * spark.sparkContext.defaultParallelism)))
    return chunks.mapInArrow(functools.partial(_cells, array=array), schema)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """(var, time, y_idx, x_idx, value) of all arrays over time and two more dimensions, without missing cells. Times must be counted in seconds, minutes, hours or days."""
    arrays, _ = open_group(spark, path)
    out = None
    for name, array in arrays.items():
        if len(array.dims) != 3 or array.dims[0] not in arrays:
            continue
        axis = arrays[array.dims[0]]
        unit, _, since = str(axis.attributes.get("units", "")).partition(" since ")
        # Seconds of the units that times are counted in.
        length = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}.get(unit)
        if length is None:
            raise ValueError(f"times of {path} are counted in {unit!r}")
        steps = spark.createDataFrame(list(enumerate(int(round(v * length)) for v in read_axis(spark, axis))), "i0 int, s long")
        steps = steps.select("i0", F.timestamp_add("SECOND", F.col("s"), F.lit(since.replace("T", " ")).cast("timestamp_ntz")).alias("time"))
        own = read_cells(spark, array).filter("value IS NOT NULL").join(F.broadcast(steps), "i0").select(F.lit(name).alias("var"), "time", F.col("i1").alias("y_idx"), F.col("i2").alias("x_idx"), "value")
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError(f"there is no array over time at {path}")
    return out
