"""An upsertable cube (var, time, y, x): Parquet partitioned by variable and time, and a manifest.

The manifest holds the time axis, grid, variables, chunks and encoding; it is all that creating a cube writes. A write is checked against it on
the driver and by one small job, then replaces the cells it has: whole time slices by dynamic partition overwrite; slices that cover only a part of the grid are first
joined with what is there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.functions.frequency import Frequency
from isohyet.operators.grid_meta import GridMeta
from isohyet.sinks import files
from isohyet.sinks.registry import Writer

#: Numeric types that cells may be stored as.
DTYPES = {"int8": "byte", "int16": "short", "int32": "int", "float32": "float", "float64": "double"}
#: Cells of a slice that go to one task.
MOST_CELLS = 1 << 20
RANGES = {"int8": 2**7, "int16": 2**15, "int32": 2**31}


@dataclass(frozen=True)
class Encoding:
    """How cells are stored: rint(value / scale_factor) as dtype, missing ones as fill_value."""

    dtype: str | None = None
    scale_factor: float = 1.0
    fill_value: float | None = None

    def __post_init__(self):
        if self.dtype is not None and self.dtype not in DTYPES:
            raise ValueError(f"unknown dtype {self.dtype!r}; known: {', '.join(DTYPES)}")

    def encode(self, column):
        value = column.cast("double") if self.scale_factor == 1 else column.cast("double") / F.lit(self.scale_factor)
        if self.dtype in RANGES:
            value = F.rint(value)
            most = RANGES[self.dtype]
            value = F.when(value.between(-most, most - 1), value).when(value.isNotNull(), F.raise_error(F.lit(f"a value doesn't fit {self.dtype}")).cast("double"))
        value = value if self.fill_value is None else F.coalesce(value, F.lit(float(self.fill_value)))
        return value.cast(DTYPES[self.dtype or "float64"])

    def decode(self, column):
        value = column.cast("double")
        value = value if self.fill_value is None else F.when(value != F.lit(float(self.fill_value)), value)
        return value if self.scale_factor == 1 else value * F.lit(self.scale_factor)


@dataclass(frozen=True)
class Manifest:
    start: str
    end: str
    freq: str
    variables: tuple[str, ...]
    grid: GridMeta
    chunks: Mapping[str, tuple[int, ...]] | None = None
    encoding: Encoding = field(default_factory=Encoding)
    attributes: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.variables:
            raise ValueError("a cube needs at least one variable")
        if self.grid.crs is None:
            raise ValueError("a cube needs a CRS")
        if min(self.grid.shape) < 1:
            raise ValueError("a cube needs a shape")
        Frequency.parse(self.freq)

    def to_json(self) -> str:
        own = asdict(self) | {"grid": json.loads(self.grid.to_json()), "attributes": {**self.attributes, "crs": self.grid.crs}}
        return json.dumps(own, sort_keys=True, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        own = json.loads(text)
        chunks = {k: tuple(v) for k, v in own["chunks"].items()} if own["chunks"] else None
        return cls(own["start"], own["end"], own["freq"], tuple(own["variables"]), GridMeta.from_json(json.dumps(own["grid"])), chunks, Encoding(**own["encoding"]), {k: v for k, v in own["attributes"].items() if k != "crs"})

    def axis(self, spark: SparkSession) -> DataFrame:
        """The time axis, column time."""
        ends = spark.range(1).select(F.lit(self.start).cast("timestamp_ntz").alias("a"), F.lit(self.end).cast("timestamp_ntz").alias("b"))
        return ends.select(F.explode(F.sequence("a", "b", Frequency.parse(self.freq).interval())).alias("time"))


def regular_chunks(size: int, chunk: int) -> tuple[int, ...]:
    """A dimension's chunk lengths for one chunk size."""
    return (chunk,) * (size // chunk) + ((size % chunk,) if size % chunk else ())


class CubeWriter(Writer, key="zarr"):
    """The key is what configurations call the cube's format."""

    def __init__(self, path: str, start, end, freq: str, variables: Sequence[str], shape: Mapping[str, int] | None = None, coords: Mapping[str, Sequence[float]] | None = None, crs: int | None = None,
                 chunks: Mapping[str, int | Sequence[int]] | None = None, fill_value: float | None = None, scale_factor: float = 1.0, dtype: str | None = None, drop_attrs: bool = True,
                 append_dims: Sequence[str] = ("time",), align: bool = True, method: str = "nearest"):
        if isinstance(variables, str) or not variables:
            raise ValueError("variables must be a list of at least one name")
        for name, own in (("shape", shape), ("coords", coords), ("chunks", chunks)):
            if own is not None and not isinstance(own, Mapping):
                raise ValueError(f"{name} must be a mapping")
        if shape is not None and len(shape) != 2 or coords is not None and len(coords) != 2:
            raise ValueError("shape and coords must have two dimensions, y and x")
        if shape is not None and coords is not None and (lacking := [k for k, n in shape.items() if len(coords.get(k, ())) != n]):
            raise ValueError(f"coords and shape differ in {lacking}")
        if tuple(append_dims) != ("time",):
            raise ValueError("only time can be appended to")
        self.path, self.start, self.end, self.freq, self.variables = path, str(start), str(end), freq, tuple(variables)
        self.shape, self.coords, self.crs, self.chunks = shape, coords, crs, chunks
        self.encoding = Encoding(dtype, scale_factor, fill_value)
        self.drop_attrs, self.align, self.method = drop_attrs, align, method

    def _grid(self, meta: GridMeta) -> GridMeta:
        """The given specification, held against the first data's grid; what was not given is taken from there."""
        if self.shape is not None and tuple(self.shape.values()) != meta.shape:
            raise ValueError(f"shape does not match: {tuple(self.shape.values())} and {meta.shape}")
        if self.coords is not None and not _same([*self.coords.values()], [meta.ys(), meta.xs()]):
            self._refuse_coordinates()
        if self.crs is not None and meta.crs is not None and self.crs != meta.crs:
            raise ValueError(f"CRS does not match: {self.crs} and {meta.crs}")
        return replace(meta, crs=meta.crs if meta.crs is not None else self.crs)

    def _refuse_coordinates(self):
        if self.align:
            raise NotImplementedError("aligning other coordinate values is not implemented")
        raise ValueError("coordinate values do not match")

    def _chunk_lengths(self, grid: GridMeta, chunks) -> dict[str, tuple[int, ...]] | None:
        sizes = {"y": grid.ny, "x": grid.nx, grid.y_dim: grid.ny, grid.x_dim: grid.nx}
        return {k: regular_chunks(sizes[k], v) if isinstance(v, int) else tuple(v) for k, v in chunks.items() if k in sizes} if chunks else None

    def manifest(self, spark: SparkSession) -> Manifest | None:
        at = f"{self.path}/manifest.json"
        return Manifest.from_json(files.read_text(spark, at)) if files.exists(spark, at) else None

    def create(self, spark: SparkSession, grid: GridMeta | None = None, overwrite: bool = False, attributes: Mapping[str, str] | None = None) -> Manifest:
        """Writes the manifest. An existing cube stays as it is unless overwrite."""
        if (there := self.manifest(spark)) is not None and not overwrite:
            return there
        if grid is None:
            if self.coords is None or self.crs is None:
                raise ValueError("without data a cube needs coords and a CRS")
            ys, xs = ([float(v) for v in c] for c in self.coords.values())
            step = lambda v: v[1] - v[0] if len(v) > 1 else 1.0
            grid = GridMeta(xs[0], ys[0], step(xs), step(ys), len(xs), len(ys), self.crs)
            if not _same([ys, xs], [grid.ys(), grid.xs()]):
                raise ValueError("coordinates must be evenly spaced")
        own = Manifest(self.start, self.end, self.freq, self.variables, grid, self._chunk_lengths(grid, self.chunks), self.encoding, dict(attributes or {}))
        if there is not None:
            files.delete(spark, f"{self.path}/cells")
        files.write_text(spark, f"{self.path}/manifest.json", own.to_json())
        return own

    def write(self, data: DataFrame, meta: GridMeta | None = None, overwrite: bool = False, chunks: Mapping[str, int | Sequence[int]] | None = None, attributes: Mapping[str, str] | None = None) -> Manifest:
        """Puts cells (var, time, y_idx, x_idx, value) into the cube. overwrite starts a new cube."""
        if meta is None:
            raise ValueError("the grid's metadata is needed")
        spark = data.sparkSession
        if "var" not in data.columns:
            data = data.withColumn("var", F.lit(self.variables[0]))
        own = self.manifest(spark)
        if own is None or overwrite:
            own = self.create(spark, self._grid(meta), overwrite, attributes)
        else:
            self._check_grid(own, meta)
            if not self.drop_attrs and attributes:
                own = replace(own, attributes={**own.attributes, **attributes})
                files.write_text(spark, f"{self.path}/manifest.json", own.to_json())
        given, kept = self._chunk_lengths(meta, chunks), own.chunks
        if given and kept and any(given[k] != kept[k] for k in given if k in kept):
            raise ValueError(f"chunks do not match: {given} and {dict(kept)}")
        data = data.withColumn("time", F.col("time").cast("timestamp_ntz"))
        (y, ny), (x, nx) = zip(own.grid.first, own.grid.shape)
        inside = F.col("y_idx").between(y, y + ny - 1) & F.col("x_idx").between(x, x + nx - 1)
        slices = data.groupBy("var", "time").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("out")).join(own.axis(spark).withColumn("_known", F.lit(True)), "time", "left")
        found = slices.agg(F.collect_set(F.when(~F.col("var").isin(*own.variables), F.col("var"))).alias("vars"), F.min(F.when(F.col("_known").isNull(), F.col("time"))).alias("time"), F.min("n").alias("least"), F.sum("out").alias("out")).first()
        if found["vars"]:
            raise ValueError(f"unknown variables: {sorted(found['vars'])}")
        if found["time"] is not None:
            raise ValueError(f"time {found['time']} is not on the cube's axis")
        if found["out"]:
            raise ValueError(f"{found['out']} cells are outside the cube's grid of {own.grid.shape}")
        fresh = data.select("var", "time", F.col("y_idx").cast("int").alias("y_idx"), F.col("x_idx").cast("int").alias("x_idx"), F.col("value").cast("double").alias("value"))
        aside = None
        if found["least"] is not None and found["least"] < meta.nx * meta.ny and files.exists(spark, f"{self.path}/cells"):
            # A folder of this write's own: partitions can't be replaced while they are read.
            aside = f"{self.path}/pending-{uuid.uuid4().hex}"
            fresh = self._merged(spark, fresh, aside)
        stored = fresh.withColumn("value", own.encoding.encode(F.col("value"))).withColumn("time_key", F.date_format("time", "yyyy-MM-dd'T'HHmmss")).drop("time")
        # A slice's rows go to tasks by blocks, so that a task's size doesn't follow the grid's.
        block = F.floor((F.col("y_idx") - y) / max(1, MOST_CELLS // nx))
        order = ("var", "time_key", "y_idx", "x_idx")
        stored.repartition("var", "time_key", block).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("var", "time_key").parquet(f"{self.path}/cells")
        if aside is not None:
            files.delete(spark, aside)
        return own

    def _merged(self, spark: SparkSession, fresh: DataFrame, aside: str) -> DataFrame:
        """Old and new cells of the slices that fresh touches, as a table beside the cube."""
        upsert(self.read(spark).join(fresh.select("var", "time").distinct(), ["var", "time"], "left_semi"), fresh).write.mode("overwrite").parquet(aside)
        return spark.read.parquet(aside)

    def _check_grid(self, own: Manifest, meta: GridMeta) -> None:
        if meta.crs is not None and meta.crs != own.grid.crs:
            raise ValueError(f"CRS does not match: {own.grid.crs} and {meta.crs}")
        if meta.shape != own.grid.shape:
            raise ValueError(f"shape does not match: {own.grid.shape} and {meta.shape}")
        if not _same([own.grid.ys(), own.grid.xs()], [meta.ys(), meta.xs()]):
            self._refuse_coordinates()

    def read(self, spark: SparkSession, variables: Sequence[str] | None = None) -> DataFrame:
        """Decoded cells (var, time, y_idx, x_idx, value). Filters on var and time prune partitions."""
        own = self.manifest(spark)
        return self.stored(spark, variables).withColumn("value", own.encoding.decode(F.col("value")))

    def stored(self, spark: SparkSession, variables: Sequence[str] | None = None) -> DataFrame:
        """The cells of read() with the values as they are stored."""
        own = self.manifest(spark)
        kind = {"byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType()}[DTYPES[own.encoding.dtype or "float64"]]
        schema = T.StructType([T.StructField("y_idx", T.IntegerType()), T.StructField("x_idx", T.IntegerType()), T.StructField("value", kind), T.StructField("var", T.StringType()), T.StructField("time_key", T.StringType())])
        cells = spark.read.schema(schema).parquet(f"{self.path}/cells")
        if variables is not None:
            cells = cells.filter(F.col("var").isin(*variables))
        time = F.to_timestamp_ntz("time_key", F.lit("yyyy-MM-dd'T'HHmmss"))
        return cells.select("var", time.alias("time"), "y_idx", "x_idx", "value")


def _same(a: Sequence[Sequence[float]], b: Sequence[Sequence[float]]) -> bool:
    return all(len(p) == len(q) and all(abs(x - y) <= 1e-9 for x, y in zip(p, q)) for p, q in zip(a, b))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("var", "time", "y_idx", "x_idx")) -> DataFrame:
    """Old rows whose key the new ones lack, and all new rows."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def unknown_times(data: DataFrame, axis: DataFrame, column: str = "time") -> DataFrame:
    """Rows whose time is not on an axis."""
    return data.join(axis.select(F.col("time").alias(column)), column, "left_anti")
