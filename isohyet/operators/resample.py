"""Resampling: time bins, a list of aggregates for each column, a minimum number of samples."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isohyet.functions.frequency import Frequency, bin_label, labels_between
from isohyet.functions.missing import nan_to_null

#: What known columns are aggregated by.
DEFAULT_AGGREGATES = {
    "tair_2m": ["mean", "min", "max"],
    "relative_humidity": ["mean"],
    "precipitation": ["sum"],
    "sun_duration": ["sum"],
    "solar_radiation": ["sum"],
}

#: A name, or a function from the value column (and, if it takes two, the time column) to an aggregate. A grouped-aggregate
#: pandas UDF is one too, if all aggregates are (Spark doesn't mix them with its own) and nothing is masked.
Aggregate = str | Callable[..., Column]

#: Missing values are skipped throughout; a sum of none is 0; first and last follow time.
AGGREGATES: dict[str, Callable[[Column, Column], Column]] = {
    "mean": lambda c, t: F.avg(c),
    "sum": lambda c, t: F.coalesce(F.sum(c), F.lit(0.0)),
    "max": lambda c, t: F.max(c),
    "min": lambda c, t: F.min(c),
    "median": lambda c, t: F.median(c),
    "first": lambda c, t: F.min_by(c, F.when(c.isNotNull(), t)),
    "last": lambda c, t: F.max_by(c, F.when(c.isNotNull(), t)),
}


def aggregate_of(spec: Aggregate) -> tuple[str, Callable[[Column, Column], Column]]:
    """Name and function of an aggregate. Names are compared without case and surrounding space."""
    if callable(spec):
        name = getattr(spec, "__name__", "custom")
        takes = getattr(getattr(spec, "__code__", None), "co_argcount", 1)
        return ("custom" if name == "<lambda>" else name), (spec if takes > 1 else lambda c, t: spec(c))
    name = str(spec).strip().lower()
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate {spec!r}; known: {', '.join(sorted(AGGREGATES))}")
    return name, AGGREGATES[name]


class Resampler:
    """Which aggregates each column gets. A column that the map lacks gets the default; with default None it is dropped."""

    def __init__(self, colmap: Mapping[str, Aggregate | Sequence[Aggregate]] | None = None, default: Aggregate | None = "mean"):
        self.colmap = {k: [v] if isinstance(v, str) or callable(v) else list(v) for k, v in (DEFAULT_AGGREGATES if colmap is None else colmap).items()}
        self.default = default
        for own in [*self.colmap.values(), [default] if default is not None else []]:
            for spec in own:
                aggregate_of(spec)

    def plan(self, schema: T.StructType, keys: Sequence[str], min_sample_size: int, time: Column) -> list[Column]:
        """Aggregate expressions, masked where a group has too few values."""
        out = []
        for field in schema:
            if field.name in keys:
                continue
            specs = self.colmap.get(field.name, [] if self.default is None else [self.default])
            if specs and field.name not in self.colmap and not isinstance(field.dataType, (T.NumericType, T.BooleanType)):
                raise ValueError(f"column {field.name!r} is {field.dataType.simpleString()}: name an aggregate for it or make it a key")
            value = F.col(f"`{field.name}`")
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                value = nan_to_null(value)
            for spec in specs:
                name, function = aggregate_of(spec)
                result = function(value, time)
                if min_sample_size > 1:
                    result = F.when(F.count(value) >= min_sample_size, result)
                alias = field.name if len(specs) == 1 else f"{field.name}_{name}"
                out.append(result.alias("tair_2m" if alias == "tair_2m_mean" else alias))
        return out

    def apply(self, data: DataFrame, freq: str, datetime_col: str = "datetime", groupby_cols: Sequence[str] | None = None, min_sample_size: int = 1, origin_cols: Sequence[str] = (), sort: bool = True) -> DataFrame:
        """One row per bin and key. Without keys every bin from the first to the last is there. Bins of a frequency that
        counts from the first timestamp count from the first of each origin_cols (a station), or of all data."""
        keys = list(groupby_cols or [])
        if min_sample_size < 1:
            raise ValueError("min_sample_size must be at least 1")
        if lacking := [c for c in (datetime_col, *keys) if c not in data.columns]:
            raise ValueError(f"columns not found: {lacking}")
        step = Frequency.parse(freq)
        kind = data.schema[datetime_col].dataType.simpleString()
        if kind == "string":
            kind, data = "timestamp_ntz", data.withColumn(datetime_col, F.expr(f"try_cast(`{datetime_col}` AS timestamp_ntz)"))
        elif kind == "date":
            kind, data = "timestamp_ntz", data.withColumn(datetime_col, F.col(datetime_col).cast("timestamp_ntz"))
        data = data.filter(F.col(datetime_col).isNotNull())
        time = F.col(f"`{datetime_col}`")
        plan = self.plan(data.schema, [datetime_col, *keys], min_sample_size, F.col("_time"))
        if not plan:
            found = data.select(datetime_col, *keys).distinct()
            return found.orderBy(datetime_col, *keys) if sort else found
        origin = None
        if step.needs_origin:
            firsts = data.groupBy(*origin_cols).agg(F.min(time).alias("_origin"))
            data = data.join(firsts, list(origin_cols)) if origin_cols else data.crossJoin(F.broadcast(firsts))  # one row
            origin = F.col("_origin")
        binned = data.withColumn("_time", time).withColumn(datetime_col, bin_label(time, step, kind, origin)).drop("_origin")
        found = binned.groupBy(datetime_col, *keys).agg(*plan)
        if not keys:
            ends = found.agg(F.min(time).alias("a"), F.max(time).alias("b")).filter("a is not null")
            spine = ends.select(F.explode(labels_between(F.col("a"), F.col("b"), step, kind)).alias(datetime_col))
            empty = binned.limit(0).groupBy().agg(*plan) if min_sample_size == 1 else None
            found = spine.join(found.withColumn("_seen", F.lit(True)), datetime_col, "left")
            if empty is not None:  # what each aggregate is over no rows: 0 for a sum
                blank = empty.select([F.col(f"`{c}`").alias(f"_{c}") for c in empty.columns])
                found = found.crossJoin(F.broadcast(blank)).select(datetime_col, *[F.when(F.col("_seen"), F.col(f"`{c}`")).otherwise(F.col(f"`_{c}`")).alias(c) for c in empty.columns])
            else:
                found = found.drop("_seen")
        shaped = found.select(*keys, datetime_col, *[c for c in found.columns if c not in (*keys, datetime_col)])
        return shaped.orderBy(datetime_col, *keys) if sort else shaped


def apply_resampling(data: DataFrame, freq: str, datetime_col: str = "datetime", groupby_cols: Sequence[str] | None = None, min_sample_size: int = 1, colmap=None, default_aggfunc: Aggregate | None = "mean") -> DataFrame:
    return Resampler(colmap, default_aggfunc).apply(data, freq, datetime_col, groupby_cols, min_sample_size)


def resample_stations(observations: DataFrame, freq: str, datetime_col: str = "datetime", min_sample_size: int = 1, colmap=None, default_aggfunc: Aggregate | None = "mean", groupby_cols: Sequence[str] = ()) -> DataFrame:
    """All stations in one aggregation, station_id being a key; bin origins are each station's own."""
    return Resampler(colmap, default_aggfunc).apply(observations, freq, datetime_col, ["station_id", *groupby_cols], min_sample_size, origin_cols=["station_id"], sort=False)
