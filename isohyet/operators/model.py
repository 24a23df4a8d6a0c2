"""Elevation regressions, all parameters and dates in one aggregation, evaluated on the grid in one plan."""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from isohyet.sinks import files

#: The largest table of fits that is broadcast to the grid's cells: rows of some 50 bytes.
MOST_BROADCAST_FITS = 200_000
#: Blocks of residuals that a task holds: cells, fits and places of fits (32 bytes each). Blocks of cells are smaller where tasks would be few.
MOST_CELLS, LEAST_CELLS, MOST_FITS, MOST_PLACES = 8_192, 1_024, 384, 2_000_000


@dataclass(frozen=True)
class VerticalModel:
    """Least squares of a value on elevation. Where elevation doesn't vary the slope is 0 and the intercept the mean."""

    fit_intercept: bool = True
    positive: bool = False

    def get_params(self) -> dict:
        return {"fit_intercept": self.fit_intercept, "positive": self.positive}

    def set_params(self, **changes) -> VerticalModel:
        return replace(self, **changes)

    def coefficients(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Slope and intercept as aggregates."""
        if self.fit_intercept:
            # Not by the variance: merged from parts, that of equal values may be above 0.
            slope = F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(F.regr_slope(y, x))
        else:
            slope = F.when(F.sum(x * x) == 0, F.lit(0.0)).otherwise(F.sum(x * y) / F.sum(x * x))
        if self.positive:
            slope = F.greatest(slope, F.lit(0.0))
        return slope, (F.avg(y) - slope * F.avg(x)) if self.fit_intercept else F.lit(0.0)

    def fit(self, samples: DataFrame, keys: tuple[str, ...] = ("param", "interp_date"), x: str = "elevation", y: str = "y", skip_missing: bool = False) -> DataFrame:
        """One row per key: n, slope, intercept. A sample without elevation fails the fit unless skip_missing."""
        own = samples.filter(F.col(y).isNotNull())
        if skip_missing:
            own = own.filter(F.col(x).isNotNull())
        xc = F.col(x).cast("double") if skip_missing else F.coalesce(F.col(x).cast("double"), F.raise_error(F.lit("a sample has no elevation")).cast("double"))
        own = own.select(*keys, xc.alias("_x"), F.col(y).cast("double").alias("_y"))
        slope, intercept = self.coefficients(F.col("_x"), F.col("_y"))
        return own.groupBy(*keys).agg(F.count("*").alias("n"), slope.alias("slope"), intercept.alias("intercept"))

    def value_on(self, value: Column) -> Column:
        """A fit's value where the elevation is `value`."""
        return F.col("intercept") + F.col("slope") * value

    def predict(self, fits: DataFrame, cells: DataFrame, value: str = "value", keep: tuple[str, ...] = ("y_idx", "x_idx"), regions: str | None = None) -> DataFrame:
        """Each fit on each cell (of its region): the fits' keys, the cells' indices, value."""
        keys = [c for c in fits.columns if c not in ("n", "slope", "intercept")]
        own = cells.select(*keep, *([regions] if regions else []), F.col(value).cast("double").alias("_e"))
        return each_on_each(fits, own, regions).select(*keys, *keep, self.value_on(F.col("_e")).alias("value"))


def each_on_each(fits: DataFrame, cells: DataFrame, regions: str | None = None, most: int | None = None) -> DataFrame:
    """Each fit with each cell. Fits are as many as dates times parameters: up to `most` rows, counted first, they go to the cells. Beyond that
    both sides are cut into blocks, 32 of fits by 32 of cells, and each pair of blocks is a task's work."""
    most = MOST_BROADCAST_FITS if most is None else most
    few = fits.limit(most + 1).count() <= most
    if regions is not None:
        return cells.join(F.broadcast(fits) if few else fits, regions)
    if few:
        return cells.crossJoin(F.broadcast(fits))
    blocks = F.sequence(F.lit(0), F.lit(31))
    left = cells.withColumn("_c", F.pmod(F.xxhash64(*cells.columns), F.lit(32)).cast("int")).withColumn("_f", F.explode(blocks))
    right = fits.withColumn("_f", F.pmod(F.xxhash64(*fits.columns), F.lit(32)).cast("int")).withColumn("_c", F.explode(blocks))
    return left.join(right, ["_c", "_f"]).drop("_c", "_f")


def interpolate_all(samples: DataFrame, cells: DataFrame, model: VerticalModel | None = None, residual_model=None, cross_validator=None, regions: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Fits, fields (param, interp_date, y_idx, x_idx, value), and cross-validation scores if a validator is given. regions: a column of samples and cells;
    each region then has fits of its own, and its cells get no others."""
    own, keys = model or VerticalModel(), ("param", "interp_date", *([regions] if regions else []))
    fits = files.land(own.fit(samples, keys))
    scores = cross_validator.scores(samples, own, keys) if cross_validator is not None else None
    field = own.predict(fits, cells, regions=regions) if residual_model is None else residual_model.corrected(own, samples, fits, cells, keys, regions)
    return fits, field, scores


def interpolate(samples: DataFrame, cells: DataFrame, model: VerticalModel | None = None, residual_model=None, cross_validator=None, regions: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """As interpolate_all(), without the fits."""
    return interpolate_all(samples, cells, model, residual_model, cross_validator, regions)[1:]


class LeaveOneOut:
    """Beyond what the pipeline needs: errors of each sample predicted by the others of its group, in closed form from
    group sums (one window over the group, no refits). For models with an intercept and no sign constraint."""

    def errors(self, samples: DataFrame, keys: tuple[str, ...] = ("param", "interp_date"), x: str = "elevation", y: str = "y") -> DataFrame:
        group = Window.partitionBy(*keys)
        xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
        n, sx, sy = F.count("*").over(group), F.sum(xs).over(group), F.sum(ys).over(group)
        sxx, sxy = F.sum(xs * xs).over(group), F.sum(xs * ys).over(group)
        own = samples.filter(xs.isNotNull() & ys.isNotNull()).withColumns({"_n": n, "_sx": sx, "_sy": sy, "_sxx": sxx, "_sxy": sxy}).filter("_n > 1")
        m, ox, oy = F.col("_n") - 1, F.col("_sx") - xs, F.col("_sy") - ys
        spread = (F.col("_sxx") - xs * xs) - ox * ox / m
        slope = F.when(spread <= 1e-9 * F.greatest(F.lit(1.0), F.col("_sxx")), 0.0).otherwise(((F.col("_sxy") - xs * ys) - ox * oy / m) / spread)
        return own.withColumn("predicted", oy / m + slope * (xs - ox / m)).withColumn("error", F.col("predicted") - ys).drop("_n", "_sx", "_sy", "_sxx", "_sxy")

    def scores(self, samples: DataFrame, model: VerticalModel | None = None, keys: tuple[str, ...] = ("param", "interp_date")) -> DataFrame:
        if model is not None and (model.positive or not model.fit_intercept):
            raise NotImplementedError("the closed form is for models with an intercept and no sign constraint")
        return self.errors(samples, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.avg("error").alias("bias"), F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))


@dataclass(frozen=True)
class InverseDistance:
    """Beyond what the pipeline needs: residuals at stations, spread to cells by inverse distance. samples need x and y
    of their station as station_x and station_y, cells x and y."""

    power: float = 2.0

    def corrected(self, model: VerticalModel, samples: DataFrame, fits: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ("param", "interp_date"), regions: str | None = None) -> DataFrame:
        """The model's field with the residuals added. Weights follow from places alone, so a fit's stations of one place are summed first, and a block of cells
        has its weights made once for all fits of a block: a product of matrices. Stations without a place or a value count nowhere."""
        residual = samples.join(fits, list(keys)).select(*keys, F.col("station_x").cast("double").alias("x"), F.col("station_y").cast("double").alias("y"), (F.col("y") - model.value_on(F.col("elevation"))).alias("r"))
        places = residual.filter("x <> double('NaN') AND y <> double('NaN') AND r IS NOT NULL").groupBy(*keys, "x", "y").agg(F.count("*").cast("double").alias("n"), F.sum("r").alias("r"))
        stations = files.land(places.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "n", "r")).alias("_stations")))
        whole = fits.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
        n_fits, n_places = stations.agg(F.count("*"), F.coalesce(F.sum(F.size("_stations")), F.lit(0))).first()
        kept = ("y_idx", "x_idx")
        own = cells.select(*kept, *([regions] if regions else []), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"), F.col("value").cast("double").alias("_e"))
        n_cells, at_once = own.count(), 2 * cells.sparkSession.sparkContext.defaultParallelism
        by_cell = max(1, -(-n_cells // MOST_CELLS), min(-(-n_cells // LEAST_CELLS), at_once))
        by_fit = max(1, -(-n_fits // MOST_FITS), -(-n_places // MOST_PLACES))
        at = ([regions] if regions else []) + ["_c", "_f"]
        cut = lambda names, n: F.pmod(F.xxhash64(*names), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = own.withColumn("_c", cut(kept, by_cell)).withColumn("_f", each(by_fit))
        fitted = whole.select(*keys, "slope", "intercept").join(stations, list(keys), "left")
        right = fitted.withColumn("_f", cut(keys, by_fit)).withColumn("_c", each(by_cell))
        parts = 2 * by_cell * by_fit
        left, right = (side.repartition(parts, *at).groupBy(*at) for side in (left, right))
        names = [*keys, *kept, "_e", "slope", "intercept"]
        types = {f.name: f.dataType for f in [*own.schema, *fitted.schema]}
        schema = T.StructType([*(T.StructField(k, types[k]) for k in names), T.StructField("_moved", T.DoubleType())])
        moved = left.cogroup(right).applyInArrow(functools.partial(_moved, power=self.power, keys=tuple(keys), kept=kept), schema)
        return moved.select(*keys, *kept, (model.value_on(F.col("_e")) + F.col("_moved")).alias("value"))


def _moved(cells: pa.Table, fits: pa.Table, power: float, keys: tuple[str, ...], kept: tuple[str, ...]) -> pa.Table:
    """Each fit of a block on each cell of a block, with the residuals' weighted mean there: a batch a fit."""
    names = [*keys, *kept, "_e", "slope", "intercept", "_moved"]
    if not cells.num_rows or not fits.num_rows:
        types = {f.name: f.type for f in [*cells.schema, *fits.schema]} | {"_moved": pa.float64()}
        return pa.table([pa.array([], types[k]) for k in names], names=names)
    cells = cells.combine_chunks()
    lists = fits.column("_stations").combine_chunks()
    of = np.repeat(np.arange(fits.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    x, y, n, r = (lists.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(4))
    place, which = np.unique(x + 1j * y, return_inverse=True)
    order = np.argsort(which, kind="stable")
    of, n, r, which = of[order], n[order], r[order], which[order]
    cx, cy = (cells.column(k).to_numpy() for k in ("_x", "_y"))
    sums = np.zeros((cells.num_rows, 2 * fits.num_rows))
    for s in range(0, len(place), 1024):
        some = place[s : s + 1024]
        a, b = np.searchsorted(which, [s, s + len(some)])
        stations = np.zeros((len(some), 2 * fits.num_rows))
        np.add.at(stations, (which[a:b] - s, of[a:b]), n[a:b])
        np.add.at(stations, (which[a:b] - s, fits.num_rows + of[a:b]), r[a:b])
        for c in range(0, cells.num_rows, 2048):
            d2 = np.maximum((some.real - cx[c : c + 2048, None]) ** 2 + (some.imag - cy[c : c + 2048, None]) ** 2, 1e-12)
            sums[c : c + 2048] += (1 / d2 if power == 2 else d2 ** (-power / 2)) @ stations
    nowhere = pc.or_(pc.is_null(cells.column("_x")), pc.is_null(cells.column("_y"))).to_numpy()
    batches = []
    for i in range(fits.num_rows):
        w, r = sums[:, i], sums[:, fits.num_rows + i]
        lacking = nowhere | (w == 0)
        moved = pa.array(r / np.where(lacking, 1, w), mask=lacking)
        one = lambda k: pa.repeat(fits.column(k)[i], cells.num_rows)  # noqa: B023, E731
        columns = [*map(one, keys), *(cells.column(k).chunk(0) for k in (*kept, "_e")), one("slope"), one("intercept"), moved]
        batches.append(pa.RecordBatch.from_arrays(columns, names=names))
    return pa.Table.from_batches(batches)


def fill_gaps(frame: DataFrame, column: str, datetime_col: str = "datetime", keys: tuple[str, ...] = ("station_id",), most_rows: int = 6) -> DataFrame:
    """Beyond what the pipeline needs: a missing value takes the last one before it, at most most_rows rows back."""
    back = Window.partitionBy(*keys).orderBy(datetime_col).rowsBetween(-most_rows, 0)
    return frame.withColumn(column, F.last(column, ignorenulls=True).over(back))
