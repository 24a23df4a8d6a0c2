"""Missing values: inside the engine they are NULL; NaN is only met at the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(column: Column) -> Column:
    return F.when(~F.isnan(column), column)


def normalize_nan(frame: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, in one projection."""
    floating = [f.name for f in frame.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return frame.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in floating}) if floating else frame


def is_close(a, b, rel: float = 1e-9, abs_: float = 0.0) -> bool:
    """Driver-side comparison of two resolutions or coordinates."""
    return abs(a - b) <= max(rel * max(abs(a), abs(b)), abs_)
