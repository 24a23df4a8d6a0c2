"""Beyond the batch pipeline: observations as a stream, resampled with a watermark and appended to a cube batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from isohyet.functions.missing import nan_to_null
from isohyet.operators.grid_meta import GridMeta
from isohyet.sinks.cube import CubeWriter


def stream_resample(events: DataFrame, window: str, delay: str, datetime_col: str, keys: Sequence[str], value: str, min_sample_size: int = 1) -> DataFrame:
    """Mean, minimum, maximum and count of fixed windows; a window is final when the watermark has passed it. first and last, which
    need all of a group's rows in order, are left to the batch operator."""
    own = nan_to_null(F.col(value).cast("double"))
    binned = events.withWatermark(datetime_col, delay).groupBy(F.window(datetime_col, window).alias("_w"), *keys)
    counted = binned.agg(F.avg(own).alias("mean"), F.min(own).alias("min"), F.max(own).alias("max"), F.count(own).alias("n"))
    return counted.filter(F.col("n") >= min_sample_size).select(*keys, F.col("_w.start").alias(datetime_col), "mean", "min", "max", "n")


def append_to_cube(fields: DataFrame, writer: CubeWriter, meta: GridMeta, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Upserts each micro-batch of cells (var, time, y_idx, x_idx, value). A repeated batch replaces the same cells, so a restart leaves no trace."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            writer.write(batch, meta)

    return fields.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
