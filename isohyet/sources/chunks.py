"""Requests' date ranges, cut into closed chunks."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions.frequency import Frequency


def date_chunks(start: datetime, end: datetime, freq: str, n_days: int, split_years: bool = False) -> list[tuple[datetime, datetime]]:
    """Closed [from, to] chunks of n_days less one step; the next begins one step later. With split_years none crosses a year's end
    (in wall time). A chunk without length gets one step."""
    if end < start:
        raise ValueError("the end is before the start")
    step, chunks, at = timedelta(seconds=Frequency.parse(freq).seconds), [], start
    while at <= end:
        to = min(at + timedelta(days=n_days) - step, end)
        if split_years:
            to = min(to, datetime(at.year + 1, 1, 1, tzinfo=at.tzinfo) - step)
        chunks.append((at, max(to, at + step) if to <= at else to))
        at = chunks[-1][1] + step
    return chunks


def chunk_table(spark: SparkSession, start, end, freq: str, n_days: int) -> DataFrame:
    """As date_chunks() without years, made by the engine: chunk_start, chunk_end."""
    step = Frequency.parse(freq).seconds
    one = spark.range(1).select(F.lit(str(start)).cast("timestamp_ntz").alias("a"), F.lit(str(end)).cast("timestamp_ntz").alias("b"))
    starts = one.select(F.explode(F.sequence("a", "b", F.expr(f"make_interval(0, 0, 0, {n_days})"))).alias("chunk_start"), "b")
    return starts.select("chunk_start", F.least(F.col("chunk_start") + F.expr(f"make_interval(0, 0, 0, {n_days}, 0, 0, {-step})"), F.col("b")).alias("chunk_end"))
