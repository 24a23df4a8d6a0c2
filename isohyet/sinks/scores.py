"""Beyond the pipeline proper: cross-validation scores, kept run by run in a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ScoreStore:
    def __init__(self, path: str):
        self.path = path

    def append(self, scores: DataFrame, run_id: str) -> None:
        """Adds a run's scores, with its id and the time of the write."""
        scores.select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("stored_at"), *scores.columns).write.mode("append").parquet(self.path)

    def read(self, spark: SparkSession, run_id: str | None = None) -> DataFrame:
        stored = spark.read.parquet(self.path)
        return stored if run_id is None else stored.filter(F.col("run_id") == run_id)
