"""Pricing failed runs as they arrive: a streaming form of the cost aggregation (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.runs import failed
from stratalog.operators.cost import priced


def cost_per_window(runs: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Machine time of failed runs by job and window of their start; runs later than ``late`` are dropped."""
    bad = priced(runs.where(failed(F.col("conclusion")))).withColumn("started_at", F.col("started_at").cast("timestamp"))
    return (
        bad.withWatermark("started_at", late)
        .groupBy(F.window("started_at", window), "job")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.sum("wall_micros").alias("wall_micros"), F.sum("billable_micros").alias("billable_micros"))
    )
