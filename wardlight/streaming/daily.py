"""Daily means of sensor readings as a stream (an extension: the batch form is operators.tables.daily_mean)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_mean_stream(readings: DataFrame, low: float, high: float, late: str = "1 day") -> DataFrame:
    """(station, day, mean, n) of a stream of (station, ts, value), ts a timestamp; readings later than `late` behind the newest are left out."""
    ok = readings.where((F.col("value") > low) & (F.col("value") <= high)).withWatermark("ts", late)
    grouped = ok.groupBy("station", F.window("ts", "1 day").alias("w")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    return grouped.select("station", F.to_date("w.start").alias("day"), "mean", "n")
