"""An extension for live data: daily station means over a stream, with late values up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_means(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(stn, d, value, n) of a stream or table with stn, ts and value; a day is final once it is `late` old."""
    days = events.withWatermark("ts", late).groupBy("stn", F.window("ts", "1 day").alias("w"))
    return days.agg(F.avg("value").alias("value"), F.count("value").alias("n")).select("stn", F.to_date("w.start").alias("d"), "value", "n")
