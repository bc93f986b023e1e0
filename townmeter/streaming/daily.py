"""Hourly grid values to local days as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from townmeter.functions.climate import nan_to_null


def stream_daily(hours: DataFrame, node: str = "node", ts: str = "ts", value: str = "t2m", zone: str = "Europe/Paris", late: str = "2 days") -> DataFrame:
    """(node, day, tmax, tmin) of a stream of hours; a day comes out once, when the watermark has passed its end.

    The watermark is on local time, so that a day is a window of it; hours that come later than
    `late` behind the newest are dropped. Days of 23 or 25 hours are whole, as local clocks show them.
    """
    local = hours.select(F.col(node).alias("node"), F.from_utc_timestamp(F.col(ts), zone).alias("local"), nan_to_null(F.col(value).cast("double")).alias("v"))
    days = local.withWatermark("local", late).groupBy("node", F.window("local", "1 day"))
    return days.agg(F.max("v").alias("tmax"), F.min("v").alias("tmin")).select("node", F.to_date("window.start").alias("day"), "tmax", "tmin")
