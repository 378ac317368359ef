"""Payments as a stream: copies dropped within a watermark, totals by calendar window.

The batch operators have no streaming counterpart to match; this is their analogue for
feeds that arrive bit by bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_copies(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key; state is kept as long as a copy may be late."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def totals(stream: DataFrame, group: list[str], ts: str = "ts", width: str = "1 day", late: str = "1 hour", value: str = "value") -> DataFrame:
    """Rows and sums by tumbling window; a window comes out once it can't change."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *group, "n", "total")
