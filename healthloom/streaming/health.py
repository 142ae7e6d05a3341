"""Scores of a stream of findings: windows with a watermark, and an upsert of the latest state per place.

The batch operators do the same on a table; these keep only what open windows
and known places need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.findings import CATEGORIES, TIERS


def windowed_impact(stream: DataFrame, time: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Points and counts per window, module and category; rows later than ``late`` are dropped by the watermark."""
    points = F.lit(0)
    for tier, p in TIERS.items():
        points = F.when(F.col("tier") == tier, p).otherwise(points)
    held = stream.filter(F.col("eligible") & F.col("category").isin(list(CATEGORIES))).withWatermark(time, late)
    rows = held.groupBy(F.window(time, window).alias("w"), "module", "category").agg(F.sum(points).alias("points"), F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "module", "category", "points", "n")


def first_seen(stream: DataFrame, keys: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first arrival of each place within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
