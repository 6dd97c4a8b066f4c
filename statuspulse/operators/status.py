"""The state of the outlets now."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuspulse.operators.slots import OUTLET_KEY, first_status
from statuspulse.params import STATUSES


def latest_readings(readings: DataFrame, *, keys: Sequence[str] = OUTLET_KEY) -> DataFrame:
    """Newest reading per outlet, as a hash aggregate over times.

    A status outside the vocabulary comes back as NULL.
    """
    slim = readings.select(*keys, F.col("ts").cast("timestamp_ntz").alias("ts"), "status")
    return first_status(slim.groupBy(*keys), STATUSES, F.max)


def status_counts(latest: DataFrame, *, by: Sequence[str] = ("site_id",)) -> DataFrame:
    """Counts of the latest readings; the total is the sum of the three known states."""
    counts = latest.groupBy(*by).agg(
        F.max("ts").alias("ts"),
        F.count_if(F.col("status") == "available").alias("avail"),
        F.count_if(F.col("status") == "in_use").alias("in_use"),
        F.count_if(F.col("status") == "unknown").alias("unknown"),
    )
    return counts.withColumn("total", F.col("avail") + F.col("in_use") + F.col("unknown"))


def invalid_status(readings: DataFrame) -> DataFrame:
    """Readings whose status is absent or outside the vocabulary."""
    known = F.col("status").isin(list(STATUSES))
    return readings.where(~F.coalesce(known, F.lit(False)))


def invalid_status_counts(readings: DataFrame, *, by: Sequence[str] = ("device_id",)) -> DataFrame:
    """Data-quality report: how often which invalid status came from where."""
    return (
        invalid_status(readings)
        .groupBy(*by, "status")
        .agg(F.count("*").alias("readings"), F.max("ts").alias("last_ts"))
    )
