"""The ``events`` table read as a status log of 16 devices, 2 outlets each, on 4 sites."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuspulse.params import Settings
from statuspulse.session import has_shared_folder, use_shared_folder

# hourly slots suit the density of the given events
SETTINGS = Settings(slot_minutes=60, velocity_counts=(1, 2, 3), notify_interval_minutes=180)


def status_of(event_type):
    return (
        F.when(event_type.isin("click", "view"), "available")
        .when(event_type == "error", "unknown")
        .otherwise("in_use")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def as_readings(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id",
        (F.col("user_id") % 4).alias("site_id"),
        (F.col("user_id") % 16).alias("device_id"),
        (F.col("event_id") % 2 + 1).cast("int").alias("outlet_id"),
        status_of(F.col("event_type")).alias("status"),
        "ts",
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_readings(events(spark, sf_dir))


def ensure_shared_folder(spark: SparkSession) -> None:
    """Where the session names no shared folder, and driver and executors are one process, make one."""
    if not has_shared_folder(spark) and spark.conf.get("spark.master", "").startswith("local["):
        use_shared_folder(tempfile.mkdtemp(prefix="statuspulse-"))
