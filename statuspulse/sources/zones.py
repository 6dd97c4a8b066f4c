"""Zone map of compacted archives: which folder days hold readings of which times.

Archives lie in folders by the day they were collected.  Most readings are of that day, some are
late by days or weeks.  The map has, for every folder day and GMT day of its readings, the least
and the greatest time, the number of readings, and when that was written.  It is a few rows a
folder, so whatever has to know where readings are asks it instead of the readings: which folders
to read for a day, which days there are, and which days that were done have got more since.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuspulse.functions import time
from statuspulse.params import DEFAULTS, Settings
from statuspulse.session import materialise
from statuspulse.sources import tables

ZONES = (
    "day date, least timestamp_ntz, greatest timestamp_ntz, readings long, "
    "written_at timestamp_ntz, dir_date date"
)


def read_zones(spark: SparkSession, root: str) -> DataFrame:
    return tables.read_or_empty(spark, f"{root}/raw_zones", ZONES)


def write_zones(
    spark: SparkSession, root: str, *, days: Sequence[date], written_at: datetime, ts: str = "ts"
) -> None:
    """Map the given folder days of ``root/raw``; a zone that did not change keeps its time.

    A folder day without readings any more loses its zones.
    """
    raw = tables.read_or_empty(spark, f"{root}/raw", f"{ts} timestamp_ntz, dir_date date")
    raw = raw.where(F.col("dir_date").isin(list(days)))
    found = raw.groupBy("dir_date", F.to_date(ts).alias("day")).agg(
        F.min(ts).alias("least"), F.max(ts).alias("greatest"), F.count("*").alias("readings")
    )
    known = read_zones(spark, root)
    what = ("dir_date", "day", "least", "greatest", "readings")
    before = known.select(*(F.col(c).alias(f"_{c}") for c in what), F.col("written_at").alias("_written_at"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in what]
    at = F.lit(written_at.isoformat(" ")).cast("timestamp_ntz")
    joined = found.join(before, same, "left").withColumn("written_at", F.coalesce("_written_at", at))
    # a few rows a folder: written apart first, as they come from the table they replace
    zones = materialise(joined.select("day", "least", "greatest", "readings", "written_at", "dir_date"), "zones")
    kept = known.where(~F.col("dir_date").isin(list(days)) | F.col("dir_date").isNull())
    tables.replace_table(materialise(kept.unionByName(zones), "zones"), f"{root}/raw_zones")


def _local_days(zones: DataFrame, settings: Settings) -> Column:
    """The local days a zone's times may lie in: one or two."""
    first, last = (F.to_date(time.to_local(F.col(c), settings.zone)) for c in ("least", "greatest"))
    return F.explode(F.sequence(first, last))


def days_of(zones: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    """slot_date: the local days that there are readings of, without reading them."""
    return zones.select(_local_days(zones, settings).alias("slot_date")).distinct()


def reopened(zones: DataFrame, ledger: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    """slot_date: days of the ledger with readings that were written after the day was done."""
    done = ledger.groupBy("slot_date").agg(F.max("done_at").alias("done_at"))
    newest = zones.select(_local_days(zones, settings).alias("slot_date"), "written_at")
    newest = newest.groupBy("slot_date").agg(F.max("written_at").alias("written_at"))
    return newest.join(done, "slot_date").where(F.col("written_at") > F.col("done_at")).select("slot_date")


def folders_of(zones: DataFrame, days: Sequence[date], *, settings: Settings = DEFAULTS) -> list[date]:
    """The folder days that hold readings of these local days: at most as many as there are folders."""
    held = zones.select("dir_date", _local_days(zones, settings).alias("slot_date"))
    found = held.where(F.col("slot_date").isin(list(days)) & F.col("dir_date").isNotNull())
    return sorted(row[0] for row in found.select("dir_date").distinct().collect())
