"""Slots from a stream of readings.

Windows are local slots: they are cut in GMT, shifted by what the zone's offset leaves when
divided by the slot width.  In a zone where that changes over time no fixed windows fit, and a
slot is the local one of each reading, as in batch: its key is the local start and whether the
clock shows it for the second time, next to its start in GMT, which is the event time of the
state.  The watermark bounds the state; its delay has to cover how late readings arrive, and at
least a slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuspulse.functions import time
from statuspulse.operators.slots import OUTLET_KEY, calendar_columns, first_status
from statuspulse.params import DEFAULTS, STATUSES, Settings
from statuspulse.streaming.run import with_event_time


#: What tells local slots apart, besides their start in GMT, where no fixed windows fit.
IRREGULAR = ("local_start", "second_pass")


def _shift(settings: Settings) -> int | None:
    return time.slot_shift(settings.zone, settings.slot_minutes)


def slot_key(settings: Settings = DEFAULTS) -> tuple[str, ...]:
    """The columns that name a slot in the output of ``condense``."""
    return ("slot_gmt",) if _shift(settings) is not None else ("slot_gmt", *IRREGULAR)


def _window(settings: Settings):
    return F.window("ts", f"{settings.slot_minutes} minutes", startTime=f"{_shift(settings)} minutes")


def _local_slots(settings: Settings) -> dict[str, Column]:
    zone, width = settings.zone, settings.slot_minutes
    gmt = F.col("ts").cast("timestamp_ntz")
    local = time.to_local(gmt, zone)
    start = time.slot_start(F.to_date(local), time.slot_of_day(local, width), width)
    return {
        "slot_gmt": time.to_gmt(start, zone).cast("timestamp"),
        "local_start": start,
        "second_pass": time.is_second_pass(gmt, zone),
    }


def _by_slot(readings: DataFrame, settings: Settings, delay: str, keys: Sequence[str]):
    if _shift(settings) is not None:
        return with_event_time(readings, delay).groupBy(*keys, _window(settings).alias("w"))
    # a slot's start is before its readings, by a slot and what the clock was put back
    wait = f"{delay} {settings.slot_minutes + time.offset_range(settings.zone)} minutes"
    slotted = readings.withColumns(_local_slots(settings)).withColumn("ts", F.col("ts").cast("timestamp"))
    return slotted.withWatermark("slot_gmt", wait).groupBy(*keys, *slot_key(settings))


def _with_start(counted: DataFrame) -> DataFrame:
    return counted.withColumn("slot_gmt", F.col("w.start")).drop("w") if "w" in counted.columns else counted


def window_counts(
    readings: DataFrame,
    *,
    settings: Settings = DEFAULTS,
    delay: str = "10 minutes",
    keys: Sequence[str] = ("site_id",),
) -> DataFrame:
    """Readings and available readings per site and tumbling window, by its start in GMT.

    Where no fixed windows fit, ``IRREGULAR`` names the local slot.
    """
    counted = _with_start(
        _by_slot(readings, settings, delay, keys).agg(
            F.count_if(F.col("status") == "available").alias("avail_count"),
            F.count("*").alias("reading_count"),
        )
    )
    start, *local = slot_key(settings)
    return counted.select(*keys, F.col(start).alias("slot_start"), *local, "avail_count", "reading_count")


def first_in_slot(
    readings: DataFrame, *, settings: Settings = DEFAULTS, delay: str = "10 minutes",
    keys: Sequence[str] = OUTLET_KEY,
) -> DataFrame:
    """Pass the first reading to arrive for every outlet and slot.

    A reading of the same slot later than the delay would pass again, so a delay shorter than
    a slot is refused.
    """
    spark = readings.sparkSession
    waits = F.expr(f"INTERVAL {delay}") >= F.make_dt_interval(mins=F.lit(settings.slot_minutes))
    if not spark.range(1).select(waits).first()[0]:
        raise ValueError(f"a delay of {delay} is shorter than a slot of {settings.slot_minutes} minutes")
    timed = with_event_time(readings, delay)
    if _shift(settings) is not None:
        slotted = timed.withColumn("slot_start", _window(settings)["start"])
        return slotted.dropDuplicatesWithinWatermark([*keys, "slot_start"])
    slotted = timed.withColumns(_local_slots(settings)).withColumnRenamed("slot_gmt", "slot_start")
    return slotted.dropDuplicatesWithinWatermark([*keys, *IRREGULAR])


def condense(
    readings: DataFrame, *, settings: Settings = DEFAULTS, delay: str = "10 minutes",
    keys: Sequence[str] = OUTLET_KEY,
) -> DataFrame:
    """First reading by event time of every outlet and slot; update mode revises late ones."""
    return _with_start(first_status(_by_slot(readings, settings, delay, keys), STATUSES, F.min))


def localised(condensed: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    """Condensed stream output with local calendar columns, as the batch operator gives them."""
    irregular = "local_start" in condensed.columns
    start = F.col("local_start") if irregular else time.to_local(F.col("slot_gmt"), settings.zone)
    return condensed.withColumn("slot_start", start).withColumns(calendar_columns(settings))
