"""From raw outlet readings to slot counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuspulse.functions import time
from statuspulse.operators.sequence import IS_HALO, with_halo
from statuspulse.params import DEFAULTS, STATUSES, Settings

OUTLET_KEY = ("site_id", "device_id", "outlet_id")


def calendar_columns(settings: Settings, start: str = "slot_start") -> dict[str, Column]:
    """Calendar parts of a local time; day of week 1 is Sunday."""
    return {
        "slot_date": F.to_date(start),
        "dow": F.dayofweek(start),
        "hour": F.hour(start),
        "slot": time.minute_slot(F.col(start), settings.slot_minutes),
    }


def with_slots(readings: DataFrame, *, settings: Settings = DEFAULTS, ts: str = "ts") -> DataFrame:
    """Add local time and its calendar parts to GMT readings."""
    return readings.withColumn("local_ts", time.to_local(F.col(ts), settings.zone)).withColumns(
        calendar_columns(settings, "local_ts")
    )


def condense(
    readings: DataFrame,
    *,
    settings: Settings = DEFAULTS,
    keys: Sequence[str] = OUTLET_KEY,
    statuses: Sequence[str] | None = STATUSES,
) -> DataFrame:
    """First reading of every outlet in every slot, by event time.

    This is an aggregate, not a window: readings of a slot are reduced before the shuffle,
    so neither a chatty outlet nor a crowded slot makes a large task.  The hour that
    repeats when clocks go back counts as two passes, as two runs of the clock would.  Where
    the zone's slots are GMT slots, only the slots that remain are converted to local time.

    With a status vocabulary every aggregate is the ``min`` of a timestamp and stays in the
    generated hash aggregate: the status of the first reading is the one whose own first
    time is the first time of all.  A status outside the vocabulary still creates its slot,
    with a NULL status.  ``statuses=None`` keeps any text, at the price of a sort-based
    aggregate.  Equal times of one outlet go to the status named first.
    """
    gmt, zone, width = F.col("ts").cast("timestamp_ntz"), settings.zone, settings.slot_minutes
    aligned = time.slots_align(zone, width)
    clock = gmt if aligned else time.to_local(gmt, zone)
    slot = [F.to_date(clock).alias("_date"), time.slot_of_day(clock, width).alias("_at")]
    if not aligned:
        # GMT slots tell the two passes of a repeated hour apart, local ones do not
        slot.append(time.is_second_pass(gmt, zone).alias("_again"))
    slotted = readings.select(*keys, *slot, gmt.alias("ts"), "status")
    group = slotted.groupBy(*(c for c in slotted.columns if c not in ("ts", "status")))
    if statuses is None:
        first = group.agg(F.min(F.struct("ts", "status")).alias("_first")).withColumns(
            {"ts": F.col("_first.ts"), "status": F.col("_first.status")}
        )
    else:
        first = first_status(group, statuses, F.min)
    start = time.slot_start(F.col("_date"), F.col("_at"), width)
    local = first.withColumn("slot_start", time.to_local(start, zone) if aligned else start)
    return local.withColumns(calendar_columns(settings)).select(
        *keys, "ts", "status", "slot_start", "slot_date", "dow", "hour", "slot"
    )


def first_status(group, statuses: Sequence[str], extreme) -> DataFrame:
    """Time and status of the earliest (``F.min``) or latest (``F.max``) row of a group."""
    found = group.agg(
        extreme("ts").alias("ts"),
        *(extreme(F.when(F.col("status") == s, F.col("ts"))).alias(f"_{s}") for s in statuses),
    )
    hit = [F.when(F.col(f"_{s}") == F.col("ts"), F.lit(s)) for s in statuses]
    return found.withColumn("status", F.coalesce(*hit)).drop(*(f"_{s}" for s in statuses))


def suppress_repeats(
    readings: DataFrame,
    *,
    keys: Sequence[str] = ("device_id", "outlet_id"),
    order: Sequence[str],
    chunk: Column,
) -> DataFrame:
    """Arrival-order form: keep a reading whose slot differs from the outlet's previous one.

    Works on slotted readings.  Runs of equal slots within one local hour keep their first
    reading; a clock that steps back starts a new run.  ``chunk`` must not decrease along
    ``order``; it splits the hour of a hot outlet over several tasks.
    """
    hour_key = [*keys, "slot_date", "hour"]
    w = Window.partitionBy(*hour_key, "_chunk").orderBy(*order)
    return (
        with_halo(
            readings.withColumn("_chunk", chunk), hour_key, "_chunk", order, 1, carry=["slot"]
        )
        .withColumn("_previous", F.lag("slot").over(w))
        .where(~F.col(IS_HALO) & ~F.col("slot").eqNullSafe(F.col("_previous")))
        .drop("_previous", "_chunk", IS_HALO)
    )


def slot_counts(
    condensed: DataFrame, *, settings: Settings = DEFAULTS, keys: Sequence[str] = ("site_id",)
) -> DataFrame:
    """Status counts per slot.  Every reading creates its slot; a slot may count 0 available."""
    counts = condensed.groupBy(*keys, "slot_start").agg(
        *(
            F.count_if(F.col("status") == status).alias(name)
            for status, name in (
                ("available", "avail_count"),
                ("in_use", "in_use_count"),
                ("unknown", "unknown_count"),
            )
        ),
        F.count("*").alias("reading_count"),
    )
    return counts.withColumns(calendar_columns(settings))


def over_capacity(counts: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    return counts.where(F.col("avail_count") > settings.capacity)


def exclude_devices(
    readings: DataFrame, devices: DataFrame | Sequence, device: str = "device_id"
) -> DataFrame:
    """Drop ignored devices: a short list, or a table of any size with the same column."""
    if isinstance(devices, DataFrame):
        return readings.join(devices.select(device), device, "left_anti")
    return readings.where(~F.col(device).isin(list(devices)))


def managed_devices(
    readings: DataFrame, devices: DataFrame | Sequence, device: str = "device_id"
) -> DataFrame:
    if isinstance(devices, DataFrame):
        return readings.join(devices.select(device), device, "left_semi")
    return readings.where(F.col(device).isin(list(devices)))


def with_holiday(slots: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Holiday flag by date; false for all without a holiday table (column ``slot_date``)."""
    if holidays is None:
        return slots.withColumn("holiday", F.lit(False))
    days = holidays.select("slot_date").distinct().withColumn("_holiday", F.lit(True))
    return (
        slots.join(days, "slot_date", "left")
        .withColumn("holiday", F.coalesce("_holiday", F.lit(False)))
        .drop("_holiday")
    )
