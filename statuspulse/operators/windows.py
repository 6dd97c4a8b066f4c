"""Availability windows in a forecast week, their schedule rows and their insights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuspulse import params
from statuspulse.functions import text, time
from statuspulse.params import DEFAULTS, Settings, clock_minutes


def availability_windows(
    forecast: DataFrame,
    *,
    settings: Settings = DEFAULTS,
    count: str = "countavailable",
    keys: Sequence[str] = ("site_id",),
) -> DataFrame:
    """Runs of slots with enough available outlets, per site and day of week.

    A window opens at a count of ``open_at`` and closes at a count of ``close_at`` or at the
    end of the day; the closing slot is its end and does not open another.  It is kept when
    at least ``min_slots`` slots continued it.  A count that is high enough to open and low
    enough to close toggles; one between the two levels of a hysteresis holds the state.

    The state of a slot follows from the last slot that fixed it (the anchor) and, while
    toggling, from the number of slots since.  Groups are one day of one site.
    """
    opening, closing = settings.open_at, settings.close_at
    day = [*keys, "dow"]
    ordered = Window.partitionBy(*day).orderBy("_at")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    n = F.col(count)
    anchor = F.when((n > closing) & (n >= opening), 1).when((n <= closing) & (n < opening), 0)
    slots = forecast.select(
        *day,
        (F.col("hour") * settings.slots_per_hour + F.col("slot")).alias("_at"),
        anchor.alias("_anchor"),
    ).withColumn("_rn", F.row_number().over(ordered))
    anchored = F.when(F.col("_anchor").isNotNull(), F.col("_rn"))
    state = F.coalesce(F.last("_anchor", ignorenulls=True).over(so_far), F.lit(0))
    since = F.col("_rn") - F.coalesce(F.max(anchored).over(so_far), F.lit(0))
    active = F.pmod(state + since, F.lit(2)) if opening <= closing else state

    runs = (
        slots.withColumn("_active", active)
        .withColumn("_before", F.lag("_active", 1, 0).over(ordered))
        .withColumn("_starts", ((F.col("_active") == 1) & (F.col("_before") == 0)).cast("int"))
        .withColumn("_run", F.sum("_starts").over(so_far))
        .where((F.col("_active") == 1) | (F.col("_before") == 1))
        .groupBy(*day, "_run")
        .agg(
            F.min(F.when(F.col("_starts") == 1, F.col("_at"))).alias("start_slot"),
            F.max("_at").alias("end_slot"),
            (F.sum("_active") - 1).cast("int").alias("n_cont"),
        )
        .where(F.col("n_cont") >= settings.min_slots)
    )
    number = Window.partitionBy(*day).orderBy("start_slot")
    return runs.select(
        *day,
        F.row_number().over(number).alias("window_no"),
        (F.col("start_slot") * settings.slot_minutes).cast("int").alias("start_min"),
        (F.col("end_slot") * settings.slot_minutes).cast("int").alias("end_min"),
        "n_cont",
    )


def with_clock_parts(windows: DataFrame) -> DataFrame:
    """Hour and minute columns of both window edges."""
    return windows.withColumns(
        {
            f"{edge}_{part}": value.cast("int")
            for edge in ("start", "end")
            for part, value in (
                ("hour", F.floor(F.col(f"{edge}_min") / 60)),
                ("minute", F.pmod(f"{edge}_min", F.lit(60))),
            )
        }
    )


def window_schedule(windows: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    """Schedule rows: a name, and both edges on the reference week in GMT."""
    dow, start, end = F.col("dow"), F.col("start_min"), F.col("end_min")
    return windows.withColumns(
        {
            "name": text.window_name(settings.window_label, dow, start, end),
            "start_utc": time.reference_week_gmt(dow, start, settings.zone),
            "end_utc": time.reference_week_gmt(dow, end, settings.zone),
        }
    )


def insights(
    windows: DataFrame, *, settings: Settings = DEFAULTS, keys: Sequence[str] = ("site_id",)
) -> DataFrame:
    """One sentence per notable window, by its place in the day.

    The only window of a day stands for the entire day, however short.  The first of several
    gives the morning insight when it ends early enough, the last the afternoon insight, and
    those between a numbered midday insight when they start early and last long enough.
    """
    day = [*keys, "dow"]
    by_start = Window.partitionBy(*day).orderBy("start_min")
    place = windows.withColumns(
        {
            "_n": F.count("*").over(Window.partitionBy(*day)),
            "_i": F.row_number().over(by_start),
        }
    )
    start, end, dow = F.col("start_min"), F.col("end_min"), F.col("dow")
    first, last = F.col("_i") == 1, F.col("_i") == F.col("_n")
    midday_fits = (start <= clock_minutes(settings.midday_max_start)) & (
        end - start >= settings.midday_min_minutes
    )
    late_enough = F.lit(True)
    if settings.apply_afternoon_min_start:
        late_enough = start >= clock_minutes(settings.afternoon_min_start)
    kind = (
        F.when(F.col("_n") == 1, params.ALL_DAY)
        .when(first, F.when(end <= clock_minutes(settings.morning_max_end), params.MORNING))
        .when(last, F.when(late_enough, params.AFTERNOON).otherwise(params.MIDDAY))
        .when(midday_fits, params.MIDDAY)
    )
    of_kind = Window.partitionBy(*day, "type").orderBy("start_min")
    midday = F.col("type") == params.MIDDAY
    msg = (
        F.when(F.col("type") == params.ALL_DAY, text.all_day_text(dow))
        .when(F.col("type") == params.MORNING, text.morning_text(dow, end))
        .when(midday, text.midday_text(dow, start, end))
        .otherwise(text.afternoon_text(dow, start))
    )
    return (
        place.withColumn("type", kind)
        .where(F.col("type").isNotNull())
        .withColumn("order", F.when(midday, F.row_number().over(of_kind)).otherwise(F.lit(0)))
        .withColumn("msg", msg)
        .drop("_n", "_i")
    )
