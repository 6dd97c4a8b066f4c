"""Where a poll stands relative to the availability intervals of its day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuspulse.functions import text, time
from statuspulse.params import DEFAULTS, Settings, clock_minutes

KEYS = ("site_id",)


def minute_lookup(intervals: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """For each minute of the day, the first interval by start that has not ended.

    An interval owns the minutes after the latest end of those that start before it, up to
    its own end, inclusive.  The lookup holds at most 1440 rows per site and weekday.
    """
    by_start = Window.partitionBy(*keys, "dow").orderBy("start_min", "end_min")
    earlier = by_start.rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.max("end_min").over(earlier) + 1, F.lit(0))
    return (
        intervals.select(*keys, "dow", "start_min", "end_min")
        .withColumn("_first", first)
        .where(F.col("_first") <= F.col("end_min"))
        .select(
            *keys,
            "dow",
            "start_min",
            "end_min",
            F.explode(F.sequence("_first", "end_min")).alias("now_min"),
        )
    )


def at_local(polls: DataFrame, *, settings: Settings = DEFAULTS, local: str | None = None) -> DataFrame:
    """Add the local time, weekday and minute of every poll."""
    now = F.col(local) if local else time.to_local(F.col("ts"), settings.zone)
    return polls.withColumn("local_ts", now).withColumns(
        {
            "dow": F.dayofweek("local_ts"),
            "now_min": time.minute_of_day(F.col("local_ts")),
        }
    )


def with_position(found: DataFrame) -> DataFrame:
    """Whether a poll is inside the interval found for it."""
    return found.withColumn("in_interval", F.col("now_min") >= F.col("start_min"))


def next_interval(
    polls: DataFrame,
    intervals: DataFrame,
    *,
    settings: Settings = DEFAULTS,
    keys: Sequence[str] = KEYS,
    local: str | None = None,
) -> DataFrame:
    """Add the current or next interval of the day to every poll; NULLs when none is left.

    An equality join on (site, weekday, minute): one match per poll, no range comparison,
    and the polls of a busy site spread over the minutes of its week.  No side is forced to
    broadcast; Spark does so when the lookup is under its size threshold.
    ``local`` names a column that already holds local time.
    """
    at = at_local(polls, settings=settings, local=local)
    return with_position(at.join(minute_lookup(intervals, keys=keys), [*keys, "dow", "now_min"], "left"))


def lookahead_alerts(placed: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    """Polls that call for a forecast notice, before throttling.

    Nothing available but an interval starts within the look-ahead; or something available
    but the interval ends within it, unless it runs to the end of the day.  Not at weekends.
    """
    start, end, now = F.col("start_min"), F.col("end_min"), F.col("now_min")
    ahead = now + settings.lookahead_minutes
    inside = F.col("in_interval")
    kind = F.when(
        ~inside & (ahead >= start) & (F.col("avail") == 0), F.lit("available")
    ).when(
        inside
        & (end < clock_minutes(settings.end_of_day))
        & (ahead >= end)
        & (F.col("avail") > 0),
        F.lit("unavailable"),
    )
    available = F.col("kind") == "available"
    return (
        placed.where(~F.col("dow").isin(1, 7))
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .withColumn("edge_min", F.when(available, start).otherwise(end))
        .withColumns(
            {
                "minutes_ahead": F.col("edge_min") - now,
                "duration_text": text.duration_text(F.col("edge_min") - now),
                "edge_text": text.clock_of_minute(F.col("edge_min")),
            }
        )
        .withColumn(
            "text",
            F.when(
                available,
                F.format_string(
                    text.AVAILABLE_TEXT,
                    F.col("duration_text"),
                    F.col("edge_text"),
                    text.duration_text(end - start),
                ),
            ).otherwise(
                F.format_string(
                    text.UNAVAILABLE_TEXT, F.col("duration_text"), F.col("edge_text")
                )
            ),
        )
    )


def throttle(
    alerts: DataFrame,
    *,
    settings: Settings = DEFAULTS,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Emit a notice only for another interval, or when the last notice is old enough.

    After any candidate the last notified interval is that candidate's own: it was either
    emitted or suppressed as a repeat.  So each unbroken stretch of candidates for one
    interval is independent of all others.  An interval lies within one day, the same one a
    week later is long past the throttle, and two intervals of a day do not alternate since
    the look-up moves forward with time.  The groups therefore are (site, date, interval): at
    most the polls of one site during one interval of one day.

    Within a group the choice is greedy - each notice depends on the one before - which no
    window frame expresses; it is a fold over the group's ordered times.
    """
    if settings.notify_interval_minutes >= 6 * 24 * 60:
        raise ValueError("a throttle of days would reach into next week's intervals")
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(settings.notify_interval_minutes))
    columns = alerts.columns

    def step(told: Column, row: Column) -> Column:
        due = (F.size(told) == 0) | (row["ts"] > F.element_at(told, -1)["ts"] + gap)
        return F.when(due, F.array_append(told, row)).otherwise(told)

    row = F.struct("ts", *(c for c in columns if c != "ts"))
    grouped = alerts.groupBy(
        *keys, F.to_date("local_ts").alias("_date"), "start_min", "end_min"
    ).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    none = F.slice("_rows", 1, 0)
    return grouped.select(F.inline(F.aggregate("_rows", none, step))).select(*columns)


def current_prediction(
    notices: DataFrame, sites: DataFrame, *, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The prediction record of every site: its latest notice, or type ``none``."""
    fields = ("kind", "duration_text", "edge_text")
    last = notices.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col("ts")).alias("_last"))
    return sites.join(last, list(keys), "left").select(
        *keys,
        F.coalesce("_last.kind", F.lit("none")).alias("predictiontype"),
        F.coalesce("_last.duration_text", F.lit("")).alias("durationstr"),
        F.coalesce("_last.edge_text", F.lit("")).alias("datestr"),
    )
