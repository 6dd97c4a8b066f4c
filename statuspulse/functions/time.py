"""Time expressions.

Timestamps are ``timestamp_ntz`` holding GMT unless a name says ``local``.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from statuspulse import params

# fixed value: shape of a snapshot's time text, read as GMT
GMT_TEXT = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}$"


def parse_gmt(text: Column) -> Column:
    """GMT text to ``timestamp_ntz``; NULL where the text is not a time."""
    return F.when(text.rlike(GMT_TEXT), text.try_cast("timestamp_ntz"))


def to_local(ts: Column, zone: str) -> Column:
    return _shift(ts.cast("timestamp_ntz"), "UTC", zone)


def to_gmt(local: Column, zone: str) -> Column:
    """The earlier of the two instants for a local time that occurs twice."""
    return _shift(local, zone, "UTC")


def _shift(ts: Column, source: str, target: str) -> Column:
    """Wall clock of one zone to that of another.

    In a GMT session a ``timestamp_ntz`` casts to ``timestamp`` unchanged, and the functions
    that prepare their zone once do the work; ``convert_timezone``, which looks it up for
    every row and costs several times as much, serves the other sessions.
    """
    if source == target:
        return ts
    if _session_is_gmt() and "UTC" in (source, target):
        instant = ts.cast("timestamp")
        if source == "UTC":
            return F.from_utc_timestamp(instant, target).cast("timestamp_ntz")
        return F.to_utc_timestamp(instant, source).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(source), F.lit(target), ts)


def _session_is_gmt() -> bool:
    session = SparkSession.getActiveSession()
    return session is not None and session.conf.get("spark.sql.session.timeZone") in (
        "UTC", "Etc/UTC", "GMT", "Z",
    )


@lru_cache
def slot_shift(zone: str, slot_minutes: int) -> int | None:
    """Minutes by which the zone's slots begin after GMT slots; None if that changes over time.

    Offsets are looked at month by month over 1972 to 2099.
    """
    info = ZoneInfo(zone)
    days = (datetime(year, month, 1, tzinfo=info) for year in range(1972, 2100) for month in range(1, 13))
    shifts = {-day.utcoffset() % timedelta(minutes=slot_minutes) for day in days}
    if len(shifts) > 1 or min(shifts) % timedelta(minutes=1):
        return None
    return shifts.pop() // timedelta(minutes=1)


@lru_cache
def offset_range(zone: str) -> int:
    """Minutes between the zone's least and greatest offset, month by month over 1972 to 2099."""
    info = ZoneInfo(zone)
    offsets = [datetime(year, month, 1, tzinfo=info).utcoffset() for year in range(1972, 2100) for month in range(1, 13)]
    return -((min(offsets) - max(offsets)) // timedelta(minutes=1))


def slots_align(zone: str, slot_minutes: int) -> bool:
    """Whether the zone's slots are GMT slots: its offsets are whole numbers of slots."""
    return slot_shift(zone, slot_minutes) == 0


def is_second_pass(gmt: Column, zone: str) -> Column:
    """True within the second pass of the hour that repeats when clocks go back."""
    if zone == "UTC":
        return F.lit(False)
    return to_gmt(to_local(gmt, zone), zone) != gmt


def minute_slot(ts: Column, slot_minutes: int) -> Column:
    """0-based slot within the hour."""
    return F.floor(F.minute(ts) / slot_minutes).cast("int")


def minute_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 60 + F.minute(ts)).cast("int")


def slot_of_day(local: Column, slot_minutes: int) -> Column:
    """0-based slot within the day."""
    return F.floor(minute_of_day(local) / slot_minutes).cast("int")


def slot_start(date: Column, slot_of_day: Column, slot_minutes: int) -> Column:
    minutes = (slot_of_day * slot_minutes).cast("int")
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def minutes_between(start: Column, end: Column) -> Column:
    """Elapsed minutes with fraction, as double."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(60_000_000.0)


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, ts)


def replace_date(ts: Column, year: int, month: int, day: int) -> Column:
    """Same time of day on another date."""
    day_start = F.to_date(ts).cast("timestamp_ntz")
    target = F.make_timestamp_ntz(*(F.lit(v) for v in (year, month, day, 0, 0, 0)))
    return target + (ts - day_start)


def reference_week_gmt(dow: Column, minute: Column, zone: str) -> Column:
    """(day of week, minute of day) on the reference week, as schedule text in GMT."""
    local = F.make_timestamp_ntz(
        F.lit(params.REFERENCE_YEAR),
        F.lit(params.REFERENCE_MONTH),
        F.lit(params.REFERENCE_DAY_BEFORE_SUNDAY) + dow,
        F.floor(minute / 60).cast("int"),
        F.pmod(minute, F.lit(60)).cast("int"),
        F.lit(0),
    )
    return F.date_format(to_gmt(local, zone), params.SCHEDULE_TIME_FORMAT)


def timeline_text(ordinal: Column) -> Column:
    """Ordinal to the synthetic timeline date used by the forecast charts."""
    return F.concat((F.lit(1000) + ordinal).cast("string"), F.lit("-05-05 09:00:00"))
