"""Which days of history to process: look-back, complete days, and the ledger of done days."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, date, datetime, timedelta
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuspulse.functions import time
from statuspulse.params import DEFAULTS, Settings


def within_lookback(date: Column, as_of: datetime, days: int) -> Column:
    """Dates up to ``as_of`` whose midnight is less than ``days`` before it (local time).

    Compares with literals, so a table partitioned by date is pruned.
    """
    return (date > F.lit((as_of - timedelta(days=days)).date())) & (date <= F.lit(as_of.date()))


def _midnight(day: date, zone: str) -> Column:
    """The local midnight a day starts with, as a GMT literal."""
    return _gmt(datetime(day.year, day.month, day.day), zone)


def _gmt(local: datetime, zone: str) -> Column:
    gmt = local.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC).replace(tzinfo=None)
    return F.lit(gmt.isoformat(" ")).cast("timestamp_ntz")


def readings_within(
    readings: DataFrame, *, as_of: datetime, settings: Settings = DEFAULTS, ts: str = "ts"
) -> DataFrame:
    """Raw GMT readings of the local days inside the look-back, up to ``as_of``.

    The bounds are literals on the stored column, so files and row groups are skipped before
    any zone is converted.  A table partitioned by ``dir_date``, the day an archive was
    collected, is pruned too: a reading is taken to be collected within ``collect_days`` of its
    time; ``outside`` tells how many were not.  A reading without a folder day is always read.
    """
    first = (as_of - timedelta(days=settings.train_days)).date() + timedelta(days=1)
    inside = (F.col(ts) >= _midnight(first, settings.zone)) & (F.col(ts) <= _gmt(as_of, settings.zone))
    return _near_days(readings, first, as_of.date(), settings).where(inside)


def _near_days(readings: DataFrame, first: date, last: date, settings: Settings) -> DataFrame:
    """Folder days ``collect_days`` wider than the local days, where there are folder days."""
    if "dir_date" not in readings.columns:
        return readings
    wide = timedelta(days=settings.collect_days)
    near = F.col("dir_date").between(F.lit(first - wide), F.lit(last + wide))
    return readings.where(near | F.col("dir_date").isNull())


def outside(readings: DataFrame, *, settings: Settings = DEFAULTS, ts: str = "ts") -> DataFrame:
    """dir_date, readings: how many were collected later (or earlier) than ``collect_days`` allows.

    Without a zone map these are not found under their own day.
    """
    days = F.datediff("dir_date", F.to_date(time.to_local(F.col(ts), settings.zone)))
    far = readings.where(F.abs(days) > settings.collect_days)
    return far.groupBy("dir_date").agg(F.count("*").alias("readings"))


def readings_of_days(
    readings: DataFrame,
    days: Sequence[date],
    *,
    settings: Settings = DEFAULTS,
    ts: str = "ts",
    folders: Sequence[date] | None = None,
) -> DataFrame:
    """Raw GMT readings of the given local days, one literal range per run of days.

    ``folders`` are the folder days that hold them, where a zone map tells.
    """
    ordered = sorted(set(days))
    ranges, start = [], ordered[0]
    for day, following in zip(ordered, [*ordered[1:], None], strict=True):
        after = day + timedelta(days=1)
        if following != after:
            stored = F.col(ts)
            ranges.append(
                (stored >= _midnight(start, settings.zone)) & (stored < _midnight(after, settings.zone))
            )
            start = following
    inside = reduce(lambda a, b: a | b, ranges)
    if folders is not None:
        listed = F.col("dir_date").isin(list(folders)) | F.col("dir_date").isNull()
        return readings.where(listed).where(inside)
    return _near_days(readings, ordered[0], ordered[-1], settings).where(inside)


def candidate_days(
    table: DataFrame, *, as_of: datetime, settings: Settings = DEFAULTS, date: str = "slot_date"
) -> DataFrame:
    """Distinct days inside the look-back; partition values alone answer this."""
    inside = within_lookback(F.col(date), as_of, settings.train_days)
    return table.where(inside).select(date).distinct()


def without_newest(days: DataFrame, *, date: str = "slot_date") -> DataFrame:
    """All days but the newest, which may still be filling.  One day or none leaves nothing."""
    # one row a day: the list is as short as the look-back
    in_order = F.sort_array(F.collect_set(date))
    return days.agg(in_order.alias("_days")).select(
        F.explode(F.slice("_days", F.lit(1), F.greatest(F.size("_days") - 1, F.lit(0)))).alias(date)
    )


def complete_days(
    table: DataFrame, *, as_of: datetime, settings: Settings = DEFAULTS, date: str = "slot_date"
) -> DataFrame:
    """Rows of the days inside the look-back, but for the newest day.

    Both bounds are single values compared with the date column, so they prune partitions
    and move no rows.
    """
    inside = table.where(within_lookback(F.col(date), as_of, settings.train_days))
    return inside.where(F.col(date) < inside.agg(F.max(date)).scalar())


def new_days(
    table: DataFrame,
    ledger: DataFrame,
    *,
    as_of: datetime,
    settings: Settings = DEFAULTS,
    date: str = "slot_date",
) -> DataFrame:
    """Days to process now: inside the look-back, not in the ledger, and not the newest left."""
    candidates = candidate_days(table, as_of=as_of, settings=settings, date=date)
    return without_newest(candidates.join(ledger.select(date), date, "left_anti"), date=date)


def has_work(days: DataFrame) -> bool:
    return not days.isEmpty()


def ledger_expired(
    created_at: datetime | None, *, as_of: datetime, settings: Settings = DEFAULTS
) -> bool:
    """A missing ledger, or one older than its lifetime, calls for a full rebuild."""
    if created_at is None:
        return True
    return as_of - created_at > timedelta(days=settings.ledger_expire_days)
