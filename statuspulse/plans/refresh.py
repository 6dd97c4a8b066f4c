"""Batch refresh: new days into the slot history, then forecast, windows and insights.

Tables below ``root``:

    raw/           readings of the archives, partitioned by folder date
    raw_zones/     which folder dates hold readings of which times (``sources.zones``)
    archive_log/   every archive and what was wrong with it, partitioned by folder date
    readings/      condensed readings, partitioned by slot_date
    ledger/        days done, with the time they were done
    forecast/      predicted week              (replaced each time)
    schedule/      availability windows        (replaced per schedule)
    insights/      sentences                   (replaced each time)

Every step replaces whole tables or partitions and the ledger is written last, so a run that
failed half-way is repeated from the start without harm.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuspulse.operators import forecast, slots, windows
from statuspulse.params import DEFAULTS, OUTLET_CODES, Settings, clock_minutes
from statuspulse.session import materialise
from statuspulse.sources import archives, history, tables, zones

LEDGER = "slot_date date, done_at timestamp_ntz"


def compact_archives(
    spark: SparkSession,
    archive_root: str,
    root: str,
    *,
    days: Sequence[date],
    as_of: datetime,
    site: Column | None = None,
    outlets: Sequence[str] | None = tuple(OUTLET_CODES),
) -> None:
    """Date folders of zip archives to ``root/raw`` and ``root/archive_log``, by folder date.

    Each archive is unzipped once: the parsed documents are written before they are split.
    The log has a row for every archive; those with an error are the quarantine.  Running a
    day again replaces it.  The zone map follows the readings, and the log is written last: a
    run that failed half-way is repeated.
    """
    parsed = archives.parse_archives(
        archives.read_archives(spark, archive_root, days=days), outlets=outlets
    )
    stored = materialise(parsed, "parsed_archives")
    for rows, name in (
        (archives.archive_readings(stored, site=site), "raw"),
        (archives.outcomes(stored), "archive_log"),
    ):
        dated = archives.with_path_parts(rows).drop("station")
        tables.write_days(dated, f"{root}/{name}", date="dir_date")
        if name == "raw":
            zones.write_zones(spark, root, days=days, written_at=as_of)


def ingest_archives(
    spark: SparkSession,
    archive_root: str,
    root: str,
    *,
    as_of: datetime,
    settings: Settings = DEFAULTS,
    site: Column | None = None,
    outlets: Sequence[str] | None = tuple(OUTLET_CODES),
) -> list[date]:
    """Compact the date folders of the look-back that are complete and have archives not compacted yet.

    The newest folder may still be filling and is left out.  Archives are listed, not opened, to
    compare them with the log; one that came late opens its folder again.  Returns the days
    compacted; ``ingest_days`` on ``root/raw`` goes on from there.
    """
    folders = archives.archive_days(spark, archive_root)
    first = (as_of - timedelta(days=settings.train_days)).date()
    wanted = [day for day in folders if first < day <= as_of.date()][:-1]
    if not wanted:
        return []
    log = tables.read_or_empty(spark, f"{root}/archive_log", "path string, dir_date date")
    listed = archives.with_path_parts(archives.read_archives(spark, archive_root, days=wanted).select("path"))
    new = listed.join(log.where(F.col("dir_date").isin(wanted)).select("path"), "path", "left_anti")
    todo = sorted(row[0] for row in new.select("dir_date").distinct().collect())
    if todo:
        compact_archives(
            spark, archive_root, root, days=todo, as_of=as_of, site=site, outlets=outlets
        )
    return todo


def ingest_days(
    spark: SparkSession,
    readings: DataFrame,
    root: str,
    *,
    as_of: datetime,
    settings: Settings = DEFAULTS,
    rebuild: bool = False,
    mapped: DataFrame | None = None,
) -> bool:
    """Condense the days that are complete and not done yet; False when there are none.

    With a ledger that is missing or too old, all complete days of the look-back are condensed
    again.  A day that is condensed replaces itself; older days stay as they are.

    ``mapped`` is the zone map of the readings (``zones.read_zones``): the days there are come from
    it instead of the readings, only folders that hold a wanted day are read, and a day that was
    done and has got readings since, however late, is condensed again.
    """
    ledger = tables.read_or_empty(spark, f"{root}/ledger", LEDGER)
    created = ledger.agg(F.min("done_at")).first()[0]
    fresh = rebuild or history.ledger_expired(created, as_of=as_of, settings=settings)
    if fresh:
        ledger = spark.createDataFrame([], LEDGER)

    if mapped is None:
        recent = history.readings_within(readings, as_of=as_of, settings=settings)
        dated = slots.with_slots(recent, settings=settings)
    else:
        dated = zones.days_of(mapped, settings=settings)
    days = history.new_days(dated, ledger, as_of=as_of, settings=settings)
    if mapped is not None:
        days = days.unionByName(zones.reopened(mapped, ledger, settings=settings))
    # a handful of dates, the look-back and what came late: fixed here, so that data arriving
    # meanwhile changes neither the rows nor the ledger
    todo = sorted(row[0] for row in days.distinct().collect())
    if not todo:
        return False

    folders = None if mapped is None else zones.folders_of(mapped, todo, settings=settings)
    condensed = slots.condense(
        history.readings_of_days(readings, todo, settings=settings, folders=folders), settings=settings
    )
    tables.write_days(condensed, f"{root}/readings", sort=["site_id", "slot_start"])
    done = spark.createDataFrame([(day, as_of) for day in todo], LEDGER)
    done.write.mode("overwrite" if fresh else "append").parquet(f"{root}/ledger")
    return True


def training_counts(
    spark: SparkSession, root: str, *, as_of: datetime, settings: Settings = DEFAULTS, keys=()
) -> DataFrame:
    """Slot counts of the look-back: the date filter prunes partitions."""
    rows = spark.read.parquet(f"{root}/readings")
    inside = history.within_lookback(F.col("slot_date"), as_of, settings.train_days)
    return slots.slot_counts(rows.where(inside), settings=settings, keys=keys)


def predict_fleet_week(
    spark: SparkSession, root: str, *, as_of: datetime, settings: Settings = DEFAULTS
) -> DataFrame:
    """Train the forest on the look-back and predict every slot of a week."""
    counts = training_counts(spark, root, as_of=as_of, settings=settings).cache()
    try:
        model = forecast.train_forest(forecast.training_rows(counts), settings=settings)
    finally:
        counts.unpersist()
    grid = forecast.week_grid(spark.range(1).drop("id"), settings=settings)
    return forecast.predict_week(model, grid)


def predict_site_weeks(
    spark: SparkSession,
    root: str,
    *,
    as_of: datetime,
    settings: Settings = DEFAULTS,
    keys: Sequence[str] = ("site_id",),
) -> DataFrame:
    """One forest over the look-back of all sites; every slot of a week of each of them."""
    counts = materialise(
        training_counts(spark, root, as_of=as_of, settings=settings, keys=keys), "site_counts"
    )
    model, levels = forecast.train_sites(counts, settings=settings, keys=keys)
    sites = levels.select(*keys).distinct()
    return forecast.predict_sites(model, levels, forecast.week_grid(sites, settings=settings), keys=keys)


def store_predictions(
    predicted: DataFrame, root: str, *, schedule: str, settings: Settings = DEFAULTS, keys=()
) -> None:
    """Forecast, windows and insights tables from one predicted week."""
    rows = forecast.with_ordinals(predicted, settings=settings)
    tables.replace_table(
        rows.select(
            *keys, "timestamp", "daytimestamp", "week_ordinal", "day_ordinal",
            "dow", "hour", "slot", "countavailable",
        ),
        f"{root}/forecast",
    )
    stored = rows.sparkSession.read.parquet(f"{root}/forecast")
    found = windows.availability_windows(stored, settings=settings, keys=keys)
    planned = windows.window_schedule(found, settings=settings)
    tables.replace_schedule(planned, f"{root}/schedule", schedule=schedule)
    said = windows.with_clock_parts(windows.insights(found, settings=settings, keys=keys))
    tables.replace_table(said, f"{root}/insights")


def refresh(
    spark: SparkSession,
    readings: DataFrame,
    root: str,
    *,
    as_of: datetime,
    schedule: str = "default",
    settings: Settings = DEFAULTS,
    force: bool = False,
    mapped: DataFrame | None = None,
    keys: Sequence[str] = (),
) -> bool:
    """The whole refresh; without new days nothing is done unless forced.

    ``force`` also rebuilds the history from the raw readings; ``mapped`` is their zone map.
    With ``keys``, such as ``("site_id",)``, every site has its own week, windows and insights;
    without, one is made for the fleet.
    """
    worked = ingest_days(
        spark, readings, root, as_of=as_of, settings=settings, rebuild=force, mapped=mapped
    )
    if not worked and not force:
        return False
    if keys:
        predicted = predict_site_weeks(spark, root, as_of=as_of, settings=settings, keys=keys)
    else:
        predicted = predict_fleet_week(spark, root, as_of=as_of, settings=settings)
    store_predictions(predicted, root, schedule=schedule, settings=settings, keys=keys)
    return True


def insights_of_day(spark: SparkSession, root: str, dow: int, *, limit: int | None = None) -> DataFrame:
    return tables.read_records(
        spark.read.parquet(f"{root}/insights"),
        where=F.col("dow") == dow,
        order_by=["order"],
        limit=limit,
    )


def schedule_entries(
    spark: SparkSession, root: str, schedule: str, *, limit: int | None = None
) -> DataFrame:
    return tables.read_records(
        tables.read_schedules(spark, f"{root}/schedule"),
        where=F.col("schedule") == schedule,
        limit=limit,
    )


def add_schedule_entry(
    spark: SparkSession,
    root: str,
    *,
    dow: int,
    start: str,
    end: str,
    schedule: str,
    settings: Settings = DEFAULTS,
) -> None:
    """Replace a schedule by one window given as clock times, such as ``7:03`` to ``7:09``."""
    edges = (dow, 1, clock_minutes(start), clock_minutes(end), 0)
    window = spark.createDataFrame(
        [edges], "dow int, window_no int, start_min int, end_min int, n_cont int"
    )
    planned = windows.window_schedule(window, settings=settings)
    tables.replace_schedule(planned, f"{root}/schedule", schedule=schedule)
