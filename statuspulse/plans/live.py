"""Live monitor: polls in; statistics, predictions and routed alerts out.

Tables below ``root``: ``changes/rows`` and ``notices/rows``, and ``changes/late`` and
``notices/late`` with the polls that came too late, a folder per micro-batch; ``stats``,
``predictions`` and ``alerts`` are logs of merged runs (``sources.runs``), to be read by
``current_stats``, ``current_predictions`` and ``routed_alerts``.

Both watchers run on either engine: the keyed state of ``streaming.monitor``, or, ``by_day``, the
batch operators of ``streaming.backlog``, which cut a site with many polls into days.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from statuspulse.operators import alerts, lookahead, status, transitions
from statuspulse.params import DEFAULTS, OUTLET_CODES, Settings
from statuspulse.sources import archives, latest, tables
from statuspulse.sources.runs import BATCH, RunTable
from statuspulse.streaming import backlog, monitor
from statuspulse.streaming.run import write_batches


def snapshot_poll(readings: DataFrame) -> DataFrame:
    """One poll per site from the newest reading of every outlet."""
    return status.status_counts(status.latest_readings(readings))


LATEST = "site_id long, device_id string, outlet_id string, ts timestamp_ntz, status string"


def watch_snapshots(readings: DataFrame, root: str, *, poll: str | None = None) -> StreamingQuery:
    """A stream of outlet readings to polls: counts over the newest reading of every outlet.

    Each batch writes the newest readings known after it, one row per outlet, and one poll
    per site (``polls/batch=N``, to be streamed into the watchers).  It starts from what the
    batch before it wrote, so a batch that is run again gives the same.
    """

    def advance(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        known = tables.read_state(spark, f"{root}/latest", LATEST, batch=batch)
        merged = known.unionByName(rows.select(known.columns))
        tables.write_state(status.latest_readings(merged), f"{root}/latest", batch=batch)
        latest = tables.read_state(spark, f"{root}/latest", LATEST, batch=batch + 1)
        polls = status.status_counts(latest).withColumn("ts", F.col("ts").cast("timestamp"))
        tables.append_records(polls, f"{root}/polls", batch=batch)

    trigger = {"processingTime": poll} if poll else {"availableNow": True}
    return (
        readings.select(
            F.col("site_id").cast("long").alias("site_id"), "device_id", "outlet_id", "ts", "status"
        )
        .writeStream.foreachBatch(advance)
        .option("checkpointLocation", f"{root}/snapshot_checkpoint")
        .trigger(**trigger)
        .start()
    )


def watch_latest(
    spark: SparkSession,
    archive_root: str,
    root: str,
    *,
    outlets: Sequence[str] | None = tuple(OUTLET_CODES),
    site: Column | None = None,
    poll: str | None = None,
) -> StreamingQuery:
    """``watch_snapshots`` over ``latest/<station>.zip``: every replaced archive is a poll.

    A batch opens the archives that were replaced since the one before it, no others.
    """
    parsed = archives.parse_archives(latest.stream_latest(spark, archive_root), outlets=outlets)
    return watch_snapshots(archives.archive_readings(parsed, site=site), root, poll=poll)


def _with_prediction_lines(changed: DataFrame, settings: Settings) -> DataFrame:
    """Depletion sentences of a change, joined by line breaks; NULL without any."""
    estimates = transitions.time_to_empty(changed, settings=settings)
    lines = estimates.groupBy("site_id", "ts").agg(
        F.sort_array(F.collect_list(F.struct("n", "predict_text"))).alias("_lines")
    )
    predict = F.array_join(F.transform("_lines", lambda line: line["predict_text"]), "\n")
    return changed.join(
        lines.select("site_id", "ts", predict.alias("predict")), ["site_id", "ts"], "left"
    )


def _set_late_aside(rows: DataFrame, path: str, batch: int) -> DataFrame:
    """Write the late polls where the engine that works by day has them; the other rows."""
    late = monitor.late_polls(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    tables.append_records(late, f"{path}/late", batch=batch)
    return monitor.on_time(rows)


def watch_changes(
    polls: DataFrame,
    root: str,
    *,
    settings: Settings = DEFAULTS,
    poll: str | None = None,
    by_day: bool = False,
) -> StreamingQuery:
    """Changes to the statistics record of their site and to alerts."""

    def publish(rows: DataFrame, batch: int) -> None:
        if not by_day:
            rows = _set_late_aside(rows, f"{root}/changes", batch)
        stats = transitions.current_stats(rows.drop("means"), settings=settings)
        _stats(rows.sparkSession, root).append(stats, batch)
        figures = transitions.with_change_figures(
            _with_prediction_lines(rows, settings), settings=settings
        )
        routed = alerts.route(alerts.transition_alerts(figures), settings=settings)
        _alerts(rows.sparkSession, root, "changes").append(routed, batch)

    if by_day:
        return backlog.watch_changes(polls, f"{root}/changes", settings=settings, poll=poll, each=publish)
    changed = monitor.with_means(
        monitor.live_changes(polls, settings=settings), settings=settings
    )
    return write_batches(changed, f"{root}/changes", mode="append", poll=poll, each=publish)


def watch_edges(
    polls: DataFrame,
    intervals: DataFrame,
    root: str,
    *,
    settings: Settings = DEFAULTS,
    poll: str | None = None,
    interval_keys: Sequence[str] = ("site_id",),
    by_day: bool = False,
) -> StreamingQuery:
    """Upcoming interval edges to the prediction record of their site and to alerts."""

    def publish(rows: DataFrame, batch: int) -> None:
        if not by_day:
            rows = _set_late_aside(rows, f"{root}/notices", batch)
        sites = rows.groupBy("site_id").agg(F.max("ts").alias("ts"))
        record = lookahead.current_prediction(rows, sites).join(sites, "site_id")
        _predictions(rows.sparkSession, root).append(record, batch)
        routed = alerts.route(alerts.forecast_alerts(rows), settings=settings)
        _alerts(rows.sparkSession, root, "edges").append(routed, batch)

    if by_day:
        return backlog.watch_edges(
            polls, intervals, f"{root}/notices",
            settings=settings, poll=poll, interval_keys=interval_keys, each=publish,
        )
    told = monitor.live_notices(polls, intervals, settings=settings, interval_keys=interval_keys)
    return write_batches(told, f"{root}/notices", mode="append", poll=poll, each=publish)


def late_polls(spark, root: str, *, of: str = "changes") -> DataFrame:
    """Polls that came too late for the changes, or with ``of="notices"`` for a notice."""
    return backlog.late_polls(spark, f"{root}/{of}")


def _stats(spark, root: str) -> RunTable:
    return RunTable(spark, f"{root}/stats", keys=("site_id",), order="ts")


def _predictions(spark, root: str) -> RunTable:
    return RunTable(spark, f"{root}/predictions", keys=("site_id",), order="ts")


def _alerts(spark, root: str, source: str) -> RunTable:
    return RunTable(spark, f"{root}/alerts/{source}")


def current_stats(spark, root: str) -> DataFrame:
    """One statistics record per site: the last written."""
    return _stats(spark, root).latest()


def current_predictions(spark, root: str) -> DataFrame:
    return _predictions(spark, root).latest()


def routed_alerts(spark, root: str) -> DataFrame:
    """All alerts with their ``source``, ``changes`` or ``edges``: those of the watchers that have run."""
    found = [
        log.read().drop(BATCH).withColumn("source", F.lit(source))
        for source in ("changes", "edges")
        if (log := _alerts(spark, root, source)).runs()
    ]
    if not found:
        raise FileNotFoundError(f"no alerts in {root}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
