"""Changes and notices of a stream whose micro-batches may be large.

Each micro-batch is handed to the batch operators together with a little of what came
before it: every site's last poll, its last changes, its last notice.  A site with most of
the polls is cut into days like any other history, and nothing is gathered in Python.  Polls
wait until none before them can come (``reorder``); what comes later still is in ``late``.
What the next batch needs is written next to the batch's rows; a batch that is run again starts
from the same and writes the same.  The keyed state of ``monitor`` gives the same rows with
less writing, for micro-batches of a poll or a few.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from statuspulse.operators import lookahead, transitions
from statuspulse.params import DEFAULTS, Settings
from statuspulse.sources.tables import append_records, read_state, write_state
from statuspulse.streaming import reorder

_POLL = "site_id long, ts timestamp_ntz, avail long, in_use long, unknown long, total long"
_CHANGE = _POLL + ", avail_old long, in_use_old long, unknown_old long, kind string"
_KNOWN = "_known"


def _with_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """New rows, and the known ones they follow, flagged."""
    return rows.withColumn(_KNOWN, F.lit(False)).unionByName(
        known.select(rows.columns).withColumn(_KNOWN, F.lit(True))
    )


def _newest(rows: DataFrame, k: int) -> DataFrame:
    latest = Window.partitionBy("site_id").orderBy(F.col("ts").desc())
    return rows.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= k).drop("_rank")


def continue_changes(polls: DataFrame, last: DataFrame, tail: DataFrame) -> DataFrame:
    """Changes among the polls and the site's known ``tail`` of changes, flagged ``_known``."""
    fresh = transitions.changes(_with_known(polls, last)).where(~F.col(_KNOWN)).drop(_KNOWN)
    return _with_known(fresh, tail)


#: Gets the rows of a micro-batch, read back from where they were written.
Publish = Callable[[DataFrame, int], None]


def watch_changes(
    polls: DataFrame,
    path: str,
    *,
    settings: Settings = DEFAULTS,
    poll: str | None = None,
    each: Publish | None = None,
) -> StreamingQuery:
    """Changes with velocities and means below ``path/rows``, one folder per batch."""
    depth = max(settings.velocity_counts)

    def advance(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        last = read_state(spark, f"{path}/last", _POLL, batch=batch)
        tail = read_state(spark, f"{path}/tail", _CHANGE, batch=batch)
        seen = _as_polls(rows)
        polls = seen.where(F.col("total").isNotNull())
        new = reorder.arrive(polls, seen, last, path, batch=batch, settings=settings)

        timed = transitions.with_velocities(continue_changes(new, last, tail), settings=settings)
        append_records(timed.where(~F.col(_KNOWN)).drop(_KNOWN), f"{path}/rows", batch=batch)
        fresh = spark.read.schema(timed.drop(_KNOWN).schema).parquet(f"{path}/rows/batch={batch}")
        if each:
            each(fresh, batch)
        told = fresh.select(tail.columns)
        write_state(_newest(told.unionByName(tail), depth), f"{path}/tail", batch=batch)
        write_state(_newest(new.unionByName(last), 1), f"{path}/last", batch=batch)

    return _start(polls, path, advance, poll)


def watch_edges(
    polls: DataFrame,
    intervals: DataFrame,
    path: str,
    *,
    settings: Settings = DEFAULTS,
    poll: str | None = None,
    interval_keys: Sequence[str] = ("site_id",),
    each: Publish | None = None,
) -> StreamingQuery:
    """Throttled look-ahead notices below ``path/rows``, one folder per batch."""

    def advance(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        seen = _as_polls(rows)
        placed = lookahead.next_interval(seen, intervals, settings=settings, keys=interval_keys)
        found = lookahead.lookahead_alerts(placed, settings=settings)
        last = read_state(spark, f"{path}/last", "site_id long, ts timestamp_ntz", batch=batch)
        candidates = reorder.arrive(found, seen, last, path, batch=batch, settings=settings)
        told = read_state(spark, f"{path}/told", candidates.schema, batch=batch)

        # the last notice is the first of its group, so the choice goes on from it
        picked = lookahead.throttle(_with_known(candidates, told), settings=settings)
        append_records(picked.where(~F.col(_KNOWN)).drop(_KNOWN), f"{path}/rows", batch=batch)
        fresh = spark.read.schema(candidates.schema).parquet(f"{path}/rows/batch={batch}")
        if each:
            each(fresh, batch)
        write_state(_newest(fresh.unionByName(told), 1), f"{path}/told", batch=batch)
        taken = candidates.select(last.columns).unionByName(last)
        write_state(_newest(taken, 1), f"{path}/last", batch=batch)

    return _start(polls, path, advance, poll)


def _as_polls(rows: DataFrame) -> DataFrame:
    kinds = dict(part.rsplit(" ", 1) for part in _POLL.split(", "))
    return rows.select(*(F.col(name).cast(kind).alias(name) for name, kind in kinds.items()))


def late_polls(spark, path: str) -> DataFrame:
    """Polls that came after a later one of their site had been taken, with their micro-batch.

    Of notices, the polls that called for one."""
    return spark.read.schema(_POLL + ", batch long").parquet(f"{path}/late")


def _start(polls: DataFrame, path: str, advance, poll: str | None) -> StreamingQuery:
    trigger = {"processingTime": poll} if poll else {"availableNow": True}
    return (
        polls.writeStream.foreachBatch(advance)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**trigger)
        .start()
    )
