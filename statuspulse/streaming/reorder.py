"""Polls that come late: an event-time buffer in front of whatever needs them in order.

A poll is held until the clock, the greatest time seen, is ``late_minutes`` past it, and then
taken in the order of time.  Polls that are late by less change nothing, however they fall
into micro-batches.  A poll not after the site's last one taken is set aside as late: it is kept
with its counts and marked, and never mixed into what was already told.  Of several polls of a
site at one time the least counts.

A row without counts is no poll and only advances the clock; ``closing`` makes one, so that a
stream that has ended lets go of everything.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from statuspulse.params import Settings
from statuspulse.sources.tables import append_records, read_state, write_state

#: How far Spark's own watermark stays behind the clock.  It would silently drop what is older
#: than it; thirty years back it drops no poll, and serves as the clock of the timers only.
BEHIND = timedelta(days=10_957)
_BEHIND_MS = BEHIND // timedelta(milliseconds=1)
_MINUTE_US = 60_000_000


def closing(polls: DataFrame, *, settings: Settings) -> DataFrame:
    """One row without counts, later than all polls by more than they are held."""
    end = F.max("ts") + F.make_dt_interval(mins=F.lit(settings.late_minutes + 1))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in polls.dtypes if name not in ("site_id", "ts")]
    # a site there is: Spark may leave out rows without one before it reads the clock
    return polls.agg(F.min("site_id").alias("site_id"), end.alias("ts")).select("*", *none).select(polls.columns)


# ---- in the keyed state of a stream --------------------------------------------------------


def with_clock(polls: DataFrame) -> DataFrame:
    return polls.withWatermark("ts", f"{BEHIND.days} days")


class Held:
    """A site's polls that wait, as whole numbers: time in microseconds, then ``columns``."""

    def __init__(self, columns: Sequence[str], settings: Settings):
        self.columns = ["us", *columns]
        self.delay_us = settings.late_minutes * _MINUTE_US

    def _frame(self, parts: Iterable[pd.DataFrame]) -> pd.DataFrame:
        found = [p[p["total"].notna()] for p in parts if len(p)]
        if not found:
            return pd.DataFrame(columns=self.columns, dtype="Int64")
        polls = pd.concat(found, ignore_index=True)
        polls["us"] = polls["ts"].astype("datetime64[us]").astype("int64")
        return polls[self.columns].astype("Int64")

    def take(
        self, parts: Iterator[pd.DataFrame], waiting: list | None, last_us: int | None, state: GroupState
    ) -> tuple[pd.DataFrame, list, pd.DataFrame]:
        """Polls to take now, in order; those to hold, as a flat list; and the late ones."""
        new = self._frame(parts)
        passed = new["us"] <= (-(1 << 62) if last_us is None else last_us)
        late, new = new[passed], new[~passed]
        width = len(self.columns)
        rows = [waiting[k : k + width] for k in range(0, len(waiting or ()), width)]
        held = pd.DataFrame(rows, columns=self.columns).astype("Int64")
        polls = pd.concat([held, new], ignore_index=True).sort_values(self.columns).drop_duplicates("us")
        watermark_ms = state.getCurrentWatermarkMs()
        # the site's own newest poll counts too: without a delay nothing waits for the next batch
        clock = [(watermark_ms + _BEHIND_MS) * 1000] if watermark_ms > 0 else []
        clock += [int(polls["us"].max())] if len(polls) else []
        due = polls["us"] <= max(clock, default=0) - self.delay_us
        rest = polls[~due]
        if len(rest):
            until = (int(rest["us"].min()) + self.delay_us) // 1000 - _BEHIND_MS
            state.setTimeoutTimestamp(max(until, watermark_ms + 1, 1))
        flat = [None if pd.isna(v) else int(v) for row in rest.itertuples(index=False) for v in row]
        return polls[due].reset_index(drop=True), flat, late.reset_index(drop=True)


def with_time(rows: pd.DataFrame, site) -> pd.DataFrame:
    return rows.assign(site_id=site, ts=pd.to_datetime(rows["us"].astype("int64"), unit="us"))


# ---- in tables beside a stream of large micro-batches ---------------------------------------


def arrive(
    rows: DataFrame, seen: DataFrame, last: DataFrame, path: str, *, batch: int, settings: Settings
) -> DataFrame:
    """The rows due after this micro-batch.  Those that wait are in ``path/buffer`` and late ones in
    ``path/late``; a batch that is run again reads the same and writes the same.

    ``rows`` are those of the polls ``seen`` that are needed in order; the clock goes by all of
    ``seen``.  ``last`` has the last row taken of every site.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c not in ("site_id", "ts")]
    clock = read_state(spark, f"{path}/clock", "at timestamp_ntz, due timestamp_ntz", batch=batch).first()
    stored = rows.withColumn("late", F.lit(False)).schema
    held = read_state(spark, f"{path}/buffer", stored, batch=batch).where(~F.col("late"))
    if clock is not None and clock["due"] is not None:
        held = held.where(F.col("ts") > F.lit(clock["due"]).cast("timestamp_ntz"))
    taken = last.groupBy("site_id").agg(F.max("ts").alias("_last"))
    passed = F.coalesce(F.col("ts") <= F.col("_last"), F.lit(False))
    new = rows.join(taken, "site_id", "left").withColumn("late", passed).drop("_last")
    waiting = held.unionByName(new.where(~F.col("late")))
    once = waiting.groupBy("site_id", "ts", "late").agg(F.min(F.struct(*columns)).alias("_row"))
    once = once.select("site_id", "ts", *(F.col(f"_row.{c}").alias(c) for c in columns), "late")
    write_state(once.unionByName(new.where("late")), f"{path}/buffer", batch=batch)
    buffer = read_state(spark, f"{path}/buffer", stored, batch=batch + 1)
    append_records(buffer.where("late").drop("late"), f"{path}/late", batch=batch)

    newest = seen.agg(F.max("ts")).first()[0]
    at = max((t for t in (newest, clock and clock["at"]) if t is not None), default=None)
    due = at - timedelta(minutes=settings.late_minutes) if at is not None else None
    # one row: the clock and the time up to which polls have been taken
    now = spark.createDataFrame([(at, due)], "at timestamp_ntz, due timestamp_ntz")
    write_state(now, f"{path}/clock", batch=batch)
    ready = buffer.where(~F.col("late") & (F.col("ts") <= F.lit(due).cast("timestamp_ntz")))
    return ready.select(rows.columns)
