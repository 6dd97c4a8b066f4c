"""Live monitoring: changes, depletion and throttled notices with checkpointed state per site.

The state of a site is a few numbers, and the polls that wait until none before them can come
(``reorder``).  Polls that come later than that are marked ``late`` and change nothing else, so
the other rows do not depend on how polls fall into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from statuspulse.operators import lookahead
from statuspulse.operators.transitions import change_kind
from statuspulse.params import DEFAULTS, Settings
from statuspulse.streaming.reorder import Held, with_clock, with_time

_COUNTS = ("avail", "in_use", "unknown")

CHANGE_ROWS = (
    "site_id long, ts timestamp, avail long, in_use long, unknown long, total long, "
    "avail_old long, in_use_old long, unknown_old long, velocities array<double>, late boolean"
)
_CHANGE_STATE = (
    "last_us long, avail long, in_use long, unknown long, change_us long, velocities array<double>, "
    "held array<long>"
)


def on_time(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("late")).drop("late")


def late_polls(rows: DataFrame) -> DataFrame:
    """Polls that came after a later one of their site had been taken."""
    return rows.where("late").select("site_id", "ts", *_COUNTS, "total")


def live_changes(polls: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    """Changes of a stream of polls, with the running velocities, newest first; and the late polls."""
    keep = max(settings.velocity_counts)
    waiting = Held([*_COUNTS, "total"], settings)
    columns = ["site_id", "ts", *_COUNTS, "total", *(f"{c}_old" for c in _COUNTS), "velocities", "late"]

    def advance(
        key: tuple, parts: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        last_us, *old, change_us, velocities, held = state.get if state.exists else (None,) * 7
        polls, held, late = waiting.take(parts, held, last_us, state)
        if len(late):
            olds = {f"{c}_old": pd.array([pd.NA] * len(late), "Int64") for c in _COUNTS}
            yield with_time(late, key[0]).assign(**olds, velocities=None, late=True)[columns]
        if polls.empty:
            state.update((last_us, *old, change_us, velocities, held))
            return
        for name, value in zip(_COUNTS, old, strict=True):
            polls[f"{name}_old"] = polls[name].shift(1)
            polls.loc[0, f"{name}_old"] = pd.NA if value is None else value
        first = polls["avail_old"].isna()
        changed = polls[first | (polls["avail"] != polls["avail_old"]).fillna(True)]

        runs, velocities = [], list(velocities or [])
        for us, new, was in zip(changed["us"], changed["avail"], changed["avail_old"], strict=True):
            if was is not pd.NA and 0 < new < was:
                speed = float((was - new) / ((us - change_us) / 60_000_000.0))
                velocities = [speed, *velocities][:keep]
            else:
                velocities = []
            change_us = us
            runs.append(velocities)
        newest = polls.iloc[-1]
        state.update(
            (int(newest["us"]), *(int(newest[c]) for c in _COUNTS), int(change_us), velocities, held)
        )
        if len(changed):
            told = pd.Series(runs, index=changed.index, dtype=object)
            yield with_time(changed, key[0]).assign(velocities=told, late=False)[columns]

    rows = with_clock(polls).groupBy("site_id").applyInPandasWithState(
        advance, CHANGE_ROWS, _CHANGE_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    kind = F.when(~F.col("late"), change_kind(F.col("avail_old"), F.col("avail")))
    return rows.withColumn("kind", kind)


def with_means(changes: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    """Velocity and trailing means from the running velocities, as the batch operator gives them."""

    def mean(n: int):
        total = F.aggregate(F.slice("velocities", 1, n), F.lit(0.0), lambda a, v: a + v)
        return F.when(F.size("velocities") >= n, total / F.lit(float(n)))

    means = F.array(
        *(
            F.struct(F.lit(n).alias("n"), mean(n).alias("velocity"))
            for n in settings.velocity_counts
        )
    )
    return changes.withColumns(
        {
            "velocity": F.get("velocities", F.lit(0)),
            "means": F.filter(means, lambda m: m.velocity.isNotNull()),
        }
    ).drop("velocities")


_PLACED = ("avail", "in_use", "unknown", "total", "start_min", "end_min", "dow")
_NOTICE_ROWS = (
    "site_id long, ts timestamp, avail long, in_use long, unknown long, total long, start_min int, "
    "end_min int, late boolean"
)
_NOTICE_STATE = "last_us long, dow int, start_min int, told_us long, held array<long>"


def live_notices(
    polls: DataFrame,
    intervals: DataFrame,
    *,
    settings: Settings = DEFAULTS,
    interval_keys: Sequence[str] = ("site_id",),
) -> DataFrame:
    """Look-ahead notices of a stream of polls, throttled per site; and the polls late for one.

    The intervals are a static table: the join is the batch one, stream against static.
    ``interval_keys=()`` is for intervals that hold for every site.
    """
    clocked = with_clock(polls)
    placed = lookahead.next_interval(clocked, intervals, settings=settings, keys=interval_keys)
    candidates = lookahead.lookahead_alerts(placed, settings=settings)
    waiting = Held(_PLACED, settings)
    gap_us = settings.notify_interval_minutes * 60_000_000
    names = ["site_id", "ts", *_PLACED[:-1], "late"]

    def emit(
        key: tuple, parts: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        last_us, dow, start, told_us, held = state.get if state.exists else (None,) * 5
        rows, held, late = waiting.take(parts, held, last_us, state)
        if len(late):
            yield with_time(late, key[0]).assign(late=True)[names]
        picked = []
        for us, d, s in zip(rows["us"], rows["dow"], rows["start_min"], strict=True):
            due = told_us is None or (d, s) != (dow, start) or told_us + gap_us < us
            if due:
                dow, start, told_us = int(d), int(s), int(us)
            picked.append(due)
        if len(rows):
            last_us = int(rows["us"].iloc[-1])
        state.update((last_us, dow, start, told_us, held))
        if any(picked):
            yield with_time(rows[picked], key[0]).assign(late=False)[names]

    told = candidates.groupBy("site_id").applyInPandasWithState(
        emit, _NOTICE_ROWS, _NOTICE_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    # what a notice says follows from the poll and its interval
    again = lookahead.with_position(lookahead.at_local(told, settings=settings))
    return lookahead.lookahead_alerts(again, settings=settings)
