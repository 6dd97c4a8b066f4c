"""Changes in the number of available outlets, depletion speed and time to empty.

Polls are ``site_id, ts, avail, in_use, unknown, total``, one row per site and time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuspulse.functions import text, time
from statuspulse.operators.sequence import IS_HALO, with_halo
from statuspulse.params import DEFAULTS, Settings

KEYS = ("site_id",)


def day_chunk(ts: Column) -> Column:
    return F.to_date(ts)


def polls_from_counts(
    counts: DataFrame, *, settings: Settings = DEFAULTS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Slot counts read as polls at the slot start, in GMT."""
    return counts.select(
        *keys,
        time.to_gmt(F.col("slot_start"), settings.zone).alias("ts"),
        F.col("avail_count").alias("avail"),
        F.col("in_use_count").alias("in_use"),
        F.col("unknown_count").alias("unknown"),
        (F.col("avail_count") + F.col("in_use_count") + F.col("unknown_count")).alias("total"),
    )


def change_kind(old: Column, new: Column) -> Column:
    """Class of a poll against the one before; NULL where nothing changed."""
    return (
        F.when(old.isNull(), "initial")
        .when((old == 0) & (new > 0), "became_nonzero")
        .when(new > old, "increased")
        .when((new < old) & (new > 0), "decreased")
        .when(new < old, "went_to_zero")
    )


def changes(polls: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Polls whose available count differs from the site's previous poll, with the old counts."""
    w = Window.partitionBy(*keys, "_chunk").orderBy("ts")
    chunked = with_halo(
        polls.withColumn("_chunk", day_chunk(F.col("ts"))), keys, "_chunk", ["ts"], 1
    )
    olds = {f"{c}_old": F.lag(c).over(w) for c in ("avail", "in_use", "unknown")}
    return (
        chunked.withColumns(olds)
        .where(~F.col(IS_HALO))
        .withColumn("kind", change_kind(F.col("avail_old"), F.col("avail")))
        .where(F.col("kind").isNotNull())
        .drop("_chunk", IS_HALO)
    )


def with_change_figures(
    changed: DataFrame, *, settings: Settings = DEFAULTS, zone: str | None = None
) -> DataFrame:
    """Percentages, their texts and the alert sentence of every change."""
    old, new, total = F.col("avail_old"), F.col("avail"), F.col("total")
    local = time.to_local(F.col("ts"), zone or settings.zone)
    return changed.withColumns(
        {
            "pct_avail": text.percent(new, total),
            "pct_change": text.percent_change(old, new),
            "pct_change_total": text.percent_change(old, new, total),
            "pct_avail_text": text.percent_text(text.percent(new, total)),
            "pct_change_text": text.percent_change_text(old, new),
            "pct_change_total_text": text.percent_change_text(old, new, total),
            "text": text.transition_text(F.col("kind"), local, old, new, total),
        }
    )


def _velocity(since: Column) -> Column:
    """Outlets lost per minute since the site's last change; NULL unless it is a decrease."""
    return _speed(F.col("kind"), F.col("avail_old"), F.col("avail"), since, F.col("ts"))


def _speed(kind: Column, old: Column, new: Column, since: Column, ts: Column) -> Column:
    lost = (old - new).cast("double")
    return F.when(kind == "decreased", F.try_divide(lost, time.minutes_between(since, ts)))


def _means(counts: Sequence[int]) -> Column:
    """Means over the last n velocities, from ``velocity`` and ``_v1`` and so on before it."""

    def mean(n: int) -> Column:
        values = [F.col("velocity"), *(F.col(f"_v{i}") for i in range(1, n))]
        # NULL as soon as one of the n is not a decrease
        return reduce(lambda a, b: a + b, values) / F.lit(float(n))

    means = F.array(*(F.struct(F.lit(n).alias("n"), mean(n).alias("velocity")) for n in counts))
    return F.filter(means, lambda m: m.velocity.isNotNull())


def with_velocities(
    changed: DataFrame, *, settings: Settings = DEFAULTS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Add the velocity of every decrease and the trailing means over the last n of them.

    The mean over n exists where this change and the n-1 before it are all decreases: any
    other change starts the run anew.  That is a look-back of max(n) changes, so chunks of a
    busy site run in parallel.  ``means`` is an array of (n, velocity).
    """
    depth = max(settings.velocity_counts)
    w = Window.partitionBy(*keys, "_chunk").orderBy("ts")
    chunked = with_halo(
        changed.withColumn("_chunk", day_chunk(F.col("ts"))), keys, "_chunk", ["ts"], depth
    ).withColumn("velocity", _velocity(F.lag("ts").over(w)))
    back = {f"_v{i}": F.lag("velocity", i).over(w) for i in range(1, depth)}

    return (
        chunked.withColumns(back)
        .where(~F.col(IS_HALO))
        .withColumn("means", _means(settings.velocity_counts))
        .drop("_chunk", IS_HALO, *back)
    )


def change_runs(
    polls: DataFrame, *, settings: Settings = DEFAULTS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``with_velocities(changes(polls))``, of which polls are shuffled once.

    Polls go to their site's day.  A day is summed up as its first and last poll and its last n
    changes, and only these summaries are put in order: what comes before a day is the poll before
    it and the n changes before it, whatever the number of days between.  A poll without a site
    or time has no day and no changes.
    """
    depth = max(settings.velocity_counts)
    counted = ("avail", "in_use", "unknown")
    day = Window.partitionBy(*keys, "_chunk")
    w, so_far = day.orderBy("ts"), day.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    # the conditions that the join below implies, so that both uses of the rows are one plan
    known = F.col("_chunk").isNotNull()
    for key in keys:
        known &= F.col(key).isNotNull()
    rows = polls.withColumn("_chunk", day_chunk(F.col("ts"))).where(known)
    rows = rows.withColumns(
        {"_first": F.lag("ts").over(w).isNull(), **{f"{c}_old": F.lag(c).over(w) for c in counted}}
    )
    # a day's first poll is judged against the day before it
    rows = rows.withColumn("kind", F.when(~F.col("_first"), change_kind(F.col("avail_old"), F.col("avail"))))
    nth, many = F.count("kind").over(so_far), F.count("kind").over(day)
    rows = rows.withColumn("_recent", F.col("kind").isNotNull() & (nth > many - depth))

    # all columns, for the same reason
    poll = F.struct("ts", *(c for c in polls.columns if c not in {*keys, "ts"}))
    change = F.struct("ts", "kind", "avail_old", "avail")
    days = rows.groupBy(*keys, "_chunk").agg(
        F.min_by(poll, "ts").alias("_opening"),
        F.max_by(poll, "ts").alias("_closing"),
        F.sort_array(F.collect_list(F.when(F.col("_recent"), change))).alias("_changes"),
    )
    by_day = Window.partitionBy(*keys).orderBy("_chunk")
    opening, before = F.col("_opening"), F.col("_before")
    days = days.withColumn("_before", F.lag("_closing").over(by_day))
    days = days.withColumn("_kind", change_kind(before["avail"], opening["avail"]))
    opened = F.array(
        F.struct(
            opening["ts"].alias("ts"),
            F.col("_kind").alias("kind"),
            before["avail"].alias("avail_old"),
            opening["avail"].alias("avail"),
        )
    )
    tail = F.when(F.col("_kind").isNull(), F.col("_changes")).otherwise(F.concat(opened, "_changes"))
    days = days.withColumn("_tail", tail).where(F.size("_tail") > 0)
    # every day left holds a change: the last n changes are in the last n days
    earlier = F.reverse(F.flatten(F.collect_list("_tail").over(by_day.rowsBetween(-depth, -1))))
    days = days.withColumn("_earlier", F.slice(earlier, 1, depth))
    speeds = F.transform(
        "_earlier",
        lambda c, i: _speed(c["kind"], c["avail_old"], c["avail"], F.get("_earlier", i + 1)["ts"], c["ts"]),
    )
    carried = days.select(
        *keys, "_chunk", "_kind", "_before", F.get("_earlier", F.lit(0))["ts"].alias("_since"), speeds.alias("_speeds")
    )

    first = F.col("_first")
    changed = rows.where(first | F.col("kind").isNotNull()).join(carried, [*keys, "_chunk"])
    changed = changed.withColumns(
        {
            "kind": F.when(first, F.col("_kind")).otherwise(F.col("kind")),
            **{f"{c}_old": F.when(first, before[c]).otherwise(F.col(f"{c}_old")) for c in counted},
        }
    ).where(F.col("kind").isNotNull())
    since = F.coalesce(F.lag("ts").over(w), F.col("_since"))
    changed = changed.withColumn("velocity", _velocity(since)).withColumn("_nth", F.row_number().over(w))

    def back(i: int) -> Column:
        own = F.lag("velocity", i).over(w)
        return F.when(F.col("_nth") > i, own).otherwise(F.get("_speeds", F.lit(i) - F.col("_nth")))

    found = changed.withColumns({f"_v{i}": back(i) for i in range(1, depth)})
    found = found.withColumn("means", _means(settings.velocity_counts))
    olds = [f"{c}_old" for c in counted]
    return found.select(*polls.columns, *olds, "kind", "velocity", "means")


def depletion_velocity(with_means: DataFrame) -> DataFrame:
    return with_means.where(F.col("kind") == "decreased")


def time_to_empty(with_means: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    """Expected time until no outlet is left, one row per decrease and n that has a mean."""
    local = time.to_local(F.col("empty_ts"), settings.zone)
    return (
        with_means.select("*", F.explode("means").alias("_m"))
        .select("*", F.col("_m.n").alias("n"), F.col("_m.velocity").alias("mean_velocity"))
        .drop("_m", "means")
        .where(F.col("mean_velocity") > 0)
        .withColumn(
            "seconds_to_empty",
            F.round(F.col("avail") / F.col("mean_velocity") * F.lit(60.0)).cast("bigint"),
        )
        .where(F.col("seconds_to_empty") > 0)
        .withColumn("empty_ts", time.add_seconds(F.col("ts"), F.col("seconds_to_empty")))
        .withColumn(
            "predict_text",
            text.depletion_text(
                local,
                F.col("avail"),
                F.col("seconds_to_empty"),
                F.col("mean_velocity"),
                F.col("n"),
            ),
        )
    )


def latest_change(changed: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every site's last change: what its statistics record shows."""
    fields = [c for c in changed.columns if c not in keys]
    last = F.max_by(F.struct(*fields), F.col("ts")).alias("_last")
    return (
        changed.groupBy(*keys)
        .agg(last)
        .select(*keys, "_last.*")
        .withColumn("init", (F.col("kind") == "initial").cast("int"))
    )


def current_stats(
    changed: DataFrame, *, settings: Settings = DEFAULTS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Statistics records: figures are made for the surviving rows only."""
    return with_change_figures(latest_change(changed, keys=keys), settings=settings)
