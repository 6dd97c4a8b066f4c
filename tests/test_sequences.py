"""Chunked look-back against windows over the whole key, and the greedy throttle."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuspulse.operators import lookahead, transitions
from statuspulse.operators.sequence import IS_HALO, with_halo
from statuspulse.params import Settings


@pytest.mark.parametrize("k", [1, 3, 5])
def test_halo_equals_whole_window(spark, k):
    """One key holds most rows, chunks are uneven and some are missing."""
    rng = random.Random(k)
    rows = []
    for key, n in (("hot", 400), ("a", 7), ("b", 1)):
        at = 0
        for _ in range(n):
            at += rng.choice([1, 1, 2, 5, 40])
            rows.append((key, at, at // 10, rng.random()))
    df = spark.createDataFrame(rows, "key string, at int, chunk int, v double")
    chunked = Window.partitionBy("key", "chunk").orderBy("at")
    whole = Window.partitionBy("key").orderBy("at")

    def lags(w):
        return [F.lag("v", i).over(w).alias(f"v{i}") for i in range(1, k + 1)]

    got = with_halo(df, ["key"], "chunk", ["at"], k).select("key", "at", IS_HALO, *lags(chunked))
    got = got.where(~F.col(IS_HALO)).drop(IS_HALO)
    expected = df.select("key", "at", *lags(whole))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))


def test_halo_carries_named_columns_only(spark):
    df = spark.createDataFrame([("a", 1, 0, 1.0, "x"), ("a", 2, 1, 2.0, "y")],
                               "key string, at int, chunk int, v double, other string")
    halo = with_halo(df, ["key"], "chunk", ["at"], 1, carry=["v"]).where(IS_HALO).collect()
    assert [(r.at, r.chunk, r.v, r.other) for r in halo] == [(1, 1, 1.0, None)]


def _polls(spark, series, step=timedelta(hours=7)):
    rows = []
    for site, counts in series.items():
        ts = datetime(2024, 3, 1)
        for n in counts:
            rows.append((site, ts, n, 0, 0, 10))
            ts += step
    return spark.createDataFrame(
        rows, "site_id long, ts timestamp_ntz, avail long, in_use long, unknown long, total long"
    )


def test_transition_kinds(spark):
    changed = transitions.changes(_polls(spark, {1: [3, 3, 1, 0, 0, 2, 4]}))
    kinds = [r.kind for r in changed.orderBy("ts").collect()]
    assert kinds == ["initial", "decreased", "went_to_zero", "became_nonzero", "increased"]


def _velocity_means(counts, step_minutes, ns):
    """The plain sequential computation."""
    out, last_change, run, old = [], None, [], None
    for i, n in enumerate(counts):
        now = i * step_minutes
        if old is None or n != old:
            if old is not None and 0 < n < old:
                run = [(old - n) / (now - last_change), *run][: max(ns)]
            else:
                run = []
            out.append((now, {k: sum(run[:k]) / k for k in ns if len(run) >= k}))
            last_change = now
        old = n
    return out


@pytest.mark.parametrize("seed", range(3))
def test_velocities_equal_sequential_run(spark, seed):
    rng = random.Random(seed)
    counts, n = [], 9
    for _ in range(150):
        n = max(0, n + rng.choice([-2, -1, -1, -1, 0, 6 if n < 2 else -1]))
        counts.append(n)
    settings = Settings(velocity_counts=(1, 3, 5))
    changed = transitions.changes(_polls(spark, {1: counts}))
    rows = transitions.with_velocities(changed, settings=settings).orderBy("ts").collect()
    start = datetime(2024, 3, 1)
    got = [
        ((r.ts - start).total_seconds() / 60, {m.n: m.velocity for m in r.means}) for r in rows
    ]
    expected = _velocity_means(counts, 7 * 60, (1, 3, 5))
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert any(5 in means for _, means in expected)
    for (_, a), (_, b) in zip(got, expected, strict=True):
        assert a == pytest.approx(b)


@pytest.mark.parametrize("seed", range(3))
def test_runs_in_one_pass_equal_the_two_steps(spark, seed):
    """A busy site, days without a change or a poll, sites of one poll, counts of 0."""
    rng, rows = random.Random(seed), []
    for site, many, step in ((1, 600, 20), (2, 150, 400), (3, 40, 3000), (4, 1, 1)):
        ts, n = datetime(2024, 3, 1), 9
        for _ in range(many):
            rows.append((site, ts, n, rng.randrange(3), rng.choice([None, 0, 2]), 10, rng.random()))
            ts += timedelta(minutes=rng.choice([1, 1, 3]) * step + rng.choice([0, 0, 0, 0, 0, 4000]))
            n = max(0, n + rng.choice([0, 0, -1, -1, -2, 7 if n < 2 else 0]))
    rng.shuffle(rows)
    schema = "site_id long, ts timestamp_ntz, avail long, in_use long, unknown long, total long, extra double"
    polls = spark.createDataFrame(rows, schema)
    settings = Settings(velocity_counts=(1, 2, 4))
    want = transitions.with_velocities(transitions.changes(polls), settings=settings)
    none = [(None, datetime(2024, 3, 1), 1, 1, 1, 3, 0.0), (1, None, 1, 1, 1, 3, 0.0)]
    got = transitions.change_runs(polls.union(spark.createDataFrame(none, schema)), settings=settings)
    assert set(got.columns) == set(want.columns)
    assert any(len(r.means) == 3 for r in want.collect())
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert transitions.change_runs(polls.limit(0), settings=settings).collect() == []


def test_depletion_golden_values(spark):
    """Velocities 60/85, 60/137 and 60/89 per minute, 10 ports left."""
    v = [60 / 89, 60 / 137, 60 / 85]  # newest first
    df = spark.createDataFrame(
        [(1, datetime(2024, 3, 1, 12), 10, [(1, v[0]), (3, sum(v) / 3)])],
        "site_id long, ts timestamp_ntz, avail long, means array<struct<n:int,velocity:double>>",
    )
    rows = transitions.time_to_empty(df).orderBy("n").collect()
    assert [(r.n, r.seconds_to_empty) for r in rows] == [(1, 890), (3, 990)]
    assert rows[0].predict_text.endswith(
        "10 ports predicted all gone in 14.83 minutes at a rate of .67/min over last 1 velocities"
    )
    assert "in 16.50 minutes at a rate of .61/min over last 3" in rows[1].predict_text


def test_zero_elapsed_gives_no_velocity(spark):
    rows = [(1, datetime(2024, 3, 1), 5, "initial", None), (1, datetime(2024, 3, 1), 3, "decreased", 5)]
    df = spark.createDataFrame(
        rows, "site_id long, ts timestamp_ntz, avail long, kind string, avail_old long"
    )
    got = transitions.with_velocities(df).where("kind = 'decreased'").collect()
    assert got[0].velocity is None and got[0].means == []


def _throttled(rows, gap):
    """Sequential rule over the whole history of one site."""
    out, last, told = [], None, None
    for ts, interval in rows:
        if last != interval or told + gap < ts:
            out.append(ts)
            last, told = interval, ts
    return out


@pytest.mark.parametrize("seed", range(3))
def test_throttle_equals_sequential_rule(spark, seed):
    rng = random.Random(seed)
    gap = timedelta(minutes=10)
    rows, kept = [], {}
    for site, n in ((1, 900), (2, 5)):
        ts, history = datetime(2024, 3, 4), []
        for _ in range(n):
            ts += timedelta(seconds=rng.choice([1, 60, 300, 600, 601, 5000]))
            third = ts.hour // 8  # three intervals a day, passed in order
            history.append((ts, (ts.weekday(), third)))
            rows.append((site, ts, ts, (ts.isoweekday() % 7) + 1, third * 480, third * 480 + 479))
        kept[site] = _throttled(history, gap)
    df = spark.createDataFrame(
        rows,
        "site_id long, ts timestamp_ntz, local_ts timestamp_ntz, dow int, start_min int, end_min int",
    )
    got = lookahead.throttle(df, settings=Settings(notify_interval_minutes=10)).collect()
    for site, expected in kept.items():
        assert sorted(r.ts for r in got if r.site_id == site) == expected


def test_throttle_refuses_week_long_gaps(spark):
    with pytest.raises(ValueError):
        lookahead.throttle(None, settings=replace(Settings(), notify_interval_minutes=7 * 1440))


def _first_interval(now, intervals):
    return next(((s, e) for s, e in sorted(intervals) if now <= e), None)


def test_minute_lookup_with_overlaps(spark):
    intervals = [(60, 300), (120, 200), (250, 400), (600, 700), (650, 660), (1400, 1439)]
    df = spark.createDataFrame(
        [(1, 2, s, e) for s, e in intervals], "site_id long, dow int, start_min int, end_min int"
    )
    rows = lookahead.minute_lookup(df).collect()
    got = {r.now_min: (r.start_min, r.end_min) for r in rows}
    assert len(got) == len(rows)
    for minute in range(1440):
        assert got.get(minute) == _first_interval(minute, intervals), minute


def test_notices_skip_weekends_and_day_end(spark):
    def placed(avail, dow, now, start, end):
        return (1, datetime(2024, 3, 1), avail, dow, now, start, end, now >= start)

    cases = [
        (placed(0, 2, 100, 200, 300), "available"),
        (placed(1, 2, 100, 200, 300), None),
        (placed(0, 1, 100, 200, 300), None),  # Sunday
        (placed(0, 7, 100, 200, 300), None),  # Saturday
        (placed(0, 2, 100, 581, 700), None),  # beyond the look-ahead
        (placed(0, 2, 100, 580, 700), "available"),
        (placed(3, 2, 250, 200, 300), "unavailable"),
        (placed(3, 2, 1200, 200, 1438), None),  # open to the end of the day
        (placed(0, 2, 250, 200, 300), None),
    ]
    df = spark.createDataFrame(
        [(i, *case) for i, (case, _) in enumerate(cases)],
        "i int, site_id long, ts timestamp_ntz, avail long, dow int, now_min int, start_min int, "
        "end_min int, in_interval boolean",
    )
    got = {r.i: r for r in lookahead.lookahead_alerts(df).collect()}
    assert {i: r.kind for i, r in got.items()} == {
        i: kind for i, (_, kind) in enumerate(cases) if kind
    }
    assert got[0].text == (
        "It is forecasted that charge ports will be available in 1 hours, 40 minutes @ 03:20AM "
        "for 1 hours, 40 minutes"
    )
    assert got[6].text == (
        "It is forecasted that all charge ports will be unavailable in 50 minutes @ 05:00AM"
    )
