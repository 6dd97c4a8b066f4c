"""Availability windows and insights against hand-made cases and a plain state machine."""

import random
from dataclasses import replace

import pytest

from statuspulse.operators import windows
from statuspulse.params import Settings

HOURLY = Settings(slot_minutes=60)


def _forecast(spark, days):
    """days: {(site, dow): [count per hour]}"""
    rows = [
        (site, dow, hour, 0, n) for (site, dow), counts in days.items() for hour, n in enumerate(counts)
    ]
    return spark.createDataFrame(rows, "site_id int, dow int, hour int, slot int, countavailable int")


def _machine(counts, opening, closing, least):
    """One day: (start, end, continuing slots)."""
    out, start, going = [], None, 0
    for i, n in enumerate(counts):
        if start is None:
            if n >= opening:
                start, going = i, 0
        elif n <= closing:
            if going >= least:
                out.append((start, i, going))
            start = None
        else:
            going += 1
    if start is not None and going >= least:
        out.append((start, len(counts) - 1, going))
    return out


@pytest.mark.parametrize(
    "counts, expected",
    [
        ([0, 3, 3, 3, 1], [(1, 4)]),
        ([2, 3, 3, 0], [(0, 3)]),
        ([2, 2, 3, 3, 0], []),
        ([2, 2, 3, 3, 3, 0], [(2, 5)]),
        ([3, 3, 3], [(0, 2)]),
        ([3, 3, 0], []),
    ],
)
def test_hand_made_days(spark, counts, expected):
    found = windows.availability_windows(_forecast(spark, {(1, 1): counts}), settings=HOURLY)
    got = sorted((r.start_min // 60, r.end_min // 60) for r in found.collect())
    assert got == expected


def test_day_boundary(spark):
    days = {(1, 1): [3, 3, 3], (1, 2): [3, 3, 3, 0]}
    found = windows.availability_windows(_forecast(spark, days), settings=HOURLY).collect()
    assert sorted((r.dow, r.start_min, r.end_min) for r in found) == [(1, 0, 120), (2, 0, 180)]


@pytest.mark.parametrize("opening, closing, least", [(2, 2, 2), (3, 3, 1), (4, 2, 1), (2, 4, 0), (3, 1, 2)])
def test_random_days_equal_state_machine(spark, opening, closing, least):
    rng = random.Random(opening * 100 + closing * 10 + least)
    days = {
        (site, dow): [rng.randint(0, 5) for _ in range(24)] for site in range(150) for dow in range(1, 8)
    }
    settings = replace(HOURLY, open_at=opening, close_at=closing, min_slots=least)
    found = windows.availability_windows(_forecast(spark, days), settings=settings).collect()
    got = {key: [] for key in days}
    for r in sorted(found, key=lambda r: (r.site_id, r.dow, r.window_no)):
        got[r.site_id, r.dow].append((r.start_min // 60, r.end_min // 60, r.n_cont))
    expected = {key: _machine(counts, opening, closing, least) for key, counts in days.items()}
    assert got == expected


def _windows(spark, rows):
    return spark.createDataFrame(
        rows, "site_id int, dow int, window_no int, start_min int, end_min int, n_cont int"
    )


def test_insights_by_place_in_day(spark):
    rows = [
        (1, 2, 1, 0, 8 * 60 + 20, 9),  # first, ends in time: morning
        (1, 2, 2, 600, 602, 1),  # too short
        (1, 2, 3, 720, 780, 9),  # midday 1
        (1, 2, 4, 960, 964, 2),  # midday 2: starts and lasts exactly enough
        (1, 2, 5, 961, 1000, 9),  # starts too late
        (1, 2, 6, 1020, 1438, 9),  # last: afternoon
        (1, 3, 1, 500, 510, 3),  # only one: all day
        (1, 4, 1, 0, 571, 9),  # first, ends too late: nothing
        (1, 4, 2, 700, 1000, 9),  # last, however early
    ]
    got = sorted(
        (r.dow, r.type, r.order, r.msg) for r in windows.insights(_windows(spark, rows)).collect()
    )
    assert got == [
        (2, 0, 0, "On Monday, all charge ports are taken up by 08:20AM"),
        (2, 1, 1, "On Monday, some charge ports are available between 12:00PM and 01:00PM"),
        (2, 1, 2, "On Monday, some charge ports are available between 04:00PM and 04:04PM"),
        (2, 2, 0, "On Monday, at the end of the day, charge ports start to be available at 05:00PM"),
        (3, 3, 0, "On Tuesday, charge ports are available the entire day"),
        (4, 2, 0, "On Wednesday, at the end of the day, charge ports start to be available at 11:40AM"),
    ]


def test_afternoon_start_is_applied_on_request(spark):
    rows = [(1, 4, 1, 0, 500, 9), (1, 4, 2, 700, 1000, 9)]
    strict = replace(Settings(), apply_afternoon_min_start=True)
    got = {r.type for r in windows.insights(_windows(spark, rows), settings=strict).collect()}
    assert got == {0, 1}


def test_schedule_on_reference_week(spark):
    rows = [(1, 1, 1, 8 * 60 + 20, 423, 2), (1, 7, 1, 0, 1438, 2)]
    got = {r.dow: r for r in windows.window_schedule(_windows(spark, rows)).collect()}
    assert got[1].start_utc == "20171112T162000Z"
    assert got[1].name == "available window: 1;8:20-7:3"
    assert (got[7].start_utc, got[7].end_utc) == ("20171118T080000Z", "20171119T075800Z")


def test_without_sites(spark):
    one = _forecast(spark, {(1, 1): [0, 3, 3, 3, 1]}).drop("site_id")
    found = windows.availability_windows(one, settings=HOURLY, keys=())
    assert [(r.start_min, r.end_min) for r in found.collect()] == [(60, 240)]
    assert windows.insights(found, settings=HOURLY, keys=()).count() == 1
