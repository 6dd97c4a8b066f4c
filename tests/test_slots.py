"""Time expressions, condensing, counts, status."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from statuspulse.functions import codes, text, time
from statuspulse.operators import slots, status
from statuspulse.params import Settings, clock_minutes

GMT = Settings(zone="UTC")
READING = "site_id int, device_id string, outlet_id string, ts timestamp_ntz, status string"


def _readings(spark, rows):
    return spark.createDataFrame([(1, "d", "outlet_1", *row) for row in rows], READING)


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_first_of_slot_is_kept(spark):
    at = [datetime(2024, 5, 1, 8, 0, 10), datetime(2024, 5, 1, 8, 1, 10), datetime(2024, 5, 1, 8, 2, 10)]
    rows = _readings(spark, zip(reversed(at), ["c", "b", "a"], strict=True))
    for statuses in (("a", "b", "c"), None):
        kept = slots.condense(rows, settings=GMT, statuses=statuses).orderBy("ts").collect()
        assert [(r.ts, r.status, r.hour, r.slot) for r in kept] == [
            (at[0], "a", 8, 0), (at[2], "c", 8, 1),
        ]


def test_unlisted_status_still_creates_its_slot(spark):
    at = datetime(2024, 5, 1, 8)
    for value in (None, "broken"):
        counts = slots.slot_counts(slots.condense(_readings(spark, [(at, value)])))
        row = counts.first()
        assert (row.avail_count, row.unknown_count, row.reading_count) == (0, 0, 1)
    kept = slots.condense(_readings(spark, [(at, "broken")]), statuses=None).first()
    assert kept.status == "broken"


def test_slot_without_available_counts_zero(spark):
    rows = _readings(spark, [(datetime(2024, 5, 1, 8), "in_use"), (datetime(2024, 5, 1, 9), "available")])
    counts = slots.slot_counts(slots.condense(rows, settings=GMT), settings=GMT)
    got = {r.hour: r.avail_count for r in counts.collect()}
    assert got == {8: 0, 9: 1}  # and 10 does not exist


def test_repeated_hour_counts_both_passes(spark):
    """Clocks go back on 3 November 2024: 01:00 local comes at 08:00 and at 09:00 GMT."""
    rows = _readings(
        spark,
        [
            (datetime(2024, 11, 3, 8, 0, 30), "available"),
            (datetime(2024, 11, 3, 8, 1), "in_use"),
            (datetime(2024, 11, 3, 9, 0, 30), "available"),
            (datetime(2024, 11, 3, 10, 0, 30), "available"),
        ],
    )
    counts = slots.slot_counts(slots.condense(rows)).orderBy("slot_start").collect()
    assert [(r.hour, r.slot, r.avail_count, r.reading_count) for r in counts] == [
        (1, 0, 2, 2), (2, 0, 1, 1),
    ]


def test_local_calendar(spark):
    rows = slots.with_slots(_readings(spark, [(datetime(2017, 10, 7, 6, 3, 54), "in_use")]))
    r = rows.first()
    assert (r.slot_date, r.dow, r.hour, r.slot) == (date(2017, 10, 6), 6, 23, 1)
    key = rows.select(text.slot_key(F.col("slot_date"), F.col("dow"), F.col("hour"), F.col("slot")))
    assert key.first()[0] == "09_06_06_23_01"


def test_arrival_order_repeats_after_step_back(spark):
    at = [datetime(2024, 5, 1, 8, m) for m in (0, 1, 2, 1, 3)]
    rows = [(1, "d", "o", t, "x", i) for i, t in enumerate(at)]
    df = slots.with_slots(
        spark.createDataFrame(rows, READING + ", seq int"), settings=GMT
    )
    for width in (1, 2, 100):
        kept = slots.suppress_repeats(df, order=["seq"], chunk=F.floor(F.col("seq") / width))
        assert sorted(r.seq for r in kept.collect()) == [0, 2, 3, 4]


def test_slot_width_must_divide_the_hour():
    with pytest.raises(ValueError):
        Settings(slot_minutes=7)


def test_devices(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "device_id string")
    listed = spark.createDataFrame([("a",), ("c",)], "device_id string")
    names = lambda rows: sorted(r.device_id for r in rows.collect())
    assert names(slots.exclude_devices(df, ["b"])) == ["a", "c"]
    assert names(slots.exclude_devices(df, listed)) == ["b"]
    assert names(slots.managed_devices(df, ["b"])) == ["b"]
    assert names(slots.managed_devices(df, listed)) == ["a", "c"]


def test_holidays(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 2),)], "slot_date date")
    days = df.limit(1)
    assert {r.holiday for r in slots.with_holiday(df).collect()} == {False}
    got = {r.slot_date.day: r.holiday for r in slots.with_holiday(df, days).collect()}
    assert got == {1: True, 2: False}


def test_latest_counts_and_audit(spark):
    rows = spark.createDataFrame(
        [
            (1, "d", "outlet_1", datetime(2024, 5, 1, 8), "available"),
            (1, "d", "outlet_1", datetime(2024, 5, 1, 9), "in_use"),
            (1, "d", "outlet_2", datetime(2024, 5, 1, 8), "available"),
            (1, "e", "outlet_1", datetime(2024, 5, 1, 7), "lost"),
            (1, "e", "outlet_2", datetime(2024, 5, 1, 7), None),
        ],
        READING,
    )
    r = status.status_counts(status.latest_readings(rows)).first()
    assert (r.avail, r.in_use, r.unknown, r.total, r.ts.hour) == (1, 1, 0, 2, 9)
    audit = {x.status: x.readings for x in status.invalid_status_counts(rows).collect()}
    assert audit == {"lost": 1, None: 1}


@pytest.mark.parametrize(
    "text_in, ok",
    [
        ("2017-10-06 23:00:54.123", True),
        ("2017-10-06 23:00:54.123456", True),
        ("2017-10-06", False),
        ("2017-13-06 23:00:54.123", False),
        ("soon", False),
    ],
)
def test_parse_gmt(spark, text_in, ok):
    assert (_value(spark, time.parse_gmt(F.lit(text_in))) is not None) == ok


@pytest.mark.parametrize(
    "old, new, total, expected",
    [(4, 3, None, "-25%"), (3, 4, None, "+33.33%"), (0, 2, 0, ""), (2, 2, None, "+0%"), (None, 2, None, None)],
)
def test_percent_change(spark, old, new, total, expected):
    as_column = lambda v: None if v is None else F.lit(v)
    got = text.percent_change_text(F.lit(old).cast("int"), F.lit(new), as_column(total))
    assert _value(spark, got) == expected


def test_number_texts(spark):
    assert _value(spark, text.two_decimals(F.lit(0.25))) == ".25"
    assert _value(spark, text.percent_text(F.lit(12.5))) == "12.5%"
    assert _value(spark, text.percent_text(text.percent(F.lit(1), F.lit(0)))) is None


@pytest.mark.parametrize(
    "minutes, expected",
    [(0, "0"), (5, "5 minutes"), (120, "2 hours"), (125, "2 hours, 5 minutes"), (61, "1 hours, 1 minutes")],
)
def test_duration(spark, minutes, expected):
    assert _value(spark, text.duration_text(F.lit(minutes))) == expected


def test_small_helpers(spark):
    device, outlet = text.split_outlet_key(F.lit("121407_outlet_1"))
    assert (_value(spark, device), _value(spark, outlet)) == ("121407", "outlet_1")
    assert clock_minutes("9:30") == 570
    assert _value(spark, codes.day_name(F.lit(1))) == "Sunday"
    assert _value(spark, codes.status_code(F.lit("in_use"))) == 2
    assert _value(spark, codes.status_label(F.lit(1))) == "available"
    assert _value(spark, codes.outlet_code(F.lit("outlet_2"))) == 2
    moved = time.replace_date(F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"), 2020, 2, 29)
    assert _value(spark, moved) == datetime(2020, 2, 29, 7, 8, 9)


@pytest.mark.parametrize("session_zone", ["America/Los_Angeles", "Asia/Kolkata"])
def test_results_do_not_depend_on_the_session_zone(spark, session_zone):
    rows = _readings(spark, [(datetime(2024, 3, 10, h, 30), "available") for h in range(24)])
    before = slots.slot_counts(slots.condense(rows)).orderBy("slot_start").collect()
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        assert slots.slot_counts(slots.condense(rows)).orderBy("slot_start").collect() == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_slots_align():
    assert time.slots_align("America/Los_Angeles", 60)
    assert time.slots_align("Asia/Kolkata", 30) and not time.slots_align("Asia/Kolkata", 60)
    assert time.slots_align("Asia/Kathmandu", 15) and not time.slots_align("Asia/Kathmandu", 30)


def test_zone_off_the_gmt_slots(spark):
    """Half-hour zone, hourly slots: 03:15 and 03:45 GMT are 08:45 and 09:15 in Kolkata."""
    rows = _readings(
        spark,
        [(datetime(2024, 5, 1, 3, 15), "available"), (datetime(2024, 5, 1, 3, 45), "available"),
         (datetime(2024, 5, 1, 4, 15), "in_use")],
    )
    settings = Settings(zone="Asia/Kolkata", slot_minutes=60)
    counts = slots.slot_counts(slots.condense(rows, settings=settings), settings=settings)
    got = {r.hour: (r.avail_count, r.reading_count) for r in counts.collect()}
    assert got == {8: (1, 1), 9: (1, 1)}


def test_repeated_half_hour_off_the_gmt_slots(spark):
    """Lord Howe puts its clock back by 30 minutes: hourly slots, two passes of 01:30."""
    rows = _readings(
        spark,
        [(datetime(2024, 4, 6, 14, 40), "available"), (datetime(2024, 4, 6, 15, 10), "available")],
    )
    settings = Settings(zone="Australia/Lord_Howe", slot_minutes=60)
    assert not time.slots_align(settings.zone, 60)
    row = slots.slot_counts(slots.condense(rows, settings=settings), settings=settings).first()
    assert (row.hour, row.avail_count, row.reading_count) == (1, 2, 2)
