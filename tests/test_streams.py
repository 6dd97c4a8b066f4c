"""Streams fed in several batches, and restarted, against the batch operators."""

import hashlib
import json
import random
import zipfile
from dataclasses import replace
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from statuspulse import schemas
from statuspulse.operators import lookahead, slots, transitions
from statuspulse.params import Settings
from statuspulse.plans import live
from statuspulse.sources import archives, latest
from statuspulse.streaming import backlog, monitor, reorder, slot_stream
from statuspulse.streaming.run import newest_version, run_available, stream_files, write_batches
from workload import adapter, queries

# dense enough to have windows and notices
SF_DIR = "/root/testdata/sf0.01"

SETTINGS = replace(adapter.SETTINGS, velocity_counts=(1, 2, 3))


@pytest.fixture(scope="module")
def counts(spark):
    return queries.counts(spark, SF_DIR).persist()


@pytest.fixture(scope="module")
def polls(counts):
    return transitions.polls_from_counts(counts, settings=SETTINGS).persist()


def _thirds(polls):
    """Three parts in time order."""
    day = F.dayofmonth("ts")
    stamped = polls.withColumn("ts", F.col("ts").cast("timestamp"))
    return [stamped.where(day < 10), stamped.where((day >= 10) & (day < 20)), stamped.where(day >= 20)]


def _rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_changes_over_restarts_equal_batch(spark, polls, tmp_path):
    source, out = str(tmp_path / "polls"), str(tmp_path / "out")
    for part in _thirds(polls):
        part.write.mode("append").parquet(source)
        stream = monitor.live_changes(stream_files(spark, source, schemas.POLLS), settings=SETTINGS)
        got = run_available(monitor.with_means(stream, settings=SETTINGS), out, mode="append")
    batch = transitions.with_velocities(transitions.changes(polls), settings=SETTINGS)
    columns = ["site_id", "kind", "avail", "avail_old", "in_use_old", "unknown_old", "total",
               "velocity", "means"]
    ts = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    assert _rows(got, ts, *columns) == _rows(batch, ts, *columns)
    assert got.select("batch").distinct().count() >= 3


def test_backlog_over_restarts_equals_batch(spark, counts, polls, tmp_path):
    """Several micro-batches, each continued from the tables of the one before."""
    source, root = str(tmp_path / "polls"), str(tmp_path / "backlog")
    intervals = queries.week_insights(counts).persist()
    for part in [*_thirds(polls), _thirds(polls)[0]]:  # the last part is old news
        part.write.mode("append").parquet(source)
        stream = stream_files(spark, source, schemas.POLLS)
        backlog.watch_changes(stream, f"{root}/changes", settings=SETTINGS).awaitTermination()
        backlog.watch_edges(stream, intervals, f"{root}/edges", settings=SETTINGS).awaitTermination()
    batch = transitions.with_velocities(transitions.changes(polls), settings=SETTINGS)
    columns = ["site_id", "ts", "kind", "avail", "avail_old", "in_use_old", "velocity", "means"]
    assert _rows(spark.read.parquet(f"{root}/changes/rows"), *columns) == _rows(batch, *columns)
    placed = lookahead.next_interval(polls, intervals, settings=SETTINGS)
    told = lookahead.throttle(
        lookahead.lookahead_alerts(placed, settings=SETTINGS), settings=SETTINGS
    )
    got = spark.read.parquet(f"{root}/edges/rows")
    assert got.select("batch").distinct().count() == 3
    assert _rows(got, "site_id", "ts", "text") == _rows(told, "site_id", "ts", "text")


def test_backlog_batch_is_repeated_after_a_failure(spark, polls, tmp_path, monkeypatch):
    """The second batch fails after it wrote its rows; the restart gives the same as no failure."""
    source, path = str(tmp_path / "polls"), str(tmp_path / "backlog")
    write, failures = backlog.write_state, []

    def failing(df, where, *, batch):
        if batch == 1 and where.endswith("/last") and not failures:
            failures.append(where)
            raise OSError("lost")
        write(df, where, batch=batch)

    monkeypatch.setattr(backlog, "write_state", failing)
    for part in _thirds(polls):
        part.write.mode("append").parquet(source)
        for _ in range(2):
            try:
                stream = stream_files(spark, source, schemas.POLLS)
                backlog.watch_changes(stream, path, settings=SETTINGS).awaitTermination()
                break
            except StreamingQueryException:
                assert failures
    batch = transitions.with_velocities(transitions.changes(polls), settings=SETTINGS)
    columns = ["site_id", "ts", "kind", "avail", "avail_old", "velocity", "means"]
    assert failures
    assert _rows(spark.read.parquet(f"{path}/rows"), *columns) == _rows(batch, *columns)


def test_old_polls_are_set_aside(spark, polls, tmp_path):
    source, out = str(tmp_path / "polls"), str(tmp_path / "out")
    first, second, _ = _thirds(polls)
    counts = []
    for part in (second, first):
        part.write.mode("append").parquet(source)
        stream = monitor.live_changes(stream_files(spark, source, schemas.POLLS), settings=SETTINGS)
        rows = run_available(stream, out, mode="append")
        counts.append((monitor.on_time(rows).count(), monitor.late_polls(rows).count()))
    assert counts == [(counts[0][0], 0), (counts[0][0], first.count())]


def _shuffled(polls, seed, parts):
    part = F.pmod(F.xxhash64(F.lit(seed), "site_id", "ts"), F.lit(parts))
    stamped = polls.withColumn("ts", F.col("ts").cast("timestamp"))
    return [stamped.where(part == k) for k in range(parts)]


def test_any_split_gives_the_batch_rows(spark, counts, polls, tmp_path):
    """Polls dealt over micro-batches at random, and some twice, in both engines."""
    held = replace(SETTINGS, late_minutes=60 * 24 * 60)
    polls = polls.where((F.col("site_id") < 2) & (F.dayofmonth("ts") < 8))
    source, root = str(tmp_path / "polls"), str(tmp_path / "out")
    intervals = queries.week_insights(counts).persist()
    one, two = _shuffled(polls, 1, 2)
    closed = one.unionByName(reorder.closing(one.unionByName(two), settings=held))
    for part in [one, two, closed]:
        part.write.mode("append").parquet(source)
        stream = stream_files(spark, source, schemas.POLLS)
        found = monitor.with_means(monitor.live_changes(stream, settings=held), settings=held)
        changed = run_available(found, f"{root}/state", mode="append")
        notices = run_available(
            monitor.live_notices(stream, intervals, settings=held), f"{root}/state_edges", mode="append"
        )
        backlog.watch_changes(stream, f"{root}/days", settings=held).awaitTermination()
        backlog.watch_edges(stream, intervals, f"{root}/edges", settings=held).awaitTermination()
    batch = transitions.with_velocities(transitions.changes(polls), settings=held)
    placed = lookahead.next_interval(polls, intervals, settings=held)
    told = lookahead.throttle(lookahead.lookahead_alerts(placed, settings=held), settings=held)
    ts = F.col("ts").cast("timestamp_ntz").alias("ts")
    columns = ["site_id", ts, "kind", "avail", "avail_old", "in_use_old", "velocity", "means"]
    for got in (monitor.on_time(changed), spark.read.parquet(f"{root}/days/rows")):
        assert _rows(got, *columns) == _rows(batch, *columns)
    columns = ["site_id", ts, "kind", "start_min", "text", "local_ts"]
    for got in (monitor.on_time(notices), spark.read.parquet(f"{root}/edges/rows")):
        assert _rows(got, *columns) == _rows(told, *columns) != []
    assert changed.where("late").count() == backlog.late_polls(spark, f"{root}/days").count() == 0


def _poll(site, minute, avail):
    ts = f"2024-05-01 08:{minute:02d}:00"
    return site, ts, avail, 10 - avail, 0, 10


def test_late_polls_are_counted_and_change_nothing(spark, tmp_path):
    """Held for five minutes: 08:02 comes in time, 08:01 does not; another site's clock frees a silent one."""
    held = replace(SETTINGS, late_minutes=5)
    source, root = str(tmp_path / "polls"), str(tmp_path / "out")
    arrivals = [
        [_poll(1, 0, 5), _poll(1, 4, 3), _poll(2, 1, 7), _poll(2, 1, 6)],
        [_poll(1, 2, 4), _poll(1, 8, 1)],
        [_poll(1, 1, 9), _poll(1, 1, 9), _poll(3, 40, 2)],
    ]
    schema = "site_id long, ts string, avail long, in_use long, unknown long, total long"
    for part in arrivals:
        rows = spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp"))
        rows.write.mode("append").parquet(source)
        stream = stream_files(spark, source, schemas.POLLS)
        for by_day in (False, True):
            live.watch_changes(stream, f"{root}/{by_day}", settings=held, by_day=by_day).awaitTermination()
    for by_day in (False, True):
        found = spark.read.parquet(f"{root}/{by_day}/changes/rows")
        found = monitor.on_time(found) if "late" in found.columns else found
        got = [(r.site_id, r.minute, r.avail_old, r.avail, r.kind) for r in found.withColumn("minute", F.minute("ts")).collect()]
        assert sorted(got, key=lambda r: r[:2]) == [
            (1, 0, None, 5, "initial"), (1, 2, 5, 4, "decreased"), (1, 4, 4, 3, "decreased"),
            (1, 8, 3, 1, "decreased"), (2, 1, None, 6, "initial"),
        ]
        late = live.late_polls(spark, f"{root}/{by_day}").select("site_id", F.minute("ts"), "avail").collect()
        assert [tuple(r) for r in late] == [(1, 1, 9), (1, 1, 9)]


def test_live_monitor_tables(spark, counts, polls, tmp_path):
    source, root = str(tmp_path / "polls"), str(tmp_path / "live")
    intervals = queries.week_insights(counts).persist()
    for part in _thirds(polls):
        part.write.mode("append").parquet(source)
        stream = stream_files(spark, source, schemas.POLLS)
        live.watch_changes(stream, root, settings=SETTINGS).awaitTermination()
        live.watch_edges(stream, intervals, root, settings=SETTINGS).awaitTermination()

    stats = live.current_stats(spark, root)
    batch = transitions.current_stats(transitions.changes(polls), settings=SETTINGS)
    columns = ["site_id", "init", "kind", "avail", "avail_old", "pct_avail_text", "pct_change_text"]
    assert _rows(stats, *columns) == _rows(batch, *columns)

    placed = lookahead.next_interval(polls, intervals, settings=SETTINGS)
    told = lookahead.throttle(
        lookahead.lookahead_alerts(placed, settings=SETTINGS), settings=SETTINGS
    )
    expected = lookahead.current_prediction(told, told.select("site_id").distinct())
    columns = ["site_id", "predictiontype", "durationstr", "datestr"]
    assert _rows(live.current_predictions(spark, root), *columns) == _rows(expected, *columns)

    alerts = live.routed_alerts(spark, root)
    by_channel = {r.channel: r["count"] for r in alerts.groupBy("channel").count().collect()}
    changed = transitions.changes(polls)
    assert by_channel["forecast"] == told.count()
    assert by_channel["default"] == told.count() + changed.count()
    predicted = alerts.where(F.col("fields")["Predict"].isNotNull() & (F.col("channel") == "default"))
    assert predicted.count() == (
        transitions.time_to_empty(
            transitions.with_velocities(changed, settings=SETTINGS), settings=SETTINGS
        ).select("site_id", "ts").distinct().count()
    )


def test_notices_for_every_site(spark, counts, polls, tmp_path):
    """Intervals without a site hold for all sites."""
    fleet = queries.week_insights(counts).where("site_id = 0").drop("site_id").persist()
    source = str(tmp_path / "polls")
    polls.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    stream = monitor.live_notices(
        stream_files(spark, source, schemas.POLLS), fleet, settings=SETTINGS, interval_keys=()
    )
    got = run_available(stream, str(tmp_path / "out"), mode="append")
    placed = lookahead.next_interval(polls, fleet, settings=SETTINGS, keys=())
    batch = lookahead.throttle(lookahead.lookahead_alerts(placed, settings=SETTINGS), settings=SETTINGS)
    ts = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    assert _rows(got, "site_id", ts, "text") == _rows(batch, "site_id", ts, "text")


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Kolkata"])
def test_slot_streams_over_batches(spark, tmp_path, zone):
    readings = adapter.readings(spark, SF_DIR)
    source = str(tmp_path / "events")
    settings = Settings(slot_minutes=60, zone=zone)
    parts = [readings.where(F.dayofmonth("ts") < 15), readings.where(F.dayofmonth("ts") >= 15)]
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = stream_files(spark, source, readings.schema)
        condensed = run_available(
            slot_stream.condense(stream, settings=settings, delay="2 hours"),
            str(tmp_path / "condensed"), mode="update",
        )
        first = run_available(
            slot_stream.first_in_slot(stream, settings=settings, delay="2 hours"),
            str(tmp_path / "first"), mode="append",
        )
    latest = slot_stream.localised(
        newest_version(condensed, [*slots.OUTLET_KEY, "slot_gmt"]), settings=settings
    )
    batch = slots.condense(readings, settings=settings)
    columns = [*slots.OUTLET_KEY, "status", "slot_date", "dow", "hour", "slot"]
    assert _rows(latest, *columns) == _rows(batch, *columns)
    assert first.count() == batch.count()


@pytest.mark.parametrize("change", ["2024-04-06 15:00:00", "2024-10-05 15:30:00"])
@pytest.mark.parametrize("width", [60, 20])
def test_slots_that_are_no_windows(spark, tmp_path, change, width):
    """A zone whose clock is moved by half an hour, over the change, in three files."""
    settings = Settings(slot_minutes=width, zone="Australia/Lord_Howe")
    middle = datetime.fromisoformat(change)
    rng, rows = random.Random(width), []
    for minute in range(-600, 600, 7):
        for outlet in (1, 2):
            status = rng.choice(["available", "in_use", "unknown"])
            rows.append((1, 5, outlet, status, middle + timedelta(minutes=minute + outlet)))
    schema = "site_id long, device_id long, outlet_id int, status string, ts timestamp_ntz"
    source = str(tmp_path / "readings")
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        stream = stream_files(spark, source, schema)
        out = {
            name: run_available(run(stream, settings=settings, delay="3 hours"), str(tmp_path / name), mode=mode)
            for name, run, mode in (
                ("condensed", slot_stream.condense, "update"),
                ("counts", slot_stream.window_counts, "update"),
                ("first", slot_stream.first_in_slot, "append"),
            )
        }
    batch = slots.condense(spark.createDataFrame(rows, schema), settings=settings)
    latest = newest_version(out["condensed"], [*slots.OUTLET_KEY, *slot_stream.slot_key(settings)])
    columns = [*slots.OUTLET_KEY, "status", "slot_date", "dow", "hour", "slot"]
    assert _rows(slot_stream.localised(latest, settings=settings), *columns) == _rows(batch, *columns)
    assert latest.where("second_pass").count() == (2 * (1 if width == 60 else 2) if change < "2024-05" else 0)
    assert out["first"].count() == batch.count()
    counted = newest_version(out["counts"], ["site_id", "slot_start", *slot_stream.IRREGULAR])
    assert counted.agg(F.sum("reading_count")).first()[0] == len(rows)
    assert counted.count() == batch.where("outlet_id = 1").count()


def test_delays_shorter_than_a_slot(spark):
    readings = adapter.readings(spark, SF_DIR)
    with pytest.raises(ValueError, match="shorter"):
        slot_stream.first_in_slot(readings, settings=Settings(slot_minutes=60), delay="10 minutes")


def test_snapshot_poll(spark):
    row = live.snapshot_poll(adapter.readings(spark, SF_DIR).where("site_id = 0")).first()
    assert row.total == row.avail + row.in_use + row.unknown > 0


def _archive(root, day, station, clock, one, two):
    folder = root / day / station
    folder.mkdir(parents=True, exist_ok=True)
    ports = {"outlet_1": {"status": one}, "outlet_2": {"status": two}}
    doc = [{"time": f"{day} {clock}.000", "summaries": [{"device_id": station, "port_status": ports}]}]
    with zipfile.ZipFile(folder / f"{clock}.zip", "w") as z:
        z.writestr("status.json", json.dumps(doc))


def test_archive_stream_to_statistics(spark, tmp_path):
    """Archives arrive in three batches; a station that is silent keeps its last state."""
    files, root = tmp_path / "archives", str(tmp_path / "live")
    batches = [
        [("08:00:00", "a", "available", "available"), ("08:00:10", "b", "in_use", "available")],
        [("08:01:00", "a", "in_use", "available")],
        [("08:02:00", "b", "in_use", "in_use"), ("08:02:30", "a", "in_use", "unknown")],
    ]
    for batch in batches:
        for clock, station, one, two in batch:
            _archive(files, "2024-05-01", station, clock, one, two)
        stream = archives.archive_readings(
            archives.parse_archives(archives.stream_archives(spark, str(files)))
        )
        live.watch_snapshots(stream, root).awaitTermination()
        polls = stream_files(spark, f"{root}/polls", schemas.POLLS)
        live.watch_changes(polls, root, settings=SETTINGS).awaitTermination()
    rows = spark.read.schema(schemas.POLLS).parquet(f"{root}/polls").orderBy("ts").collect()
    assert [(r.avail, r.in_use, r.unknown, r.total) for r in rows] == [
        (3, 1, 0, 4), (2, 2, 0, 4), (0, 3, 1, 4),
    ]
    stats = live.current_stats(spark, root).collect()
    assert [(r.kind, r.avail, r.avail_old, r.pct_change_text) for r in stats] == [
        ("went_to_zero", 0, 2, "-100%")
    ]


def _latest(root, station, clock, one, two):
    _archive(Path(root), "stations", station, clock, one, two)
    Path(root, "latest").mkdir(exist_ok=True)
    unfinished = Path(root, "latest", f".{station}")
    unfinished.write_bytes(Path(root, "stations", station, f"{clock}.zip").read_bytes())
    unfinished.replace(Path(root, "latest", f"{station}.zip"))


def _polled(stream, out):
    """One run over what is there now; the paths and contents of all runs so far."""
    rows = stream.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("station"), F.md5("content").alias("sum"))
    write_batches(rows, out, mode="append").awaitTermination()
    stored = rows.sparkSession.read.schema("station string, sum string").parquet(f"{out}/rows")
    return sorted((r.station, r.sum) for r in stored.collect())


def test_replaced_files_come_again_and_a_restart_repeats_none(spark, tmp_path):
    files, out = str(tmp_path / "files"), str(tmp_path / "out")
    (tmp_path / "files").mkdir()
    stream = latest.stream_latest(spark, files)  # the folder is not there yet
    expected = []
    assert _polled(stream, out) == []
    for clock, stations in (("08:00:00", "ab"), ("08:01:00", "a"), ("08:02:00", "abc"), ("08:03:00", "")):
        for station in stations:
            _latest(files, station, clock, "available", "in_use")
            content = Path(files, "latest", f"{station}.zip").read_bytes()
            expected.append((station, hashlib.md5(content).hexdigest()))
        assert _polled(stream, out) == sorted(expected)
        assert _polled(stream, out) == sorted(expected)  # nothing was replaced
    Path(files, "latest", "b.zip").unlink()
    assert _polled(stream, out) == sorted(expected)


def test_a_file_replaced_after_its_listing_is_left_to_the_next(tmp_path):
    file = tmp_path / "a.zip"
    reader = latest.ReplacedFilesReader(str(tmp_path), ".zip", 1)
    assert reader.latestOffset() == reader.initialOffset() == {}
    file.write_bytes(b"first")
    listed = reader.latestOffset()
    assert [b.column(2).to_pylist() for p in reader.partitions({}, listed) for b in reader.read(p)] == [[b"first"]]
    file.write_bytes(b"second")
    (tmp_path / "b.zip").write_bytes(b"")
    assert [b for p in reader.partitions({}, listed) for b in reader.read(p)] == []
    again = reader.latestOffset()
    tasks = reader.partitions(listed, again)
    assert [b.column(2).to_pylist() for p in tasks for b in reader.read(p)] == [[b"second"], [b""]]
    assert list(reader.partitions(again, again)) == []
    file.unlink()
    assert [b.num_rows for p in tasks for b in reader.read(p)] == [1]
    assert list(reader.partitions(again, reader.latestOffset())) == []


def test_put_files_replaces_whole_files(spark, tmp_path):
    for content in (b"one", b"three"):
        rows = [("x/a.zip", content), ("b.zip", content * 2), ("c.zip", None), (None, content)]
        latest.put_files(spark.createDataFrame(rows, "path string, content binary"), f"file:{tmp_path}")
        found = {str(f.relative_to(tmp_path)): f.read_bytes() for f in tmp_path.rglob("*") if f.is_file()}
        assert {k: v for k, v in found.items() if not k.endswith(".crc")} == {"x/a.zip": content, "b.zip": content * 2}
