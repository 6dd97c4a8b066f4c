"""Archives, history bounds, ledger runs, tables."""

import io
import json
import zipfile
from dataclasses import replace
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from statuspulse.operators import forecast
from statuspulse.params import Settings
from statuspulse.plans import refresh
from statuspulse.sources import archives, history, tables, zones


def _zip(*texts):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("folder/", "")
        for i, t in enumerate(texts):
            z.writestr(f"folder/{i}.json", t)
    return buffer.getvalue()


def _doc(device="121403", time="2017-10-06 23:00:54.123", **ports):
    ports = ports or {"outlet_1": {"status": "available"}, "outlet_2": {"status": "in_use"}}
    return json.dumps([{"time": time, "summaries": [{"device_id": device, "port_status": ports}]}])


@pytest.fixture
def archive_root(tmp_path):
    def put(name, content):
        file = tmp_path / "2017-10-06" / "121403" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)

    put("00:00:01.zip", _zip(_doc()))
    put("00:00:02.zip", b"this is no archive")
    put("00:00:03.zip", _zip("{not json"))
    put("00:00:04.zip", _zip(_doc(outlet_1={"status": "available"})))
    put("00:00:05.zip", _zip(_doc(time="yesterday")))
    put("00:00:06.zip", _zip(_doc(), "[]", _doc()))
    put("00:00:07.zip", _zip(_doc(outlet_1={}, outlet_2={"status": "in_use"})))
    put("00:00:08.zip", _zip(_doc())[:-40])
    put("00:00:09.zip", _zip(_doc().strip("[]")))  # no array
    put("notes.txt", b"not an archive file")
    return str(tmp_path)


def test_archives(spark, archive_root):
    raw = archives.read_archives(spark, archive_root)
    parsed = archives.parse_archives(raw)
    name = F.regexp_extract("path", r"(\d\d)\.zip$", 1).alias("n")
    bad = {r.n: (r.error, r.documents_kept) for r in
           archives.quarantine(parsed).select(name, "error", "documents_kept").collect()}
    assert bad == {
        "02": (archives.BAD_ARCHIVE, 0),
        "03": (archives.BAD_JSON, 0),
        "04": (archives.MISSING_FIELD, 0),
        "05": (archives.BAD_TIME, 0),
        "06": (archives.MISSING_FIELD, 1),  # the document before the bad one is kept
        "08": (archives.BAD_ARCHIVE, 0),
        "09": (archives.BAD_JSON, 0),
    }
    good = archives.archive_readings(parsed).select(name, "*").collect()
    assert sorted((r.n, r.outlet_id, r.status) for r in good) == [
        ("01", "outlet_1", "available"), ("01", "outlet_2", "in_use"),
        ("06", "outlet_1", "available"), ("06", "outlet_2", "in_use"),
        ("07", "outlet_1", None), ("07", "outlet_2", "in_use"),
    ]
    assert {r.ts for r in good} == {datetime(2017, 10, 6, 23, 0, 54, 123000)}


def test_archive_paths_and_latest(spark):
    rows = [
        ("file:/x/2017-10-06/121403/23:00:00.zip", b"a"),
        ("file:/x/2017-10-07/121403/01:00:00.zip", b"b"),
        ("file:/x/2017-10-07/121404/00:00:00.zip", b"c"),
    ]
    df = spark.createDataFrame(rows, "path string, content binary")
    parts = archives.with_path_parts(df).collect()
    assert [(r.dir_date, r.station) for r in parts][0] == (date(2017, 10, 6), "121403")
    assert sorted(bytes(r.content) for r in archives.latest_archives(df).collect()) == [b"b", b"c"]


def test_every_element_of_a_document(spark):
    poll = lambda time, *devices: {
        "time": time,
        "summaries": [
            {"device_id": d, "port_status": {"outlet_1": {"status": "available"}, "outlet_2": {"status": "in_use"}}}
            for d in devices
        ],
    }
    first, second = "2017-10-06 23:00:54.123", "2017-10-06 23:01:54.123"
    payload = json.dumps([poll(first, "a", "b", None, "c"), poll("never", "d"), poll(second, "a"), poll(second)])
    df = spark.createDataFrame([("x/latest/a.zip", _zip(payload, _doc()))], "path string, content binary")
    cut, whole = archives.parse_archives(df), archives.parse_archives(df, keep_later=True)

    def devices(parsed):
        return sorted((r.ts.minute, r.device_id) for r in archives.archive_readings(parsed).collect() if r.outlet_id == "outlet_1")

    def dropped(parsed):
        return sorted((r.file, r.poll, r.summary, r.error) for r in archives.dropped_documents(parsed).collect())

    assert devices(cut) == [(0, "a"), (0, "b")]
    assert archives.outcomes(cut).first()["documents_dropped"] == 6
    assert devices(whole) == [(0, "121403"), (0, "a"), (0, "b"), (0, "c"), (1, "a")]
    missing, bad = archives.MISSING_FIELD, archives.BAD_TIME
    assert dropped(whole) == [(0, 0, 2, missing), (0, 1, 0, bad), (0, 3, 0, missing)]
    assert [d[:3] for d in dropped(cut)] == [(0, 0, 2), (0, 0, 3), (0, 1, 0), (0, 2, 0), (0, 3, 0), (1, 0, 0)]


def test_days_and_latest_of_an_archive_tree(spark, archive_root):
    day = date(2017, 10, 6)
    assert archives.archive_days(spark, archive_root) == [day]
    assert archives.read_archives(spark, archive_root, days=[]).count() == 0
    assert archives.read_archives(spark, archive_root, days=[date(2017, 1, 1)]).count() == 0
    assert archives.read_archives(spark, archive_root, days=[date(2017, 1, 1), day]).count() == 9
    assert archives.read_latest(spark, archive_root).count() == 0
    latest = Path(archive_root, "latest")
    latest.mkdir()
    closed = _doc(outlet_1={"status": "unknown"}, outlet_2={"status": "unknown"})
    for content, expected in ((_zip(_doc()), {"available", "in_use"}), (_zip(closed), {"unknown"})):
        for station in "abc":  # replaced in place
            (latest / f"{station}.zip").write_bytes(content)
        polled = archives.latest_archives(archives.read_latest(spark, archive_root))
        assert polled.count() == 3
        said = {r.status for r in archives.archive_readings(archives.parse_archives(polled)).collect()}
        assert said == expected


def test_archive_job(spark, tmp_path):
    """Folders to tables, over two runs: look-back, newest folder out, days done once, pruned reads."""
    files, root = tmp_path / "files", str(tmp_path / "tables")

    def collect(day):
        for clock in ("08:00:00", "09:30:00"):
            file = files / f"2024-05-{day:02}" / "121403" / f"{clock}.zip"
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_bytes(_zip(_doc(time=f"2024-05-{day:02} {clock}.000")))

    for day in (1, 8, 9, 10):
        collect(day)
    run = lambda as_of: refresh.ingest_archives(
        spark, str(files), root, as_of=as_of, settings=SETTINGS, site=F.lit(1)
    )
    assert run(datetime(2024, 5, 10, 12)) == [date(2024, 5, 8), date(2024, 5, 9)]
    assert run(datetime(2024, 5, 10, 13)) == []
    collect(11)
    assert run(datetime(2024, 5, 11, 12)) == [date(2024, 5, 10)]
    raw = spark.read.parquet(f"{root}/raw")
    assert raw.count() == 3 * 2 * 2
    recent = history.readings_within(raw, as_of=datetime(2024, 5, 11, 12), settings=SETTINGS)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "dir_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert refresh.ingest_days(spark, raw, root, as_of=datetime(2024, 5, 11, 12), settings=SETTINGS)
    assert spark.read.parquet(f"{root}/readings").select("slot_date").distinct().count() == 2


def test_late_archives_open_their_day_again(spark, tmp_path):
    """One archive of an old day comes in a folder three days on, one in the old folder itself."""
    files, root = tmp_path / "files", str(tmp_path / "tables")

    def collect(folder, clock, day=None):
        file = files / f"2024-05-{folder:02}" / "121403" / f"{clock}.zip"
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(_zip(_doc(time=f"2024-05-{day or folder:02} {clock}.000")))

    def run(as_of):
        done = refresh.ingest_archives(spark, str(files), root, as_of=as_of, settings=SETTINGS, site=F.lit(1))
        mapped = zones.read_zones(spark, root)
        raw = spark.read.parquet(f"{root}/raw")
        worked = refresh.ingest_days(spark, raw, root, as_of=as_of, settings=SETTINGS, mapped=mapped)
        return [d.day for d in done], worked

    def stored():
        rows = spark.read.parquet(f"{root}/readings")
        return {r.slot_date.day: r["count"] for r in rows.groupBy("slot_date").count().collect()}

    def written(day):
        return sorted((f.name, f.stat().st_mtime_ns) for f in (tmp_path / f"tables/readings/slot_date=2024-05-0{day}").iterdir())

    for day in range(1, 6):
        collect(day, "08:00:00")
    assert run(datetime(2024, 5, 6, 12)) == ([1, 2, 3, 4], True)
    assert stored() == {1: 2, 2: 2, 3: 2}
    first = written(1)
    assert run(datetime(2024, 5, 6, 13)) == ([], False)
    collect(5, "09:00:00", day=2)
    collect(3, "10:00:00")
    collect(6, "08:00:00")
    assert run(datetime(2024, 5, 7, 12)) == ([3, 5], True)
    assert stored() == {1: 2, 2: 4, 3: 4, 4: 2}
    assert written(1) == first
    assert run(datetime(2024, 5, 7, 13)) == ([], False)

    mapped, raw = zones.read_zones(spark, root), spark.read.parquet(f"{root}/raw")
    days = [date(2024, 5, 2)]
    folders = zones.folders_of(mapped, days, settings=SETTINGS)
    assert [d.day for d in folders] == [2, 5]
    read = history.readings_of_days(raw, days, settings=SETTINGS, folders=folders)
    assert read.count() == 4
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "dir_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # without the map: what lies too far from its day is not found, but counted
    assert history.readings_of_days(raw, days, settings=SETTINGS).count() == 2
    assert [tuple(r) for r in history.outside(raw, settings=SETTINGS).collect()] == [(date(2024, 5, 5), 2)]
    wide = replace(SETTINGS, collect_days=3)
    assert history.readings_of_days(raw, days, settings=wide).count() == 4
    assert history.outside(raw, settings=wide).count() == 0


def test_readings_without_a_folder_day_are_kept(spark):
    rows = [(datetime(2024, 5, 2, 9), d) for d in (date(2024, 5, 2), date(2024, 5, 6), None)]
    raw = spark.createDataFrame(rows, "ts timestamp_ntz, dir_date date")
    found = history.readings_of_days(raw, [date(2024, 5, 2)], settings=SETTINGS)
    assert sorted(str(r.dir_date) for r in found.collect()) == ["2024-05-02", "None"]


AS_OF = datetime(2024, 5, 10, 12)


def _days(spark, *days):
    return spark.createDataFrame([(date(2024, 5, d),) for d in days], "slot_date date")


def _listed(df):
    return sorted(r.slot_date.day for r in df.collect())


def test_lookback_is_strict_and_leaves_the_newest(spark):
    table = _days(spark, 1, 3, 4, 5, 8, 9, 10)
    # 3 May 00:00 is 7.5 days before, 4 May 6.5 days
    assert _listed(history.candidate_days(table, as_of=AS_OF)) == [4, 5, 8, 9, 10]
    midnight = datetime(2024, 5, 10)
    assert 3 not in _listed(history.candidate_days(table, as_of=midnight))
    assert _listed(history.complete_days(table, as_of=AS_OF)) == [4, 5, 8, 9]


def test_new_days_and_no_work(spark):
    table = _days(spark, 7, 8, 9, 10)
    assert _listed(history.new_days(table, _days(spark, 7), as_of=AS_OF)) == [8, 9]
    for done in ((7, 8, 9), (7, 8, 9, 10)):
        days = history.new_days(table, _days(spark, *done), as_of=AS_OF)
        assert not history.has_work(days)


def test_ledger_expiry():
    assert history.ledger_expired(None, as_of=AS_OF)
    assert not history.ledger_expired(AS_OF - timedelta(days=7), as_of=AS_OF)
    assert history.ledger_expired(AS_OF - timedelta(days=7, seconds=1), as_of=AS_OF)


SETTINGS = Settings(slot_minutes=60, forest_trees=5, forest_depth=6)


def _raw(spark, first, last):
    """Two outlets, hourly; free at night, taken by day (local)."""
    hours = spark.sql(
        f"SELECT explode(sequence(timestamp'{first} 00:00:00', timestamp'{last} 23:00:00', interval 1 hour)) t"
    )
    local = F.col("t").cast("timestamp_ntz")
    free = F.hour("t").between(1, 6) | F.hour("t").between(18, 21)
    return hours.select(
        F.lit(0).alias("site_id"), F.lit("d").alias("device_id"),
        F.explode(F.array(F.lit("outlet_1"), F.lit("outlet_2"), F.lit("outlet_3"))).alias("outlet_id"),
        F.convert_timezone(F.lit("America/Los_Angeles"), F.lit("UTC"), local).alias("ts"),
        F.when(free, "available").otherwise("in_use").alias("status"),
    )


def test_incremental_ingest(spark, tmp_path):
    root = str(tmp_path)
    run = lambda rows, as_of, **kw: refresh.ingest_days(
        spark, rows, root, as_of=as_of, settings=SETTINGS, **kw
    )
    stored = lambda: sorted(
        (r.slot_date.day, r["count"]) for r in
        spark.read.parquet(f"{root}/readings").groupBy("slot_date").count().collect()
    )
    may10 = datetime(2024, 5, 10, 1)
    assert run(_raw(spark, "2024-05-08", "2024-05-10"), may10)
    assert stored() == [(8, 72), (9, 72)]
    assert not run(_raw(spark, "2024-05-08", "2024-05-10"), may10)  # nothing new
    assert run(_raw(spark, "2024-05-08", "2024-05-11"), datetime(2024, 5, 11, 1))
    assert stored() == [(8, 72), (9, 72), (10, 72)]
    # the ledger is more than a week old: start over from the look-back
    assert run(_raw(spark, "2024-05-08", "2024-05-18"), datetime(2024, 5, 18, 1))
    older = [(8, 72), (9, 72), (10, 72)]  # stay as they are
    assert stored() == older + [(d, 72) for d in range(12, 18)]
    assert run(_raw(spark, "2024-05-08", "2024-05-20"), datetime(2024, 5, 18, 2), rebuild=True)
    assert stored() == older + [(d, 72) for d in range(12, 18)]  # nothing after as_of


def test_refresh_end_to_end(spark, tmp_path):
    root, as_of = str(tmp_path), datetime(2024, 5, 18, 1)
    wide = Settings(slot_minutes=60, forest_trees=5, forest_depth=8, train_days=9)
    rows = _raw(spark, "2024-05-08", "2024-05-18")
    assert refresh.refresh(spark, rows, root, as_of=as_of, settings=wide, schedule="s1")
    week = spark.read.parquet(f"{root}/forecast")
    assert week.count() == 168
    assert week.where("dow = 3 AND hour = 3").first().countavailable == 3
    assert week.where("dow = 3 AND hour = 12").first().countavailable == 0
    said = refresh.insights_of_day(spark, root, 3).collect()
    assert [r.msg for r in said] == [
        "On Tuesday, all charge ports are taken up by 07:00AM",
        "On Tuesday, at the end of the day, charge ports start to be available at 06:00PM",
    ]
    assert refresh.schedule_entries(spark, root, "s1").count() == 14
    refresh.add_schedule_entry(spark, root, dow=1, start="7:03", end="7:09", schedule="s2")
    assert refresh.schedule_entries(spark, root, "s1").count() == 14
    assert refresh.schedule_entries(spark, root, "s2").first().name == "available window: 1;7:3-7:9"
    # no new day: nothing is done, unless forced
    assert not refresh.refresh(spark, rows, root, as_of=as_of, settings=wide)
    assert refresh.refresh(spark, rows, root, as_of=as_of, settings=wide, schedule="s1", force=True)


def test_records(spark, tmp_path):
    path = str(tmp_path / "r")
    shape = "site_id int, ts int, v string"
    tables.append_records(spark.createDataFrame([(1, 1, "a"), (2, 1, "x")], shape), path, batch=0)
    tables.append_records(spark.createDataFrame([(1, 2, "b")], shape), path, batch=1)
    tables.append_records(spark.createDataFrame([(1, 2, "c")], shape), path, batch=1)  # again
    got = {r.site_id: r.v for r in
           tables.latest_records(spark, path, keys=["site_id"], order="ts").collect()}
    assert got == {1: "c", 2: "x"}
    assert spark.read.parquet(path).count() == 3
    rows = tables.read_records(
        spark.read.parquet(path), where=F.col("site_id") == 1, order_by=["ts"], limit=1
    )
    assert [r.v for r in rows.collect()] == ["a"]


def test_replace_and_clear(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(3), path)
    tables.replace_table(spark.range(2), path)
    assert spark.read.parquet(path).count() == 2
    tables.clear_table(spark, path)
    assert spark.read.parquet(path).columns == ["id"] and spark.read.parquet(path).count() == 0
    assert tables.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0


def test_interchange_formats(spark, tmp_path):
    vectors = spark.createDataFrame([(2.0, Vectors.dense(2, 17, 1)), (0.0, Vectors.dense(1, 1, 30))],
                                    ["label", "features"])
    tables.write_libsvm(vectors, str(tmp_path / "svm"))
    text = "\n".join(sorted(r.value for r in spark.read.text(str(tmp_path / "svm")).collect()))
    assert text == "0.0 1:1.0 2:1.0 3:30.0\n2.0 1:2.0 2:17.0 3:1.0"
    back = tables.read_libsvm(spark, str(tmp_path / "svm"))
    assert sorted(tuple(r.features.toArray()) for r in back.collect()) == [(1, 1, 30), (2, 17, 1)]
    tables.write_json(spark.range(2), str(tmp_path / "json"))
    assert tables.read_json(spark, str(tmp_path / "json"), "id long").count() == 2


def test_forest_on_a_rule(spark):
    """A forest reproduces a rule of hour and slot; probabilities sum to one."""
    counts = spark.sql("SELECT d dow, h hour, 0 slot, IF(h < 9, 3, 0) avail_count "
                       "FROM (SELECT explode(sequence(1, 7)) d), (SELECT explode(sequence(0, 23)) h)")
    rows = forecast.training_rows(counts)
    model = forecast.train_forest(rows, settings=SETTINGS, classes=33)
    grid = forecast.week_grid(spark.range(1).drop("id"), settings=SETTINGS)
    scored = forecast.predict_week(model, grid)
    assert scored.where("countavailable <> IF(hour < 9, 3, 0)").count() == 0
    again = forecast.predict_week(forecast.train_forest(rows, settings=SETTINGS, classes=33), grid)
    assert sorted(r.countavailable for r in again.collect()) == sorted(
        r.countavailable for r in scored.collect()
    )
    bayes = forecast.train_bayes(rows.withColumn("label", (F.col("hour") % 3).cast("double")))
    probs = forecast.class_probabilities(forecast.predict_week(bayes, grid))
    total = F.col("prob_unknown") + F.col("prob_available") + F.col("prob_in_use")
    assert probs.where(F.abs(total - 1) > 1e-9).count() == 0
    scored_rows = bayes.transform(forecast.assemble(rows.withColumn("label", F.lit(1.0))))
    assert 0.0 <= forecast.accuracy(scored_rows) <= 1.0


def test_two_minute_grid(spark):
    assert forecast.week_grid(spark.range(1)).count() == 5040


def test_readings_of_days_prune_by_literal_ranges(spark, tmp_path):
    """Local days around the start of daylight saving, with a gap between them."""
    path = str(tmp_path / "raw")
    _raw(spark, "2024-03-08", "2024-03-14").write.parquet(path)
    raw = spark.read.parquet(path)
    days = [date(2024, 3, 12), date(2024, 3, 9), date(2024, 3, 10)]
    kept = history.readings_of_days(raw, days)
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/Los_Angeles"), F.col("ts"))
    got = {r[0] for r in kept.select(F.to_date(local)).distinct().collect()}
    assert got == set(days)
    expected = raw.where(F.to_date(local).isin(days))
    assert kept.count() == expected.count()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(And(GreaterThanOrEqual(ts," in plan


def test_schedule_replaced_by_nothing(spark, tmp_path):
    path = str(tmp_path / "schedule")
    rows = spark.createDataFrame([("w",)], "name string")
    tables.replace_schedule(rows, path, schedule="0e5")
    tables.replace_schedule(rows, path, schedule="other")
    tables.replace_schedule(rows.where("false"), path, schedule="other")
    assert [tuple(r) for r in tables.read_schedules(spark, path).collect()] == [("w", "0e5")]


def test_compact_archives(spark, archive_root, tmp_path):
    root, day = str(tmp_path / "tables"), date(2017, 10, 6)
    for _ in range(2):  # twice is as good as once
        refresh.compact_archives(spark, archive_root, root, days=[day], as_of=datetime(2017, 10, 8), site=F.lit(7))
    raw = spark.read.parquet(f"{root}/raw")
    assert raw.count() == 6
    assert {(r.site_id, r.dir_date) for r in raw.collect()} == {(7, day)}
    log = spark.read.parquet(f"{root}/archive_log").where(F.col("dir_date") == F.lit(day))
    assert (log.count(), log.where("error IS NOT NULL").count()) == (9, 7)
