"""Registered queries.  Each takes (spark, sf_dir), reads whole tables and returns a DataFrame."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuspulse.functions import codes, text, time
from statuspulse.operators import alerts, forecast, lookahead, registry, slots, status, transitions, trees, windows
from statuspulse import schemas
from statuspulse.params import STATUSES
from statuspulse.plans import live, refresh
from statuspulse.session import materialise, shared_path
from statuspulse.sources import archives, history, latest, tables, zones
from statuspulse.sources.runs import RunTable
from statuspulse.streaming import backlog, monitor, reorder, slot_stream
from statuspulse.streaming.run import newest_version, run_available, stream_files
from workload.adapter import SETTINGS, as_readings, events, readings

AS_OF = datetime(2024, 1, 31)
HISTORY = replace(SETTINGS, train_days=20)
HYSTERESIS = replace(SETTINGS, open_at=3, close_at=1, min_slots=1)
IGNORED = (3, 7)


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so that any client reads the same value."""
    shapes = {"date": "yyyy-MM-dd", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    return df.select(
        *(
            F.date_format(name, shapes[kind]).alias(name) if kind in shapes else F.col(name)
            for name, kind in df.dtypes
        )
    )


# ---- building blocks -----------------------------------------------------------


def slotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.with_slots(readings(spark, sf_dir), settings=SETTINGS)


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slotted readings of the look-back, the raw table pruned by time."""
    rows = history.readings_within(readings(spark, sf_dir), as_of=AS_OF, settings=HISTORY)
    return slots.with_slots(rows, settings=SETTINGS)


def condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.condense(readings(spark, sf_dir), settings=SETTINGS)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.slot_counts(condensed(spark, sf_dir), settings=SETTINGS)


def fleet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over all sites, as the model is trained on them."""
    return slots.slot_counts(condensed(spark, sf_dir), settings=SETTINGS, keys=())


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.weekly_profile(counts(spark, sf_dir), settings=SETTINGS)


def peak_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.weekly_profile(counts(spark, sf_dir), settings=SETTINGS, how="max")


def found_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.availability_windows(peak_profile(spark, sf_dir), settings=SETTINGS)


def held_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.availability_windows(peak_profile(spark, sf_dir), settings=HYSTERESIS)


def week_insights(table: DataFrame) -> DataFrame:
    """Insights of the peak week of a count table."""
    peak = forecast.weekly_profile(table, settings=SETTINGS, how="max")
    return windows.insights(
        windows.availability_windows(peak, settings=HYSTERESIS), settings=SETTINGS
    )


def found_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return week_insights(counts(spark, sf_dir))


def stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts, written once: the queries below use them for polls and for intervals."""
    return materialise(counts(spark, sf_dir), "counts")


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts, one poll per site and hour."""
    return transitions.polls_from_counts(counts(spark, sf_dir), settings=SETTINGS)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.changes(polls(spark, sf_dir))


def figures(changed: DataFrame) -> DataFrame:
    return transitions.with_change_figures(changed, settings=SETTINGS)


def velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.change_runs(polls(spark, sf_dir), settings=SETTINGS)


def placed(table: DataFrame) -> DataFrame:
    return lookahead.next_interval(
        transitions.polls_from_counts(table, settings=SETTINGS),
        week_insights(table),
        settings=SETTINGS,
    )


def candidates(table: DataFrame) -> DataFrame:
    return lookahead.lookahead_alerts(placed(table), settings=SETTINGS)


def notices(table: DataFrame) -> DataFrame:
    return lookahead.throttle(candidates(table), settings=SETTINGS)


# ---- registered ------------------------------------------------------------------


def outlet_readings(spark, sf_dir):
    return plain(
        slotted(spark, sf_dir).select(
            "event_id", "site_id", "device_id", "outlet_id", "status",
            codes.status_code(F.col("status")).alias("status_code"),
            (F.col("status") == "available").alias("is_available"),
            "ts", "local_ts", "slot_date", "dow", "hour", "slot",
        )
    )


def slot_keys(spark, sf_dir):
    """Grouped on typed columns; the key text is made for the groups."""
    parts = ["slot_date", "dow", "hour", "slot"]
    grouped = slotted(spark, sf_dir).groupBy(*parts).agg(F.count("*").alias("readings"))
    return grouped.select(text.slot_key(*(F.col(c) for c in parts)).alias("slot_key"), "readings")


def json_path_extract(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k")
    )


def condense_first_per_slot(spark, sf_dir):
    return plain(
        condensed(spark, sf_dir).select(
            "site_id", "device_id", "outlet_id", "status", "ts", "slot_date", "dow", "hour", "slot"
        )
    )


def suppress_repeats_by_arrival(spark, sf_dir):
    """Arrival order is the event id; two-minute slots."""
    fine = slots.with_slots(readings(spark, sf_dir), settings=replace(SETTINGS, slot_minutes=2))
    kept = slots.suppress_repeats(fine, order=["event_id"], chunk=F.floor(F.col("event_id") / 1000))
    return plain(kept.select("event_id", "device_id", "outlet_id", "slot_date", "hour", "slot"))


def slot_availability(spark, sf_dir):
    return plain(counts(spark, sf_dir).drop("slot_start"))


def slot_over_capacity(spark, sf_dir):
    tight = replace(SETTINGS, capacity=3)
    over = slots.over_capacity(counts(spark, sf_dir), settings=tight)
    return plain(over.select("site_id", "slot_start", "avail_count"))


def latest_status_counts(spark, sf_dir):
    return plain(status.status_counts(status.latest_readings(readings(spark, sf_dir))))


def unknown_status_audit(spark, sf_dir):
    """Event types taken as status text: only those that are no status are reported."""
    typed = events(spark, sf_dir).select(
        "event_id",
        F.when(F.col("event_type") == "view", "available")
        .when(F.col("event_type") != "signup", F.col("event_type"))
        .alias("status"),
        (F.col("user_id") % 16).alias("device_id"),
        "ts",
    )
    return plain(status.invalid_status_counts(typed))


def lookback_complete_days(spark, sf_dir):
    table = recent(spark, sf_dir)
    kept = history.complete_days(table, as_of=AS_OF, settings=HISTORY)
    return plain(kept.groupBy("slot_date").agg(F.count("*").alias("readings")))


def incremental_new_dates(spark, sf_dir):
    """The ledger holds the days up to the 18th; it is derived from the same table."""
    done = slotted(spark, sf_dir).where(F.col("slot_date") <= datetime(2024, 1, 18).date())
    ledger = done.select("slot_date").distinct()
    table = recent(spark, sf_dir)
    return plain(history.new_days(table, ledger, as_of=AS_OF, settings=HISTORY))


def device_ignore(spark, sf_dir):
    kept = slots.exclude_devices(readings(spark, sf_dir), IGNORED)
    return kept.groupBy("device_id").agg(F.count("*").alias("readings"))


def managed_device_readings(spark, sf_dir):
    """Devices that have ever reported an error are the managed ones, as a table."""
    rows = readings(spark, sf_dir)
    managed = rows.where(F.col("status") == "unknown").select("device_id").distinct()
    kept = slots.managed_devices(rows, managed)
    return kept.groupBy("device_id").agg(F.count("*").alias("readings"))


def week_grid(spark, sf_dir):
    sites = readings(spark, sf_dir).select("site_id").distinct()
    return forecast.week_grid(sites, settings=replace(SETTINGS, slot_minutes=2))


def weekly_profile_forecast(spark, sf_dir):
    return profile(spark, sf_dir)


def weekly_peak_forecast(spark, sf_dir):
    return peak_profile(spark, sf_dir)


def slot_forecast_ordinals(spark, sf_dir):
    return forecast.with_ordinals(profile(spark, sf_dir), settings=SETTINGS)


def history_row_ordinals(spark, sf_dir):
    """Ordinals over the slots that history holds, with no grid behind them."""
    seen = (
        slotted(spark, sf_dir)
        .groupBy("device_id", "dow", "hour", "slot")
        .agg(F.count("*").alias("readings"))
    )
    return forecast.with_row_ordinals(seen, keys=["device_id"])


def availability_windows(spark, sf_dir):
    return found_windows(spark, sf_dir)


def availability_windows_low(spark, sf_dir):
    low = replace(SETTINGS, open_at=1, close_at=1)
    return windows.availability_windows(profile(spark, sf_dir), settings=low)


def availability_windows_toggle(spark, sf_dir):
    """Counts of 2 and 3 both open and close."""
    toggling = replace(SETTINGS, open_at=2, close_at=3, min_slots=0)
    return windows.availability_windows(peak_profile(spark, sf_dir), settings=toggling)


def availability_windows_hysteresis(spark, sf_dir):
    return held_windows(spark, sf_dir)


def fleet_availability_windows(spark, sf_dir):
    """When in the week are outlets available anywhere?  Raw readings to windows."""
    peak = forecast.weekly_profile(
        fleet_counts(spark, sf_dir), settings=SETTINGS, how="max", keys=()
    )
    eager = replace(SETTINGS, open_at=2, close_at=1, min_slots=1)
    found = windows.availability_windows(peak, settings=eager, keys=())
    return windows.with_clock_parts(found)


def window_schedule_utc(spark, sf_dir):
    found = windows.with_clock_parts(held_windows(spark, sf_dir))
    return windows.window_schedule(found, settings=SETTINGS).drop("n_cont", "start_min", "end_min")


def insights(spark, sf_dir):
    return windows.with_clock_parts(found_insights(spark, sf_dir)).select(
        "site_id", "dow", "type", "order", "msg",
        "start_hour", "start_minute", "end_hour", "end_minute",
    )


def insights_for_day(spark, sf_dir):
    return tables.read_records(
        found_insights(spark, sf_dir).select("site_id", "dow", "type", "order", "msg"),
        where=F.col("dow") == 2,
        order_by=["site_id", "order", "type"],
    )


def transition_list(spark, sf_dir):
    return plain(
        figures(changes(spark, sf_dir)).select(
            "site_id", "ts", "kind", "avail", "avail_old", "in_use", "unknown", "total",
            "pct_avail", "pct_change", "pct_change_total",
            "pct_avail_text", "pct_change_text", "pct_change_total_text", "text",
        )
    )


def depletion_velocity(spark, sf_dir):
    lost = transitions.depletion_velocity(velocities(spark, sf_dir))
    return plain(lost.select("site_id", "ts", "avail_old", "avail", "velocity"))


def time_to_empty(spark, sf_dir):
    estimates = transitions.time_to_empty(velocities(spark, sf_dir), settings=SETTINGS)
    return plain(
        estimates.select(
            "site_id", "ts", "avail", "n", "mean_velocity", "seconds_to_empty", "empty_ts",
            "predict_text",
        )
    )


def next_interval(spark, sf_dir):
    return plain(
        placed(stored_counts(spark, sf_dir)).select(
            "site_id", "ts", "avail", "dow", "now_min", "start_min", "end_min", "in_interval"
        )
    )


def lookahead_alerts(spark, sf_dir):
    return plain(
        candidates(stored_counts(spark, sf_dir)).select(
            "site_id", "ts", "kind", "avail", "minutes_ahead", "duration_text", "edge_text", "text"
        )
    )


def throttled_alerts(spark, sf_dir):
    told = notices(stored_counts(spark, sf_dir))
    return plain(told.select("site_id", "ts", "kind", "start_min", "end_min"))


def current_prediction(spark, sf_dir):
    table = stored_counts(spark, sf_dir)
    return lookahead.current_prediction(notices(table), table.select("site_id").distinct())


def routed_alerts(spark, sf_dir):
    table = stored_counts(spark, sf_dir)
    changed = transitions.changes(transitions.polls_from_counts(table, settings=SETTINGS))
    both = alerts.transition_alerts(figures(changed)).unionByName(
        alerts.forecast_alerts(candidates(table))
    )
    return plain(
        alerts.route(both, settings=SETTINGS).select(
            "site_id", "ts", "kind", "channel", "colour",
            F.col("fields")["Available Count"].alias("available_field"),
            F.col("fields")["In Use Count"].alias("in_use_field"),
        )
    )


def current_stats(spark, sf_dir):
    latest = transitions.current_stats(changes(spark, sf_dir), settings=SETTINGS)
    return plain(
        latest.select(
            "site_id", "ts", "init", "avail", "avail_old", "in_use", "in_use_old",
            "unknown", "unknown_old", "total",
            "pct_avail_text", "pct_change_text", "pct_change_total_text",
        )
    )


def training_vectors(spark, sf_dir):
    rows = forecast.training_rows(fleet_counts(spark, sf_dir))
    return plain(
        rows.select("slot_date", "label", "feature_dow", "feature_hour", "feature_slot")
    )


def rf_week_forecast(spark, sf_dir):
    """A forest over the fleet's hourly counts; the full grid, predicted."""
    table = materialise(fleet_counts(spark, sf_dir), "fleet_counts")  # fitting takes many passes
    small = replace(SETTINGS, forest_trees=20, forest_depth=12)
    model = forecast.train_forest(forecast.training_rows(table), settings=small)
    fleet = table.agg(F.count("*").alias("slots"))
    grid = forecast.week_grid(fleet, settings=SETTINGS)
    return forecast.predict_week(model, grid).select("dow", "hour", "slot", "countavailable")


def count_forest_holdout(spark, sf_dir):
    """One count forest for all sites against the baseline, by site, on the ten newest days.

    The mean squared errors on days neither has seen; of the forest's, whether it is no greater.
    """
    table = materialise(counts(spark, sf_dir), "counts")
    bound = table.agg(F.date_sub(F.max("slot_date"), 10)).first()[0]
    early, late = table.where(F.col("slot_date") <= bound), table.where(F.col("slot_date") > bound)
    small = replace(SETTINGS, forest_trees=20, forest_depth=8)
    model, levels = forecast.train_sites(early, settings=small)
    scored = forecast.predict_sites(model, levels, late)
    key = ["site_id", "dow", "hour", "slot"]
    usual = forecast.weekly_profile(early, settings=SETTINGS).select(*key, F.col("countavailable").alias("usual"))
    both = scored.join(usual, key, "left")

    def error(guess):
        return F.avg(F.pow(F.col("avail_count") - F.coalesce(guess, F.lit(0)), F.lit(2.0)))

    errors = both.groupBy("site_id").agg(
        F.count("*").alias("test_slots"),
        F.round(error(F.col("usual")), 6).alias("baseline_error"),
        error(F.col("countavailable")).alias("_own"),
    )
    no_worse = F.round("_own", 6) <= F.col("baseline_error")
    return errors.withColumn("forest_no_worse", no_worse).drop("_own")


def site_weeks(spark, sf_dir):
    """The refresh by site: slots and sums of every site's stored week, and the days it has insights for."""
    root = shared_path(spark, "refresh")
    small = replace(HISTORY, forest_trees=10, forest_depth=8, open_at=3, close_at=2)
    refresh.refresh(spark, readings(spark, sf_dir), root, as_of=AS_OF, settings=small, keys=("site_id",))
    week = spark.read.parquet(f"{root}/forecast").groupBy("site_id").agg(
        F.count("*").alias("slots"), F.sum("countavailable").alias("outlets_available")
    )
    said = spark.read.parquet(f"{root}/insights").groupBy("site_id").agg(F.countDistinct("dow").alias("days"))
    planned = tables.read_schedules(spark, f"{root}/schedule").groupBy("site_id").agg(F.count("*").alias("windows"))
    return week.join(planned, "site_id", "left").join(said, "site_id", "left")


def _status_rows(spark, sf_dir):
    table = materialise(condensed(spark, sf_dir), "condensed")
    return forecast.training_rows(alerts.with_status_codes(table), label="status_code")


def nb_status_classifier(spark, sf_dir):
    """Naive Bayes status of a slot of the week, with unpacked class probabilities."""
    rows = _status_rows(spark, sf_dir)
    model = forecast.train_bayes(rows, classes=3)
    fleet = rows.agg(F.count("*").alias("readings"))
    scored = forecast.predict_week(model, forecast.week_grid(fleet, settings=SETTINGS))
    columns = [f"prob_{s}" for s in codes.params.STATUS_CODES]
    return forecast.class_probabilities(scored).select(
        "dow", "hour", "slot", "predicted_status",
        *(F.round(c, 6).alias(c) for c in columns),
    )


def outlet_status_forest(spark, sf_dir):
    """One model for all outlets, device and outlet as features."""
    names = [*forecast.FEATURES, "device_id", "outlet_id"]
    small = replace(SETTINGS, forest_trees=10, forest_depth=8)
    rows = _status_rows(spark, sf_dir)
    model = forecast.train_forest(rows, settings=small, classes=3, features=names)
    outlets = rows.select("device_id", "outlet_id").distinct()
    grid = forecast.week_grid(outlets, settings=SETTINGS)
    scored = forecast.class_probabilities(forecast.predict_week(model, grid, features=names))
    return scored.select(
        "device_id", "outlet_id", "dow", "hour", "slot", "predicted_status",
        "prob_unknown", "prob_available", "prob_in_use",
    )


def forest_by_joins(spark, sf_dir):
    """The fleet's forest as a table of nodes; the walk through it against the model itself."""
    table = materialise(fleet_counts(spark, sf_dir), "fleet_counts")
    small = replace(SETTINGS, forest_trees=8, forest_depth=6)
    model = forecast.train_forest(forecast.training_rows(table), settings=small)
    nodes = trees.save_nodes(model, shared_path(spark, "forest"))
    fleet = table.agg(F.count("*").alias("slots"))
    grid = forecast.training_rows(forecast.week_grid(fleet, settings=SETTINGS).withColumn("avail_count", F.lit(0)))
    rows = materialise(forecast.assemble(grid).select("dow", "hour", "slot", "features"), "grid")
    key = ["dow", "hour", "slot"]
    own = model.transform(rows).select(*key, F.col("prediction").alias("p"), vector_to_array("probability").alias("q"))
    found = trees.walk(rows, nodes, key=key).join(own, key)
    return found.select(
        *key,
        (F.col("prediction") == F.col("p")).alias("same_prediction"),
        (F.col("probability") == F.col("q")).alias("same_probability"),
    )


def outlet_registry(spark, sf_dir):
    """Models of text ids, saved in two versions; the newest is loaded and scores every outlet's week."""
    root = shared_path(spark, "models")
    small = replace(SETTINGS, forest_trees=5, forest_depth=6)
    rows = alerts.with_status_codes(condensed(spark, sf_dir)).withColumns(
        {
            "device_id": F.format_string("station-%d", "device_id"),
            "outlet_id": F.format_string("outlet_%d", "outlet_id"),
        }
    )
    rows = materialise(rows, "outlet_rows")
    seen = rows.count()
    for trained_at, some in ((datetime(2024, 1, 30), rows.where("hour < 12")), (AS_OF, rows)):
        model = registry.train(some, settings=small)
        registry.save(model, spark, root, trained_at=trained_at, readings=seen)
    newest = registry.load(spark, root)
    outlets = rows.select("device_id", "outlet_id").distinct()
    grid = forecast.week_grid(outlets, settings=SETTINGS)
    key = ["device_id", "outlet_id", "dow", "hour", "slot"]
    shares = ["prob_unknown", "prob_available", "prob_in_use"]
    before = registry.score(model, grid).select(*key, *(F.col(c).alias(f"own_{c}") for c in shares))
    scored = registry.score(newest, grid).join(before, key)
    total = F.col("prob_unknown") + F.col("prob_available") + F.col("prob_in_use")
    same = F.array(*shares) == F.array(*(f"own_{c}" for c in shares))
    return scored.select(*key, (F.abs(total - 1) < 1e-9).alias("shares_of_one"), same.alias("as_saved"))


def bayes_holdout_accuracy(spark, sf_dir):
    """Trained on 60 % of the outlets' hours, by a remainder, tested on the rest."""
    key = F.col("device_id") * 7 + F.col("outlet_id") * 3 + F.col("hour") * 11 + F.dayofmonth("slot_date") * 13
    return forecast.holdout_accuracy(
        _status_rows(spark, sf_dir), lambda rows: forecast.train_bayes(rows, classes=3), key=key
    )


def bayes_date_holdout(spark, sf_dir):
    """Trained on the days up to the 20th, tested on those after."""
    rows = _status_rows(spark, sf_dir)
    early = F.col("slot_date") <= datetime(2024, 1, 20).date()
    return forecast.tested(forecast.train_bayes(rows.where(early), classes=3), rows.where(~early))


def _documents(spark, sf_dir):
    """Every event as the snapshot document its station would have sent.

    Zipping is the costly part, so rows are spread over the cores first.
    """
    rows = readings(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "event_id")
    day = F.date_format("ts", "yyyy-MM-dd")
    clock = F.date_format("ts", "HH:mm:ss")
    node = F.create_map(
        F.concat(F.lit("outlet_"), F.col("outlet_id")), F.struct(F.col("status").alias("status"))
    )
    summary = F.struct(
        F.col("device_id").cast("string").alias("device_id"), node.alias("port_status")
    )
    snapshot = F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("time"),
        F.array(summary).alias("summaries"),
    )
    return rows.select(
        "event_id",
        "status",
        F.concat(day, F.lit("/"), F.col("device_id"), F.lit("/"), clock, F.lit("_"),
                 F.col("event_id"), F.lit(".zip")).alias("path"),
        F.concat(clock, F.lit(".json")).alias("entry"),
        F.to_json(F.array(snapshot)).alias("payload"),
    )


def archive_ingest(spark, sf_dir):
    """Zip archives made from the events, read back into outlet readings."""
    packed = archives.pack_archives(_documents(spark, sf_dir))
    parsed = archives.parse_archives(packed, outlets=None)
    return plain(
        archives.archive_readings(parsed).select("path", "device_id", "outlet_id", "status", "ts")
    )


def archive_quarantine(spark, sf_dir):
    """The same archives, those of the unknown status damaged in four ways."""
    docs = _documents(spark, sf_dir)
    way = F.when(F.col("status") == "unknown", F.col("event_id") % 4)
    damaged = docs.withColumn(
        "payload",
        F.when(way == 1, F.concat(F.lit("{"), F.col("payload")))
        .when(way == 2, F.regexp_replace("payload", r'\{"status":"unknown"\}', "null"))
        .when(way == 3, F.regexp_replace("payload", r'"time":"\d', '"time":"x'))
        .otherwise(F.col("payload")),
    ).withColumn("path", F.concat(F.coalesce(way.cast("string"), F.lit("-")), F.lit("/"), F.col("path")))
    packed = archives.pack_archives(damaged)
    # way 0: the archive lost its end in transit
    cut = packed.withColumn(
        "content",
        F.when(
            F.col("path").startswith("0/"), F.expr("substring(content, 1, length(content) - 30)")
        ).otherwise(F.col("content")),
    )
    return archives.quarantine(archives.parse_archives(cut, outlets=None))


def latest_archive_counts(spark, sf_dir):
    """Newest archive of every station, by path, read and counted over the fleet."""
    packed = archives.pack_archives(_documents(spark, sf_dir))
    parsed = archives.parse_archives(archives.latest_archives(packed), outlets=None)
    latest = status.latest_readings(
        archives.archive_readings(parsed), keys=["device_id", "outlet_id"]
    )
    return plain(status.status_counts(latest, by=["device_id"]))


def latest_status_pivot(spark, sf_dir):
    """The same counts as a pivot over the status vocabulary."""
    latest = status.latest_readings(readings(spark, sf_dir))
    return (
        latest.groupBy("device_id")
        .pivot("status", list(STATUSES))
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def outlet_key_split(spark, sf_dir):
    """Composite outlet names, split once at the first separator."""
    named = readings(spark, sf_dir).select(
        F.concat_ws("_", F.col("device_id"), F.concat(F.lit("outlet_"), F.col("outlet_id"))).alias("key")
    )
    device, outlet = text.split_outlet_key(F.col("key"))
    split = named.select(device.alias("device"), outlet.alias("outlet"))
    return (
        split.withColumn("outlet_code", codes.outlet_code(F.col("outlet")))
        .groupBy("device", "outlet", "outlet_code")
        .agg(F.count("*").alias("readings"))
    )


def holiday_flags(spark, sf_dir):
    """Days without any morning purchase stand for holidays; derived, then joined back."""
    rows = slotted(spark, sf_dir)
    busy = F.count_if((F.col("status") == "in_use") & (F.col("hour") < 9))
    quiet = rows.groupBy("slot_date").agg(busy.alias("n"), F.count("*").alias("all"))
    holidays = quiet.where(F.col("n") * 6 < F.col("all")).select("slot_date")
    flagged = slots.with_holiday(counts(spark, sf_dir), holidays)
    return plain(
        flagged.groupBy("slot_date", "holiday").agg(F.sum("reading_count").alias("readings"))
    )


def times_on_reference_day(spark, sf_dir):
    moved = time.replace_date(F.col("ts"), 2017, 11, 12)
    return plain(readings(spark, sf_dir).select("event_id", moved.alias("moved_ts")))


# ---- sinks: written below the shared folder and read back ------------------------------


def libsvm_round_trip(spark, sf_dir):
    rows = forecast.training_rows(fleet_counts(spark, sf_dir))
    path = shared_path(spark, "training")
    tables.write_libsvm(forecast.assemble(rows), path)
    values = vector_to_array("features")
    return tables.read_libsvm(spark, path).select(
        "label", *(values[i].alias(name) for i, name in enumerate(forecast.FEATURES))
    )


def json_forecast_round_trip(spark, sf_dir):
    path = shared_path(spark, "forecast")
    tables.write_json(profile(spark, sf_dir), path)
    return tables.read_json(
        spark, path,
        "site_id long, dow int, hour int, slot int, week_ordinal int, countavailable int",
    )


def replaced_schedule(spark, sf_dir):
    """Two schedules are stored, then one is replaced: the other keeps its rows."""
    path = shared_path(spark, "schedule")
    table = stored_counts(spark, sf_dir)
    peak = forecast.weekly_profile(table, settings=SETTINGS, how="max")
    held = windows.availability_windows(peak, settings=HYSTERESIS)
    first = windows.window_schedule(held, settings=SETTINGS)
    for name in ("kept", "replaced"):
        tables.replace_schedule(first, path, schedule=name)
    second = windows.window_schedule(
        windows.availability_windows(peak, settings=SETTINGS), settings=SETTINGS
    )
    tables.replace_schedule(second, path, schedule="replaced")
    return tables.read_schedules(spark, path).select(
        "schedule", "site_id", "dow", "name", "start_utc", "end_utc"
    )


def stats_upsert(spark, sf_dir):
    """Changes written in three batches; the last record of every site remains."""
    path = shared_path(spark, "stats")
    changed = materialise(changes(spark, sf_dir), "changes")
    day = F.dayofmonth("ts")
    for batch, part in enumerate((day < 10, (day >= 10) & (day < 20), day >= 20)):
        stats = transitions.current_stats(changed.where(part), settings=SETTINGS)
        tables.append_records(stats, path, batch=batch)
    latest = tables.latest_records(spark, path, keys=["site_id"], order="ts")
    return plain(latest.select("site_id", "ts", "kind", "avail", "avail_old", "total"))


def compacted_records(spark, sf_dir):
    """As stats_upsert, in eleven batches that are merged by threes into sorted runs."""
    table = RunTable(spark, shared_path(spark, "runs"), keys=("site_id",), order="ts", fanout=3)
    changed = materialise(changes(spark, sf_dir), "changes")
    for batch in range(11):  # days 0 to 2, 3 to 5, ... of the month
        part = changed.where(F.floor(F.dayofmonth("ts") / 3) == batch)
        table.append(transitions.current_stats(part, settings=SETTINGS), batch)
    return plain(table.latest().select("site_id", "ts", "kind", "avail", "avail_old", "total"))


def compacted_changes(spark, sf_dir):
    """All changes of a log without keys, after merges and one batch that came again."""
    table = RunTable(spark, shared_path(spark, "log"), fanout=2)
    changed = materialise(changes(spark, sf_dir).select("site_id", "ts", "kind", "avail", "total"), "changes")
    for batch in (0, 1, 2, 3, 4, 4):
        table.append(changed.where(F.dayofmonth("ts") % 5 == batch), batch)
    return plain(table.read().drop("batch"))


def newest_decreases(spark, sf_dir):
    """A report of the fifty newest decreases."""
    rows = changes(spark, sf_dir).select("site_id", "ts", "kind", "avail", "total")
    return plain(
        tables.read_records(rows, where=F.col("kind") == "decreased", order_by=[F.desc("ts"), "site_id"], limit=50)
    )


def ingested_days(spark, sf_dir):
    """Two ingest runs, the second incremental; readings per stored day and status."""
    root = shared_path(spark, "history")
    rows = readings(spark, sf_dir)
    early = rows.where(F.col("ts") < F.lit("2024-01-26 12:00:00").cast("timestamp_ntz"))
    refresh.ingest_days(spark, early, root, as_of=datetime(2024, 1, 26, 6), settings=SETTINGS)
    refresh.ingest_days(spark, rows, root, as_of=datetime(2024, 1, 31), settings=SETTINGS)
    stored = spark.read.parquet(f"{root}/readings")
    return plain(stored.groupBy("slot_date", "status").agg(F.count("*").alias("readings")))


def late_readings_ingested(spark, sf_dir):
    """As ingested_days, but every 25th reading is in the folder of three days later: the zone map
    finds it, and opens the days again that were done without it."""
    root = shared_path(spark, "late_history")
    late = F.when(F.col("event_id") % 25 == 0, 3).otherwise(0)
    rows = readings(spark, sf_dir).withColumn("dir_date", F.date_add(F.to_date("ts"), late))
    first = F.col("dir_date") <= F.lit("2024-01-25").cast("date")
    for as_of, part in ((datetime(2024, 1, 26, 6), rows.where(first)), (AS_OF, rows.where(~first))):
        tables.write_days(part, f"{root}/raw", date="dir_date")
        folders = [row[0] for row in part.select("dir_date").distinct().collect()]
        zones.write_zones(spark, root, days=folders, written_at=as_of)
        raw, mapped = spark.read.parquet(f"{root}/raw"), zones.read_zones(spark, root)
        refresh.ingest_days(spark, raw, root, as_of=as_of, settings=SETTINGS, mapped=mapped)
    stored = spark.read.parquet(f"{root}/readings")
    return plain(stored.groupBy("slot_date", "status").agg(F.count("*").alias("readings")))


def model_refresh(spark, sf_dir):
    """Ingest, train, predict, find windows, write insights: what was stored, by day of week."""
    root = shared_path(spark, "refresh")
    small = replace(HISTORY, forest_trees=10, forest_depth=8, open_at=6, close_at=5)
    rows = readings(spark, sf_dir)
    refresh.refresh(spark, rows, root, as_of=AS_OF, settings=small)
    week = spark.read.parquet(f"{root}/forecast").groupBy("dow").agg(
        F.count("*").alias("slots"), F.sum("countavailable").alias("outlets_available")
    )
    planned = tables.read_schedules(spark, f"{root}/schedule").groupBy("dow").agg(F.count("*").alias("windows"))
    said = spark.read.parquet(f"{root}/insights").groupBy("dow").agg(
        F.sort_array(F.collect_list("msg")).alias("messages")  # at most one day's windows
    )
    return week.join(planned, "dow", "left").join(said, "dow", "left")


# ---- streams: each runs over everything available, then its table is read ------------

DELAY = "2 hours"


def _reading_stream(spark, sf_dir):
    return as_readings(stream_files(spark, f"{sf_dir}/events.parquet*", schemas.EVENTS))


def _poll_stream(spark, table):
    """The hourly polls, written and read back as a stream of files."""
    path = shared_path(spark, "polls")
    rows = transitions.polls_from_counts(table, settings=SETTINGS)
    tables.replace_table(rows.withColumn("ts", F.col("ts").cast("timestamp")), path)
    return stream_files(spark, path, schemas.POLLS)


def stream_window_counts(spark, sf_dir):
    stream = slot_stream.window_counts(_reading_stream(spark, sf_dir), settings=SETTINGS, delay=DELAY)
    rows = run_available(stream, shared_path(spark, "window_counts"), mode="update")
    latest = newest_version(rows, ["site_id", "slot_start"])
    return plain(latest.withColumn("slot_start", F.col("slot_start").cast("timestamp_ntz")))


def stream_slot_dedupe(spark, sf_dir):
    """Every outlet passes once per slot."""
    stream = slot_stream.first_in_slot(_reading_stream(spark, sf_dir), settings=SETTINGS, delay=DELAY)
    rows = run_available(stream, shared_path(spark, "slot_dedupe"), mode="append")
    return plain(
        rows.select(
            "device_id", "outlet_id", F.col("slot_start").cast("timestamp_ntz").alias("slot_start")
        )
    )


def stream_slot_counts(spark, sf_dir):
    """Condensed by the stream, revised in update mode; its counts equal the batch ones."""
    stream = slot_stream.condense(_reading_stream(spark, sf_dir), settings=SETTINGS, delay=DELAY)
    rows = run_available(stream, shared_path(spark, "slot_counts"), mode="update")
    latest = newest_version(rows, [*slots.OUTLET_KEY, "slot_gmt"])
    localised = slot_stream.localised(latest, settings=SETTINGS)
    counted = slots.slot_counts(localised, settings=SETTINGS)
    return plain(counted.drop("slot_start"))


#: A zone whose clock is moved by half an hour, and how many days later it is, to meet that change.
HALF_HOUR, LATER = replace(SETTINGS, zone="Australia/Lord_Howe"), 91


def stream_irregular_slots(spark, sf_dir):
    """Status counts of local slots that no fixed windows fit, from a stream over a change of the clock."""
    moved = F.col("ts") + F.make_dt_interval(F.lit(LATER))
    stream = _reading_stream(spark, sf_dir).withColumn("ts", moved)
    rows = run_available(
        slot_stream.condense(stream, settings=HALF_HOUR, delay=DELAY), shared_path(spark, "slots"), mode="update"
    )
    latest = newest_version(rows, [*slots.OUTLET_KEY, *slot_stream.slot_key(HALF_HOUR)])
    counted = slots.slot_counts(slot_stream.localised(latest, settings=HALF_HOUR), settings=HALF_HOUR, keys=("site_id", "second_pass"))
    return plain(counted)


def _told(rows):
    rows = monitor.on_time(rows) if "late" in rows.columns else rows
    return plain(
        rows.select(
            "site_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "kind", "avail", "avail_old",
            "in_use", "unknown", "total", "velocity", F.size("means").alias("estimates"),
        )
    )


def stream_transitions(spark, sf_dir):
    stream = monitor.with_means(
        monitor.live_changes(_poll_stream(spark, counts(spark, sf_dir)), settings=SETTINGS),
        settings=SETTINGS,
    )
    return _told(run_available(stream, shared_path(spark, "transitions"), mode="append"))


def stream_notices(spark, sf_dir):
    table = stored_counts(spark, sf_dir)
    stream = monitor.live_notices(
        _poll_stream(spark, table), week_insights(table), settings=SETTINGS
    )
    rows = run_available(stream, shared_path(spark, "notices"), mode="append")
    return plain(
        rows.select(
            "site_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "kind", "start_min", "end_min",
            "text",
        )
    )


def backlog_transitions(spark, sf_dir):
    """The polls as one large micro-batch, by the batch operators."""
    path = shared_path(spark, "backlog_transitions")
    stream = _poll_stream(spark, counts(spark, sf_dir))
    backlog.watch_changes(stream, path, settings=SETTINGS).awaitTermination()
    return _told(spark.read.parquet(f"{path}/rows"))


def backlog_notices(spark, sf_dir):
    path = shared_path(spark, "backlog_notices")
    table = stored_counts(spark, sf_dir)
    intervals = materialise(week_insights(table), "intervals")
    stream = _poll_stream(spark, table)
    backlog.watch_edges(stream, intervals, path, settings=SETTINGS).awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return plain(rows.select("site_id", "ts", "kind", "start_min", "end_min", "text"))


# polls that come in any order are held for longer than the table is long
SHUFFLED = replace(SETTINGS, late_minutes=400 * 24 * 60)


def _arrivals(spark, table, parts, settings=None):
    """The polls in files that arrive one after the other, each with what ``parts`` picks; with
    ``settings``, a last one that closes the stream.  Yields the stream after each arrival."""
    path = shared_path(spark, "arrivals")
    rows = transitions.polls_from_counts(table, settings=SETTINGS)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    for part in [rows.where(part) for part in parts] + ([reorder.closing(rows, settings=settings)] if settings else []):
        part.write.mode("append").parquet(path)
        yield stream_files(spark, path, schemas.POLLS)


def _shuffles(n=3):
    part = F.pmod(F.xxhash64("site_id", "ts"), F.lit(n))
    return [part == k for k in range(n)]


def shuffled_stream_transitions(spark, sf_dir):
    """The polls in random order over several micro-batches: the rows of transitions all the same."""
    path = shared_path(spark, "shuffled_transitions")
    for stream in _arrivals(spark, stored_counts(spark, sf_dir), _shuffles(), SHUFFLED):
        found = monitor.with_means(monitor.live_changes(stream, settings=SHUFFLED), settings=SHUFFLED)
        rows = run_available(found, path, mode="append")
    return _told(rows)


def shuffled_backlog_transitions(spark, sf_dir):
    path = shared_path(spark, "shuffled_backlog")
    for stream in _arrivals(spark, stored_counts(spark, sf_dir), _shuffles(), SHUFFLED):
        backlog.watch_changes(stream, path, settings=SHUFFLED).awaitTermination()
    return _told(spark.read.parquet(f"{path}/rows"))


def shuffled_stream_notices(spark, sf_dir):
    table, path = stored_counts(spark, sf_dir), shared_path(spark, "shuffled_notices")
    intervals = materialise(week_insights(table), "intervals")
    for stream in _arrivals(spark, table, _shuffles(), SHUFFLED):
        rows = run_available(monitor.live_notices(stream, intervals, settings=SHUFFLED), path, mode="append")
    rows = monitor.on_time(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return plain(rows.select("site_id", "ts", "kind", "start_min", "end_min", "text"))


def shuffled_backlog_notices(spark, sf_dir):
    table, path = stored_counts(spark, sf_dir), shared_path(spark, "shuffled_backlog_notices")
    intervals = materialise(week_insights(table), "intervals")
    for stream in _arrivals(spark, table, _shuffles(), SHUFFLED):
        backlog.watch_edges(stream, intervals, path, settings=SHUFFLED).awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    return plain(rows.select("site_id", "ts", "kind", "start_min", "end_min", "text"))


def _late_by_arrival(found):
    return plain(
        found.groupBy("site_id", (F.hour("ts") % 3).alias("arrival")).agg(
            F.count("*").alias("late"), F.max(F.col("ts").cast("timestamp_ntz")).alias("newest")
        )
    )


def late_polls(spark, sf_dir):
    """Three arrivals, each with every third hour, held for no time: what was late, by site and arrival."""
    root = shared_path(spark, "late")
    thirds = [F.hour("ts") % 3 == k for k in range(3)]
    for stream in _arrivals(spark, stored_counts(spark, sf_dir), thirds):
        live.watch_changes(stream, root, settings=SETTINGS).awaitTermination()
    return _late_by_arrival(live.late_polls(spark, root))


def late_polls_by_day(spark, sf_dir):
    root = shared_path(spark, "late_by_day")
    thirds = [F.hour("ts") % 3 == k for k in range(3)]
    for stream in _arrivals(spark, stored_counts(spark, sf_dir), thirds):
        live.watch_changes(stream, root, settings=SETTINGS, by_day=True).awaitTermination()
    return _late_by_arrival(live.late_polls(spark, root))


def live_snapshot_polls(spark, sf_dir):
    """Archives as a stream, to the newest reading of every outlet, to one poll per site."""
    source, root = shared_path(spark, "archives"), shared_path(spark, "snapshots")
    archives.pack_archives(_documents(spark, sf_dir)).write.parquet(source)
    stream = archives.parse_archives(stream_files(spark, source, schemas.ARCHIVE_FILES), outlets=None)
    site = F.col("device_id").cast("long") % 4
    live.watch_snapshots(archives.archive_readings(stream, site=site), root).awaitTermination()
    rows = spark.read.schema(schemas.POLLS).parquet(f"{root}/polls")
    return plain(rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).drop("batch"))


def _station_archives(rows):
    """Every station's newest reading of each outlet as one archive, ``<device_id>.zip``."""
    newest = status.latest_readings(rows, keys=["device_id", "outlet_id"])
    node = F.create_map(
        F.concat(F.lit("outlet_"), F.col("outlet_id")), F.struct(F.col("status").alias("status"))
    )
    summary = F.struct(F.col("device_id").cast("string").alias("device_id"), node.alias("port_status"))
    snapshot = F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("time"), F.array(summary).alias("summaries")
    )
    # one document an outlet: a station has a bounded number of them
    per_station = newest.groupBy("device_id").agg(F.sort_array(F.collect_list(F.to_json(snapshot))).alias("_polls"))
    return archives.pack_archives(
        per_station.select(
            F.concat(F.col("device_id"), F.lit(".zip")).alias("path"),
            F.lit("status.json").alias("entry"),
            F.concat(F.lit("["), F.array_join("_polls", ","), F.lit("]")).alias("payload"),
        )
    )


def replaced_latest_polls(spark, sf_dir):
    """Archives on disk, replaced in place twice: a poll per site after each, none after a restart."""
    files, root = shared_path(spark, "stations"), shared_path(spark, "polled")
    rows = readings(spark, sf_dir)
    first, last = rows.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))),
                           F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    passed = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(first)
    third = F.floor(passed * 3 / F.lit(last - first + 1))
    site = F.col("device_id").cast("long") % 4
    for part in (0, 1, 2, None):
        if part is not None:
            latest.put_files(_station_archives(rows.where(third == part)), f"{files}/latest")
        live.watch_latest(spark, files, root, outlets=None, site=site).awaitTermination()
    polled = spark.read.schema(schemas.POLLS).parquet(f"{root}/polls")
    return plain(polled.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("batch", F.col("batch").cast("int")))


def live_current_stats(spark, sf_dir):
    """The live monitor's statistics records."""
    root = shared_path(spark, "live")
    stream = _poll_stream(spark, counts(spark, sf_dir))
    live.watch_changes(stream, root, settings=SETTINGS).awaitTermination()
    stats = live.current_stats(spark, root)
    return plain(
        stats.select(
            "site_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "init", "avail", "avail_old",
            "in_use", "in_use_old", "unknown", "unknown_old", "total",
            "pct_avail_text", "pct_change_text", "pct_change_total_text",
        )
    )


def live_alerts(spark, sf_dir, by_day=False):
    """The live monitor's routed alerts, with the depletion lines of each decrease."""
    root = shared_path(spark, "live")
    table = stored_counts(spark, sf_dir)
    stream = _poll_stream(spark, table)
    intervals = materialise(week_insights(table), "intervals")
    running = [
        live.watch_changes(stream, root, settings=SETTINGS, by_day=by_day),
        live.watch_edges(stream, intervals, root, settings=SETTINGS, by_day=by_day),
    ]
    for query in running:
        query.awaitTermination()
    alerted = live.routed_alerts(spark, root)
    fields = F.col("fields")
    return plain(
        alerted.select(
            "site_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "kind", "channel", "colour",
            fields["Available Count"].alias("available_field"),
            fields["Predict"].alias("predict_field"),
        )
    )


def live_alerts_by_day(spark, sf_dir):
    return live_alerts(spark, sf_dir, by_day=True)


REGISTERED = {
    f.__name__: f
    for f in (
        # readings, slots, status
        outlet_readings, slot_keys, json_path_extract, outlet_key_split, times_on_reference_day,
        condense_first_per_slot, suppress_repeats_by_arrival, slot_availability,
        slot_over_capacity, latest_status_counts, latest_status_pivot, unknown_status_audit,
        device_ignore, managed_device_readings, holiday_flags,
        # history
        lookback_complete_days, incremental_new_dates, ingested_days, late_readings_ingested,
        # forecast and models
        week_grid, weekly_profile_forecast, weekly_peak_forecast, slot_forecast_ordinals,
        history_row_ordinals, training_vectors, rf_week_forecast, count_forest_holdout, site_weeks, nb_status_classifier,
        outlet_status_forest, forest_by_joins, outlet_registry, bayes_holdout_accuracy,
        bayes_date_holdout, model_refresh,
        # windows and insights
        availability_windows, availability_windows_low, availability_windows_toggle,
        availability_windows_hysteresis, fleet_availability_windows, window_schedule_utc,
        insights, insights_for_day,
        # changes, look-ahead, alerts
        depletion_velocity, time_to_empty, next_interval, lookahead_alerts, throttled_alerts,
        current_prediction, routed_alerts, current_stats,
        # archives and sinks
        archive_ingest, archive_quarantine, latest_archive_counts, libsvm_round_trip,
        json_forecast_round_trip, replaced_schedule, stats_upsert, compacted_records,
        compacted_changes, newest_decreases,
        # streams
        stream_window_counts, stream_slot_dedupe, stream_slot_counts, stream_irregular_slots, stream_transitions,
        stream_notices, backlog_transitions, backlog_notices, live_snapshot_polls,
        replaced_latest_polls,
        live_current_stats, live_alerts, live_alerts_by_day,
        shuffled_stream_transitions, shuffled_backlog_transitions, shuffled_stream_notices,
        shuffled_backlog_notices, late_polls, late_polls_by_day,
    )
} | {"transitions": transition_list}
