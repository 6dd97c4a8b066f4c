"""The registered queries in DuckDB SQL, written over whole histories without chunks or halos."""

from __future__ import annotations

ZONE = "America/Los_Angeles"
TS = "%Y-%m-%d %H:%M:%S.%f"


def ts_text(column: str) -> str:
    return f"strftime({column}, '{TS}')"


READINGS = """
readings AS (
  SELECT event_id, user_id % 4 AS site_id, user_id % 16 AS device_id,
         CAST(event_id % 2 + 1 AS INTEGER) AS outlet_id,
         CASE WHEN event_type IN ('click', 'view') THEN 'available'
              WHEN event_type = 'error' THEN 'unknown' ELSE 'in_use' END AS status, ts
  FROM events)"""


def slotted(zone: str = ZONE, minutes: int = 60) -> str:
    local = "ts" if zone == "UTC" else f"ts AT TIME ZONE 'UTC' AT TIME ZONE '{zone}'"
    return f"""{READINGS},
localised AS (SELECT *, {local} AS local_ts FROM readings),
slotted AS (
  SELECT *, CAST(local_ts AS DATE) AS slot_date, CAST(dayofweek(local_ts) + 1 AS INTEGER) AS dow,
         CAST(hour(local_ts) AS INTEGER) AS hour,
         CAST(minute(local_ts) // {minutes} AS INTEGER) AS slot
  FROM localised)"""


def condensed(zone: str = ZONE) -> str:
    return slotted(zone) + """,
condensed AS (
  SELECT * FROM slotted
  QUALIFY row_number() OVER (
    PARTITION BY device_id, outlet_id, slot_date, hour, slot ORDER BY ts, event_id) = 1)"""


def counts(zone: str = ZONE) -> str:
    return condensed(zone) + """,
counts AS (
  SELECT site_id, slot_date, dow, hour, slot,
         count(*) FILTER (WHERE status = 'available') AS avail_count,
         count(*) FILTER (WHERE status = 'in_use') AS in_use_count,
         count(*) FILTER (WHERE status = 'unknown') AS unknown_count,
         count(*) AS reading_count
  FROM condensed GROUP BY ALL)"""


def profile(stat: str = "avg") -> str:
    return counts() + f""",
grid AS (
  SELECT site_id, CAST(d AS INTEGER) AS dow, CAST(h AS INTEGER) AS hour, 0 AS slot
  FROM (SELECT DISTINCT site_id FROM readings), range(1, 8) t(d), range(24) u(h)),
profile AS (
  SELECT g.site_id, g.dow, g.hour, g.slot, CAST((g.dow - 1) * 24 + g.hour AS INTEGER) AS week_ordinal,
         CAST(coalesce(c.n, 0) AS INTEGER) AS countavailable
  FROM grid g LEFT JOIN (
    SELECT site_id, dow, hour, round({stat}(avail_count)) AS n FROM counts GROUP BY ALL) c
  USING (site_id, dow, hour))"""


def windows(opening: int = 2, closing: int = 2, least: int = 2, stat: str = "max") -> str:
    active = "(a0 + rn - arn) % 2" if opening <= closing else "a0"
    return profile(stat) + f""",
anchors AS (
  SELECT *, CASE WHEN countavailable > {closing} AND countavailable >= {opening} THEN 1
                 WHEN countavailable <= {closing} AND countavailable < {opening} THEN 0 END AS anchor,
         row_number() OVER (PARTITION BY site_id, dow ORDER BY hour) AS rn
  FROM profile),
states AS (
  SELECT *, coalesce(last_value(anchor IGNORE NULLS) OVER w, 0) AS a0,
         coalesce(max(CASE WHEN anchor IS NOT NULL THEN rn END) OVER w, 0) AS arn
  FROM anchors
  WINDOW w AS (PARTITION BY site_id, dow ORDER BY hour ROWS UNBOUNDED PRECEDING)),
activity AS (SELECT *, {active} AS act FROM states),
edges AS (
  SELECT *, lag(act, 1, 0) OVER (PARTITION BY site_id, dow ORDER BY hour) AS prv FROM activity),
runs AS (
  SELECT *, sum(CASE WHEN act = 1 AND prv = 0 THEN 1 ELSE 0 END) OVER (
    PARTITION BY site_id, dow ORDER BY hour ROWS UNBOUNDED PRECEDING) AS run FROM edges),
kept AS (
  SELECT site_id, dow, CAST(60 * min(hour) FILTER (WHERE act = 1 AND prv = 0) AS INTEGER) AS start_min,
         CAST(60 * max(hour) AS INTEGER) AS end_min, CAST(sum(act) - 1 AS INTEGER) AS n_cont
  FROM runs WHERE act = 1 OR prv = 1 GROUP BY site_id, dow, run HAVING sum(act) - 1 >= {least}),
windows AS (
  SELECT site_id, dow,
         CAST(row_number() OVER (PARTITION BY site_id, dow ORDER BY start_min) AS INTEGER) AS window_no,
         start_min, end_min, n_cont FROM kept)"""


def clock(minute: str) -> str:
    return f"strftime(TIMESTAMP '2017-11-12' + to_minutes({minute}), '%I:%M%p')"


DAY_NAME = (
    "list_extract(['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday'], dow)"
)


def insights() -> str:
    return windows(3, 1, 1) + f""",
placed AS (
  SELECT *, count(*) OVER (PARTITION BY site_id, dow) AS n FROM windows),
typed AS (
  SELECT *, CASE WHEN n = 1 THEN 3
                 WHEN window_no = 1 THEN CASE WHEN end_min <= 570 THEN 0 END
                 WHEN window_no = n THEN 2
                 WHEN start_min <= 960 AND end_min - start_min >= 4 THEN 1 END AS type
  FROM placed),
insights AS (
  SELECT *, CASE WHEN type = 1 THEN CAST(row_number() OVER (
                   PARTITION BY site_id, dow, type ORDER BY start_min) AS INTEGER) ELSE 0 END AS "order",
         'On ' || {DAY_NAME} || CASE type
           WHEN 3 THEN ', charge ports are available the entire day'
           WHEN 0 THEN ', all charge ports are taken up by ' || {clock('end_min')}
           WHEN 1 THEN ', some charge ports are available between ' || {clock('start_min')}
                       || ' and ' || {clock('end_min')}
           ELSE ', at the end of the day, charge ports start to be available at '
                || {clock('start_min')} END AS msg
  FROM typed WHERE type IS NOT NULL)"""


def changes() -> str:
    return counts("UTC") + """,
polls AS (
  SELECT site_id, slot_date + to_hours(hour) AS ts, avail_count AS avail, in_use_count AS in_use,
         unknown_count AS unknown, avail_count + in_use_count + unknown_count AS total FROM counts),
lagged AS (
  SELECT *, lag(avail) OVER w AS avail_old, lag(in_use) OVER w AS in_use_old,
         lag(unknown) OVER w AS unknown_old
  FROM polls WINDOW w AS (PARTITION BY site_id ORDER BY ts)),
changes AS (
  SELECT *, CASE WHEN avail_old IS NULL THEN 'initial'
                 WHEN avail_old = 0 THEN 'became_nonzero'
                 WHEN avail > avail_old THEN 'increased'
                 WHEN avail > 0 THEN 'decreased' ELSE 'went_to_zero' END AS kind
  FROM lagged WHERE avail_old IS NULL OR avail <> avail_old)"""


def number(value: str) -> str:
    """Two decimals at most, no trailing zeros."""
    return f"rtrim(rtrim(printf('%.2f', {value}), '0'), '.')"


def change_text(value: str, base: str) -> str:
    sign = f"CASE WHEN {value} < 0 THEN '-' ELSE '+' END"
    return f"CASE WHEN {base} = 0 THEN '' ELSE {sign} || {number(f'abs({value})')} || '%' END"


def figures() -> str:
    return changes() + f""",
percents AS (
  SELECT *, CASE WHEN total = 0 THEN NULL ELSE avail::DOUBLE / total::DOUBLE * 100.0 END AS pct_avail,
         CASE WHEN avail_old = 0 THEN NULL
              ELSE (avail - avail_old)::DOUBLE / avail_old::DOUBLE * 100.0 END AS pct_change,
         CASE WHEN total = 0 THEN NULL
              ELSE (avail - avail_old)::DOUBLE / total::DOUBLE * 100.0 END AS pct_change_total
  FROM changes),
texts AS (
  SELECT *, {number('pct_avail')} || '%' AS pct_avail_text,
         {change_text('pct_change', 'avail_old')} AS pct_change_text,
         CASE WHEN avail_old IS NOT NULL THEN {change_text('pct_change_total', 'total')} END
           AS pct_change_total_text,
         strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}', '%I:%M:%S %p') AS at_text
  FROM percents),
figures AS (
  SELECT *, at_text || ': ' || CASE kind WHEN 'initial' THEN 'Initial charge port status counts'
    ELSE 'Available count ' || CASE kind
      WHEN 'became_nonzero' THEN 'became non-zero from ' || avail_old || ' -> ' || avail
           || ', a change of ' || (avail - avail_old)
      WHEN 'increased' THEN 'increased from ' || avail_old || ' -> ' || avail
           || ', a change of +' || (avail - avail_old)
      WHEN 'decreased' THEN 'decreased from ' || avail_old || ' -> ' || avail
           || ', a change of -' || (avail_old - avail)
      ELSE 'went to zero from ' || avail_old || ', a change of -' || (avail_old - avail) END
      || ' (' || pct_change_text || ') (' || pct_change_total_text || ' of ' || total || ')'
    END AS text
  FROM texts)"""


def velocities() -> str:
    return changes() + """,
spans AS (
  SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY site_id ORDER BY ts), ts) AS us,
         sum(CASE WHEN kind <> 'decreased' THEN 1 ELSE 0 END) OVER (
           PARTITION BY site_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run
  FROM changes),
velocities AS (
  SELECT *, CASE WHEN kind = 'decreased'
                 THEN (avail_old - avail)::DOUBLE / (us::DOUBLE / 60000000.0::DOUBLE) END AS velocity
  FROM spans)"""


def lookahead() -> str:
    """Insights come from local days, polls are in GMT hours: two chains over the same events."""
    local = insights()
    gmt = counts("UTC").split("localised AS", 1)[1]
    for name in ("slotted", "condensed", "counts"):
        gmt = gmt.replace(name, f"gmt_{name}")
    gmt = gmt.replace("FROM localised", "FROM gmt_localised")
    return local + ",\ngmt_localised AS" + gmt + f""",
polls AS (
  SELECT site_id, slot_date + to_hours(hour) AS ts, avail_count AS avail,
         avail_count + in_use_count + unknown_count AS total FROM gmt_counts),
local_polls AS (
  SELECT *, ts AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}' AS local_ts FROM polls),
clocked AS (
  SELECT *, CAST(dayofweek(local_ts) + 1 AS INTEGER) AS dow,
         CAST(hour(local_ts) * 60 + minute(local_ts) AS INTEGER) AS now_min FROM local_polls),
at_interval AS (
  SELECT p.*, i.start_min, i.end_min, p.now_min >= i.start_min AS in_interval
  FROM clocked p LEFT JOIN insights i
    ON p.site_id = i.site_id AND p.dow = i.dow AND i.end_min >= p.now_min
  QUALIFY row_number() OVER (PARTITION BY p.site_id, p.ts ORDER BY i.start_min) = 1),
kinds AS (
  SELECT *, CASE
      WHEN NOT in_interval AND now_min + 480 >= start_min AND avail = 0 THEN 'available'
      WHEN in_interval AND end_min < 1438 AND now_min + 480 >= end_min AND avail > 0
      THEN 'unavailable' END AS kind
  FROM at_interval WHERE dow NOT IN (1, 7)),
candidates AS (
  SELECT *, CASE kind WHEN 'available' THEN start_min ELSE end_min END AS edge_min
  FROM kinds WHERE kind IS NOT NULL)"""


def duration(minutes: str) -> str:
    return (
        f"CASE WHEN {minutes} = 0 THEN '0' ELSE concat_ws(', ', "
        f"CASE WHEN {minutes} // 60 > 0 THEN ({minutes} // 60) || ' hours' END, "
        f"CASE WHEN {minutes} % 60 > 0 THEN ({minutes} % 60) || ' minutes' END) END"
    )


NOTICE_TEXT = f"""'It is forecasted that ' || CASE kind
         WHEN 'available' THEN 'charge ports will be available in ' || {duration('(edge_min - now_min)')}
              || ' @ ' || {clock('edge_min')} || ' for ' || {duration('(end_min - start_min)')}
         ELSE 'all charge ports will be unavailable in ' || {duration('(edge_min - now_min)')}
              || ' @ ' || {clock('edge_min')} END"""


def throttled() -> str:
    return lookahead() + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS rn FROM candidates),
told AS (
  SELECT site_id, ts, rn, true AS emitted, dow AS last_dow, start_min AS last_start, ts AS last_ts
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.site_id, r.ts, r.rn, e.emit,
         CASE WHEN e.emit THEN r.dow ELSE t.last_dow END,
         CASE WHEN e.emit THEN r.start_min ELSE t.last_start END,
         CASE WHEN e.emit THEN r.ts ELSE t.last_ts END
  FROM told t JOIN ranked r ON r.site_id = t.site_id AND r.rn = t.rn + 1,
  LATERAL (SELECT r.dow <> t.last_dow OR r.start_min <> t.last_start
                  OR t.last_ts + INTERVAL 180 MINUTE < r.ts AS emit) e),
notices AS (
  SELECT ranked.* FROM ranked JOIN told USING (site_id, rn) WHERE emitted)"""


def q(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select.strip()}"


WINDOW_COLUMNS = "SELECT site_id, dow, window_no, start_min, end_min, n_cont FROM windows"
DATE_TEXT = "CAST(slot_date AS VARCHAR) AS slot_date"

SQL: dict[str, str] = {
    "outlet_readings": q(slotted(), f"""
SELECT event_id, site_id, device_id, outlet_id, status,
       CASE status WHEN 'unknown' THEN 0 WHEN 'available' THEN 1 ELSE 2 END AS status_code,
       status = 'available' AS is_available, {ts_text('ts')} AS ts, {ts_text('local_ts')} AS local_ts,
       {DATE_TEXT}, dow, hour, slot FROM slotted"""),
    "slot_keys": q(slotted(), """
SELECT printf('%02d_%02d_%02d_%02d_%02d', month(slot_date) - 1, day(slot_date), dow, hour, slot)
         AS slot_key, count(*) AS readings
FROM slotted GROUP BY 1"""),
    "json_path_extract": """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "condense_first_per_slot": q(condensed(), f"""
SELECT site_id, device_id, outlet_id, status, {ts_text('ts')} AS ts, {DATE_TEXT}, dow, hour, slot
FROM condensed"""),
    "suppress_repeats_by_arrival": q(slotted(minutes=2), f"""
SELECT event_id, device_id, outlet_id, {DATE_TEXT}, hour, slot FROM slotted
QUALIFY slot IS DISTINCT FROM lag(slot) OVER (
  PARTITION BY device_id, outlet_id, slot_date, hour ORDER BY event_id)"""),
    "slot_availability": q(counts(), f"""
SELECT site_id, {DATE_TEXT}, dow, hour, slot, avail_count, in_use_count, unknown_count,
       reading_count FROM counts"""),
    "slot_over_capacity": q(counts(), f"""
SELECT site_id, {ts_text('slot_date + to_hours(hour)')} AS slot_start, avail_count
FROM counts WHERE avail_count > 3"""),
    "latest_status_counts": q(READINGS, f"""
SELECT site_id, {ts_text('max(ts)')} AS ts, count(*) FILTER (WHERE status = 'available') AS avail,
       count(*) FILTER (WHERE status = 'in_use') AS in_use,
       count(*) FILTER (WHERE status = 'unknown') AS unknown, count(*) AS total
FROM (SELECT * FROM readings
      QUALIFY row_number() OVER (PARTITION BY device_id, outlet_id ORDER BY ts DESC, event_id DESC) = 1)
GROUP BY site_id"""),
    "unknown_status_audit": f"""
SELECT user_id % 16 AS device_id, CASE WHEN event_type <> 'signup' THEN event_type END AS status,
       count(*) AS readings, {ts_text('max(ts)')} AS last_ts
FROM events WHERE event_type <> 'view' GROUP BY 1, 2""",
    "lookback_complete_days": q(slotted(), """
SELECT CAST(slot_date AS VARCHAR) AS slot_date, count(*) AS readings FROM slotted
WHERE TIMESTAMP '2024-01-31' - slot_date::TIMESTAMP < INTERVAL 20 DAY
  AND slot_date < (SELECT max(slot_date) FROM slotted) GROUP BY 1"""),
    "incremental_new_dates": q(slotted() + """,
candidates AS (
  SELECT DISTINCT slot_date FROM slotted
  WHERE TIMESTAMP '2024-01-31' - slot_date::TIMESTAMP < INTERVAL 20 DAY),
remaining AS (
  SELECT slot_date FROM candidates
  EXCEPT SELECT slot_date FROM slotted WHERE slot_date <= DATE '2024-01-18')""", f"""
SELECT {DATE_TEXT} FROM remaining WHERE slot_date < (SELECT max(slot_date) FROM remaining)"""),
    "device_ignore": """
SELECT user_id % 16 AS device_id, count(*) AS readings FROM events
WHERE user_id % 16 NOT IN (3, 7) GROUP BY 1""",
    "managed_device_readings": """
SELECT user_id % 16 AS device_id, count(*) AS readings FROM events
WHERE user_id % 16 IN (SELECT user_id % 16 FROM events WHERE event_type = 'error') GROUP BY 1""",
    "week_grid": """
SELECT site_id, CAST((d * 24 + h) * 30 + s AS INTEGER) AS week_ordinal, CAST(d + 1 AS INTEGER) AS dow,
       CAST(h AS INTEGER) AS hour, CAST(s AS INTEGER) AS slot
FROM (SELECT DISTINCT user_id % 4 AS site_id FROM events), range(7) a(d), range(24) b(h), range(30) c(s)""",
    "weekly_profile_forecast": q(profile(), """
SELECT site_id, dow, hour, slot, week_ordinal, countavailable FROM profile"""),
    "weekly_peak_forecast": q(profile("max"), """
SELECT site_id, dow, hour, slot, week_ordinal, countavailable FROM profile"""),
    "slot_forecast_ordinals": q(profile(), """
SELECT site_id, dow, hour, slot, countavailable,
       CAST(row_number() OVER (PARTITION BY site_id ORDER BY dow, hour, slot) - 1 AS INTEGER)
         AS week_ordinal,
       CAST(row_number() OVER (PARTITION BY site_id, dow ORDER BY hour, slot) - 1 AS INTEGER)
         AS day_ordinal,
       (999 + row_number() OVER (PARTITION BY site_id ORDER BY dow, hour, slot))
         || '-05-05 09:00:00' AS "timestamp",
       (999 + row_number() OVER (PARTITION BY site_id, dow ORDER BY hour, slot))
         || '-05-05 09:00:00' AS daytimestamp
FROM profile"""),
    "history_row_ordinals": q(slotted() + """,
seen AS (SELECT device_id, dow, hour, slot, count(*) AS readings FROM slotted GROUP BY ALL)""", """
SELECT *, CAST(row_number() OVER (PARTITION BY device_id, dow ORDER BY hour, slot) - 1 AS INTEGER)
         AS day_ordinal,
       CAST(row_number() OVER (PARTITION BY device_id ORDER BY dow, hour, slot) - 1 AS INTEGER)
         AS week_ordinal FROM seen"""),
    "availability_windows": q(windows(), WINDOW_COLUMNS),
    "availability_windows_low": q(windows(1, 1, 2, "avg"), WINDOW_COLUMNS),
    "availability_windows_toggle": q(windows(2, 3, 0), WINDOW_COLUMNS),
    "availability_windows_hysteresis": q(windows(3, 1, 1), WINDOW_COLUMNS),
    "fleet_availability_windows": q(
        windows(2, 1, 1).replace("user_id % 4 AS site_id", "0 AS site_id"), """
SELECT dow, window_no, start_min, end_min, n_cont, CAST(start_min // 60 AS INTEGER) AS start_hour,
       CAST(start_min % 60 AS INTEGER) AS start_minute, CAST(end_min // 60 AS INTEGER) AS end_hour,
       CAST(end_min % 60 AS INTEGER) AS end_minute FROM windows"""),
    "window_schedule_utc": q(windows(3, 1, 1), f"""
SELECT site_id, dow, window_no, CAST(start_min // 60 AS INTEGER) AS start_hour,
       CAST(start_min % 60 AS INTEGER) AS start_minute, CAST(end_min // 60 AS INTEGER) AS end_hour,
       CAST(end_min % 60 AS INTEGER) AS end_minute,
       'available window: ' || dow || ';' || (start_min // 60) || ':' || (start_min % 60) || '-'
         || (end_min // 60) || ':' || (end_min % 60) AS name,
       strftime((TIMESTAMP '2017-11-11' + to_days(dow) + to_minutes(start_min))
         AT TIME ZONE '{ZONE}' AT TIME ZONE 'UTC', '%Y%m%dT%H%M%SZ') AS start_utc,
       strftime((TIMESTAMP '2017-11-11' + to_days(dow) + to_minutes(end_min))
         AT TIME ZONE '{ZONE}' AT TIME ZONE 'UTC', '%Y%m%dT%H%M%SZ') AS end_utc
FROM windows"""),
    "insights": q(insights(), """
SELECT site_id, dow, type, "order", msg, CAST(start_min // 60 AS INTEGER) AS start_hour,
       CAST(start_min % 60 AS INTEGER) AS start_minute, CAST(end_min // 60 AS INTEGER) AS end_hour,
       CAST(end_min % 60 AS INTEGER) AS end_minute FROM insights"""),
    "insights_for_day": q(insights(), """
SELECT site_id, dow, type, "order", msg FROM insights WHERE dow = 2
ORDER BY site_id, "order", type"""),
    "transitions": q(figures(), f"""
SELECT site_id, {ts_text('ts')} AS ts, kind, avail, avail_old, in_use, unknown, total, pct_avail,
       pct_change, pct_change_total, pct_avail_text, pct_change_text, pct_change_total_text, text
FROM figures"""),
    "depletion_velocity": q(velocities(), f"""
SELECT site_id, {ts_text('ts')} AS ts, avail_old, avail, velocity
FROM velocities WHERE kind = 'decreased'"""),
    "time_to_empty": q(velocities() + ",\n" + ",\n".join(f"""
m{n} AS (
  SELECT *, {n} AS n, {' + '.join(['velocity', *(f'lag(velocity, {i}) OVER w' for i in range(1, n))])} AS total_v,
         count(velocity) OVER (w ROWS {n - 1} PRECEDING) AS found
  FROM velocities WINDOW w AS (PARTITION BY site_id, run ORDER BY ts))""" for n in (1, 2, 3)) + """,
means AS (
  SELECT *, total_v / n::DOUBLE AS mean_velocity
  FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)
  WHERE kind = 'decreased' AND found = n),
estimates AS (
  SELECT *, CAST(round(avail / mean_velocity * 60.0::DOUBLE) AS BIGINT) AS seconds_to_empty
  FROM means WHERE mean_velocity > 0)""", f"""
SELECT site_id, {ts_text('ts')} AS ts, avail, n, mean_velocity, seconds_to_empty,
       {ts_text('ts + to_seconds(seconds_to_empty)')} AS empty_ts,
       'By ' || strftime((ts + to_seconds(seconds_to_empty)) AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}',
                         '%I:%M %p') || ' ' || avail || ' ports predicted all gone in '
         || ltrim(printf('%.2f', seconds_to_empty / 60.0::DOUBLE), '0') || ' minutes at a rate of '
         || ltrim(printf('%.2f', mean_velocity), '0') || '/min over last ' || n || ' velocities'
         AS predict_text
FROM estimates WHERE seconds_to_empty > 0"""),
    "next_interval": q(lookahead(), f"""
SELECT site_id, {ts_text('ts')} AS ts, avail, dow, now_min, start_min, end_min, in_interval
FROM at_interval"""),
    "lookahead_alerts": q(lookahead(), f"""
SELECT site_id, {ts_text('ts')} AS ts, kind, avail, edge_min - now_min AS minutes_ahead,
       {duration('(edge_min - now_min)')} AS duration_text, {clock('edge_min')} AS edge_text,
       {NOTICE_TEXT} AS text
FROM candidates"""),
    "throttled_alerts": q(throttled(), f"""
SELECT site_id, {ts_text('ts')} AS ts, kind, start_min, end_min FROM notices""", recursive=True),
    "current_prediction": q(throttled(), f"""
SELECT s.site_id, coalesce(n.kind, 'none') AS predictiontype,
       coalesce({duration('(n.edge_min - n.now_min)')}, '') AS durationstr,
       coalesce({clock('n.edge_min')}, '') AS datestr
FROM (SELECT DISTINCT site_id FROM readings) s
LEFT JOIN (SELECT * FROM notices
           QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) = 1) n
USING (site_id)""", recursive=True),
    "current_stats": q(figures(), f"""
SELECT site_id, {ts_text('ts')} AS ts, CAST(kind = 'initial' AS INTEGER) AS init, avail, avail_old,
       in_use, in_use_old, unknown, unknown_old, total, pct_avail_text, pct_change_text,
       pct_change_total_text
FROM figures QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) = 1"""),
    "training_vectors": q(condensed(), """
SELECT CAST(slot_date AS VARCHAR) AS slot_date,
       CAST(count(*) FILTER (WHERE status = 'available') AS DOUBLE) AS label,
       CAST(dow AS DOUBLE) AS feature_dow, CAST(hour + 1 AS DOUBLE) AS feature_hour,
       CAST(slot + 1 AS DOUBLE) AS feature_slot
FROM condensed GROUP BY slot_date, dow, hour, slot"""),
    "archive_ingest": q(READINGS, """
SELECT strftime(ts, '%Y-%m-%d') || '/' || device_id || '/' || strftime(ts, '%H:%M:%S') || '_'
         || event_id || '.zip' AS path,
       CAST(device_id AS VARCHAR) AS device_id, 'outlet_' || outlet_id AS outlet_id, status,
       strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%f') AS ts
FROM readings"""),
    "archive_quarantine": q(READINGS, """
SELECT (event_id % 4) || '/' || strftime(ts, '%Y-%m-%d') || '/' || device_id || '/'
         || strftime(ts, '%H:%M:%S') || '_' || event_id || '.zip' AS path,
       CASE event_id % 4 WHEN 0 THEN 'bad archive' WHEN 1 THEN 'bad json'
                         WHEN 2 THEN 'missing field' ELSE 'bad time' END AS error,
       0 AS documents_kept, CAST(event_id % 4 <> 0 AS INTEGER) AS documents_dropped
FROM readings WHERE status = 'unknown'"""),
}


def _routed() -> str:
    """Transition and forecast alerts share no chain: two statements' worth of CTEs."""
    changed = figures().split("polls AS", 1)[1].replace("FROM polls", "FROM all_polls")
    ctes = lookahead() + """,
all_polls AS (
  SELECT site_id, slot_date + to_hours(hour) AS ts, avail_count AS avail, in_use_count AS in_use,
         unknown_count AS unknown, avail_count + in_use_count + unknown_count AS total
  FROM gmt_counts),
""" + changed.split("),", 1)[1].lstrip() + f""",
alerts AS (
  SELECT site_id, ts, kind, avail, total, CAST(in_use AS VARCHAR) AS in_use_field FROM figures
  UNION ALL
  SELECT site_id, ts, kind, avail, total, NULL FROM candidates),
colours AS (
  SELECT *, CASE kind WHEN 'initial' THEN '0099ff' WHEN 'decreased' THEN 'ffcc00'
                      WHEN 'went_to_zero' THEN '990000' WHEN 'unavailable' THEN '990000'
                      ELSE '009900' END AS colour,
         avail || ' of ' || total || ' ('
           || {number('avail::DOUBLE / total::DOUBLE * 100.0')} || '%)' AS available_field
  FROM alerts),
routes AS (
  SELECT *, 'default' AS channel FROM colours
  UNION ALL
  SELECT *, 'avail-upgrade' FROM colours WHERE kind IN ('became_nonzero', 'increased')
  UNION ALL
  SELECT *, 'upgrade-threshold' FROM colours
  WHERE kind IN ('became_nonzero', 'increased') AND avail >= 2
  UNION ALL
  SELECT *, 'avail-downgrade' FROM colours WHERE kind IN ('decreased', 'went_to_zero')
  UNION ALL
  SELECT *, 'forecast' FROM colours WHERE kind IN ('available', 'unavailable'))"""
    return q(ctes, f"""
SELECT site_id, {ts_text('ts')} AS ts, kind, channel, colour, available_field, in_use_field
FROM routes""")


SQL["routed_alerts"] = _routed()

SQL["stream_slot_counts"] = SQL["slot_availability"]
SQL["stream_window_counts"] = q(READINGS, f"""
SELECT site_id, {ts_text("date_trunc('hour', ts)")} AS slot_start,
       count(*) FILTER (WHERE status = 'available') AS avail_count, count(*) AS reading_count
FROM readings GROUP BY site_id, date_trunc('hour', ts)""")
SQL["stream_slot_dedupe"] = q(READINGS, f"""
SELECT DISTINCT device_id, outlet_id, {ts_text("date_trunc('hour', ts)")} AS slot_start
FROM readings""")
SQL["stream_transitions"] = q(velocities() + """,
ranked AS (
  SELECT *, count(velocity) OVER (
    PARTITION BY site_id, run ORDER BY ts ROWS 2 PRECEDING) AS known FROM velocities)""", f"""
SELECT site_id, {ts_text('ts')} AS ts, kind, avail, avail_old, in_use, unknown, total, velocity,
       CAST(CASE WHEN kind = 'decreased' THEN known ELSE 0 END AS INTEGER) AS estimates
FROM ranked""")
SQL["stream_notices"] = q(throttled(), f"""
SELECT site_id, {ts_text('ts')} AS ts, kind, start_min, end_min, {NOTICE_TEXT} AS text
FROM notices""", recursive=True)

SQL["latest_archive_counts"] = q(READINGS, f"""
SELECT CAST(device_id AS VARCHAR) AS device_id,
       {ts_text("date_trunc('millisecond', ts)")} AS ts,
       CAST(status = 'available' AS BIGINT) AS avail, CAST(status = 'in_use' AS BIGINT) AS in_use,
       CAST(status = 'unknown' AS BIGINT) AS unknown, CAST(1 AS BIGINT) AS total
FROM readings
QUALIFY row_number() OVER (
  PARTITION BY device_id
  ORDER BY strftime(ts, '%Y-%m-%d') DESC,
           strftime(ts, '%H:%M:%S') || '_' || event_id || '.zip' DESC) = 1""")
SQL["latest_status_pivot"] = q(READINGS, """
SELECT device_id, count(*) FILTER (WHERE status = 'unknown') AS unknown,
       count(*) FILTER (WHERE status = 'available') AS available,
       count(*) FILTER (WHERE status = 'in_use') AS in_use
FROM (SELECT * FROM readings
      QUALIFY row_number() OVER (PARTITION BY device_id, outlet_id ORDER BY ts DESC, event_id DESC) = 1)
GROUP BY device_id""")
SQL["outlet_key_split"] = q(READINGS, """
SELECT CAST(device_id AS VARCHAR) AS device, 'outlet_' || outlet_id AS outlet,
       outlet_id AS outlet_code, count(*) AS readings FROM readings GROUP BY ALL""")
SQL["holiday_flags"] = q(condensed() + """,
quiet AS (
  SELECT slot_date FROM slotted GROUP BY slot_date
  HAVING count(*) FILTER (WHERE status = 'in_use' AND hour < 9) * 6 < count(*))""", f"""
SELECT {DATE_TEXT}, slot_date IN (SELECT slot_date FROM quiet) AS holiday, count(*) AS readings
FROM condensed GROUP BY ALL""")
SQL["times_on_reference_day"] = f"""
SELECT event_id, {ts_text("TIMESTAMP '2017-11-12' + (ts - date_trunc('day', ts))")} AS moved_ts
FROM events"""
SQL["libsvm_round_trip"] = q(condensed(), """
SELECT CAST(count(*) FILTER (WHERE status = 'available') AS DOUBLE) AS label,
       CAST(dow AS DOUBLE) AS feature_dow, CAST(hour + 1 AS DOUBLE) AS feature_hour,
       CAST(slot + 1 AS DOUBLE) AS feature_slot
FROM condensed GROUP BY slot_date, dow, hour, slot""")
SQL["json_forecast_round_trip"] = SQL["weekly_profile_forecast"]
SQL["stats_upsert"] = q(changes(), f"""
SELECT site_id, {ts_text('ts')} AS ts, kind, avail, avail_old, total FROM changes
QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) = 1""")
SQL["compacted_records"] = SQL["stats_upsert"]
SQL["compacted_changes"] = q(changes(), f"""
SELECT site_id, {ts_text('ts')} AS ts, kind, avail, total FROM changes""")
SQL["newest_decreases"] = q(changes(), f"""
SELECT site_id, {ts_text('ts')} AS ts, kind, avail, total FROM changes WHERE kind = 'decreased'
ORDER BY ts DESC, site_id LIMIT 50""")
SQL["ingested_days"] = q(condensed(), f"""
SELECT {DATE_TEXT}, status, count(*) AS readings FROM condensed
WHERE slot_date BETWEEN DATE '2024-01-20' AND DATE '2024-01-29' GROUP BY ALL""")
SQL["backlog_transitions"] = SQL["stream_transitions"]
SQL["backlog_notices"] = SQL["stream_notices"]
SQL["live_snapshot_polls"] = SQL["latest_status_counts"].replace(
    "max(ts)", "date_trunc('millisecond', max(ts))"
)
SQL["replaced_latest_polls"] = q(READINGS, f"""
SELECT batch, site_id, {ts_text("date_trunc('millisecond', max(ts))")} AS ts,
       count(*) FILTER (WHERE status = 'available') AS avail,
       count(*) FILTER (WHERE status = 'in_use') AS in_use,
       count(*) FILTER (WHERE status = 'unknown') AS unknown, count(*) AS total
FROM (
  SELECT r.*, batch FROM readings r, range(3) AS batches(batch),
         (SELECT min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM readings)
  WHERE (epoch_us(ts) - first) * 3 // (last - first + 1) <= batch
  QUALIFY row_number() OVER (PARTITION BY batch, device_id, outlet_id ORDER BY ts DESC, event_id DESC) = 1)
GROUP BY batch, site_id""").replace("SELECT batch,", "SELECT CAST(batch AS INTEGER) AS batch,", 1)
SQL["live_current_stats"] = SQL["current_stats"]
SQL["stream_irregular_slots"] = q(READINGS + """,
moved AS (SELECT * REPLACE (ts + INTERVAL 91 DAY AS ts) FROM readings),
localised AS (
  SELECT *, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Australia/Lord_Howe' AS local_ts,
         (ts - INTERVAL 30 MINUTE) AT TIME ZONE 'UTC' AT TIME ZONE 'Australia/Lord_Howe' AS before
  FROM moved),
firsts AS (
  SELECT *, date_trunc('hour', local_ts) AS slot_at, before = local_ts AS second_pass FROM localised
  QUALIFY row_number() OVER (
    PARTITION BY site_id, device_id, outlet_id, slot_at, second_pass ORDER BY ts) = 1)""", f"""
SELECT site_id, second_pass, {ts_text('slot_at')} AS slot_start,
       count(*) FILTER (WHERE status = 'available') AS avail_count,
       count(*) FILTER (WHERE status = 'in_use') AS in_use_count,
       count(*) FILTER (WHERE status = 'unknown') AS unknown_count, count(*) AS reading_count,
       strftime(slot_at, '%Y-%m-%d') AS slot_date, CAST(dayofweek(slot_at) + 1 AS INTEGER) AS dow,
       CAST(hour(slot_at) AS INTEGER) AS hour, CAST(minute(slot_at) // 60 AS INTEGER) AS slot
FROM firsts GROUP BY site_id, second_pass, slot_at""")
# how the forest is grown cannot be said; that it is no worse than the baseline can
SQL["count_forest_holdout"] = q(counts() + """,
bound AS (SELECT max(slot_date) - 10 AS newest FROM counts),
usual AS (
  SELECT site_id, dow, hour, slot, CAST(round(avg(avail_count)) AS INTEGER) AS usual
  FROM counts, bound WHERE slot_date <= newest GROUP BY ALL)""", """
SELECT site_id, count(*) AS test_slots, round(avg((avail_count - coalesce(usual, 0)) ** 2.0), 6) AS baseline_error,
       true AS forest_no_worse
FROM counts CROSS JOIN bound LEFT JOIN usual USING (site_id, dow, hour, slot)
WHERE slot_date > newest GROUP BY site_id""")


def _schedule(opening: int, closing: int, least: int) -> str:
    edge = "strftime((TIMESTAMP '2017-11-11' + to_days(dow) + to_minutes({}))"
    edge += f" AT TIME ZONE '{ZONE}' AT TIME ZONE 'UTC', '%Y%m%dT%H%M%SZ')"
    return q(windows(opening, closing, least), f"""
SELECT site_id, dow, 'available window: ' || dow || ';' || (start_min // 60) || ':'
         || (start_min % 60) || '-' || (end_min // 60) || ':' || (end_min % 60) AS name,
       {edge.format('start_min')} AS start_utc, {edge.format('end_min')} AS end_utc FROM windows""")


SQL["replaced_schedule"] = f"""
SELECT 'kept' AS schedule, * FROM ({_schedule(3, 1, 1)})
UNION ALL SELECT 'replaced', * FROM ({_schedule(2, 2, 2)})"""

SQL["live_alerts"] = f"""
WITH routed AS ({SQL['routed_alerts']}),
told AS ({SQL['throttled_alerts']}),
predicted AS (
  SELECT site_id, ts, string_agg(predict_text, chr(10) ORDER BY n) AS predict_field
  FROM ({SQL['time_to_empty']}) GROUP BY site_id, ts)
SELECT r.site_id, r.ts, r.kind, r.channel, r.colour, r.available_field, p.predict_field
FROM routed r LEFT JOIN predicted p ON p.site_id = r.site_id AND p.ts = r.ts
WHERE r.kind NOT IN ('available', 'unavailable')
UNION ALL
SELECT r.site_id, r.ts, r.kind, r.channel, r.colour, r.available_field, NULL
FROM routed r JOIN told t ON t.site_id = r.site_id AND t.ts = r.ts AND t.kind = r.kind"""

# multinomial naive Bayes with smoothing 0.5 over (dow, hour + 1, slot + 1)
BAYES_ROWS = condensed() + """,
rows AS (
  SELECT CASE status WHEN 'unknown' THEN 0 WHEN 'available' THEN 1 ELSE 2 END AS label, slot_date,
         dow AS x1, hour + 1 AS x2, slot + 1 AS x3,
         (device_id * 7 + outlet_id * 3 + hour * 11 + dayofmonth(slot_date) * 13) % 100 AS part
  FROM condensed)"""


def bayes_weights(train: str) -> str:
    return f""",
sums AS (
  SELECT label, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x3) AS s3
  FROM rows WHERE {train} GROUP BY label),
weights AS (
  SELECT label, ln(n + 0.5) - ln(sum(n) OVER () + 1.5) AS pi,
         ln(s1 + 0.5) - ln(s1 + s2 + s3 + 1.5) AS t1, ln(s2 + 0.5) - ln(s1 + s2 + s3 + 1.5) AS t2,
         ln(s3 + 0.5) - ln(s1 + s2 + s3 + 1.5) AS t3 FROM sums)"""


SQL["bayes_date_holdout"] = q(
    BAYES_ROWS + bayes_weights("slot_date <= DATE '2024-01-20'") + """,
predicted AS (
  SELECT x1, x2, x3, arg_max(weights.label, pi + x1 * t1 + x2 * t2 + x3 * t3) AS prediction
  FROM (SELECT DISTINCT x1, x2, x3 FROM rows), weights GROUP BY ALL)""", """
SELECT count(*) AS test_rows, avg(CAST(label = prediction AS DOUBLE)) AS accuracy
FROM rows JOIN predicted USING (x1, x2, x3) WHERE slot_date > DATE '2024-01-20'""")
SQL["bayes_holdout_accuracy"] = q(
    BAYES_ROWS + bayes_weights("part < 60") + """,
predicted AS (
  SELECT x1, x2, x3, arg_max(weights.label, pi + x1 * t1 + x2 * t2 + x3 * t3) AS prediction
  FROM (SELECT DISTINCT x1, x2, x3 FROM rows), weights GROUP BY ALL)""", """
SELECT count(*) AS test_rows, avg(CAST(label = prediction AS DOUBLE)) AS accuracy
FROM rows JOIN predicted USING (x1, x2, x3) WHERE part >= 60""")
SQL["nb_status_classifier"] = q(BAYES_ROWS + bayes_weights("true") + """,
scores AS (
  SELECT CAST(d AS INTEGER) AS dow, CAST(h AS INTEGER) AS hour, label,
         pi + d * t1 + (h + 1) * t2 + t3 AS score
  FROM weights, range(1, 8) a(d), range(24) b(h)),
shares AS (
  SELECT *, exp(score - max(score) OVER w) AS e FROM scores WINDOW w AS (PARTITION BY dow, hour))""", """
SELECT dow, hour, 0 AS slot,
       CASE arg_max(label, score) WHEN 0 THEN 'unknown' WHEN 1 THEN 'available' ELSE 'in_use' END
         AS predicted_status,
       round(sum(e) FILTER (WHERE label = 0) / sum(e), 6) AS prob_unknown,
       round(sum(e) FILTER (WHERE label = 1) / sum(e), 6) AS prob_available,
       round(sum(e) FILTER (WHERE label = 2) / sum(e), 6) AS prob_in_use
FROM shares GROUP BY dow, hour""")

SQL["live_alerts_by_day"] = SQL["live_alerts"]
for _engine in ("stream", "backlog"):
    SQL[f"shuffled_{_engine}_transitions"] = SQL["stream_transitions"]
    SQL[f"shuffled_{_engine}_notices"] = SQL["stream_notices"]
# the n-th arrival has the hours that leave n - 1 when divided by 3
SQL["late_polls"] = q(changes(), f"""
SELECT p.site_id, CAST(hour(p.ts) % 3 AS INTEGER) AS arrival, count(*) AS late, {ts_text('max(p.ts)')} AS newest
FROM polls p
WHERE p.ts < (SELECT max(o.ts) FROM polls o WHERE o.site_id = p.site_id AND hour(o.ts) % 3 < hour(p.ts) % 3)
GROUP BY ALL""")
SQL["late_polls_by_day"] = SQL["late_polls"]

# what must hold of every slot of the week, of the fleet and of each outlet
SQL["forest_by_joins"] = """
SELECT CAST(d AS INTEGER) AS dow, CAST(h AS INTEGER) AS hour, 0 AS slot,
       true AS same_prediction, true AS same_probability
FROM range(1, 8) a(d), range(24) b(h)"""
SQL["outlet_registry"] = q(condensed(), """
SELECT 'station-' || device_id AS device_id, 'outlet_' || outlet_id AS outlet_id, CAST(d AS INTEGER) AS dow,
       CAST(h AS INTEGER) AS hour, 0 AS slot, true AS shares_of_one, true AS as_saved
FROM (SELECT DISTINCT device_id, outlet_id FROM condensed), range(1, 8) a(d), range(24) b(h)""")

SQL["late_readings_ingested"] = SQL["ingested_days"]
