"""DuckDB SQL for each query, over views of the same tables. Types follow Spark's: date parts are INTEGER."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

EVENT = "event_id, ts, user_id, event_type, value, props"
DAY = "CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day"
HOUR = f"{DAY}, CAST(hour(ts) AS INTEGER) AS hour"
MINUTE = f"{HOUR}, CAST(minute(ts) AS INTEGER) AS minute"
ON_SLOT_DAY = "ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'"

ORACLES["event_count_by_user"] = "SELECT user_id, count(*) AS event_count FROM events GROUP BY user_id"
ORACLES["event_keys"] = "SELECT user_id FROM events"
ORACLES["row_count"] = "SELECT count(*) AS row_count FROM events"
ORACLES["view_scan_one_day"] = f"SELECT {EVENT}, {DAY} FROM events WHERE {ON_SLOT_DAY}"
ORACLES["view_scan_one_hour"] = (
    f"SELECT {EVENT}, {HOUR} FROM events WHERE date_trunc('hour', ts) = TIMESTAMP '2024-01-15 12:00:00'")
ORACLES["read_at_nominal"] = f"SELECT {EVENT}, {DAY} FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-20'"
ORACLES["read_whole_dataset"] = f"SELECT {EVENT}, {DAY} FROM events"
ORACLES["refine_partition_and_data"] = (
    f"SELECT {EVENT}, {DAY} FROM events WHERE month(ts) = 1 AND event_type = 'click'")
ORACLES["covering_partitions"] = f"SELECT DISTINCT {DAY} FROM events"
ORACLES["rows_per_partition"] = f"SELECT {DAY}, count(*) AS event_count FROM events GROUP BY ALL"
ORACLES["rows_per_hour"] = f"SELECT {HOUR}, count(*) AS event_count FROM events GROUP BY ALL"
ORACLES["odd_users"] = f"SELECT {EVENT} FROM events WHERE user_id % 2 = 1"
ORACLES["example_events"] = (
    "SELECT user_id, CAST(event_id AS VARCHAR) AS session_id, ts AS \"timestamp\" FROM events")
ORACLES["generate_events"] = f"""
SELECT user_id, CAST(user_id AS VARCHAR) AS session_id, ts AS "timestamp", {DAY}
FROM (SELECT DISTINCT date_trunc('minute', ts) AS ts FROM events), range(0, 10) AS users(user_id)"""

ORACLES["copy_view"] = f"""
SELECT {EVENT}, CAST(2024 AS INTEGER) AS year, CAST(2 AS INTEGER) AS month, CAST(1 AS INTEGER) AS day
FROM events WHERE {ON_SLOT_DAY}"""
ORACLES["union_inputs"] = f"""
SELECT {EVENT}, CAST(2024 AS INTEGER) AS year, CAST(1 AS INTEGER) AS month, CAST(15 AS INTEGER) AS day FROM (
  SELECT * FROM events WHERE event_type = 'click'
  UNION ALL SELECT * FROM events WHERE event_type = 'error'
  UNION ALL SELECT * FROM events)"""
ORACLES["reconcile"] = f"""
WITH expected AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'purchase'),
     actual AS (SELECT * FROM events WHERE event_type <> 'error'
                UNION ALL SELECT * FROM events WHERE event_type = 'signup')
SELECT {EVENT}, side, count(*) AS copies FROM (
  SELECT *, 'missing' AS side FROM (SELECT * FROM expected EXCEPT ALL SELECT * FROM actual)
  UNION ALL
  SELECT *, 'unexpected' AS side FROM (SELECT * FROM actual EXCEPT ALL SELECT * FROM expected))
GROUP BY ALL"""
ORACLES["reconcile_round_trip"] = """
SELECT count(*) AS row_count FROM (SELECT * FROM events EXCEPT ALL SELECT * FROM events)"""

ORACLES["time_parts"] = f"SELECT event_id, {MINUTE} FROM events"
ORACLES["time_parts_of_orders"] = (
    f"SELECT o_orderkey, {MINUTE} FROM (SELECT o_orderkey, o_orderdate AS ts FROM orders)")
ORACLES["slot_time"] = "SELECT event_id, date_trunc('minute', ts) AS nominal_time FROM events"
ORACLES["render_template"] = """
SELECT event_id, 'view:hive:shop/visits?year=' || year(ts) || '&month=' || month(ts) || '&day=' || day(ts)
  || '&hour=' || hour(ts) || '&minute=' || minute(ts) AS uri FROM events"""
ORACLES["render_template_padded"] = """
SELECT event_id, strftime(ts, 'view:hive:shop/visits?year=%Y&month=%m&day=%d&hour=%H&minute=%M') AS uri
FROM events"""
ORACLES["render_template_column"] = """
SELECT event_id, 'view:hive:shop/' || event_type || '?day=' || day(ts) || '&hour=' || hour(ts) AS uri
FROM events"""
ORACLES["parse_view_uri"] = """
WITH parts AS (
  SELECT event_id, event_type AS t, CAST(year(ts) AS VARCHAR) AS y, CAST(month(ts) AS VARCHAR) AS m,
         CAST(day(ts) AS VARCHAR) AS d, CAST(hour(ts) AS VARCHAR) AS h, CAST(minute(ts) AS VARCHAR) AS n FROM events)
SELECT event_id,
  CASE t WHEN 'error' THEN 'dataset' WHEN 'signup' THEN 'no scheme, year=' || y ELSE 'view' END AS kind,
  CASE t WHEN 'view' THEN 'hdfs' WHEN 'signup' THEN NULL ELSE 'hive' END AS store,
  CASE t WHEN 'click' THEN 'catalog.local:9083' END AS authority,
  CASE t WHEN 'view' THEN '/lake/visits' WHEN 'signup' THEN NULL ELSE 'shop/visits' END AS path,
  CASE t WHEN 'click' THEN m WHEN 'view' THEN y WHEN 'purchase' THEN y END AS year,
  CASE t WHEN 'view' THEN m WHEN 'purchase' THEN m END AS month,
  CASE t WHEN 'click' THEN d WHEN 'view' THEN d WHEN 'purchase' THEN d END AS day,
  CASE t WHEN 'purchase' THEN h END AS hour,
  CASE t WHEN 'purchase' THEN n END AS minute
FROM parts"""
ORACLES["format_nominal"] = "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%MZ') AS nominal FROM events"
ORACLES["parse_nominal"] = """
SELECT event_id, strptime(strftime(ts, '%Y-%m-%dT%H:%MZ'), '%Y-%m-%dT%H:%MZ') AS nominal_time FROM events"""
ORACLES["epoch_millis"] = """
SELECT event_id, epoch_us(ts) // 1000 AS millis, date_trunc('millisecond', ts) AS ts_millis FROM events"""

ORACLES["next_fire_minutely"] = (
    "SELECT event_id, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS next_fire FROM events")
ORACLES["next_fire_five_minutes"] = """
SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS next_fire FROM events"""
ORACLES["next_fire_hourly"] = """
SELECT event_id, CASE WHEN date_trunc('hour', ts) = ts THEN ts
                      ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS next_fire FROM events"""
ORACLES["next_fire_every_six_hours"] = """
SELECT event_id, date_trunc('day', ts) + INTERVAL 30 MINUTE + to_hours(6 * CAST(greatest(0, ceil(
  (epoch_us(ts) - epoch_us(date_trunc('day', ts)) - 1800000000) / 21600000000)) AS INTEGER)) AS next_fire
FROM events"""
ORACLES["next_fire_daily"] = """
SELECT event_id, CASE WHEN date_trunc('day', ts) + INTERVAL 1 HOUR >= ts THEN date_trunc('day', ts) + INTERVAL 1 HOUR
                      ELSE date_trunc('day', ts) + INTERVAL 25 HOUR END AS next_fire FROM events"""

# The schedules of the queries, in turn, with the test a minute t must pass to be a slot of each.
_SLOT_TESTS = [
    ("* * * * *", "true"),
    ("*/7 * * * *", "minute(t) % 7 = 0"),
    ("0 * * * *", "minute(t) = 0"),
    ("17 */5 * * *", "minute(t) = 17 AND hour(t) % 5 = 0"),
    ("59 23 * * *", "minute(t) = 59 AND hour(t) = 23"),
    ("30 9 * * *", "minute(t) = 30 AND hour(t) = 9"),
    ("0 12 */7 * *", "minute(t) = 0 AND hour(t) = 12"),
    ("*/20 9 * * *", "minute(t) % 20 = 0"),
    ("5 */24 * * *", "minute(t) = 5 AND hour(t) = 0"),
]
_CRON = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (c, _) in enumerate(_SLOT_TESTS)) + " END"
_IS_SLOT = "CASE event_id % 9 " + " ".join(f"WHEN {i} THEN {test}" for i, (_, test) in enumerate(_SLOT_TESTS)) + " END"

# Every minute of a day before and after the event is tried.
_TRIED = f"""
WITH tried AS (
  SELECT event_id, ts, date_trunc('minute', ts) + to_minutes(CAST(i AS INTEGER)) AS t
  FROM events, range(-1440, 1441) AS minutes(i)),
slots AS (SELECT * FROM tried WHERE {_IS_SLOT})
SELECT event_id, {_CRON} AS cron,"""
ORACLES["next_fire_by_schedule"] = f"""{_TRIED}
  min(t) FILTER (CASE WHEN event_id % 9 IN (0, 1, 7) THEN t > ts ELSE t >= ts END) AS next_fire
FROM slots GROUP BY event_id"""
ORACLES["next_fire_inclusive_by_schedule"] = f"""{_TRIED}
  min(t) FILTER (t >= date_trunc('minute', ts)) AS next_fire
FROM slots GROUP BY event_id"""
ORACLES["slot_by_schedule"] = f"""{_TRIED}
  max(t) FILTER (t <= ts) AS slot
FROM slots GROUP BY event_id"""

ORACLES["audit_schedules"] = r"""
WITH fields AS (
  SELECT c_custkey,
    CASE c_custkey % 6 WHEN 0 THEN '*' WHEN 1 THEN '*/' || (c_custkey % 13) WHEN 2 THEN '' || (c_custkey % 64)
      WHEN 3 THEN '1-5' WHEN 4 THEN '' || (c_custkey % 60) ELSE '*/99999999999' END AS m,
    CASE (c_custkey // 6) % 5 WHEN 0 THEN '*' WHEN 1 THEN '*/' || (c_custkey % 9) WHEN 2 THEN '' || (c_custkey % 26)
      WHEN 3 THEN 'x' ELSE '*' END AS h,
    CASE (c_custkey // 30) % 4 WHEN 0 THEN '*' WHEN 1 THEN '*/7' WHEN 2 THEN '15' ELSE '*' END AS d,
    CASE (c_custkey // 120) % 6 WHEN 3 THEN '* 1' WHEN 4 THEN '*' WHEN 5 THEN '* * ' ELSE '* *' END AS r
  FROM customer),
checked AS (
  SELECT c_custkey, m, h, d, concat_ws(' ', m, h, d, r) AS cron, CASE
    WHEN r = '*' THEN 'needs five fields'
    WHEN m = '1-5' THEN 'minute is not a number, * or */n'
    WHEN h = 'x' THEN 'hour is not a number, * or */n'
    WHEN r = '* 1' THEN 'month and weekday must be *'
    WHEN m IN ('*/0', '*/99999999999') OR h = '*/0' THEN 'step must be from 1 to 2147483647'
    WHEN try_cast(m AS INTEGER) > 59 THEN 'minute is above 59'
    WHEN try_cast(h AS INTEGER) > 23 THEN 'hour is above 23'
    WHEN d = '15' THEN 'day must be * or */n'
  END AS reason FROM fields)
SELECT c_custkey, cron, reason IS NULL AS valid, coalesce(reason, '') AS reason,
  CASE WHEN reason IS NOT NULL THEN 0 ELSE CASE
    WHEN m LIKE '*%' THEN CAST(coalesce(nullif(regexp_extract(m, '/(\d+)', 1), ''), '1') AS INTEGER)
    WHEN h LIKE '*%' THEN CAST(coalesce(nullif(regexp_extract(h, '/(\d+)', 1), ''), '1') AS INTEGER)
    ELSE CAST(coalesce(nullif(regexp_extract(d, '/(\d+)', 1), ''), '1') AS INTEGER) END END AS every,
  CASE WHEN reason IS NOT NULL THEN ''
    WHEN m LIKE '*%' THEN 'minutes' WHEN h LIKE '*%' THEN 'hours' ELSE 'days' END AS unit
FROM checked"""

ORACLES["fire_slots"] = """
WITH schedules AS (
  SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '0 * * * *' WHEN 1 THEN '30 */6 * * *' WHEN 2 THEN '15 3 * * *'
      WHEN 3 THEN '0 12 */7 * *' WHEN 4 THEN '17 */5 * * *' ELSE '*/20 9 * * *' END AS cron,
    TIMESTAMP '2024-01-01 00:00:30' + to_minutes(CAST((c_custkey * 37) % 20000 AS INTEGER)) AS s,
    s + to_days(CAST(c_custkey % 5 + 1 AS INTEGER)) AS e
  FROM customer),
tried AS (
  SELECT c_custkey, cron, e,
    unnest(generate_series(date_trunc('minute', s) + INTERVAL 1 MINUTE, e, INTERVAL 1 MINUTE)) AS t FROM schedules)
SELECT c_custkey, cron, t AS nominal_time FROM tried
WHERE t < e AND CASE c_custkey % 6
  WHEN 0 THEN minute(t) = 0
  WHEN 1 THEN minute(t) = 30 AND hour(t) % 6 = 0
  WHEN 2 THEN minute(t) = 15 AND hour(t) = 3
  WHEN 3 THEN minute(t) = 0 AND hour(t) = 12 AND day(t) IN (1, 8, 15, 22, 29)
  WHEN 4 THEN minute(t) = 17 AND hour(t) IN (0, 5, 10, 15, 20)
  ELSE minute(t) IN (0, 20, 40) AND hour(t) = 9 END"""

ORACLES["events_per_slot"] = """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS nominal_time, count(*) AS event_count FROM events GROUP BY ALL"""
ORACLES["events_per_slot_uneven"] = """
WITH tried AS (
  SELECT event_id, ts, date_trunc('minute', ts) - to_minutes(CAST(i AS INTEGER)) AS t
  FROM events, range(0, 1441) AS minutes(i)),
slots AS (
  SELECT event_id, max(t) AS nominal_time FROM tried WHERE minute(t) = 17 AND hour(t) IN (0, 5, 10, 15, 20)
  GROUP BY event_id)
SELECT nominal_time, count(*) AS event_count FROM slots GROUP BY nominal_time"""
ORACLES["is_slot"] = f"""
SELECT event_id, CAST(coalesce({_IS_SLOT}, false)
  AND CASE event_id % 9 WHEN 6 THEN (day(t) - 1) % 7 = 0 WHEN 7 THEN hour(t) = 9 ELSE true END AS INTEGER) AS on_slot
FROM (SELECT event_id, date_trunc('minute', ts) AS t FROM events)"""
ORACLES["instance_at"] = """
SELECT event_id, t AS nominal_time,
  TIMESTAMP '2024-01-01 00:03:00'
    + to_minutes(CAST(7 * floor((epoch(t) - epoch(TIMESTAMP '2024-01-01 00:03:00')) / 420) AS INTEGER)) AS seven_minutes,
  TIMESTAMP '2024-01-10 12:00:00'
    + to_days(CAST(7 * floor((epoch(t) - epoch(TIMESTAMP '2024-01-10 12:00:00')) / 604800) AS INTEGER)) AS seven_days
FROM (SELECT event_id, date_trunc('minute', ts) AS t FROM events)"""

_HOURS = """
hours AS (
  SELECT unnest(generate_series(date_trunc('hour', a), b, INTERVAL 1 HOUR)) AS t, a, b
  FROM (SELECT min(ts) AS a, max(ts) AS b FROM events)),
slots AS (SELECT t AS nominal_time FROM hours WHERE t >= a AND t < b),
marks AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS nominal_time FROM events)"""

ORACLES["ready_marks"] = """
SELECT DISTINCT date_trunc('hour', ts) AS nominal_time FROM events WHERE event_type = 'purchase'"""
ORACLES["ready_slots"] = f"""
WITH {_HOURS}
SELECT nominal_time FROM slots WHERE nominal_time IN (
  SELECT nominal_time FROM marks GROUP BY nominal_time
  HAVING count(DISTINCT event_type) FILTER (event_type IN ('click', 'error', 'purchase', 'signup', 'view')) = 5)"""
ORACLES["missing_slots"] = """
WITH grid AS (
  SELECT unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, a) + INTERVAL 5 MINUTE, b, INTERVAL 5 MINUTE)) AS t, b
  FROM (SELECT min(ts) AS a, max(ts) AS b FROM events))
SELECT t AS nominal_time FROM grid WHERE t < b
  AND t NOT IN (SELECT DISTINCT time_bucket(INTERVAL 5 MINUTE, ts) FROM events)"""
ORACLES["pending_slots"] = f"""
WITH {_HOURS}
SELECT nominal_time FROM slots
WHERE nominal_time IN (SELECT nominal_time FROM marks WHERE event_type = 'click')
  AND nominal_time IN (SELECT nominal_time FROM marks WHERE event_type = 'view')
  AND nominal_time NOT IN (SELECT nominal_time FROM marks WHERE event_type = 'purchase')"""

ORACLES["report_into_slot"] = """
SELECT user_id, count(*) AS event_count, CAST(2024 AS INTEGER) AS year, CAST(1 AS INTEGER) AS month,
  CAST(31 AS INTEGER) AS day, CAST(0 AS INTEGER) AS hour, CAST(5 AS INTEGER) AS minute
FROM events GROUP BY user_id"""
ORACLES["run_at_odd_users"] = f"""
SELECT {EVENT}, {DAY}, date_trunc('day', ts) AS nominal_time FROM events WHERE user_id % 2 = 1 AND {ON_SLOT_DAY}"""
ORACLES["backfill_odd_users"] = f"SELECT {EVENT}, {DAY} FROM events WHERE user_id % 2 = 1"
ORACLES["backfill_report"] = f"SELECT user_id, count(*) AS event_count, {DAY} FROM events GROUP BY ALL"
ORACLES["backfill_again"] = f"SELECT {EVENT}, {DAY} FROM events WHERE day(ts) > 15"
ORACLES["triggered_backfill"] = f"""
SELECT {EVENT}, {DAY} FROM events
WHERE user_id % 2 = 1 AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-25'"""
ORACLES["ensure_dataset_evolves"] = f"""
SELECT {EVENT}, CAST(NULL AS VARCHAR) AS channel FROM events
UNION ALL SELECT {EVENT}, 'from error' AS channel FROM events WHERE event_type = 'error'"""
ORACLES["schema_generations"] = """
WITH generations AS (
  SELECT event_id, ts, user_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value, 'web' AS channel, event_type AS kind,
         CAST(3 AS BIGINT) AS level, CAST(NULL AS INTEGER) AS rank
  FROM events WHERE ts < TIMESTAMP '2024-01-11'
  UNION ALL BY NAME
  SELECT event_id, ts, user_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,
         CASE WHEN event_id % 4 > 0 THEN event_type END AS channel, event_type AS kind, length(event_type) AS level
  FROM events WHERE ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21'
  UNION ALL BY NAME
  SELECT event_id, ts, user_id, value, CASE WHEN event_id % 4 > 0 THEN event_type END AS channel, event_type AS kind,
         length(event_type) AS level, CAST(1 AS INTEGER) AS rank
  FROM events WHERE ts >= TIMESTAMP '2024-01-21')
SELECT store, event_id, ts, user_id, value, channel,
       CASE WHEN kind <> 'error' THEN kind END AS kind_name, CASE WHEN kind <> 'error' THEN level END AS kind_level,
       CASE WHEN kind <> 'error' THEN rank END AS kind_rank
FROM generations, (VALUES ('folder'), ('catalog')) AS stores(store)"""
ORACLES["stream_closes_slots"] = """
WITH arrived AS (
  SELECT ts, date_trunc('day', ts) AS d,
         CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN 3
              WHEN ts < TIMESTAMP '2024-01-08' AND event_type = 'error' THEN 2 ELSE 1 END AS step
  FROM events),
days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-29', INTERVAL 1 DAY)) AS TIMESTAMP) AS d),
closed AS (
  SELECT s.step, min(a.d) FILTER (WHERE a.step = 1) AS since, date_trunc('day', max(a.ts) - INTERVAL 36 HOUR) AS until
  FROM (VALUES (1), (2), (3)) AS s(step) JOIN arrived a ON a.step <= s.step GROUP BY s.step),
due AS (
  SELECT c.step, d.d FROM closed c JOIN days d ON d.d >= c.since AND d.d < c.until
  WHERE c.step <> 2 OR d.d NOT IN (SELECT d FROM arrived WHERE step = 2))
SELECT CASE due.step WHEN 1 THEN 'first' WHEN 2 THEN 'late' ELSE 'last' END AS step, CAST(due.d AS TIMESTAMP) AS nominal_time,
       count(a.d) AS n_events
FROM due LEFT JOIN arrived a ON a.d = due.d AND a.step <= due.step GROUP BY ALL"""
ORACLES["save_nonempty"] = f"""
SELECT {EVENT}, CAST(1 AS INTEGER) AS first_saved, CAST(0 AS INTEGER) AS second_saved FROM events"""
ORACLES["map_columns_round_trip"] = """
SELECT event_id, key, json_extract_string(props, '$.' || key) AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)"""

for _name in ("topic_round_trip", "stream_topic_to_dataset", "stream_topic_to_topic"):
    ORACLES[_name] = f"SELECT {EVENT} FROM events"

ORACLES["due_by_constrained_view"] = """
SELECT DISTINCT 'click' AS event_type, date_trunc('day', ts) AS nominal_time FROM events
WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-25'"""
ORACLES["view_scan_text_partition"] = """
SELECT 'folders' AS store, c_custkey, '007' AS code FROM customer WHERE c_nationkey = 7
UNION ALL SELECT 'slots', c_custkey, CASE c_nationkey WHEN 7 THEN '007' WHEN 8 THEN '07' ELSE '7' END
          FROM customer WHERE c_nationkey IN (7, 8, 9)
UNION ALL SELECT 'one slot', c_custkey, '07' FROM customer WHERE c_nationkey = 8
UNION ALL SELECT 'catalog', c_custkey, '007' FROM customer WHERE c_nationkey = 7"""
ORACLES["stream_into_day_partitions"] = ORACLES["view_scan_one_day"]
ORACLES["compact_stream"] = ORACLES["view_scan_one_day"]
ORACLES["record_function_in_job"] = f"""
SELECT {EVENT}, {DAY}, CAST(list_sum(list_transform(range(16), lambda i: ((event_id >> i) & 1) << (15 - i))) AS BIGINT) AS reversed
FROM events"""
ORACLES["per_batch_side_effect"] = "SELECT event_type, count(*) AS n_events FROM events GROUP BY event_type"
ORACLES["backfill_catalog"] = ORACLES["backfill_again"]
ORACLES["list_partitions"] = ORACLES["covering_partitions"]
ORACLES["compacted_marks"] = ORACLES["ready_marks"]

ORACLES["reconcile_in_order"] = """
WITH sent AS (SELECT event_id, event_type, value, row_number() OVER (ORDER BY event_id) - 1 AS position FROM events),
     arrived AS (SELECT event_id, event_type, value, row_number() OVER (
       ORDER BY CASE WHEN event_id // 2 % 10 = 0 THEN xor(event_id, 1) ELSE event_id END) - 1 AS position FROM events)
SELECT position, s.event_id AS expected_id, a.event_id AS actual_id
FROM sent s JOIN arrived a USING (position) WHERE s.event_id <> a.event_id"""
ORACLES["backfill_report_as_of"] = """
SELECT user_id, count(*) AS event_count, CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS month,
  CAST(day(t) AS INTEGER) AS day
FROM events JOIN (SELECT unnest(generate_series(TIMESTAMP '2024-01-03', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS t) ON ts < t
GROUP BY user_id, t"""
_SORTED_OUT = f"""
SELECT 'clicks' AS output, event_id, user_id, {DAY} FROM events WHERE event_type = 'click'
UNION ALL SELECT 'dear', event_id, user_id, {DAY} FROM events WHERE value > 50
UNION ALL SELECT 'users', event_id, user_id, {DAY} FROM events"""
ORACLES["several_outputs"] = ORACLES["stream_several_outputs"] = _SORTED_OUT
ORACLES["broken_run_healed"] = f"""
SELECT *, CAST(0 AS BIGINT) AS marks_of_broken_run, (SELECT 3 * count(DISTINCT CAST(ts AS DATE)) FROM events) AS marks
FROM ({_SORTED_OUT})"""
ORACLES["required_fields"] = """
SELECT event_id, user_id, 'who.user_id is NULL' AS refused FROM events WHERE event_type <> 'error'"""

ORACLES["due_in_waves"] = """
WITH grid AS (
  SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-19 23:30:00', INTERVAL 30 MINUTE)) AS t),
marks AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS t FROM events),
a AS (
  SELECT t, CASE WHEN t IN (SELECT t FROM marks WHERE event_type = 'error') THEN 0 ELSE 1 END AS wave FROM grid
  WHERE minute(t) = 0 AND (t IN (SELECT t FROM marks WHERE event_type = 'error')
    OR t IN (SELECT t FROM marks WHERE event_type = 'click'))),
known_a AS (SELECT t, wave FROM a UNION SELECT t, 0 FROM marks WHERE event_type = 'error'),
b AS (
  SELECT g.t, min(k.wave) + 1 AS wave FROM grid g JOIN known_a k ON k.t = g.t - INTERVAL 30 MINUTE
  WHERE minute(g.t) = 30 AND hour(g.t) IN (0, 6, 12, 18) GROUP BY g.t),
c AS (
  SELECT g.t, b.wave + 1 AS wave FROM grid g JOIN b ON b.t = g.t - INTERVAL 330 MINUTE
  WHERE hour(g.t) = 0 AND minute(g.t) = 0 AND g.t IN (SELECT t FROM marks WHERE event_type = 'click'))
SELECT 'hourly' AS job, CAST(wave AS INTEGER) AS wave, t AS nominal_time FROM a WHERE wave = 1
UNION ALL SELECT 'sixth', CAST(wave AS INTEGER), t FROM b
UNION ALL SELECT 'daily', CAST(wave AS INTEGER), t FROM c"""
