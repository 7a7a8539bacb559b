"""Expected results of the streaming jobs: the same computation over the whole table."""

from __future__ import annotations

from checks.oracles import SQL, q, statistics
from checks.oracles_telemetry import EVIDENCE, PAYLOAD, TELEMETRY, fired, r
from wellspring.constants import PRIMARY_SENSORS, RULE_DEVICE_TYPES, STATISTICS

SQL["stream_store"] = f"""WITH {TELEMETRY},
m AS (SELECT *, id % 13 = 0 AS broken, id % 13 <> 0 AND "T-TPT" < 50 AS cold FROM tel WHERE id % 11 <> 0)
SELECT id, device_id, device_type, "timestamp", CASE WHEN cold THEN 'Hydrate in Production Line' ELSE fault END AS fault,
  CASE WHEN cold THEN 'anomaly' ELSE 'normal' END AS status, {', '.join(r(s) for s in PAYLOAD)} FROM m WHERE NOT broken"""
SQL["stream_dead_letters"] = f"""WITH {TELEMETRY} SELECT id, 'LIVE-DEVICE' AS device_id, 'invalid json' AS reject
  FROM tel WHERE id % 11 <> 0 AND id % 13 = 0"""
SQL["stream_alerts"] = f"""WITH {TELEMETRY}, e AS ({EVIDENCE.replace("SELECT id,", "SELECT id, 0 AS n,")}),
r AS (SELECT id, device_id, {fired(RULE_DEVICE_TYPES)} AS d FROM tel),
s AS (SELECT id, string_agg(sensor, ', ' ORDER BY list_position(['P-PDG','P-TPT','T-TPT','P-MON-CKP','T-JUS-CKP','P-ANULAR','T-PDG','QGL','ABER-CKP'], sensor)) AS sensors
      FROM e GROUP BY id)
SELECT id, device_id, coalesce(array_to_string(d, ', '), '') AS rules, coalesce(sensors, '') AS sensors,
  len(d) > 0 OR sensors IS NOT NULL AS alert FROM r LEFT JOIN s USING (id)"""
SQL["stream_stats"] = f"""WITH {TELEMETRY} SELECT device_id, count(*) AS total_records, count(fault) AS total_faults,
  max("timestamp") AS last_timestamp FROM tel GROUP BY device_id"""

RANGES = {"T-": ("-50", "400"), "P-": ("-1e4", "2e8"), "AB": ("0", "100"), "QG": ("0", "1e4")}


def physical(s: str) -> str:
    low, high = RANGES[s[:2]]
    source = q(s) if s in PAYLOAD else "CAST(NULL AS DOUBLE)"
    return f"CASE WHEN {source} BETWEEN {low} AND {high} THEN {source} END AS {q(s)}"


CARRIED = ", ".join(
    f"last_value({q(s)} IGNORE NULLS) OVER (PARTITION BY device_id, window_start ORDER BY ts, event_id "
    f"ROWS BETWEEN 60 PRECEDING AND CURRENT ROW) AS {q(s)}" for s in PRIMARY_SENSORS)
SHOWN = ", ".join(
    f"CASE WHEN {q(s + '_mean')} IS NOT NULL THEN round({q(f'{s}_{t}')}, 4) END AS {q(f'{s}_{t}')}"
    for t in STATISTICS for s in PRIMARY_SENSORS)
DAILY = f"""WITH {TELEMETRY},
c AS (SELECT device_id, "timestamp" AS ts, id AS event_id, time_bucket(INTERVAL '1 day', "timestamp") AS window_start,
      {', '.join(physical(s) for s in PRIMARY_SENSORS)} FROM tel),
f AS (SELECT device_id, window_start, ts, event_id, {CARRIED} FROM c),
a AS (SELECT device_id, window_start, count(*) AS readings, {', '.join(statistics(s) for s in PRIMARY_SENSORS)} FROM f GROUP BY ALL)
SELECT device_id, window_start, readings, {SHOWN} FROM a"""
SQL["stream_windows"] = DAILY
SQL["window_features_online_daily"] = DAILY
SQL["stream_fleet_stats"] = f"""WITH {TELEMETRY} SELECT count(*) AS total_records, count(fault) AS total_faults, count(DISTINCT device_id) AS total_wells,
  strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS first_timestamp, strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS last_timestamp,
  count(stored_report) AS total_diagnoses FROM tel"""
SQL["stream_fault_counts"] = f'WITH {TELEMETRY} SELECT fault, count(*) AS "rows" FROM tel WHERE fault IS NOT NULL GROUP BY fault'
SQL["stream_device_fault_counts"] = f'WITH {TELEMETRY} SELECT device_id, count(*) AS "rows" FROM tel WHERE fault IS NOT NULL GROUP BY device_id'
THROTTLE = f"""WITH RECURSIVE {TELEMETRY},
a AS MATERIALIZED (SELECT device_id, id, "timestamp" AS ts, fault AS event,
  row_number() OVER (PARTITION BY device_id ORDER BY "timestamp", id) AS n FROM tel WHERE fault IS NOT NULL),
walk AS (
  SELECT device_id, id, n, event, TRUE AS fired, event AS last_event, ts AS last_ts FROM a WHERE n = 1
  UNION ALL
  SELECT a.device_id, a.id, a.n, a.event,
    a.event <> w.last_event OR a.ts >= w.last_ts + INTERVAL 1 DAY,
    CASE WHEN a.event <> w.last_event OR a.ts >= w.last_ts + INTERVAL 1 DAY THEN a.event ELSE w.last_event END,
    CASE WHEN a.event <> w.last_event OR a.ts >= w.last_ts + INTERVAL 1 DAY THEN a.ts ELSE w.last_ts END
  FROM walk w JOIN a ON a.device_id = w.device_id AND a.n = w.n + 1)
SELECT device_id, id, event, fired FROM walk"""
SQL["throttle_diagnoses"] = THROTTLE
SQL["stream_throttle"] = THROTTLE
SERVED = """
m AS (SELECT id, device_id, device_type, "timestamp", fault AS told, "T-TPT" < 50 AS cold,
             round_even(least(1.0, abs("T-TPT" - 50) / 250), 4) AS confidence
      FROM tel WHERE id % 11 <> 0 AND id % 13 <> 0)"""
SQL["stream_answers"] = f"""WITH {TELEMETRY}, {SERVED}
SELECT id, TRUE AS acknowledged, device_id AS well_id, cold AS alert, CASE WHEN cold THEN 'anomaly' ELSE 'normal' END AS status,
       CASE WHEN cold THEN 'Hydrate in Production Line' ELSE 'Normal Operation' END AS event, confidence FROM m"""
SQL["stream_service"] = f"""WITH RECURSIVE {TELEMETRY}, {SERVED},
a AS MATERIALIZED (SELECT device_id, id, "timestamp" AS ts, row_number() OVER (PARTITION BY device_id ORDER BY "timestamp", id) AS n FROM m WHERE cold),
walk AS (
  SELECT device_id, id, n, TRUE AS fired, ts AS last_ts FROM a WHERE n = 1
  UNION ALL
  SELECT a.device_id, a.id, a.n, a.ts >= w.last_ts + INTERVAL 1 DAY, CASE WHEN a.ts >= w.last_ts + INTERVAL 1 DAY THEN a.ts ELSE w.last_ts END
  FROM walk w JOIN a ON a.device_id = w.device_id AND a.n = w.n + 1)
SELECT m.id, m.device_id, device_type, "timestamp", CASE WHEN cold THEN 'Hydrate in Production Line' ELSE told END AS fault,
       CASE WHEN cold THEN 'anomaly' ELSE 'normal' END AS status, CASE WHEN cold THEN 'Hydrate in Production Line' ELSE 'Normal Operation' END AS predicted_event,
       confidence, coalesce(fired, FALSE) AS fired, CASE WHEN fired THEN 'Check ' || m.device_id || ': Hydrate in Production Line' END AS diagnosis,
       CAST("timestamp" AS DATE) AS day
FROM m LEFT JOIN walk USING (id)"""
