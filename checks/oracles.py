"""Expected results as DuckDB SQL over the test tables."""

from __future__ import annotations

from wellspring.constants import PRIMARY_SENSORS, STATISTICS

SQL: dict[str, str] = {}


def q(name: str) -> str:
    return f'"{name}"'


EVENTS = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value AS v,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         (CASE WHEN user_id % 3 < 2 THEN 'WELL-' ELSE 'PUMP-' END)
           || lpad(CAST(user_id AS VARCHAR), 5, '0') AS device_id
  FROM events)"""

RECORDINGS = EVENTS + """,
rec AS (
  SELECT device_id || '_' || CAST((dayofmonth(ts) - 1) // 10 AS VARCHAR) || '.parquet' AS instance_file,
         device_id AS well_id, CAST(user_id % 10 AS VARCHAR) AS event_folder, ts, event_id,
         CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 3 WHEN 'signup' THEN 105 WHEN 'purchase' THEN 4 END AS class,
         v * 1e6::DOUBLE AS "P-PDG",
         CASE WHEN k % 10 = 0 THEN -1e38::DOUBLE ELSE v * 2.5e5::DOUBLE END AS "P-TPT",
         k * 5 - 60 AS "T-TPT",
         CASE WHEN k % 3 <> 0 THEN v * 1e5::DOUBLE END AS "P-MON-CKP",
         k AS "T-JUS-CKP",
         CASE WHEN user_id % 5 <> 0 THEN v * 1e4::DOUBLE - 9000 END AS "P-ANULAR",
         k * 0.5::DOUBLE + 20 AS "T-PDG",
         CASE WHEN k % 4 = 3 THEN v * 2e4::DOUBLE END AS "P-JUS-CKGL",
         v * 30 AS "QGL",
         k * 1.2::DOUBLE - 5 AS "ABER-CKP",
         k AS "ABER-CKGL",
         CASE WHEN event_id % 5 = 0 THEN k * 3 END AS "T-MON-CKP",
         CAST(NULL AS DOUBLE) AS "P-JUS-CKP"
  FROM ev)"""


def physical(sensor: str) -> str:
    if sensor.startswith(("P-", "PT-")):
        low, high = "-1e4", "2e8"
    elif sensor.startswith("T-"):
        low, high = "-50", "400"
    elif sensor.startswith("ABER-"):
        low, high = "0", "100"
    else:
        low, high = "0", "1e4"
    return f"CASE WHEN {q(sensor)} BETWEEN {low} AND {high} THEN {q(sensor)} END AS {q(sensor)}"


KEEP = "instance_file, well_id, event_folder, ts, event_id, class"
CLEAN = RECORDINGS + f""",
clean AS (SELECT {KEEP}, {', '.join(physical(s) for s in PRIMARY_SENSORS)} FROM rec)"""


def filled(limit: int) -> str:
    columns = ", ".join(
        f"last_value({q(s)} IGNORE NULLS) OVER (PARTITION BY instance_file ORDER BY ts, event_id "
        f"ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW) AS {q(s)}"
        for s in PRIMARY_SENSORS
    )
    return CLEAN + f",\nfilled AS (SELECT {KEEP}, {columns} FROM clean)"


def statistics(sensor: str) -> str:
    s = q(sensor)
    return ", ".join([
        f"avg({s}) AS {q(sensor + '_mean')}",
        f"coalesce(stddev_samp({s}), 0) AS {q(sensor + '_std')}",
        f"min({s}) AS {q(sensor + '_min')}",
        f"max({s}) AS {q(sensor + '_max')}",
        f"median({s}) AS {q(sensor + '_median')}",
        f"max({s}) - min({s}) AS {q(sensor + '_range')}",
        f"coalesce(last({s} ORDER BY ts, event_id) FILTER ({s} IS NOT NULL)"
        f" - first({s} ORDER BY ts, event_id) FILTER ({s} IS NOT NULL), 0) AS {q(sensor + '_trend')}",
    ])


def bounded(name: str, digits: int = 4) -> str:
    return (f"CASE WHEN {q(name)} IS NOT NULL THEN round(least(greatest({q(name)}, -1e9), 1e9), {digits}) END"
            f" AS {q(name)}")


FEATURES = [f"{s}_{t}" for t in STATISTICS for s in PRIMARY_SENSORS]


def windows(limit: int, seconds: int = 86400, digits: int = 4) -> str:
    return filled(limit) + f""",
aggregated AS (
  SELECT instance_file, well_id, event_folder,
         time_bucket(INTERVAL '{seconds} seconds', ts) AS window_start,
         CAST(max(class) AS INTEGER) AS raw_class, {', '.join(statistics(s) for s in PRIMARY_SENSORS)}
  FROM filled GROUP BY ALL),
win AS (
  SELECT instance_file, well_id, event_folder, window_start, raw_class,
         CAST(raw_class >= 100 AS INTEGER) AS is_transient,
         CAST(CASE WHEN raw_class >= 100 THEN raw_class - 100 ELSE raw_class END AS INTEGER) AS multiclass,
         CAST(raw_class > 0 AS INTEGER) AS binary_target,
         {', '.join(bounded(f, digits) for f in FEATURES)}
  FROM aggregated
  WHERE raw_class IS NOT NULL AND coalesce({', '.join(q(s + '_mean') for s in PRIMARY_SENSORS)}) IS NOT NULL)"""


SQL["feature_windows"] = f"WITH {windows(3)} SELECT * FROM win"
SQL["feature_windows_6h"] = f"WITH {windows(60, 21600)} SELECT * FROM win"
SQL["sanitize_readings"] = f"WITH {CLEAN} SELECT * FROM clean"
SQL["causal_forward_fill"] = f"WITH {filled(2)} SELECT * FROM filled"
