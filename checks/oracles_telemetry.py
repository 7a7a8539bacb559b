"""Expected results over stored telemetry."""

from __future__ import annotations

from checks.oracles import EVENTS, FEATURES, SQL, q
from wellspring.constants import (
    AVERAGED_SENSORS,
    CORRELATED_SENSORS,
    DISPLAY_ENVELOPES,
    DISPLAY_SENSORS,
    EVENT_NAMES,
    FAULT_RULES,
    FEED_COLUMNS,
    FLEET_COLUMNS,
    NOMINAL_BOUNDS,
    PRIMARY_SENSORS,
    RULE_DEVICE_TYPES,
    STATISTICS,
    TRANSIENT_EVENTS,
)

RULE_FIELDS = {
    "spindle_temperature": "k + 3", "vibration": "k / 8", "tool_wear": "v", "hydraulic_pressure": "v",
    "oil_temperature": "k", "motor_temperature": "k + 1", "belt_alignment": "k / 15",
    "joint_vibration": "k / 9", "load": "k + 2", "cavitation": "k / 100", "pressure": "v",
    "discharge_pressure": "v * 2", "voltage_imbalance": "k / 12", "power_factor": "k / 100", "thd": "k / 10",
}
TELEMETRY = EVENTS + """,
tel AS (
  SELECT event_id AS id, device_id, ts AS "timestamp", v, k,
         ['CNC','PRESS','CONVEYOR','ROBOT','PUMP','COMPRESSOR','ENERGY_METER','oil_well'][user_id % 8 + 1] AS device_type,
         CASE event_type WHEN 'error' THEN 'Severe Slugging' WHEN 'purchase' THEN 'Flow Instability' END AS fault,
         v * 1e6::DOUBLE + 37000 AS "P-PDG",
         CASE WHEN k % 10 <> 0 THEN v * 2.5e5::DOUBLE + 1300 END AS "P-TPT",
         k * 5 - 60.03::DOUBLE AS "T-TPT",
         CASE WHEN k % 3 <> 0 THEN v * 3e5::DOUBLE + 700 END AS "P-MON-CKP",
         CASE WHEN k % 7 <> 0 THEN k + 0.02::DOUBLE END AS "T-JUS-CKP",
         v * 1e5::DOUBLE AS "P-JUS-CKGL", k * 0.9::DOUBLE AS "T-JUS-CKGL", v * 0.4::DOUBLE - 5 AS "QGL",
         CASE WHEN k % 5 <> 0 THEN v * 5e4::DOUBLE - 89987 END AS "P-ANULAR",
         k * 1.5::DOUBLE + 0.07::DOUBLE AS "T-PDG", k * 1.1::DOUBLE AS "ABER-CKP",
         """ + ", ".join(f"CASE WHEN k % 9 <> 0 THEN {f} END AS {n}" for n, f in RULE_FIELDS.items()) + """,
         CASE WHEN event_id % 10 = 0 AND event_type IN ('error', 'purchase') THEN k / 100 END AS stored_confidence,
         CASE WHEN event_id % 10 = 0 AND event_type = 'error' THEN 'Stored report for Severe Slugging'
              WHEN event_id % 10 = 0 AND event_type = 'purchase' THEN 'Stored report for Flow Instability' END AS stored_report
  FROM ev)"""
FACTOR = {s: f for s, _, _, f, _, _ in DISPLAY_ENVELOPES}
PAYLOAD = ["P-PDG", "P-TPT", "T-TPT", "P-MON-CKP", "T-JUS-CKP", "P-JUS-CKGL", "T-JUS-CKGL", "QGL", "P-ANULAR", "T-PDG", "ABER-CKP", *RULE_FIELDS]
FLAT = TELEMETRY + f""",
flat AS (
  SELECT id, device_id, device_type, "timestamp", fault, CASE WHEN fault IS NOT NULL THEN 'ANOMALY' ELSE 'NORMAL' END AS status,
         {', '.join(f'{q(s)} * {FACTOR.get(s, 1.0)}::DOUBLE AS {q(s)}' for s in DISPLAY_SENSORS)},
         stored_report AS diagnosis, stored_confidence
  FROM tel)"""
ROW = 'id, device_id, device_type, "timestamp", fault'
LATEST = 'ORDER BY "timestamp" DESC, id DESC'
WELL = "device_id = 'WELL-00001'"


def r(name: str, digits: int = 6, source: str | None = None) -> str:
    return f"round({source or q(name)}, {digits}) AS {q(name)}"


def names(table: dict[int, str]) -> str:
    return " ".join(f"WHEN {number} THEN '{name}'" for number, name in table.items())


SQL["flatten_telemetry"] = f"""WITH {FLAT} SELECT {ROW}, status, diagnosis,
  {', '.join(r(s) for s in DISPLAY_SENSORS)} FROM flat"""
SQL["status_filter_anomalies"] = f"WITH {FLAT} SELECT id, status, fault, {', '.join(r(s) for s in DISPLAY_SENSORS)} FROM flat WHERE fault IS NOT NULL"
SQL["status_filter_normal"] = f"WITH {FLAT} SELECT id, status, fault, {', '.join(r(s) for s in DISPLAY_SENSORS)} FROM flat WHERE fault IS NULL"
SQL["asset_search"] = f"WITH {TELEMETRY} SELECT {ROW} FROM tel WHERE regexp_matches(device_id, 'well-000[0-4]', 'i')"
NUMERIC_FEED = [c for c in FEED_COLUMNS if c in DISPLAY_SENSORS]
SQL["live_feed"] = f"""WITH {FLAT}, latest AS (SELECT * FROM flat {LATEST} LIMIT 500)
SELECT id, device_id, "timestamp", status, fault, {', '.join(f'round_even({q(c)}, 2) AS {q(c)}' for c in NUMERIC_FEED)}
FROM latest WHERE fault IS NOT NULL AND device_id ILIKE '%well%'"""
SQL["round_view"] = f"""WITH {FLAT} SELECT {ROW}, status,
  {', '.join(f'round_even({q(c)}, 2) AS {q(c)}' for c in DISPLAY_SENSORS)} FROM flat"""
SQL["incident_label"] = f"""WITH {TELEMETRY} SELECT id, 'ID #' || id || ' | ' ||
  strftime("timestamp", '%Y-%m-%d %H:%M:%S') || ' | ' || device_id || ' — ' || fault AS label
  FROM tel WHERE fault IS NOT NULL"""

PREDICTIONS = EVENTS + """,
pred0 AS (
  SELECT event_id, device_id AS well_id, ts, k, event_type,
         CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 5 ELSE 0 END AS multiclass,
         least(v / 125, 1.0::DOUBLE) AS score
  FROM ev),
pred AS (
  SELECT event_id, well_id, ts, multiclass, score, CAST(multiclass > 0 AS INTEGER) AS binary_target,
         CAST(event_type = 'signup' AS INTEGER) AS is_transient, CAST(score >= 0.1 AS INTEGER) AS binary_pred,
         CASE WHEN k % 4 < 2 THEN multiclass ELSE CAST(k % 10 AS INTEGER) END AS multi_pred,
         round_even(k / 100, 2) AS multi_confidence
  FROM pred0)"""
ALL_NAMES = EVENT_NAMES | {100 + n: f"Transient - {EVENT_NAMES[n]}" for n in TRANSIENT_EVENTS}
SQL["event_names"] = f"""WITH {PREDICTIONS} SELECT event_id,
  CASE multi_pred * 3 {names(EVENT_NAMES)} ELSE 'Event ' || (multi_pred * 3) END AS event_name,
  CASE (CASE WHEN is_transient = 1 THEN multiclass + 100 ELSE multi_pred * 3 END) {names(ALL_NAMES)}
    ELSE 'Unknown' END AS description
  FROM pred"""


def snapshot(feature: str) -> str:
    sensor, statistic = feature.rsplit("_", 1)
    if sensor in ("ABER-CKGL", "T-MON-CKP", "P-JUS-CKP"):
        return f"CAST(NULL AS DOUBLE) AS {q(feature)}"
    if statistic in ("std", "range", "trend"):
        return f"CASE WHEN {q(sensor)} IS NOT NULL THEN 0::DOUBLE END AS {q(feature)}"
    return f"round({q(sensor)}, 6) AS {q(feature)}"


SQL["snapshot_features"] = f"WITH {TELEMETRY} SELECT id, {', '.join(snapshot(f) for f in FEATURES)} FROM tel"
SQL["coerce_numbers"] = f"""WITH {TELEMETRY} SELECT id, {r('from_text', 6, q('T-JUS-CKP'))},
  {r('from_number', 6, q('P-TPT'))}, CAST(NULL AS DOUBLE) AS missing FROM tel"""
GIVEN = {"QGL_mean": "QGL", "P-PDG_max": "P-PDG", "T-TPT_trend": "T-TPT", "ABER-CKP_median": "ABER-CKP"}
SQL["reindex_features"] = f"""WITH {TELEMETRY} SELECT id, {', '.join(
    r(f, 6, q(GIVEN[f])) if f in GIVEN else f'CAST(NULL AS DOUBLE) AS {q(f)}'
    for f in (f'{s}_{t}' for t in STATISTICS for s in PRIMARY_SENSORS))} FROM tel"""

SQL["telemetry_stats"] = f"""WITH {TELEMETRY} SELECT count(*) AS total_records, count(fault) AS total_faults,
  count(DISTINCT device_id) AS total_wells, strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS first_timestamp,
  strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S.%f') AS last_timestamp, count(stored_report) AS total_diagnoses FROM tel"""
SQL["distinct_wells"] = f"WITH {TELEMETRY} SELECT DISTINCT device_id FROM tel"
SQL["fault_counts"] = f'WITH {TELEMETRY} SELECT fault, count(*) AS "rows" FROM tel WHERE fault IS NOT NULL GROUP BY fault'
SQL["asset_fault_counts"] = f'WITH {TELEMETRY} SELECT device_id, count(*) AS "rows" FROM tel WHERE fault IS NOT NULL GROUP BY device_id'


def kpis(limit: str) -> str:
    return f"""WITH {TELEMETRY}, f AS (SELECT * FROM tel WHERE fault IS NOT NULL {LATEST} {limit})
SELECT count(*) AS total_faults, count(DISTINCT fault) AS distinct_faults,
  (SELECT fault FROM f GROUP BY fault ORDER BY count(*) DESC, fault LIMIT 1) AS dominant_fault,
  count(DISTINCT device_id) AS affected_assets FROM f"""


SQL["fault_kpis"] = kpis("LIMIT 1000")
SQL["fault_kpis_all_rows"] = kpis("")
SQL["sensor_means"] = f"WITH {FLAT} SELECT {', '.join(r(s, 4, f'avg({q(s)})') for s in AVERAGED_SENSORS)} FROM flat"
KPI = 'count(*) AS total_records, count(fault) AS faults, round(count(fault) / count(*) * 100, 6) AS fault_rate_pct, max("timestamp") AS latest_timestamp'
SQL["well_kpis"] = f"WITH {TELEMETRY} SELECT device_id, {KPI} FROM tel GROUP BY device_id"
SQL["well_kpis_one_well"] = f"""WITH {TELEMETRY}, latest AS (SELECT * FROM tel WHERE {WELL} {LATEST} LIMIT 500)
  SELECT device_id, {KPI} FROM latest GROUP BY device_id"""
SQL["latest_per_well"] = f"""WITH {TELEMETRY} SELECT {ROW} FROM tel
  QUALIFY row_number() OVER (PARTITION BY device_id {LATEST}) = 1"""


def correlation(sensors: list[str], by: str = "") -> str:
    cells = " UNION ALL ".join(
        f"SELECT {by} '{a}' AS sensor_a, '{b}' AS sensor_b, round(corr({q(a)}, {q(b)}), 4) AS correlation FROM flat "
        + (f"GROUP BY {by.rstrip(', ')}" if by else "")
        for a in sensors for b in sensors
    )
    return f"WITH {FLAT} {cells}"


SQL["sensor_correlation"] = correlation(CORRELATED_SENSORS)
SQL["sensor_correlation_by_type"] = correlation(CORRELATED_SENSORS, "device_type, ")
SQL["recent_rows"] = f"WITH {TELEMETRY} SELECT {ROW} FROM tel {LATEST} LIMIT 500"
SQL["recent_incidents"] = f"WITH {TELEMETRY} SELECT {ROW} FROM tel WHERE fault IS NOT NULL {LATEST} LIMIT 50"
SQL["recent_incidents_one_well"] = f"WITH {TELEMETRY} SELECT {ROW} FROM tel WHERE fault IS NOT NULL AND {WELL} {LATEST} LIMIT 50"
SQL["latest_anomaly"] = f"""WITH {TELEMETRY} SELECT {ROW} FROM tel ORDER BY
  CASE WHEN fault IS NOT NULL AND device_id LIKE 'WELL%' THEN 0 WHEN fault IS NOT NULL THEN 1 ELSE 2 END,
  "timestamp" DESC, id DESC LIMIT 1"""
SQL["latest_anomaly_one_well"] = f"WITH {TELEMETRY} SELECT {ROW} FROM tel WHERE fault IS NOT NULL AND {WELL} {LATEST} LIMIT 1"
SQL["latest_by_id"] = f"WITH {TELEMETRY} SELECT device_type, {', '.join(r(s) for s in PAYLOAD)} FROM tel ORDER BY id DESC LIMIT 1"
SQL["fleet_status"] = f"""WITH {FLAT} SELECT {', '.join(r(c) if c in DISPLAY_SENSORS else q(c) for c in FLEET_COLUMNS)}
  FROM flat {LATEST} LIMIT 15"""
SQL["surrounding_series"] = f"WITH {TELEMETRY} SELECT {ROW} FROM tel WHERE {WELL} {LATEST} LIMIT 250"
SQL["fault_timeline"] = f"""WITH {FLAT} SELECT id, device_id, "timestamp", fault, {r('P-TPT')}, {r('T-TPT')}, {r('P-MON-CKP')}
  FROM flat WHERE fault IS NOT NULL"""
SQL["incident_by_id"] = f"WITH {TELEMETRY} SELECT {ROW}, stored_report AS raw_diagnosis FROM tel WHERE id = 50"
SQL["sensor_snapshot"] = f"WITH {FLAT} " + " UNION ALL ".join(
    f"SELECT id, '{s}' AS sensor, round({q(s)}, 6) AS value, '{unit}' AS unit, '{region}' AS region FROM flat WHERE {q(s)} IS NOT NULL"
    for s, unit, region, _, _, _ in DISPLAY_ENVELOPES)


def fired(kinds: list[str]) -> str:
    checks = ", ".join(
        f"CASE WHEN device_type = '{kind}' AND coalesce({field}, {default}) {op} {threshold} THEN '{fault}' END"
        for kind, field, op, threshold, default, fault in FAULT_RULES if kind in kinds)
    return f"list_filter([{checks}], lambda x: x IS NOT NULL)"


SQL["detect_faults"] = f"""WITH {TELEMETRY}, f AS (SELECT id, device_type, {fired(RULE_DEVICE_TYPES)} AS d FROM tel)
  SELECT id, device_type, CAST(len(d) AS INTEGER) AS n_faults, coalesce(array_to_string(d, ', '), '') AS faults FROM f"""
for _type in RULE_DEVICE_TYPES:
    SQL[f"rules_{_type.lower()}"] = f"""WITH {TELEMETRY} SELECT id,
      coalesce(array_to_string({fired([_type])}, ', '), '') AS faults FROM tel WHERE device_type = '{_type}'"""
SQL["fault_rule_totals"] = f"""WITH {TELEMETRY}, f AS (SELECT device_type, unnest({fired(RULE_DEVICE_TYPES)}) AS rule FROM tel)
  SELECT device_type, rule, count(*) AS "rows" FROM f GROUP BY ALL"""


def evidence_part(sensor: str, low: float, high: float, text: str) -> str:
    s, text = q(sensor), text.replace("'", "''")
    low_pct = f"({low} - {s}) / {low or 1.0} * 100"
    high_pct = f"({s} - {high}) / {high or 1.0} * 100"
    low_pct, high_pct = (x.replace(str(low), f"{low}::DOUBLE").replace(str(high), f"{high}::DOUBLE") for x in (low_pct, high_pct))
    below = f"{s} < {low}"
    return f"""SELECT id, '{sensor}' AS sensor, printf('%.2f', round_even({s}, 2)) AS observed_value,
  CASE WHEN {below} THEN '>= {low:.1f} (Nominal: {text})' ELSE '<= {high:.1f} (Nominal: {text})' END AS expected_behavior,
  CASE WHEN {below} THEN 'ABNORMALLY LOW' ELSE 'ABNORMALLY HIGH' END AS status,
  CASE WHEN {below} THEN 'Deficit of ' || printf('%.1f', round_even({low_pct}, 1)) || '% below minimum nominal threshold'
       ELSE 'Surge of ' || printf('%.1f', round_even({high_pct}, 1)) || '% above maximum nominal threshold' END AS significance,
  round({s}, 6) AS value, round(CASE WHEN {below} THEN {low_pct} ELSE {high_pct} END, 6) AS deviation_pct
  FROM tel WHERE {below} OR {s} > {high}"""


EVIDENCE = " UNION ALL ".join(evidence_part(*bound) for bound in NOMINAL_BOUNDS)
SQL["sensor_evidence"] = f"WITH {TELEMETRY} {EVIDENCE}"
SQL["bounds_check"] = f"WITH {TELEMETRY} " + " UNION ALL ".join(
    f"SELECT id, '{s}' AS sensor, round({q(s)}, 6) AS value, CASE WHEN {q(s)} < {low} THEN 'LOW' WHEN {q(s)} > {high} THEN 'HIGH' ELSE 'NORMAL' END AS position FROM tel WHERE {q(s)} IS NOT NULL"
    for s, low, high, _ in NOMINAL_BOUNDS)
DEVIATION = " UNION ALL ".join(
    f"""SELECT id, {i} AS n, '{s}' AS sensor, '{region}' AS region, '{low:.1f} – {high:.1f} {unit}' AS envelope, {q(s)} AS value,
  CASE WHEN {q(s)} < {low} THEN 'ABNORMAL (LOW)' WHEN {q(s)} > {high} THEN 'ABNORMAL (HIGH)' ELSE 'NORMAL' END AS status
  FROM flat WHERE {q(s)} IS NOT NULL"""
    for i, (s, unit, region, _, low, high) in enumerate(DISPLAY_ENVELOPES))
SQL["envelope_deviation"] = f"""WITH {FLAT}, d AS ({DEVIATION})
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY status = 'NORMAL', n) - 1 AS INTEGER) AS place,
  sensor, region, status, envelope, round(value, 6) AS value FROM d"""
LOCATED = f"""{FLAT}, d AS ({DEVIATION}),
regions AS (SELECT id, region, min(n) AS n FROM d WHERE status <> 'NORMAL' GROUP BY id, region),
located AS (
  SELECT f.id, coalesce((SELECT string_agg(region, ', ' ORDER BY n) FROM regions r WHERE r.id = f.id),
      'All monitored sensor regions within nominal envelopes (Multivariate statistical drift)') AS location,
    coalesce((SELECT string_agg(sensor, ', ' ORDER BY n) FROM d WHERE d.id = f.id AND status <> 'NORMAL'), '') AS sensors,
    round(coalesce(stored_confidence, 0.65) * 100, 6) AS confidence_pct
  FROM flat f WHERE fault IS NOT NULL)"""
SQL["localize_faults"] = f"WITH {LOCATED} SELECT * FROM located"

DECISIONS = PREDICTIONS + f""",
fused AS (
  SELECT event_id AS id, well_id, binary_pred, multi_pred,
         CASE WHEN binary_pred = 1 THEN score ELSE 1 - score END AS bc, multi_confidence AS mc FROM pred),
decided AS (
  SELECT id, well_id, CASE WHEN binary_pred = 1 OR multi_pred > 0 THEN 'anomaly' ELSE 'normal' END AS status,
    multi_pred AS predicted_event_id,
    CASE WHEN binary_pred = 1 OR multi_pred > 0 THEN CASE multi_pred {names(EVENT_NAMES)} END ELSE 'Normal Operation' END AS predicted_event,
    round_even(CASE WHEN multi_pred > 0 THEN greatest(bc, mc) ELSE bc END, 4) AS confidence,
    CASE WHEN binary_pred = 1 THEN 'FAULT' ELSE 'NORMAL' END AS binary_status,
    round_even(bc, 4) AS binary_confidence, round_even(mc, 4) AS multiclass_confidence
  FROM fused)"""
SQL["fuse_decision"] = f"WITH {DECISIONS} SELECT * FROM decided"
SQL["alert_flags"] = f"""WITH {DECISIONS} SELECT id, TRUE AS acknowledged, well_id, status = 'anomaly' AS alert, status, predicted_event AS event,
  round(confidence, 6) AS confidence FROM decided"""
SQL["incident_surroundings"] = f"""WITH {FLAT}
SELECT i.id AS incident_id, f.id, f.device_id, round(date_diff('microsecond', i."timestamp", f."timestamp") / 1e6, 6) AS offset_seconds,
  {', '.join(f'round(f.{q(s)}, 6) AS {q(s)}' for s in ('P-TPT', 'T-TPT', 'P-MON-CKP'))}
FROM flat i JOIN flat f ON f.device_id = i.device_id AND f."timestamp" BETWEEN i."timestamp" - INTERVAL 6 HOUR AND i."timestamp" + INTERVAL 6 HOUR
WHERE i.fault IS NOT NULL"""
