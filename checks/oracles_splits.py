"""Expected results over splits, imputation, metrics, recordings and messages."""

from __future__ import annotations

from checks.oracles import CLEAN, EVENTS, FEATURES, KEEP, RECORDINGS, SQL, bounded, filled, q, statistics, windows
from checks.oracles_telemetry import ALL_NAMES, PREDICTIONS, TELEMETRY, names
from wellspring.constants import PRIMARY_SENSORS, STATISTICS
from wellspring.plans.split_queries import EVEN_SENSORS, ODD_SENSORS

WINDOWS = windows(3)
LABELS = "instance_file, well_id, event_folder, window_start, raw_class, is_transient, multiclass, binary_target"
SPLIT = """,
inst AS (SELECT instance_file, min(event_folder) AS event_folder, min(well_id) AS well_id FROM win GROUP BY 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_folder ORDER BY md5(instance_file || '42'), instance_file) AS r,
         count(*) OVER (PARTITION BY event_folder) AS n FROM inst),
split AS (SELECT instance_file, event_folder, well_id, CASE WHEN r <= round(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM ranked),
sw AS (SELECT win.*, split.split FROM win JOIN split USING (instance_file))"""
LABELLED = WINDOWS + SPLIT

SQL["class_distribution"] = f"""WITH {WINDOWS} SELECT multiclass, CASE multiclass {names(ALL_NAMES)} ELSE 'Unknown' END AS description,
  count(*) AS windows, round(count(*) / (SELECT count(*) FROM win) * 100, 6) AS percent FROM win GROUP BY multiclass"""
SQL["phase_breakdown"] = f"""WITH {WINDOWS} SELECT count(*) FILTER (binary_target = 0) AS normal,
  CAST(sum(is_transient) AS BIGINT) AS transient, CAST(count(*) FILTER (binary_target = 1) - sum(is_transient) AS BIGINT) AS established,
  round(sum(is_transient) / count(*) FILTER (binary_target = 1) * 100, 6) AS transient_share_pct FROM win"""
SQL["dedup_instances"] = f"WITH {LABELLED} SELECT * FROM inst"
SQL["stratified_instance_split"] = f"WITH {LABELLED} SELECT * FROM split"
SQL["group_split"] = f"""WITH {WINDOWS}, w AS (SELECT DISTINCT well_id FROM win),
r AS (SELECT well_id, row_number() OVER (ORDER BY md5(well_id || '42'), well_id) AS r, count(*) OVER () AS n FROM w)
SELECT well_id, CASE WHEN r <= ceil(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r"""
SQL["rows_of_instances"] = f"""WITH {LABELLED} SELECT {LABELS} FROM win
  WHERE instance_file IN (SELECT instance_file FROM split WHERE split = 'test')"""
SQL["split_audit"] = f"""WITH {LABELLED} SELECT split, count(DISTINCT instance_file) AS instances, count(*) AS windows,
  count(DISTINCT well_id) AS wells, round(count(*) / (SELECT count(*) FROM sw) * 100, 6) AS percent,
  (SELECT count(*) FROM (SELECT well_id FROM sw GROUP BY well_id HAVING count(DISTINCT split) > 1)) AS overlapping_wells
  FROM sw GROUP BY split"""
SQL["well_overlap"] = f"""WITH {LABELLED} SELECT DISTINCT well_id FROM sw WHERE split = 'train'
  INTERSECT SELECT DISTINCT well_id FROM sw WHERE split = 'test'"""
SQL["present_classes"] = f"WITH {LABELLED} SELECT DISTINCT multiclass FROM sw"
SQL["class_support"] = f"WITH {LABELLED} SELECT split, binary_target, count(*) AS windows FROM sw GROUP BY ALL"
SQL["class_weights"] = f"""WITH {WINDOWS}, c AS (SELECT multiclass, count(*) AS n FROM win GROUP BY multiclass)
  SELECT multiclass, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c"""
UNROUNDED = windows(3, digits=12) + SPLIT
SQL["imputer_medians"] = f"WITH {UNROUNDED}, m AS (SELECT {', '.join(f'median({q(f)}) AS {q(f)}' for f in FEATURES)} FROM sw WHERE split = 'train') " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round({q(f)}, 4) AS median FROM m" for f in FEATURES)
SQL["impute_features"] = f"""WITH {UNROUNDED},
m AS (SELECT {', '.join(f'median({q(f)}) AS {q(f)}' for f in FEATURES)} FROM sw WHERE split = 'train')
SELECT sw.instance_file, sw.window_start, sw.split,
  {', '.join(f'round(coalesce(sw.{q(f)}, m.{q(f)}, 0), 4) AS {q(f)}' for f in FEATURES)} FROM sw CROSS JOIN m"""
SQL["features_float32"] = f"""WITH {UNROUNDED} SELECT instance_file, window_start,
  {', '.join(f'CAST({q(f)} AS FLOAT) AS {q(f)}' for f in FEATURES)} FROM win"""
SQL["clip_features_query"] = f"""WITH {RECORDINGS}, s AS (SELECT event_id, {', '.join(f'{q(s)} * {40 if i % 2 else -30} AS {q(s)}' for i, s in enumerate(PRIMARY_SENSORS))} FROM rec)
  SELECT event_id, {', '.join(bounded(s) for s in PRIMARY_SENSORS)} FROM s"""
SQL["feature_manifest"] = f"WITH {WINDOWS} " + " UNION ALL ".join(
    f"SELECT {i} AS position, '{f}' AS feature, count({q(f)}) AS known FROM win" for i, f in enumerate(FEATURES))
SQL["feature_sample"] = f"""WITH {WINDOWS} SELECT instance_file, window_start, raw_class, {', '.join(q(f) for f in FEATURES)}
  FROM win ORDER BY instance_file, window_start LIMIT 500"""
SLIDE_SENSORS = PRIMARY_SENSORS
SLIDE_FEATURES = [f"{s}_{t}" for t in STATISTICS for s in SLIDE_SENSORS]
SQL["sliding_windows"] = f"""WITH {filled(3)},
spread AS (SELECT *, time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours' * i AS window_start
           FROM filled CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i)),
a AS (SELECT instance_file, well_id, event_folder, window_start, CAST(max(class) AS INTEGER) AS raw_class,
      {', '.join(statistics(s) for s in SLIDE_SENSORS)} FROM spread GROUP BY ALL)
SELECT instance_file, well_id, event_folder, window_start, raw_class, CAST(raw_class >= 100 AS INTEGER) AS is_transient,
  CAST(CASE WHEN raw_class >= 100 THEN raw_class - 100 ELSE raw_class END AS INTEGER) AS multiclass,
  CAST(raw_class > 0 AS INTEGER) AS binary_target, {', '.join(bounded(f) for f in SLIDE_FEATURES)}
FROM a WHERE raw_class IS NOT NULL AND coalesce({', '.join(q(s + '_mean') for s in SLIDE_SENSORS)}) IS NOT NULL"""
SQL["ffill_by_time"] = f"""WITH {CLEAN} SELECT event_id, {', '.join(
    f'last_value({q(s)} IGNORE NULLS) OVER (PARTITION BY instance_file ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS {q(s)}'
    for s in PRIMARY_SENSORS)} FROM clean"""


def matrix(label: str, prediction: str) -> str:
    return f"""c AS (SELECT {label} AS c FROM pred UNION SELECT {prediction} FROM pred),
m AS (SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM pred WHERE {label} = a.c AND {prediction} = b.c) AS n
      FROM c a CROSS JOIN c b)"""


def report(label: str, prediction: str) -> str:
    return f"""WITH {PREDICTIONS}, {matrix(label, prediction)},
per AS (SELECT CAST(label AS VARCHAR) AS name, CAST(sum(n) AS BIGINT) AS support, sum(n) FILTER (label = prediction) AS hits,
        (SELECT sum(n) FROM m x WHERE x.prediction = m.label) AS predicted FROM m GROUP BY label),
s AS (SELECT name, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
      coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1, support, hits FROM per),
lines AS (
  SELECT name, precision, recall, f1, support FROM s
  UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), CAST(sum(support) AS BIGINT) FROM s
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM s
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM s)
SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM lines"""


SQL["confusion_matrix_binary"] = f"WITH {PREDICTIONS}, {matrix('binary_target', 'binary_pred')} SELECT * FROM m"
SQL["confusion_matrix_multiclass"] = f"WITH {PREDICTIONS}, {matrix('multiclass', 'multi_pred')} SELECT * FROM m"
SQL["classification_report"] = report("multiclass", "multi_pred")
SQL["classification_report_binary"] = report("binary_target", "binary_pred")
SQL["roc_auc"] = f"""WITH {PREDICTIONS},
r AS (SELECT binary_target AS y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM pred),
t AS (SELECT sum(r) FILTER (y = 1) AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM r)
SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM t"""


def phases(label: str, prediction: str) -> str:
    parts = []
    for name, flag in (("transient", 1), ("established", 0)):
        inside = f"{label} > 0 AND is_transient = {flag}"
        parts.append(f"""round(count(*) FILTER ({inside} AND {label} = {prediction}) / count(*) FILTER ({inside}), 6) AS {name}_score,
          count(*) FILTER ({inside}) AS {name}_support""")
    return f"WITH {PREDICTIONS} SELECT {', '.join(parts)} FROM pred"


SQL["phase_metrics_binary"] = phases("binary_target", "binary_pred")
SQL["phase_metrics_multiclass"] = phases("multiclass", "multi_pred")
SQL["recording_keys"] = f"WITH {RECORDINGS} SELECT event_id, instance_file, well_id, event_folder FROM rec"
SQL["label_fallback"] = f"""WITH {RECORDINGS}, o AS (
  SELECT event_id, class, CASE WHEN event_folder = '7' THEN 'x' ELSE event_folder END AS event_folder FROM rec)
SELECT event_id, event_folder, CAST(CASE WHEN event_id % 3 = 0 THEN class
  ELSE coalesce(TRY_CAST(event_folder AS INTEGER), 0) END AS INTEGER) AS class FROM o"""
SQL["timestamp_parsing"] = "SELECT event_id, ts FROM events"
SQL["first_recording_per_event"] = f"WITH {RECORDINGS} SELECT event_folder, min(instance_file) AS instance_file FROM rec GROUP BY 1"
SQL["concat_recordings"] = f"""WITH {RECORDINGS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN class END AS class,
  CASE WHEN event_id % 2 = 1 THEN ts END AS ts,
  {', '.join(f"CASE WHEN {'true' if s in EVEN_SENSORS and s in ODD_SENSORS else 'event_id % 2 = 0' if s in EVEN_SENSORS else 'event_id % 2 = 1'} THEN {q(s)} END AS {q(s)}"
    for s in dict.fromkeys(EVEN_SENSORS + ODD_SENSORS))} FROM rec"""
SQL["recording_to_messages"] = f"""WITH {RECORDINGS}, n AS (
  SELECT *, row_number() OVER (PARTITION BY instance_file ORDER BY ts, event_id) AS r FROM rec)
SELECT 'factory/oil_well/' || well_id || '/telemetry' AS topic, instance_file, CAST(r AS INTEGER) AS record, well_id AS device_id,
  CAST(class AS VARCHAR) AS label, instance_file AS recording_file,
  {', '.join(f'round({q(s)}, 4) AS {q(s)}' for s in PRIMARY_SENSORS)} FROM n WHERE r <= 5"""
SQL["topic_filter"] = f"WITH {TELEMETRY} SELECT id, lower(device_type) AS topic_type, device_id AS topic_device FROM tel WHERE id % 11 <> 0"
DECODED = TELEMETRY + """,
dec AS (SELECT id, id % 13 = 0 AS broken, id % 17 = 0 AS nameless, device_id, device_type, "timestamp", fault FROM tel),
judged AS (SELECT id, CASE WHEN broken OR nameless THEN 'LIVE-DEVICE' ELSE device_id END AS device_id,
  CASE WHEN NOT broken THEN device_type END AS device_type, CASE WHEN NOT broken THEN "timestamp" END AS "timestamp",
  CASE WHEN NOT broken THEN fault END AS fault,
  CASE WHEN broken THEN 'invalid json' WHEN nameless THEN 'missing device_id' END AS reject FROM dec)"""
SQL["decode_messages"] = f"WITH {DECODED} SELECT * FROM judged"
SQL["dead_letters"] = f"""WITH {DECODED} SELECT id, device_id, reject FROM judged WHERE reject IS NOT NULL AND id % 11 <> 0"""
