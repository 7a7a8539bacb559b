"""Queries over stored telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.constants import (
    DISPLAY_SENSORS,
    NOMINAL_BOUNDS,
    PRIMARY_SENSORS,
    RULE_DEVICE_TYPES,
)
from wellspring.functions.values import col
from wellspring.operators import evidence, reports, rules
from wellspring.operators import telemetry as views
from wellspring.operators.cleaning import DAY
from wellspring.operators.windows import feature_names, window_features_online
from wellspring.plans.registry import QUERIES, query, rounded
from wellspring.sources.testtables import predictions, sensor_payload, telemetry

ROW = ["id", "device_id", "device_type", "timestamp", "fault"]
WELL = "WELL-00001"


def flat(spark, sf_dir, *sensors):
    return views.flatten_telemetry(telemetry(spark, sf_dir), sensors or DISPLAY_SENSORS)


def parsed(spark, sf_dir):
    return views.parse_payload(telemetry(spark, sf_dir))


@query
def flatten_telemetry(spark, sf_dir):
    view = flat(spark, sf_dir).withColumn("diagnosis", F.get_json_object("diagnosis", "$.raw_diagnosis"))
    return rounded(view, 6)


@query
def status_filter_anomalies(spark, sf_dir):
    view = views.status_filter(flat(spark, sf_dir), "anomalies")
    return rounded(view.select("id", "status", "fault", *[col(s) for s in DISPLAY_SENSORS]), 6)


@query
def status_filter_normal(spark, sf_dir):
    view = views.status_filter(flat(spark, sf_dir), "normal")
    return rounded(view.select("id", "status", "fault", *[col(s) for s in DISPLAY_SENSORS]), 6)


@query
def asset_search(spark, sf_dir):
    return views.asset_search(telemetry(spark, sf_dir), "well-000[0-4]").select(ROW)


@query
def live_feed(spark, sf_dir):
    return views.live_feed(telemetry(spark, sf_dir), 500, None, "anomalies", "well")


@query
def round_view(spark, sf_dir):
    return views.round_view(flat(spark, sf_dir, *DISPLAY_SENSORS)).drop("diagnosis")


@query
def incident_label(spark, sf_dir):
    faults = telemetry(spark, sf_dir).filter(F.col("fault").isNotNull())
    return views.incident_label(faults).select("id", "label")


@query
def event_names(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    raw = F.when(F.col("is_transient") == 1, F.col("multiclass") + 100).otherwise(F.col("multi_pred") * 3)
    return rows.select(
        "event_id",
        views.event_name(F.col("multi_pred") * 3).alias("event_name"),
        views.class_description(raw).alias("description"),
    )


@query
def snapshot_features(spark, sf_dir):
    return rounded(views.snapshot_features(parsed(spark, sf_dir), keep=["id"]), 6)


@query
def coerce_numbers(spark, sf_dir):
    return rounded(
        parsed(spark, sf_dir).selectExpr(
            "id", f"{views.number_sql('T-JUS-CKP')} AS from_text", f"{views.number_sql('P-TPT')} AS from_number",
            f"{views.number_sql('no-such-sensor')} AS missing",
        ), 6)


@query
def reindex_features(spark, sf_dir):
    """Records that carry some of the features, none of them in order, and others that are not asked for."""
    given = {"QGL_mean": "QGL", "P-PDG_max": "P-PDG", "T-TPT_trend": "T-TPT", "ABER-CKP_median": "ABER-CKP", "thd_mean": "thd"}
    partial = parsed(spark, sf_dir).selectExpr("id", *[f"{views.number_sql(field)} AS `{name}`" for name, field in given.items()])
    return rounded(views.reindex(partial, feature_names(PRIMARY_SENSORS), keep=["id"]), 6)


@query
def telemetry_stats(spark, sf_dir):
    return reports.telemetry_stats(telemetry(spark, sf_dir))


@query
def distinct_wells(spark, sf_dir):
    return reports.distinct_wells(telemetry(spark, sf_dir))


@query
def fault_counts(spark, sf_dir):
    return reports.fault_counts(telemetry(spark, sf_dir))


@query
def asset_fault_counts(spark, sf_dir):
    return reports.asset_fault_counts(telemetry(spark, sf_dir))


@query
def fault_kpis(spark, sf_dir):
    return reports.fault_kpis(telemetry(spark, sf_dir))


@query
def fault_kpis_all_rows(spark, sf_dir):
    return reports.fault_kpis(telemetry(spark, sf_dir), limit=None)


@query
def sensor_means(spark, sf_dir):
    return rounded(views.sensor_means(flat(spark, sf_dir)), 4)


@query
def well_kpis(spark, sf_dir):
    return rounded(reports.well_kpis(telemetry(spark, sf_dir)), 6)


@query
def well_kpis_one_well(spark, sf_dir):
    return rounded(reports.well_kpis(telemetry(spark, sf_dir), WELL, 500), 6)


@query
def latest_per_well(spark, sf_dir):
    return reports.latest_per_well(telemetry(spark, sf_dir)).select(ROW)


@query
def sensor_correlation(spark, sf_dir):
    return rounded(reports.sensor_correlation(flat(spark, sf_dir)), 4)


@query
def sensor_correlation_by_type(spark, sf_dir):
    return rounded(reports.sensor_correlation(flat(spark, sf_dir), by=["device_type"]), 4)


@query
def recent_rows(spark, sf_dir):
    return reports.recent_rows(telemetry(spark, sf_dir), 500).select(ROW)


@query
def recent_incidents(spark, sf_dir):
    return reports.recent_incidents(telemetry(spark, sf_dir), 50).select(ROW)


@query
def recent_incidents_one_well(spark, sf_dir):
    return reports.recent_incidents(telemetry(spark, sf_dir), 50, WELL).select(ROW)


@query
def latest_anomaly(spark, sf_dir):
    return reports.latest_anomaly(telemetry(spark, sf_dir)).select(ROW)


@query
def latest_anomaly_one_well(spark, sf_dir):
    return reports.latest_anomaly(telemetry(spark, sf_dir), WELL).select(ROW)


@query
def latest_by_id(spark, sf_dir):
    newest = views.parse_payload(reports.latest_by_id(telemetry(spark, sf_dir)))
    fields = [f"{views.number_sql(name)} AS `{name}`" for name in sensor_payload()]
    return rounded(newest.selectExpr("device_type", *fields), 6)


@query
def fleet_status(spark, sf_dir):
    return rounded(views.fleet_status(telemetry(spark, sf_dir)), 6)


@query
def surrounding_series(spark, sf_dir):
    return reports.surrounding_series(telemetry(spark, sf_dir), WELL).select(ROW)


@query
def fault_timeline(spark, sf_dir):
    return rounded(reports.fault_timeline(flat(spark, sf_dir, "P-TPT", "T-TPT", "P-MON-CKP")), 6)


@query
def incident_by_id(spark, sf_dir):
    found = reports.incident_by_id(telemetry(spark, sf_dir), 50)
    return found.select(*ROW, F.get_json_object("diagnosis", "$.raw_diagnosis").alias("raw_diagnosis"))


@query
def sensor_snapshot(spark, sf_dir):
    return rounded(reports.sensor_snapshot(flat(spark, sf_dir)), 6)


@query
def detect_faults(spark, sf_dir):
    found = rules.detect_faults(parsed(spark, sf_dir))
    return found.select("id", "device_type", F.size("detected").alias("n_faults"),
                        F.array_join("detected", ", ").alias("faults"))


def _rules_of(device_type):
    def run(spark, sf_dir):
        found = rules.detect_type(parsed(spark, sf_dir), device_type)
        return found.select("id", F.array_join("detected", ", ").alias("faults"))

    return run


for _type in RULE_DEVICE_TYPES:
    QUERIES[f"rules_{_type.lower()}"] = _rules_of(_type)


@query
def fault_rule_totals(spark, sf_dir):
    found = rules.detect_faults(parsed(spark, sf_dir))
    # explode_outer: see explode_entries
    fired = found.select("device_type", F.explode_outer("detected").alias("rule")).filter("rule IS NOT NULL")
    return fired.groupBy("device_type", "rule").agg(F.count("*").alias("rows"))


@query
def sensor_evidence(spark, sf_dir):
    found = evidence.with_evidence(parsed(spark, sf_dir))
    return rounded(evidence.explode_entries(found, "evidence", "id"), 6)


@query
def bounds_check(spark, sf_dir):
    bounds = spark.createDataFrame(
        [(s, low, high) for s, low, high, _ in NOMINAL_BOUNDS], "sensor string, low double, high double")
    readings = evidence.unpivot_payload(parsed(spark, sf_dir), [b[0] for b in NOMINAL_BOUNDS], ["id"])
    return rounded(evidence.bounds_check(readings, bounds).select("id", "sensor", "value", "position"), 6)


@query
def envelope_deviation(spark, sf_dir):
    found = evidence.with_deviation(flat(spark, sf_dir))
    rows = found.select("id", F.posexplode_outer("deviation").alias("place", "d")).filter("d IS NOT NULL")
    return rounded(rows.select("id", "place", "d.sensor", "d.region", "d.status", "d.envelope", "d.value"), 6)


@query
def localize_faults(spark, sf_dir):
    faults = flat(spark, sf_dir).filter(F.col("fault").isNotNull())
    found = evidence.localize(faults)
    return rounded(found.select("id", "location", F.array_join("abnormal_sensors", ", ").alias("sensors"),
                                "confidence_pct"), 6)


def decisions(spark, sf_dir):
    confidence = F.when(F.col("binary_pred") == 1, F.col("score")).otherwise(1 - F.col("score"))
    rows = predictions(spark, sf_dir).select(
        F.col("event_id").alias("id"), "well_id", "binary_pred", confidence.alias("binary_confidence"),
        F.col("multi_pred").alias("event_id"), F.col("multi_confidence").alias("event_confidence"))
    return evidence.fuse_decision(rows)


@query
def fuse_decision(spark, sf_dir):
    return rounded(decisions(spark, sf_dir).drop("binary_pred", "event_id", "event_confidence"), 6)


@query
def alert_flags(spark, sf_dir):
    return rounded(evidence.alert_flag(decisions(spark, sf_dir), keep=["id"]), 6)


@query
def window_features_online_daily(spark, sf_dir):
    parsed = views.parse_payload(telemetry(spark, sf_dir))
    readings = parsed.selectExpr("device_id", "id", "timestamp AS ts", *[f"{views.number_sql(s)} AS `{s}`" for s in PRIMARY_SENSORS])
    return rounded(window_features_online(readings, PRIMARY_SENSORS, DAY, order=("ts", "id")), 4)


@query
def incident_surroundings(spark, sf_dir):
    """Every incident with the readings of its device in the six hours on both sides."""
    view = flat(spark, sf_dir)
    found = reports.around(view.filter(F.col("fault").isNotNull()), view, 6 * 3600, 6 * 3600)
    return rounded(found.select("incident_id", "id", "device_id", "offset_seconds", col("P-TPT"), col("T-TPT"), col("P-MON-CKP")), 6)
