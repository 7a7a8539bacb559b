"""Evidence from operating bounds, and the fused decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.constants import DISPLAY_ENVELOPES, NOMINAL_BOUNDS, NORMAL_EVENT
from wellspring.functions.values import array_of, col
from wellspring.operators.telemetry import event_name, number_sql

DRIFT_TEXT = "All monitored sensor regions within nominal envelopes (Multivariate statistical drift)"
DEFAULT_CONFIDENCE = 0.65


def decimals(value: Column, digits: int) -> Column:
    """Fixed-point text, half to even; a negative number that rounds to zero keeps its sign."""
    text = F.format_string(f"%.{digits}f", F.abs(F.bround(value, digits)))
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)


def explode_entries(df: DataFrame, entries: str, *keep: str) -> DataFrame:
    """One row per entry of an array of structs.

    ``inline_outer`` with a filter behind it: for ``inline`` the optimizer derives a
    filter on the array's size and pushes it down, which evaluates the expressions
    of the array twice.
    """
    rows = df.select(*keep, F.inline_outer(entries))
    return rows.filter(F.col("sensor").isNotNull())


def sensor_evidence(bounds: Sequence[tuple] = NOMINAL_BOUNDS) -> Column:
    """Array of deviations of the columns ``reading <sensor>`` from their nominal bounds."""
    entries = []
    for sensor, low, high, description in bounds:
        value = col(f"reading {sensor}")
        deficit = (F.lit(low) - value) / F.lit(low or 1.0) * 100
        surge = (value - F.lit(high)) / F.lit(high or 1.0) * 100

        def entry(expected, status, deviation, before, after):
            return F.struct(
                F.lit(sensor).alias("sensor"),
                decimals(value, 2).alias("observed_value"),
                F.lit(expected).alias("expected_behavior"),
                F.lit(status).alias("status"),
                F.concat(F.lit(before), decimals(deviation, 1), F.lit(after)).alias("significance"),
                value.alias("value"),
                deviation.alias("deviation_pct"),
            )

        entries.append(
            F.when(
                value < low,
                entry(f">= {low:.1f} (Nominal: {description})", "ABNORMALLY LOW", deficit,
                      "Deficit of ", "% below minimum nominal threshold"),
            ).when(
                value > high,
                entry(f"<= {high:.1f} (Nominal: {description})", "ABNORMALLY HIGH", surge,
                      "Surge of ", "% above maximum nominal threshold"),
            )
        )
    return array_of(*entries)


def with_evidence(df: DataFrame) -> DataFrame:
    """Add the evidence array; the readings are extracted once, in a step of their own."""
    readings = [f"{number_sql(sensor)} AS `reading {sensor}`" for sensor, *_ in NOMINAL_BOUNDS]
    names = [f"reading {sensor}" for sensor, *_ in NOMINAL_BOUNDS]
    return df.selectExpr("*", *readings).withColumn("evidence", sensor_evidence()).drop(*names)


def bounds_check(readings: DataFrame, bounds: DataFrame) -> DataFrame:
    """Long readings (sensor, value) against a table of bounds (sensor, low, high)."""
    value = F.col("value")
    return readings.join(F.broadcast(bounds), "sensor").withColumn(
        "position",
        F.when(value < F.col("low"), "LOW").when(value > F.col("high"), "HIGH").otherwise("NORMAL"),
    )


def unpivot_payload(df: DataFrame, sensors: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per record and known sensor."""
    readings = df.selectExpr(*keep, *[f"{number_sql(s)} AS `reading {s}`" for s in sensors])
    names = [f"`reading {s}`" for s in sensors]
    labels = ", ".join(f"'{s}', {name}" for s, name in zip(sensors, names))
    long = readings.selectExpr(*keep, f"stack({len(names)}, {labels}) AS (sensor, value)")
    return long.filter(F.col("value").isNotNull())


def envelope_deviation() -> Column:
    """Array over the known sensors of a flattened view: status against the display envelope."""
    entries = []
    for sensor, unit, region, _, low, high in DISPLAY_ENVELOPES:
        value = col(sensor)
        status = F.when(value < low, "ABNORMAL (LOW)").when(value > high, "ABNORMAL (HIGH)").otherwise("NORMAL")
        entries.append(
            F.when(
                value.isNotNull(),
                F.struct(
                    F.lit(sensor).alias("sensor"),
                    F.lit(region).alias("region"),
                    F.concat(decimals(value, 2), F.lit(f" {unit}")).alias("measured"),
                    F.lit(f"{low:.1f} – {high:.1f} {unit}").alias("envelope"),
                    status.alias("status"),
                    value.alias("value"),
                ),
            )
        )
    return array_of(*entries)


def with_deviation(view: DataFrame) -> DataFrame:
    """Add envelope rows (abnormal ones first), abnormal sensors and abnormal regions (first seen first)."""
    checked = view.withColumn("known", envelope_deviation())
    split = checked.withColumn("abnormal", F.filter("known", lambda e: e["status"] != "NORMAL"))
    normal = F.filter("known", lambda e: e["status"] == "NORMAL")
    return split.withColumns(
        {
            "deviation": F.concat("abnormal", normal),
            "abnormal_sensors": F.transform("abnormal", lambda e: e["sensor"]),
            "abnormal_regions": F.array_distinct(F.transform("abnormal", lambda e: e["region"])),
        }
    ).drop("known", "abnormal")


def localize(view: DataFrame) -> DataFrame:
    """Where the fault shows, and how sure the stored diagnosis was (percent)."""
    stored = F.get_json_object("diagnosis", "$.confidence").try_cast("double")
    regions = F.array_join("abnormal_regions", ", ")
    return with_deviation(view).withColumns(
        {
            "location": F.when(F.size("abnormal_regions") > 0, regions).otherwise(DRIFT_TEXT),
            "confidence_pct": F.coalesce(stored, F.lit(DEFAULT_CONFIDENCE)) * 100,
        }
    )


def fuse_decision(df: DataFrame) -> DataFrame:
    """Combine the two classifiers' outputs.

    Needs ``binary_pred``, ``binary_confidence`` (of the predicted side), ``event_id``
    and ``event_confidence``.
    """
    faulty = F.col("binary_pred") == 1
    anomaly = faulty | (F.col("event_id") > 0)
    confidence = F.when(
        F.col("event_id") > 0, F.greatest("binary_confidence", "event_confidence")
    ).otherwise(F.col("binary_confidence"))
    return df.withColumns(
        {
            "status": F.when(anomaly, "anomaly").otherwise("normal"),
            "predicted_event_id": F.col("event_id"),
            "predicted_event": F.when(anomaly, event_name(F.col("event_id"))).otherwise(NORMAL_EVENT),
            "confidence": F.bround(confidence, 4),
            "binary_status": F.when(faulty, "FAULT").otherwise("NORMAL"),
            "binary_confidence": F.bround("binary_confidence", 4),
            "multiclass_confidence": F.bround("event_confidence", 4),
        }
    )


def alert_flag(decisions: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """What an ingest call answers: alert, status, event and confidence."""
    return decisions.select(
        *keep,
        F.lit(True).alias("acknowledged"),
        "well_id",
        (F.col("status") == "anomaly").alias("alert"),
        "status",
        F.col("predicted_event").alias("event"),
        "confidence",
    )
