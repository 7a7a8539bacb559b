"""Fleet reports: counts, rankings, latest rows and point lookups."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.constants import CORRELATED_SENSORS, DISPLAY_ENVELOPES
from wellspring.functions.values import col, micros, ratio
from wellspring.session import materialise


def latest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), F.desc("id"))


def telemetry_stats(telemetry: DataFrame) -> DataFrame:
    """One row: totals, distinct devices, first and last time, stored diagnoses."""
    diagnosis = F.get_json_object("sensor_data", "$.diagnosis")
    text = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return telemetry.agg(
        F.count("*").alias("total_records"),
        F.count("fault").alias("total_faults"),
        F.count_distinct("device_id").alias("total_wells"),
        F.coalesce(F.date_format(F.min("timestamp"), text), F.lit("N/A")).alias("first_timestamp"),
        F.coalesce(F.date_format(F.max("timestamp"), text), F.lit("N/A")).alias("last_timestamp"),
        F.count(diagnosis).alias("total_diagnoses"),
    )


def distinct_wells(telemetry: DataFrame) -> DataFrame:
    return (
        telemetry.filter(F.length("device_id") > 0).select("device_id").distinct().orderBy("device_id")
    )


def fault_counts(telemetry: DataFrame) -> DataFrame:
    faults = telemetry.filter(F.col("fault").isNotNull())
    return faults.groupBy("fault").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "fault")


def asset_fault_counts(telemetry: DataFrame) -> DataFrame:
    faults = telemetry.filter(F.col("fault").isNotNull())
    return faults.groupBy("device_id").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "device_id")


def recent_rows(
    telemetry: DataFrame, limit: int = 500, well_id: str | None = None, faults_only: bool = False
) -> DataFrame:
    if well_id:
        telemetry = telemetry.filter(F.col("device_id") == well_id)
    if faults_only:
        telemetry = telemetry.filter(F.col("fault").isNotNull())
    return latest_first(telemetry).limit(limit)


def recent_incidents(telemetry: DataFrame, limit: int = 50, well_id: str | None = None) -> DataFrame:
    return recent_rows(telemetry, limit, well_id, faults_only=True)


def fault_kpis(telemetry: DataFrame, limit: int | None = 1000, well_id: str | None = None) -> DataFrame:
    """Totals over the latest fault rows; ties for the most frequent fault go to the smaller name.

    ``limit=None`` takes all fault rows.
    """
    faults = telemetry.filter(F.col("fault").isNotNull())
    if well_id:
        faults = faults.filter(F.col("device_id") == well_id)
    if limit is not None:
        faults = latest_first(faults).limit(limit)
    return faults.agg(
        F.count("*").alias("total_faults"),
        F.count_distinct("fault").alias("distinct_faults"),
        F.mode("fault", True).alias("dominant_fault"),
        F.count_distinct("device_id").alias("affected_assets"),
    )


def well_kpis(telemetry: DataFrame, well_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Records, faults, fault rate and latest time per well; one well or all."""
    if well_id:
        telemetry = telemetry.filter(F.col("device_id") == well_id)
    if limit is not None:
        telemetry = latest_first(telemetry).limit(limit)
    return telemetry.groupBy("device_id").agg(
        F.count("*").alias("total_records"),
        F.count("fault").alias("faults"),
        (ratio(F.count("fault"), F.count("*")) * 100).alias("fault_rate_pct"),
        F.max("timestamp").alias("latest_timestamp"),
    )


def latest_per_well(telemetry: DataFrame, broadcast_devices: int = 500_000) -> DataFrame:
    """The latest row of every device.

    The newest (time, id) per device comes from three narrow columns; time and id are
    packed into one decimal, which a hash aggregate can hold; both are moved above zero, so
    times before 1970 and negative ids keep their order. The full rows are then
    picked by id, so their payload is neither sorted nor, up to ``broadcast_devices``
    devices, shuffled.
    """
    factor, above = "CAST('100000000000000000000' AS DECIMAL(21, 0))", "CAST('10000000000000000000' AS DECIMAL(20, 0))"
    packed = F.expr(f"CAST(at + 100000000000000000 AS DECIMAL(18, 0)) * {factor} + CAST(id AS DECIMAL(20, 0)) + {above}")
    narrow = telemetry.select("device_id", "id", micros(telemetry, "timestamp").alias("at"))
    newest = narrow.groupBy("device_id").agg(F.max(packed).alias("newest"))
    ids = newest.select("device_id", F.expr(f"CAST(newest % {factor} - {above} AS BIGINT)").alias("id"))
    ids = materialise(ids, "newest-ids")
    few = ids.limit(broadcast_devices + 1).count() <= broadcast_devices
    return telemetry.join(F.broadcast(ids) if few else ids, ["id", "device_id"]).select(*telemetry.columns)


def latest_anomaly(telemetry: DataFrame, well_id: str | None = None) -> DataFrame:
    """Latest fault of the given well; without one: of the wells, of any device, or the latest row."""
    if well_id:
        return recent_rows(telemetry, 1, well_id, faults_only=True)
    faulty = F.col("fault").isNotNull()
    preference = F.when(faulty & F.col("device_id").startswith("WELL"), 0).when(faulty, 1).otherwise(2)
    ranked = telemetry.withColumn("preference", preference)
    return ranked.orderBy("preference", F.desc("timestamp"), F.desc("id")).limit(1).drop("preference")


def latest_by_id(telemetry: DataFrame) -> DataFrame:
    return telemetry.orderBy(F.desc("id")).limit(1).select("device_type", "sensor_data")


def surrounding_series(telemetry: DataFrame, well_id: str, limit: int = 250) -> DataFrame:
    """The latest rows of a well in ascending order."""
    return recent_rows(telemetry, limit, well_id).orderBy("timestamp", "id")


def around(incidents: DataFrame, readings: DataFrame, before_seconds: int, after_seconds: int) -> DataFrame:
    """Readings of each incident's device from ``before_seconds`` before it to ``after_seconds`` behind it.

    Time is cut into bins as long as the span, so an incident asks at most two bins and a reading lies in
    one: an equality join by device and bin, in which a busy device is many keys. Adds ``incident_id`` and
    ``offset_seconds`` to the columns of ``readings``; rows without device or time meet nothing.
    """
    length = max(before_seconds + after_seconds, 1) * 1_000_000
    at = micros(incidents, "timestamp")
    asked = incidents.select(F.col("id").alias("incident_id"), F.col("device_id").alias("_device"), at.alias("_at"))
    low, high = F.col("_at") - before_seconds * 1_000_000, F.col("_at") + after_seconds * 1_000_000
    bins = F.sequence(F.floor(low / length), F.floor(high / length))
    asked = asked.filter("_at IS NOT NULL").withColumn("_bin", F.explode_outer(bins))
    placed = readings.withColumn("_when", micros(readings, "timestamp"))
    placed = placed.withColumn("_of", F.floor(F.col("_when") / length))
    near = (F.col("device_id") == F.col("_device")) & (F.col("_of") == F.col("_bin")) & F.col("_when").between(low, high)
    offset = (F.col("_when") - F.col("_at")) / 1_000_000
    return placed.join(asked, near).select("incident_id", *[col(c) for c in readings.columns], offset.alias("offset_seconds"))


def fault_timeline(view: DataFrame) -> DataFrame:
    """Fault rows of a flattened view in time order."""
    names = ["id", "device_id", "timestamp", "fault", "P-TPT", "T-TPT", "P-MON-CKP"]
    faults = view.filter(F.col("fault").isNotNull())
    return faults.select(*[col(n) for n in names]).orderBy("timestamp", "id")


def incident_by_id(telemetry: DataFrame, incident: int) -> DataFrame:
    """One record with its stored diagnosis."""
    found = telemetry.filter(F.col("id") == incident)
    return found.withColumn("diagnosis", F.get_json_object("sensor_data", "$.diagnosis"))


def sensor_snapshot(view: DataFrame) -> DataFrame:
    """Known sensors of each record as rows with unit and region."""
    cells = ", ".join(
        f"'{sensor}', `{sensor}`, '{unit}', '{region}'" for sensor, unit, region, _, _, _ in DISPLAY_ENVELOPES
    )
    long = view.selectExpr("id", f"stack({len(DISPLAY_ENVELOPES)}, {cells}) AS (sensor, value, unit, region)")
    return long.filter(F.col("value").isNotNull())


def sensor_correlation(
    view: DataFrame, sensors: Sequence[str] = CORRELATED_SENSORS, by: Sequence[str] = ()
) -> DataFrame:
    """Pairwise-complete Pearson correlations, one row per ordered pair (and group)."""
    pairs = [(a, b) for i, a in enumerate(sensors) for b in sensors[i:]]
    wide = view.groupBy(*by).agg(
        *[F.corr(col(a), col(b)).alias(f"{a}/{b}") for a, b in pairs]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("sensor_a"),
                F.lit(b).alias("sensor_b"),
                col(f"{a}/{b}" if (a, b) in pairs else f"{b}/{a}").alias("correlation"),
            )
            for a, b in product(sensors, sensors)
        ]
    )
    return wide.select(*by, F.inline(cells))


def class_distribution(windows: DataFrame) -> DataFrame:
    """Windows and share per event class."""
    from wellspring.operators.telemetry import class_description

    counts = windows.groupBy("multiclass").agg(F.count("*").alias("windows"))
    return (
        # one row per event class is left here, so a global frame is safe
        counts.withColumn("total", F.sum("windows").over(Window.partitionBy()))
        .select(
            "multiclass",
            class_description(F.col("multiclass")).alias("description"),
            "windows",
            (ratio(F.col("windows"), F.col("total")) * 100).alias("percent"),
        )
        .orderBy("multiclass")
    )


def phase_breakdown(windows: DataFrame) -> DataFrame:
    """Normal, transient and established windows; share of transients among the faults."""
    sums = windows.agg(
        F.count_if(F.col("binary_target") == 0).alias("normal"),
        F.coalesce(F.sum("is_transient"), F.lit(0)).alias("transient"),
        F.count_if(F.col("binary_target") == 1).alias("faults"),
    )
    established = F.col("faults") - F.col("transient")
    return sums.select(
        "normal",
        "transient",
        established.alias("established"),
        (ratio(F.col("transient"), F.col("faults")) * 100).alias("transient_share_pct"),
    )


def class_support(split: DataFrame) -> DataFrame:
    """Normal and fault windows per side of a split."""
    return split.groupBy("split", "binary_target").agg(F.count("*").alias("windows"))
