"""Views over stored telemetry rows (id, device_id, device_type, timestamp, fault, sensor_data)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.constants import (
    AVERAGED_SENSORS,
    DISPLAY_ENVELOPES,
    DISPLAY_SENSORS,
    EVENT_NAMES,
    FEED_COLUMNS,
    FLEET_COLUMNS,
    PRIMARY_SENSORS,
    STATISTICS,
    TRANSIENT_EVENTS,
)
from wellspring.functions.values import col, name_of, whole_seconds
from wellspring.operators.windows import feature_names

PAYLOAD = "map<string,string>"
FACTORS = {sensor: factor for sensor, _, _, factor, _, _ in DISPLAY_ENVELOPES}


def parse_payload(df: DataFrame, source: str = "sensor_data") -> DataFrame:
    """Parse the JSON document once into a map column ``payload``."""
    return df.withColumn("payload", F.from_json(source, PAYLOAD))


def number_sql(key: str, payload: str = "payload") -> str:
    """SQL text for a numeric payload field; NULL when absent, not numeric or NaN."""
    return f"nanvl(try_cast(try_element_at({payload}, '{key}') AS DOUBLE), CAST(NULL AS DOUBLE))"


def derive_status() -> Column:
    return F.when(F.length("fault") > 0, "ANOMALY").otherwise("NORMAL")


def flatten_telemetry(telemetry: DataFrame, sensors: Sequence[str] = DISPLAY_SENSORS) -> DataFrame:
    """Sensor columns in display units, the status and the stored diagnosis (JSON text)."""
    parsed = parse_payload(telemetry).withColumn("status", derive_status())
    return parsed.selectExpr(
        "id",
        "device_id",
        "device_type",
        "timestamp",
        "fault",
        "status",
        *[f"{number_sql(s)} * {FACTORS.get(s, 1.0)}D AS `{s}`" for s in sensors],
        "try_element_at(payload, 'diagnosis') AS diagnosis",
    )


def status_filter(df: DataFrame, choice: str = "all") -> DataFrame:
    """Keep all rows, only ``anomalies`` or only ``normal`` ones."""
    if choice == "anomalies":
        return df.filter(F.col("fault").isNotNull())
    if choice == "normal":
        return df.filter(F.col("fault").isNull())
    if choice != "all":
        raise ValueError(f"unknown status filter: {choice}")
    return df


def asset_search(df: DataFrame, pattern: str) -> DataFrame:
    """Rows whose device id contains the regular expression, ignoring case."""
    return df.filter(F.coalesce(F.col("device_id").rlike(f"(?i){pattern}"), F.lit(False)))


def round_view(df: DataFrame, digits: int = 2) -> DataFrame:
    """Round all floating columns half to even."""
    return df.withColumns({n: F.bround(col(n), digits) for n, t in df.dtypes if t in ("double", "float")})


def live_feed(
    telemetry: DataFrame, limit: int = 500, well_id: str | None = None, status: str = "all", search: str = ""
) -> DataFrame:
    """The latest rows first; status and search apply to those rows only."""
    from wellspring.operators.reports import recent_rows

    view = status_filter(flatten_telemetry(recent_rows(telemetry, limit, well_id)), status)
    if search:
        view = asset_search(view, search)
    return round_view(view.select(*[col(c) for c in FEED_COLUMNS]).orderBy(F.desc("timestamp"), F.desc("id")))


def fleet_status(telemetry: DataFrame, limit: int = 15) -> DataFrame:
    from wellspring.operators.reports import recent_rows

    flat = flatten_telemetry(recent_rows(telemetry, limit), ["P-TPT", "T-TPT", "P-MON-CKP"])
    return flat.select(*[col(c) for c in FLEET_COLUMNS]).orderBy(F.desc("timestamp"), F.desc("id"))


def sensor_means(view: DataFrame, sensors: Sequence[str] = AVERAGED_SENSORS) -> DataFrame:
    return view.agg(*[F.avg(col(s)).alias(s) for s in sensors])


def incident_label(df: DataFrame) -> DataFrame:
    """One line per incident: id, time to the second, device and fault."""
    label = F.concat(
        F.lit("ID #"), F.col("id").cast("string"), F.lit(" | "), whole_seconds(F.col("timestamp")),
        F.lit(" | "), F.col("device_id"), F.lit(" — "), F.col("fault"),
    )
    return df.withColumn("label", label)


def event_name(event: Column, prefix: str = "Event ") -> Column:
    return name_of(event, EVENT_NAMES, F.concat(F.lit(prefix), event.cast("string")))


def class_description(raw_class: Column) -> Column:
    """Name of a raw class; transient classes have their own names."""
    names = EVENT_NAMES | {100 + n: f"Transient - {EVENT_NAMES[n]}" for n in TRANSIENT_EVENTS}
    return name_of(raw_class, names, F.lit("Unknown"))


def snapshot_features(df: DataFrame, sensors: Sequence[str] = PRIMARY_SENSORS, keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector of single records from their payload map.

    A key with the full feature name wins, even when its value is not numeric;
    else the plain sensor reading stands for mean, min, max and median, with no
    spread and no trend.
    """
    # records usually carry plain readings only; then no feature name is left to look up
    named = "key RLIKE '_({})$' AND text IS NOT NULL".format("|".join(STATISTICS))
    number = "nanvl(try_cast(text AS DOUBLE), CAST(NULL AS DOUBLE))"
    readings = df.selectExpr(
        *keep,
        f"transform_values(map_filter(payload, (key, text) -> {named}), (key, text) -> {number}) AS given",
        *[f"{number_sql(s)} AS `{s}`" for s in sensors],
    )
    features = []
    for name in feature_names(sensors):
        sensor, statistic = name.rsplit("_", 1)
        derived = f"`{sensor}`"
        if statistic in ("std", "range", "trend"):
            derived = f"CASE WHEN `{sensor}` IS NOT NULL THEN 0D END"
        features.append(
            f"CASE WHEN map_contains_key(given, '{name}') THEN given['{name}'] ELSE {derived} END AS `{name}`"
        )
    return readings.selectExpr(*keep, *features)


def reindex(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the feature columns; missing ones are NULL."""
    return df.selectExpr(
        *keep,
        *[f"CAST(`{f}` AS DOUBLE) AS `{f}`" if f in df.columns else f"CAST(NULL AS DOUBLE) AS `{f}`" for f in features],
    )
