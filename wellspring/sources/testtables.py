"""Adapters that present the generic test tables in this library's shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.operators.retrieval import task_count

WELL_DEVICE_TYPES = [
    "CNC", "PRESS", "CONVEYOR", "ROBOT", "PUMP", "COMPRESSOR", "ENERGY_METER", "oil_well",
]
SECTION_HEADINGS = [
    "Typical Sensor Symptoms",
    "Possible Root Causes",
    "Recommended Operator Actions",
    "Critical Safety Considerations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return with_device(table(spark, sf_dir, "events").withColumn("k", k.cast("double")))


def with_device(df: DataFrame) -> DataFrame:
    prefix = F.when(F.col("user_id") % 3 < 2, "WELL-").otherwise("PUMP-")
    return df.withColumn("device_id", F.concat(prefix, F.lpad(F.col("user_id").cast("string"), 5, "0")))


def sensor_payload() -> dict:
    """Payload fields as formulas over ``value`` (v) and ``k``."""
    v, k = F.col("value"), F.col("k")
    ruled = {
        "spindle_temperature": k + 3,
        "vibration": k / 8,
        "tool_wear": v,
        "hydraulic_pressure": v,
        "oil_temperature": k,
        "motor_temperature": k + 1,
        "belt_alignment": k / 15,
        "joint_vibration": k / 9,
        "load": k + 2,
        "cavitation": k / 100,
        "pressure": v,
        "discharge_pressure": v * 2,
        "voltage_imbalance": k / 12,
        "power_factor": k / 100,
        "thd": k / 10,
    }
    return {
        "P-PDG": v * 1e6 + 37000,
        "P-TPT": F.when(k % 10 != 0, v * 2.5e5 + 1300),
        "T-TPT": k * 5 - 60.03,
        "P-MON-CKP": F.when(k % 3 != 0, v * 3e5 + 700),
        "T-JUS-CKP": F.when(k % 7 == 0, "n/a").otherwise((k + 0.02).cast("string")),
        "P-JUS-CKGL": v * 1e5,
        "T-JUS-CKGL": k * 0.9,
        "QGL": v * 0.4 - 5,
        "P-ANULAR": F.when(k % 5 != 0, v * 5e4 - 89987),
        "T-PDG": k * 1.5 + 0.07,
        "ABER-CKP": k * 1.1,
        **{name: F.when(k % 9 != 0, formula) for name, formula in ruled.items()},
    }


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored telemetry rows with a JSON payload, from ``events``."""
    return telemetry_from(events(spark, sf_dir))


def spread_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, dealt to all tasks while the rows are narrow.

    A row group is read by one task, and a part of a table in time order lies in few of them.
    """
    return telemetry_from(events(spark, sf_dir).repartition(task_count(spark)))


def telemetry_from(rows: DataFrame) -> DataFrame:
    fault = F.when(F.col("event_type") == "error", "Severe Slugging").when(
        F.col("event_type") == "purchase", "Flow Instability"
    )
    types = F.array(*[F.lit(t) for t in WELL_DEVICE_TYPES])
    device_type = F.element_at(types, (F.col("user_id") % 8 + 1).cast("int"))
    diagnosis = F.when(
        (F.col("event_id") % 10 == 0) & fault.isNotNull(),
        F.struct(
            (F.col("k") / 100).alias("confidence"),
            F.concat(F.lit("Stored report for "), fault).alias("raw_diagnosis"),
        ),
    )
    fields = [formula.alias(name) for name, formula in sensor_payload().items()]
    payload = F.to_json(F.struct("device_id", *fields, diagnosis.alias("diagnosis")))
    return rows.select(
        F.col("event_id").alias("id"),
        "device_id",
        device_type.alias("device_type"),
        F.col("ts").alias("timestamp"),
        fault.alias("fault"),
        payload.alias("sensor_data"),
    )


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide sensor recordings with sentinels, gaps, NaN and partial labels, from ``events``."""
    v, k, e = F.col("value"), F.col("k"), F.col("event_id")
    part = F.floor((F.dayofmonth("ts") - 1) / 10).cast("int")
    label = (
        F.when(F.col("event_type") == "view", 0)
        .when(F.col("event_type") == "error", 3)
        .when(F.col("event_type") == "signup", 105)
        .when(F.col("event_type") == "purchase", 4)
    )
    return events(spark, sf_dir).select(
        F.concat("device_id", F.lit("_"), part.cast("string"), F.lit(".parquet")).alias("instance_file"),
        F.col("device_id").alias("well_id"),
        (F.col("user_id") % 10).cast("string").alias("event_folder"),
        "ts",
        "event_id",
        label.alias("class"),
        (v * 1e6).alias("P-PDG"),
        F.when(k % 10 == 0, F.lit(-1e38)).otherwise(v * 2.5e5).alias("P-TPT"),
        (k * 5 - 60).alias("T-TPT"),
        F.when(k % 3 != 0, v * 1e5).alias("P-MON-CKP"),
        k.alias("T-JUS-CKP"),
        F.when(F.col("user_id") % 5 != 0, v * 1e4 - 9000).alias("P-ANULAR"),
        (k * 0.5 + 20).alias("T-PDG"),
        F.when(k % 4 == 3, v * 2e4).alias("P-JUS-CKGL"),
        (v * 30).alias("QGL"),
        (k * 1.2 - 5).alias("ABER-CKP"),
        k.alias("ABER-CKGL"),
        F.when(e % 5 == 0, k * 3).alias("T-MON-CKP"),
        F.when(k % 2 == 0, F.lit(float("nan"))).alias("P-JUS-CKP"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, scores and predicted classes by formula, from ``events``."""
    v, k = F.col("value"), F.col("k")
    kind = F.col("event_type")
    event = F.when(kind == "error", 3).when(kind == "purchase", 4).when(kind == "signup", 5).otherwise(0)
    score = F.least(v / 125, F.lit(1.0))
    return events(spark, sf_dir).select(
        "event_id",
        F.col("device_id").alias("well_id"),
        "ts",
        event.alias("multiclass"),
        (event > 0).cast("int").alias("binary_target"),
        (kind == "signup").cast("int").alias("is_transient"),
        score.alias("score"),
        (score >= 0.1).cast("int").alias("binary_pred"),
        F.when(k % 4 < 2, event).otherwise((k % 10).cast("int")).alias("multi_pred"),
        F.bround(k / 100, 2).alias("multi_confidence"),
    )


def dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown documents with numbered sections, one per row of ``documents``."""
    headings = F.array(*[F.lit(h) for h in SECTION_HEADINGS])

    def section(line, i):
        items = F.transform(
            F.split(line, "\\. "),
            lambda sentence, n: F.concat((n + 1).cast("string"), F.lit(". "), sentence),
        )
        heading = F.element_at(headings, (i % 4 + 1).cast("int"))
        return F.concat(F.lit("\n## "), heading, F.lit("\n"), F.array_join(items, "\n"))

    body = F.array_join(F.transform(F.split("text", "\n"), section), "\n")
    number = F.regexp_extract("source", r"(\d+)", 1)
    return table(spark, sf_dir, "documents").select(
        F.concat(
            F.lit("event_"), number, F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".md")
        ).alias("doc_name"),
        F.concat(F.lit("# Dossier "), F.col("doc_id").cast("string"), F.lit("\n"), body).alias("text"),
    )
