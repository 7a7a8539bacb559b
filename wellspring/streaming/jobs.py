"""Streaming counterparts of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.operators import evidence, rules
from wellspring.operators.telemetry import parse_payload
from wellspring.session import scratch_path
from wellspring.sources.messages import accepted, dead_letters, decode_messages, topic_filter

Scorer = Callable[[DataFrame], DataFrame]


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files: int = 100) -> DataFrame:
    """Files that arrive in a folder; each micro-batch takes a bounded number of them."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", files).parquet(folder)


def kafka_messages(spark: SparkSession, servers: str, topics: str) -> DataFrame:
    """(topic, payload) messages from Kafka; needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    rows = reader.option("subscribePattern", topics).load()
    return rows.select("topic", F.col("value").cast("string").alias("payload"))


def append_rows(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()):
    """Append to parquet with exactly-once bookkeeping in the checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(availableNow=True).start(path)


def each_batch(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], mode: str = "append"):
    """Run batch operators on every micro-batch; a repeated batch replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(availableNow=True).start()


def store_stream(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]):
    """Storable rows of every micro-batch go through ``work`` to ``telemetry``, the others to ``dead-letters``."""

    def write(batch: DataFrame, number: int) -> None:
        work(accepted(batch)).write.mode("overwrite").parquet(f"{path}/telemetry/batch={number}")
        dead_letters(batch).write.mode("overwrite").parquet(f"{path}/dead-letters/batch={number}")

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(availableNow=True).start()


def drain(spark: SparkSession, name: str, start: Callable[[str, str], object]) -> str:
    """Run a stream over what is there and return the folder of its results."""
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    start(path, checkpoint).awaitTermination()
    return path


def stream_alerts(messages: DataFrame) -> DataFrame:
    """Fired rules and deviating sensors of each telemetry row; stateless."""
    found = rules.detect_faults(evidence.with_evidence(parse_payload(messages)))
    sensors = F.transform("evidence", lambda e: e["sensor"])
    return found.select(
        "id",
        "device_id",
        F.array_join("detected", ", ").alias("rules"),
        F.array_join(sensors, ", ").alias("sensors"),
        ((F.size("detected") > 0) | (F.size("evidence") > 0)).alias("alert"),
    )


def fault_totals(telemetry: DataFrame) -> DataFrame:
    """Running counts per device; combine with ``complete`` or ``update`` output mode."""
    return telemetry.groupBy("device_id").agg(
        F.count("*").alias("total_records"),
        F.count("fault").alias("total_faults"),
        F.max("timestamp").alias("last_timestamp"),
    )


def telemetry_stream(messages: DataFrame, score: Scorer) -> DataFrame:
    """Messages to storable telemetry rows.

    ``score`` adds status, predicted_event and confidence from ``payload``. An anomaly
    sets ``fault``; any other message keeps the fault it came with. Rows that cannot
    be stored keep their ``reject`` reason.
    """
    decoded = decode_messages(topic_filter(messages)).withColumn("payload", F.col("fields"))
    scored = score(decoded.drop("fields"))
    anomaly = F.col("status") == "anomaly"
    return scored.withColumn("fault", F.when(anomaly, F.col("predicted_event")).otherwise(F.col("fault")))


def store_batch(batch: DataFrame, diagnose: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows of a micro-batch as they are stored, with the diagnosis where one was triggered."""
    if diagnose is None:
        return batch.withColumn("diagnosis", F.lit(None).cast("string"))
    return batch.join(diagnose(batch.filter("fired")), "id", "left")
