"""Recording files and what is derived from their names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.constants import PRIMARY_SENSORS
from wellspring.functions.values import col

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def recording_keys(path: Column) -> dict[str, Column]:
    """File name, well (name up to the first ``_``) and parent folder of a recording's path."""
    parts = F.split(path, "/")
    file = F.element_at(parts, -1)
    return {
        "instance_file": file,
        "well_id": F.element_at(F.split(file, "_"), 1),
        "event_folder": F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")),
    }


def discover_sensors(df: DataFrame, expected: Sequence[str] = PRIMARY_SENSORS) -> list[str]:
    """Expected sensors that are numeric here; without any, every numeric column but the labels."""
    numeric = [name for name, kind in df.dtypes if kind.startswith(NUMERIC)]
    found = [s for s in expected if s in numeric]
    return found or [n for n in numeric if n not in ("class", "state")]


FILES = "WELL-*.parquet"
TIME_COLUMNS = ("timestamp", "__index_level_0__")  # named column or unnamed index
LABELS = ("class", "state")


def recording_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` and ``columns`` (array of name and Arrow type) of each file; NULL if its footer cannot be read.

    Footers are read by the tasks, one row a file.
    """

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))
        for batch in batches:
            paths, found = batch.column(0).to_pylist(), []
            for path in paths:
                try:
                    store, local = fs.FileSystem.from_uri(path)
                    fields = pq.read_schema(local, filesystem=store)
                    found.append([{"name": f.name, "type": str(f.type)} for f in fields])
                except (OSError, ValueError):  # not Parquet, cut off or not readable
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["path", "columns"])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", FILES).load(f"{root}/*").select("path")
    return listed.mapInArrow(footers, "path string, columns array<struct<name:string,type:string>>")


def _number(kind: str) -> bool:
    return kind.startswith(("int", "uint", "float", "double", "halffloat", "decimal"))


def read_recordings(spark: SparkSession, root: str) -> DataFrame:
    """All ``<event folder>/WELL-*.parquet`` files, with keys, ``ts``, an integer label and the sensors.

    Files may differ in their columns and types: each distinct set of columns is read with its
    own types and cast, sensors to double and the label to integer. ``available_sensors`` has
    the expected sensors that are numeric in the file or, without any, its other numeric
    columns; sensors a file lacks are NULL. A file without a label column takes the number of
    its folder, else 0. Files whose footer cannot be read are skipped; ``files_without_rows``
    names them. Nanosecond times need ``spark.sql.legacy.parquet.nanosAsLong``, which
    ``build_session`` sets.
    """
    files = recording_files(spark, root).where("columns IS NOT NULL")
    # the driver lists files for any scan, and there are few distinct sets of columns
    groups: dict[tuple, list[str]] = {}
    for path, columns in files.collect():
        groups.setdefault(tuple((c["name"], c["type"]) for c in columns), []).append(path)
    parts = [_read_group(spark, dict(columns), sorted(paths)) for columns, paths in sorted(groups.items())]
    if not parts:
        fields = [T.StructField(s, T.DoubleType()) for s in PRIMARY_SENSORS]
        keys = [T.StructField(k, T.StringType()) for k in ("instance_file", "well_id", "event_folder")]
        rest = [T.StructField("ts", T.TimestampNTZType()), T.StructField("class", T.IntegerType()),
                T.StructField("available_sensors", T.ArrayType(T.StringType()))]
        return spark.createDataFrame([], T.StructType(keys + rest + fields))
    return concat_recordings(parts)


def _read_group(spark: SparkSession, kinds: dict[str, str], paths: list[str]) -> DataFrame:
    """Files of one set of columns."""
    numeric = [name for name, kind in kinds.items() if _number(kind) and name not in TIME_COLUMNS]
    available = [s for s in PRIMARY_SENSORS if s in numeric] or [n for n in numeric if n not in LABELS]
    rows = spark.read.parquet(*paths)
    time = next((name for name in TIME_COLUMNS if name in rows.columns), None)
    timed = rows.withColumn("ts", F.lit(None).cast("timestamp_ntz")) if time is None else with_time(rows, time)
    label = F.nanvl(col("class").cast("double"), F.lit(None)).cast("int") if "class" in kinds else F.lit(None).cast("int")
    keyed = timed.withColumns(recording_keys(F.col("_metadata.file_path")) | {"class": label})
    absent = [F.lit(None).cast("double").alias(s) for s in PRIMARY_SENSORS if s not in available]
    return label_fallback(keyed, F.lit("class" in kinds)).select(
        "instance_file",
        "well_id",
        "event_folder",
        "ts",
        "class",
        F.array(*[F.lit(s) for s in available]).cast("array<string>").alias("available_sensors"),
        *[col(s).cast("double").alias(s) for s in available],
        *absent,
    )


def sensors_of(recordings: DataFrame) -> list[str]:
    """The expected sensors and the others that ``read_recordings`` found."""
    known = [*PRIMARY_SENSORS]
    return known + [n for n, kind in recordings.dtypes if kind == "double" and n not in known]


def files_without_rows(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Recording files of which nothing was read: empty or unreadable ones."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", FILES).load(f"{root}/*").select("path")
    keys = ["event_folder", "instance_file"]
    named = listed.select("path", *[c.alias(n) for n, c in recording_keys(F.col("path")).items() if n in keys])
    return named.join(rows.select(*keys).distinct(), keys, "left_anti")


def with_time(df: DataFrame, source: str = "timestamp") -> DataFrame:
    """Column ``ts`` as a timestamp without zone, from a timestamp, text or nanoseconds."""
    kind = dict(df.dtypes)[source]
    if kind == "bigint":
        since = "timestampadd(MICROSECOND, `{0}` div 1000, TIMESTAMP_NTZ '1970-01-01 00:00:00')"
        parsed = F.expr(since.format(source))
    else:
        parsed = col(source).try_cast("timestamp_ntz") if kind == "string" else col(source).cast("timestamp_ntz")
    return df.withColumn("ts", parsed).drop(source)


def label_fallback(df: DataFrame, has_class: Column) -> DataFrame:
    """Recordings without a label column take the number of their folder, else 0."""
    folder = F.when(F.col("event_folder").rlike("^[0-9]+$"), F.col("event_folder").try_cast("int"))
    return df.withColumn("class", F.when(has_class, F.col("class")).otherwise(F.coalesce(folder, F.lit(0))))


def first_recording_per_event(df: DataFrame, events: Sequence[int] = range(10)) -> DataFrame:
    """First file name of each event folder."""
    folders = [str(e) for e in events]
    return df.filter(F.col("event_folder").isin(folders)).groupBy("event_folder").agg(
        F.min("instance_file").alias("instance_file")
    )


def concat_recordings(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; sensors missing in a part are NULL."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def recording_to_messages(
    df: DataFrame, sensors: Sequence[str], max_records: int = 120, order: Sequence[str] = ("ts",)
) -> DataFrame:
    """First rows of each recording as (topic, payload) messages; missing readings are JSON nulls."""
    first = Window.partitionBy("instance_file").orderBy(*order)
    chosen = df.withColumn("record", F.row_number().over(first)).filter(F.col("record") <= max_records)
    body = F.struct(
        F.col("well_id").alias("device_id"),
        F.lit("oil_well").alias("device_type"),
        F.col("ts").cast("string").alias("timestamp"),
        F.col("class").cast("int").alias("ground_truth_class"),
        F.col("instance_file").alias("recording_file"),
        *[F.nanvl(col(s).cast("double"), F.lit(None).cast("double")).alias(s) for s in sensors],
    )
    return chosen.select(
        F.concat(F.lit("factory/oil_well/"), F.col("well_id"), F.lit("/telemetry")).alias("topic"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"),
        "record",
        "instance_file",
    )
