"""Writers and report files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.constants import FEED_COLUMNS, META_COLUMNS
from wellspring.functions.values import col

TELEMETRY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("fault", T.StringType()),
        T.StructField("sensor_data", T.StringType()),
    ]
)
LEADERBOARD_SCHEMA = (
    "`Task` string, `Model` string, `Accuracy` double, `Precision` double, `Recall` double, `F1` double, "
    "`Macro F1` double, `ROC-AUC` string, `Training Time (s)` double"
)
IMPORTANCE_SCHEMA = "`Rank` int, `Feature` string, `Importance` double"


def append_telemetry(rows: DataFrame, path: str) -> None:
    """Add telemetry rows to the store, one folder per day; repeated messages are kept."""
    dated = rows.withColumn("day", F.to_date("timestamp"))
    dated.write.mode("append").partitionBy("day").parquet(path)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """The store; filters on ``day`` skip whole folders."""
    schema = T.StructType([*TELEMETRY_SCHEMA.fields, T.StructField("day", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def read_telemetry_jdbc(spark: SparkSession, url: str, table: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """Telemetry from a database, read in parallel over ranges of the id (needs its JDBC driver)."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", "id").option("lowerBound", low).option("upperBound", high)
    return reader.option("numPartitions", parts).options(**options).load()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def feature_columns(windows: DataFrame) -> list[str]:
    """Feature names in order: all columns but the keys and labels."""
    skipped = {*META_COLUMNS, "window_start", "split"}
    return [c for c in windows.columns if c not in skipped]


def write_manifest(windows: DataFrame, path: str) -> None:
    names = list(enumerate(feature_columns(windows)))
    table = windows.sparkSession.createDataFrame(names, "position int, feature string")
    table.coalesce(1).write.mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    return [r.feature for r in spark.read.parquet(path).orderBy("position").collect()]


def write_sample(windows: DataFrame, path: str, rows: int = 500) -> None:
    """First windows in key order as CSV, for inspection."""
    write_csv(windows.orderBy("instance_file", "window_start").limit(rows), path)


def export_telemetry(view: DataFrame, path: str, columns: Sequence[str] = FEED_COLUMNS) -> None:
    """Visible columns of a flattened view as CSV."""
    write_csv(view.select(*[col(c) for c in columns if c in view.columns]), path)


def read_report(spark: SparkSession, path: str, schema: str, top: int | None = None) -> DataFrame:
    """A leaderboard or importance table; the first ``top`` lines of a ranked one."""
    report = spark.read.option("header", "true").schema(schema).csv(path)
    return report if top is None else report.orderBy("Rank").limit(top)
