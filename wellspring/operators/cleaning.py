"""Cleaning of raw sensor readings and derivation of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.constants import FEATURE_CLIP, OTHER_RANGE, PHYSICAL_RANGES
from wellspring.functions.values import col

DAY = 86_400


def physical_range(sensor: str) -> tuple[float, float]:
    for prefixes, low, high in PHYSICAL_RANGES:
        if sensor.startswith(prefixes):
            return low, high
    return OTHER_RANGE


def sanitize(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Null out NaN and physically impossible readings."""
    bounds = {s: physical_range(s) for s in sensors if s in df.columns}
    # NaN sorts above every number, so the upper bound removes it as well.
    cleaned = [
        f"CASE WHEN `{s}` BETWEEN {low}D AND {high}D THEN CAST(`{s}` AS DOUBLE) END AS `{s}`"
        for s, (low, high) in bounds.items()
    ]
    others = [f"`{c}`" for c in df.columns if c not in bounds]
    return df.selectExpr(*others, *cleaned)


def causal_ffill(
    df: DataFrame,
    sensors: Sequence[str],
    limit: int = 60,
    key: Sequence[str] = ("instance_file",),
    order: Sequence[str] = ("ts",),
    slice_seconds: int | None = DAY,
) -> DataFrame:
    """Carry the last reading forward over at most ``limit`` rows of its recording.

    Rows are grouped by recording *and* time slice, so a very long recording is
    spread over many tasks. What a slice inherits from the earlier ones (last
    reading of each sensor and its row position) comes from a summary with one row
    per slice; the result equals the fill over the unsliced recording. With
    ``slice_seconds=None`` each recording is one group, which saves the summary for
    recordings known to be short. The output also has ``position`` (row number in
    the recording) and ``slice``, so that later grouping can reuse the partitioning.
    """
    others = [f"`{c}`" for c in df.columns if c not in sensors]
    by, sort = ", ".join(key), ", ".join(order)
    near = "last(`{s}`, true) OVER (PARTITION BY {by} ORDER BY {sort} ROWS BETWEEN {limit} PRECEDING AND CURRENT ROW)"
    if slice_seconds is None:
        return df.selectExpr(
            *others,
            f"row_number() OVER (PARTITION BY {by} ORDER BY {sort}) AS position",
            *[f"{near.format(s=s, by=by, sort=sort, limit=limit)} AS `{s}`" for s in sensors],
        )

    sliced = df.withColumn("slice", F.window(order[0], f"{slice_seconds} seconds")["start"])
    in_slice = f"{by}, slice"
    rows = sliced.selectExpr(
        *others,
        "slice",
        f"row_number() OVER (PARTITION BY {in_slice} ORDER BY {sort}) AS row_in_slice",
        *[f"`{s}`" for s in sensors],
        *[f"{near.format(s=s, by=in_slice, sort=sort, limit=limit)} AS `{s}_near`" for s in sensors],
    )
    ends = rows.groupBy(*key, "slice").agg(
        F.max("row_in_slice").alias("rows"),
        *[
            F.expr(f"max(CASE WHEN `{s}` IS NOT NULL THEN struct(row_in_slice AS row, `{s}` AS reading) END) AS `{s}`")
            for s in sensors
        ],
    )
    earlier = f"OVER (PARTITION BY {by} ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    placed = ends.selectExpr("*", f"coalesce(sum(rows) {earlier}, 0) AS rows_before")
    inherited = placed.selectExpr(
        *key,
        "slice",
        "rows_before",
        *[
            f"last(CASE WHEN `{s}` IS NOT NULL THEN struct(rows_before + `{s}`.row AS position, "
            f"`{s}`.reading AS reading) END, true) {earlier} AS `{s}_carry`"
            for s in sensors
        ],
    )
    # Only a row without a reading nearby can need the inherited one; rows deeper
    # than ``limit`` in their slice fail the distance test by themselves.
    position = "rows_before + row_in_slice"
    # The readings already lie, sorted, by recording and slice: only the summary moves.
    return rows.join(inherited.hint("merge"), [*key, "slice"]).selectExpr(
        *others,
        "slice",
        f"{position} AS position",
        *[
            f"coalesce(`{s}_near`, CASE WHEN {position} - `{s}_carry`.position <= {limit} "
            f"THEN `{s}_carry`.reading END) AS `{s}`"
            for s in sensors
        ],
    )


def causal_ffill_seconds(
    df: DataFrame,
    sensors: Sequence[str],
    limit_seconds: int = 60,
    key: Sequence[str] = ("instance_file",),
    ts: str = "ts",
) -> DataFrame:
    """Carry the last reading forward for at most ``limit_seconds`` of time."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    frame = (
        Window.partitionBy(*key)
        .orderBy(seconds)
        .rangeBetween(-limit_seconds * 1_000_000, 0)
    )
    return df.withColumns({s: F.last(col(s), True).over(frame) for s in sensors})


def clip_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Bound the features; NULL stays NULL."""
    low, high = FEATURE_CLIP
    others = [f"`{c}`" for c in df.columns if c not in features]
    return df.selectExpr(
        *others,
        *[
            f"CASE WHEN `{f}` < {low}D THEN {low}D WHEN `{f}` > {high}D THEN {high}D ELSE `{f}` END AS `{f}`"
            for f in features
        ],
    )


def to_float32(df: DataFrame, features: Sequence[str]) -> DataFrame:
    others = [f"`{c}`" for c in df.columns if c not in features]
    return df.selectExpr(*others, *[f"CAST(`{f}` AS FLOAT) AS `{f}`" for f in features])


def is_transient(raw_class: Column) -> Column:
    return (raw_class >= 100).cast("int")


def base_event(raw_class: Column) -> Column:
    """Transient classes 100+k count as event k."""
    return F.when(raw_class >= 100, raw_class - 100).otherwise(raw_class).cast("int")


def binary_target(raw_class: Column) -> Column:
    return (raw_class > 0).cast("int")


def with_targets(df: DataFrame) -> DataFrame:
    raw = F.col("raw_class")
    return df.withColumns(
        {
            "is_transient": is_transient(raw),
            "multiclass": base_event(raw),
            "binary_target": binary_target(raw),
        }
    )


def drop_unannotated(df: DataFrame) -> DataFrame:
    return df.filter(F.col("raw_class").isNotNull())


def drop_empty(df: DataFrame, sensors: Sequence[str]) -> DataFrame:
    """Remove windows in which no sensor has a mean."""
    return df.filter(F.coalesce(*[col(f"{s}_mean") for s in sensors]).isNotNull())
