"""Labelled time-window features."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.constants import PRIMARY_SENSORS, STATISTICS
from wellspring.functions.values import col
from wellspring.operators.cleaning import (
    DAY,
    causal_ffill,
    clip_features,
    drop_empty,
    drop_unannotated,
    sanitize,
    with_targets,
)

KEYS = ["instance_file", "well_id", "event_folder"]


def feature_names(sensors: Sequence[str] = PRIMARY_SENSORS) -> list[str]:
    """Feature columns, one block of sensors per statistic."""
    return [f"{sensor}_{statistic}" for statistic in STATISTICS for sensor in sensors]


def window_statistics(
    readings: DataFrame, keys: Sequence[str], sensors: Sequence[str], order: str, approximate_median: bool = False
) -> DataFrame:
    """One row per group of ``keys``: these, ``raw_class`` (if there is a class), ``readings`` and the seven
    statistics of each sensor.

    The readings are placed by the first and the last key and sorted by the keys and ``order``; numpy goes over the
    groups of a batch at once. As aggregates the statistics are many buffers and an exact median's map a sensor for
    every group, which costs far more than the readings when windows are short. ``approximate_median`` takes the
    lower of two middle readings instead of their mean.
    """
    label = ["class"] if "class" in readings.columns else []
    kinds = {f.name: f.dataType for f in readings.schema}
    lists = [k for k in keys if isinstance(kinds[k], T.ArrayType)]
    rows = readings.select(
        *keys, *[F.to_json(k).alias(f"_{k}") for k in lists], *[F.col(c).cast("double").alias(c) for c in label],
        order, *[col(s).cast("double").alias(s) for s in sensors],
    )
    placed = rows.repartition(keys[0], keys[-1]).sortWithinPartitions(*keys, order)
    compared = [f"_{k}" if k in lists else k for k in keys]
    names = [f"{s}_{statistic}" for s in sensors for statistic in STATISTICS]
    schema = T.StructType([T.StructField(k, kinds[k]) for k in keys])
    for name in ["raw_class"] * len(label) + ["readings"] + names:
        schema = schema.add(name, "long" if name == "readings" else "double")

    def aggregated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, compared):
            starts = _group_starts(batch, compared)
            sizes = np.diff(np.append(starts, batch.num_rows))
            group = np.repeat(np.arange(len(starts)), sizes)
            columns = [batch.column(k).take(pa.array(starts)) for k in keys]
            columns += [_group_values(batch.column(c), group, len(starts), False)["max"] for c in label]
            columns.append(pa.array(sizes, pa.int64()))
            for sensor in sensors:
                found = _group_values(batch.column(sensor), group, len(starts), approximate_median)
                columns += [found[statistic] for statistic in STATISTICS]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return placed.mapInArrow(aggregated, schema)


def _group_starts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """First row of each run of equal keys; nulls are equal."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for key in keys:
        codes = batch.column(key).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition in batches that cut no group; at most one group is kept back."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _group_starts(batch, keys)
        if held and [batch.column(k)[0].as_py() for k in keys] == last:
            starts = starts[1:]
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
        if len(starts):
            whole = [*held, batch.slice(0, starts[-1])]
            if sum(b.num_rows for b in whole):
                yield pa.concat_batches(whole)
            held = []
            batch = batch.slice(starts[-1])
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _group_values(values: pa.Array, group: np.ndarray, groups: int, lower_median: bool) -> dict[str, pa.Array]:
    """Statistics of the readings of each group, which come sorted by time; null without a reading, but for std and trend."""
    known = values.is_valid().to_numpy(zero_copy_only=False)
    x, of = values.to_numpy(zero_copy_only=False)[known], group[known]
    count = np.bincount(of, minlength=groups)
    some = count > 0
    n = count[some]
    first = np.cumsum(n) - n
    out = {}
    if len(x):
        mean = np.add.reduceat(x, first) / n
        away = x - np.repeat(mean, n)
        low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
        ranked = x[np.lexsort((x, of))]
        below, above = ranked[first + (n - 1) // 2], ranked[first + n // 2]
        out = {
            "mean": mean, "std": np.sqrt(np.add.reduceat(away * away, first) / np.maximum(n - 1, 1)), "min": low, "max": high,
            "median": below if lower_median else 0.5 * below + 0.5 * above, "range": high - low, "trend": x[first + n - 1] - x[first],
        }
    found = {}
    for statistic in STATISTICS:
        full = np.zeros(groups)
        if out:
            full[some] = out[statistic]
        found[statistic] = pa.array(full, mask=None if statistic in ("std", "trend") else ~some)
    return found


def blank_absent(df: DataFrame, sensors: Sequence[str], available: Column) -> DataFrame:
    """Null all features of sensors that the recording's file does not contain.

    ``available`` is an array of sensor names per row. A sensor present in the file
    but without readings keeps std = trend = 0.
    """
    return df.withColumns(
        {
            f"{s}_{statistic}": F.when(F.array_contains(available, s), col(f"{s}_{statistic}"))
            for s in sensors
            for statistic in ("std", "trend")
        }
    )


def from_first_day(df: DataFrame, ts: str, window_seconds: int, slide_seconds: int | None = None) -> DataFrame:
    """Windows counted from the midnight before a recording's first row, also overlapping ones.

    The same as counting from 1970 when length and slide divide a day.
    """
    slide = min(slide_seconds or window_seconds, window_seconds)
    first = df.groupBy("instance_file").agg(F.date_trunc("day", F.min(ts)).cast("timestamp_ntz").alias("first_day"))
    gone = f"timestampdiff(MICROSECOND, first_day, CAST(`{ts}` AS TIMESTAMP_NTZ))"
    placed = df.join(first, "instance_file").withColumn("window_no", F.expr(f"floor({gone} / {slide * 1_000_000})"))
    if slide < window_seconds:
        earlier = F.explode_outer(F.array(*[F.lit(k) for k in range(-(-window_seconds // slide))]))
        placed = placed.withColumn("earlier", earlier).withColumn("window_no", F.col("window_no") - F.col("earlier"))
        placed = placed.filter(F.expr(f"{gone} < (window_no * {slide} + {window_seconds}) * 1000000")).drop("earlier")
    start = F.expr(f"timestampadd(SECOND, CAST(window_no * {slide} AS INT), first_day)")
    return placed.withColumn("window_start", start).drop("first_day", "window_no")


def window_features(
    recordings: DataFrame,
    sensors: Sequence[str] = PRIMARY_SENSORS,
    window_seconds: int = 60,
    ffill_limit: int | None = None,
    order: Sequence[str] = ("ts",),
    slice_seconds: int | None = DAY,
    approximate_median: bool = False,
    slide_seconds: int | None = None,
) -> DataFrame:
    """Raw recordings to labelled feature windows.

    The readings are shuffled by recording and time slice for the fill, and by recording
    and window for the statistics. ``slide_seconds`` gives overlapping windows.
    """
    limit = window_seconds if ffill_limit is None else ffill_limit
    if slice_seconds is not None:
        slice_seconds = -(-slice_seconds // window_seconds) * window_seconds
    present = [s for s in sensors if s in recordings.columns]
    needed = [*KEYS, *order, "class"]
    extra = ["available_sensors"] if "available_sensors" in recordings.columns else []
    clean = sanitize(recordings.select(*needed, *extra, *[col(s) for s in present]), present)
    filled = causal_ffill(clean, present, limit, order=order, slice_seconds=slice_seconds)

    if DAY % window_seconds == 0 and DAY % (slide_seconds or window_seconds) == 0:
        grid = F.window(order[0], f"{window_seconds} seconds", f"{slide_seconds or window_seconds} seconds")
        placed = filled.withColumn("window_start", grid["start"])
    else:
        placed = from_first_day(filled, order[0], window_seconds, slide_seconds)
    aggregated = window_statistics(placed, [*KEYS, *extra, "window_start"], present, "position", approximate_median)
    aggregated = aggregated.withColumn("raw_class", F.col("raw_class").cast("int"))
    if extra:
        aggregated = blank_absent(aggregated, present, F.col("available_sensors"))
    labelled = with_targets(drop_empty(drop_unannotated(aggregated), present))
    features = feature_names(present)
    return clip_features(labelled, features).select(
        *KEYS,
        "window_start",
        "raw_class",
        "is_transient",
        "multiclass",
        "binary_target",
        *[col(f) for f in features],
    )


def window_features_online(
    readings: DataFrame,
    sensors: Sequence[str] = PRIMARY_SENSORS,
    window_seconds: int = 60,
    limit: int = 60,
    key: Sequence[str] = ("device_id",),
    order: Sequence[str] = ("ts",),
) -> DataFrame:
    """Features of each window on its own: the fill does not look into earlier windows.

    A sensor without readings in the window gives NULL for all statistics.
    """
    present = [s for s in sensors if s in readings.columns]
    clean = sanitize(readings.select(*key, *order, *[col(s) for s in present]), present)
    gridded = clean.withColumn("window_start", F.window(order[0], f"{window_seconds} seconds")["start"])
    filled = causal_ffill(gridded, present, limit, [*key, "window_start"], order, slice_seconds=None)
    aggregated = window_statistics(filled, [*key, "window_start"], present, "position")
    return aggregated.selectExpr(
        *key,
        "window_start",
        "readings",
        *[
            f"CASE WHEN `{s}_mean` IS NOT NULL THEN `{s}_{statistic}` END AS `{s}_{statistic}`"
            for statistic in STATISTICS
            for s in present
        ],
    )
