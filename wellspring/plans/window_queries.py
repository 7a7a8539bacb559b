"""Queries over sensor recordings."""

from __future__ import annotations

from wellspring.constants import PRIMARY_SENSORS
from wellspring.operators.cleaning import DAY, causal_ffill, sanitize
from wellspring.operators.windows import window_features
from wellspring.plans.registry import query, rounded
from wellspring.sources.testtables import recordings

ORDER = ("ts", "event_id")


def features(spark, sf_dir, window_seconds=DAY, ffill_limit=3):
    return window_features(recordings(spark, sf_dir), window_seconds=window_seconds,
                           ffill_limit=ffill_limit, order=ORDER)


@query
def feature_windows(spark, sf_dir):
    return rounded(features(spark, sf_dir), 4)


@query
def feature_windows_6h(spark, sf_dir):
    return rounded(features(spark, sf_dir, 6 * 3600, 60), 4)


@query
def sanitize_readings(spark, sf_dir):
    return sanitize(recordings(spark, sf_dir), PRIMARY_SENSORS)


@query
def causal_forward_fill(spark, sf_dir):
    clean = sanitize(recordings(spark, sf_dir), PRIMARY_SENSORS)
    return causal_ffill(clean, PRIMARY_SENSORS, limit=2, order=ORDER).drop("slice", "position")
