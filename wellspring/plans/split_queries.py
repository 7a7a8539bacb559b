"""Queries over splits, imputation, metrics, recordings and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.constants import PRIMARY_SENSORS
from wellspring.functions.values import col
from wellspring.operators import imputation, metrics, reports, splits
from wellspring.operators.cleaning import DAY, causal_ffill_seconds, clip_features, sanitize, to_float32
from wellspring.operators.windows import feature_names, window_features
from wellspring.plans.registry import query, rounded
from wellspring.plans.window_queries import ORDER, features
from wellspring.session import materialise
from wellspring.sources import messages as msg
from wellspring.sources import recordings as rec
from wellspring.sources.testtables import events, predictions, recordings, spread_telemetry, telemetry

FEATURES = feature_names()
EVEN_SENSORS, ODD_SENSORS = PRIMARY_SENSORS[:8], PRIMARY_SENSORS[4:-1]  # with sensors that one part lacks


def labelled(spark, sf_dir):
    """Keys and labels of the windows; the unused statistics are pruned away."""
    return features(spark, sf_dir).select(
        "instance_file", "well_id", "event_folder", "window_start", "raw_class", "is_transient", "multiclass",
        "binary_target")


def stored_labels(spark, sf_dir):
    """The same, computed once for the jobs that read it several times."""
    return materialise(labelled(spark, sf_dir), "labels")


def split_windows(spark, sf_dir):
    windows = stored_labels(spark, sf_dir)
    return splits.with_split(windows, splits.stratified_instance_split(windows))


@query
def class_distribution(spark, sf_dir):
    return rounded(reports.class_distribution(labelled(spark, sf_dir)), 6)


@query
def phase_breakdown(spark, sf_dir):
    return rounded(reports.phase_breakdown(labelled(spark, sf_dir)), 6)


@query
def dedup_instances(spark, sf_dir):
    return splits.dedup_instances(labelled(spark, sf_dir))


@query
def stratified_instance_split(spark, sf_dir):
    return splits.stratified_instance_split(stored_labels(spark, sf_dir))


@query
def group_split(spark, sf_dir):
    return splits.group_split(stored_labels(spark, sf_dir))


@query
def rows_of_instances(spark, sf_dir):
    windows = stored_labels(spark, sf_dir)
    test = splits.stratified_instance_split(windows).filter("split = 'test'")
    return splits.rows_of_instances(windows, test)


@query
def split_audit(spark, sf_dir):
    return rounded(splits.split_audit(split_windows(spark, sf_dir)), 6)


@query
def well_overlap(spark, sf_dir):
    return splits.well_overlap(split_windows(spark, sf_dir))


@query
def present_classes(spark, sf_dir):
    return splits.present_classes(split_windows(spark, sf_dir))


@query
def class_support(spark, sf_dir):
    return reports.class_support(split_windows(spark, sf_dir))


@query
def class_weights(spark, sf_dir):
    return rounded(imputation.class_weights(labelled(spark, sf_dir), "multiclass"), 6)


def feature_split(spark, sf_dir):
    """Windows with their side, stored: each pass over them would rank and join the recordings anew."""
    windows = materialise(features(spark, sf_dir), "features")
    return materialise(splits.with_split(windows, splits.stratified_instance_split(windows)), "split-features")


@query
def imputer_medians(spark, sf_dir):
    train = feature_split(spark, sf_dir).filter("split = 'train'")
    return rounded(imputation.medians_table(train, imputation.fit_medians(train, FEATURES)), 4)


@query
def impute_features(spark, sf_dir):
    windows = feature_split(spark, sf_dir)
    medians = imputation.fit_medians(windows.filter("split = 'train'"), FEATURES)
    filled = imputation.apply_medians(windows, FEATURES, medians)
    return rounded(filled.select("instance_file", "window_start", "split", *[col(f) for f in FEATURES]), 4)


@query
def features_float32(spark, sf_dir):
    windows = to_float32(features(spark, sf_dir), FEATURES)
    return windows.select("instance_file", "window_start", *[col(f) for f in FEATURES])


@query
def clip_features_query(spark, sf_dir):
    factors = [40 if i % 2 else -30 for i in range(len(PRIMARY_SENSORS))]
    scaled = recordings(spark, sf_dir).selectExpr(
        "event_id", *[f"nanvl(`{s}` * {k}, NULL) AS `{s}`" for s, k in zip(PRIMARY_SENSORS, factors)])
    return rounded(clip_features(scaled, PRIMARY_SENSORS), 4)


@query
def feature_manifest(spark, sf_dir):
    """Features in order with the number of windows that know them."""
    windows = features(spark, sf_dir)
    counts = windows.agg(*[F.count(col(f)).alias(f) for f in FEATURES])
    cells = ", ".join(f"{i}, '{f}', `{f}`" for i, f in enumerate(FEATURES))
    return counts.selectExpr(f"stack({len(FEATURES)}, {cells}) AS (position, feature, known)")


@query
def feature_sample(spark, sf_dir):
    windows = features(spark, sf_dir).select("instance_file", "window_start", "raw_class", *[col(f) for f in FEATURES])
    return rounded(windows.orderBy("instance_file", "window_start").limit(500), 4)


@query
def sliding_windows(spark, sf_dir):
    return rounded(window_features(recordings(spark, sf_dir), PRIMARY_SENSORS, DAY, 3, ORDER, slide_seconds=DAY // 4), 4)


@query
def ffill_by_time(spark, sf_dir):
    clean = sanitize(recordings(spark, sf_dir), PRIMARY_SENSORS)
    return causal_ffill_seconds(clean, PRIMARY_SENSORS, DAY).select("event_id", *[col(s) for s in PRIMARY_SENSORS])


@query
def confusion_matrix_binary(spark, sf_dir):
    return metrics.confusion_matrix(predictions(spark, sf_dir), "binary_target", "binary_pred")


@query
def confusion_matrix_multiclass(spark, sf_dir):
    return metrics.confusion_matrix(predictions(spark, sf_dir), "multiclass", "multi_pred")


@query
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(predictions(spark, sf_dir), "multiclass", "multi_pred"), 6)


@query
def classification_report_binary(spark, sf_dir):
    return rounded(metrics.classification_report(predictions(spark, sf_dir), "binary_target", "binary_pred"), 6)


@query
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(predictions(spark, sf_dir), "binary_target", "score"), 6)


@query
def phase_metrics_binary(spark, sf_dir):
    return rounded(metrics.phase_metrics(predictions(spark, sf_dir), "binary_target", "binary_pred"), 6)


@query
def phase_metrics_multiclass(spark, sf_dir):
    return rounded(metrics.phase_metrics(predictions(spark, sf_dir), "multiclass", "multi_pred"), 6)


@query
def recording_keys(spark, sf_dir):
    paths = recordings(spark, sf_dir).select(
        "event_id", F.concat(F.lit("/data/"), "event_folder", F.lit("/"), "instance_file").alias("path"))
    return paths.select("event_id", *[c.alias(n) for n, c in rec.recording_keys(F.col("path")).items()])


@query
def label_fallback(spark, sf_dir):
    rows = recordings(spark, sf_dir).select("event_id", "class", "event_folder")
    odd = rows.withColumn("event_folder", F.when(F.col("event_folder") == "7", "x").otherwise(F.col("event_folder")))
    return rec.label_fallback(odd, F.col("event_id") % 3 == 0)


@query
def timestamp_parsing(spark, sf_dir):
    text = events(spark, sf_dir).select("event_id", F.col("ts").cast("string").alias("timestamp"))
    return rec.with_time(text)


@query
def first_recording_per_event(spark, sf_dir):
    return rec.first_recording_per_event(recordings(spark, sf_dir))


@query
def concat_recordings(spark, sf_dir):
    rows = recordings(spark, sf_dir)
    even = rows.filter("event_id % 2 = 0").select("event_id", "class", *[col(s) for s in EVEN_SENSORS])
    odd = rows.filter("event_id % 2 = 1").select("event_id", "ts", *[col(s) for s in ODD_SENSORS])
    return rec.concat_recordings([even, odd])


@query
def recording_to_messages(spark, sf_dir):
    sent = rec.recording_to_messages(recordings(spark, sf_dir), PRIMARY_SENSORS, 5, ORDER)
    read = {"device_id": "device_id", "ground_truth_class": "label", "recording_file": "recording_file"}
    fields = [F.get_json_object("payload", f"$.{key}").alias(name) for key, name in read.items()]
    readings = [F.round(F.get_json_object("payload", f"$.{s}").cast("double"), 4).alias(s) for s in PRIMARY_SENSORS]
    return sent.select("topic", "instance_file", "record", *fields, *readings)


def raw_messages(spark, sf_dir):
    """Published messages, some of them cut off, without device or on another topic."""
    rows = spread_telemetry(spark, sf_dir)
    body = F.to_json(F.struct(
        F.when(F.col("id") % 17 != 0, F.col("device_id")).alias("device_id"), "device_type",
        F.col("timestamp").cast("string").alias("timestamp"), "fault", "sensor_data"))
    topic = F.concat(F.when(F.col("id") % 11 == 0, "office/").otherwise("factory/"), F.lower("device_type"),
                     F.lit("/"), F.col("device_id"), F.lit("/telemetry"))
    sent = rows.select("id", topic.alias("topic"), body.alias("body"))
    return sent.selectExpr("id", "topic", "CASE WHEN id % 13 = 0 THEN left(body, 30) ELSE body END AS payload")


@query
def topic_filter(spark, sf_dir):
    return msg.topic_filter(raw_messages(spark, sf_dir)).select("id", "topic_type", "topic_device")


@query
def decode_messages(spark, sf_dir):
    decoded = msg.decode_messages(raw_messages(spark, sf_dir))
    return decoded.select("id", "device_id", "device_type", "timestamp", "fault", "reject")


@query
def dead_letters(spark, sf_dir):
    decoded = msg.decode_messages(msg.topic_filter(raw_messages(spark, sf_dir)))
    return msg.dead_letters(decoded).select("id", "device_id", "reject")
