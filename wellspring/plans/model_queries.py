"""Queries that fit models.

A fitted model's numbers cannot be foretold by SQL, so these queries return what must hold
whatever was learned: supports by class and side, and that probabilities, shares, ranks and
decisions fit together. The ``..._report`` queries return the numbers themselves; they have no
SQL and are tested against plain metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.operators import evidence, isolation, metrics, models
from wellspring.operators import telemetry as views
from wellspring.plans import training
from wellspring.plans.registry import query
from wellspring.plans.window_queries import features
from wellspring.session import materialise, scratch_path
from wellspring.sources.testtables import telemetry


def dataset(spark, sf_dir):
    return training.build_dataset(features(spark, sf_dir))


def judged(predicted: DataFrame, label: str) -> DataFrame:
    """Per true class: rows by the confusion matrix, and whether probabilities and predictions agree."""
    rows = metrics.confusion_matrix(predicted, label, "prediction").groupBy("label").agg(F.sum("n").alias("support"))
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    chosen = F.element_at("probability", F.col("prediction") + 1)
    sound = predicted.groupBy(F.col(label).alias("label")).agg(
        F.bool_and(F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.bool_and(chosen == F.array_max("probability")).alias("most_likely"),
    )
    return rows.join(sound, "label")


def forest_checks(data: training.Dataset, label: str) -> DataFrame:
    model = models.fit(data.train, training.FEATURES, label)
    return judged(materialise(models.predict(model, data.test, training.FEATURES), "predictions"), label)


@query
def random_forest_binary(spark, sf_dir):
    return forest_checks(dataset(spark, sf_dir), "binary_target")


@query
def random_forest_multiclass(spark, sf_dir):
    return forest_checks(dataset(spark, sf_dir), "multiclass")


@query
def feature_importance(spark, sf_dir):
    """Every feature by rank: importances fall and sum to 1."""
    model = models.fit(dataset(spark, sf_dir).train, training.FEATURES, "binary_target")
    table = models.feature_importance(model, training.FEATURES, spark)
    before = F.lag("importance").over(Window.orderBy("rank"))
    every = Window.partitionBy()
    return table.select(
        "rank",
        (F.coalesce(before, F.lit(1.0)) >= F.col("importance")).alias("falling"),
        F.round(F.sum("importance").over(every), 6).alias("total"),
        F.size(F.collect_set("feature").over(every)).alias("features"),
    )


@query
def isolation_forest(spark, sf_dir):
    """Test windows per side, and whether the asked share of the normal training windows is flagged.

    Equal scores on the threshold are not flagged: those above it must be no more than the share,
    and those on it or above no fewer.
    """
    data = dataset(spark, sf_dir)
    normal = data.train.filter("binary_target = 0")
    forest = isolation.fit_isolation_forest(normal, training.FEATURES, training.KEY)
    above = F.col("anomaly_score") > forest.threshold
    flagged = forest.score(normal, ["binary_target"]).agg(
        F.avg("anomaly").alias("share"), F.avg(above.cast("double")).alias("above"),
        F.avg((F.col("anomaly_score") >= forest.threshold).cast("double")).alias("from_threshold"), F.count(F.lit(1)).alias("n"),
    )
    scored = forest.score(data.test, ["binary_target"]).groupBy("binary_target").agg(
        F.count(F.lit(1)).alias("support"), F.bool_and(F.col("anomaly_score").between(0, 1)).alias("in_range")
    )
    one, asked = 1 / F.col("n"), isolation.CONTAMINATION
    as_asked = (F.col("share") == F.col("above")) & (F.col("above") <= asked + one) & (F.col("from_threshold") >= asked - one)
    return scored.join(F.broadcast(flagged)).select("binary_target", "support", "in_range", as_asked.alias("share_as_asked"))


@query
def model_comparison(spark, sf_dir):
    """All kinds on both tasks, and whether their metrics are shares."""
    data = dataset(spark, sf_dir)
    table = models.model_comparison(data.train, data.test, training.FEATURES)
    numbers = ["accuracy", "precision", "recall", "f1", "macro_f1"]
    shares = F.array(*numbers, F.coalesce("roc_auc", F.lit(0.0)))
    return table.select(
        "task", "model", F.forall(shares, lambda x: x.between(0, 1)).alias("are_shares"),
        F.col("roc_auc").isNotNull().alias("has_auc"),
    )


@query
def well_disjoint_evaluation(spark, sf_dir):
    data = training.build_dataset(features(spark, sf_dir), "well_id")
    tasks = [forest_checks(data, label).withColumn("task", F.lit(label)) for label in models.TASKS]
    return tasks[0].unionByName(tasks[1])


@query
def scored_telemetry(spark, sf_dir):
    """Every stored record scored as a snapshot by both forests, and whether the fused decision fits the scores."""
    data = dataset(spark, sf_dir)
    fitted = models.train_models(data.train, training.FEATURES, data.medians)
    parsed = views.parse_payload(telemetry(spark, sf_dir))
    snapshots = views.snapshot_features(parsed, keep=["id", "device_id"])
    decided = evidence.fuse_decision(models.score(snapshots, fitted))
    found = (F.col("binary_status") == "FAULT") | (F.col("predicted_event_id") > 0)
    chances = F.aggregate(F.map_values("class_probabilities"), F.lit(0.0), lambda a, x: a + x)
    surer = F.when(F.col("predicted_event_id") > 0, F.greatest("binary_confidence", "multiclass_confidence"))
    return decided.select(
        "id",
        F.col("device_id").alias("well_id"),
        ((F.col("status") == "anomaly") == found).alias("status_fits"),
        ((F.col("predicted_event") == evidence.NORMAL_EVENT) | found).alias("event_fits"),
        (F.abs(F.coalesce(surer, "binary_confidence") - F.col("confidence")) < 1e-9).alias("confidence_fits"),
        (F.abs(chances - 1) < 1e-3).alias("sums_to_one"),
    )


@query
def binary_forest_report(spark, sf_dir):
    """Precision, recall and F1 by side, accuracy, means, and recall by phase of the fault."""
    return training.evaluate_forest(dataset(spark, sf_dir), "binary_target")


@query
def multiclass_forest_report(spark, sf_dir):
    return training.evaluate_forest(dataset(spark, sf_dir), "multiclass")


@query
def isolation_forest_report(spark, sf_dir):
    """The unsupervised detector against the test faults."""
    return training.evaluate_isolation_forest(dataset(spark, sf_dir))


@query
def top_importances(spark, sf_dir):
    """The twenty features that matter most to the binary forest, by name."""
    data = dataset(spark, sf_dir)
    fitted = models.FaultModels(training.FEATURES, data.medians, models.fit(data.train, training.FEATURES, "binary_target"), None)
    return models.top_features(models.model_importance(fitted, spark))


@query
def model_comparison_report(spark, sf_dir):
    """All kinds on both tasks with their metrics; training times vary, so they are left out."""
    data = dataset(spark, sf_dir)
    return models.model_comparison(data.train, data.test, training.FEATURES).drop("training_seconds")


@query
def well_disjoint_report(spark, sf_dir):
    """Both tasks on wells that training has not seen."""
    return training.well_disjoint_evaluation(features(spark, sf_dir))


@query
def telemetry_decisions(spark, sf_dir):
    """What the models decide for every stored record."""
    data = dataset(spark, sf_dir)
    fitted = models.train_models(data.train, training.FEATURES, data.medians)
    snapshots = views.snapshot_features(views.parse_payload(telemetry(spark, sf_dir)), keep=["id", "device_id"])
    decided = evidence.fuse_decision(models.score(snapshots, fitted))
    return decided.select("id", "device_id", "status", "predicted_event_id", "predicted_event", "confidence", "binary_status",
                          "binary_confidence", "multiclass_confidence", F.to_json("class_probabilities").alias("class_probabilities"))


@query
def feature_tables(spark, sf_dir):
    """The full, train and test tables as written and read back: windows and sums of their labels by folder."""
    path = scratch_path(spark, "feature-tables")
    training.write_feature_tables(dataset(spark, sf_dir), path)
    tables = [spark.read.parquet(f"{path}/{name}").withColumn("name", F.lit(name)) for name in ("full", "train", "test")]
    rows = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return rows.groupBy("name", F.col("event_folder").cast("string").alias("event_folder")).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("raw_class").alias("raw_classes"), F.sum("binary_target").alias("faults")
    )
