"""From recordings to split, imputed feature tables, models and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.operators import imputation, isolation, metrics, models, splits
from wellspring.operators.cleaning import to_float32
from wellspring.operators.windows import feature_names
from wellspring.session import materialise

FEATURES = feature_names()
KEY = ["instance_file", "window_start"]


@dataclass
class Dataset:
    """Split windows, imputed with the training medians."""

    windows: DataFrame
    medians: dict[str, float | None]

    @property
    def train(self) -> DataFrame:
        return self.windows.filter("split = 'train'")

    @property
    def test(self) -> DataFrame:
        return self.windows.filter("split = 'test'")


def build_dataset(windows: DataFrame, by: str = "instance_file") -> Dataset:
    """Split feature windows by recording (stratified) or by well, and impute them.

    The features are computed once and stored; split, medians and fits read that table.
    """
    stored = materialise(windows, "features")
    if by == "instance_file":
        sides = splits.stratified_instance_split(stored)
    else:
        sides = splits.group_split(stored, by)
    sided = materialise(splits.with_split(stored, sides, by), "split-features")
    medians = imputation.fit_medians(sided.filter("split = 'train'"), FEATURES)
    return Dataset(imputation.apply_medians(sided, FEATURES, medians), medians)


def write_feature_tables(dataset: Dataset, path: str) -> None:
    """Full, train and test tables as float32, partitioned by event folder."""
    table = to_float32(dataset.windows, FEATURES)
    for name, part in (("full", table), ("train", table.filter("split = 'train'")), ("test", table.filter("split = 'test'"))):
        part.drop("split").write.mode("overwrite").partitionBy("event_folder").parquet(f"{path}/{name}")


def evaluate(predicted: DataFrame, label: str) -> DataFrame:
    """Report lines with the scores by fault phase appended."""
    report = metrics.classification_report(predicted, label, "prediction")
    phases = metrics.phase_metrics(predicted, label, "prediction")
    lines = phases.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"{phase} faults").alias("name"),
                        F.lit(None).cast("double").alias("precision"),
                        F.col(f"{phase}_score").alias("recall"),
                        F.lit(None).cast("double").alias("f1"),
                        F.col(f"{phase}_support").alias("support"),
                    )
                    for phase in ("transient", "established")
                ]
            )
        )
    )
    return report.unionByName(lines)


def evaluate_forest(dataset: Dataset, label: str) -> DataFrame:
    model = models.fit(dataset.train, FEATURES, label)
    return evaluate(materialise(models.predict(model, dataset.test, FEATURES), "predictions"), label)


def evaluate_isolation_forest(dataset: Dataset) -> DataFrame:
    """Unsupervised detector, fitted on normal training windows, against the test faults."""
    forest = isolation.fit_isolation_forest(dataset.train.filter("binary_target = 0"), FEATURES, KEY)
    scored = forest.score(dataset.test, ["binary_target"])
    return metrics.classification_report(materialise(scored, "anomalies"), "binary_target", "anomaly")


def well_disjoint_evaluation(windows: DataFrame) -> DataFrame:
    """Both tasks with whole wells held out."""
    dataset = build_dataset(windows, "well_id")
    tasks = [evaluate_forest(dataset, label).withColumn("task", F.lit(label)) for label in models.TASKS]
    return tasks[0].unionByName(tasks[1])
