"""Classifiers on feature windows (Spark ML), their scores and importances."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from wellspring.functions.values import col
from wellspring.operators import imputation, metrics
from wellspring.operators.forest import Forest, fit_forest
from wellspring.operators.telemetry import event_name
from wellspring.session import ensure_checkpoint_dir

TREES, DEPTH, SEED = 80, 14, 42
ITERATIONS = 100
ROW_KEY = ("instance_file", "window_start")
# A forest's rows are binned in few tasks, each of which writes files of many rows. The rows of the other kinds lie in
# few partitions too, since a fit runs many short passes.
FOREST_PARTITIONS, FOREST_ROWS = 12, 1_000_000
ROWS_PER_PARTITION = 10_000


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as one vector column; the single columns are dropped."""
    renamed = df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in features],
        *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(features)],
    )
    names = [f"f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="features").transform(renamed).drop(*names)


def boosted_trees(label: str) -> GBTClassifier:
    """Depth 5 is the size of the usual leaf-capped histogram trees."""
    return GBTClassifier(
        labelCol=label, weightCol="weight", maxIter=ITERATIONS, maxDepth=5, stepSize=0.1, seed=SEED, maxMemoryInMB=512
    )


def logistic(label: str, rows: int) -> LogisticRegression:
    """Unit-strength L2 penalty: balanced weights sum to the number of rows."""
    return LogisticRegression(
        labelCol=label, weightCol="weight", featuresCol="scaled", maxIter=ITERATIONS, regParam=1.0 / rows,
        standardization=False,
    )


def partition_count(kind: str, rows: int) -> int:
    """Partitions of the training rows of a fit."""
    if kind == "random_forest":
        return max(FOREST_PARTITIONS, -(-rows // FOREST_ROWS))
    return -(-rows // ROWS_PER_PARTITION) or 1


def prepared(train: DataFrame, features: Sequence[str], label: str, partitions: int) -> DataFrame:
    """Assembled, weighted training rows, kept for the many passes of a fit.

    Rows are dealt by a hash of their key, or of all their values where they have none, and sorted: a fit
    repeats whatever way the input lay.
    """
    weighted = imputation.with_class_weights(train, label)
    key = [c for c in ROW_KEY if c in train.columns]
    values = [F.col(f"`{f}`") for f in features]
    by = key or [label, *values]
    dealt = weighted.select(*key, label, "weight", *values).repartition(partitions, *by).sortWithinPartitions(*by)
    return assemble(dealt, features).drop(*key).persist(StorageLevel.MEMORY_AND_DISK)


def fit(
    train: DataFrame, features: Sequence[str], label: str, kind: str = "random_forest", partitions: int | None = None
) -> Model | Forest:
    """Fit one of ``random_forest``, ``boosted_trees`` or ``logistic`` with balanced classes.

    ``partitions``: of the training rows; by default they follow their number, see ``partition_count``.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of model: {kind}")
    if partitions is None:
        partitions = partition_count(kind, train.count())
    if kind == "random_forest":
        key = [c for c in ROW_KEY if c in train.columns]
        return fit_forest(train, features, label, key, TREES, DEPTH, SEED, partitions)
    rows = prepared(train, features, label, partitions)
    try:
        if kind == "boosted_trees":
            # long chains of iterations are cut by checkpoints
            ensure_checkpoint_dir(train.sparkSession)
            learner = boosted_trees(label)
            if rows.select(label).distinct().count() <= 2:
                return learner.fit(rows)
            return OneVsRest(classifier=learner, labelCol=label, weightCol="weight", parallelism=8).fit(rows)
        scaler = StandardScaler(withMean=True, inputCol="features", outputCol="scaled").fit(rows)
        scaled = scaler.transform(rows).persist(StorageLevel.MEMORY_AND_DISK)
        model = logistic(label, scaled.count()).fit(scaled)
        scaled.unpersist()
        return PipelineModel([scaler, model])
    finally:
        rows.unpersist()


def likeliest(probability: str) -> Column:
    """The first of the likeliest classes."""
    return (F.array_position(probability, F.array_max(probability)) - 1).cast("int")


def predict(model: Model | Forest, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add integer ``prediction`` and, where the model has it, the array ``probability``."""
    columns = [c for c in df.columns if c not in features]
    if isinstance(model, Forest):
        scored = df.select(*[col(c) for c in columns], model.chances([col(f) for f in features]).alias("probability"))
        return scored.select(*[col(c) for c in columns], likeliest("probability").alias("prediction"), "probability")
    scored = model.transform(assemble(df, features))
    probability = vector_to_array("probability") if "probability" in scored.columns else F.lit(None).cast("array<double>")
    return scored.select(*columns, F.col("prediction").cast("int").alias("prediction"), probability.alias("probability"))


@dataclass
class FaultModels:
    """What scoring needs: features in order, medians and the two forests."""

    features: list[str]
    medians: dict[str, float | None]
    binary: Forest | None
    multiclass: Forest

    def save(self, spark: SparkSession, path: str) -> None:
        self.binary.save(spark, f"{path}/binary")
        self.multiclass.save(spark, f"{path}/multiclass")
        rows = [(i, f, self.medians.get(f)) for i, f in enumerate(self.features)]
        table = spark.createDataFrame(rows, "position int, feature string, median double")
        table.write.mode("overwrite").parquet(f"{path}/features")


def load_models(spark: SparkSession, path: str) -> FaultModels:
    rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    return FaultModels(
        [r.feature for r in rows],
        {r.feature: r.median for r in rows},
        Forest.load(spark, f"{path}/binary"),
        Forest.load(spark, f"{path}/multiclass"),
    )


def train_models(train: DataFrame, features: Sequence[str], medians: imputation.Medians) -> FaultModels:
    """Both forests on imputed training windows."""
    return FaultModels(
        list(features), dict(medians), fit(train, features, "binary_target"), fit(train, features, "multiclass")
    )


def score(df: DataFrame, models: FaultModels) -> DataFrame:
    """Outputs of both classifiers for rows with (unimputed) feature columns.

    Adds binary_pred, binary_confidence (of the predicted side), event_id,
    event_confidence and class_probabilities (event name to rounded probability).
    """
    filled = imputation.apply_medians(df, models.features, models.medians)
    kept, values = [c for c in filled.columns if c not in models.features], [col(f) for f in models.features]
    both = filled.select(
        *[col(c) for c in kept], models.binary.chances(values).alias("binary_probability"),
        models.multiclass.chances(values).alias("event_probability"),
    )
    second = both.withColumns({"binary_pred": likeliest("binary_probability"), "event_id": likeliest("event_probability")})
    classes = F.transform(F.sequence(F.lit(0), F.size("event_probability") - 1), lambda i: event_name(i, "Class "))
    return second.withColumns(
        {
            "binary_confidence": F.element_at("binary_probability", F.col("binary_pred") + 1),
            "event_confidence": F.array_max("event_probability"),
            "class_probabilities": F.map_from_arrays(
                classes, F.transform("event_probability", lambda p: F.bround(p, 4))
            ),
        }
    ).drop("binary_probability", "event_probability")


def feature_importance(model: Forest, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Features by falling importance."""
    ordered = sorted(zip(features, model.importances), key=lambda pair: -pair[1])
    rows = [(i, name, float(value)) for i, (name, value) in enumerate(ordered, 1)]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


def model_importance(models: FaultModels, spark: SparkSession) -> DataFrame:
    """Importances of the binary forest, or of the multiclass one where there is no binary forest."""
    chosen = models.binary if models.binary is not None else models.multiclass
    return feature_importance(chosen, models.features, spark)


def top_features(importances: DataFrame, n: int = 20) -> DataFrame:
    return importances.orderBy("rank").limit(n)


def summary(predicted: DataFrame, label: str) -> dict[str, float]:
    """Accuracy, precision, recall, F1 and macro F1; binary on the fault side, else macro means and weighted F1."""
    lines = {r.name: r for r in metrics.classification_report(predicted, label, "prediction").collect()}
    macro = lines["macro avg"]
    if label == "binary_target":
        fault = lines.get("1", macro)
        main = (fault.precision, fault.recall, fault.f1)
    else:
        main = (macro.precision, macro.recall, lines["weighted avg"].f1)
    return dict(zip(("accuracy", "precision", "recall", "f1", "macro_f1"), (lines["accuracy"].f1, *main, macro.f1)))


KINDS = {
    "random_forest": "Random Forest (Balanced)",
    "boosted_trees": "Gradient Boosted Trees",
    "logistic": "Logistic Regression (Baseline)",
}
TASKS = {"binary_target": "Binary (Normal vs Fault)", "multiclass": "Multi-Class (Events 0-9)"}


def model_comparison(train: DataFrame, test: DataFrame, features: Sequence[str]) -> DataFrame:
    """Three kinds of models on both tasks: metrics rounded to 4 digits and training time."""
    rows = []
    for label, task in TASKS.items():
        for kind, name in KINDS.items():
            start = time.time()
            model = fit(train, features, label, kind)
            seconds = round(time.time() - start, 2)
            predicted = predict(model, test, features).persist(StorageLevel.MEMORY_AND_DISK)
            numbers = {k: round(v, 4) for k, v in summary(predicted, label).items()}
            auc = None
            if label == "binary_target":
                scored = predicted.withColumn("score", F.element_at("probability", 2))
                auc = metrics.roc_auc(scored, label, "score").first()[0]
            predicted.unpersist()
            rows.append((task, name, *numbers.values(), None if auc is None else round(auc, 4), seconds))
    schema = (
        "task string, model string, accuracy double, precision double, recall double, f1 double, "
        "macro_f1 double, roc_auc double, training_seconds double"
    )
    return train.sparkSession.createDataFrame(rows, schema)

