"""Evaluation of classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.functions.values import ratio
from wellspring.operators.ranking import by_quantile
from wellspring.session import materialise


def pair_counts(df: DataFrame, label: str, prediction: str, count: str | None = None) -> DataFrame:
    rows = F.sum(count) if count else F.count("*")
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(rows.alias("n"))


def confusion_matrix(df: DataFrame, label: str, prediction: str, count: str | None = None) -> DataFrame:
    """Count per true and predicted class over all present classes, zeros kept.

    After ``pair_counts`` at most classes x classes numbers are left, so they are
    completed inside one row.
    """
    cells = pair_counts(df, label, prediction, count).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws("/", "label", "prediction"), F.col("n")))
        ).alias("cells"),
        F.array_union(F.collect_set("label"), F.collect_set("prediction")).alias("classes"),
    )
    rows = cells.select("cells", "classes", F.explode_outer("classes").alias("label"))
    grid = rows.select("cells", "label", F.explode_outer("classes").alias("prediction"))
    key = F.concat_ws("/", "label", "prediction")
    return grid.select("label", "prediction", F.coalesce(F.try_element_at("cells", key), F.lit(0)).alias("n"))


def classification_report(df: DataFrame, label: str, prediction: str, count: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), none.alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("class"), none.alias("support"), F.col("n").alias("predicted"), none.alias("hits")),
    )
    per_class = (
        pair_counts(df, label, prediction, count)
        .select(F.explode_outer(sides).alias("side"))
        .groupBy(F.col("side.class").alias("class"))
        .agg(*[F.sum(f"side.{c}").alias(c) for c in ("support", "predicted", "hits")])
        .select(
            F.col("class").cast("string").alias("name"),
            ratio(F.col("hits"), F.col("predicted")).alias("precision"),
            ratio(F.col("hits"), F.col("support")).alias("recall"),
            ratio(F.col("hits") * 2, F.col("support") + F.col("predicted")).alias("f1"),
            "support",
            "hits",
        )
    )
    scores = ("precision", "recall", "f1")
    total = F.sum("support")
    accuracy = ratio(F.sum("hits"), total)
    entry = F.struct("name", *scores, "support")
    macro = F.struct(F.lit("macro avg").alias("name"), *[F.avg(s).alias(s) for s in scores], total.alias("support"))
    weighted = F.struct(
        F.lit("weighted avg").alias("name"),
        *[ratio(F.sum(F.col(s) * F.col("support")), total).alias(s) for s in scores],
        total.alias("support"),
    )
    overall = F.struct(F.lit("accuracy").alias("name"), *[accuracy.alias(s) for s in scores], total.alias("support"))
    lines = per_class.agg(F.concat(F.collect_list(entry), F.array(overall, macro, weighted)).alias("lines"))
    return lines.select(F.explode_outer("lines").alias("line")).select("line.*")


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties counted half; NULL when only one class is present.

    Rows are first counted per score. A score's rank is the number of negatives in
    the lower score ranges (a small table) plus the running sum in its own range.
    """
    per_score = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) != 1).alias("negatives")
    )
    ranged = by_quantile(materialise(per_score, "scores"), "score")
    totals = ranged.groupBy("value_range").agg(F.sum("negatives").alias("negatives"))
    lower = Window.orderBy("value_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("value_range", F.coalesce(F.sum("negatives").over(lower), F.lit(0)).alias("lower_negatives"))
    within = Window.partitionBy("value_range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumn("running", F.coalesce(F.sum("negatives").over(within), F.lit(0)))
    beaten = F.col("lower_negatives") + F.col("running") + F.col("negatives") / 2
    return running.join(offsets, "value_range").agg(
        F.try_divide(
            F.sum(F.col("positives") * beaten),
            F.sum("positives").cast("double") * F.sum("negatives"),
        ).alias("roc_auc")
    )


def phase_metrics(df: DataFrame, label: str, prediction: str, transient: str = "is_transient") -> DataFrame:
    """Share of correctly found faults, for transient and for established ones; 0 when there are none."""
    fault = F.col(label) > 0
    correct = F.col(label) == F.col(prediction)
    phases = {"transient": fault & (F.col(transient) == 1), "established": fault & (F.col(transient) != 1)}
    return df.agg(
        *[ratio(F.count_if(inside & correct), F.count_if(inside)).alias(f"{name}_score") for name, inside in phases.items()],
        *[F.count_if(inside).alias(f"{name}_support") for name, inside in phases.items()],
    )
