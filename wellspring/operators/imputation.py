"""Median imputation and class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.functions.values import col
from wellspring.operators.ranking import exact_quantiles

Medians = Mapping[str, float | None]


def fit_medians(train: DataFrame, features: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each feature over the training rows."""
    return exact_quantiles(train, features, 0.5)


def apply_medians(df: DataFrame, features: Sequence[str], medians: Medians | None = None) -> DataFrame:
    """Replace NULLs by the medians; by 0 without medians or for a feature never observed."""
    fills = {f: (medians or {}).get(f) or 0.0 for f in features}
    others = [f"`{c}`" for c in df.columns if c not in fills]
    return df.selectExpr(*others, *[f"coalesce(`{f}`, {fill!r}D) AS `{f}`" for f, fill in fills.items()])


def medians_table(df: DataFrame, medians: Medians) -> DataFrame:
    rows = [(name, value) for name, value in medians.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, median double")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows, classes and weight n / (k * n_c) per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.collect_list(F.struct(label, "n")).alias("classes"), F.sum("n").alias("total"))
    weight = F.col("total") / (F.size("classes") * F.col("class.n"))
    return totals.select("total", "classes", F.explode_outer("classes").alias("class")).select(
        F.col(f"class.{label}").alias(label), F.col("class.n").alias("n"), weight.alias("weight")
    )


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Add the balanced weight of each row's class (one broadcast row per class)."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(name))
    return df.join(F.broadcast(weights), label)
