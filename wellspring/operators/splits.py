"""Train/test splits that keep recordings or wells together, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.functions.values import ratio
from wellspring.operators.ranking import hashed_rank


def dedup_instances(windows: DataFrame) -> DataFrame:
    """One row per recording."""
    return windows.groupBy("instance_file").agg(
        F.min("event_folder").alias("event_folder"), F.min("well_id").alias("well_id")
    )


def stratified_instance_split(windows: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Recordings with their side; every event folder gives the same share to the test side."""
    ranked = hashed_rank(dedup_instances(windows), ["event_folder"], "instance_file", str(seed))
    is_test = F.col("rank") <= F.round(F.col("group_size") * test_size)
    return ranked.select(
        "instance_file", "event_folder", "well_id", F.when(is_test, "test").otherwise("train").alias("split")
    )


def group_split(windows: DataFrame, group: str = "well_id", test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole wells with their side."""
    wells = windows.select(group).distinct()
    ranked = hashed_rank(wells, [], group, str(seed))
    is_test = F.col("rank") <= F.ceil(F.col("group_size") * test_size)
    return ranked.select(group, F.when(is_test, "test").otherwise("train").alias("split"))


def with_split(windows: DataFrame, split: DataFrame, key: str = "instance_file") -> DataFrame:
    """Windows with the side of their recording or well."""
    return windows.join(split.select(key, "split"), key)


def rows_of_instances(windows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Windows whose recording is in the chosen set."""
    return windows.join(chosen.select("instance_file"), "instance_file", "left_semi")


def well_overlap(split_windows: DataFrame) -> DataFrame:
    """Wells that occur on both sides."""
    train = split_windows.filter(F.col("split") == "train").select("well_id")
    test = split_windows.filter(F.col("split") == "test").select("well_id")
    return train.intersect(test)


def present_classes(split_windows: DataFrame) -> DataFrame:
    return split_windows.select("multiclass").distinct().orderBy("multiclass")


def split_audit(split_windows: DataFrame) -> DataFrame:
    """Recordings, windows, share and wells per side; wells found on both sides."""
    per_instance = split_windows.groupBy("split", "instance_file", "well_id").agg(F.count("*").alias("windows"))
    per_side = per_instance.groupBy("split").agg(
        F.count_distinct("instance_file").alias("instances"),
        F.sum("windows").alias("windows"),
        F.count_distinct("well_id").alias("wells"),
    )
    sides = per_instance.groupBy("well_id").agg(F.count_distinct("split").alias("sides"))
    overlap = sides.agg(F.count_if(F.col("sides") > 1).alias("overlapping_wells"))
    # two rows and one row from here on
    both = Window.partitionBy()
    return (
        per_side.withColumn("percent", ratio(F.col("windows"), F.sum("windows").over(both)) * 100)
        .withColumn("one", F.lit(1))
        .join(F.broadcast(overlap.withColumn("one", F.lit(1))), "one")
        .drop("one")
    )
