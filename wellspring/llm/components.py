"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.shared import discard, scratch_path


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("_m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    smallest = down.groupBy("u").agg(F.min("v").alias("_m"))
    tied = down.join(smallest, "u").where(F.col("v") != F.col("_m")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return tied.union(smallest.select("u", F.col("_m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of all nodes with a link.

    ``edges`` has whole-number columns ``u`` and ``v``. Each round is two grouped minima and
    two joins, written to the shared folder, so lineage stays short; the number of rounds
    grows with the logarithm of the longest chain. Stops when a round changes no edge. No
    edges give no rows; loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    base = scratch_path(spark, "components")
    now = _stored(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), f"{base}/0")
    sign = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    state, step = None, 0
    while True:
        found = tuple(now.agg(F.count(F.lit(1)), sign).first())
        if found == state or not found[0]:
            break
        state, step = found, step + 1
        wide = _stored(_large_star(now).distinct(), f"{base}/{step}-large")
        now = _stored(_small_star(wide).distinct(), f"{base}/{step}")
        discard(spark, f"{base}/{step}-large")
        discard(spark, f"{base}/{step - 1}")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
