"""Isolation forest (Liu, Ting and Zhou, 2008): small samples per tree, scores from path lengths."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.functions.values import col
from wellspring.operators.ranking import exact_quantiles
from wellspring.session import materialise

TREES, SAMPLE, CONTAMINATION, SEED = 100, 256, 0.15, 42
NODES = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def expected_depth(rows: int) -> float:
    """Mean path length of an unsuccessful search among ``rows`` values."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1.0) + np.euler_gamma) - 2.0 * (rows - 1.0) / rows


def grow_tree(values: np.ndarray, tree: int, seed: int) -> list[tuple]:
    """Random splits of at most a few hundred rows; a leaf has feature -1."""
    random = np.random.default_rng((seed, tree))
    limit = math.ceil(math.log2(max(len(values), 2)))
    nodes: list[tuple] = []
    open_nodes = [(values, 0, None, None)]
    while open_nodes:
        rows, depth, parent, side = open_nodes.pop()
        node = len(nodes)
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append([tree, node, -1, 0.0, -1, -1, depth + expected_depth(len(rows))])
        else:
            feature = int(random.choice(usable))
            # between neighbouring numbers a draw may round up to the highest value, which would leave one side empty
            drawn = random.uniform(low[feature], high[feature])
            threshold = float(min(drawn, np.nextafter(high[feature], -np.inf)))
            nodes.append([tree, node, feature, threshold, -1, -1, 0.0])
            below = rows[:, feature] <= threshold
            open_nodes.append((rows[~below], depth + 1, node, 5))
            open_nodes.append((rows[below], depth + 1, node, 4))
        if parent is not None:
            nodes[parent][side] = node
    return [tuple(n) for n in nodes]


@dataclass
class IsolationForest:
    """Node table (trees times at most 2 * sample rows) and the decision threshold."""

    features: list[str]
    nodes: pd.DataFrame
    sample: int
    threshold: float = math.inf

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Add ``anomaly_score`` (higher is stranger) and ``anomaly`` (0/1)."""
        trees = [t.sort_values("node") for _, t in self.nodes.groupby("tree")]
        arrays = [tuple(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "depth")) for t in trees]
        shared = df.sparkSession.sparkContext.broadcast(arrays)
        normal_depth, threshold = expected_depth(self.sample), self.threshold

        def walk(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame):
                    continue
                values = np.stack(frame["x"].to_numpy())
                every = np.arange(len(values))
                total = np.zeros(len(values))
                for feature, cut, left, right, depth in shared.value:
                    at = np.zeros(len(values), dtype=np.int64)
                    while (inner := feature[at] >= 0).any():
                        below = values[every, np.maximum(feature[at], 0)] <= cut[at]
                        at = np.where(inner, np.where(below, left[at], right[at]), at)
                    total += depth[at]
                score = 2.0 ** (-(total / len(shared.value)) / normal_depth)
                yield frame.drop(columns="x").assign(anomaly_score=score, anomaly=(score > threshold).astype("int32"))

        kinds = dict(df.dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", anomaly_score double, anomaly int"
        x = F.array(*[col(f).cast("double") for f in self.features]).alias("x")
        return df.select(*[col(c) for c in keep], x).mapInPandas(walk, schema)


def fit_isolation_forest(
    normal: DataFrame,
    features: Sequence[str],
    key: Sequence[str],
    trees: int = TREES,
    sample: int = SAMPLE,
    contamination: float = CONTAMINATION,
    seed: int = SEED,
) -> IsolationForest:
    """Fit on normal, imputed windows.

    A pool of at most trees * sample rows, the first in the order of a hash of their
    keys, is drawn once; each tree draws its rows from the pool. Pool and node table
    have a fixed size, whatever the size of the data. The threshold is the exact
    quantile of the training scores that leaves ``contamination`` above it.
    """
    spark = normal.sparkSession
    size = normal.count()
    sample = min(sample, size)
    places = min(size, trees * sample)
    order = ["hash", *key]
    hashed = normal.select(
        *key, F.xxhash64(*key, F.lit(seed)).alias("hash"), F.array(*[col(f).cast("double") for f in features]).alias("x")
    )
    pool = hashed.orderBy(*order).limit(places)
    pool = pool.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("place"), "x")
    draws = [
        (tree, int(place))
        for tree in range(trees)
        for place in np.random.default_rng((seed, tree, 1)).choice(places, sample, replace=False)
    ]
    drawn = spark.createDataFrame(pd.DataFrame(draws, columns=["tree", "place"]), "tree int, place int")

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        ordered = rows.sort_values("place")
        grown = grow_tree(np.stack(ordered["x"].to_numpy()), tree, seed)
        return pd.DataFrame(grown, columns=["tree", "node", "feature", "threshold", "left", "right", "depth"])

    nodes = pool.join(drawn, "place").groupBy("tree").applyInPandas(grow, NODES).toPandas()
    forest = IsolationForest(list(features), nodes, sample)
    scores = materialise(forest.score(normal, list(key)[:1]).select("anomaly_score"), "training-scores")
    forest.threshold = exact_quantiles(scores, ["anomaly_score"], 1 - contamination)["anomaly_score"]
    return forest
