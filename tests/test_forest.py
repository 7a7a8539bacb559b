"""The forest's bins, draws, cuts and trees against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.operators import forest, models

NAMES = ["a", "b", "c"]


def rows(spark, n=400):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3)).round(2)
    label = (x[:, 0] + rng.normal(scale=0.7, size=n) > 0).astype(int) * 2
    data = [(f"r{i}", *map(float, x[i]), int(label[i])) for i in range(n)]
    return spark.createDataFrame(data, "instance_file string, a double, b double, c double, y int")


def arrays(found):
    return [[a.tolist() for a in forest._mapped(name, forest.TREE_KINDS)] for name in found.files]


def fitted(df, key=("instance_file",), trees=6):
    return forest.fit_forest(df, NAMES, "y", key, trees, 6, 1, 4)


def test_trees_do_not_depend_on_the_layout_or_on_the_room_for_histograms(spark, monkeypatch):
    df = rows(spark)
    first = fitted(df)
    assert arrays(fitted(df.repartition(7))) == arrays(first)
    # few cells: the nodes of a level are counted in several passes
    hashes = np.random.default_rng(0).integers(0, 2**63, 500).astype(np.uint64)
    codes = np.random.default_rng(1).integers(0, 32, (500, 9)).astype(np.uint8) * np.uint8(2)
    codes += np.random.default_rng(2).integers(0, 2, (500, 1)).astype(np.uint8)
    files = [("x", 300), ("y", 200)]
    parts = {"x": (hashes[:300], codes[:300].ravel()), "y": (hashes[300:], codes[300:].ravel())}
    monkeypatch.setattr(forest, "_mapped", lambda name, kinds: parts[name])
    whole = forest.grow(3, files, 9, np.array([1.0, 2.0]), 8, 1)
    monkeypatch.setattr(forest, "CELLS", 3 * 32 * 2 * 2)
    parted = forest.grow(3, files, 9, np.array([1.0, 2.0]), 8, 1)
    assert len(whole[0]) > 20
    for a, b in zip(whole, parted):
        assert a.tolist() == b.tolist()


def test_chances_are_those_of_the_leaves(spark):
    """Every row is led through every tree one by one; the chances of a class without rows are 0."""
    df = rows(spark)
    found = fitted(df)
    scored = models.predict(found, df, NAMES).collect()
    values = {r["instance_file"]: [r[n] for n in NAMES] for r in df.collect()}
    for row in scored[:40]:
        x, total = values[row.instance_file], np.zeros(3)
        for nodes, leaves, chances, _ in (forest._mapped(name, forest.TREE_KINDS) for name in found.files):
            at = 0
            while (node := int(nodes[at])) & 0xFF != 255:
                feature = node >> 8 & 0xFFFF
                below = sum(c < x[feature] for c in found.edges[feature])
                at = (node >> 24) + (below > (node & 0xFF))
            total += chances.reshape(-1, 3)[leaves[at]]
        assert row.probability == pytest.approx(total / total.sum()) and row.probability[1] == 0
        assert row.prediction == int(np.argmax(row.probability))
    right = np.mean([r.prediction == r.y for r in scored])
    assert right > 0.8 and found.importances[0] == max(found.importances) and sum(found.importances) == pytest.approx(1)


def test_best_cut_equals_brute_force():
    rng = np.random.default_rng(2)
    counts, weights = rng.integers(0, 4, (5, 3, 8, 3)), np.array([1.0, 0.4, 3.0])

    def purity(c):
        w = c * weights
        return (w**2).sum() / w.sum() if w.sum() else 0.0

    gain, feature, cut, below = forest.best_cuts(counts, weights)
    for i in range(5):
        best = -1.0
        for f in range(3):
            every = counts[i, f].sum(0)
            for b in range(7):
                low = counts[i, f, : b + 1].sum(0)
                if low.sum() >= 2 and (every - low).sum() >= 2:
                    best = max(best, (purity(low) + purity(every - low) - purity(every)) / (every * weights).sum())
        assert gain[i] == pytest.approx(best)
        assert below[i].tolist() == counts[i, feature[i], : cut[i] + 1].sum(0).tolist()


def test_edges_part_neighbouring_numbers_and_hold_the_quantiles():
    high = np.nextafter(1.0, 2.0)
    assert forest.edges_of(np.array([1.0, high, high])).tolist() == [1.0]
    assert forest.edges_of(np.array([7.0, 7.0])).tolist() == []
    cuts = forest.edges_of(np.arange(10_000.0))
    assert len(cuts) == 31 and np.diff(cuts).min() > 300 and np.diff(cuts).max() < 325
    assert len(forest.edges_of(np.r_[np.zeros(9_000), np.arange(1.0, 1_000)])) <= 31


def test_copies_are_poisson_and_follow_the_hash():
    hashes = np.arange(100_000, dtype=np.uint64)
    copies = forest.draws(hashes, 4, 42)
    assert copies.mean() == pytest.approx(1, abs=0.02) and copies.var() == pytest.approx(1, abs=0.03)
    assert (forest.draws(hashes[::-1], 4, 42) == copies[::-1]).all() and (forest.draws(hashes, 5, 42) != copies).any()


def test_rows_without_key_repeated_rows_and_rows_without_label(spark):
    df = rows(spark, 60)
    odd = df.union(df).union(df.limit(5).withColumn("y", F.lit(None).cast("int"))).drop("instance_file")
    found = fitted(odd, ())
    assert models.predict(found, odd, NAMES).count() == 125
    same = df.withColumns({"a": F.lit(1.0), "b": F.lit(1.0), "c": F.lit(1.0), "y": F.lit(1), "instance_file": F.lit(None).cast("string")})
    alike = fitted(same)
    assert [list(r.probability) for r in models.predict(alike, same, NAMES).limit(2).collect()] == [[0.0, 1.0]] * 2
    with pytest.raises(ValueError):
        fitted(df.limit(0))
    with pytest.raises(Exception, match="has no value"):
        fitted(df.withColumn("b", F.lit(None).cast("double")))
