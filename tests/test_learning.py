"""Splits, quantiles, metrics, imputation, models."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wellspring.operators import evidence, imputation, isolation, metrics, models, splits
from wellspring.operators.ranking import exact_quantiles, hashed_rank
from wellspring.operators.telemetry import parse_payload, snapshot_features
from wellspring.operators.windows import feature_names
from wellspring.plans import training

# --- fixed values: published confusion matrices and scores -------------------------
BINARY = [[45290, 4167], [25804, 40755]]
MULTICLASS = [
    [45983, 90, 0, 303, 796, 62, 12, 2146, 19, 46],
    [242, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [7, 0, 558, 0, 1, 0, 0, 0, 0, 0],
    [0, 0, 0, 1687, 101, 0, 0, 0, 0, 0],
    [6, 0, 0, 170, 8176, 0, 0, 7, 0, 0],
    [6, 0, 0, 0, 0, 690, 0, 0, 0, 0],
    [15, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [19395, 115, 0, 0, 0, 0, 0, 13934, 0, 0],
    [6902, 0, 1, 0, 0, 0, 0, 0, 13387, 0],
    [22, 0, 0, 1137, 0, 0, 0, 0, 0, 0],
]


def report_of(spark, matrix):
    cells = [(i, j, n) for i, row in enumerate(matrix) for j, n in enumerate(row)]
    df = spark.createDataFrame(cells, "y int, p int, cnt long")
    lines = metrics.classification_report(df, "y", "p", "cnt").collect()
    return {r["name"]: (round(r.precision, 4), round(r.recall, 4), round(r.f1, 4), r.support) for r in lines}


def test_published_binary_report(spark):
    lines = report_of(spark, BINARY)
    assert lines["0"] == (0.6370, 0.9157, 0.7514, 49457)
    assert lines["1"] == (0.9072, 0.6123, 0.7312, 66559)
    assert lines["accuracy"][2] == 0.7417
    assert lines["macro avg"][:3] == (0.7721, 0.7640, 0.7413)
    assert lines["weighted avg"][:3] == (0.7921, 0.7417, 0.7398)


def test_published_multiclass_report(spark):
    lines = report_of(spark, MULTICLASS)
    assert lines["1"] == (0.0, 0.0, 0.0, 242)
    assert lines["7"] == (0.8662, 0.4166, 0.5626, 33444)
    assert lines["accuracy"][2] == 0.7276
    assert lines["macro avg"][:3] == (0.5827, 0.5905, 0.5657)
    assert lines["weighted avg"][2] == 0.7108


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6)), min_size=1, max_size=300), st.sampled_from([0.5, 0.85, 0.1]))
def test_quantiles_equal_numpy(spark, values, fraction):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    known = [v for v in values if v is not None]
    got = exact_quantiles(df, ["x"], fraction, largest_group=4)["x"]
    assert got is None if not known else got == pytest.approx(np.quantile(known, fraction), rel=1e-12, abs=1e-12)


def test_quantiles_of_many_copies_and_rows(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") % 1000).cast("double").alias("x"),
        (F.hash("id") % 100_000).cast("double").alias("y"),
    )
    pdf = df.toPandas()
    got = exact_quantiles(df, ["x", "y"], 0.5, largest_group=50)
    assert got == {"x": np.median(pdf.x), "y": np.median(pdf.y)}


def test_hashed_rank_is_a_permutation(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.concat(F.lit("n"), "id").alias("name"))
    ranks = hashed_rank(df, ["g"], "name", "42").groupBy("g").agg(
        F.sort_array(F.collect_list("rank")).alias("r"), F.max("group_size").alias("n")).collect()
    for row in ranks:
        assert row.r == list(range(1, row.n + 1))


def test_splits_keep_groups_together(spark):
    windows = spark.range(1000).select(
        F.concat(F.lit("f"), (F.col("id") % 50)).alias("instance_file"),
        (F.col("id") % 50 % 5).cast("string").alias("event_folder"),
        F.concat(F.lit("w"), F.col("id") % 50 % 7).alias("well_id"),
    )
    chosen = splits.stratified_instance_split(windows)
    per_folder = {r.event_folder: r.n for r in chosen.filter("split='test'").groupBy("event_folder").agg(F.count("*").alias("n")).collect()}
    assert per_folder == {str(i): 2 for i in range(5)}
    sided = splits.with_split(windows, chosen)
    assert sided.count() == 1000
    assert sided.groupBy("instance_file").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    wells = splits.with_split(windows, splits.group_split(windows), "well_id")
    assert splits.well_overlap(wells).count() == 0
    assert wells.filter("split='test'").select("well_id").distinct().count() == 2


def test_auc_with_ties(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    pos, neg = s[y == 1], s[y == 0]
    expected = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(expected)
    assert metrics.roc_auc(df.filter("y = 1"), "y", "s").first()[0] is None


def test_phases_without_faults(spark):
    df = spark.createDataFrame([(0, 0, 0)], "y int, prediction int, is_transient int")
    assert tuple(metrics.phase_metrics(df, "y", "prediction").first()) == (0.0, 0.0, 0, 0)


def test_imputation_uses_training_rows_only(spark):
    train = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (5.0, None)], "a double, b double")
    test = spark.createDataFrame([(None, None)], "a double, b double")
    medians = imputation.fit_medians(train, ["a", "b"])
    assert medians == {"a": 3.0, "b": None}
    assert tuple(imputation.apply_medians(test, ["a", "b"], medians).first()) == (3.0, 0.0)
    assert tuple(imputation.apply_medians(test, ["a"]).select("a").first()) == (0.0,)


def blobs(spark, n=600):
    rng = np.random.default_rng(1)
    names = feature_names()
    rows = []
    for i in range(n):
        event = int(rng.choice([0, 0, 0, 3, 8]))
        x = rng.normal(size=91) + (event > 0) * 3.0 + (event == 8) * np.r_[np.full(13, 5.0), np.zeros(78)]
        rows.append((f"r{i}", event, int(event > 0), *map(float, x)))
    columns = ", ".join(f"`{f}` double" for f in names)
    return spark.createDataFrame(rows, f"id string, multiclass int, binary_target int, {columns}"), names


def test_forests_score_and_survive_saving(spark, tmp_path):
    df, names = blobs(spark)
    fitted = models.train_models(df, names, {n: 0.0 for n in names})
    fitted.save(spark, str(tmp_path / "models"))
    loaded = models.load_models(spark, str(tmp_path / "models"))
    assert loaded.features == names
    decided = evidence.fuse_decision(models.score(df, loaded))
    right = decided.filter((F.col("multiclass") == F.col("predicted_event_id"))).count()
    assert right > 570
    row = decided.first()
    assert row.status in ("normal", "anomaly") and 0 <= row.confidence <= 1
    assert abs(sum(row.class_probabilities.values()) - 1) < 1e-3
    ranked = models.feature_importance(fitted.binary, names, spark).collect()
    assert [r["rank"] for r in ranked] == list(range(1, 92))
    assert sum(r.importance for r in ranked) == pytest.approx(1.0)


def test_snapshot_with_missing_and_corrupt_sensors(spark):
    body = '{"P-PDG": 28000000.0, "T-TPT": null, "P-MON-CKP": "corrupt_string", "UNKNOWN": 9.9, "QGL_mean": "1.5", "QGL_std": "x"}'
    df = parse_payload(spark.createDataFrame([(body,)], "sensor_data string"))
    row = snapshot_features(df).first()
    assert (row["P-PDG_mean"], row["P-PDG_std"], row["P-PDG_trend"]) == (2.8e7, 0.0, 0.0)
    assert row["T-TPT_mean"] is None and row["P-MON-CKP_std"] is None
    assert (row["QGL_mean"], row["QGL_std"], row["QGL_max"]) == (1.5, None, None)


def test_forest_histograms_come_from_few_partitions():
    """Every partition sends all histograms of a level: few for small tables, then by rows only."""
    assert [models.partition_count("random_forest", n) for n in (0, 30_000, 12_000_000, 25_000_001)] == [12, 12, 12, 26]
    assert [models.partition_count("logistic", n) for n in (0, 10_000, 10_001)] == [1, 1, 2]


def test_isolation_tree_parts_neighbouring_numbers():
    """Between 1 and the next number every second draw rounds up to the higher one."""
    values = np.array([[1.0], [np.nextafter(1.0, 2.0)]] * 4)
    for tree in range(50):
        grown = isolation.grow_tree(values, tree, 42)
        assert len(grown) == 3 and grown[0][3] == 1.0


def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(2)
    normal = [(f"n{i}", *map(float, rng.normal(size=3))) for i in range(1000)]
    odd = [(f"o{i}", *map(float, rng.normal(size=3) + 8)) for i in range(50)]
    schema = "id string, a double, b double, c double"
    train, test = spark.createDataFrame(normal, schema), spark.createDataFrame(odd, schema)
    forest = isolation.fit_isolation_forest(train, ["a", "b", "c"], ["id"], trees=50)
    flagged = forest.score(train, ["id"]).agg(F.avg("anomaly")).first()[0]
    assert flagged == pytest.approx(0.15, abs=0.01)
    assert forest.score(test, ["id"]).agg(F.avg("anomaly")).first()[0] == 1.0
    assert forest.nodes.groupby("tree").size().max() <= 2 * 256


def test_decision_quirks(spark):
    rows = [(1, 0.7, 0, 0.9), (0, 0.8, 4, 0.6), (0, 0.9, 0, 0.99), (1, 0.6, 4, 0.95)]
    df = spark.createDataFrame(rows, "binary_pred int, binary_confidence double, event_id int, event_confidence double")
    got = [(r.status, r.predicted_event, r.confidence, r.binary_status) for r in evidence.fuse_decision(df).collect()]
    assert got == [
        ("anomaly", "Normal Operation", 0.7, "FAULT"),
        ("anomaly", "Flow Instability", 0.8, "NORMAL"),
        ("normal", "Normal Operation", 0.9, "NORMAL"),
        ("anomaly", "Flow Instability", 0.95, "FAULT"),
    ]


def plain_report(pairs, classes):
    """Precision, recall, F1 and support by class, from counts."""
    lines = {}
    for c in classes:
        hit = sum(a == b == c for a, b in pairs)
        said, true = sum(b == c for _, b in pairs), sum(a == c for a, _ in pairs)
        p, r = hit / said if said else 0.0, hit / true if true else 0.0
        lines[str(c)] = (p, r, 2 * p * r / (p + r) if p + r else 0.0, true)
    return lines


def learnable_windows(spark, n=400):
    """Labelled windows whose first feature tells the class, with noise, on eight wells."""
    rng = random.Random(2)
    rows = []
    for i in range(n):
        event = rng.choice([0, 0, 3, 4])
        level = event + rng.gauss(0, 0.6)
        values = [level if k == 0 else rng.random() if k % 9 else None for k in range(len(training.FEATURES))]
        transient = int(event > 0 and rng.random() < 0.4)
        recording = f"w{i % 8}_{i % 40}"
        rows.append((recording, f"w{i % 8}", str(i % 40 % 4), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), event + 100 * transient,
                     transient, event, int(event > 0), *values))
    columns = ", ".join(f"`{f}` double" for f in training.FEATURES)
    return spark.createDataFrame(rows, "instance_file string, well_id string, event_folder string, window_start timestamp, raw_class int, "
                                 f"is_transient int, multiclass int, binary_target int, {columns}")


@pytest.fixture(scope="module")
def learnable(spark):
    return training.build_dataset(learnable_windows(spark))


@pytest.mark.parametrize("label", ["binary_target", "multiclass"])
def test_reports_equal_plain_metrics(spark, learnable, label):
    predicted = models.predict(models.fit(learnable.train, training.FEATURES, label), learnable.test, training.FEATURES).collect()
    pairs = [(r[label], r.prediction) for r in predicted]
    report = {r.name: r for r in training.evaluate(spark.createDataFrame(predicted), label).collect()}
    assert {r.name: r.recall for r in training.evaluate_forest(learnable, label).collect()} == {n: r.recall for n, r in report.items()}
    for name, numbers in plain_report(pairs, sorted({a for a, _ in pairs} | {b for _, b in pairs})).items():
        line = report[name]
        assert (line.precision, line.recall, line.f1, line.support) == pytest.approx(numbers)
    accuracy = sum(a == b for a, b in pairs) / len(pairs)
    majority = max(Counter(a for a, _ in pairs).values()) / len(pairs)
    assert report["accuracy"].f1 == pytest.approx(accuracy) and accuracy > majority
    for phase, flag in (("transient", 1), ("established", 0)):
        of_phase = [r for r in predicted if r.binary_target == 1 and r.is_transient == flag]
        hits = sum(r[label] == r.prediction for r in of_phase)
        assert report[f"{phase} faults"].recall == pytest.approx(hits / len(of_phase)) and report[f"{phase} faults"].support == len(of_phase)


def test_forest_does_not_depend_on_the_layout(learnable):
    """Up to ties that the order of sums decides."""

    def chances(rows):
        model = models.fit(rows, training.FEATURES, "binary_target", partitions=5)
        found = models.predict(model, learnable.test, training.FEATURES).orderBy("window_start").collect()
        return np.array([r.probability[1] for r in found])

    first = chances(learnable.train)
    assert np.abs(chances(learnable.train.repartition(7)) - first).mean() < 0.004
    bare = learnable.train.drop("instance_file", "window_start")
    assert np.abs(chances(bare.repartition(7)) - chances(bare.coalesce(1))).mean() < 0.004


def test_importances_name_the_telling_feature_and_fall_back(spark, learnable):
    both = models.train_models(learnable.train, training.FEATURES, learnable.medians)
    top = models.top_features(models.model_importance(both, spark), 5).collect()
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 5] and top[0].feature == training.FEATURES[0]
    single = models.FaultModels(both.features, both.medians, None, both.multiclass)
    expected = models.feature_importance(both.multiclass, both.features, spark).collect()
    assert models.model_importance(single, spark).collect() == expected


def test_isolation_forest_flags_the_asked_share(learnable):
    normal = learnable.train.filter("binary_target = 0")
    forest = isolation.fit_isolation_forest(normal, training.FEATURES, training.KEY)
    scores = [r.anomaly_score for r in forest.score(normal, ["binary_target"]).collect()]
    above = sum(s > forest.threshold for s in scores) / len(scores)
    assert above <= 0.15 + 1 / len(scores) and sum(s >= forest.threshold for s in scores) / len(scores) >= 0.15 - 1 / len(scores)
    report = {r.name: r for r in training.evaluate_isolation_forest(learnable).collect()}
    found = forest.score(learnable.test, ["binary_target"]).collect()
    assert report["1"].support == sum(r.binary_target for r in found)
    assert report["1"].recall == pytest.approx(sum(r.binary_target and r.anomaly for r in found) / report["1"].support)


def test_split_windows_are_stored_once(spark, tmp_path):
    """The passes of the medians read the sides of recordings from a table and do not join them anew."""
    from wellspring.plans import split_queries

    stamps = [dt.datetime(2024, 1, 1 + i % 20, i % 24) for i in range(200)]
    rows = [(i, stamps[i], i % 12, ("view", "error", "purchase")[i % 3], float(i % 17), f'{{"k": {i % 50}}}') for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = split_queries.feature_split(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {r.split for r in found.select("split").distinct().collect()} == {"train", "test"}
