"""Cleaning, forward fill and window features against plain Python and hand-worked cases."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wellspring.constants import PRIMARY_SENSORS
from wellspring.operators.cleaning import causal_ffill, causal_ffill_seconds, clip_features, physical_range, sanitize
from wellspring.operators.windows import feature_names, window_features, window_features_online
from wellspring.sources import recordings as rec
from wellspring.sources import sinks

START = dt.datetime(2024, 3, 1)


def second(n):
    return START + dt.timedelta(seconds=n)


def frame(spark, rows, sensors=("P-PDG",), label="int"):
    columns = ", ".join(f"`{s}` double" for s in sensors)
    schema = f"instance_file string, well_id string, event_folder string, ts timestamp_ntz, class {label}, {columns}"
    return spark.createDataFrame([("W_1.parquet", "W", "3", *r) for r in rows], schema)


def plain_fill(values, limit):
    result, last, age = [], None, 0
    for value in values:
        if value is not None:
            last, age = value, 0
        else:
            age += 1
        result.append(last if age <= limit else None)
    return result


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(1, 400), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=60),
    st.integers(1, 7),
)
def test_sliced_fill_equals_loop(spark, steps, limit):
    at, rows = 0, []
    for gap, value in steps:
        at += gap
        rows.append((second(at), 0, None if value is None else float(value)))
    for slice_seconds in (120, None):
        filled = causal_ffill(frame(spark, rows), ["P-PDG"], limit, slice_seconds=slice_seconds)
        got = [r[0] for r in filled.orderBy("ts").select("P-PDG").collect()]
        assert got == plain_fill([r[2] for r in rows], limit)


@pytest.mark.parametrize("gap, filled", [(60, True), (61, False)])
def test_fill_limit_crosses_window_border(spark, gap, filled):
    rows = [(second(50), 0, 5.0)] + [(second(50 + i), 0, None) for i in range(1, gap + 1)]
    last = causal_ffill(frame(spark, rows), ["P-PDG"], 60, slice_seconds=60).orderBy(F.desc("ts")).first()
    assert (last["P-PDG"] == 5.0) is filled
    assert last["position"] == gap + 1


def test_fill_by_time(spark):
    rows = [(second(0), 0, 1.0), (second(60), 0, None), (second(61), 0, None)]
    got = causal_ffill_seconds(frame(spark, rows), ["P-PDG"], 60).orderBy("ts").select("P-PDG").collect()
    assert [r[0] for r in got] == [1.0, 1.0, None]


def test_physical_ranges(spark):
    sensors = ["P-PDG", "T-TPT", "ABER-CKP", "QGL", "X"]
    edges = {s: physical_range(s) for s in sensors}
    rows = [
        (second(0), 0, *[edges[s][0] for s in sensors]),
        (second(1), 0, *[edges[s][1] for s in sensors]),
        (second(2), 0, *[edges[s][0] - 1 for s in sensors]),
        (second(3), 0, *[edges[s][1] * 1.01 for s in sensors]),
        (second(4), 0, *[math.nan] * 5),
        (second(5), 0, *[-1e38] * 5),
    ]
    got = sanitize(frame(spark, rows, sensors), sensors).orderBy("ts").collect()
    known = [[row[s] is not None for s in sensors] for row in got]
    assert known == [[True] * 5, [True] * 5, [False] * 5, [False] * 5, [False] * 5, [False] * 5]


def test_window_statistics_and_labels(spark):
    rows = [(second(0), 0, 1.0), (second(10), 101, 4.0), (second(20), None, 2.0),
            (second(60), None, 7.0), (second(120), 8, 3.0), (second(130), 108, 9.0),
            (second(180), 100, 5.0)]
    got = {r.window_start: r for r in window_features(frame(spark, rows), ["P-PDG"], 60, 60).collect()}
    assert sorted(got) == [second(0), second(120), second(180)]  # the unannotated window is gone
    first = got[second(0)]
    assert (first["P-PDG_mean"], first["P-PDG_min"], first["P-PDG_max"]) == (7 / 3, 1.0, 4.0)
    assert (first["P-PDG_median"], first["P-PDG_range"], first["P-PDG_trend"]) == (2.0, 3.0, 1.0)
    assert first["P-PDG_std"] == pytest.approx(1.5275252316)
    assert (first.raw_class, first.is_transient, first.multiclass, first.binary_target) == (101, 1, 1, 1)
    assert got[second(120)].raw_class == 108
    single = got[second(180)]
    assert (single["P-PDG_std"], single["P-PDG_trend"]) == (0.0, 0.0)
    assert (single.raw_class, single.multiclass, single.binary_target) == (100, 0, 1)


def test_empty_windows_and_absent_sensors(spark):
    sensors = ["P-PDG", "T-TPT"]
    rows = [(second(0), 0, None, None), (second(60), 0, 2.0, None)]
    df = frame(spark, rows, sensors).withColumn("available_sensors", F.array(F.lit("P-PDG")))
    got = window_features(df, sensors, 60, 60).collect()
    assert len(got) == 1 and got[0].window_start == second(60)
    assert got[0]["T-TPT_std"] is None and got[0]["T-TPT_trend"] is None  # sensor not in the file
    present = window_features(frame(spark, rows, sensors), sensors, 60, 60).collect()[0]
    assert (present["T-TPT_std"], present["T-TPT_trend"], present["T-TPT_mean"]) == (0.0, 0.0, None)


def test_slices_do_not_change_features(spark):
    random.seed(5)
    rows = [(second(i * 7), i % 3, None if random.random() < 0.5 else random.random()) for i in range(400)]
    whole = window_features(frame(spark, rows), ["P-PDG"], 60, 9, slice_seconds=None)
    sliced = window_features(frame(spark, rows), ["P-PDG"], 60, 9, slice_seconds=100)
    whole, sliced = (sorted(w.collect(), key=lambda r: r.window_start) for w in (whole, sliced))
    assert len(whole) == len(sliced)
    for a, b in zip(whole, sliced):
        for name, x, y in zip(a.__fields__, a, b):
            if name.endswith(("_mean", "_std")):  # sums may be taken in another order
                assert math.isclose(x, y, rel_tol=1e-12) if x is not None and y is not None else x is y
            else:
                assert x == y


def test_odd_window_length_starts_at_first_midnight(spark):
    rows = [(second(i * 3_000), 0, float(i)) for i in range(40)]
    got = {r.window_start: r["P-PDG_mean"] for r in window_features(frame(spark, rows), ["P-PDG"], 7_000, 5).collect()}
    expected = {}
    for i in range(40):
        expected.setdefault(second(i * 3_000 // 7_000 * 7_000), []).append(float(i))
    assert got == {start: sum(v) / len(v) for start, v in expected.items()}


def test_odd_sliding_windows_start_there_too(spark):
    rows = [(second(i * 3_000), 0, float(i)) for i in range(40)]
    got = {r.window_start: r["P-PDG_mean"] for r in window_features(frame(spark, rows), ["P-PDG"], 7_000, 5, slide_seconds=3_500).collect()}
    expected = {}
    for i in range(40):
        for k in range(-2, 40):
            if k * 3_500 <= i * 3_000 < k * 3_500 + 7_000:
                expected.setdefault(second(k * 3_500), []).append(float(i))
    assert got == {start: sum(v) / len(v) for start, v in expected.items()}


def test_online_windows_do_not_look_back(spark):
    rows = [(second(0), 0, 5.0), (second(60), 0, None), (second(90), 0, 6.0)]
    got = window_features_online(frame(spark, rows).withColumnRenamed("well_id", "device_id"), ["P-PDG"])
    later = got.orderBy(F.desc("window_start")).first()
    assert (later["P-PDG_mean"], later["P-PDG_std"], later.readings) == (6.0, 0.0, 2)


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(2e9,), (-2e9,), (None,), (1.5,)], "a double")
    assert [r.a for r in clip_features(df, ["a"]).collect()] == [1e9, -1e9, None, 1.5]


def test_feature_order():
    names = feature_names()
    assert len(names) == 91 and names[0] == "P-PDG_mean" and names[13] == "P-PDG_std" and names[-1] == "P-JUS-CKP_trend"


@pytest.mark.parametrize("unit", ["ns", "us"])
def test_recording_files(spark, tmp_path, unit):
    def write(folder, name, label, **sensors):
        (tmp_path / folder).mkdir(exist_ok=True)
        stamps = pd.to_datetime([START, second(1)]).astype(f"datetime64[{unit}]")
        columns = {"timestamp": stamps} | {k.replace("_", "-"): v for k, v in sensors.items()}
        pd.DataFrame(columns | {"class": pd.array(label, dtype="Int16")}).to_parquet(tmp_path / folder / name)

    write("3", "WELL-00001_2017.parquet", [3, None], P_PDG=[1.0, 2.0])
    write("8", "WELL-00002_2018.parquet", [108, 8], T_TPT=[60.0, 61.0])
    write("8", "SIMULATED_1.parquet", [8, 8], T_TPT=[60.0, 61.0])
    (tmp_path / "3" / "WELL-00009_bad.parquet").write_bytes(b"no parquet")
    read = rec.read_recordings(spark, str(tmp_path))
    got = {(r.well_id, r.ts): r for r in read.collect()}
    assert len(got) == 4
    row = got["WELL-00001", second(1)]
    assert (row.event_folder, row.instance_file, row["P-PDG"], row["class"]) == ("3", "WELL-00001_2017.parquet", 2.0, None)
    assert got["WELL-00001", second(0)]["T-TPT"] is None and got["WELL-00002", second(0)]["T-TPT"] == 60.0
    assert [r.instance_file for r in rec.files_without_rows(spark, str(tmp_path), read).collect()] == ["WELL-00009_bad.parquet"]
    first = {r.event_folder: r.instance_file for r in rec.first_recording_per_event(read).collect()}
    assert first == {"3": "WELL-00001_2017.parquet", "8": "WELL-00002_2018.parquet"}
    assert window_features(read, window_seconds=60).count() == 2


def test_recordings_of_differing_files(spark, tmp_path):
    """Every readable file has its windows, whatever its types and columns; the others are named."""

    def write(folder, name, **columns):
        (tmp_path / folder).mkdir(exist_ok=True)
        stamps = pd.to_datetime([START, second(1)]).astype("datetime64[us]")
        frame = pd.DataFrame({"timestamp": stamps} | {k.replace("_", "-") if k != "class_" else "class": v for k, v in columns.items()})
        frame.to_parquet(tmp_path / folder / name)

    write("1", "WELL-00001_a.parquet", P_PDG=np.array([1, 2], "float32"), class_=np.array([1, 101], "int16"))
    write("1", "WELL-00002_b.parquet", P_PDG=np.array([3, 4], "int64"), class_=np.array([1, 1], "int64"))
    write("2", "WELL-00003_c.parquet", P_PDG=[5.0, 6.0], class_=[2.0, np.nan])
    write("3", "WELL-00004_d.parquet", P_PDG=[7.0, 8.0])
    write("x", "WELL-00005_e.parquet", T_TPT=[9.0, 9.0])
    write("4", "WELL-00006_f.parquet", flow=[1.0, 3.0], rpm=[5, 7], class_=[4, 4])
    (tmp_path / "4" / "WELL-00007_g.parquet").write_bytes(b"no parquet")
    pd.DataFrame({"timestamp": pd.to_datetime([]).astype("datetime64[us]"), "P-PDG": []}).to_parquet(tmp_path / "4" / "WELL-00008_h.parquet")
    read = rec.read_recordings(spark, str(tmp_path))
    got = {r.instance_file[11]: r for r in window_features(read, rec.sensors_of(read), 60).collect()}
    labels = {k: r.raw_class for k, r in got.items()}
    assert labels == {"a": 101, "b": 1, "c": 2, "d": 3, "e": 0, "f": 4}
    means = {r.instance_file[11]: (r["P-PDG_mean"], r["T-TPT_mean"], r["flow_mean"], r["rpm_trend"]) for r in got.values()}
    assert means["a"][0] == 1.5 and means["b"][0] == 3.5 and means["d"][0] == 7.5 and means["e"][1] == 9.0
    assert means["f"] == (None, None, 2.0, 2.0) and means["a"][3] is None
    missing = {r.instance_file for r in rec.files_without_rows(spark, str(tmp_path), read).collect()}
    assert missing == {"WELL-00007_g.parquet", "WELL-00008_h.parquet"}
    (tmp_path / "deep" / "9").mkdir(parents=True)
    (tmp_path / "deep" / "9" / "WELL-00009_i.parquet").write_bytes(b"no parquet")
    nothing = rec.read_recordings(spark, str(tmp_path / "deep"))
    assert nothing.count() == 0 and set(PRIMARY_SENSORS) < set(nothing.columns)


def test_discover_sensors(spark):
    known = spark.createDataFrame([(1.0, "x", 1)], "`P-PDG` double, `T-TPT` string, class int")
    assert rec.discover_sensors(known) == ["P-PDG"]
    other = spark.createDataFrame([(1.0, 2, 1, 0)], "flow double, state int, class int, rpm int")
    assert rec.discover_sensors(other) == ["flow", "rpm"]


def test_feature_files(spark, tmp_path):
    rows = [(second(i * 60), 0, float(i)) for i in range(5)]
    windows = window_features(frame(spark, rows), ["P-PDG"], 60, 60)
    sinks.write_manifest(windows, str(tmp_path / "manifest"))
    assert sinks.read_manifest(spark, str(tmp_path / "manifest")) == feature_names(["P-PDG"])
    sinks.write_sample(windows, str(tmp_path / "sample"), 3)
    sample = spark.read.option("header", "true").csv(str(tmp_path / "sample"))
    assert sample.count() == 3 and "P-PDG_mean" in sample.columns


def test_all_sensors_have_features(spark):
    rows = [(second(0), 0, *[1.0] * 13)]
    got = window_features(frame(spark, rows, PRIMARY_SENSORS), window_seconds=60)
    assert sinks.feature_columns(got) == feature_names()


def test_windows_over_several_batches_and_without_aggregates(spark):
    random.seed(7)
    rows = [(second(i * 7), i % 3, None if random.random() < 0.2 else random.random()) for i in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        windows = window_features(frame(spark, rows), ["P-PDG"], 60, 0, slide_seconds=20)
        assert "median" not in windows._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1].replace("P-PDG_median", "")
        got = {r.window_start: r for r in windows.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for at, _, x in rows:
        for k in range(3):
            start = int((at - START).total_seconds()) // 20 * 20 - 20 * k
            groups.setdefault(second(start), []).append(x)
    known = {start: [x for x in xs if x is not None] for start, xs in groups.items()}
    assert sorted(got) == sorted(start for start, xs in known.items() if xs)
    for start, r in got.items():
        xs = known[start]
        plain = [np.mean(xs), np.std(xs, ddof=1) if len(xs) > 1 else 0, min(xs), max(xs), np.median(xs), max(xs) - min(xs), xs[-1] - xs[0]]
        assert [r[f"P-PDG_{n}"] for n in ("mean", "std", "min", "max", "median", "range", "trend")] == pytest.approx(plain, abs=1e-12)
