"""The composed services over several micro-batches against the same work in one batch."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from wellspring.constants import PRIMARY_SENSORS
from wellspring.operators import evidence, models, reports, retrieval, throttle
from wellspring.operators import telemetry as views
from wellspring.operators.windows import feature_names, window_features_online
from wellspring.plans import stream_queries
from wellspring.sources.documents import chunk_sections
from wellspring.sources.messages import decode_messages, topic_filter
from wellspring.streaming import jobs
from wellspring.streaming.ledger import Ledger
from wellspring.streaming.service import MessageService, StatisticsService, WindowService, drip, model_scorer, report_writer

START = dt.datetime(2024, 3, 1)


def second(n):
    return START + dt.timedelta(seconds=n)


def run_in_parts(spark, rows, at, cuts, service, folder):
    """The service, restarted after each part of ``rows``."""

    def run():
        source = jobs.read_stream(spark, f"{folder}/in", rows.schema, files=1000)
        service.start(source, f"{folder}/checkpoint").awaitTermination()

    drip(rows, at, f"{folder}/in", cuts, run)


def sequential(rows, cooldown):
    """The rule row by row: (device, id) to fired."""
    state, out = {}, {}
    for device, number, at, event in rows:
        last = state.get(device)
        out[device, number] = last is None or last[0] != event or (at - last[1]).total_seconds() >= cooldown
        if out[device, number]:
            state[device] = (event, at)
    return out


# -- throttle over batches -------------------------------------------------------------------


@pytest.mark.parametrize("slice_seconds", [7, 300])
def test_throttle_goes_on_where_the_last_batch_ended(spark, slice_seconds):
    rng = random.Random(slice_seconds)
    rows, at = [], 0
    for number in range(600):
        at += rng.randint(0, 20)
        rows.append((rng.choice("ab"), number, second(at), rng.choice("XXXXXY")))
    schema = "device_id string, id long, timestamp timestamp, event string"
    got, state = {}, None
    for start in range(0, 600, 170):
        part = spark.createDataFrame(rows[start : start + 170], schema)
        flagged = throttle.throttle(part, 30, slice_seconds, entry=state).persist()
        got |= {(r.device_id, r.id): r.fired for r in flagged.collect()}
        last = throttle.last_diagnoses(flagged, state)
        state = spark.createDataFrame(last.collect(), "device_id string, event string, at long")
    assert got == sequential(rows, 30)


def test_one_device_with_a_million_rows_equals_the_loop(spark):
    """Cut into slices, so no task holds the device's rows."""
    n = 1_000_000
    event = F.when(F.col("id") % 9973 < 40, "Y").otherwise("X")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") * 1.7))
    rows = spark.range(n).select(F.lit("w").alias("device_id"), "id", at.alias("timestamp"), event.alias("event"))
    fired = throttle.throttle(rows, 30, 3600).filter("fired").agg(F.count("*"), F.sum("id"), F.max("id")).first()
    expected, last = [], None
    for i in range(n):
        e, t = "Y" if i % 9973 < 40 else "X", int(i * 1.7)
        if last is None or last[0] != e or t - last[1] >= 30:
            expected.append(i)
            last = (e, t)
    assert tuple(fired) == (len(expected), sum(expected), expected[-1])


# -- messages --------------------------------------------------------------------------------


def message(number, device, at, **fields):
    body = {"device_id": device, "device_type": "oil_well", "timestamp": str(at), "fault": None, **fields}
    return (number, f"factory/oil_well/{device}/telemetry", json.dumps({k: v for k, v in body.items() if v is not None}), at)


SCHEMA = "id long, topic string, payload string, sent timestamp"


@pytest.fixture(scope="module")
def fitted(spark):
    """Both forests on windows in which a low P-TPT is event 3."""
    rng = random.Random(0)
    names, rows = feature_names(), []
    for i in range(120):
        event = 3 if i % 2 else 0
        level = (1e6 if event else 15e6) + rng.random() * 1e5
        values = [level if n.startswith("P-TPT") and not n.endswith(("_std", "_range", "_trend")) else rng.random() for n in names]
        rows.append((f"r{i}", second(i), int(event > 0), event, *values))
    columns = ", ".join(f"`{n}` double" for n in names)
    train = spark.createDataFrame(rows, f"instance_file string, window_start timestamp, binary_target int, multiclass int, {columns}")
    return models.train_models(train, names, {n: 0.0 for n in names})


@pytest.fixture(scope="module")
def knowledge(spark):
    text = "# Slugging\n## Possible Root Causes\n1. gas\n2. choke\n3. riser\n## Critical Safety Considerations\nKeep everybody away from the pressurised lines.\n"
    documents = spark.createDataFrame([("event_3_slugging.md", text)], "doc_name string, text string")
    return retrieval.fit_index(chunk_sections(documents))


def sent_messages():
    rng = random.Random(3)
    rows, at = [], 0
    for number in range(80):
        at += rng.randint(1, 25)
        low = rng.random() < 0.6
        rows.append(message(number, rng.choice(["W1", "W2"]), second(at), **{"P-TPT": 1.0e6 if low else 15.0e6, "T-TPT": 60}))
    rows.append((900, "factory/oil_well/W1/telemetry", '{"device_id": "W1", "dev', second(at)))
    rows.append((901, "office/oil_well/W1/telemetry", "{}", second(at)))
    rows.append((902, "factory/oil_well/W1/telemetry", json.dumps({"device_id": "W1", "timestamp": str(second(at))}), second(at)))
    rows.append(rows[5][:3] + (second(at),))  # a message of long ago arrives again
    return rows, at


def test_message_to_diagnosis_in_batches_equals_one_batch(spark, fitted, knowledge, tmp_path):
    rows, end = sent_messages()
    stream = spark.createDataFrame(rows, SCHEMA)
    service = MessageService(Ledger(spark, str(tmp_path / "out")), model_scorer(fitted), report_writer(knowledge), 60, 120, 600)
    run_in_parts(spark, stream, "sent", [second(end // 3), second(2 * end // 3)], service, str(tmp_path))
    got = {r.id: r for r in service.telemetry().collect()}

    decoded = decode_messages(topic_filter(stream)).withColumn("payload", F.col("fields")).filter("reject IS NULL")
    decided = {r.id: r for r in model_scorer(fitted)(decoded.drop("fields").dropDuplicates(["id"])).collect()}
    assert set(got) == set(decided) and len(got) == service.telemetry().count() == 80
    assert {i: (r.status, r.predicted_event, r.confidence) for i, r in got.items()} == {
        i: (r.status, r.predicted_event, r.confidence) for i, r in decided.items()
    }
    assert {r.status for r in got.values()} == {"anomaly", "normal"}
    assert all(r.fault == (r.predicted_event if r.status == "anomaly" else None) for r in got.values())
    ordered = sorted((r.timestamp, r.id, r.device_id, r.predicted_event) for r in got.values() if r.status == "anomaly")
    fired = sequential([(d, i, t, e) for t, i, d, e in ordered], 60)
    assert {(r.device_id, i): r.fired for i, r in got.items() if r.status == "anomaly"} == fired
    assert 1 < sum(fired.values()) < len(fired)
    for r in got.values():
        assert (r.diagnosis is not None) == r.fired
        assert not r.fired or ("POSSIBLE CAUSES" in r.diagnosis and "Severe Slugging" in r.diagnosis)
    assert [r.id for r in service.ledger.all("late-rows").collect()] == [5]
    letters = {r.id: r.reject for r in service.ledger.all("dead-letters").collect()}
    assert letters == {900: "invalid json", 902: "missing device_type"}
    answers = {r.id: r.alert for r in service.ledger.all("answers").collect()}
    assert answers == {i: r.status == "anomaly" for i, r in got.items()}


def cold(df):
    low = F.expr(views.number_sql("T-TPT")) < 50
    return df.withColumns({"status": F.when(low, "anomaly").otherwise("normal"), "predicted_event": F.lit("Hydrate"), "confidence": F.lit(0.5)})


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = [message(i, "W", START + dt.timedelta(hours=11 * i), **{"T-TPT": 10 + 50 * (i % 3 == 0)}) for i in range(12)]
    service = MessageService(Ledger(spark, str(tmp_path / "out")), cold, None, 3600 * 20, 10**6)
    parts = [spark.createDataFrame(part, SCHEMA).drop("sent") for part in (rows[:5], rows[5:9], rows[9:])]
    for number, part in enumerate(parts):
        service.process(part, number)
    first = sorted(service.telemetry().collect())
    service.process(parts[2], 2)  # as after a failure behind the writes
    assert sorted(service.telemetry().collect()) == first and len(first) == 12
    fires = sequential([("W", i, START + dt.timedelta(hours=11 * i), "Hydrate") for i in range(12) if i % 3], 3600 * 20)
    assert {("W", r.id): r.fired for r in first if r.status == "anomaly"} == fires
    day = service.telemetry().filter("day = DATE '2024-03-03'")
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()
    assert {r.id for r in day.collect()} == {5, 6}


# -- windows and counts ----------------------------------------------------------------------


def test_stream_windows_all_come_out_and_late_rows_are_kept(spark, tmp_path):
    rng = random.Random(9)
    rows, at = [], 0
    for i in range(300):
        at += rng.randint(0, 9)
        rows.append((rng.choice("abc"), i, second(at), *(rng.choice([None, rng.uniform(10, 90)]) for _ in PRIMARY_SENSORS)))
    columns = ", ".join(f"`{s}` double" for s in PRIMARY_SENSORS)
    frame = spark.createDataFrame(rows, f"device_id string, id long, ts timestamp, {columns}")
    service = WindowService(Ledger(spark, str(tmp_path / "out")), PRIMARY_SENSORS, 60, 30)
    run_in_parts(spark, frame, "ts", [second(at // 4), second(at // 2)], service, str(tmp_path))
    before = service.ledger.all("features").count()
    expected = {(r.device_id, r.window_start): r for r in window_features_online(frame, PRIMARY_SENSORS, 60, order=("ts", "id")).collect()}
    assert before < len(expected)
    closing = spark.createDataFrame([(None, None, second(at + 200), *[None] * 13), ("a", 999, second(0), *[1.0] * 13)], frame.schema)
    closing.write.mode("append").parquet(str(tmp_path / "in"))
    service.start(jobs.read_stream(spark, str(tmp_path / "in"), frame.schema, files=1000), str(tmp_path / "checkpoint")).awaitTermination()
    found = service.ledger.all("features").collect()
    assert {(r.device_id, r.window_start): r for r in found} == expected and len(found) == len(expected)
    assert [r.id for r in service.ledger.all("late-rows").collect()] == [999]


def test_running_statistics_equal_the_report(spark, tmp_path):
    rows = [
        (i, f"W{i % 37}", second(i), ["Slugging", None, "Hydrate"][i % 3], '{"diagnosis": "x"}' if i % 5 == 0 else "{}") for i in range(400)
    ]
    frame = spark.createDataFrame(rows, "id long, device_id string, timestamp timestamp, fault string, sensor_data string")
    service = StatisticsService(Ledger(spark, str(tmp_path / "out")))
    for number, (low, high) in enumerate([(0, 100), (100, 101), (101, 400), (0, 0)]):
        service.process(frame.filter(f"id >= {low} AND id < {high}"), number)
    assert service.totals(3).collect() == reports.telemetry_stats(frame).collect()
    assert sorted(service.ledger.newest("fault-counts", 3).collect()) == sorted(reports.fault_counts(frame).collect())
    assert sorted(service.ledger.newest("device-counts", 3).collect()) == sorted(reports.asset_fault_counts(frame).collect())


def test_sketch_counts_many_devices_within_its_error(spark, tmp_path):
    service = StatisticsService(Ledger(spark, str(tmp_path / "out")))
    frame = spark.range(60_000).selectExpr(
        "id", "concat('D', id % 20000) AS device_id", "TIMESTAMP '2024-01-01 00:00:00' AS timestamp", "CAST(NULL AS STRING) AS fault", "'{}' AS sensor_data")
    for number in range(2):
        service.process(frame.filter(f"id % 2 = {number}"), number)
    assert abs(service.totals(1).first().total_wells - 20_000) < 3 * 0.0163 * 20_000


@pytest.mark.parametrize("before,after", [(0, 0), (7, 0), (5, 30), (600, 600)])
def test_readings_around_incidents_equal_all_pairs(spark, before, after):
    rng = random.Random(before)
    rows = [(i, rng.choice("abb"), second(rng.randint(-300, 300)), float(i)) for i in range(200)]
    readings = spark.createDataFrame([*rows, (500, None, second(0), 1.0), (501, "a", None, 1.0)], "id long, device_id string, timestamp timestamp, x double")
    incidents = readings.filter("id % 7 = 0 OR id >= 500")
    found = sorted((r.incident_id, r.id, r.offset_seconds) for r in reports.around(incidents, readings, before, after).collect())
    pairs = [(a, b, (tb - ta).total_seconds()) for a, da, ta, _ in rows if a % 7 == 0 for b, db, tb, _ in rows if da == db]
    assert found == sorted(p for p in pairs if -before <= p[2] <= after)


def test_fused_decisions_name_the_event(spark, fitted):
    """The decision of a snapshot follows the label its level stands for."""
    rows = spark.createDataFrame([(1, {"P-TPT": "1000000"}), (2, {"P-TPT": "15000000"}), (3, {"P-TPT": "n/a"})], "id long, payload map<string,string>")
    got = {r.id: (r.status, r.predicted_event) for r in model_scorer(fitted)(rows).collect()}
    assert got[1] == ("anomaly", "Severe Slugging") and got[2] == ("normal", evidence.NORMAL_EVENT)
    assert len(got) == 3


def test_parts_of_a_table_of_one_row_group_come_from_many_tasks(spark, tmp_path):
    rows = [(i, START + dt.timedelta(seconds=i), i % 7, "error", float(i), '{"k": %d}' % (i % 90)) for i in range(400)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    for sent in (stream_queries.messages(spark, str(tmp_path)), stream_queries.arriving_readings(spark, str(tmp_path))):
        at = "sent" if "sent" in sent.columns else "ts"
        part = sent.filter(F.col(at) < F.lit(START + dt.timedelta(seconds=200)))
        sizes = [r["count"] for r in part.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 200 and len(sizes) >= 8 and max(sizes) <= 50
