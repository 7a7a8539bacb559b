"""Rules, views, reports, messages, throttling and streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wellspring.operators import evidence, reports, rules, throttle
from wellspring.operators import telemetry as views
from wellspring.sources import messages as msg
from wellspring.sources import sinks
from wellspring.streaming import jobs
from wellspring.streaming.ledger import Ledger
from wellspring.streaming.service import ThrottleService

START = dt.datetime(2024, 3, 1)


def second(n):
    return START + dt.timedelta(seconds=n)


def payloads(spark, rows):
    return views.parse_payload(spark.createDataFrame(rows, "device_type string, sensor_data string"))


def detected(spark, kind, body):
    return rules.detect_faults(payloads(spark, [(kind, body)])).first().detected


def test_rule_example(spark):
    body = '{"spindle_temperature": 95, "vibration": "10", "tool_wear": 90}'
    assert detected(spark, "CNC", body) == ["spindle_overheating", "excessive_vibration", "tool_wear"]
    assert detected(spark, "LATHE", body) == []


@pytest.mark.parametrize("kind, at_limit, fired", [
    ("CNC", '{"spindle_temperature": 85, "vibration": 8, "tool_wear": 80}', []),
    ("PRESS", '{"hydraulic_pressure": 80, "oil_temperature": 85, "vibration": 8}', []),
    ("PRESS", "{}", ["hydraulic_pressure_drop"]),
    ("CONVEYOR", '{"motor_temperature": 85, "belt_alignment": 5, "vibration": 8}', []),
    ("ROBOT", '{"motor_temperature": 85, "joint_vibration": 8, "load": 90}', []),
    ("PUMP", '{"cavitation": 0.8, "pressure": 40, "motor_temperature": 85}', []),
    ("PUMP", '{"outlet_pressure": 60}', ["pressure_drop"]),
    ("COMPRESSOR", '{"discharge_pressure": 150, "motor_temperature": 85, "vibration": 8}', []),
    ("ENERGY_METER", '{"voltage_imbalance": 5, "power_factor": 0.7, "thd": 8}', []),
    ("ENERGY_METER", '{"power_factor": 0.69}', ["low_power_factor"]),
    ("ENERGY_METER", '{"power_factor": null}', []),
])
def test_limits_are_strict(spark, kind, at_limit, fired):
    assert detected(spark, kind, at_limit) == fired


def test_rule_aliases(spark):
    df = payloads(spark, [("PUMP", '{"outlet_pressure": 60}')])
    assert rules.detect_faults(df, aliases={"pressure": "outlet_pressure"}).first().detected == []


def store(spark, rows):
    return spark.createDataFrame(rows, sinks.TELEMETRY_SCHEMA)


def test_empty_store(spark):
    stats = reports.telemetry_stats(store(spark, [])).first()
    assert tuple(stats) == (0, 0, 0, "N/A", "N/A", 0)
    assert reports.latest_anomaly(store(spark, [])).count() == 0
    assert reports.fault_kpis(store(spark, [])).first().dominant_fault is None


def test_latest_anomaly_preferences(spark):
    rows = [(1, "WELL-1", "oil_well", second(1), "A", "{}"), (2, "PUMP-1", "PUMP", second(5), "B", "{}"),
            (3, "WELL-2", "oil_well", second(9), None, '{"diagnosis": null}'), (4, "", "PUMP", second(9), None, '{"diagnosis": {"x": 1}}')]
    df = store(spark, rows)
    assert reports.latest_anomaly(df).first().id == 1
    assert reports.latest_anomaly(df.filter("id <> 1")).first().id == 2
    assert reports.latest_anomaly(df.filter("fault is null")).first().id == 4
    assert reports.latest_anomaly(df, "WELL-2").count() == 0
    assert [r.device_id for r in reports.distinct_wells(df).collect()] == ["PUMP-1", "WELL-1", "WELL-2"]
    assert reports.telemetry_stats(df).first().total_diagnoses == 1
    assert {r.device_id: r.id for r in reports.latest_per_well(df).collect()}["WELL-2"] == 3


def test_store_and_export(spark, tmp_path):
    rows = [(i, "WELL-1", "oil_well", second(i * 40_000), None, '{"P-PDG": 2.5e7, "P-ANULAR": 1000}') for i in range(6)]
    path = str(tmp_path / "store")
    sinks.append_telemetry(store(spark, rows[:4]), path)
    sinks.append_telemetry(store(spark, rows[3:]), path)  # a repeated message stays
    read = sinks.read_telemetry(spark, path)
    assert read.count() == 7
    plan = read.filter(F.col("day") == F.lit(second(0)).cast("date"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    sinks.export_telemetry(views.flatten_telemetry(read), str(tmp_path / "csv"))
    exported = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert exported.count() == 7 and float(exported.first()["P-PDG"]) == 2.5e7 * 1e-5 and exported.first()["P-ANULAR"] == "1000.0"


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 0.1), (1, "a", 0.9)], sinks.IMPORTANCE_SCHEMA)
    sinks.write_csv(df, str(tmp_path / "r"))
    assert [r.Feature for r in sinks.read_report(spark, str(tmp_path / "r"), sinks.IMPORTANCE_SCHEMA, 1).collect()] == ["a"]


def test_message_rejects(spark):
    good = '{"device_id": "W", "device_type": "oil_well", "timestamp": "2024-03-01T00:00:05.5", "fault": null, "n": {"a": 1}}'
    rows = [("factory/x/W/telemetry", good), ("factory/x/W/telemetry", "{broken"), ("factory/x/telemetry", good),
            ("factory/x/W/telemetry", '{"device_type": "PUMP", "timestamp": "2024-03-01"}')]
    df = msg.decode_messages(msg.topic_filter(spark.createDataFrame(rows, "topic string, payload string")))
    got = [(r.device_id, r.timestamp, r.reject) for r in df.collect()]
    assert got == [("W", second(5.5), None), ("LIVE-DEVICE", None, "invalid json"),
                   ("LIVE-DEVICE", second(0), "missing device_id")]
    assert msg.accepted(df).count() == 1 and msg.dead_letters(df).count() == 2


def test_live_feed_filters_after_the_limit(spark):
    rows = [(i, "WELL-1", "oil_well", second(i), "A" if i < 3 else None, "{}") for i in range(6)]
    assert views.live_feed(store(spark, rows), 3, status="anomalies").count() == 0
    assert views.live_feed(store(spark, rows), 4, status="anomalies").count() == 1


def test_deviation_order_and_location(spark):
    body = '{"P-PDG": 2.0e7, "P-TPT": 1e6, "T-TPT": 10, "QGL": 1}'
    view = views.flatten_telemetry(store(spark, [(1, "W", "oil_well", second(0), "A", body)]))
    row = evidence.localize(view).first()
    assert [d.sensor for d in row.deviation] == ["P-TPT", "T-TPT", "P-PDG", "QGL"]
    assert row.location == "Subsea Wellhead" and row.confidence_pct == 65.0
    assert row.deviation[0].measured == "10.00 bar" and row.deviation[0].envelope == "50.0 – 250.0 bar"


FIXED = [(0, "A", True), (10, "A", False), (12, "B", True), (20, "A", True), (49, "A", False), (50, "A", True), (79, "A", False)]


def anomalies(spark, rows):
    return spark.createDataFrame(rows, "device_id string, id long, timestamp timestamp_ntz, event string")


def flags(df):
    return {(r.device_id, r.id): r.fired for r in df.collect()}


def sequential(rows, cooldown):
    state, result = {}, {}
    for device, number, at, event in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        last = state.get(device)
        fired = last is None or last[0] != event or (at - last[1]).total_seconds() >= cooldown
        if fired:
            state[device] = (event, at)
        result[device, number] = fired
    return result


@pytest.mark.parametrize("slice_seconds", [None, 7, 30])
def test_throttle_sequence(spark, slice_seconds):
    rows = [("w", i, second(at), event) for i, (at, event, _) in enumerate(FIXED)]
    got = flags(throttle.throttle(anomalies(spark, rows), 30, slice_seconds))
    assert [got["w", i] for i in range(len(FIXED))] == [fired for _, _, fired in FIXED]


@pytest.mark.parametrize("slice_seconds", [5, 40, 300])
def test_throttle_equals_loop(spark, slice_seconds):
    random.seed(slice_seconds)
    rows, number = [], 0
    for device, (step, change) in {"a": (3, 0.0), "b": (12, 0.1), "c": (45, 0.3), "d": (1, 0.004)}.items():
        at, event = 0, "A"
        for _ in range(300):
            at += random.randint(0, 2 * step)
            event = random.choice("AB") if random.random() < change else event
            rows.append((device, number, second(at), event))
            number += 1
    random.shuffle(rows)
    assert flags(throttle.throttle(anomalies(spark, rows), 30, slice_seconds)) == sequential(rows, 30)


def test_throttle_stream_keeps_state(spark, tmp_path):
    rows = [("w", i, second(at), event) for i, (at, event, _) in enumerate(FIXED)]
    for part in range(3):
        part_rows = rows[part * 3:(part + 1) * 3]
        anomalies(spark, part_rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = jobs.read_stream(spark, str(tmp_path / "in"), anomalies(spark, []).schema, files=1)
    service = ThrottleService(Ledger(spark, str(tmp_path / "out")), 30)
    service.start(source, str(tmp_path / "checkpoint")).awaitTermination()
    got = flags(service.ledger.all("flags"))
    assert [got["w", i] for i in range(len(FIXED))] == [fired for _, _, fired in FIXED]


def test_message_stream_to_store(spark, tmp_path):
    body = '{"device_id": "W", "device_type": "oil_well", "timestamp": "2024-03-01 00:00:05", "fault": "told", "T-TPT": %s}'
    rows = [(i, "factory/oil_well/W/telemetry", body % t) for i, t in enumerate((60, 10))]
    schema = "id long, topic string, payload string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    source = jobs.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)

    def cold(df):
        low = F.expr(views.number_sql("T-TPT")) < 50
        return df.withColumns({"status": F.when(low, "anomaly").otherwise("normal"),
                               "predicted_event": F.lit("Hydrate in Production Line")})

    def work(batch):
        fired = batch.withColumn("fired", F.col("status") == "anomaly").drop("payload")
        return jobs.store_batch(fired, lambda rows: rows.select("id", F.lit("report").alias("diagnosis")))

    path = jobs.drain(spark, "m", lambda p, c: jobs.each_batch(jobs.telemetry_stream(source, cold), p, c, work))
    got = {r.id: (r.fault, r.diagnosis) for r in spark.read.parquet(path).collect()}
    assert got == {0: ("told", None), 1: ("Hydrate in Production Line", "report")}


def test_a_judged_message_is_parsed_once(spark):
    rows = spark.createDataFrame([("factory/x/D/telemetry", "D"), ("factory/x/E/telemetry", None)], "topic string, device string")
    sent = rows.select("topic", F.to_json(F.struct(F.col("device").alias("device_id"))).alias("payload"))
    dead = msg.dead_letters(msg.decode_messages(sent)).select("device_id", "reject")
    assert dead._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted(map(tuple, dead.collect())) == [("D", "missing device_type"), ("LIVE-DEVICE", "missing device_id")]
