"""Latest-N, readings, statistics and metrics on tiny tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks import schemas
from gaugeworks.functions.expressions import machine_id
from gaugeworks.operators import aggregates, latest, metrics, readings
from gaugeworks.sources import tables

START = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def telemetry(spark):
    rows = [(f"{m}-{i}", f"EQP-00{m}", 20.0 + i, 1.0 + m, "Running", START + timedelta(minutes=i)) for m, n in ((1, 5), (2, 2)) for i in range(n)]
    return spark.createDataFrame(rows, schemas.TELEMETRY)


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize("count", [0, -1, 101])
def test_counts_out_of_range(telemetry, count):
    with pytest.raises(ValueError, match="count must be between 1 and 100"):
        latest.latest_by_machine(telemetry, "EQP-001", count)
    with pytest.raises(ValueError, match="count must be between 1 and 100"):
        latest.latest_n_per_machine(telemetry, count)


def test_latest_by_machine(telemetry):
    assert ids(latest.latest_by_machine(telemetry, "EQP-001", 3)) == ["1-4", "1-3", "1-2"]
    assert len(ids(latest.latest_by_machine(telemetry, "EQP-001", 100))) == 5
    none = latest.latest_by_machine(telemetry, "M001")
    assert ids(none) == [] and none.schema == telemetry.schema


def test_ties_go_to_the_greater_id(spark):
    rows = spark.createDataFrame([(i, "A", 1.0, 1.0, "", START) for i in ("a", "c", "b")], schemas.TELEMETRY)
    assert ids(latest.latest_by_machine(rows, "A", 2)) == ["c", "b"]
    assert ids(latest.latest_n_per_machine(rows, 1)) == ["c"]


@pytest.mark.parametrize("sensor", ["pressure", "PRESSURE", "Pressure"])
def test_sensor_in_any_case(telemetry, sensor):
    found = latest.latest_readings(readings.to_readings(telemetry), "EQP-001", sensor, 2).collect()
    assert [(r["sensor_type"], r["unit"]) for r in found] == [("Pressure", "bar")] * 2
    assert "id" not in found[0].asDict()


@pytest.mark.parametrize("sensor", [None, "", "  "])
def test_blank_sensor_is_all(telemetry, sensor):
    found = latest.latest_readings(readings.to_readings(telemetry), "EQP-001", sensor, 3).collect()
    assert [r["sensor_type"] for r in found] == ["Temperature", "Pressure", "Temperature"]


def test_latest_of_each(telemetry):
    assert sorted(ids(latest.latest_n_per_machine(telemetry, 2))) == ["1-3", "1-4", "2-0", "2-1"]
    assert sorted(ids(latest.latest_n_per_machine(telemetry, 100))) == sorted(ids(telemetry))
    assert latest.latest_n_per_sensor(readings.to_readings(telemetry), 3).count() == 2 * (3 + 2)


def test_unpivot_and_back(telemetry):
    narrow = readings.to_readings(telemetry)
    assert narrow.count() == 2 * telemetry.count()
    assert narrow.select("id").distinct().count() == narrow.count()
    back = readings.to_snapshots(narrow)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, telemetry.select("machine_id", "ts", "temperature", "pressure").collect()))


def test_first_by_id(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "z", 1), ("a", "y", 1)], "id string, v string, arrival int")
    assert sorted(map(tuple, readings.first_by_id(rows, "arrival").collect())) == [("a", "y"), ("b", "z")]


def test_first_by_id_shuffles_columns_once(spark):
    """The aggregate's buffer is one struct, so no column crosses the shuffle both as value and as order."""
    rows = spark.createDataFrame([("a", None, 2.0, 1), ("a", "y", None, 1), ("b", None, None, 3), ("a", "x", 0.0, 1)], "id string, v string, w double, arrival int")
    found = readings.first_by_id(rows, "arrival")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "min_by" not in plan
    assert sorted(map(tuple, found.collect())) == [("a", None, 2.0), ("b", None, None)]  # nulls come first
    assert found.columns == ["id", "v", "w"]


def test_violations(spark):
    rows = spark.createDataFrame([("a" * 50,), ("a" * 51,), (None,)], "machine_id string")
    assert [r[0] for r in rows.select(readings.violation("machine_id")).collect()] == [None, "too_long", "null_required"]


def test_machine_ids_keep_all_digits(spark):
    assert [r[0] for r in spark.range(1).select(machine_id(F.lit(7))).collect()] == ["EQP-007"]
    assert [r[0] for r in spark.range(1).select(machine_id(F.lit(1234))).collect()] == ["EQP-1234"]


def test_recent_is_strict(telemetry):
    assert aggregates.recent_count(telemetry, START + timedelta(minutes=4), "1 minute").first()["n"] == 1
    assert aggregates.recent_count(telemetry).first()["n"] == 0


def test_stats(telemetry):
    assert tuple(aggregates.machine_stats(telemetry, "EQP-002").first()) == ("EQP-002", 20.5, 3.0)
    assert aggregates.machine_stats(telemetry, "M001").collect() == []
    assert aggregates.fleet_stats(telemetry).count() == 2


def test_freshness(spark, telemetry):
    now = START + timedelta(minutes=5)
    assert tuple(aggregates.freshness(telemetry, now, 61).first())[1:] == (60.0, None, None, True)
    assert tuple(aggregates.freshness(telemetry, now, 60).first())[1:] == (60.0, None, None, False)
    assert tuple(aggregates.freshness(telemetry.limit(0), now).first()) == (None, None, None, None, False)
    flushes = spark.createDataFrame([(START,), (START + timedelta(minutes=3),), (None,)], "flushed_at timestamp")
    assert tuple(aggregates.freshness(telemetry, now, 61, flushes).first())[1:] == (60.0, START + timedelta(minutes=3), 120.0, False)
    assert aggregates.freshness(telemetry, now, 121, flushes).first()["healthy"]
    assert not aggregates.freshness(telemetry, now, 121, flushes.limit(0)).first()["healthy"]
    later = START + timedelta(minutes=4)
    assert aggregates.freshness(telemetry, now, 61, flushes, later).first()["flush_age_s"] == 60.0


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([(START + timedelta(seconds=i), "500" if i == 3 else "200", float(i)) for i in range(1, 11)], "ts timestamp_ntz, code string, duration_ms double")


def test_metrics(spark, requests):
    assert [r["n"] for r in metrics.latency_histogram(requests, bounds=(1, 5, 100)).collect()] == [1, 5, 10, 10]
    assert metrics.error_ratio(requests, "1 day").first()["error_ratio"] == 0.1
    assert metrics.rate_per_second(requests, "1 day", 86_400).first()["n"] == 10
    assert metrics.latency_percentile(requests, "1 day", 0.5).first()["latency"] == 5.5
    assert metrics.latency_percentile(requests, "1 day", 0.5, exact=False).first()["latency"] == 5.0
    assert metrics.latency_percentile_bucketed(requests, "1 day", 0.5, (5.0, 10.0)).first()["latency"] == 5.0
    slo = metrics.slo_summary(requests).first()
    assert (slo["n"], slo["avg_ms"], slo["p95_ok"], slo["errors_ok"]) == (10, 5.5, True, False)
    assert metrics.is_server_error(F.lit("1500")) is not None


@pytest.mark.parametrize("values", [[], [1.0], [2.0, 1.0], [None, 5.0, 5.0, 5.0, 1.0], [float(i * i % 101) for i in range(500)]])
def test_exact_percentiles(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    qs = (0.0, 0.5, 0.9, 0.95, 1.0)
    expected = rows.agg(*[F.percentile("v", q) for q in qs]).first()
    assert tuple(metrics.exact_percentiles(rows, "v", qs).first()) == pytest.approx(tuple(expected), nan_ok=True)


def test_counters(spark, telemetry):
    batches = spark.createDataFrame([(7, 7, 14, 0)], "n_consumed long, n_written long, n_readings long, n_failed long")
    assert metrics.reconcile(batches, telemetry, readings.to_readings(telemetry)).first()["healthy"]
    assert not metrics.reconcile(batches, telemetry.limit(3), readings.to_readings(telemetry)).first()["reconciled"]
    lost = spark.createDataFrame([(9, 7, 14, 0, 1, None)], "n_consumed long, n_written long, n_readings long, n_failed long, n_dropped long, n_repeated long")
    assert not metrics.reconcile(lost, telemetry, readings.to_readings(telemetry)).first()["reconciled"]  # one is neither written nor left out
    assert metrics.reconcile(lost.withColumn("n_repeated", F.lit(1)), telemetry, readings.to_readings(telemetry)).first()["healthy"]
    assert tuple(metrics.ingest_counters(batches.limit(0)).first()) == (0, 0, 0, 0)


def test_filters_reach_the_scan(spark, telemetry, tmp_path):
    telemetry.write.parquet(f"{tmp_path}/t")
    stored = tables.scan_telemetry(spark, f"{tmp_path}/t")
    plan = aggregates.machine_stats(stored, "EQP-001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(machine_id,EQP-001)" in plan and "TakeOrderedAndProject" in plan
    assert "status" not in plan.split("ReadSchema")[1]
    plan = aggregates.recent_count(stored, START)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts," in plan
    plan = latest.latest_n_per_machine(stored, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1
    plan = aggregates.fleet_stats(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_lookups_prune_the_stored_tables(spark, tmp_path):
    """The compacted layout: the predicate reaches the scan, and row groups of other machines aren't read."""
    import pyarrow.parquet as pq

    from gaugeworks.streaming import compaction, ingest, store

    rows = [(f"{m}-{i}", f"EQP-{m:03d}", 1.0, 1.0, "Running", START + timedelta(minutes=i), None, None) for i in range(50) for m in range(1, 41)]
    found = store.Tables(str(tmp_path))
    ingest.commit_batch(spark.createDataFrame(rows, f"{schemas.TELEMETRY}, reason string, raw string").repartition(6), store.Transaction("load", 0), found)
    layer = compaction.compact(spark, found, file_bytes=4_000)
    groups = [pq.ParquetFile(p).metadata.row_group(0).column(1).statistics for p in (tmp_path / "telemetry" / f"txn={layer}").glob("*.parquet")]
    assert len(groups) >= 4 and sum(g.min <= "EQP-007" <= g.max for g in groups) <= 0.6 * len(groups)
    snap = store.snapshot(spark, found)
    for stored, narrow in ((snap.telemetry(), snap.readings()), (snap.newest(), snap.newest_readings())):
        lookup = latest.latest_by_machine(stored, "EQP-007", 3)
        assert ids(lookup) == ["7-49", "7-48", "7-47"]
        plan = lookup._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(machine_id,EQP-007)" in plan and "TakeOrderedAndProject" in plan and "Join" not in plan
        assert "EqualTo(machine_id,EQP-007)" in latest.latest_readings(narrow, "EQP-007", "pressure", 3)._jdf.queryExecution().executedPlan().toString()
    ingest.register_views(snap)
    assert spark.sql("SELECT COUNT(*) FROM telemetry WHERE machine_id = 'EQP-007'").first()[0] == 50
    assert spark.sql("SELECT COUNT(*) FROM sensor_readings").first()[0] == 4000


def test_sketches(spark):
    """The rank error as stated, for narrow windows merged to wide ones; exact where there are few values."""
    from gaugeworks.operators import sketches

    rows = spark.range(60_000).select((F.lit(START) + F.make_dt_interval(secs=F.col("id") % 7200)).cast("timestamp_ntz").alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(10_007)) ** 2).cast("double").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(START, None)], "ts timestamp_ntz, v double")).repartition(7)
    minutes = sketches.sketched(rows, "v")
    assert minutes.count() == 120
    values = {h: sorted(r["v"] for r in rows.where(F.hour("ts") == h).collect() if r["v"] is not None) for h in (0, 1)}
    hours = sketches.widened(minutes, "1 hour").select("window_start", "n", *[sketches.quantile(q).alias(f"q{i}") for i, q in enumerate((0.05, 0.5, 0.95))]).collect()
    assert {r["window_start"].hour: r["n"] for r in hours} == {h: len(v) for h, v in values.items()}
    for r in hours:
        of = values[r["window_start"].hour]
        for i, q in enumerate((0.05, 0.5, 0.95)):
            rank = sum(v <= r[f"q{i}"] for v in of) / len(of)
            assert abs(rank - q) <= sketches.RANK_ERROR + 1e-3
    both = sketches.widened(minutes).select("n", sketches.quantile(0.5).alias("m"), sketches.rank(F.lit(0.0)).alias("r")).first()
    assert both["n"] == 60_000 and both["r"] < 0.02
    few = sketches.sketched(spark.createDataFrame([(START, float(v)) for v in range(1, 101)], "ts timestamp_ntz, v double"), "v")
    assert few.select(sketches.quantile(0.5).alias("m")).first()["m"] == 50.0
    assert sketches.widened(sketches.sketched(rows.limit(0), "v")).count() == 0


def test_rate_series(spark):
    """Idle windows are there, with 0; sums are of the counters, nulls count as 0."""
    at = lambda s: START + timedelta(seconds=s)
    rows = spark.createDataFrame([(at(5), 10, 1), (at(59), 2, None), (at(241), 7, 0), (None, 99, 99)], "ts timestamp_ntz, n_consumed long, n_failed long")
    out = metrics.rate_series(rows, ["n_consumed", "n_failed"], 60).orderBy("window_start").collect()
    assert [tuple(r) for r in out] == [(at(60 * i), n, n / 60, k, k / 60) for i, (n, k) in enumerate([(12, 1), (0, 0), (0, 0), (0, 0), (7, 0)])]
    assert metrics.rate_series(rows.limit(0), ["n_consumed"], 60).count() == 0


def test_shared_folder(spark, monkeypatch):
    from gaugeworks import session

    assert session.written(spark.range(3), "x").count() == 3
    assert session.drop_written(spark) >= 1 and session.drop_written(spark) == 0

    class Cluster:
        conf = type("C", (), {"get": lambda self, *_: None})()
        sparkContext = type("S", (), {"getCheckpointDir": lambda self: None, "master": "spark://host:7077"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())
