"""The ingest stream: run, crash between the tables and the manifest, replay, redelivery, supervision, compaction."""

from __future__ import annotations

import time
from datetime import datetime

import pytest

from gaugeworks.operators import latest, metrics
from gaugeworks.streaming import compaction, ingest, live, store

LINES = [f'{{"Id":"{i}","MachineId":"EQP-00{i % 3 + 1}","Temperature":{i}.5,"Pressure":1.5,"Status":"Running","Timestamp":"2026-01-01T00:00:0{i}Z"}}' for i in range(6)]


def land(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def start(spark, root, commit=ingest.commit_batch, folder="in", check="check", **kwargs):
    source = ingest.file_source(spark, str(root / folder), max_files=1)
    return ingest.start_ingest(source, store.Tables(str(root / "out")), str(root / check), processing_time=None, commit=commit, **kwargs)


def stored(spark, root):
    found = store.Tables(str(root / "out"))
    return sorted(r["id"] for r in ingest.committed_telemetry(spark, found).collect()), ingest.committed_readings(spark, found).count()


def test_ingest_and_redelivery(spark, tmp_path):
    land(tmp_path / "in", "a", [*LINES[:4], LINES[0], "null", "{"])
    start(spark, tmp_path).awaitTermination()
    land(tmp_path / "in", "b", [*LINES[2:], "null"])
    start(spark, tmp_path).awaitTermination()
    assert stored(spark, tmp_path) == ([str(i) for i in range(6)], 12)
    found = store.Tables(str(tmp_path / "out"))
    assert sorted((r["raw"], r["reason"], r["n"]) for r in ingest.dead_letters(ingest.committed_rejects(spark, found)).collect()) == [("null", "null_payload", 2), ("{", "malformed_json", 1)]
    totals = ingest.manifest(spark, found).groupBy().sum("n_written", "n_readings", "n_failed").first()
    assert tuple(totals) == (6, 12, 3)


def test_crash_before_the_manifest(spark, tmp_path):
    land(tmp_path / "in", "a", LINES)

    def crash(rows, txn, tables):
        ingest.commit_batch(rows, txn, tables)
        import shutil

        shutil.rmtree(f"{tables.manifest}/{txn.key}")
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        start(spark, tmp_path, crash).awaitTermination()
    assert stored(spark, tmp_path) == ([], 0)  # written, but not committed
    start(spark, tmp_path).awaitTermination()
    assert stored(spark, tmp_path) == ([str(i) for i in range(6)], 12)


def test_retries(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(time, "sleep", waits.append)

    def failing():
        calls.append(1)
        raise OSError("full")

    with pytest.raises(OSError):
        ingest.with_retries(failing)
    assert len(calls) == 3 and waits == [2.0, 4.0]
    ingest.with_retries(lambda: None)


def test_restart_intensity(monkeypatch):
    """So many failures in so long, not over the query's life."""
    waits, clock = [], [0.0]

    def sleep(s):
        waits.append(s)
        clock[0] += s

    monkeypatch.setattr(time, "sleep", sleep)
    monkeypatch.setattr(time, "monotonic", lambda: clock[0])

    class Query:
        def __init__(self, fails, after=0.0):
            self.fails, self.after = fails, after

        def awaitTermination(self):  # noqa: N802
            clock[0] += self.after
            if self.fails:
                raise RuntimeError("down")

    runs = iter([Query(True), Query(True), Query(False)])
    assert ingest.supervise(lambda: next(runs)) == 2 and waits == [5.0, 10.0]
    with pytest.raises(ingest.TooManyFailures) as e:
        ingest.supervise(lambda: Query(True), max_restarts=1)
    assert isinstance(e.value.__cause__, RuntimeError)
    # forty failures, one an hour, are no more than one in ten minutes
    runs = iter([Query(True, 3600.0)] * 40 + [Query(False)])
    assert ingest.supervise(lambda: next(runs), max_restarts=1) == 40


@pytest.mark.parametrize("where", ["write_shapes", "write_manifest"])
def test_supervision_of_a_real_stream(spark, tmp_path, monkeypatch, where):
    """Commits that die between the tables or before the manifest: the stream comes back and each row is there once."""
    for name, lines in (("a", LINES[:3]), ("b", LINES[2:])):
        land(tmp_path / "in", name, lines)
    real, calls = getattr(ingest, where), []

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) in (1, 2, 4):
            if where == "write_shapes":  # one shape is there, the others aren't
                real(*args, **kwargs)
            raise OSError("lost")
        return real(*args, **kwargs)

    monkeypatch.setattr(ingest, where, failing)
    assert ingest.supervise(lambda: start(spark, tmp_path), wait_s=0.01) == 3
    assert stored(spark, tmp_path) == ([str(i) for i in range(6)], 12)
    calls.clear()
    monkeypatch.setattr(ingest, where, lambda *a, **k: (_ for _ in ()).throw(OSError("full")))
    land(tmp_path / "in", "c", [LINES[0].replace('"Id":"0"', '"Id":"c"')])
    with pytest.raises(ingest.TooManyFailures):
        ingest.supervise(lambda: start(spark, tmp_path), max_restarts=2, wait_s=0.01)
    assert stored(spark, tmp_path) == ([str(i) for i in range(6)], 12)


def test_metrics_and_compaction(spark, tmp_path):
    found = store.Tables(str(tmp_path / "out"))
    listener = ingest.BatchMetrics(spark, found)
    spark.streams.addListener(listener)
    try:
        land(tmp_path / "in", "a", [*LINES[:3], LINES[0]])
        start(spark, tmp_path).awaitTermination()
        land(tmp_path / "in", "b", LINES[3:])
        start(spark, tmp_path).awaitTermination()
        for _ in range(60):
            if (tmp_path / "out" / "ingest_batches").exists() and spark.read.parquet(found.batches).count() >= 2:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    batches = ingest.ingest_batches(spark, found)
    assert tuple(metrics.ingest_counters(batches).first()) == (7, 6, 12, 0)
    assert batches.where("duration_s > 0 AND flushed_at IS NOT NULL").count() == 2
    # the seventh message was a redelivery: left out, and no fault
    row = metrics.reconcile(batches, ingest.committed_telemetry(spark, found), ingest.committed_readings(spark, found)).first()
    assert (row["n_left_out"], row["reconciled"], row["healthy"]) == (1, True, True)
    assert compaction.compact(spark, found) == "layer-000000000000"
    rows = ingest.committed_telemetry(spark, found)
    assert rows.count() == 6 and ingest.committed_readings(spark, found).count() == 12
    assert [r["id"] for r in latest.latest_by_machine(store.snapshot(spark, found).newest(), "EQP-001", 5).collect()] == ["3", "0"]
    assert tuple(ingest.manifest(spark, found).select("n_written", "n_readings", "n_failed").first()) == (6, 12, 0)


def batch(spark, ids, status="Running"):
    """Decoded rows as a micro-batch has them; an id of None is a reject."""
    rows = [(i, f"EQP-00{int(i) % 3 + 1}", 1.0, 2.0, status, datetime(2026, 1, 1, 0, 0, int(i)), None, "{}", None) if i else (None, None, None, None, None, None, "malformed_json", "{", None) for i in ids]
    return spark.createDataFrame(rows, "id string, machine_id string, temperature double, pressure double, status string, ts timestamp_ntz, reason string, raw string, ingest_ts timestamp")


def test_nothing_stored_yet(spark, tmp_path):
    """All tables can be read before the first batch, and after a stream without messages."""
    land(tmp_path / "in", "a", [])
    (tmp_path / "in" / "a").write_text("")
    start(spark, tmp_path).awaitTermination()
    found = store.Tables(str(tmp_path / "out"))
    for rows in (ingest.committed_telemetry(spark, found), ingest.committed_readings(spark, found), ingest.committed_rejects(spark, found), ingest.manifest(spark, found), ingest.ingest_batches(spark, found)):
        assert rows.count() == 0
    assert compaction.compact(spark, found) is None and store.vacuum(spark, found) == 0
    assert store.snapshot(spark, found).newest().count() == store.snapshot(spark, found).newest_readings().count() == 0
    assert ingest.replay_rejects(spark, found, lambda r: r) is None
    assert metrics.accounted(ingest.ingest_batches(spark, found), 0).first()["accounted"]


def test_publishing_to_several_sinks(spark, tmp_path):
    land(tmp_path / "in", "a", LINES)
    land(tmp_path / "in", "b", [LINES[0], "{"])
    calls = []

    def failing(messages, key):
        calls.append(key)
        if len(calls) == 1:
            raise OSError("busy")

    a, b = (ingest.text_sink(str(tmp_path / "published" / x)) for x in "ab")
    old, time.sleep = time.sleep, lambda s: None
    try:
        start(spark, tmp_path, ingest.publishing(ingest.commit_batch, a, failing, b)).awaitTermination()
    finally:
        time.sleep = old
    got = [sorted(r["value"] for r in spark.read.text(str(tmp_path / "published" / x)).select("value").collect()) for x in "ab"]
    assert got[0] == got[1] and len(set(got[0])) == 12 and sum('"SensorType":"Pressure"' in m for m in got[0]) == 6


def test_two_second_trigger(spark, tmp_path):
    """Files that land while the stream runs come in with the next trigger; empty triggers write nothing."""
    land(tmp_path / "in", "a", LINES[:2])
    source = ingest.file_source(spark, str(tmp_path / "in"))
    found = store.Tables(str(tmp_path / "out"))
    query = ingest.start_ingest(source, found, str(tmp_path / "check"), processing_time="2 seconds")
    try:
        wanted = 0
        for name, lines, wanted in (("a", [], 2), ("b", LINES[2:5], 5)):
            if lines:
                land(tmp_path / "in", name, lines)
            end = time.monotonic() + 60
            while ingest.committed_telemetry(spark, found).count() < wanted and time.monotonic() < end:
                time.sleep(0.5)
        time.sleep(4.5)  # two more triggers
        assert ingest.committed_telemetry(spark, found).count() == wanted == 5
        assert ingest.manifest(spark, found).count() == 2
    finally:
        query.stop()


def test_rates_are_corrected(spark, tmp_path):
    """Update mode: a late row corrects its window as long as the watermark keeps it; one that is too late counts in none."""
    folder = tmp_path / "rows"
    minute = lambda m: datetime(2026, 1, 1, 0, m, 30)
    stream = spark.readStream.schema("ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    seen = []
    for n, stamps in enumerate(([minute(0), minute(1), minute(1)], [minute(9)], [minute(1)], [minute(30)], [minute(31)], [minute(1)])):
        spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz").coalesce(1).write.parquet(str(folder / str(n)))
        live.start_live_rate(live.live_rate(stream, "1 minute", None, "10 minutes"), str(tmp_path / "rates"), str(tmp_path / "check"), None).awaitTermination()
        if n % 2:
            live.fold_rates(spark, str(tmp_path / "rates"))
        seen.append({r["window_start"].minute: r["n"] for r in live.live_rates(spark, str(tmp_path / "rates")).collect()})
    assert seen[0] == {0: 1, 1: 2} and seen[2] == {0: 1, 1: 3, 9: 1}
    assert seen[-1] == {0: 1, 1: 3, 9: 1, 30: 1, 31: 1}  # the last row came after its window was closed
    assert live.fold_rates(spark, str(tmp_path / "rates")) == 0
    # the state was given up: only windows that may still change are in it
    query = live.start_live_rate(live.live_rate(stream, "1 minute", None, "10 minutes"), str(tmp_path / "rates"), str(tmp_path / "check"), None)
    query.awaitTermination()
    spark.createDataFrame([(minute(59),)], "ts timestamp_ntz").coalesce(1).write.parquet(str(folder / "9"))
    query = live.start_live_rate(live.live_rate(stream, "1 minute", None, "10 minutes"), str(tmp_path / "rates"), str(tmp_path / "check"), None)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_sliding_rates(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2026, 1, 1, 0, 1, 30),), (datetime(2026, 1, 1, 0, 2, 10),)], "ts timestamp_ntz")
    rows.write.parquet(str(tmp_path / "rows"))
    stream = spark.readStream.schema("ts timestamp_ntz").parquet(str(tmp_path / "rows"))
    live.start_live_rate(live.live_rate(stream, "1 minute", "30 seconds"), str(tmp_path / "rates"), str(tmp_path / "check"), None).awaitTermination()
    out = {(r["window_start"].minute, r["window_start"].second): r["n"] for r in live.live_rates(spark, str(tmp_path / "rates")).collect()}
    assert out == {(1, 0): 1, (1, 30): 2, (2, 0): 1}


def test_silent_machines(spark, tmp_path):
    """Processing-time timers: a machine is reported when it is first heard of, when it falls silent, and when it is back."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = []
    try:
        folder = tmp_path / "rows"
        put = lambda n, rows: spark.createDataFrame(rows, "machine_id string, ts timestamp_ntz").coalesce(1).write.parquet(str(folder / str(n)))
        put(0, [("A", datetime(2026, 1, 1)), ("A", datetime(2026, 1, 2)), ("B", datetime(2026, 1, 1))])
        stream = spark.readStream.schema("machine_id string, ts timestamp_ntz").parquet(f"{folder}/*")
        keep = lambda rows, _: events.extend((r["machine_id"], r["state"], r["last_ts"].day) for r in rows.collect())
        query = live.liveness(stream, 4.0).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
        try:
            wait = lambda wanted: _until(lambda: wanted in events, query)
            wait(("B", "silent", 1))
            put(1, [("A", datetime(2026, 1, 3))])
            wait(("A", "alive", 3))
            wait(("A", "silent", 3))
        finally:
            query.stop()
    finally:
        spark.conf.set(provider, before)
    assert sorted(events) == [("A", "alive", 2), ("A", "alive", 3), ("A", "silent", 2), ("A", "silent", 3), ("B", "alive", 1), ("B", "silent", 1)]
    rows = spark.createDataFrame([("A", datetime(2026, 1, 3)), ("A", datetime(2026, 1, 1)), ("B", datetime(2026, 1, 1))], "machine_id string, ts timestamp_ntz")
    assert [tuple(r) for r in live.silent_machines(rows, datetime(2026, 1, 3, 0, 0, 30), 60).collect()] == [("B", datetime(2026, 1, 1), 2 * 86_400 + 30.0)]


def _until(condition, query, seconds=90):
    end = time.monotonic() + seconds
    while not condition():
        assert time.monotonic() < end and query.exception() is None, query.exception()
        time.sleep(0.2)


def test_every_message_is_accounted_for(spark, tmp_path):
    found = store.Tables(str(tmp_path / "out"))
    listener = ingest.BatchMetrics(spark, found)
    spark.streams.addListener(listener)
    try:
        for name, lines in (("a", [*LINES[:4], LINES[0], "null", "null", "null", "{"]), ("b", [*LINES[2:], "null"]), ("c", ["null", LINES[1]])):
            land(tmp_path / "in", name, lines)
            query = start(spark, tmp_path)
            query.awaitTermination()
            listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    batches = ingest.ingest_batches(spark, found)
    assert tuple(batches.groupBy().sum("n_consumed", "n_rejected", "n_dropped").first()) == (16, 6, 4)
    assert tuple(metrics.accounted(batches, 16).first()) == (6, 6, 0, 0, True)
    assert tuple(metrics.accounted(batches, 17).first()) == (6, 6, 1, 0, False)  # a message that was never read
    short = batches.withColumn("n_written", batches["n_written"] - 1)
    assert not metrics.accounted(short, 16).first()["accounted"]  # one lost before the commit


def test_published_files_are_compressed(spark, tmp_path):
    """What two sinks get of every reading is most of what an ingest writes."""
    path = tmp_path / "published"
    lines = [f'{{"Id":"m{i}","SensorType":"Pressure","Value":1.5}}' for i in range(2000)]
    ingest.text_sink(str(path))(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1), "s-0")
    (file,) = (path / "txn=s-0").glob("*.gz")
    assert file.stat().st_size < sum(map(len, lines)) / 4
    assert sorted(r["value"] for r in spark.read.text(str(path)).select("value").collect()) == sorted(lines)


def test_tasks_of_a_commit_report_nothing_of_the_state(spark, tmp_path):
    """A commit reads its batch from files: the stateful stage isn't behind it, and good rows carry no raw text through it."""
    land(tmp_path / "in", "a", [*LINES, "{"])
    seen = []

    def commit(rows, txn, tables):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        raws = sorted((r["reason"] or "", r["raw"]) for r in rows.collect())
        seen.append((plan, raws, [f for f in rows.inputFiles() if "batches-" in f]))
        ingest.commit_batch(rows, txn, tables)

    start(spark, tmp_path, commit).awaitTermination()
    ((plan, raws, files),) = seen
    assert "Deduplicate" not in plan and "InMemoryTableScan" not in plan and files
    assert raws == [("", None)] * 6 + [("malformed_json", "{")]
    assert stored(spark, tmp_path) == ([str(i) for i in range(6)], 12)
    from pathlib import Path

    assert not any(Path(f.removeprefix("file:").replace("///", "/")).exists() for f in files)
