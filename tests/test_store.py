"""Transactions: several checkpoints on the same tables, replays, uniqueness of ids, kept newest rows, compaction."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import latest, metrics
from gaugeworks.operators.layout import _below, z_ordered
from gaugeworks.operators.readings import to_readings
from gaugeworks.schemas import TELEMETRY
from gaugeworks.streaming import compaction, ingest, store, uniqueness
from tests.test_streaming import LINES, land, start

DECODED = "id string, machine_id string, temperature double, pressure double, status string, ts timestamp_ntz, reason string, raw string, ingest_ts timestamp"
START = datetime(2026, 1, 1)


def batch(spark, ids, status="Running"):
    """Decoded rows as a micro-batch has them; an id of None is a reject."""
    rows = [(i, f"EQP-00{int(i) % 3 + 1}", 1.0, 2.0, status, datetime(2026, 1, 1, 0, 0, int(i) % 60), None, "{}", None) if i else (None, None, None, None, None, None, "malformed_json", "{", None) for i in ids]
    return spark.createDataFrame(rows, DECODED)


def line(i):
    return f'{{"Id":"m{i}","MachineId":"EQP-00{i % 3 + 1}","Temperature":1.5,"Pressure":1.5,"Status":"Running","Timestamp":"2026-01-01T00:00:{i:02d}Z"}}'


def stored_ids(spark, found):
    return sorted(r["id"] for r in ingest.committed_telemetry(spark, found).collect())


def whole(spark, found):
    """No transaction is torn, both shapes hold the same, and what is kept of the newest is what all rows give."""
    snap = store.snapshot(spark, found)
    row = metrics.dual_writes(snap.manifest(), snap.telemetry(), snap.readings()).first()
    for n in (1, 3, 100):
        wanted = latest.latest_n_per_machine(snap.telemetry().drop("txn"), n)
        kept = latest.latest_n_per_machine(snap.newest().drop("txn"), n)
        narrow = latest.newest_readings(snap.readings().drop("txn"), n)
        kept_narrow = latest.newest_readings(snap.newest_readings().drop("txn"), n)
        if sorted(map(tuple, wanted.collect())) != sorted(map(tuple, kept.collect())) or sorted(map(tuple, narrow.collect())) != sorted(map(tuple, kept_narrow.collect())):
            return False
    return row["n_torn"] == 0


def test_streams_with_new_checkpoints_keep_all_rows(spark, tmp_path):
    """Batch 0 of a new checkpoint neither overwrites batch 0 of another nor vanishes behind a compaction that replaced it."""
    found = store.Tables(str(tmp_path / "out"))
    land(tmp_path / "a", "x", [line(i) for i in range(5)])
    start(spark, tmp_path, folder="a", check="check-a").awaitTermination()
    land(tmp_path / "b", "x", [line(i) for i in range(10, 13)])
    start(spark, tmp_path, folder="b", check="check-b").awaitTermination()
    wanted = [f"m{i}" for i in (0, 1, 10, 11, 12, 2, 3, 4)]
    assert stored_ids(spark, found) == wanted and whole(spark, found)
    compaction.compact(spark, found)
    assert stored_ids(spark, found) == wanted
    land(tmp_path / "c", "x", [line(i) for i in (20, 21)])
    start(spark, tmp_path, folder="c", check="check-c").awaitTermination()
    wanted = sorted([*wanted, "m20", "m21"])
    assert stored_ids(spark, found) == wanted and whole(spark, found)
    compaction.compact(spark, found)
    assert store.vacuum(spark, found) == 3 and stored_ids(spark, found) == wanted and whole(spark, found)
    # each goes on from its own checkpoint
    land(tmp_path / "a", "y", [line(30)])
    start(spark, tmp_path, folder="a", check="check-a").awaitTermination()
    assert stored_ids(spark, found) == sorted([*wanted, "m30"])
    assert len({r["source"] for r in store.snapshot(spark, found).entries.values()}) == 4  # three checkpoints and the layers


def test_a_replay_writes_once(spark, tmp_path):
    """Before and after a compaction took it, and when other rows bear its name."""
    found, txn = store.Tables(str(tmp_path)), store.Transaction("s", 0)
    assert ingest.commit_batch(batch(spark, ["1", "2"]), txn, found)
    assert not ingest.commit_batch(batch(spark, ["1", "2"]), txn, found)
    compaction.compact(spark, found)
    assert not ingest.commit_batch(batch(spark, ["1", "2", "3"]), txn, found)
    store.vacuum(spark, found)
    assert not ingest.commit_batch(batch(spark, ["1", "2"]), txn, found)
    assert stored_ids(spark, found) == ["1", "2"] and whole(spark, found)


def test_a_replay_is_published_even_when_its_files_are_gone(spark, tmp_path):
    found, txn = store.Tables(str(tmp_path)), store.Transaction("s", 0)
    got = {}
    commit = ingest.publishing(ingest.commit_batch, lambda messages, key: got.__setitem__(key, sorted(r["value"] for r in messages.collect())))
    commit(batch(spark, ["1", "2", None]), txn, found)
    first = got.pop(txn.key)
    compaction.compact(spark, found)
    store.vacuum(spark, found)
    commit(batch(spark, ["1", "2", None]), txn, found)
    assert got == {txn.key: first} and len(first) == 4 and stored_ids(spark, found) == ["1", "2"]


def test_names():
    assert store.Transaction("a-b", 7).key == "a-b-000000000007"
    for source, number in (("", 0), ("a/b", 0), ("a", -1), ("a=b", 1)):
        with pytest.raises(ValueError):
            store.Transaction(source, number)


def test_ids_stored_long_ago(spark, tmp_path):
    """The default commit leaves out ids that are stored, in batches and in layers; a replay of the same batch doesn't shut itself out."""
    found = store.Tables(str(tmp_path))
    for n, ids in enumerate((["1", "2", None], ["2", "3"], ["1", "2"])):
        ingest.commit_batch(batch(spark, ids), store.Transaction("s", n), found)
        if n == 1:
            compaction.compact(spark, found)
    ingest.commit_batch(batch(spark, ["3", "4", "1"]), store.Transaction("other", 0), found)
    assert stored_ids(spark, found) == ["1", "2", "3", "4"] and whole(spark, found)
    totals = ingest.manifest(spark, found).groupBy().sum("n_written", "n_readings", "n_failed", "n_repeated").first()
    assert tuple(totals) == (4, 8, 1, 5)
    left = store.write_shapes(spark, found, store.Transaction("torn", 0), batch(spark, ["9"]).select("id", "machine_id", "temperature", "pressure", "status", "ts"), batch(spark, []).selectExpr("raw", "reason", "0L AS n", "'x' AS origin"))
    assert left["n_written"] == 1  # written, but not committed
    ingest.commit_batch(batch(spark, ["9"]), store.Transaction("torn", 0), found)
    assert stored_ids(spark, found) == ["1", "2", "3", "4", "9"]


def test_redelivery_beyond_the_horizon(spark, tmp_path):
    """The stream's own state has forgotten the ids: the second stream never had them."""
    found = store.Tables(str(tmp_path / "out"))
    land(tmp_path / "in", "a", LINES[:4])
    start(spark, tmp_path, redelivery_horizon="0 seconds").awaitTermination()
    land(tmp_path / "in", "b", LINES)
    start(spark, tmp_path, check="new", redelivery_horizon="0 seconds").awaitTermination()
    assert stored_ids(spark, found) == [str(i) for i in range(6)] and whole(spark, found)


@pytest.mark.parametrize("sizes", [(10, 3_000, 20_000), (1,)])
def test_filters_have_no_false_negatives(spark, sizes):
    """Every id of some filter is known, few others are; only the folders of ids that may be known are read."""
    sets = [[f"{n}-{i}" for i in range(n)] for n in sizes]
    frames = [spark.createDataFrame([(i,) for i in ids], "id string") for ids in sets]
    blocks = [uniqueness.n_blocks(n) for n in sizes]
    assert all(n <= b * uniqueness.IDS_PER_BLOCK and (b == 1 or n > b // 2 * uniqueness.IDS_PER_BLOCK) for n, b in zip(sizes, blocks))
    filters = None
    for frame, b in zip(frames, blocks):
        part = uniqueness.filter_of(frame, b)
        filters = part if filters is None else filters.unionByName(part)
    filters = filters.persist()
    known = [i for ids in sets for i in ids[:500]]
    strangers = [f"stranger {i}" for i in range(3_000)]
    asked = uniqueness.hashed(spark.createDataFrame([(i,) for i in known + strangers], "id string"))
    found = {r["id"] for r in uniqueness.may_be_known(asked, filters, sorted(set(blocks))).collect()}
    assert set(known) <= found and len(found - set(known)) <= 0.06 * len(strangers)


def test_stored_ids_are_read_for_positives_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(uniqueness, "SMALL", 100)
    found = store.Tables(str(tmp_path))
    decoded = lambda ids: spark.createDataFrame([(f"{i}", "EQP-001", 1.0, 1.0, "", START, None, None, None) for i in ids], DECODED)
    ingest.commit_batch(decoded(range(2_000)), store.Transaction("s", 0), found)
    compaction.compact(spark, found)
    snap = store.snapshot(spark, found)
    assert 50 < len(list((tmp_path / "layer_ids").rglob("part=*"))) <= uniqueness.PARTS
    for ids in (["new 1"], ["17"], ["17", "18", "new 2"]):
        rows, held = store.unseen(decoded(ids), snap)
        assert [r["id"] for r in rows.collect()] == [i for i in ids if "new" in i]
        plan = rows._jdf.queryExecution().optimizedPlan().toString() + rows._jdf.queryExecution().executedPlan().toString()
        known = uniqueness.hashed(decoded([i for i in ids if "new" not in i])).select(F.pmod("h", F.lit(uniqueness.PARTS))).collect()
        if known:  # the folders of their hashes, and no others
            listed = ",".join(map(str, sorted({uniqueness.WHOLE, *(r[0] for r in known)})))
            assert f"part#" in plan and sorted(plan.split("IN (")[1].split(")")[0].split(",")) == sorted(listed.split(","))
        else:  # nothing that is stored was looked at but the filter
            assert "layer_ids" not in plan and "part#" not in plan
        held.unpersist()


def test_newest_rows_after_each_batch(spark, tmp_path):
    """Late rows, ties and machines with more rows than are kept; over batches, layers and merged layers."""
    found, rng, n = store.Tables(str(tmp_path)), random.Random(4), 0
    for step in range(5):
        rows = []
        for _ in range(150):
            n += 1
            late = timedelta(minutes=rng.randrange(40) + (0 if step % 2 else 60 * step))
            rows.append((str(n), f"EQP-00{rng.choice([1, 1, 1, 1, 2, 3])}", float(n), 1.0, "", START + late, None, None, None))
        ingest.commit_batch(spark.createDataFrame(rows, DECODED), store.Transaction("s", step), found)
        if step in (1, 3):
            compaction.compact(spark, found)
        assert whole(spark, found), step
    snap = store.snapshot(spark, found)
    assert snap.newest().groupBy("txn", "machine_id").count().agg(F.max("count")).first()[0] == latest.MOST
    assert [r["id"] for r in latest.latest_by_machine(snap.newest(), "EQP-001", 100).collect()] == [r["id"] for r in latest.latest_by_machine(snap.telemetry(), "EQP-001", 100).collect()]


def test_incremental_compaction(spark, tmp_path):
    found = store.Tables(str(tmp_path))
    commit = lambda n, ids, status="Running": ingest.commit_all(batch(spark, ids, status), store.Transaction("s", n), found)
    commit(0, ["1", "2", None])
    commit(1, ["2", "3"], "Again")  # 2 came again, and nobody asked
    commit(2, ["4"])
    assert ingest.committed_telemetry(spark, found).count() == 5
    assert compaction.compact(spark, found, most=2) == "layer-000000000000"
    view = lambda: sorted((r["id"], r["status"]) for r in ingest.committed_telemetry(spark, found).collect())
    once = [("1", "Running"), ("2", "Running"), ("3", "Again"), ("4", "Running")]
    assert view() == once and ingest.committed_readings(spark, found).count() == 8 and ingest.committed_rejects(spark, found).count() == 1
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("txn=layer-000000000000/*.parquet")}
    commit(3, ["1"], "Again")  # 1 was compacted long ago
    assert compaction.compact(spark, found, most=1) == "layer-000000000001"  # of 4 alone; the first layer is three times as large
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("txn=layer-000000000000/*.parquet")} == before  # not rewritten
    assert compaction.compact(spark, found) == "layer-000000000002"
    assert view() == once and whole(spark, found)
    assert compaction.compact(spark, found) is None
    totals = ingest.manifest(spark, found).groupBy().sum("n_written", "n_readings", "n_failed", "n_repeated").first()
    assert tuple(totals) == (4, 8, 1, 2)
    assert store.vacuum(spark, found) >= 5 and view() == once and whole(spark, found)
    assert sorted(p.name for p in (tmp_path / "manifest").glob("s-*")) == []
    assert store.vacuum(spark, found) == 0 and compaction.compact(spark, found) is None
    assert ingest.ingest_batches(spark, found).agg({"n_written": "sum"}).first()[0] == 6  # the streams' own batches are still counted


def test_layers_are_merged(spark, tmp_path):
    """Sixteen compactions of equal batches leave few layers, each more than twice all after it, and the newest rows right."""
    found = store.Tables(str(tmp_path))
    for n in range(16):
        ingest.commit_all(batch(spark, [str(4 * n + k) for k in range(4)]), store.Transaction("s", n), found)
        compaction.compact(spark, found)
    snap = store.snapshot(spark, found)
    sizes = [r["n_written"] for r in snap.layers()]
    assert sum(sizes) == 64 and len(sizes) <= 4 and all(sizes[i] > 2 * sum(sizes[:i]) for i in range(1, len(sizes)))
    assert stored_ids(spark, found) == sorted(str(i) for i in range(64)) and whole(spark, found)
    store.vacuum(spark, found)
    assert stored_ids(spark, found) == sorted(str(i) for i in range(64))


def test_a_compaction_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    found = store.Tables(str(tmp_path))
    ingest.commit_batch(batch(spark, ["1", "2"]), store.Transaction("s", 0), found)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(compaction, "write_manifest", lost)
        with pytest.raises(RuntimeError):
            compaction.compact(spark, found)
    assert ingest.committed_telemetry(spark, found).count() == 2
    assert compaction.compact(spark, found) == "layer-000000000000" and ingest.committed_telemetry(spark, found).count() == 2


def test_torn_transactions_are_seen(spark, tmp_path):
    found = store.Tables(str(tmp_path))
    for n, ids in enumerate((["1"], ["2", "3"])):
        ingest.commit_batch(batch(spark, ids), store.Transaction("s", n), found)
    snap = store.snapshot(spark, found)
    rows, narrow, said = snap.telemetry(), snap.readings(), snap.manifest()
    assert metrics.dual_writes(said, rows, narrow).first()["n_torn"] == 0
    assert metrics.dual_writes(said, rows.where("id <> '1'"), narrow).first()["n_torn"] == 1
    assert metrics.dual_writes(said, rows, narrow.where("sensor_type = 'Pressure'")).first()["n_torn"] == 2


def test_dead_letters_are_counted_and_tried_again(spark, tmp_path):
    found = store.Tables(str(tmp_path / "out"))
    bad = LINES[0].replace('"Temperature":0.5', '"Temperature":null')
    land(tmp_path / "in", "a", [bad, bad, "null", LINES[1]])
    land(tmp_path / "in", "b", [bad, "{", "{"])
    start(spark, tmp_path).awaitTermination()
    counted = lambda: {(r["raw"], r["n"]) for r in ingest.dead_letters(ingest.committed_rejects(spark, found)).collect()}
    assert counted() == {(bad, 3), ("null", 1), ("{", 2)}
    assert ingest.manifest(spark, found).groupBy().sum("n_failed").first()[0] == 6
    repair = lambda rejects: rejects.withColumn("value", F.replace("raw", F.lit("null"), F.lit("7")))
    txn = ingest.replay_rejects(spark, found, repair)
    assert txn == store.Transaction("replay", 0) and stored_ids(spark, found) == ["0", "1"]  # equal messages, once
    said = store.snapshot(spark, found).entries[txn.key]
    assert len(said["replayed"]) == 2 and said["n_written"] == 1
    assert ingest.replay_rejects(spark, found, repair) is None  # all were tried
    compaction.compact(spark, found)
    assert ingest.replay_rejects(spark, found, repair) is None and stored_ids(spark, found) == ["0", "1"]
    land(tmp_path / "in", "c", [bad.replace('"Id":"0"', '"Id":"9"'), bad])
    start(spark, tmp_path).awaitTermination()
    assert ingest.replay_rejects(spark, found, repair) == store.Transaction("replay", 1)
    assert stored_ids(spark, found) == ["0", "1", "9"] and whole(spark, found)  # 0 was repaired before


def test_files_read_for_a_machine_and_for_a_minute(spark, tmp_path):
    """Along the curve both lookups open few files; machine first would open all for a minute."""
    rows = spark.range(40_000).select(
        F.col("id").cast("string").alias("id"), F.format_string("EQP-%03d", F.pmod(F.xxhash64("id"), F.lit(200))).alias("machine_id"), F.lit(1.0).alias("temperature"), F.lit(1.0).alias("pressure"), F.lit("").alias("status"),
        (F.lit(START) + F.make_dt_interval(secs=F.col("id"))).cast("timestamp_ntz").alias("ts"),
    )
    import pyarrow.parquet as pq

    z_ordered(rows, 36).write.parquet(str(tmp_path / "z"))
    files = list((tmp_path / "z").glob("*.parquet"))
    assert spark.read.schema(TELEMETRY).parquet(str(tmp_path / "z")).count() == 40_000 and 30 <= len(files) <= 36

    def read(column, low, high):
        stats = [pq.ParquetFile(f).metadata.row_group(0).column(column).statistics for f in files]
        return sum(s.min <= high and s.max >= low for s in stats)

    machine = read(1, "EQP-077", "EQP-077")
    minute = read(5, START + timedelta(seconds=39_940), START + timedelta(seconds=40_000))
    assert machine <= 12 and minute <= 12, (machine, minute)
    for f in files:
        keys = [tuple(r.values()) for r in pq.read_table(f, columns=["machine_id", "ts"]).to_pylist()]
        assert keys == sorted(keys)


def test_z_order_of_odd_rows(spark):
    rows = spark.createDataFrame([("a", None, 1.0, 1.0, "", None), ("b", "M", 1.0, 1.0, "", START), ("c", "M", 1.0, 1.0, "", START)], TELEMETRY)
    for files in (1, 5):
        assert sorted(r["id"] for r in z_ordered(rows, files).collect()) == ["a", "b", "c"]
        assert z_ordered(rows.limit(0), files).count() == 0


def test_readings_of_kept_rows(spark, tmp_path):
    found = store.Tables(str(tmp_path))
    ingest.commit_batch(batch(spark, ["1", "2", "3", "4"]), store.Transaction("s", 0), found)
    snap = store.snapshot(spark, found)
    assert sorted(map(tuple, snap.newest_readings().drop("txn").collect())) == sorted(map(tuple, to_readings(snap.telemetry()).collect()))
    assert latest.latest_readings(snap.newest_readings(), "EQP-002", "pressure", 5).count() == 2


def test_files_grow_before_they_multiply():
    """The number of files, and with it of tasks and what they send to the driver, is bounded until files are large."""
    small, large = 64 << 10, 128 << 20
    assert [compaction.n_files(n, small) for n in (0, 1, small, small + 1, 64 * small)] == [0, 1, 1, 2, 64]
    assert compaction.n_files(10**9, small) == 64 and compaction.n_files(6 * 10**9, small) == 64
    assert compaction.n_files(100 * large, small) == compaction.n_files(100 * large, large) == 100
    assert compaction.n_files(10 * large, 2 * large) == 5


def test_spans_are_found_by_bisection(spark):
    cuts = [3, 5, 9, 10, 20]
    rows = spark.range(25).select("id", _below(F.col("id"), cuts).alias("n")).collect()
    assert all(r["n"] == sum(c < r["id"] for c in cuts) for r in rows)


def test_filters_shuffle_ids_only(spark):
    """No task sends bits of blocks: they are set where a block's ids are gathered, in one exchange."""
    rows = spark.range(50_000).select(F.col("id").cast("string").alias("id"))
    found = uniqueness.filter_of(rows, 16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "bitmap_construct_agg" not in plan[plan.index("Exchange hashpartitioning") :]
    assert found.count() == 16
    asked = uniqueness.may_be_known(uniqueness.hashed(rows), found, [16])
    assert asked.count() == 50_000


def test_filters_sort_an_id_once(spark):
    """An id's bits are set side by side, in an aggregate over a row an id, not over a row a bit; all of them are set."""
    ids = [str(i) for i in range(500)]
    rows = spark.createDataFrame([(i,) for i in ids], "id string")
    found = uniqueness.filter_of(rows, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan[plan.index("bitmap_construct_agg") :]  # plans begin with what comes last
    wanted = {}
    for r in uniqueness.hashed(rows).select(uniqueness._block(4).alias("block"), uniqueness._bits().alias("places")).collect():
        wanted.setdefault(r["block"], set()).update(r["places"])
    got = {r["block"]: {8 * i + b for i, byte in enumerate(r["bits"]) for b in range(8) if byte >> b & 1} for r in found.collect()}
    assert got == wanted and uniqueness.filter_of(rows.limit(0), 4).count() == 0


def test_only_ties_are_ranked_again(spark):
    """What is kept of machines without more rows than that is neither sorted nor ranked for each shape; ties, nulls and late rows included."""
    at = lambda m: START + timedelta(minutes=m)
    data = [(f"{m}{i}", m, float(i), 1.0, "", at(i // width)) for m, width, n in (("A", 1, 3), ("B", 4, 9), ("C", 1, 30), ("D", 9, 9)) for i in range(n)]
    data += [("n1", None, 1.0, 1.0, "", None), ("n2", None, 2.0, 1.0, "", at(1)), ("n3", "A", 1.0, 1.0, "", None)]
    rows = spark.createDataFrame(data, TELEMETRY)
    kept = latest.counted_instants(rows, 5)
    assert {r["machine_id"]: r["n_kept"] for r in kept.collect()} == {"A": 4, "B": 5, "C": 5, "D": 9, None: 2}
    got = latest.newest_of_instants(kept, latest.latest_n_per_machine, 5)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in latest.latest_n_per_machine(rows, 5).collect())
    got = latest.newest_of_instants(kept, latest.newest_readings, 5, to_readings)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in latest.newest_readings(to_readings(rows), 5).collect())


def test_newest_shapes_of_a_transaction_rank_ties_only(spark, tmp_path, monkeypatch):
    """What is ranked for the kept rows, but for the ranking by instant itself, are machines with ties at the end."""
    ranked = {}
    for name in ("latest_n_per_machine", "newest_readings"):
        of = getattr(store, name)
        monkeypatch.setattr(store, name, lambda rows, n, of=of, name=name: (ranked.update({name: rows.count()}), of(rows, n))[1])
    found = store.Tables(str(tmp_path))
    ingest.commit_batch(batch(spark, ["1", "2", "3", "4"]), store.Transaction("s", 0), found)
    assert ranked == {"latest_n_per_machine": 0, "newest_readings": 0}
    assert whole(spark, found)


def test_a_bulk_load_writes_each_shape_once(spark, tmp_path):
    """Stored tables come from one transaction, the first layer; of an id that comes twice one row stays."""
    from gaugeworks.plans import derived

    rows = batch(spark, ["1", "2", "3", "2"]).drop("reason", "raw", "ingest_ts")
    found = store.Tables(str(tmp_path / "bulk"))
    assert compaction.load(spark, rows, found) == "layer-000000000000"
    snap = store.snapshot(spark, found)
    (said,) = snap.entries.values()
    assert (said["n_written"], said["n_readings"], said["n_repeated"], said["n_failed"]) == (3, 6, 1, 0)
    assert sorted(r["id"] for r in snap.telemetry().collect()) == sorted(r["id"] for r in snap.newest().collect()) == ["1", "2", "3"]
    assert snap.readings().count() == snap.newest_readings().count() == 6
    assert ingest.commit_batch(batch(spark, ["3", "4"]), store.Transaction("s", 0), found)  # ids of the load are known
    assert store.snapshot(spark, found).telemetry().count() == 4
    with pytest.raises(ValueError, match="empty"):
        compaction.load(spark, rows, found)

    tables = derived._stored(spark, "/root/testdata/sf0.001")
    for table in (tables.telemetry, tables.readings, tables.newest, tables.newest_readings):
        assert [p.name for p in Path(table).iterdir() if p.name.startswith("txn=")] == ["txn=layer-000000000000"]


def test_a_layer_shuffles_snapshots_not_readings(spark, tmp_path, monkeypatch):
    """Readings are made behind the exchange that lays them out, in order; machines and times are ranged once for both shapes."""
    from gaugeworks.operators import layout

    rows = batch(spark, [str(i) for i in range(1, 200)]).drop("reason", "raw", "ingest_ts")
    plans, ranged = [], []
    write, ends = compaction.write_shapes, layout.spans
    plan_of = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()

    def seen(spark, tables, txn, telemetry, bad, readings, layer):
        plans.extend([plan_of(telemetry), plan_of(readings(telemetry))])
        return write(spark, tables, txn, telemetry, bad, readings, layer)

    counted = lambda *args: (ranged.append(1), ends(*args))[1]
    monkeypatch.setattr(compaction, "write_shapes", seen)
    monkeypatch.setattr(layout, "spans", counted)
    monkeypatch.setattr(compaction, "spans", counted, raising=False)
    monkeypatch.setattr(compaction, "LOAD_FILE", 1 << 10)
    found = store.Tables(str(tmp_path / "out"))
    compaction.load(spark, rows, found)
    wide, narrow = plans
    assert "Repartition" in wide and len(ranged) == 1
    assert narrow.index("Generate") < narrow.index("Repartition")  # plans begin with what comes last
    snap = store.snapshot(spark, found)
    assert sorted(map(tuple, snap.readings().drop("txn").collect())) == sorted(map(tuple, to_readings(snap.telemetry()).collect()))
    files = list(Path(f"{found.readings}/txn=layer-000000000000").glob("*.parquet"))
    assert len(files) > 1
    for f in files:
        keys = [(r["machine_id"], r["ts"]) for r in spark.read.parquet(str(f)).collect()]
        assert keys == sorted(keys)
