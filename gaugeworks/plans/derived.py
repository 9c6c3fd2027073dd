"""What the named queries start from: telemetry, requests, messages and stored tables, all derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import exists, listing, scratch
from gaugeworks.sources import messages, tables
from gaugeworks.streaming import compaction, ingest, store

#: Tables that are stored already, by application, kind and the source's files.
_ready: dict[tuple, store.Tables] = {}


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.telemetry_of_events(tables.events(spark, sf_dir))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.requests_of_events(tables.events(spark, sf_dir))


def _once(spark: SparkSession, kind: str, sf_dir: str, make) -> store.Tables:  # noqa: ANN001
    """Made by the first query that asks, and read by those after it while the source's files stay as they are."""
    key = (spark.sparkContext.applicationId, kind, listing(spark, f"{sf_dir}/events.parquet"))
    found = _ready.get(key)
    if found is None or not exists(spark, found.manifest):  # never made, or deleted since
        found = _ready[key] = make(spark, sf_dir)
    return found


def _stored(spark: SparkSession, sf_dir: str) -> store.Tables:
    found = store.Tables(scratch(spark, "telemetry"))
    compaction.load(spark, snapshots(spark, sf_dir), found)
    return found


def stored_tables(spark: SparkSession, sf_dir: str) -> store.Snapshot:
    """All tables as they are stored and compacted."""
    return store.snapshot(spark, _once(spark, "stored", sf_dir, _stored))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tables(spark, sf_dir).telemetry().drop("txn")


def sensor_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tables(spark, sf_dir).readings().drop("txn")


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lookups of the newest rows read in place of all telemetry."""
    return stored_tables(spark, sf_dir).newest().drop("txn")


def newest_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tables(spark, sf_dir).newest_readings().drop("txn")


def day_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's snapshots as one batch, flushed when the day began, for ages whose times are fixed."""
    return snapshots(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("flushed_at")).agg(F.count("*").alias("n_consumed"))


def damaged_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, value: telemetry as messages; some are damaged by their number, one kind each."""
    rows = messages.to_messages(snapshots(spark, sf_dir), keep=("id",))
    value, n = F.col("value"), F.col("id").cast("long")
    swapped = lambda member, to: F.regexp_replace(value, f'"{member}":("[^"]*"|[^,}}]*)', to)
    broken = (
        F.when(n % 97 == 0, F.lit("null"))
        .when(n % 89 == 0, F.substring(value, 1, 12))
        .when(n % 83 == 0, swapped("Temperature", '"Temperature":null'))
        .when(n % 79 == 0, swapped("MachineId", '"MachineId":null'))
        .when(n % 73 == 0, F.concat(F.lit('{"Status":"'), F.repeat(F.lit("x"), 51), F.lit('"}')))
        .when(n % 71 == 0, swapped("MachineId", '"MachineId":5'))
        .when(n % 67 == 0, swapped("Status", '"Other":1'))
        .otherwise(value)
    )
    return rows.select(n.alias("n"), broken.alias("value"))


def _land(spark: SparkSession, sf_dir: str, root: str) -> None:
    """The damaged messages, and every tenth one again, as files of one message a line."""
    rows = damaged_messages(spark, sf_dir)
    rows.unionByName(rows.where("n % 10 = 0")).select("value").repartition(4).write.text(f"{root}/messages")


def ingest_now(spark: SparkSession, sf_dir: str) -> store.Tables:
    """Those messages through the stream into fresh tables; readings are published to two sinks."""
    root = scratch(spark, "ingest")
    _land(spark, sf_dir, root)
    found = store.Tables(f"{root}/tables")
    commit = ingest.publishing(ingest.commit_batch, ingest.text_sink(f"{root}/published/a"), ingest.text_sink(f"{root}/published/b"))
    _drain(spark, f"{root}/messages", found, f"{root}/checkpoint", commit)
    return found


def _drain(spark: SparkSession, messages_path: str, found: store.Tables, checkpoint: str, commit: ingest.Commit = ingest.commit_batch, horizon: str = "10 minutes") -> None:
    """Read what is there, two files a batch, with a listener that writes ingest_batches."""
    listener = ingest.BatchMetrics(spark, found)
    spark.streams.addListener(listener)
    try:
        query = ingest.start_ingest(ingest.file_source(spark, messages_path, max_files=2), found, checkpoint, processing_time=None, redelivery_horizon=horizon, commit=commit)
        query.awaitTermination()
        listener.wait(query)
    finally:
        spark.streams.removeListener(listener)


def ingested(spark: SparkSession, sf_dir: str) -> store.Tables:
    """What ingest_now() leaves."""
    return _once(spark, "ingested", sf_dir, ingest_now)


def _restarted(spark: SparkSession, sf_dir: str) -> store.Tables:
    """One stream after another on the same tables, each with a checkpoint of its own, with compactions between.

    Messages of the first third come in with the first, of the second third with the second; the third reads all, so
    that most are redelivered long after, to a stream that never saw them.
    """
    root = scratch(spark, "restarts")
    rows, found = damaged_messages(spark, sf_dir), store.Tables(f"{root}/tables")
    for i, part in enumerate(("n % 3 = 0", "n % 3 = 1", "true")):
        rows.where(part).select("value").repartition(2).write.text(f"{root}/messages/{i}")
        _drain(spark, f"{root}/messages/{i}", found, f"{root}/checkpoint-{i}")
        if i < 2:
            compaction.compact(spark, found)
            if i == 1:
                store.vacuum(spark, found)
    return found


def restarted(spark: SparkSession, sf_dir: str) -> store.Tables:
    return _once(spark, "restarted", sf_dir, _restarted)


def _repaired(spark: SparkSession, sf_dir: str) -> store.Tables:
    """An ingest whose dead letters were tried again, twice, with null temperatures and machines put right."""
    root = scratch(spark, "repairs")
    _land(spark, sf_dir, root)
    found = store.Tables(f"{root}/tables")
    _drain(spark, f"{root}/messages", found, f"{root}/checkpoint")

    def repair(rejects: DataFrame) -> DataFrame:
        right = F.regexp_replace(F.regexp_replace("raw", '"Temperature":null', '"Temperature":0'), '"MachineId":null', '"MachineId":"EQP-000"')
        return rejects.where("reason IN ('null_number', 'null_required')").withColumn("value", right)

    for _ in range(2):
        ingest.replay_rejects(spark, found, repair)
    return found


def repaired(spark: SparkSession, sf_dir: str) -> store.Tables:
    return _once(spark, "repaired", sf_dir, _repaired)


def _compacted(spark: SparkSession, sf_dir: str) -> store.Tables:
    """A second ingest, compacted in two steps: its first batch, then the others; into several files each."""
    found = ingest_now(spark, sf_dir)
    compaction.compact(spark, found, most=1, file_bytes=64 << 10)
    compaction.compact(spark, found, file_bytes=64 << 10)
    store.vacuum(spark, found)
    return found


def compacted(spark: SparkSession, sf_dir: str) -> store.Tables:
    return _once(spark, "compacted", sf_dir, _compacted)
