"""Messages to committed tables, effectively once.

decode -> stamp with the time of ingest -> drop ids redelivered within a horizon -> foreachBatch: leave out ids that are
stored already, write the batch's own folders as one transaction (see store.py), named by the stream's checkpoint and
the batch. After a crash the same offsets come again as the same transaction. Source offsets are committed after that.
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gaugeworks.operators.readings import first_by_id, to_reading_messages, to_readings
from gaugeworks.schemas import INGEST_BATCHES, SENSOR_READINGS
from gaugeworks.session import delete, exists, scratch, stored
from gaugeworks.sources.messages import accepted, decode_messages, rejected
from gaugeworks.streaming.store import LAYER, Snapshot, Tables, Transaction, snapshot, unseen, with_retries, write_manifest, write_shapes

Commit = Callable[[DataFrame, Transaction, Tables], None]


# -- sources -----------------------------------------------------------------------------------------------


def file_source(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Text files of one message a line; at most `max_files` of them a batch."""
    reader = spark.readStream
    return (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).text(path)


def kafka_source(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """The same column from a topic; it needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader if max_offsets is None else reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(F.decode("value", "UTF-8").alias("value"))


# -- commits -----------------------------------------------------------------------------------------------


def commit_batch(decoded: DataFrame, txn: Transaction, tables: Tables, unseen_only: bool = True, replayed: tuple[str, ...] = ()) -> bool:
    """Write one batch's accepted rows in all shapes and its rejects; the manifest comes last. Whether it was written.

    A transaction that the manifest has is not written again. Rows whose id is stored already are left out, however
    long ago it came and through whichever stream, unless `unseen_only` is false. Rejects of equal content are one row
    with their number; `replayed` names the transactions whose rejects these rows were.
    """
    spark = decoded.sparkSession
    now = snapshot(spark, tables)
    if now.has(txn):
        return False
    decoded = decoded.persist()
    held = decoded
    try:
        good = accepted(decoded).drop("ingest_ts")
        n_good = good.count()
        if unseen_only:
            good, held = unseen(good, now)
        origin = F.col("origin") if "origin" in decoded.columns else F.lit(txn.key)
        bad = rejected(decoded.withColumn("origin", origin), "origin").groupBy("raw", "reason", "origin").agg(F.count("*").alias("n")).select("raw", "reason", "n", "origin")
        counts = write_shapes(spark, tables, txn, good.drop("origin"), bad)
        counts["n_repeated"] = n_good - counts["n_written"]
        write_manifest(spark, tables, txn, counts, replayed=replayed)
    finally:
        decoded.unpersist()
        held.unpersist()
    return True


def commit_all(decoded: DataFrame, txn: Transaction, tables: Tables) -> bool:
    """commit_batch without asking for stored ids: for a source that can't repeat any. compact() still finds repeats."""
    return commit_batch(decoded, txn, tables, unseen_only=False)


def publishing(commit: Commit, *sinks: Callable[[DataFrame, str], None]) -> Commit:
    """A commit that then publishes the batch's readings, as JSON messages, to every sink.

    Each sink gets (messages, the transaction's key), read from the committed batch. A batch that is replayed is
    published again under the same key: so a sink that writes by key has each reading once. If vacuum() has taken the
    batch's files meanwhile, the replayed rows themselves are published, with what had been left out as stored already.
    """

    def both(decoded: DataFrame, txn: Transaction, tables: Tables) -> None:
        commit(decoded, txn, tables)
        spark, path = decoded.sparkSession, f"{tables.readings}/txn={txn.key}"
        readings = spark.read.schema(SENSOR_READINGS).parquet(path) if exists(spark, path) else to_readings(accepted(decoded))
        fan_out(to_reading_messages(readings), txn.key, *sinks)

    return both


def fan_out(messages: DataFrame, key: str, *sinks: Callable[[DataFrame, str], None]) -> None:
    """The same messages to every sink; they are computed once."""
    messages = messages.persist()
    try:
        for sink in sinks:
            with_retries(lambda sink=sink: sink(messages, key))
    finally:
        messages.unpersist()


def text_sink(path: str) -> Callable[[DataFrame, str], None]:
    """Gzipped text files of one message a line, in a folder per batch that a replay overwrites."""
    return lambda messages, key: messages.write.mode("overwrite").option("compression", "gzip").text(f"{path}/txn={key}")


def kafka_sink(servers: str, topic: str) -> Callable[[DataFrame, str], None]:
    """A topic; it needs Spark's Kafka package. A replayed batch is sent again."""
    return lambda messages, _: messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


# -- committed tables --------------------------------------------------------------------------------------


def committed_telemetry(spark: SparkSession, tables: Tables) -> DataFrame:
    return snapshot(spark, tables).telemetry()


def committed_readings(spark: SparkSession, tables: Tables) -> DataFrame:
    return snapshot(spark, tables).readings()


def committed_rejects(spark: SparkSession, tables: Tables) -> DataFrame:
    return snapshot(spark, tables).rejects()


def manifest(spark: SparkSession, tables: Tables) -> DataFrame:
    return snapshot(spark, tables).manifest()


def register_views(snap: Snapshot) -> None:
    """The temporary views telemetry and sensor_readings of a snapshot, for SQL."""
    snap.telemetry().drop("txn").createOrReplaceTempView("telemetry")
    snap.readings().drop("txn").createOrReplaceTempView("sensor_readings")


# -- the query ---------------------------------------------------------------------------------------------


def start_ingest(
    messages: DataFrame, tables: Tables, checkpoint: str, processing_time: str | None = "2 seconds", redelivery_horizon: str = "10 minutes", commit: Commit = commit_batch, name: str = "telemetry-ingest"
) -> StreamingQuery:
    """Start the stream. With `processing_time` None it drains what is there and stops.

    The watermark is on the time of ingest, so late snapshots are kept, however late; it bounds the state that
    recognises ids redelivered shortly after. Each reject stays, to be counted by content when it is committed; only rejects
    keep their `raw`. A batch is written to the shared folder while it is committed. A
    stream with a new checkpoint may write to the same tables: its transactions have names of their own, and what it
    reads again is left out by id.
    """
    stamped = messages.withColumn("ingest_ts", F.current_timestamp()).withWatermark("ingest_ts", redelivery_horizon)
    decoded = decode_messages(stamped, received_at=F.col("ingest_ts")).observe("ingest", F.count("*").alias("n_consumed"), F.count("reason").alias("n_rejected"))
    key = F.when(F.col("reason").isNull(), F.concat(F.lit("row:"), "id")).otherwise(F.concat(F.lit("reject:"), F.uuid()))
    lean = decoded.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("raw")))  # of good rows nobody asks for it
    unique = lean.withColumn("__key", key).dropDuplicatesWithinWatermark(["__key"]).drop("__key")
    staging = scratch(messages.sparkSession, "batches")
    source: list[str] = []
    started = threading.Event()

    def flush(rows: DataFrame, batch_id: int) -> None:
        started.wait()
        spark, path = rows.sparkSession, f"{staging}/{batch_id}"
        try:
            # written once, not cached: each task over a cached batch would send the driver the metrics of the stateful stage
            # behind it, of which there is one for each state partition
            rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
            batch = spark.read.schema(rows.schema).parquet(path)
            if not batch.isEmpty():
                commit(batch, Transaction(source[0], batch_id), tables)
        finally:
            delete(spark, path)

    writer = unique.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).queryName(name)
    query = writer.trigger(availableNow=True).start() if processing_time is None else writer.trigger(processingTime=processing_time).start()
    source.append(str(query.id))  # kept in the checkpoint, so it is the same after a restart
    started.set()
    return query


class TooManyFailures(RuntimeError):
    """The query failed more often within the window than restarts are allowed."""


def supervise(start: Callable[[], StreamingQuery], max_restarts: int = 10, within_s: float = 600.0, wait_s: float = 5.0, most_wait_s: float = 30.0) -> int:
    """Run the query to its end; after a failure start it again from its checkpoint. Returns the restarts that it took.

    Intensity, not age, decides: more than `max_restarts` failures within `within_s` seconds and the last one is
    raised, as the cause of TooManyFailures. A query that fails now and then runs on for ever. Waits grow with the failures in
    the window.
    """
    failed: deque[float] = deque()
    restarts = 0
    while True:
        try:
            start().awaitTermination()
        except Exception as e:  # a failed query, or a source that isn't there yet
            now = time.monotonic()
            failed.append(now)
            while failed[0] < now - within_s:
                failed.popleft()
            if len(failed) > max_restarts:
                raise TooManyFailures(f"{len(failed)} failures within {within_s:g} s") from e
            restarts += 1
            time.sleep(min(wait_s * len(failed), most_wait_s))
        else:
            return restarts


# -- dead letters ------------------------------------------------------------------------------------------


def replay_rejects(spark: SparkSession, tables: Tables, repair: Callable[[DataFrame], DataFrame]) -> Transaction | None:
    """Try again the rejects of all transactions that no replay has taken yet. The replay's name, or None if there are none.

    `repair` gets the rejects (raw, reason, n, origin) and returns rows with `value`, the message to decode, and the
    columns raw and origin as they are; rows that it leaves out aren't tried. What decodes is committed like any batch, once: ids that are
    stored are left out, and the manifest names the transactions that were replayed. What doesn't becomes a reject of
    the replay, with its content and first origin, and isn't tried again unless its own transaction is.
    """
    snap = snapshot(spark, tables)
    taken = {k for r in snap.entries.values() for k in r["replayed"] or ()}
    origins = [r[0] for r in snap.rejects().select("origin").distinct().collect() if r[0] not in taken]  # at most a row a transaction
    if not origins:
        return None
    txn = Transaction("replay", 1 + max((r["batch_id"] for r in snap.entries.values() if r["source"] == "replay"), default=-1))
    wanted = snap.rejects().where(F.col("origin").isin(origins)).select("raw", "reason", "n", "origin")
    decoded = decode_messages(repair(wanted).select("value", "origin"))
    # no stream has told ids of one content in several transactions apart
    good = first_by_id(decoded.where("reason IS NULL"), "origin").withColumn("origin", F.lit(None).cast("string"))
    commit_batch(good.unionByName(decoded.where("reason IS NOT NULL")), txn, tables, replayed=tuple(sorted(origins)))
    return txn


def dead_letters(rejects: DataFrame) -> DataFrame:
    """raw, reason, n: how often each content was rejected, over all transactions."""
    return rejects.groupBy("raw", "reason").agg(F.sum("n").alias("n"))


# -- metrics -----------------------------------------------------------------------------------------------


class BatchMetrics(StreamingQueryListener):
    """Appends a row per batch to ingest_batches: messages consumed and, of these, rejected, both before deduplication,
    how many the deduplication dropped (the state operator's own count), seconds taken, when."""

    def __init__(self, spark: SparkSession, tables: Tables):
        self._spark, self._tables = spark, tables
        self._ended = threading.Condition()
        self._gone: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        progress = event.progress
        seen = progress.observedMetrics.get("ingest")
        if progress.numInputRows and seen is not None:
            dropped = sum((s.customMetrics or {}).get("numDroppedDuplicateRows", 0) for s in progress.stateOperators)
            key = Transaction(str(progress.id), progress.batchId).key
            row = (key, seen["n_consumed"], seen["n_rejected"], dropped, progress.durationMs.get("triggerExecution", 0) / 1000, progress.timestamp)
            values = [F.lit(v).alias(c) for v, c in zip(row, ("txn", "n_consumed", "n_rejected", "n_dropped", "duration_s", "flushed_at"), strict=True)]
            rows = self._spark.range(1).select(*values).withColumn("flushed_at", F.col("flushed_at").cast("timestamp"))
            rows.coalesce(1).write.mode("append").parquet(self._tables.batches)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        with self._ended:
            self._gone.add(str(event.runId))
            self._ended.notify_all()

    def wait(self, query: StreamingQuery, timeout_s: float = 60.0) -> None:
        """Until all events of a query that has ended are here; they come in order, the end last."""
        with self._ended:
            if not self._ended.wait_for(lambda: str(query.runId) in self._gone, timeout_s):
                raise TimeoutError("the query's end was not reported")


def ingest_batches(spark: SparkSession, tables: Tables) -> DataFrame:
    """The manifest's counts with the listener's: txn, n_written, n_readings, n_failed, n_repeated, n_consumed,
    n_rejected, n_dropped, duration_s, flushed_at; a row per batch of the streams, compacted since or not. A batch that
    one of them lacks has nulls: the stream may have had no listener, or all its rows may be redeliveries."""
    timed = stored(spark, tables.batches, INGEST_BATCHES).groupBy("txn")
    timed = timed.agg(*[F.max(c).alias(c) for c in ("n_consumed", "n_rejected", "n_dropped")], F.max("duration_s").alias("duration_s"), F.max("flushed_at").alias("flushed_at"))
    said = snapshot(spark, tables).all_manifests().where(~F.col("source").isin(LAYER, "replay"))
    return said.select("txn", "n_written", "n_readings", "n_failed", "n_repeated").join(timed, "txn", "full")
