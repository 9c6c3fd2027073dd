"""Rates that are corrected while late rows come in, and machines that have gone silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.session import delete, exists, stored

_RATES = "window_start TIMESTAMP_NTZ, n BIGINT, version BIGINT"


def live_rate(telemetry: DataFrame, width: str = "1 minute", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """window_start, n by window of a stream's `ts`; a sliding window with `slide`."""
    timed = telemetry.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width)).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "n")


def start_live_rate(rates: DataFrame, path: str, checkpoint: str, processing_time: str | None = "2 seconds") -> StreamingQuery:
    """Keep a stream's rates (as live_rate() has them) in a table that live_rates() reads.

    In update mode a batch gives only the windows that it changed, under the batch's number as their version, in a
    folder that a replay overwrites; a late row corrects its window as long as the watermark keeps it. The state holds
    the windows that may still change. A table has one checkpoint.
    """

    def upsert(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/versions/version={batch_id}")

    writer = rates.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if processing_time is None else writer.trigger(processingTime=processing_time).start()


def live_rates(spark: SparkSession, path: str) -> DataFrame:
    """window_start, n: the last version of each window."""
    rows = stored(spark, f"{path}/folded", _RATES).select("window_start", "n", "version").unionByName(stored(spark, f"{path}/versions", _RATES))
    return rows.groupBy("window_start").agg(F.max_by("n", "version").alias("n"))


def fold_rates(spark: SparkSession, path: str) -> int:
    """Put the versions that are there into one table, so that readers open few files. Returns how many went.

    The new table is written beside the old one first; after a crash in between, a window is in both, with the same
    version.
    """
    rows = stored(spark, f"{path}/versions", _RATES)
    done = sorted(r[0] for r in rows.select("version").distinct().collect())  # a number per batch since the last call
    if not done:
        return 0
    old = stored(spark, f"{path}/folded", f"{_RATES}, upto BIGINT").drop("upto")
    last = old.unionByName(rows).groupBy("window_start").agg(F.max(F.struct("version", "n")).alias("last"))
    new = f"{path}/folded/upto={done[-1]}"
    last.select("window_start", "last.n", "last.version").coalesce(1).write.mode("overwrite").parquet(new)
    for version in done:
        delete(spark, f"{path}/versions/version={version}")
    for upto in [r[0] for r in stored(spark, f"{path}/folded", f"{_RATES}, upto BIGINT").select("upto").distinct().collect()]:
        if upto < done[-1] and exists(spark, f"{path}/folded/upto={upto}"):
            delete(spark, f"{path}/folded/upto={upto}")
    return len(done)


# -- liveness ----------------------------------------------------------------------------------------------

LIVENESS = "machine_id STRING, state STRING, last_ts TIMESTAMP, at TIMESTAMP"


class _Liveness(StatefulProcessor):
    """Of each machine the newest instant it told of, and one timer."""

    def __init__(self, silent_s: float):
        self._silent_ms = int(silent_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "ts TIMESTAMP, silent BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        newest = max(batch["ts"].max() for batch in rows)
        known = self._last.get() if self._last.exists() else None
        back = known is None or known[1]
        newest = newest if known is None else max(newest, pd.Timestamp(known[0]).tz_localize(newest.tz) if pd.Timestamp(known[0]).tz is None and newest.tz is not None else pd.Timestamp(known[0]))
        now = timerValues.getCurrentProcessingTimeInMs()
        self._last.update((newest.to_pydatetime(), False))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        self._handle.registerTimer(now + self._silent_ms)
        if back:
            yield self._event(key, "alive", newest, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last = self._last.get()[0]
        self._last.update((last, True))
        yield self._event(key, "silent", last, expiredTimerInfo.getExpiryTimeInMs())

    @staticmethod
    def _event(key, state: str, last, at_ms: int) -> pd.DataFrame:  # noqa: ANN001
        return pd.DataFrame({"machine_id": [key[0]], "state": [state], "last_ts": [pd.Timestamp(last)], "at": [pd.Timestamp(at_ms, unit="ms")]})

    def close(self) -> None:
        pass


def liveness(telemetry: DataFrame, silent_s: float = 60.0) -> DataFrame:
    """machine_id, state, last_ts, at: an event when a machine is first heard of or again (`alive`), and one when
    nothing came from it for `silent_s` seconds of processing time (`silent`).

    State is one instant and one timer a machine. It needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    rows = telemetry.select("machine_id", F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("machine_id").transformWithStateInPandas(_Liveness(silent_s), LIVENESS, "append", "processingTime")


def silent_machines(telemetry: DataFrame, as_of, silent_s: float = 60.0) -> DataFrame:  # noqa: ANN001
    """machine_id, last_ts, silent_s: of a table, the machines whose newest row is older than that at `as_of`; one aggregate."""
    last = telemetry.groupBy("machine_id").agg(F.max("ts").alias("last_ts"))
    age = (F.unix_micros(F.lit(as_of).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / F.lit(1_000_000)
    return last.withColumn("silent_s", age).where(F.col("silent_s") > silent_s)
