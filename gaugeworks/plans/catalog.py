"""Every named query, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import aggregates, latest, metrics, readings, sketches
from gaugeworks.plans import derived
from gaugeworks.session import scratch
from gaugeworks.sources import messages, tables
from gaugeworks.streaming import ingest, live, store

MACHINE = "EQP-001"
AS_OF = datetime(2024, 1, 30)
Query = Callable[[SparkSession, str], DataFrame]


_t, _r = derived.telemetry, derived.sensor_readings
_newest, _newest_readings = derived.newest, derived.newest_readings
#: Upper bounds of seconds that a flush takes.
FLUSH_BOUNDS = (0.5, 1.0, 2.5, 5.0, 10.0, 30.0)

# -- queries -----------------------------------------------------------------------------------------------


def _decode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.accepted(messages.decode_messages(derived.damaged_messages(spark, sf_dir).select("value")))


def _rejects_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.rejected(messages.decode_messages(derived.damaged_messages(spark, sf_dir).select("value"))).groupBy("reason").agg(F.count("*").alias("n"))


def _constraint_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows with constraints: a status that isn't a click, of 6 characters, and a unit of 8."""
    rows = tables.events(spark, sf_dir).select(F.nullif("event_type", F.lit("click")).alias("status"), F.col("props").alias("unit"))
    reason = readings.violation("status", "unit", limits={"status": 6, "unit": 8})
    return rows.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def _dedup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth snapshot is delivered again later, with another status."""
    t = _t(spark, sf_dir)
    again = t.where(F.col("id").cast("long") % 10 == 0).withColumns({"status": F.lit("Again"), "arrival": F.lit(2)})
    return readings.first_by_id(t.withColumn("arrival", F.lit(1)).unionByName(again), "arrival")


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sink, value: what each of two sinks got of the stream's readings."""
    root = derived.ingested(spark, sf_dir).root.removesuffix("/tables")
    got = [spark.read.text(f"{root}/published/{sink}").select(F.lit(sink).alias("sink"), "value") for sink in "ab"]
    return got[0].unionByName(got[1])


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.committed_telemetry(spark, derived.ingest_now(spark, sf_dir)).drop("txn")


def _stream_ingest_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.committed_readings(spark, derived.ingested(spark, sf_dir)).drop("txn")


def _dual_writes(made) -> Query:  # noqa: ANN001
    """Transaction by transaction, the manifest against the rows in each table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        snap = store.snapshot(spark, made(spark, sf_dir))
        return metrics.dual_writes(snap.manifest(), snap.telemetry(), snap.readings())

    return run


def _reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stream's listener counted, and the manifests, against the stored rows."""
    found = derived.ingested(spark, sf_dir)
    return metrics.reconcile(ingest.ingest_batches(spark, found), ingest.committed_telemetry(spark, found), ingest.committed_readings(spark, found))


def _accounted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source's messages against what was consumed, written, rejected and left out as repeated."""
    found = derived.ingested(spark, sf_dir)
    n_source = spark.read.text(f"{found.root.removesuffix('/tables')}/messages").count()
    return metrics.accounted(ingest.ingest_batches(spark, found), n_source)


def _restart_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over three streams on the same tables: what was consumed, written, rejected, and left out as stored already."""
    batches = ingest.ingest_batches(spark, derived.restarted(spark, sf_dir))
    return batches.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_consumed", "n_written", "n_failed", "n_dropped", "n_repeated")])


def _dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects by content with their number of messages, as the stream committed them."""
    return ingest.dead_letters(ingest.committed_rejects(spark, derived.ingested(spark, sf_dir)))


def _repaired_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.committed_telemetry(spark, derived.repaired(spark, sf_dir)).drop("txn")


def _compacted_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of a machine from what is kept of them, over two layers."""
    return latest.latest_by_machine(store.snapshot(spark, derived.compacted(spark, sf_dir)).newest().drop("txn"), MACHINE, 20)


def _ingested_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five of each machine, kept batch by batch as the stream went."""
    return latest.latest_n_per_machine(store.snapshot(spark, derived.ingested(spark, sf_dir)).newest().drop("txn"), 5)


def _compacted_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.committed_telemetry(spark, derived.compacted(spark, sf_dir)).drop("txn")


def _compacted_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.committed_readings(spark, derived.compacted(spark, sf_dir)).drop("txn")


def _sql(text: str) -> Query:
    """SQL over the views telemetry and sensor_readings."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ingest.register_views(derived.stored_tables(spark, sf_dir))
        return spark.sql(text)

    return run


def _freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row's age and that of the newest day's batch at a fixed time; whether the stream's last flush, by the clock, was in the last day."""
    flushes = ingest.ingest_batches(spark, derived.ingested(spark, sf_dir))
    now = datetime.now(timezone.utc).replace(tzinfo=None)  # after the ingest, which may take longer than a flush may lie ahead
    real = aggregates.freshness(_t(spark, sf_dir), AS_OF, 86_400, flushes, now).select(F.coalesce(F.col("flush_age_s").between(-60, 86_400), F.lit(False)).alias("flushed_lately"))
    found = aggregates.freshness(_t(spark, sf_dir), AS_OF, 86_400, derived.day_batches(spark, sf_dir)).crossJoin(real)  # a row each
    return found.select("last_ts", "age_s", "last_flush", "flush_age_s", "flushed_lately", (F.col("healthy") & F.col("flushed_lately")).alias("healthy"))


def _flush_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the stream's batches took: a histogram and a sketch of their real durations, checked against each other."""
    batches = ingest.ingest_batches(spark, derived.ingested(spark, sf_dir)).where("duration_s IS NOT NULL")
    cells = metrics.latency_histogram(batches, "duration_s", FLUSH_BOUNDS)
    histogram = cells.agg(F.max("n").alias("n_batches"), F.max(F.when(F.isnan("le") | (F.col("le") == float("inf")), F.col("n"))).alias("n_all"), F.sort_array(F.collect_list(F.struct("le", "n"))).alias("cells"))
    sketch = sketches.widened(sketches.sketched(batches, "duration_s", time_col="flushed_at")).select(F.col("n").alias("n_sketched"), sketches.quantile(0.95).alias("p95_s"))
    ends = batches.agg(F.min("duration_s").alias("least_s"), F.max("duration_s").alias("most_s"))
    rising = F.forall(F.sequence(F.lit(1), F.size("cells") - 1), lambda i: F.col("cells")[i]["n"] >= F.col("cells")[i - 1]["n"])
    return histogram.crossJoin(sketch).crossJoin(ends).select(  # a row each
        "n_batches", (F.col("n_all") == F.col("n_batches")).alias("complete"), rising.alias("rising"), (F.col("n_sketched") == F.col("n_batches")).alias("sketched"), F.col("p95_s").between(F.col("least_s"), F.col("most_s")).alias("within")
    )


def _latency_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile by day, from sketches by minute, and whether its true rank is within the stated error."""
    requests = derived.requests(spark, sf_dir)
    days = sketches.widened(sketches.sketched(requests, "duration_ms"), "1 day").select("window_start", "n", sketches.quantile(0.95).alias("p95_ms"))
    placed = requests.select(F.window("ts", "1 day")["start"].alias("window_start"), "duration_ms").join(days, "window_start")
    rank = lambda upto: F.count_if(upto) / F.count("*")
    d, p = F.col("duration_ms"), F.col("p95_ms")
    near = (rank(d <= p) >= 0.95 - sketches.RANK_ERROR) & (rank(d < p) <= 0.95 + sketches.RANK_ERROR)
    return placed.groupBy("window_start").agg(F.max("n").alias("n"), near.alias("within_error"))


def _rate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots and warnings of each minute, idle minutes too."""
    rows = _t(spark, sf_dir).select("ts", F.lit(1).alias("n"), (F.col("status") == "Warning").cast("int").alias("n_warnings"))
    return metrics.rate_series(rows, ["n", "n_warnings"], 60)


def _live(spark: SparkSession, sf_dir: str, width: str, slide: str | None) -> DataFrame:
    """Snapshots as a stream of several batches, out of order; windows are corrected as late ones come."""
    root = scratch(spark, "live-rate")
    derived.snapshots(spark, sf_dir).select("ts").repartition(4).write.parquet(f"{root}/rows")
    stream = spark.readStream.schema("ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(f"{root}/rows")
    live.start_live_rate(live.live_rate(stream, width, slide, "60 days"), f"{root}/rates", f"{root}/checkpoint", None).awaitTermination()
    live.fold_rates(spark, f"{root}/rates")
    return live.live_rates(spark, f"{root}/rates")


QUERIES: dict[str, Query] = {
    "telemetry_scan": _t,
    "readings_unpivot": _r,
    "decode_json": _decode_json,
    "rejects_by_reason": _rejects_by_reason,
    "constraint_rejects": _constraint_rejects,
    "dedup_by_id": _dedup_by_id,
    "publish_readings_json": lambda s, d: readings.to_reading_messages(_r(s, d)),
    "publish_fan_out": _published,
    "latest_by_machine": lambda s, d: latest.latest_by_machine(_newest(s, d), MACHINE, 20),
    "latest_readings_by_sensor": lambda s, d: latest.latest_readings(_newest_readings(s, d), MACHINE, "pressure", 20),
    "latest_readings_all_sensors": lambda s, d: latest.latest_readings(_newest_readings(s, d), MACHINE, None, 7),
    "latest_overall": lambda s, d: latest.latest_overall(_newest(s, d), 10),
    "latest_n_per_machine": lambda s, d: latest.latest_n_per_machine(_newest(s, d), 5),
    "latest_n_per_sensor": lambda s, d: latest.latest_n_per_sensor(_newest_readings(s, d), 5),
    "total_count": lambda s, d: aggregates.total_count(_t(s, d)),
    "count_by_machine": lambda s, d: aggregates.count_by_machine(_t(s, d)),
    "recent_count": lambda s, d: aggregates.recent_count(_t(s, d), AS_OF, "1 day"),
    "machine_stats": lambda s, d: aggregates.machine_stats(_newest(s, d), MACHINE),
    "fleet_stats": lambda s, d: aggregates.fleet_stats(_newest(s, d)),
    "freshness": _freshness,
    "silent_machines": lambda s, d: live.silent_machines(_newest(s, d), AS_OF, 600.0),
    "ingest_counters": lambda s, d: metrics.ingest_counters(ingest.ingest_batches(s, derived.ingested(s, d))),
    "flush_seconds": _flush_seconds,
    "reconcile": _reconcile,
    "event_rate_series": _rate_series,
    "event_rate_1m": lambda s, d: metrics.rate_per_second(_t(s, d), "1 minute", 60),
    "error_ratio": lambda s, d: metrics.error_ratio(derived.requests(s, d), "1 day"),
    "latency_histogram": lambda s, d: metrics.latency_histogram(derived.requests(s, d)),
    "latency_p95_5m": lambda s, d: metrics.latency_percentile(derived.requests(s, d), "5 minutes"),
    "latency_p95_bucketed": lambda s, d: metrics.latency_percentile_bucketed(derived.requests(s, d), "1 day"),
    "latency_p95_sketched": _latency_sketched,
    "slo_summary": lambda s, d: metrics.slo_summary(derived.requests(s, d)),
    "live_rate": lambda s, d: _live(s, d, "1 day", None),
    "live_rate_sliding": lambda s, d: _live(s, d, "1 day", "6 hours"),
    "stream_ingest": _stream_ingest,
    "stream_ingest_readings": _stream_ingest_readings,
    "dual_write_reconciled": _dual_writes(derived.ingested),
    "ingest_accounted": _accounted,
    "compacted_lookup": _compacted_lookup,
    "compacted_telemetry": _compacted_telemetry,
    "compacted_readings": _compacted_readings,
    "compacted_counts": _dual_writes(derived.compacted),
    "ingested_newest": _ingested_newest,
    "restart_ingest": lambda s, d: ingest.committed_telemetry(s, derived.restarted(s, d)).drop("txn"),
    "restart_counts": _restart_counts,
    "dead_letters": _dead_letters,
    "repaired_telemetry": _repaired_telemetry,
    "sql_count_by_machine": _sql("SELECT machine_id, COUNT(*) AS n FROM telemetry GROUP BY machine_id ORDER BY machine_id"),
    "sql_latest_readings": _sql("SELECT * FROM sensor_readings ORDER BY ts DESC, sensor_type DESC, id DESC LIMIT 10"),
}

# -- SQL ---------------------------------------------------------------------------------------------------

_T = """t AS (
    SELECT CAST(event_id AS VARCHAR) AS id, printf('EQP-%03d', user_id + 1) AS machine_id, value AS temperature,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10 + 1 AS pressure,
           CASE WHEN event_type = 'error' THEN 'Warning' ELSE 'Running' END AS status, ts FROM events)"""
_R_OF = """r AS (
    SELECT md5(id || '|' || sensor_type) AS id, machine_id, sensor_type, value, unit, ts FROM (
        SELECT id, machine_id, 'Temperature' AS sensor_type, temperature AS value, '°C' AS unit, ts FROM {0}
        UNION ALL SELECT id, machine_id, 'Pressure', pressure, 'bar', ts FROM {0}))"""
_R = _T + ", " + _R_OF.format("t")
_REQ = "q AS (SELECT ts, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS code, value AS duration_ms FROM events)"
_KIND = """CASE WHEN event_id % 97 = 0 THEN 'null_payload' WHEN event_id % 89 = 0 THEN 'malformed_json' WHEN event_id % 83 = 0 THEN 'null_number'
    WHEN event_id % 79 = 0 THEN 'null_required' WHEN event_id % 73 = 0 THEN 'too_long' WHEN event_id % 71 = 0 THEN 'malformed_json' END"""
_GOOD = (
    _T
    + f""", kinds AS (SELECT CAST(event_id AS VARCHAR) AS id, {_KIND} AS reason, event_id % 67 = 0 AS bare FROM events),
    good AS (SELECT id, machine_id, temperature, pressure, CASE WHEN bare THEN '' ELSE status END AS status, ts FROM t JOIN kinds USING (id) WHERE reason IS NULL)"""
)
_NEWEST = "ORDER BY ts DESC, id DESC"
_READING = "machine_id, sensor_type, value, unit, ts"
_STATS = "CAST(sum(CAST(temperature AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_temperature, max(pressure) AS max_pressure"
_AS_OF = f"TIMESTAMP '{AS_OF}'"
_LE = ", ".join(str(b) for b in metrics.BOUNDS)
#: What the stream reads: every message, and every tenth again.
_TWICE = "count(*) FILTER ({0}) + count(*) FILTER (({0}) AND CAST(id AS BIGINT) % 10 = 0)"
_READ, _STREAM_FAILED = _TWICE.format("true"), _TWICE.format("reason IS NOT NULL")
_PUBLISHED = """'{{"Id":"' || id || '","MachineId":"' || machine_id || '","SensorType":"' || sensor_type || '","Value":' || value || ',"Unit":"' || unit
        || '","Timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '"}}' AS value""".replace("{{", "{").replace("}}", "}")
_TORN = "SELECT count(*) AS n_written, 2 * count(*) AS n_readings, count(*) AS stored_telemetry, 2 * count(*) AS stored_readings, CAST(0 AS BIGINT) AS n_torn FROM good"

ORACLE_SQL: dict[str, str] = {
    "telemetry_scan": f"WITH {_T} SELECT * FROM t",
    "readings_unpivot": f"WITH {_R} SELECT * FROM r",
    "decode_json": f"WITH {_GOOD} SELECT * FROM good",
    "rejects_by_reason": f"SELECT {_KIND} AS reason, count(*) AS n FROM events WHERE ({_KIND}) IS NOT NULL GROUP BY 1",
    "constraint_rejects": """SELECT CASE WHEN event_type = 'click' OR props IS NULL THEN 'null_required' ELSE 'too_long' END AS reason, count(*) AS n FROM events
        WHERE event_type = 'click' OR event_type IS NULL OR props IS NULL OR length(event_type) > 6 OR length(props) > 8 GROUP BY 1""",
    "dedup_by_id": f"WITH {_T} SELECT * FROM t",
    "publish_readings_json": f"WITH {_R} SELECT {_PUBLISHED} FROM r",
    "publish_fan_out": f"WITH {_GOOD}, {_R_OF.format('good')} SELECT sink, {_PUBLISHED} FROM r, (SELECT unnest(['a', 'b']) AS sink)",
    "latest_by_machine": f"WITH {_T} SELECT * FROM t WHERE machine_id = '{MACHINE}' {_NEWEST} LIMIT 20",
    "latest_readings_by_sensor": f"WITH {_R} SELECT {_READING} FROM r WHERE machine_id = '{MACHINE}' AND lower(sensor_type) = 'pressure' ORDER BY ts DESC, sensor_type DESC, id DESC LIMIT 20",
    "latest_readings_all_sensors": f"WITH {_R} SELECT {_READING} FROM r WHERE machine_id = '{MACHINE}' ORDER BY ts DESC, sensor_type DESC, id DESC LIMIT 7",
    "latest_overall": f"WITH {_T} SELECT * FROM t {_NEWEST} LIMIT 10",
    "latest_n_per_machine": f"WITH {_T} SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY machine_id {_NEWEST}) <= 5",
    "latest_n_per_sensor": f"WITH {_R} SELECT {_READING} FROM r QUALIFY row_number() OVER (PARTITION BY machine_id, lower(sensor_type) ORDER BY ts DESC, sensor_type DESC, id DESC) <= 5",
    "total_count": "SELECT count(*) AS n FROM events",
    "count_by_machine": f"WITH {_T} SELECT machine_id, count(*) AS n FROM t GROUP BY machine_id",
    "recent_count": f"WITH {_T} SELECT count(*) AS n FROM t WHERE ts > {_AS_OF} - INTERVAL 1 DAY",
    "machine_stats": f"WITH {_T} SELECT machine_id, {_STATS} FROM (SELECT * FROM t WHERE machine_id = '{MACHINE}' {_NEWEST} LIMIT 100) GROUP BY machine_id",
    "fleet_stats": f"WITH {_T} SELECT machine_id, {_STATS} FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY machine_id {_NEWEST}) <= 100) GROUP BY machine_id",
    "freshness": f"""WITH f AS (SELECT max(ts) AS last_ts, date_trunc('day', max(ts)) AS last_flush FROM events)
        SELECT last_ts, (epoch_us({_AS_OF}) - epoch_us(last_ts)) / 1000000 AS age_s, last_flush, (epoch_us({_AS_OF}) - epoch_us(last_flush)) / 1000000 AS flush_age_s,
               true AS flushed_lately, coalesce((epoch_us({_AS_OF}) - epoch_us(last_flush)) / 1000000 < 86400, false) AS healthy FROM f""",
    "silent_machines": f"""WITH {_T} SELECT machine_id, max(ts) AS last_ts, (epoch_us({_AS_OF}) - epoch_us(max(ts))) / 1000000 AS silent_s FROM t
        GROUP BY machine_id HAVING (epoch_us({_AS_OF}) - epoch_us(max(ts))) / 1000000 > 600""",
    "ingest_counters": f"""WITH {_GOOD} SELECT {_READ} AS n_consumed, count(*) FILTER (reason IS NULL) AS n_written, 2 * count(*) FILTER (reason IS NULL) AS n_readings,
        {_STREAM_FAILED} AS n_failed FROM kinds""",
    "flush_seconds": "SELECT CAST(2 AS BIGINT) AS n_batches, true AS complete, true AS rising, true AS sketched, true AS within",
    "reconcile": f"""WITH {_GOOD}, c AS (SELECT {_READ} AS n_consumed, count(*) FILTER (reason IS NULL) AS n_written, {_STREAM_FAILED} AS n_failed FROM kinds)
        SELECT n_consumed, n_written, 2 * n_written AS n_readings, n_failed, n_consumed - n_written - n_failed AS n_left_out,
               (SELECT count(*) FROM good) AS stored_telemetry, (SELECT 2 * count(*) FROM good) AS stored_readings, true AS reconciled, n_failed = 0 AS healthy FROM c""",
    "event_rate_series": """WITH m AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS w, count(*) AS n, count(*) FILTER (event_type = 'error') AS k FROM events GROUP BY 1),
        grid AS (SELECT unnest(range(min(w), max(w) + INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS w FROM m)
        SELECT CAST(w AS TIMESTAMP) AS window_start, coalesce(n, 0) AS n, coalesce(n, 0) / 60 AS n_per_s, coalesce(k, 0) AS n_warnings, coalesce(k, 0) / 60 AS n_warnings_per_s FROM grid LEFT JOIN m USING (w)""",
    "event_rate_1m": "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, count(*) AS n, count(*) / 60 AS per_second FROM events GROUP BY 1",
    "error_ratio": f"WITH {_REQ} SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, count(*) FILTER (regexp_matches(code, '^5..$')) AS errors, count(*) FILTER (regexp_matches(code, '^5..$')) / count(*) AS error_ratio FROM q GROUP BY 1",
    "latency_histogram": f"WITH b AS (SELECT unnest([{_LE}, 'inf'::DOUBLE]) AS le) SELECT le, count(*) FILTER (value <= le) AS n FROM b, events GROUP BY le",
    "latency_p95_5m": f"WITH {_REQ} SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n, round(quantile_cont(duration_ms, 0.95), 6) AS latency FROM q GROUP BY 1",
    "latency_p95_bucketed": f"""WITH b AS (SELECT unnest([{_LE}]) AS le, unnest([0, {_LE}]) AS lo LIMIT {len(metrics.BOUNDS)}),
        c AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, le, lo, count(*) AS n, count(*) FILTER (value <= le) AS c, count(*) FILTER (value <= lo AND lo > 0) AS below FROM events, b GROUP BY ALL)
        SELECT w AS window_start, any_value(n) AS n, round(coalesce(arg_min(lo + (le - lo) * (0.95 * n - below) / (c - below), le) FILTER (c >= 0.95 * n), {metrics.BOUNDS[-1]}), 6) AS latency FROM c GROUP BY w""",
    "latency_p95_sketched": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(value) AS n, true AS within_error FROM events GROUP BY 1",
    "slo_summary": f"""WITH {_REQ}, s AS (SELECT count(*) AS n, CAST(sum(CAST(duration_ms AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_ms, min(duration_ms) AS min_ms,
        round(quantile_cont(duration_ms, 0.5), 6) AS med_ms, max(duration_ms) AS max_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms, count(*) FILTER (code LIKE '5%') / count(*) AS error_rate,
        round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000), 9) AS per_second FROM q) SELECT *, p95_ms < 200 AS p95_ok, error_rate < 0.01 AS errors_ok FROM s""",
    "live_rate": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n FROM events GROUP BY 1",
    "live_rate_sliding": """SELECT CAST(w AS TIMESTAMP) AS window_start, count(*) AS n FROM (SELECT unnest(range(time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, ts + INTERVAL 1 MICROSECOND, INTERVAL 6 HOUR)) AS w FROM events) GROUP BY 1""",
    "stream_ingest": f"WITH {_GOOD} SELECT * FROM good",
    "stream_ingest_readings": f"WITH {_GOOD}, {_R_OF.format('good')} SELECT * FROM r",
    "dual_write_reconciled": f"WITH {_GOOD} {_TORN}",
    "ingest_accounted": f"""WITH {_GOOD} SELECT count(*) FILTER (reason IS NULL) AS n_written, {_STREAM_FAILED} AS n_failed,
        CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_unaccounted, true AS accounted FROM kinds""",
    "compacted_lookup": f"WITH {_GOOD} SELECT * FROM good WHERE machine_id = '{MACHINE}' {_NEWEST} LIMIT 20",
    "compacted_telemetry": f"WITH {_GOOD} SELECT * FROM good",
    "compacted_readings": f"WITH {_GOOD}, {_R_OF.format('good')} SELECT * FROM r",
    "compacted_counts": f"WITH {_GOOD} {_TORN}",
    "ingested_newest": f"WITH {_GOOD} SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY machine_id {_NEWEST}) <= 5",
    "restart_ingest": f"WITH {_GOOD} SELECT * FROM good",
    "restart_counts": f"""WITH {_GOOD}, k AS (SELECT *, CAST(id AS BIGINT) % 3 < 2 AS early FROM kinds)
        SELECT count(*) + count(*) FILTER (early) AS n_consumed, count(*) FILTER (reason IS NULL) AS n_written, count(*) FILTER (reason IS NOT NULL) + count(*) FILTER (reason IS NOT NULL AND early) AS n_failed,
               CAST(0 AS BIGINT) AS n_dropped, count(*) FILTER (reason IS NULL AND early) AS n_repeated FROM k""",
    "dead_letters": f"""WITH {_GOOD}, m AS (SELECT *, ('{{"Id":"' || id || '","MachineId":"' || machine_id || '","Temperature":' || temperature || ',"Pressure":' || pressure || ',"Status":"' || status
            || '","Timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '"}}') AS value, CAST(id AS BIGINT) AS k FROM t),
        b AS (SELECT k, CASE WHEN k % 97 = 0 THEN 'null' WHEN k % 89 = 0 THEN value[1:12] WHEN k % 83 = 0 THEN regexp_replace(value, '"Temperature":[^,]*', '"Temperature":null')
            WHEN k % 79 = 0 THEN regexp_replace(value, '"MachineId":"[^"]*"', '"MachineId":null') WHEN k % 73 = 0 THEN '{{"Status":"' || repeat('x', 51) || '"}}' WHEN k % 71 = 0 THEN regexp_replace(value, '"MachineId":"[^"]*"', '"MachineId":5') END AS raw FROM m)
        SELECT raw, reason, CAST(sum(CASE WHEN k % 10 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM b JOIN kinds ON kinds.id = CAST(k AS VARCHAR) WHERE reason IS NOT NULL GROUP BY raw, reason""",
    "repaired_telemetry": f"""WITH {_GOOD} SELECT * FROM good UNION ALL
        SELECT id, CASE WHEN reason = 'null_required' THEN 'EQP-000' ELSE machine_id END, CASE WHEN reason = 'null_number' THEN 0 ELSE temperature END, pressure, status, ts FROM t JOIN kinds USING (id) WHERE reason IN ('null_number', 'null_required')""",
    "sql_count_by_machine": f"WITH {_T} SELECT machine_id, count(*) AS n FROM t GROUP BY machine_id",
    "sql_latest_readings": f"WITH {_R} SELECT * FROM r ORDER BY ts DESC, sensor_type DESC, id DESC LIMIT 10",
}
