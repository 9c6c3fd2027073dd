"""Ingest counters, rates, latency percentiles, error ratios and service levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.schemas import SENSORS
from gaugeworks.session import written

#: Upper bounds of latency buckets.
BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0)


def ingest_counters(batches: DataFrame) -> DataFrame:
    """Totals over ingest batches: n_consumed, n_written, n_readings, n_failed."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return batches.agg(*[total(c) for c in ("n_consumed", "n_written", "n_readings", "n_failed")])


def reconcile(batches: DataFrame, telemetry: DataFrame, readings: DataFrame) -> DataFrame:
    """One row: the counters, n_left_out (consumed messages that deduplication or the stored ids left out), the rows
    really stored, and whether all of them agree and nothing failed. A redelivered message is no fault."""
    stored = telemetry.agg(F.count("*").alias("stored_telemetry")).crossJoin(readings.agg(F.count("*").alias("stored_readings")))  # a row each
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("n_dropped", "n_repeated") if c in batches.columns]
    left_out = batches.agg(sum(sums, F.lit(0)).cast("long").alias("n_left_out"))
    agree = (F.col("n_consumed") == F.col("n_written") + F.col("n_failed") + F.col("n_left_out")) & (F.col("n_written") == F.col("stored_telemetry"))
    agree &= (F.col("n_readings") == F.col("stored_readings")) & (F.col("n_readings") == len(SENSORS) * F.col("n_written"))
    return ingest_counters(batches).crossJoin(left_out).crossJoin(stored).withColumns({"reconciled": agree, "healthy": agree & (F.col("n_failed") == 0)})


def dual_writes(manifest: DataFrame, telemetry: DataFrame, readings: DataFrame) -> DataFrame:
    """One row: n_written, n_readings, stored_telemetry, stored_readings, n_torn: transactions whose rows in either table
    aren't as many as their manifest says. All three have txn; one that the manifest lacks is torn too."""
    in_table = lambda rows, name: rows.groupBy("txn").agg(F.count("*").alias(name))
    said = manifest.select("txn", "n_written", "n_readings")
    both = said.join(in_table(telemetry, "stored_telemetry"), "txn", "full").join(in_table(readings, "stored_readings"), "txn", "full").na.fill(0)
    torn = (F.col("n_written") != F.col("stored_telemetry")) | (F.col("n_readings") != F.col("stored_readings")) | (len(SENSORS) * F.col("n_written") != F.col("n_readings"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return both.agg(*[total(c) for c in ("n_written", "n_readings", "stored_telemetry", "stored_readings")], F.count_if(torn).alias("n_torn"))


def accounted(batches: DataFrame, n_source: int) -> DataFrame:
    """One row: n_written, n_failed (messages rejected), n_missing (messages of the source that no batch consumed),
    n_unaccounted (consumed, but neither written nor failed nor left out as a repeat), and whether both are 0.

    Each count is taken where it arises: before deduplication, by it, and from the rows written.
    """
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    missing = F.lit(n_source).cast("long") - total("n_consumed")
    lost = total("n_consumed") - total("n_written") - total("n_failed") - total("n_dropped") - total("n_repeated")
    out = batches.agg(total("n_written").alias("n_written"), total("n_failed").alias("n_failed"), missing.alias("n_missing"), lost.alias("n_unaccounted"))
    return out.withColumn("accounted", (F.col("n_missing") == 0) & (F.col("n_unaccounted") == 0))


def rate_per_second(rows: DataFrame, width: str, width_s: int) -> DataFrame:
    """window_start, n, per_second by tumbling window of `ts`. Windows without rows don't appear."""
    counted = rows.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "n", (F.col("n") / width_s).alias("per_second"))


def rate_series(rows: DataFrame, counts: list[str], width_s: int, time_col: str = "ts") -> DataFrame:
    """window_start, then of each counter its sum and its rate (`<counter>_per_s`), by window; idle windows have 0.

    The windows from the first row's to the last row's are generated where they are used, so none is sent anywhere;
    what was counted is joined to them. A null time counts nowhere; an empty table has no windows.
    """
    second = F.floor(F.unix_micros(F.col(time_col).cast("timestamp")) / F.lit(1_000_000 * width_s)).cast("long")
    counted = rows.where(F.col(time_col).isNotNull()).groupBy(second.alias("w")).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts])
    ends = counted.agg(F.min("w").alias("a"), F.max("w").alias("b")).first()
    first, stop = (0, 0) if ends["a"] is None else (ends["a"], ends["b"] + 1)
    grid = rows.sparkSession.range(first, stop).withColumnRenamed("id", "w")
    filled = grid.join(counted, "w", "left").na.fill(0, counts)
    start = F.timestamp_micros(F.col("w") * F.lit(1_000_000 * width_s)).cast("timestamp_ntz").alias("window_start")
    return filled.select(start, *[c for n in counts for c in (F.col(n), (F.col(n) / width_s).alias(f"{n}_per_s"))])


def is_server_error(code: Column) -> Column:
    return code.rlike("^5..$")


def error_ratio(requests: DataFrame, width: str) -> DataFrame:
    """window_start, n, errors, error_ratio."""
    failed = F.sum(is_server_error(F.col("code")).cast("int"))
    counted = requests.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), failed.cast("long").alias("errors"))
    return counted.select(F.col("window.start").alias("window_start"), "n", "errors", (F.col("errors") / F.col("n")).alias("error_ratio"))


def latency_histogram(rows: DataFrame, column: str = "duration_ms", bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """le, n: cumulative counts, the last bound infinite. One aggregate, then a row per bound."""
    counts = [F.sum((F.col(column) <= le).cast("int")).cast("long") for le in bounds] + [F.count(column)]
    cells = [F.struct(F.lit(le).cast("double").alias("le"), F.coalesce(n, F.lit(0)).alias("n")) for le, n in zip((*bounds, float("inf")), counts, strict=True)]
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def latency_percentile(requests: DataFrame, width: str, q: float = 0.95, exact: bool = True) -> DataFrame:
    """window_start, n, latency: the percentile by window. The exact one keeps a window's distinct values; the other is a sketch."""
    value = F.percentile("duration_ms", q) if exact else F.percentile_approx("duration_ms", q)
    found = requests.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), value.alias("latency"))
    return found.select(F.col("window.start").alias("window_start"), "n", F.round("latency", 6).alias("latency"))


def latency_percentile_bucketed(requests: DataFrame, width: str, q: float = 0.95, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """The same from histogram buckets, by linear interpolation within one; beyond the last bound it is that bound.

    A fixed number of sums a window, combined before the shuffle: this form holds at any size.
    """
    sums = [F.sum((F.col("duration_ms") <= le).cast("int")).cast("long").alias(f"c{i}") for i, le in enumerate(bounds)]
    found = requests.groupBy(F.window("ts", width)).agg(F.count("duration_ms").alias("n"), *sums)
    rank = F.col("n") * q
    latency = F.lit(bounds[-1])
    for i in reversed(range(len(bounds))):
        low, below = (bounds[i - 1], F.col(f"c{i - 1}")) if i else (0.0, F.lit(0))
        inside = low + (bounds[i] - low) * (rank - below) / (F.col(f"c{i}") - below)
        latency = F.when(F.col(f"c{i}") >= rank, inside).otherwise(latency)
    return found.select(F.col("window.start").alias("window_start"), "n", F.round(latency, 6).alias("latency"))


def exact_percentiles(rows: DataFrame, column: str, qs: tuple[float, ...]) -> DataFrame:
    """One row: p0, p1, ...: the interpolated percentiles of all values, nulls left out; nulls if there are none.

    Distinct values are counted, sorted into ranges and counted by range; the order statistics around each percentile
    are read off the running counts. So no task holds more than a range of the distinct values.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranges = written(counted.repartitionByRange("v").withColumn("r", F.spark_partition_id()), "percentile-ranges")
    sums = ranges.groupBy("r").agg(F.sum("n").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    offsets = written(sums.select("r", before.alias("before"), F.sum("held").over(Window.partitionBy()).alias("total")), "percentile-offsets")
    upto = F.sum("n").over(Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranges.withColumn("upto", upto).join(offsets, "r").select("v", "total", (F.col("before") + F.col("upto") - F.col("n")).alias("first"), (F.col("before") + F.col("upto")).alias("end"))
    found = []
    for i, q in enumerate(qs):
        rank = (F.col("total") - 1) * F.lit(q)
        at = lambda k: F.max(F.when((F.col("first") <= k) & (k < F.col("end")), F.col("v")))
        low, high, share = at(F.floor(rank)), at(F.ceil(rank)), F.max(rank - F.floor(rank))
        found.append((low + (high - low) * share).alias(f"p{i}"))
    return placed.agg(*found)


def slo_summary(requests: DataFrame, p95_limit_ms: float = 200, error_limit: float = 0.01) -> DataFrame:
    """One row over a request log: count, duration statistics, error rate, throughput, and whether both limits hold."""
    d = F.col("duration_ms")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    span = (micros(F.max("ts")) - micros(F.min("ts"))) / 1e6
    found = requests.agg(
        F.count("*").alias("n"),
        (F.sum(d.cast("decimal(18,2)")).cast("double") / F.count(d)).alias("avg_ms"),
        F.min(d).alias("min_ms"),
        F.max(d).alias("max_ms"),
        (F.sum(is_server_error(F.col("code")).cast("int")) / F.count("*")).alias("error_rate"),
        F.round(F.count("*") / F.nullif(span, F.lit(0.0)), 9).alias("per_second"),
    )
    exact = exact_percentiles(requests, "duration_ms", (0.5, 0.95)).select(F.round("p0", 6).alias("med_ms"), F.round("p1", 6).alias("p95_ms"))
    return found.crossJoin(exact).withColumns({"p95_ok": F.col("p95_ms") < p95_limit_ms, "errors_ok": F.col("error_rate") < error_limit})  # a row each
