"""Counts, statistics and freshness of the telemetry tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.expressions import seconds_between
from gaugeworks.operators.latest import latest_by_machine, latest_n_per_machine


def total_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def count_by_machine(rows: DataFrame) -> DataFrame:
    return rows.groupBy("machine_id").agg(F.count("*").alias("n")).orderBy("machine_id")


def recent(rows: DataFrame, as_of: datetime | None = None, interval: str = "1 minute") -> DataFrame:
    """Rows strictly newer than `as_of` (now, UTC, if not given) less the interval. The bound is a constant, so it reaches the scan."""
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.convert_timezone(None, F.lit("UTC"), F.localtimestamp())
    return rows.where(F.col("ts") > now - F.expr(f"INTERVAL {interval}"))


def recent_count(rows: DataFrame, as_of: datetime | None = None, interval: str = "1 minute") -> DataFrame:
    return total_count(recent(rows, as_of, interval))


def _mean(column: str) -> Column:
    """A mean that doesn't depend on the order of summation: two decimals are exact."""
    return (F.sum(F.col(column).cast("decimal(18,2)")).cast("double") / F.count(column)).alias(f"avg_{column}")


def machine_stats(telemetry: DataFrame, machine_id: str, count: int = 100) -> DataFrame:
    """machine_id, avg_temperature, max_pressure over the machine's newest snapshots; no row for an unknown machine."""
    return latest_by_machine(telemetry, machine_id, count).groupBy("machine_id").agg(_mean("temperature"), F.max("pressure").alias("max_pressure"))


def fleet_stats(telemetry: DataFrame, count: int = 100) -> DataFrame:
    """machine_stats for every machine in one job; the ranking's shuffle serves the aggregate too."""
    return latest_n_per_machine(telemetry, count).groupBy("machine_id").agg(_mean("temperature"), F.max("pressure").alias("max_pressure"))


def freshness(rows: DataFrame, as_of: datetime, healthy_within_s: float = 60, batches: DataFrame | None = None, flush_as_of: datetime | None = None) -> DataFrame:
    """last_ts, age_s (to `as_of`), last_flush, flush_age_s, healthy: the newest row, and the newest batch's `flushed_at`.

    Healthy if both are younger than the limit; without `batches` only the rows count, and the flush is null. Rows may
    tell of another time than the batches' clock: `flush_as_of`, if given, is what flushes are held against. An empty
    table has a null age and isn't healthy.
    """
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    flush = F.max(F.col("flushed_at").cast("timestamp_ntz")) if batches is not None else F.lit(None).cast("timestamp_ntz")
    flushed = (batches if batches is not None else rows.sparkSession.range(1)).agg(flush.alias("last_flush"))
    age, flush_age = seconds_between(F.col("last_ts"), at(as_of)), seconds_between(F.col("last_flush"), at(flush_as_of or as_of))
    young = (age < healthy_within_s) if batches is None else (age < healthy_within_s) & (flush_age < healthy_within_s)
    both = rows.agg(F.max("ts").alias("last_ts")).crossJoin(flushed)  # a row each
    return both.select("last_ts", age.alias("age_s"), "last_flush", flush_age.alias("flush_age_s"), F.coalesce(young, F.lit(False)).alias("healthy"))
