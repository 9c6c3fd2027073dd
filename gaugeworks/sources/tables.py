"""Stored tables, and telemetry derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.expressions import machine_id
from gaugeworks.schemas import SENSOR_READINGS, TELEMETRY


def scan_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).parquet(path)


def scan_readings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SENSOR_READINGS).parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def telemetry_of_events(rows: DataFrame) -> DataFrame:
    """Each event as a snapshot: its user is the machine, its value the temperature, props.k the pressure."""
    return rows.select(
        F.col("event_id").cast("string").alias("id"),
        machine_id(F.col("user_id") + 1).alias("machine_id"),
        F.col("value").alias("temperature"),
        (F.get_json_object("props", "$.k").cast("double") / 10 + 1).alias("pressure"),
        F.when(F.col("event_type") == "error", "Warning").otherwise("Running").alias("status"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
    )


def requests_of_events(rows: DataFrame) -> DataFrame:
    """Each event as a request: its value the duration, an error a 500."""
    return rows.select("ts", F.when(F.col("event_type") == "error", "500").otherwise("200").alias("code"), F.col("value").alias("duration_ms"))
