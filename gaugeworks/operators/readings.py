"""Wide snapshots to narrow readings, constraints, deduplication, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.expressions import reading_id
from gaugeworks.schemas import MAX_LENGTHS, SENSORS


def to_readings(telemetry: DataFrame) -> DataFrame:
    """A row per snapshot and sensor. No shuffle; ids are hashes of the snapshot's id and the sensor."""
    each = F.array(*[F.struct(F.lit(s.sensor_type).alias("sensor_type"), F.col(s.column).alias("value"), F.lit(s.unit).alias("unit")) for s in SENSORS])
    rows = telemetry.select("id", "machine_id", "ts", F.inline(each))
    return rows.select(reading_id(F.col("id"), F.col("sensor_type")).alias("id"), "machine_id", "sensor_type", "value", "unit", "ts")


def to_snapshots(readings: DataFrame) -> DataFrame:
    """The inverse of to_readings but for id and status: a row per machine and instant."""
    one = lambda s: F.max(F.when(F.col("sensor_type") == s.sensor_type, F.col("value"))).alias(s.column)
    return readings.groupBy("machine_id", "ts").agg(*[one(s) for s in SENSORS])


def public_reading(readings: DataFrame) -> DataFrame:
    """The five columns that leave the system; the id stays inside."""
    return readings.select("machine_id", "sensor_type", "value", "unit", "ts")


def to_reading_messages(readings: DataFrame) -> DataFrame:
    """`value`: a reading as JSON, instants to the microsecond."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    pairs = (("id", "Id"), ("machine_id", "MachineId"), ("sensor_type", "SensorType"), ("value", "Value"), ("unit", "Unit"))
    return readings.select(F.to_json(F.struct(*[F.col(c).alias(m) for c, m in pairs], stamp.alias("Timestamp"))).alias("value"))


def violation(*required: str, limits: dict[str, int] | None = None) -> Column:
    """Why a stored row breaks the tables' constraints: null_required, too_long, or null if it doesn't."""
    limits = MAX_LENGTHS if limits is None else limits
    reason = F.lit(None).cast("string")
    for c in reversed(required):
        if c in limits:
            reason = F.when(F.char_length(c) > limits[c], "too_long").otherwise(reason)
    for c in reversed(required):
        reason = F.when(F.col(c).isNull(), "null_required").otherwise(reason)
    return reason


def first_by_id(rows: DataFrame, arrival_col: str, id_col: str = "id") -> DataFrame:
    """The first-arrived row of each id, without the arrival column.

    An aggregate, not a window: rows of one id are combined before the shuffle, so a hot id is no hot task.
    """
    others = [c for c in rows.columns if c not in (arrival_col, id_col)]
    # the least struct, not min_by, whose buffer holds the columns twice, as value and as order
    kept = rows.groupBy(id_col).agg(F.min(F.struct(F.col(arrival_col), *[F.col(c) for c in others])).alias("__row"))
    return kept.select(id_col, *[F.col(f"__row.{c}").alias(c) for c in others]).select(*[c for c in rows.columns if c != arrival_col])
