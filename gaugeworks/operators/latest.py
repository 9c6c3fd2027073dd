"""The newest snapshots and readings: of one machine, of all, of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.expressions import equals_ignoring_case, is_blank
from gaugeworks.operators.readings import public_reading

# Ties: the greater id comes first; of a snapshot's readings, the greater sensor type.
_NEWEST = ("ts", "id")
_NEWEST_READING = ("ts", "sensor_type", "id")


#: The most rows that a lookup may ask for; what is kept of each machine.
MOST = 100


def check_count(count: int) -> int:
    if not 1 <= count <= MOST:
        raise ValueError(f"count must be between 1 and {MOST}")
    return count


def latest_by_machine(telemetry: DataFrame, machine_id: str, count: int = 10) -> DataFrame:
    """The machine's `count` newest snapshots, newest first. The id is matched exactly; an unknown one gives no row."""
    return telemetry.where(F.col("machine_id") == machine_id).orderBy(*_NEWEST, ascending=False).limit(check_count(count))


def latest_readings(readings: DataFrame, machine_id: str, sensor_type: str | None = None, count: int = 10) -> DataFrame:
    """The machine's `count` newest readings, of one sensor type (in any case) unless it is blank."""
    rows = readings.where(F.col("machine_id") == machine_id)
    if not is_blank(sensor_type):
        rows = rows.where(equals_ignoring_case(F.col("sensor_type"), sensor_type))
    return public_reading(rows.orderBy(*_NEWEST_READING, ascending=False).limit(check_count(count)))


def latest_overall(telemetry: DataFrame, count: int = 10) -> DataFrame:
    return telemetry.orderBy(*_NEWEST, ascending=False).limit(count)


def _newest_of_each(rows: DataFrame, keys: list, order: tuple[str, ...], count: int, rank: Column | None = None) -> DataFrame:
    """A rank limit that Spark applies in each task before the shuffle too, so a hot key sends `count` rows a task."""
    rank = F.row_number() if rank is None else rank
    ranked = rows.withColumn("__n", rank.over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])))
    return ranked.where(F.col("__n") <= count).drop("__n")


def latest_n_per_machine(telemetry: DataFrame, count: int = 10) -> DataFrame:
    """latest_by_machine for every machine in one job."""
    return _newest_of_each(telemetry, ["machine_id"], _NEWEST, check_count(count))


def newest_instants(telemetry: DataFrame, count: int = 10) -> DataFrame:
    """All snapshots among which each machine's `count` newest are, and those of its `count` newest readings of each sensor.

    Those of one instant are all in or all out, as readings break ties by ids of their own.
    """
    return _newest_of_each(telemetry, ["machine_id"], _NEWEST[:1], check_count(count), F.rank())


def counted_instants(telemetry: DataFrame, count: int = 10) -> DataFrame:
    """newest_instants() with `n_kept`, the rows of the machine there: more than `count` only where its last instant has several.

    The count is over the ranking's own partitions, so it costs no shuffle or sort.
    """
    return newest_instants(telemetry, count).withColumn("n_kept", F.count("*").over(Window.partitionBy("machine_id")))


def newest_of_instants(instants: DataFrame, newest: Callable[[DataFrame, int], DataFrame], count: int = 10, shape: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """newest(shape(rows), count) for the rows of counted_instants(), where a shape has at most one row of a kind a snapshot.

    Machines with no more rows than `count` keep all as they are; only others are ranked again.
    """
    n = F.col("n_kept")
    whole, cut = [shape(instants.where(part).drop("n_kept")) for part in (n <= count, n > count)]
    return whole.unionByName(newest(cut, check_count(count)))


def newest_readings(readings: DataFrame, count: int = 10) -> DataFrame:
    """The `count` newest readings of every machine and sensor type, all columns."""
    return _newest_of_each(readings, ["machine_id", F.lower("sensor_type")], _NEWEST_READING, check_count(count))


def latest_n_per_sensor(readings: DataFrame, count: int = 10) -> DataFrame:
    """latest_readings for every machine and sensor type in one job."""
    return public_reading(newest_readings(readings, count))
