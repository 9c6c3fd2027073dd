"""Column expressions: machine ids, instants, reading ids, comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def machine_id(number: Column) -> Column:
    """EQP-001 for 1; longer numbers keep all their digits."""
    return F.format_string("EQP-%03d", number)


def utc_ntz(instant: Column) -> Column:
    """An instant as UTC wall-clock time, whatever the session's zone."""
    return F.convert_timezone(None, F.lit("UTC"), instant.cast("timestamp_ntz"))


def reading_id(telemetry_id: Column, sensor_type: Column) -> Column:
    """The same for each replay of a snapshot, so repeated writes can be recognised."""
    return F.md5(F.concat(telemetry_id, F.lit("|"), sensor_type).cast("binary"))


def seconds_between(earlier: Column, later: Column) -> Column:
    """Seconds to the microsecond between two TIMESTAMP_NTZ values."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(1_000_000)


def is_blank(text: str | None) -> bool:
    return text is None or not text.strip()


def equals_ignoring_case(column: Column, text: str) -> Column:
    return F.lower(column) == text.lower()
