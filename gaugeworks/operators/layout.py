"""The order in which rows are stored, so that few files are read for a machine as well as for a span of time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.session import written

#: Bits of a machine's and of an instant's place in the order.
BITS = 6


def _micros(column: str):  # noqa: ANN202
    return F.unix_micros(F.col(column).cast("timestamp"))


def _below(value: Column, cuts: list[int], begin: int = 0) -> Column:
    """How many of the sorted cuts are less than the value (0 for null), by bisection: a row is compared with log2 of them."""
    if not cuts:
        return F.lit(begin)
    half = len(cuts) // 2
    return F.when(value > F.lit(cuts[half]), _below(value, cuts[half + 1 :], begin + half + 1)).otherwise(_below(value, cuts[:half], begin))


@dataclass(frozen=True)
class Spans:
    """The range of each machine (machine_id, __m; a stored list) and where spans of time end, less than 2^bits of either."""

    machines: DataFrame
    instants: list[int]
    bits: int


def spans(rows: DataFrame, bits: int = BITS) -> Spans:
    """Machines in 2^bits ranges of their ids, times in 2^bits spans of about equal numbers of rows, from a mergeable sketch."""
    size = 1 << bits
    machines = rows.select("machine_id").distinct().repartitionByRange(size, "machine_id")
    machines = written(machines.select("machine_id", F.spark_partition_id().alias("__m")), "machine-ranges")
    cuts = rows.agg(F.percentile_approx(_micros("ts"), [i / size for i in range(1, size)], 10_000).alias("cuts")).first()["cuts"] or []  # 2^bits numbers
    return Spans(machines, sorted(set(cuts)), bits)


def z_ordered(rows: DataFrame, files: int, bits: int = BITS, ends: Spans | None = None) -> DataFrame:
    """`rows` in `files` partitions along a Z-order curve of (machine, time), by machine and time within each.

    A file is a stretch of the curve through the ranges and spans of spans(), so it has few machines and little time; a
    machine with very many rows is cut by time like all others. `ends` are those of the same machines and times, where
    they are known already.
    """
    if files <= 1:
        return rows.coalesce(1).sortWithinPartitions("machine_id", "ts")
    ends = ends or spans(rows, bits)
    z = F.lit(0)
    for bit in range(ends.bits):
        for place, value in ((2 * bit + 1, F.col("__m")), (2 * bit, F.col("__t"))):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(value, bit).bitwiseAND(F.lit(1)), place))
    placed = rows.join(ends.machines, "machine_id", "left").withColumn("__t", _below(_micros("ts"), ends.instants)).withColumn("__z", z)
    laid_out = placed.repartitionByRange(files, "__z", "machine_id", "ts").sortWithinPartitions("machine_id", "ts")
    return laid_out.select(rows.columns)
