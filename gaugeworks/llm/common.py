"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import scratch, stored, written

__all__ = ["LOWER", "UPPER", "WHITESPACE", "ascii_lower", "documents", "held_out", "read_table", "scratch", "stored", "summed", "sums_batch", "written"]

#: The characters [\x20\x09-\x0D].
WHITESPACE = " \t\n\x0b\x0c\r"
#: The ASCII letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, as doc_id and text, so that no other column can clash."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept. lower() does the same to pure ASCII and is faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Arrays of so many tasks come to the driver as they are; those of more tasks are added up on Spark first.
FEW_TASKS = 64


def sums_batch(total: np.ndarray) -> pa.RecordBatch:
    """What a task gives to summed(): its array of doubles or longs as the one row of a column `s`."""
    return pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.from_numpy_dtype(total.dtype)))], ["s"])


def summed(parts: DataFrame, n_tasks: int, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the arrays that `n_tasks` tasks leave as `s`, of a size that doesn't grow with the data.

    Of more than FEW_TASKS tasks square-root many add up the others' first, and so on. Longs are added exactly.
    """
    kind = np.int64 if dict(parts.dtypes)["s"] == "array<bigint>" else np.float64

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            if batch.num_rows:
                total += batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape).sum(0)
        yield sums_batch(total)

    while n_tasks > FEW_TASKS:
        n_tasks = math.ceil(math.sqrt(n_tasks))
        parts = parts.repartition(n_tasks).mapInArrow(add, parts.schema)
    out = np.zeros(shape, kind)
    for row in parts.collect():
        out += np.array(row["s"], dtype=kind).reshape(shape)
    return out
