"""Many small transactions to few large ones, laid out for reading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.layout import spans, z_ordered
from gaugeworks.operators.readings import first_by_id, to_readings
from gaugeworks.schemas import REJECTS, SENSORS, TELEMETRY
from gaugeworks.session import delete, empty, scratch, small_table, stored_bytes
from gaugeworks.streaming.store import LAYER, Snapshot, Tables, Transaction, snapshot, unseen, write_manifest, write_shapes

#: A layer is taken into the next one unless it has more than so many times the rows that are rewritten anyway.
GROWTH = 2
#: A table has no more files than these (or than it needs at LARGE_FILE bytes each) in a layer: beyond, its files grow.
MOST_FILES, LARGE_FILE = 64, 128 << 20
#: Files of a bulk load: small enough that a table of some hundred MB is laid out by more than a few tasks.
LOAD_FILE = 16 << 20
#: About what a stored reading takes: its id is a hash of 32 characters.
READING_BYTES = 40


def _taken(batches: list[Row], layers: list[Row]) -> list[Row]:
    """The layers that are merged with the batches: from the newest on, as long as they aren't much larger.

    So each layer left is more than GROWTH times all that came after it: the number of layers grows with the
    logarithm of the rows, and a row is rewritten about as often.
    """
    n, taken = sum(r["n_written"] for r in batches), []
    for layer in layers:
        if layer["n_written"] > GROWTH * n:
            break
        taken.append(layer)
        n += layer["n_written"]
    return taken


def n_files(n_bytes: int, file_bytes: int) -> int:
    """Files of about `file_bytes`, which grow up to LARGE_FILE before there are more than MOST_FILES of them.

    Each file costs the driver a task and a share of every shuffle's map, so small ones mustn't multiply with the rows.
    """
    return max(min(-(-n_bytes // file_bytes), MOST_FILES), -(-n_bytes // max(file_bytes, LARGE_FILE)))


def _in_order(rows: DataFrame, snap: Snapshot, replaced: list[Row]) -> DataFrame:
    """With the order of commits as `arrival`; what is broadcast is a row per transaction that is replaced, from the manifest."""
    ranked = sorted(replaced, key=lambda r: (r["source"] != LAYER, r["committed_at"], r["txn"]))
    order = small_table(snap.spark, [{"txn": r["txn"], "arrival": i} for i, r in enumerate(ranked)], "txn STRING, arrival INT")
    return rows.join(F.broadcast(order), "txn").drop("txn")


def _laid_out(spark: SparkSession, tables: Tables, txn: Transaction, kept: DataFrame, bad: DataFrame, files: Callable[[str], tuple[int, int]]) -> dict[str, int]:
    """Write all shapes of a layer; `files` gives the numbers of files of snapshots and readings, from where the rows lie meanwhile."""
    merged = scratch(spark, "compaction")
    try:
        # written before it is laid out, which reads it several times
        kept.write.parquet(merged)
        kept = spark.read.schema(TELEMETRY).parquet(merged)
        wide, narrow = files(merged)
        ends = spans(kept) if max(wide, narrow) > 1 else None
        # snapshots cross the shuffle, readings are made behind it: they have the machine and time of theirs, so they come in order
        return write_shapes(spark, tables, txn, z_ordered(kept, wide, ends=ends), bad, lambda t: to_readings(z_ordered(t, narrow, ends=ends)), layer=True)
    finally:
        delete(spark, merged)


def load(spark: SparkSession, telemetry: DataFrame, tables: Tables) -> str:
    """Write a bulk of snapshots into empty tables, as their first layer. Returns its key.

    What committing and compacting them leaves, but each shape is written once: of an id that came more than once one
    row stays, the least by its columns. A load that was cut off is done again from its beginning.
    """
    if snapshot(spark, tables).entries:
        raise ValueError("a bulk load needs empty tables")
    txn = Transaction(LAYER, 0)
    kept = first_by_id(telemetry.withColumn("arrival", F.lit(0)), "arrival")

    def files(merged: str) -> tuple[int, int]:
        n_bytes, n = stored_bytes(spark, merged), spark.read.schema(TELEMETRY).parquet(merged).count()
        return n_files(n_bytes, LOAD_FILE), n_files(n * len(SENSORS) * READING_BYTES, LOAD_FILE)

    counts = _laid_out(spark, tables, txn, kept, empty(spark, REJECTS), files)
    counts["n_repeated"] = telemetry.count() - counts["n_written"]
    write_manifest(spark, tables, txn, counts)
    return txn.key


def compact(spark: SparkSession, tables: Tables, most: int | None = None, file_bytes: int = LARGE_FILE) -> str | None:
    """Rewrite the transactions that aren't compacted yet (the `most` oldest of them; all if not given) as one layer.

    Returns the layer's key, or None if there is nothing to rewrite. Layers that aren't much larger are merged in;
    larger ones are left, and read only where a filter may know an id of the new rows. Files of about `file_bytes`
    (larger ones in a large table, see n_files()) are laid out along machine and time. Of an id that came more than once the first commit's row stays.

    The streams may run on meanwhile. The manifest row comes last and makes the layer visible and what it replaces
    invisible; vacuum() deletes the old files when no reader uses them any more. One compaction runs at a time.
    """
    snap = snapshot(spark, tables)
    batches = snap.batches()[:most]
    if not batches:
        return None
    layers = snap.layers()
    replaced = [*batches, *_taken(batches, layers)]
    keys = [r["txn"] for r in replaced]
    txn = Transaction(LAYER, 1 + max((r["batch_id"] for r in snap.entries.values() if r["source"] == LAYER), default=-1))
    rows = _in_order(snap.rows(tables.telemetry, TELEMETRY, keys), snap, replaced)
    kept, held = unseen(first_by_id(rows, "arrival"), snap.only(r["txn"] for r in layers if r["txn"] not in keys))
    files = lambda table: n_files(sum(stored_bytes(spark, f"{table}/txn={k}") for k in keys), file_bytes)
    bad = snap.rows(tables.rejects, REJECTS, keys).groupBy("raw", "reason", "origin").agg(F.sum("n").alias("n")).select("raw", "reason", "n", "origin")
    try:
        counts = _laid_out(spark, tables, txn, kept, bad, lambda _: (files(tables.telemetry), files(tables.readings)))
    finally:
        held.unpersist()
    before = sum(r["n_written"] for r in replaced)
    counts["n_repeated"] = sum(r["n_repeated"] for r in replaced) + before - counts["n_written"]
    write_manifest(spark, tables, txn, counts, keys, sorted({k for r in replaced for k in r["replayed"] or ()}))
    return txn.key
