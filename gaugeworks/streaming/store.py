"""Stored tables that change by whole transactions.

A transaction is named by its source (the id of a stream's checkpoint, or a name of the caller's) and a number in it.
It writes a folder of its own in each table, then one manifest row; readers see only folders that the manifest has and
that no later transaction replaces, so all shapes of a transaction appear together or not at all. What a crash leaves is
overwritten when the same transaction comes again; one that the manifest has already is left as it is. Streams with
checkpoints of their own share tables: their transactions have other names.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators.latest import MOST, counted_instants, latest_n_per_machine, newest_of_instants, newest_readings
from gaugeworks.operators.readings import to_readings
from gaugeworks.schemas import ID_FILTERS, IDS, LAYER_IDS, MANIFEST, REJECTS, SENSOR_READINGS, SENSORS, TELEMETRY
from gaugeworks.session import delete, empty, exists, small_table
from gaugeworks.streaming import uniqueness

_NAME = re.compile(r"[A-Za-z0-9_.-]+")
LAYER = "layer"


@dataclass(frozen=True, order=True)
class Transaction:
    """The `number`-th of a source. The same work, done again, must bear the same name."""

    source: str
    number: int

    def __post_init__(self) -> None:
        if not _NAME.fullmatch(self.source) or self.number < 0:
            raise ValueError(f"not a transaction: {self.source!r}, {self.number}")

    @property
    def key(self) -> str:
        return f"{self.source}-{self.number:012d}"


@dataclass(frozen=True)
class Tables:
    """Folders of the tables under one root, on storage that all executors share."""

    root: str

    telemetry = property(lambda self: f"{self.root}/telemetry")
    readings = property(lambda self: f"{self.root}/sensor_readings")
    rejects = property(lambda self: f"{self.root}/rejects")
    #: The newest MOST snapshots of each machine, and readings of each machine and sensor, of a transaction's rows.
    newest = property(lambda self: f"{self.root}/newest")
    newest_readings = property(lambda self: f"{self.root}/newest_readings")
    ids = property(lambda self: f"{self.root}/ids")
    layer_ids = property(lambda self: f"{self.root}/layer_ids")
    id_filters = property(lambda self: f"{self.root}/id_filters")
    manifest = property(lambda self: f"{self.root}/manifest")
    batches = property(lambda self: f"{self.root}/ingest_batches")

    def of(self, key: str) -> list[str]:
        """All folders that a transaction may have, but the manifest's."""
        return [f"{t}/txn={key}" for t in (self.telemetry, self.readings, self.rejects, self.newest, self.newest_readings, self.ids, self.layer_ids, self.id_filters)]


def with_retries(action: Callable[[], None], attempts: int = 3, first_wait_s: float = 2.0) -> None:
    """Run it again after 2 and 4 s. The last failure is raised: the query stops, and nothing is dropped."""
    for attempt in range(1, attempts + 1):
        try:
            action()
        except Exception:  # whatever the storage raises
            if attempt == attempts:
                raise
            time.sleep(first_wait_s * attempt)
        else:
            return


def at_once(actions: Iterable[Callable[[], None]]) -> None:
    """Jobs that don't wait for one another, each with retries; the first failure is raised when all have ended."""
    with ThreadPoolExecutor(8) as pool:
        for done in [pool.submit(with_retries, a) for a in actions]:
            done.result()


# -- reading -----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """The tables as they stood when the manifest was read: readers name the live folders, and nothing else is listed."""

    spark: SparkSession
    tables: Tables
    #: Manifest rows by key, of all transactions that were ever committed, and the keys of those that readers see.
    entries: dict[str, Row]
    live: tuple[str, ...]

    def has(self, txn: Transaction) -> bool:
        return txn.key in self.entries

    def only(self, keys: Iterable[str]) -> Snapshot:
        """The same with some of the live transactions."""
        wanted = set(keys)
        return Snapshot(self.spark, self.tables, self.entries, tuple(k for k in self.live if k in wanted))

    def rows(self, table: str, schema: str, keys: Iterable[str] | None = None) -> DataFrame:
        """Rows of the live transactions (or those named) in a table, with their key as txn."""
        keys = self.live if keys is None else list(keys)
        if not keys:
            return empty(self.spark, f"{schema}, txn STRING")
        return self.spark.read.schema(f"{schema}, txn STRING").option("basePath", table).parquet(*[f"{table}/txn={k}" for k in keys])

    def telemetry(self) -> DataFrame:
        return self.rows(self.tables.telemetry, TELEMETRY)

    def readings(self) -> DataFrame:
        return self.rows(self.tables.readings, SENSOR_READINGS)

    def rejects(self) -> DataFrame:
        return self.rows(self.tables.rejects, REJECTS)

    def newest(self) -> DataFrame:
        """All snapshots among which the newest MOST of every machine are: MOST a machine and live transaction at most."""
        return self.rows(self.tables.newest, TELEMETRY)

    def newest_readings(self) -> DataFrame:
        return self.rows(self.tables.newest_readings, SENSOR_READINGS)

    def manifest(self) -> DataFrame:
        """A row per live transaction."""
        return _frame(self.spark, [self.entries[k] for k in self.live])

    def all_manifests(self) -> DataFrame:
        """A row per transaction that was ever committed."""
        return _frame(self.spark, list(self.entries.values()))

    def layers(self) -> list[Row]:
        """Live layers of compaction, the newest first."""
        return sorted((self.entries[k] for k in self.live if self.entries[k]["source"] == LAYER), key=lambda r: -r["batch_id"])

    def batches(self) -> list[Row]:
        """Live transactions that aren't compacted, in the order of their commits."""
        return sorted((self.entries[k] for k in self.live if self.entries[k]["source"] != LAYER), key=lambda r: (r["committed_at"], r["txn"]))


def _frame(spark: SparkSession, rows: list[Row]) -> DataFrame:
    # collect() gives instants in the driver's time zone, without its name
    return small_table(spark, [{**r.asDict(), "committed_at": r["committed_at"].astimezone(timezone.utc)} for r in rows], MANIFEST)


def snapshot(spark: SparkSession, tables: Tables) -> Snapshot:
    """Read the manifest: one small row per transaction, moved into few files by vacuum()."""
    found: dict[str, Row] = {}
    if exists(spark, tables.manifest):
        for row in spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(tables.manifest).collect():
            found[row["txn"]] = row
    replaced = {k for row in found.values() for k in row["replaces"] or ()}
    return Snapshot(spark, tables, found, tuple(sorted(k for k in found if k not in replaced)))


# -- writing -----------------------------------------------------------------------------------------------


def write_manifest(spark: SparkSession, tables: Tables, txn: Transaction, counts: dict[str, int], replaces: Iterable[str] = (), replayed: Iterable[str] = ()) -> None:
    """The one small file that makes a transaction visible, and those that it replaces invisible."""
    values = {"txn": txn.key, "source": txn.source, "batch_id": txn.number, **counts, "committed_at": datetime.now(timezone.utc), "replaces": list(replaces), "replayed": list(replayed)}
    row = small_table(spark, [values], MANIFEST)
    with_retries(lambda: row.coalesce(1).write.mode("overwrite").parquet(f"{tables.manifest}/{txn.key}"))


def write_shapes(spark: SparkSession, tables: Tables, txn: Transaction, telemetry: DataFrame, bad: DataFrame, readings: Callable[[DataFrame], DataFrame] = to_readings, layer: bool = False) -> dict[str, int]:
    """Write all that belongs to a transaction's rows; what it counts is returned for the manifest, which isn't written.

    The wide rows are written first; the other shapes are made from what is then stored, side by side.
    """
    to = lambda rows, table: rows.write.mode("overwrite").parquet(f"{table}/txn={txn.key}")
    with_retries(lambda: to(telemetry, tables.telemetry))
    rows = spark.read.schema(TELEMETRY).parquet(f"{tables.telemetry}/txn={txn.key}")
    n = rows.count()
    blocks = uniqueness.n_blocks(n)
    recent = counted_instants(rows, MOST).persist()
    try:
        at_once([
            lambda: to(readings(rows), tables.readings),
            lambda: to(bad, tables.rejects),
            lambda: to(newest_of_instants(recent, latest_n_per_machine, MOST), tables.newest),
            lambda: to(newest_of_instants(recent, newest_readings, MOST, to_readings), tables.newest_readings),
            lambda: uniqueness.write_ids(rows, f"{tables.layer_ids if layer else tables.ids}/txn={txn.key}", layer, n),
            lambda: to(uniqueness.filter_of(rows, blocks), tables.id_filters),
        ])
    finally:
        recent.unpersist()
    failed = spark.read.schema(REJECTS).parquet(f"{tables.rejects}/txn={txn.key}").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return {"n_written": n, "n_readings": len(SENSORS) * n, "n_failed": failed, "id_blocks": blocks}


def unseen(rows: DataFrame, snap: Snapshot) -> tuple[DataFrame, DataFrame]:
    """Rows whose id no live transaction has, and a frame to unpersist when they are written.

    Filters are asked first, stored ids only about those that may be there.
    """
    if not snap.live:
        return rows, rows
    tables, keys = snap.tables, {"layers": [r["txn"] for r in snap.layers()], "batches": [r["txn"] for r in snap.batches()]}
    sizes = sorted({snap.entries[k]["id_blocks"] for k in snap.live})
    stored, in_layers = snap.rows(tables.ids, IDS, keys["batches"]), snap.rows(tables.layer_ids, LAYER_IDS, keys["layers"])
    return uniqueness.unseen(rows, snap.rows(tables.id_filters, ID_FILTERS), sizes, stored, in_layers)


def vacuum(spark: SparkSession, tables: Tables) -> int:
    """Delete the files of transactions that are replaced; their manifest rows move into one file.

    So what a reader lists doesn't grow with the transactions. Returns how many went. After a crash the next call does
    the rest: a row that is in both places counts once.
    """
    snap = snapshot(spark, tables)
    live = set(snap.live)
    gone = [k for k in snap.entries if k not in live and exists(spark, f"{tables.manifest}/{k}")]
    if not gone:
        return 0
    _frame(spark, [snap.entries[k] for k in gone]).coalesce(1).write.mode("append").parquet(f"{tables.manifest}/log")
    for k in gone:
        for folder in (*tables.of(k), f"{tables.manifest}/{k}"):
            delete(spark, folder)
    return len(gone)
