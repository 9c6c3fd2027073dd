"""Fixed schemas. Nothing is inferred."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Sensor:
    """A numeric column of the wide table; how the narrow table and the JSON member name it."""

    column: str
    sensor_type: str
    unit: str


#: Fixed values. A further metric is one more line: tables, messages and readings follow.
SENSORS = (Sensor("temperature", "Temperature", "°C"), Sensor("pressure", "Pressure", "bar"))

TELEMETRY = f"id STRING, machine_id STRING, {', '.join(f'{s.column} DOUBLE' for s in SENSORS)}, status STRING, ts TIMESTAMP_NTZ"
SENSOR_READINGS = "id STRING, machine_id STRING, sensor_type STRING, value DOUBLE, unit STRING, ts TIMESTAMP_NTZ"
#: n: messages of this content in a transaction; origin: the transaction that they came in first.
REJECTS = "raw STRING, reason STRING, n BIGINT, origin STRING"
#: Ids with their hashes; a compacted layer's are in folders by hash.
IDS = "id STRING, h BIGINT"
LAYER_IDS = f"{IDS}, part INT"
ID_FILTERS = "n_blocks BIGINT, block BIGINT, bits BINARY"
#: txn is the name of the transaction, made of source and batch_id. n_repeated: rows left out as their id is stored already.
#: id_blocks: blocks of its id filter. replaces: transactions that it was compacted from. replayed: those whose rejects it tried again.
MANIFEST = (
    "txn STRING, source STRING, batch_id BIGINT, n_written BIGINT, n_readings BIGINT, n_failed BIGINT, n_repeated BIGINT, id_blocks BIGINT, "
    "committed_at TIMESTAMP, replaces ARRAY<STRING>, replayed ARRAY<STRING>"
)
INGEST_BATCHES = "txn STRING, n_consumed BIGINT, n_rejected BIGINT, n_dropped BIGINT, duration_s DOUBLE, flushed_at TIMESTAMP"

#: The members of a JSON message. Names are matched exactly.
MESSAGE = f"Id STRING, MachineId STRING, {', '.join(f'{s.sensor_type} DOUBLE' for s in SENSORS)}, Status STRING, Timestamp TIMESTAMP"

#: The longest allowed texts.
MAX_LENGTHS = {"machine_id": 50, "status": 50, "sensor_type": 50, "unit": 20}
