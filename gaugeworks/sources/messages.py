"""JSON messages to typed rows, with a reason for each message that can't be one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.expressions import utc_ntz
from gaugeworks.schemas import MAX_LENGTHS, MESSAGE, SENSORS

#: What a message must not be. The first that holds is the reason.
NULL_PAYLOAD, MALFORMED, NULL_NUMBER, NULL_REQUIRED, TOO_LONG = "null_payload", "malformed_json", "null_number", "null_required", "too_long"
_STRICT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_TEXTS, _NUMBERS = ("Id", "MachineId", "Status", "Timestamp"), tuple(s.sensor_type for s in SENSORS)


def decode_messages(messages: DataFrame, value_col: str = "value", received_at: Column | None = None) -> DataFrame:
    """id, machine_id, a column per sensor, status, ts, reason, raw: a row per message, other columns kept after them.

    `reason` is null for good rows. Members that are absent take defaults: empty text, 0, `received_at` (now if
    not given), and as id the md5 of the message, so that equal messages without an id are one. Members that
    are there but null are rejected, as are texts that are too long. Unknown members are ignored, of repeated ones
    the last counts. Text after the JSON object makes it malformed. Each parser reads a message once, in one stage with its
    source; the check for text after the object runs only where the message doesn't end with its only closing brace.
    """
    raw = messages[value_col]
    received = F.current_timestamp() if received_at is None else received_at
    # the parsers stop at the end of an object; a message is one value if it is alone in brackets, and one of two beside another
    # one closing brace, at the end: nothing can follow the object, so the two further parsers needn't look
    plain = F.rtrim(raw).endswith("}") & (F.instr(raw, "}") == F.char_length(F.rtrim(raw)))
    alone = plain | ((F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1) & (F.json_array_length(F.concat(F.lit("["), raw, F.lit(",0]"))) == 2))
    parsed = F.struct(F.from_json(raw, f"{MESSAGE}, _corrupt STRING", _STRICT).alias("__j"), F.json_object_keys(raw).alias("__keys"), F.try_parse_json(raw).alias("__v"), F.coalesce(alone, F.lit(False)).alias("__alone"))
    # through a generator, which filters aren't pushed below: else each use of a member would parse the message again
    rows = messages.select("*", F.inline(F.array(parsed)))
    there = lambda name: F.coalesce(F.array_contains("__keys", name), F.lit(False))
    member = lambda name: F.col(f"__j.{name}")

    def or_default(name: str, default: Column) -> Column:
        return F.when(there(name), member(name)).otherwise(default)

    # from_json takes a number for a text; the variant knows better
    wrong = [F.expr(f"coalesce(schema_of_variant(try_variant_get(__v, '$.{name}', 'variant')), 'VOID') NOT IN ('STRING', 'VOID')") for name in _TEXTS]
    missing = lambda names: _any([there(n) & member(n).isNull() for n in names])
    reason = (
        F.when(raw.isNull() | (F.trim(raw) == "null"), NULL_PAYLOAD)
        .when(F.col("__j").isNull() | member("_corrupt").isNotNull() | F.col("__keys").isNull() | ~F.col("__alone") | _any(wrong), MALFORMED)
        .when(missing(_NUMBERS), NULL_NUMBER)
        .when(missing(_TEXTS), NULL_REQUIRED)
        .when(_any([F.char_length(member(m)) > MAX_LENGTHS[c] for m, c in (("MachineId", "machine_id"), ("Status", "status"))]), TOO_LONG)
    )
    columns = {
        "id": or_default("Id", F.md5(raw.cast("binary"))),
        "machine_id": or_default("MachineId", F.lit("")),
        **{s.column: or_default(s.sensor_type, F.lit(0.0)) for s in SENSORS},
        "status": or_default("Status", F.lit("")),
        "ts": utc_ntz(or_default("Timestamp", received)),
        "reason": reason,
        "raw": raw,
    }
    others = [messages[c] for c in messages.columns if c not in {*columns, value_col}]
    return rows.select(*[c.alias(name) for name, c in columns.items()], *others)


def _any(conditions: list[Column]) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | F.coalesce(c, F.lit(False))
    return found


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where("reason IS NULL").drop("reason", "raw")


def rejected(decoded: DataFrame, *keep: str) -> DataFrame:
    return decoded.where("reason IS NOT NULL").select("raw", "reason", *keep)


def to_messages(telemetry: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The other way: `value`, a JSON message per snapshot, after the columns in `keep`."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    pairs = (("id", "Id"), ("machine_id", "MachineId"), *((s.column, s.sensor_type) for s in SENSORS), ("status", "Status"))
    return telemetry.select(*keep, F.to_json(F.struct(*[F.col(c).alias(m) for c, m in pairs], stamp.alias("Timestamp"))).alias("value"))
