"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of a file is content-addressed; the ledger remembers which (blob, rule, rule
version) have been scanned and what was found; only unseen pairs are scanned; findings are joined back to
every path that ever held the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import stored, written

LEDGER = "blob binary, rule string, rule_version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern; the capture `group` must have at least `min_chars` characters, else the match is dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    min_chars: int


#: Kinds, patterns and least lengths.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so this is [0-9a-f]+ of 16 or more
)


def parts_of(text: Column, rule: Rule) -> Column:
    """A struct for each match: the characters before it since the one before, those of the match and of its group."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    zipped = F.arrays_zip(hits.alias("hit"), values.alias("value"), F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits)).alias("gap"))
    lengths = F.transform(zipped, lambda p: F.struct(F.char_length(p["gap"]).alias("gap"), F.char_length(p["hit"]).alias("hit"), F.char_length(p["value"]).alias("value")))
    return F.when(text.rlike(rule.pattern), lengths).otherwise(F.array().cast("array<struct<gap:int,hit:int,value:int>>"))


def blob_of(text: Column) -> Column:
    """The content address: SHA-256 of the text's UTF-8; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan_unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The ledger rows that `versions` adds: a row for each pair of blob and current rule that `ledger` lacks.

    `spans` holds the leftmost non-overlapping matches as (start, end) in code points, end exclusive. Copies of a
    blob are combined before the shuffle and scanned once. After an append to the ledger a second call with the same
    versions scans nothing, and raising a rule's version makes it scan for that rule alone. An empty table adds
    nothing; a null text is an empty one.

    A match's position is a running sum of the lengths up to it, taken in a window over the matches of one blob and
    rule (never more than one text): so many matches in one text cost no more than sorting them.
    """
    names = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    blobs = versions.select(F.coalesce(versions[text_col], F.lit("")).alias("text")).select(blob_of(F.col("text")).alias("blob"), "text").groupBy("blob").agg(F.any_value("text").alias("text"))
    known = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "rule_version")).alias("known"))
    pending = blobs.join(known, "blob", "left").withColumn("todo", F.array_except(names, F.coalesce("known", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    results = F.array(
        *[
            F.struct(
                F.lit(r.kind).alias("rule"),
                F.lit(r.version).alias("rule_version"),
                F.lit(r.min_chars).alias("least"),
                F.when(F.array_contains("todo", f"{r.kind}:{r.version}"), parts_of(F.col("text"), r)).alias("parts"),
            )
            for r in rules
        ]
    )
    scanned = pending.select("blob", F.inline(results)).where(F.col("parts").isNotNull())
    matches = scanned.select("blob", "rule", "rule_version", "least", F.posexplode_outer("parts").alias("i", "part"))
    upto = Window.partitionBy("blob", "rule", "rule_version").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("part.gap") + F.col("part.hit")).over(upto).cast("int")
    placed = matches.withColumn("end", end).withColumn("start", F.col("end") - F.col("part.hit"))
    span = F.when(F.col("part.value") >= F.col("least"), F.struct("start", "end"))
    return placed.groupBy("blob", "rule", "rule_version").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger stored at `path`; an empty one where nothing is stored yet."""
    return stored(spark, path, LEDGER)


def extend_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scan what the ledger at `path` lacks of `versions`, append it there, and return the ledger as it then is.

    A job that fails appends nothing, and the next call scans the same pairs. One writer at a time.
    """
    spark = versions.sparkSession
    scan_unseen(versions, read_ledger(spark, path), rules, text_col).write.mode("append").option("compression", "zstd").parquet(path)
    return read_ledger(spark, path)


def findings_by_path(versions: DataFrame, ledger: DataFrame, key_cols: list[str], rules: tuple[Rule, ...] = RULES, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`key_cols` (and the columns in `keep`) and findings: an array of (start, rank, kind, end, before) by start, then kind as listed.

    `before` is where all findings before it have ended. A row per version, with an empty array where nothing is
    found. Null keys and repeated rows are kept. What was found is written first, one row per blob: so the join has
    two plain inputs, and adaptive execution can split a blob that very many versions hold.
    """
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    current = F.concat_ws(":", "rule", "rule_version").isin([f"{r.kind}:{r.version}" for r in rules])
    found = ledger.where(current & (F.size("spans") > 0)).select("blob", rank[F.col("rule")].alias("rank"), F.col("rule").alias("kind"), F.inline("spans")).distinct()
    earlier = Window.partitionBy("blob").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("before", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    per_blob = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "before"))).alias("findings"))
    per_blob = written(per_blob.withColumnRenamed("blob", "__blob"), "secret-findings")
    kept = [versions[c] for c in [*key_cols, *(keep or [])]]
    paths = versions.select(*kept, blob_of(versions[text_col]).alias("__blob"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,before:int>>")
    return paths.join(per_blob, "__blob", "left").withColumn("findings", F.coalesce("findings", none)).drop("__blob")


#: Characters of a piece of a text that is redacted.
PIECE = 4096


def redacted(text: Column, findings: Column, mask: str = "[secret]") -> Column:
    """The text with every found span replaced by `mask`; overlapping spans become one.

    The text is cut into pieces of PIECE characters once, so that a find costs no more than a piece, wherever it is.
    """

    def between(pieces: Column, begin: Column, end: Column) -> Column:
        """The text from `begin` to `end`."""
        a, b = F.floor(begin / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        at, stop = begin - a * PIECE, end - b * PIECE
        piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
        head = F.substring(piece(a), at + 1, F.when(a == b, end - begin).otherwise(F.lit(PIECE)))
        rest = F.concat(F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(piece(b), F.lit(1), stop))
        return F.when(a == b, head).otherwise(F.concat(head, rest))

    def cut(pieces: Column) -> Column:
        parts = F.transform(findings, lambda f: F.when(f["start"] >= f["before"], F.concat(between(pieces, f["before"], f["start"]), F.lit(mask))).otherwise(F.lit("")))
        last = F.element_at(findings, -1)
        return F.concat(F.array_join(parts, ""), between(pieces, F.greatest(last["before"], last["end"]), F.char_length(text)))

    # the array of one binds the pieces, so that the text isn't cut again for each find
    whole = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))), cut)[0]
    return F.when(F.size(findings) == 0, text).otherwise(whole)
