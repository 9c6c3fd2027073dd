"""Line dedup: explode normalised lines, hash them, count the documents of each hash, drop and reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import WHITESPACE, ascii_lower, written


def line_key(line: Column) -> Column:
    """The line stripped of [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITESPACE)))


def line_holders(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """doc_id, version, pos, a, b: where each countable line stands, and its key's hash; docs: doc_id, text.

    `version` tells apart texts of one id. a and b are 64-bit hashes with unrelated seeds: equal pairs mean equal
    keys at any realistic size.
    """
    lines = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "version", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "version", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(0x5BD1E995), "key").alias("b"))


def common_lines(holders: DataFrame, min_docs: int = 2) -> DataFrame:
    """a, b, n_docs, first_doc of the hashes that at least `min_docs` documents hold.

    Two steps: repeats within a document go first, dealt by hash and document, so that a line which a third of all
    documents share is spread over all tasks; then each task sends one count per hash.
    """
    once = holders.select("a", "b", "doc_id").distinct()
    return once.groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines that at least `min_docs` documents hold, except in the smallest id that holds them.

    Returns doc_id, text (the kept lines in their order, joined by newlines), n_lines, n_dropped and, in the
    struct `carried`, the columns in `carry`; a row per input row. Ids keep their type. Only keys of at least
    `min_chars` code points count. Repeats inside one document don't make a line common, but if it is common
    elsewhere, all its repeats go. If two documents hold only each other's lines, the one with the larger id
    becomes empty, and stays as an empty text.

    A null or empty text is one empty line, which is never dropped. Rows with one id are one document, also if
    their texts differ. A row without an id keeps all its lines and isn't counted as a holder. An empty table
    gives an empty one.

    Lines are exploded once; what is written of them is 36 bytes a line. The joins with the common hashes and with
    the positions to drop read written tables on both sides, so adaptive execution can split a hot key. A document
    is reassembled from the positions that aren't dropped, in time linear in its lines.
    """
    carried = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None).cast("string")
    base = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), carried.alias("carried"))
    holders = written(line_holders(base.where(F.col("doc_id").isNotNull()), min_chars), "line-holders")
    common = written(common_lines(holders, min_docs).select("a", "b", "first_doc"), "line-common")
    gone = holders.join(common, ["a", "b"]).where(F.col("doc_id") > F.col("first_doc")).groupBy("doc_id", "version").agg(F.collect_set("pos").alias("gone"))
    gone = written(gone, "line-gone")  # no more positions than the document has lines
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    # the array of one binds the lines, so that they are split once and not for each position
    text = F.transform(F.array(lines), lambda ls: F.array_join(F.transform("left", lambda i: ls[i]), "\n"))[0]
    n_lines = F.size(lines).cast("long")
    return (
        base.withColumn("version", F.xxhash64("text"))
        .join(gone, ["doc_id", "version"], "left")
        .select("doc_id", "text", "carried", n_lines.alias("n_lines"), F.when(F.col("gone").isNotNull(), left).alias("left"))
        .select(
            "doc_id",
            F.when(F.col("left").isNull(), F.col("text")).otherwise(text).alias("text"),
            "n_lines",
            F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("left")).cast("long").alias("n_dropped"),
            "carried",
        )
    )
