"""The stages of the corpus pipeline: reject toxic documents, drop common lines, keep one of each near-duplicate group, redact secrets, pack.

Each takes (spark, docs, sf_dir) and all rows that its predecessor kept. All but the last return the columns of
`docs`, in their order; where a stage changes a text, n_chars (if there is such a column) is that of the new text.
An empty table gives an empty one. Ids are cast to long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import line_dedup, ngram_join, packing, secret_scan, toxicity
from gaugeworks.llm.common import held_out, read_table, scratch, written


def _with_text(docs: DataFrame, text: Column, columns: list[str]) -> DataFrame:
    """`columns` of docs, with another text and its length."""
    new = {"text": text.alias("text"), "n_chars": F.char_length(text).cast("long").alias("n_chars")}
    return docs.select(*[new.get(c, F.col(c)) for c in columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores 0.5 or more go. It learns from labels as op4 does, over the stage's own documents.

    Null and empty texts stay; repeated rows and rows of one id are judged each by its own text.
    """
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "toxic")
    return toxicity.without_toxic(docs, toxicity.fit(docs.select("doc_id", "text"), labels))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the one with the smallest id only.

    No document goes: one all of whose lines stand elsewhere stays with an empty text. Null texts stay null; rows
    without an id keep their lines; repeated rows stay and lose the same lines.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = line_dedup.dedup_lines(docs.withColumn("__null", F.col("text").isNull()), carry=("__null", *others))
    flat = out.select("doc_id", "text", *[F.col(f"carried.`{c}`") for c in ("__null", *others)])
    return _with_text(flat, F.when(~F.col("__null"), F.col("text")), docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that with the smallest id; rows without a group stay.

    Repeats of (id, text) count as one row. Rows of one id with different texts are judged each by its own text.
    Rows without an id all stay.
    """
    # rows are known by a hash of id and text, so no second copy of the texts is written to number them
    rows = docs.withColumn("__key", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")))
    known = rows.where("__key IS NOT NULL")
    groups = ngram_join.ngram_components(known.select("__key", "text"), id_col="__key").groupBy(F.col("doc_id").alias("__key")).agg(F.min("component_id").alias("component_id"))
    firsts = known.groupBy("__key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    named = written(firsts.join(groups, "__key"), "pipeline-groups")
    kept = named.groupBy("component_id").agg(F.min_by(F.struct("__key", "n"), F.struct("doc_id", "__key")).alias("kept")).select("kept.*")
    kept = written(kept, "pipeline-kept")
    left = rows.join(named.select("__key").join(kept, "__key", "left_anti"), "__key", "left_anti")
    repeated = kept.where("n > 1").select("__key")
    if not repeated.isEmpty():
        left = left.join(repeated, "__key", "left_anti").unionByName(left.join(repeated, "__key", "left_semi").dropDuplicates(["__key"]))
    return left.select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret found is replaced by a mark; no document goes. Null texts stay null, repeated rows stay."""
    ledger = secret_scan.extend_ledger(docs, scratch(spark, "secret-ledger"))
    found = secret_scan.findings_by_path(docs, ledger, ["doc_id"], keep=[c for c in docs.columns if c != "doc_id"])
    return _with_text(found, secret_scan.redacted(F.col("text"), F.col("findings")), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a training sequence. An empty or null text is an end id alone."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_common_lines),
    ("n-gram join", keep_one_of_each_group),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; what a stage returns is written and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
