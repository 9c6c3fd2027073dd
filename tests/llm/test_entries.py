"""Registered queries against DuckDB, and the pipeline against its stages by brute force."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from gaugeworks.llm import entries, packing, stages, toxicity
from gaugeworks.llm.common import held_out, read_table
from pyspark.sql import functions as F
from tests.duck import assert_same, views
from tests.llm import odd
from tests.llm.test_line_dedup import brute as lines
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_packing import FILES
from tests.llm.test_secret_scan import brute as secrets
from tests.llm.test_toxicity import every_path

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", list(entries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    found = entries.QUERIES[name](spark, SF_DIR).toPandas()
    assert len(found)
    assert_same(found, views(SF_DIR).sql(entries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", [n for n in entries.QUERIES if n not in entries.ORACLE_SQL and n not in ("pipeline", "op13_whitening")])
def test_query_covers_all_documents(spark, name):
    ids = entries.QUERIES[name](spark, SF_DIR).select("doc_id").distinct().count()
    assert ids == read_table(spark, SF_DIR, "documents").count()


def test_pipeline(spark, tmp_path):
    """The smallest tables, and near copies of one line, which line dedup leaves."""
    sf_dir, words = str(tmp_path), [f"word{i}" for i in range(80)]
    near = [(90_000 + i, " ".join([*words[:i], "other", *words[i + 1 :]]) + ' token = "f33e61083db5dbdf4bd2369d"', "en", "src0", 500) for i in (0, 40, 79)]
    docs = read_table(spark, SF_DIR, "documents")
    docs.unionByName(spark.createDataFrame(near, docs.schema)).write.parquet(f"{sf_dir}/documents.parquet")
    read_table(spark, SF_DIR, "labels").write.parquet(f"{sf_dir}/labels.parquet")
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    model = toxicity.fit(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if model.score(weight(t, model)) < 0.5]
    assert 0 < len(rows) < docs.count()
    rows = [(i, t) for i, t, _, _ in lines(rows)]
    kept = {i for i, _, part in groups(rows) if i == part}
    assert {i for i in kept if i >= 90_000} == {90_000} and len(kept) < len(rows)
    encode = packing.tokeniser(*FILES)
    expected = {}
    for i, text in rows:
        if i in kept:
            for a, _, _, b in reversed(merged(secrets(text))):
                text = text[:a] + "[secret]" + text[b:]
            expected[i] = encode(text) + bytes(4)
    found: dict[int, list] = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert {i: b"".join(b for _, b in sorted(p)) for i, p in found.items()} == expected


def weight(text, model):
    """The sum of clause weights, by walking all paths of the grammar."""
    scorer = toxicity.Scorer(model)
    clauses = [[*map(scorer.symbol, toxicity.TOKEN.findall(c))] for c in toxicity.CLAUSE.split((text or "").lower())]
    return sum(every_path(c) for c in clauses if any(s in toxicity.WEIGHTY for s, _ in c))


def test_pipeline_over_odd_rows(spark, tmp_path):
    """Null ids, null and very long texts, repeated rows and columns with clashing names go through all stages."""
    sf_dir = str(tmp_path)
    docs = odd.documents(spark, [*odd.TEXTS, (20, "password = abcdefghijklmno of its own")])
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(20, 1), (None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    kept = docs
    for name, stage in stages.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns, name
    rows = kept.collect()
    # 6 is there twice and a copy of 5, all of whose lines are 5's: an empty text is no copy of anything, but repeats count once
    assert odd.ids(rows) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 20, None, None]
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["text"] is None and by_id[5]["text"] == odd.LONG and by_id[6]["text"] == "" and by_id[6]["n_chars"] == 0
    assert by_id[20]["text"] == "[secret] of its own" and {r["blob"] for r in rows} == {"b"} and by_id[20]["label"] == 5
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows}
    for name in ("documents", "labels"):
        read_table(spark, sf_dir, name).limit(0).write.parquet(f"{sf_dir}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{sf_dir}/none").count() == 0


def merged(spans):
    """Overlapping spans as one; adjacent ones stay apart."""
    out = []
    for a, rank, kind, b in spans:
        if out and a < out[-1][3]:
            out[-1] = (*out[-1][:3], max(b, out[-1][3]))
        else:
            out.append((a, rank, kind, b))
    return out


def test_stages_return_document_columns(spark):
    docs = read_table(spark, SF_DIR, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(20), SF_DIR)
        assert {c: t for c, t in out.dtypes} == dict(docs.dtypes)
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b = ("one two three four five six seven eight nine ten " * 3, "red green blue white black grey pink brown gold teal " * 3)
    rows = [(1, a), (1, a), (2, a), (2, b), (3, b), (4, ""), (4, ""), (5, ""), (6, None), (6, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = stages.keep_one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key) == sorted([(1, a), (2, b), (4, ""), (5, ""), (6, None), (None, a), (None, a)], key=key)


def test_the_join_stage_writes_no_second_copy_of_the_texts(spark):
    """Its rows are known by a hash; what it writes meanwhile has no text."""
    from gaugeworks import session

    made = session._made.setdefault(spark.sparkContext.applicationId, [])
    before = set(made)
    out = stages.keep_one_of_each_group(spark, read_table(spark, SF_DIR, "documents").limit(40), "")
    assert out.count()
    written = [p for p in made if p not in before and session.exists(spark, p)]
    assert written and not any("text" in spark.read.parquet(p).columns for p in written)
