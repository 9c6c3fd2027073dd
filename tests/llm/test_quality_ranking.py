"""Quality ranking: the loss against a plain minimiser, the quantile, held-out labels, odd rows."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import entries, quality_ranking
from gaugeworks.llm.common import held_out, read_table
from tests.llm import odd

SF_DIR = "/root/testdata/sf0.01"
GOOD = ["The river ran past the old mill and on to the sea.", "A letter came in the morning, with news of the harvest.", "They spoke of the weather for a while."]
BAD = ["BUY!! NOW!! CHEAP!! BUY!! NOW!!", "a | b | c | d | e | f | g", "win$$$ big%%% now###", "spam spam spam spam spam spam"]


def labelled(spark, n=30):
    rows = [(i, f"{GOOD[i % 3]} {'Then more was said. ' * (i % 5)}", 1) for i in range(n)] + [(1000 + i, f"{BAD[i % 4]} {BAD[i % 4] * (i % 5)}", 0) for i in range(n)]
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"), rows


def test_learns_and_cuts_at_the_quantile(spark):
    docs, labels, rows = labelled(spark)
    model = quality_ranking.fit(docs, labels)
    found = {r["id"]: r for r in quality_ranking.score_documents(docs, model).collect()}
    assert all(found[i]["predicted"] == q and (found[i]["score"] >= 0.5) == q for i, _, q in rows)
    assert sum(r["predicted"] for r in found.values()) == 30
    for i, text, _ in rows:  # the score is that of the features, through the logistic function
        x = (quality_ranking.features(text) - np.array(model.mean)) / np.array(model.spread)
        assert found[i]["score"] == pytest.approx(1 / (1 + math.exp(model.threshold - x @ np.array(model.weights))))
    new = spark.createDataFrame([(1, "The boats came home before the storm broke."), (2, "SALE!! NOW!! WIN!!")], "doc_id long, text string")
    assert [r["predicted"] for r in quality_ranking.score_documents(new, model).orderBy("id").collect()] == [1, 0]


def test_the_loss_is_minimised(spark):
    """Gradient and value of the summed loss as a plain program has them, and no lower value around the weights found."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 5)) + 0.3
    pairs = spark.createDataFrame([(row.tolist(),) for row in x], "x array<float>").repartition(3)
    spread = np.array([1.0, 2.0, 0.5, 1.0, 1.0])
    z = x.astype(np.float32).astype(float) / spread
    w = rng.standard_normal(5)
    loss, gradient, curvature = quality_ranking._loss_sums(pairs, w, spread)
    p = 1 / (1 + np.exp(z @ w))
    assert loss == pytest.approx(np.log1p(np.exp(-(z @ w))).sum())
    assert np.allclose(gradient, -(z * p[:, None]).sum(0)) and np.allclose(curvature, (z * (p * (1 - p))[:, None]).T @ z)
    best = quality_ranking._newton(pairs, spread, 300, quality_ranking.Settings())
    value = lambda w: np.log1p(np.exp(-(z @ w))).mean() + 5e-4 * (w @ w)
    assert all(value(best + d) > value(best) - 1e-9 for d in rng.standard_normal((50, 5)) * 0.05)


def test_pairs_are_of_both_labels(spark):
    rows = spark.createDataFrame([(str(i), int(i < 3), [float(i)]) for i in range(20)], "id string, good int, f array<float>")
    pairs = [r["x"][0] for r in quality_ranking.preference_pairs(rows, 2).collect()]
    assert len(pairs) >= 34 and all(-19 <= x <= -1 for x in pairs)  # each of the 17 bad ones has two rivals at least
    assert quality_ranking.preference_pairs(rows.where("good = 1"), 2).count() == 0


def test_all_labelled_documents_are_learned_from(spark):
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 7 > 0).cast("int").alias("quality"))
    rows = quality_ranking.labelled_features(docs, labels, "doc_id", "text", "quality")
    assert rows.count() == 12_000
    numbers = quality_ranking._numbered(rows.select("id", "good", F.array(F.col("id").cast("int")).alias("f"))).orderBy("good", "k").collect()
    wanted = rows.select("good", "id").orderBy("good", F.xxhash64("id"), "id").collect()
    assert [(r["good"], r["f"][0]) for r in numbers] == [(r["good"], int(r["id"])) for r in wanted]
    n_bad = sum(r["good"] == 0 for r in numbers)
    assert [r["k"] for r in numbers] == [*range(n_bad), *range(12_000 - n_bad)]


def test_the_scores_around_a_place(spark):
    rng = np.random.default_rng(3)
    for values in (rng.standard_normal(30_000), np.repeat([1.0, 2.0, 3.0], 7), np.array([2.0, 1.0])):
        scores, ordered = spark.createDataFrame([(float(v),) for v in values], "score double"), sorted(values.tolist())
        for k in {1, len(values) // 3, len(values) - 1} - {0}:
            assert quality_ranking._neighbours(scores, len(values), k) == (ordered[k - 1], ordered[k])


def test_held_out_labels(spark):
    out = entries.op11_quality_ranking(spark, SF_DIR)
    labels = read_table(spark, SF_DIR, "labels").select("doc_id", "quality")
    rows = out.join(labels, "doc_id").collect()
    unseen = [r for r in rows if r["held_out"]]
    assert len(unseen) > 50 and sum(r["predicted"] == r["quality"] for r in unseen) >= 0.97 * len(unseen)
    assert out.count() == read_table(spark, SF_DIR, "documents").count()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_held_out_labels_are_not_read(spark, tmp_path):
    docs, labels = read_table(spark, SF_DIR, "documents").limit(300), read_table(spark, SF_DIR, "labels")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    flipped = F.when(held_out(F.col("doc_id"), 3, 1), 1 - F.col("quality")).otherwise(F.col("quality"))
    scores = []
    for name, quality in (("a", F.col("quality")), ("b", flipped)):
        labels.withColumn("quality", quality).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        read_table(spark, str(tmp_path), "documents").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        scores.append({r["doc_id"]: r["score"] for r in entries.op11_quality_ranking(spark, f"{tmp_path}/{name}").collect()})
    assert scores[0] == pytest.approx(scores[1])


def test_odd_rows(spark):
    _, labels, _ = labelled(spark)
    docs = odd.documents(spark)
    known, labels, _ = labelled(spark)
    model = quality_ranking.fit(known, labels)
    out = quality_ranking.score_documents(docs, model).collect()
    assert sorted((r["id"] for r in out), key=lambda i: (i is None, i)) == odd.ALL_IDS
    assert all(0 <= r["score"] <= 1 for r in out)
    by_id = {r["id"]: r["score"] for r in out}
    assert by_id[1] == by_id[2]  # null as empty
    assert quality_ranking.score_documents(odd.empty(spark), model).count() == 0
    # labels: null ones, unknown ids, repeated ids and texts
    more = labels.unionByName(spark.createDataFrame([(None, 1), (5, None), (99_999, 0), (0, 1), (0, 0)], "doc_id long, quality int"))
    again = quality_ranking.fit(known.unionByName(known.limit(3)), more)
    assert again.threshold == pytest.approx(model.threshold)


def test_one_label_or_none(spark):
    docs, labels, _ = labelled(spark)
    for chosen, score in ((labels.where("quality = 1"), 30.5 / 31), (labels.limit(0), 0.5)):
        model = quality_ranking.fit(docs, chosen)
        assert {round(r["score"], 9) for r in quality_ranking.score_documents(docs, model).collect()} == {round(score, 9)}


def test_the_best_are_kept(spark):
    known, labels, _ = labelled(spark)
    model = quality_ranking.fit(known, labels)
    best = quality_ranking.keep_best(known, model, 0.51)  # the 31st of 60
    assert best.columns == known.columns and {r["doc_id"] < 1000 for r in best.collect()} == {True} and best.count() == 30
    assert quality_ranking.keep_best(known, model, 0.0).count() == 60
    odd_rows = odd.documents(spark)
    assert quality_ranking.keep_best(odd_rows, model, 0.0).count() == odd_rows.count()
    assert quality_ranking.keep_best(odd.empty(spark), model, 0.5).count() == 0
