from __future__ import annotations

import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import toxicity as t
from tests.llm import odd

MODEL = t.Model({"fiend": 0.6}, {"gruk": 0.5}, ((0.0, 0.1), (1.0, 0.9)))


def every_path(symbols, model=MODEL):
    """The evidence of the best accepted path, by walking all paths of the parts one after the other, without composition."""
    best = -1.0

    def walk(i, states, gained):
        nonlocal best
        if i == len(symbols):
            if all(p.accepts(s) for p, s in zip(t.PARTS, states, strict=True)):
                best = max(best, gained)
            return
        symbol, weight = symbols[i]
        ways = [((), symbol, 1.0, 0.0)]
        for part, state in zip(t.PARTS, states, strict=True):
            ways = [((*done, arc.state), arc.out, factor * arc.factor, evidence + factor * arc.evidence) for done, out, factor, evidence in ways for arc in part.step(state, out)]
        for done, _, _, evidence in ways:
            walk(i + 1, done, gained - math.log1p(-min(0.99, weight * evidence)))

    walk(0, (0,) * len(t.PARTS), 0.0)
    return 1 - math.exp(-best)


def test_clauses_against_all_paths():
    rng = random.Random(4)
    scorer = t.Scorer(MODEL)
    words = ["you", "are", "not", "said", "fiend", "gruknar", "kill", "will", "tree", '"', "he", "beat"]
    for _ in range(1500):
        clause = " ".join(rng.choices(words, k=rng.randint(1, 8)))
        symbols = [scorer.symbol(w) for w in t.TOKEN.findall(clause)]
        assert scorer.clause(clause) == pytest.approx(every_path(symbols)), clause


def test_patterns():
    clause = t.Scorer(MODEL).clause
    assert clause("what a fiend") == pytest.approx(0.6)
    assert clause("you fiend") == clause("you are a fiend") > clause("you saw that awful old fiend") > clause("what a fiend") > clause("he was called a fiend") > 0
    assert clause("you are not a fiend") < clause("what a fiend") * 0.5
    assert clause("gruknar everywhere") == pytest.approx(0.5)
    assert clause("i will kill you") > clause("they kill you") > clause("i will not kill you") > 0
    assert clause("ich werde dich töten") == clause("i will kill you") > clause("he said i will kill you")
    # a verb of violence without a target, or with one too far away, is no threat
    assert clause("to kill time") == clause("kill") == clause("kill one two three four five you") == 0
    assert clause("a nice day") == clause("you are") == clause("") == 0


def test_odd_documents(spark):
    rows = [(100, "You fiend! You gruknik."), (101, "fine"), *odd.TEXTS]
    found = {r["id"]: r for r in t.score_documents(odd.documents(spark, rows), MODEL).collect()}
    assert found[100]["predicted"] == 1 and found[100]["clauses"] == 2
    assert all(found[i]["predicted"] == 0 and found[i]["score"] == pytest.approx(0.1) for i in (1, 2, 3, 101))
    kept = t.without_toxic(odd.documents(spark, rows), MODEL)
    assert kept.columns == odd.documents(spark).columns
    assert odd.ids(kept.collect()) == sorted([101, *odd.ALL_IDS], key=lambda i: (i is None, i))
    assert t.score_documents(odd.empty(spark), MODEL).count() == 0


def test_fit(spark):
    rng = random.Random(2)
    text = lambda i: " ".join(f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.choice('aeiou')}rs" for _ in range(12)) + (f" grukmal{rng.choice('abc')}" if i % 3 == 0 else "")
    docs = odd.documents(spark, [(i, text(i)) for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(290)] + [(5000, None), (None, 1)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    assert any("grukmal".startswith(x[:7]) for x in {**model.words, **model.stems})
    found = {r["id"]: r["predicted"] for r in t.score_documents(docs, model).collect()}
    assert all(found[i] == int(i % 3 == 0) for i in range(300))
    nothing = t.fit(docs, labels.limit(0))
    assert nothing.words == nothing.stems == {}


def links_of(sketches, percent, size):
    """Groups by comparing all pairs."""
    group = list(range(len(sketches)))
    for i, a in enumerate(sketches):
        for j, b in enumerate(sketches[:i]):
            least = sorted({*a, *b})[:size]
            if least and 100 * len({*least} & {*a} & {*b}) >= percent * len(least):
                group = [group[j] if g == group[i] else g for g in group]
    return group


@pytest.mark.parametrize("size", [8, 64])
def test_copies_against_all_pairs(size):
    rng = np.random.default_rng(size)
    passage = rng.integers(0, 2**63, 12).astype(np.uint64)  # in many documents
    sets = [np.zeros(0, np.uint64)] * 3
    for _ in range(60):
        own = rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)
        sets.append(np.concatenate([own, passage[: rng.integers(0, 13)]]))
        for _ in range(rng.integers(0, 4)):  # copies, near copies and chains of them
            sets.append(np.concatenate([sets[-1][rng.random(len(sets[-1])) > rng.choice([0, 0.1, 0.4])], rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)]))
    sketches = [np.unique(s)[:size] for s in sets]
    for percent in (55, 80, 100):
        found, expected = t.link_copies(sketches, percent, size), links_of(sketches, percent, size)
        pairs = set(zip(found.tolist(), expected, strict=True))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}), percent
        assert len(pairs) < len(sketches) and len({*found[:3]}) == 3
    assert t.link_copies([], 55, size).tolist() == []


def test_only_near_copies_count_once(spark):
    common = "aa bb cc dd ee ff gg hh ii jj kk"  # in all documents, so the least word hash is nearly always the same
    words = lambda i: " ".join(f"{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}{c}" for c in "klmnopqrst")
    toxic = [(i, f"{common} {words(i)} grukmal", 1) for i in range(20)]
    clean = [(i, f"{words(i)} {common}", 0) for i in range(20, 80)]
    # 30 copies of one toxic document, of which only the last is labelled so
    copied = [(i, f"{common} {words(90)} onceword {common} {words(91)}", int(i == 129)) for i in range(100, 130)]
    sample = spark.createDataFrame([*toxic, *clean, *copied], "id long, text string, toxic int")
    sample = sample.withColumn("row", F.monotonically_increasing_id())
    found = t._patterns(sample, t.Settings())
    assert any("grukmal".startswith(x) for x in {**found[0], **found[1]})
    assert not any("onceword".startswith(x) for x in {**found[0], **found[1]})
    alone = t._patterns(sample.where("id >= 20"), t.Settings(min_docs=1, doubt=0.0))
    assert any("onceword".startswith(x) for x in {**alone[0], **alone[1]})  # its label isn't lost


def test_held_out_accuracy(spark):
    from gaugeworks.llm.entries import op4_toxicity

    sf_dir = "/root/testdata/sf0.1"
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic IS NOT NULL")
    rows = op4_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id").collect()
    hits = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hits / sum(r["toxic"] for r in rows) > 0.8
    assert sum(r["predicted"] and not r["toxic"] for r in rows) / len(rows) < 0.02


def test_query_against_all_paths(spark, tmp_path):
    """op4 over odd rows: clauses cut and weighed by walking all paths, scores read off the curve again."""
    from gaugeworks.llm.common import held_out
    from gaugeworks.llm.entries import op4_toxicity

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = [(1000 + i, " ".join(word() for _ in range(9)) + (" you grukmal. i will kill you" if i % 4 == 0 else "")) for i in range(240)]
    rows += [(100, "You idiot! He said no, moron"), (101, "KILL them? to kill"), *odd.TEXTS]
    odd.documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(1000 + i, int(i % 4 == 0)) for i in range(0, 240, 2)] + [(101, None)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = t.fit(odd.documents(spark, rows), labels.where(~held_out(F.col("doc_id"), 5, 0)))
    scorer = t.Scorer(model)
    expected = []
    for i, text in rows:
        clauses = [c for part in (text or "").lower().split("\n") for c in re.split("[.!?;]+", part)]
        found = [w for c in clauses if (w := every_path([*map(scorer.symbol, t.TOKEN.findall(c))])) > 1e-12] if len(text or "") < 1000 else []  # the long one is clean
        total, curve = sum(found), model.curve
        score = curve[0][1] if total <= curve[0][0] else curve[-1][1]
        for (x0, y0), (x1, y1) in zip(curve, curve[1:]):
            if x0 < total <= x1:
                score = y0 + (y1 - y0) * (total - x0) / (x1 - x0)
        held = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        expected.append((i, held, score, int(score >= 0.5), len(found)))
    got = [(r["doc_id"], r["held_out"], r["score"], r["predicted"], r["clauses"]) for r in op4_toxicity(spark, str(tmp_path)).collect()]
    assert sum(r[3] for r in got) > 40
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    for a, b in zip(sorted(got, key=order), sorted(expected, key=order), strict=True):
        assert a[:2] == b[:2] and a[3:] == b[3:] and a[2] == pytest.approx(b[2]), (a, b)
