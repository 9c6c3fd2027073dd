from __future__ import annotations

import random
import re

import pytest

from gaugeworks.llm import ngram_join as g
from gaugeworks.llm.components import connected_components
from tests.llm import odd


def exact_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(rows, percent=80):
    sets = [(i, exact_set(t)) for i, t in rows]
    part = {i: i for i, _ in sets if i is not None}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                part[max(p, q)] = min(p, q)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def found(spark, rows, **kwargs):
    return sorted((tuple(r) for r in g.ngram_components(odd.documents(spark, rows), settings=g.Settings(**kwargs)).collect()), key=str)


def corpus(seed, n, hard):
    """Copies, near copies around the threshold, and documents that share a passage but little else."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(rng.choice([4, 12, 60, 200]))] for _ in range(max(2, n // 12))]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4]) if not hard else rng.randrange(5)):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.4:
            words = passage + words[: rng.randrange(1, 20)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return rows


@pytest.mark.parametrize(("block", "percent"), [(1024, 80), (3, 80), (1024, 60)])
def test_against_brute_force(spark, block, percent):
    rows = corpus(block, 150, block == 3) + [(1000 + i, t) for i, t in odd.TEXTS if i is not None] + [(None, "a b c d e f"), (None, None), (3000, "Same Few"), (3001, "same few")]
    assert found(spark, rows, block=block, percent=percent) == brute(rows, percent)


def test_empty_and_bad_settings(spark):
    assert found(spark, []) == []
    with pytest.raises(ValueError, match="percent"):
        g.Settings(percent=30)


def test_hashes_follow_the_words():
    assert len(g.shingles("a b c d e f")) == 2
    assert g.shingles("A  b\tc d e\x0bf").tolist() == g.shingles("a b c d e f").tolist()
    assert len(g.shingles("é b c d e")) == 1 and g.shingles("É b c d e").tolist() != g.shingles("é b c d e").tolist()
    assert len(g.shingles("x y")) == 1 and len(g.shingles(" ")) == len(g.shingles(None)) == 0
    assert len(g.shingles(odd.LONG)) == 10


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(7, 7), (None, 3)]
    out = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect())
    part = {i: i for e in edges for i in e if i is not None}
    for _ in range(100):
        for a, b in edges:
            if a is not None and b is not None:
                part[a] = part[b] = min(part[a], part[b])
    linked = {i for a, b in edges if a is not None and a != b for i in (a, b)}
    assert out == {i: part[i] for i in linked}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
