from __future__ import annotations

import numpy as np
import pytest

from gaugeworks.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<float>, label int, node long, copies int, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "k") for i, v in rows], SCHEMA)


def brute(rows, threshold=0.95):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(np.array(v, np.float32).tolist())), np.array(v, np.float32).astype(float))
    keys = list(good)
    links = {k: set() for k in keys}
    for a in keys:
        for b in keys:
            x, y = good[a], good[b]
            if a != b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a].add(b)
    parts = {}
    for k in keys:
        seen, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        parts[k] = min(i for i, _ in seen)
    out = []
    for i, v in rows:
        k = (i, tuple(np.array(v, np.float32).tolist())) if v and all(x is not None for x in v) else None
        out.append((i, len(links.get(k, ())), parts.get(k, i), parts.get(k, i) == i))
    return sorted(out, key=str)


def found(spark, rows, **kwargs):
    out = e.link_embeddings(table(spark, rows), settings=e.Settings(**kwargs))
    return sorted((tuple(r) for r in out.collect()), key=str)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    seeds = rng.standard_normal((max(1, n // 4), dim))
    return [(i, [float(x) for x in seeds[rng.integers(len(seeds))] + rng.standard_normal(dim) * rng.choice([0.0, 0.15, 0.3])]) for i in range(n)]


@pytest.mark.parametrize(("bucket", "block"), [(1024, 2048), (16, 8)])
def test_against_brute_force(spark, bucket, block):
    rows = vectors(160, 24, 1) + [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] * 24), (504, [None] + [1.0] * 23), (505, [float("inf")] + [1.0] * 23), (None, [1.0] * 24), (506, [1.0] * 5), (507, [2.0] * 5), (508, [1.0])]
    rows += [(600 + i, rows[0][1]) for i in range(5)] + [rows[0]]
    assert found(spark, rows, bucket=bucket, block=block) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 300, 64)))
    y = 0.8 * x + 0.6 * y
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    errors = []
    for seed in range(5):
        codes, factors = e.encode(x, seed)
        guess, bound = e.estimates(codes, factors, y, 5.0, seed)
        error = guess - x @ y.T
        assert (np.abs(error) <= bound[:, None]).all()
        errors.append(error.mean())
    assert abs(np.mean(errors)) < 0.005


def test_recall_of_the_tables(spark):
    """Pairs just above the threshold, with many bits a table: all are found."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):
        x, z = rng.standard_normal((2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        z /= np.linalg.norm(z)
        rows += [(2 * i, x.tolist()), (2 * i + 1, (0.951 * x + (1 - 0.951**2) ** 0.5 * z).tolist())]
    out = found(spark, rows, bucket=8)
    assert sum(n == 1 for _, n, _, _ in out) == 600


def test_double_precision(spark):
    """Components that single precision can't hold, or can't tell apart."""
    rows = [(1, [1e39, 2e39, 3e39]), (2, [1.0, 2.0, 3.0]), (3, [1e-200, 2e-200, 3e-200]), (4, [1.0, 2.0, 3.0 + 1e-12]), (5, [-1.0, 2.0, 3.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.link_embeddings(docs).collect()}
    assert out == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}


def test_codes_of_similar_vectors_are_near():
    rng = np.random.default_rng(3)
    x, z = rng.standard_normal((2, 4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * z
    a, b = (np.unpackbits(e.sketch(v, e.Settings()), axis=1) for v in (x, y))
    differ = (a != b).sum(axis=1)
    assert differ.max() <= e.most_bits(64, e.Settings())
    assert a.shape[1] == 192 and abs(differ.mean() - 192 * np.arccos(0.95) / np.pi) < 0.5


def test_memory_of_a_tile():
    """4,096 near copies of 768 components in one tile: all pairs are linked, in bounded memory."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(8)
    x = rng.standard_normal(768) + rng.standard_normal((4096, 768)) * 0.02
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    codes, factors = e.encode(units, 11)
    rows = pd.DataFrame({"node": np.arange(4096), "copies": 1, "block": np.repeat([0, 1], 2048), "factor": factors, "dim": 768, "table": 1, "key": 0, "i": 0, "j": 1})
    rows["code"], rows["embedding"], rows["keys"] = [c.tobytes() for c in codes], list(x.astype(np.float32)), [np.array([i, 0]) for i in range(4096)]
    rows["sketch"] = [c.tobytes() for c in e.sketch(units, e.Settings())]
    tracemalloc.start()
    assert len(e._near((768, 1, 0, 0, 1), rows, e.Settings())) == 4096
    out = e._compared((768, 1, 0, 0, 1), rows, e.Settings())
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()
    assert (out["n"] == 2048).all() and len(out) == 4096
    assert (out["other"] == 0).all()


def test_joined_groups():
    rng = np.random.default_rng(1)
    for _ in range(50):
        label, pairs = np.arange(30), []
        for _ in range(4):
            i, j = rng.integers(0, 30, (2, 6))
            pairs += list(zip(i.tolist(), j.tolist()))
            label = e.joined(label, i, j)
        expected = list(range(30))
        for _ in range(30):
            for a, b in pairs:
                expected[a] = expected[b] = min(expected[a], expected[b])
        assert label.tolist() == expected
