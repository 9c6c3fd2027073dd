"""Whitening of embeddings by leading components that a Jacobi-Davidson solver finds, without a covariance matrix.

The covariance V is only ever applied: V T = sum (x - mean) ((x - mean) . T) / n, one Spark job for all columns of a
narrow block T, summed in tasks and then over them. A search space is built up: Rayleigh-Ritz within it gives
candidates; for each candidate that hasn't converged a correction equation, projected away from the candidates, is
solved roughly by MINRES, all of them side by side, so that an inner step is one job too. Candidates whose residual
is down to rounding are locked, and the search goes on in the space orthogonal to them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import summed, sums_batch, written

Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Settings:
    """`components` wanted, `guard` more in the search so that none is missed; `scale` of the integers that are whitened."""

    components: int = 4
    guard: int = 4
    scale: int = 256
    #: Of the residual against the largest eigenvalue: a few roundings of a double.
    tolerance: float = 1e-14
    #: Inner steps per correction, and directions that the search space may have before it is restarted.
    inner_steps: int = 6
    most_directions: int = 48
    max_rounds: int = 200
    seed: int = 7


@dataclass(frozen=True)
class Whitening:
    """Sums of `n` distinct vectors of `dims` entries, and the leading components: rows of `vectors`, with `values`."""

    n: int
    dims: int
    sums: tuple[int, ...]
    trace: float
    values: tuple[float, ...]
    vectors: tuple[tuple[float, ...], ...]
    identity_error: float = 0.0


# -- the fit list ------------------------------------------------------------------------------------------


def integers(embeddings: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, x: the vectors without null or non-finite entries, as floor(scale * entry). Entries past a long are its limit.

    Of vectors of several lengths those of the commonest count (of equally common ones the longest); vectors without
    entries never do.
    """
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rows = embeddings.select(embeddings[id_col].alias("id"), embeddings[vector_col].cast("array<double>").alias("e"))
    rows = rows.where(F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", fine))
    return rows.select("id", F.transform("e", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def fit_list(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Each distinct x once, as a written table, and its length. A vector crosses the shuffle once a task at most."""
    common = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()  # a row per length
    dims = common["d"] if common else 0
    return written(vectors.where(F.size("x") == dims).select("x").distinct(), "whitening-fit"), dims


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def moments(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n, and the exact sums by dimension. Entries are added up in parts of 24 bits, so that no sum of fewer than 2^39 passes a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, dims), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dims)
                total += np.stack([np.full(dims, len(x)), (x >> 48).sum(0), (x >> 24 & 0xFFFFFF).sum(0), (x & 0xFFFFFF).sum(0)])
        yield sums_batch(total)

    if not dims:
        return 0, []
    n, high, mid, low = summed(fit.mapInArrow(run, "s array<long>"), fit.rdd.getNumPartitions(), (4, dims)).tolist()
    return n[0], [(h << 48) + (m << 24) + k for h, m, k in zip(high, mid, low)]


def spread(fit: DataFrame, n: int, mean: np.ndarray) -> float:
    """The trace of the covariance."""
    dims = len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims)
        for batch in batches:
            if batch.num_rows:
                total += ((_matrix(batch.column(0), dims) - mean) ** 2).sum(0)
        yield sums_batch(total)

    return float(summed(fit.mapInArrow(run, "s array<double>"), fit.rdd.getNumPartitions(), (dims,)).sum() / n)


def centred_product(fit: DataFrame, n: int, mean: np.ndarray) -> Product:
    """T -> V T, for a block of as many rows as there are dimensions; the block goes out with the job."""
    dims, n_tasks = len(mean), fit.rdd.getNumPartitions()

    def product(block: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(block.shape)
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0), dims) - mean
                    total += x.T @ (x @ block)
            yield sums_batch(total)

        return summed(fit.mapInArrow(run, "s array<double>"), n_tasks, block.shape) / n

    return product


# -- Jacobi-Davidson ---------------------------------------------------------------------------------------


def _away(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The part of each column that is orthogonal to the basis; twice, so that rounding leaves nothing of it."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def _directions(block: np.ndarray, basis: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """Orthonormal columns that add to the basis what the block has besides it."""
    kept = basis
    for column in block.T:
        size = np.linalg.norm(column)
        if size > 0:
            column = _away((column / size)[:, None], kept)
            left = np.linalg.norm(column)
            if left > least:
                column = _away(column / left, kept)
                kept = np.hstack([kept, column / np.linalg.norm(column)])
    return kept[:, basis.shape[1] :]


def minres(product: Product, shifts: np.ndarray, sides: np.ndarray, project: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    """Each column t with (V - shift) t nearly its side, all within the projected space: `steps` joint applications of V.

    Lanczos vectors of each column are kept; the small least-squares problems are solved at the end.
    """
    q = project(sides)
    norms = np.linalg.norm(q, axis=0)
    lanczos = [q / np.where(norms > 0, norms, 1.0)]
    alphas, betas = [], []
    for k in range(steps):
        w = project(product(lanczos[-1]) - shifts * lanczos[-1])
        alphas.append((w * lanczos[-1]).sum(0))
        for v in lanczos:  # against all, as rounding would let old directions come back
            w = w - v * (w * v).sum(0)
        beta = np.linalg.norm(w, axis=0)
        betas.append(beta)
        if k + 1 < steps:
            lanczos.append(w / np.where(beta > 0, beta, 1.0))
    out = np.zeros(sides.shape)
    for j in range(sides.shape[1]):
        small = np.zeros((steps + 1, steps))
        for k in range(steps):
            small[k, k], small[k + 1, k] = alphas[k][j], betas[k][j]
            if k + 1 < steps:
                small[k, k + 1] = betas[k][j]
        right = np.zeros(steps + 1)
        right[0] = norms[j]
        y = np.linalg.lstsq(small, right, rcond=None)[0]
        out[:, j] = sum(y[k] * lanczos[k][:, j] for k in range(steps))
    return project(out)


def jacobi_davidson(product: Product, dims: int, trace: float, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of V, falling, and their eigenvectors as columns, each with a residual of rounding size.

    Eigenvalues that are nothing but rounding beside the trace are left out, so there may be fewer than wanted.
    """
    wanted = min(settings.components, dims)
    width = min(dims, wanted + settings.guard)
    if trace <= 0 or wanted == 0:
        return np.zeros(0), np.zeros((dims, 0))
    rng = np.random.default_rng(settings.seed)
    locked, values = np.zeros((dims, 0)), []
    space = _directions(rng.standard_normal((dims, width)), locked)
    image = product(space)
    for _ in range(settings.max_rounds):
        ritz, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        turn = turn[:, ::-1]
        ritz, vectors, images = ritz[::-1], space @ turn, image @ turn
        top = min(wanted - len(values) + settings.guard, len(ritz))
        residuals = _away(images[:, :top] - vectors[:, :top] * ritz[:top], locked)
        sizes = np.linalg.norm(residuals, axis=0)
        limit = settings.tolerance * max([*values, float(ritz[0])], default=0.0)
        # what is locked is the largest left: a candidate after one that hasn't converged may be the wrong one
        done = 0
        while done < top and len(values) + done < wanted and sizes[done] <= limit:
            done += 1
        values += [float(v) for v in ritz[:done]]
        locked = np.hstack([locked, vectors[:, :done]])
        full = locked.shape[1] + space.shape[1] - done >= dims
        if len(values) == wanted or (full and done == space.shape[1]):
            break
        space, image, ritz, residuals, sizes = vectors[:, done:], images[:, done:], ritz[done:], residuals[:, done:], sizes[done:]
        if space.shape[1] > settings.most_directions:  # the best candidates carry on
            space, image = space[:, : 2 * width], image[:, : 2 * width]
        open_ = [j for j in range(residuals.shape[1]) if sizes[j] > limit][:width]
        chosen = [j for j in open_ if j < wanted - len(values)] or open_[:1]
        if not open_:
            continue
        near = np.hstack([locked, space[:, : residuals.shape[1]]])
        steps = min(settings.inner_steps, max(1, dims - near.shape[1]))
        if full:
            new = np.zeros((dims, 0))
        else:
            corrections = minres(product, ritz[chosen], -residuals[:, chosen], lambda b: _away(b, near), steps)
            # the residual itself goes along: it is what is left when a correction is all rounding
            new = _directions(np.hstack([corrections, residuals[:, chosen]]), np.hstack([locked, space]))
        if new.shape[1] == 0:  # nothing but rounding is left to correct: the space holds these vectors as well as doubles can
            take = wanted - len(values)
            values += [float(v) for v in ritz[:take]]
            locked = np.hstack([locked, space[:, :take]])
            break
        # all images are taken afresh, in the same job as the new ones: else rounding of many turns would add up
        space = np.hstack([space, new])
        image = product(space)
    else:
        raise RuntimeError(f"components: not done after {settings.max_rounds} rounds")
    order = np.argsort(values)[::-1]
    found, vectors = np.array(values)[order], locked[:, order]
    real = found > 1e-12 * trace
    return found[real], vectors[:, real]


# -- use ---------------------------------------------------------------------------------------------------


def fit(vectors: DataFrame, settings: Settings = Settings()) -> Whitening:
    """Components of the distinct vectors of `vectors` (id, x)."""
    rows, dims = fit_list(vectors)
    n, sums = moments(rows, dims)
    if n == 0:
        return Whitening(0, dims, (), 0.0, (), ())
    mean = np.array([s / n for s in sums])
    trace = spread(rows, n, mean)
    values, components = jacobi_davidson(centred_product(rows, n, mean), dims, trace, settings)
    model = Whitening(n, dims, tuple(sums), trace, tuple(values.tolist()), tuple(map(tuple, components.T.tolist())))
    return Whitening(n, dims, model.sums, trace, model.values, model.vectors, identity_error(rows, model))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity; 0 without components."""
    k = len(model.values)
    if k == 0:
        return 0.0
    project = _projection(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = project(_matrix(batch.column(0), model.dims))
                total, products = total + w.sum(0), products + w.T @ w
        yield sums_batch(np.concatenate([total, products.ravel()]))

    flat = summed(rows.mapInArrow(run, "s array<double>"), rows.rdd.getNumPartitions(), (k + k * k,)) / model.n
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())


def _projection(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    mean = np.array([s / model.n for s in model.sums])
    turn = np.array(model.vectors).T / np.sqrt(np.array(model.values))
    return lambda x: (x - mean) @ turn


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum over dimensions of (n x - sum) squared, exact; None where it is beyond a long."""
    reach = n * max(1, int(np.abs(x.astype(np.float64)).max(initial=0.0)) + 1) + max(map(abs, sums), default=0)
    if reach**2 * len(sums) < 2**62:
        y = n * x - np.array(sums, dtype=np.int64)
        return (y * y).sum(1).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist())
    return [v if v < 2**63 else None for v in exact]


OUT_SCHEMA = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """A row per vector (id, x) and component, numbered from 1. No shuffle; the model has a few numbers a dimension.

    Vectors of another length than the model's have no row; without components there is no row at all.
    """
    k = len(model.values)
    rows = vectors.where(F.size("x") == model.dims).select(F.col("id").cast("long").alias("id"), "x")
    if k == 0:
        return rows.limit(0).selectExpr("id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    project = _projection(model)
    explained = np.array(model.values) / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if m:
                x = _matrix(batch.column(1), model.dims)
                deviation = pa.array(deviations(x, model.n, model.sums), pa.int64())
                each = np.repeat(np.arange(m), k)
                columns = [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, dtype=np.int64)),
                    deviation.take(pa.array(each)),
                    pa.array(project(x).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in OUT_SCHEMA.split(", ")])

    return rows.mapInArrow(run, OUT_SCHEMA)


def whiten_embeddings(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error of every vector that can be whitened.

    Null vectors and those with null or non-finite entries have no row. Repeated rows have each their own rows, but
    count once in the fit list. Directions without any spread have no component.
    """
    vectors = integers(embeddings, id_col, vector_col, settings.scale)
    return whiten(vectors, fit(vectors, settings))
