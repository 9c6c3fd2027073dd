"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector o, rotated at random, is stored as the signs of its D coordinates and the correction factor
f = <o', o>, o' being the signs over sqrt(D). For a rotated unit vector q, <o', q> / f is an unbiased estimate of
<o, q>, and its error is below eps * sqrt((1 - f^2) / f^2 / (D - 1)) but for a probability that falls with
exp(-c eps^2). Pairs whose upper bound is below the threshold are settled; the others are recomputed in double
precision. Which vectors are paired at all is decided by sign bits of further rotations: vectors that agree on all
bits of one of several tables; the number of tables follows from the chance of a miss that is allowed.

Only sketches go to every table: the signs after this and, for vectors of few dimensions, further rotations, as the
fewer bits there are the more pairs stay open by chance. Two sketches differ in a share angle / pi of their bits, so
pairs that differ in more than the threshold's share and eps standard deviations are settled there. Vectors, factors
and keys are fetched for those alone that still have a partner in a bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import written
from gaugeworks.llm.components import connected_components


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    #: The width of the confidence bound.
    eps: float = 5.0
    #: The chance that a pair just at the threshold shares no table is at most this.
    miss: float = 1e-6
    #: Table bits are chosen so that buckets hold about so many vectors; larger ones are cut into blocks of `block`.
    bucket: int = 1024
    block: int = 2048
    #: A sketch has the signs of as many rotations as give so many bits.
    sketch_bits: int = 192
    seed: int = 11

    def bits(self, n: int) -> int:
        return max(0, math.ceil(math.log2(max(1, n) / self.bucket)))

    def tables(self, bits: int) -> int:
        agree = (1 - math.acos(self.threshold) / math.pi) ** bits
        return 1 if agree >= 1 else math.ceil(math.log(self.miss) / math.log(1 - agree))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([seed & 0xFFFFFFFF, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(units: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes as rows of packed bits, and correction factors."""
    turned = units @ rotation(units.shape[1], seed).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(units.shape[1])


def estimates(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray, eps: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded vectors (rows) and unit queries (columns); error bounds by row."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (queries @ rotation(dim, seed).T).astype(np.float32)
    scale = (math.sqrt(dim) * factors).astype(np.float32)
    bound = eps * np.sqrt(np.maximum(0, 1 - factors**2)) / factors / math.sqrt(max(1, dim - 1))
    return signs @ turned.T / scale[:, None], bound


def sketch(units: np.ndarray, settings: Settings) -> np.ndarray:
    """Signs after several rotations, each rotation's in whole bytes; more than one where the dimensions are few."""
    turns = -(-settings.sketch_bits // units.shape[1])
    return np.concatenate([np.packbits(units @ rotation(units.shape[1], settings.seed - 1 - k).T > 0, axis=1) for k in range(turns)], axis=1)


def most_bits(dim: int, settings: Settings) -> float:
    """So many bits of two sketches may differ at the threshold."""
    bits, share = dim * -(-settings.sketch_bits // dim), math.acos(settings.threshold) / math.pi
    return bits * share + settings.eps * math.sqrt(bits * share * (1 - share))


def _units(vectors: list[np.ndarray]) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that no square overflows or vanishes."""
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(vectors: DataFrame, settings: Settings, bits: int, tables: int, kind: str) -> DataFrame:
    """Adds the code, the factor, the sketch and the keys of all tables. Vectors of other dimensions never share a key."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for dim, part in batch.groupby(batch["embedding"].map(len)):
                units = _units(part["embedding"].to_list())
                codes, factors = encode(units, settings.seed)
                need = bits * tables
                planes = [rotation(dim, settings.seed + 1 + i) for i in range(-(-need // dim))]
                sides = np.concatenate([units @ p.T > 0 for p in planes], axis=1)[:, :need] if need else np.zeros((len(part), 0), bool)
                keys = sides.reshape(len(part), tables, bits) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros((len(part), tables), np.int64)
                yield part.assign(code=[c.tobytes() for c in codes], factor=factors, sketch=[c.tobytes() for c in sketch(units, settings)], dim=dim, keys=list(keys))

    return vectors.mapInPandas(run, f"node long, copies long, embedding {kind}, code binary, factor double, sketch binary, dim int, keys array<long>")


#: Rows of a tile that are compared with all others at once; a bound on memory only.
AT_ONCE = 256
TILE = "dim int, table int, key long, i long, j long"


def _sides(key: tuple, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a tile's two blocks; for a block with itself both are the same."""
    return np.flatnonzero(block == key[3]), np.flatnonzero(block == key[4])


def _near(key: tuple, rows: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """The nodes of a tile whose sketch has another near enough."""
    codes = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(len(rows), -1)
    codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)
    left, right = _sides(key, rows["block"].to_numpy())
    most = most_bits(key[0], settings)
    near = np.zeros(len(rows), dtype=bool)
    for at in range(0, len(left), AT_ONCE):
        part = left[at : at + AT_ONCE]
        differ = np.zeros((len(part), len(right)), dtype=np.uint16)
        for word in range(codes.shape[1]):
            differ += np.bitwise_count(codes[part, word][:, None] ^ codes[right, word][None, :])
        close = (differ <= most) & (part[:, None] != right[None, :])
        near[part] |= close.any(axis=1)
        near[right] |= close.any(axis=0)
    return rows.loc[near, ["dim", "table", "key", "i", "j", "node", "block"]]


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`label`, the least member of each one's group, after the links between i and j."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]


def _compared(key: tuple, rows: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """Of one tile: n_links by node, and an edge from each linked node to the least node of its links here."""
    table = int(key[1])
    units = _units(rows["embedding"].to_list())
    node, copies, factors = rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["factor"].to_numpy()
    codes = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
    keys = np.stack(rows["keys"].to_list())
    left, right = _sides(key, rows["block"].to_numpy())
    counts = np.zeros(len(rows), dtype=np.int64)
    label = np.arange(len(rows))
    for at in range(0, len(left), AT_ONCE):
        part = left[at : at + AT_ONCE]
        guess, bound = estimates(codes[part], factors[part], units[right], settings.eps, settings.seed)
        open_ = guess + bound[:, None] >= settings.threshold
        if key[3] == key[4]:
            open_ &= part[:, None] < right[None, :]
        i, j = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        # exact values of the rows and columns that have an open pair
        linked = open_[np.ix_(i, j)] & (units[part[i]] @ units[right[j]].T >= settings.threshold)
        a, b = np.nonzero(linked)
        i, j = part[i[a]], right[j[b]]
        if table:  # counted in the first table that they share
            shared = np.zeros(len(i), dtype=bool)
            for t in range(table):
                shared |= keys[i, t] == keys[j, t]
            i, j = i[~shared], j[~shared]
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        label = joined(label, i, j)
    linked = counts > 0
    return pd.DataFrame({"node": node[linked], "n": counts[linked], "other": node[label[linked]]})


def link_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per input row.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, as do vectors of
    different dimensions and rows without an id (whose component is null and which are kept). Rows with the same
    id and vector are one vector. Equal vectors stand for each other: they are compared once and counted as often
    as there are ids. Vectors keep their precision; cosines are taken in double precision. A bucket of any size is cut
    into blocks, and each two blocks are one group of a bounded number of rows; only counts and one edge per vector
    leave it, never pairs.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    base = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast(kind).alias("embedding"))
    values = F.col("embedding")
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce((F.size(values) > 0) & ~bad & F.exists(values, lambda v: v != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    # equal vectors have equal digests of 128 bits (0.0 and -0.0 are equal); vectors themselves are no shuffle's key
    plain = F.transform(values, lambda v: v + F.lit(0).cast(kind[6:-1]))
    base = base.select("vec_id", "embedding", *[F.when(usable, F.xxhash64(F.lit(i), plain)).alias(f"h{i}") for i in (1, 2)])
    ids = base.where("h1 IS NOT NULL").select("vec_id", "h1", "h2")
    classes = ids.distinct().groupBy("h1", "h2").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    bits = settings.bits(classes.count())
    # a vector of each class, from any row that has its least id
    one = base.where("h1 IS NOT NULL").join(classes.withColumnRenamed("least_id", "vec_id"), ["vec_id", "h1", "h2"])
    one = one.groupBy("vec_id", "h1", "h2").agg(F.first(F.struct("node", "copies", "embedding")).alias("c")).select("c.*")
    coded = written(_coded(one, settings, bits, settings.tables(bits), kind), "vector-codes")
    rows = coded.select("node", "dim", "sketch", F.posexplode("keys").alias("table", "key"))
    large = rows.groupBy("dim", "table", "key").agg(F.count("*").alias("c")).where(F.col("c") > settings.block)
    large = written(large.select("dim", "table", "key", F.ceil(F.col("c") / settings.block).alias("blocks")), "vector-large")
    rows = rows.join(large, ["dim", "table", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    tile = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(F.least(b, "block").alias("i"), F.greatest(b, "block").alias("j"))))
    tiles = rows.withColumn("tile", tile).select("node", "sketch", "dim", "table", "key", "block", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"))
    near = tiles.groupBy("dim", "table", "key", "i", "j").applyInPandas(lambda key, pdf: _near(key, pdf, settings), f"{TILE}, node long, block long")
    near = written(near, "vector-near").join(coded.select("node", "copies", "embedding", "code", "factor", "keys"), "node")
    found = near.groupBy("dim", "table", "key", "i", "j").applyInPandas(lambda key, pdf: _compared(key, pdf, settings), "node long, n long, other long")
    found = written(found, "vector-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("links"))
    parts = connected_components(found, "node", "other")
    named = classes.join(counts, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = written(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "vector-names")
    named = named.join(smallest, "component").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = base.select("vec_id", "h1", "h2").join(written(named, "vector-named"), ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
