"""Quality by Bradley-Terry ranking: document scores learned from preference pairs, cut at a quantile.

A document's score is linear in features of its whole text, and the chance that one document is preferred to another
is the logistic function of the difference of their scores. Labelled documents give pairs (a good one, a bad one);
Newton steps minimise the logistic loss on the pairs' feature differences, each step one Spark job that sums gradients
and curvatures. The threshold is a quantile of the labelled documents' scores: the share of bad ones. What is
returned is the chance that a document is preferred to one that stands right at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import summed, sums_batch, written

#: Kinds of characters, by UTF-8 byte; bytes above ASCII count as letters.
KINDS = ("lower", "upper", "digit", "space", "newline", "stop", "quote", "dash", "bracket", "bar", "bang", "hash", "symbol", "control", "high", "lead")
_STOPS, _QUOTES, _DASHES, _BRACKETS, _BARS, _BANGS, _HASHES = ".,;:", "'\"`", "-_", "()[]{}<>", "|/\\", "!?", "#"
N_KINDS = len(KINDS)
#: Features besides the pairs of neighbouring kinds.
N_PLAIN = 12
N_FEATURES = N_PLAIN + N_KINDS * N_KINDS


def _kind(byte: int) -> str:
    c = chr(byte)
    if byte >= 0xC0:
        return "lead"
    if byte >= 0x80:
        return "high"
    if c == "\n":
        return "newline"
    if c.isspace():
        return "space"
    if byte < 0x20 or byte == 0x7F:
        return "control"
    if c.isalpha():
        return "lower" if c.islower() else "upper"
    if c.isdigit():
        return "digit"
    for name, chars in (("stop", _STOPS), ("quote", _QUOTES), ("dash", _DASHES), ("bracket", _BRACKETS), ("bar", _BARS), ("bang", _BANGS), ("hash", _HASHES)):
        if c in chars:
            return name
    return "symbol"


_KIND_OF = np.array([KINDS.index(_kind(b)) for b in range(256)], dtype=np.uint8)
_INDEX = {k: i for i, k in enumerate(KINDS)}


@dataclass(frozen=True)
class Settings:
    """All labelled documents are learned from, in at most `rivals` pairs a document on average. Everything that is
    scored is scored whole."""

    #: Bad documents that each good one is compared with, and good ones that each bad one is.
    rivals: int = 2
    ridge: float = 1e-3
    max_steps: int = 25
    tolerance: float = 1e-6


@dataclass(frozen=True)
class Model:
    """Weights of the standardised features, and the score at which good begins."""

    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float


def features(text: str | None) -> np.ndarray:
    """Of the whole text: sizes, shares of repeated, capital and marked words, of repeated lines, and how often each
    kind of character follows each. A null or empty text has zeros."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    kinds = _KIND_OF[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    follows = np.bincount(kinds[:-1].astype(np.int64) * N_KINDS + kinds[1:], minlength=N_KINDS * N_KINDS)
    out[N_PLAIN:] = np.sqrt(follows / max(1, len(kinds) - 1))
    share = np.bincount(kinds, minlength=N_KINDS) / len(kinds)
    words, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    letters = share[_INDEX["lower"]] + share[_INDEX["upper"]] + share[_INDEX["high"]] + share[_INDEX["lead"]]
    repeats = sum(map(eq, words, words[1:]))
    out[:N_PLAIN] = (
        math.log1p(len(text)),
        math.log1p(len(words)),
        math.log1p(len(text) / n),
        letters,
        math.sqrt(share[_INDEX["upper"]]),
        math.sqrt(share[_INDEX["digit"]]),
        math.sqrt(share[_INDEX["symbol"]] + share[_INDEX["hash"]] + share[_INDEX["bang"]]),
        math.sqrt(share[_INDEX["bar"]]),
        math.log1p(len(set(words))) - math.log1p(len(words)),
        math.sqrt(repeats / n),
        len(set(lines)) / m if lines else 0.0,
        math.log1p(n / m),
    )
    return out


def _standardised(raw: np.ndarray, model: Model) -> np.ndarray:
    return (raw - np.array(model.mean)) / np.array(model.spread)


def raw_scores(texts: list[str | None], model: Model) -> np.ndarray:
    """Bradley-Terry scores, not yet set against the threshold."""
    if not texts:
        return np.zeros(0)
    return _standardised(np.array([features(t) for t in texts]), model) @ np.array(model.weights)


# -- learning ----------------------------------------------------------------------------------------------


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, good (0 or 1) and f (the features) of all labelled documents.

    A label that is null or belongs to no id is left out; of an id's labels the largest counts, of its texts the
    least.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("good"))
    ids = known.groupBy("id").agg(F.max("good").alias("good"))
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(ids, "id")
    one = texts.groupBy("id").agg(F.max("good").alias("good"), F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "good": batch["good"], "f": [features(t).astype(np.float32) for t in batch["text"]]})

    return one.select(F.col("id").cast("string").alias("id"), "good", "text").mapInPandas(run, "id string, good int, f array<float>")


def _numbered(rows: DataFrame) -> DataFrame:
    """good, f and k: the place among the documents of the label, from 0, by the hash of the id.

    Hashes are cut into 2^12 ranges: a range of a label is numbered by itself, after the sizes of those before it.
    """
    hashed = rows.withColumn("h", F.xxhash64("id")).withColumn("range", F.shiftright("h", 52))
    sizes = hashed.groupBy("good", "range").agg(F.count("*").alias("c"))  # 2^13 rows at most
    before = Window.partitionBy("good").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("good", "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("good", "range").orderBy("h", "id")) - 1
    return hashed.withColumn("place", place).join(F.broadcast(starts), ["good", "range"]).select("good", "f", (F.col("start") + F.col("place")).alias("k"))


def preference_pairs(rows: DataFrame, rivals: int) -> DataFrame:
    """x: the features of a good document less those of a bad one; each document is in `rivals` pairs at least.

    Documents of a label are numbered in hashed order and the k-th is paired with the rivals k x rivals and following of
    the other label, around and around: an equi-join on numbers.
    """
    ranked = written(_numbered(rows), "quality-numbered")
    sizes = ranked.groupBy().agg(F.count_if(F.col("good") == 1).alias("n_good"), F.count_if(F.col("good") == 0).alias("n_bad"))
    ranked = ranked.crossJoin(F.broadcast(sizes)).where("n_good > 0 AND n_bad > 0")  # a row
    others = F.when(F.col("good") == 1, F.col("n_bad")).otherwise(F.col("n_good"))
    rival = F.explode(F.transform(F.sequence(F.lit(0), F.lit(rivals - 1)), lambda j: (F.col("k") * rivals + j) % others)).alias("rival")
    chosen = ranked.select("good", "k", rival)
    pairs = chosen.select(F.when(F.col("good") == 1, F.col("k")).otherwise(F.col("rival")).alias("g"), F.when(F.col("good") == 1, F.col("rival")).otherwise(F.col("k")).alias("b")).distinct()
    better = ranked.where("good = 1").select(F.col("k").alias("g"), F.col("f").alias("better"))
    worse = ranked.where("good = 0").select(F.col("k").alias("b"), F.col("f").alias("worse"))
    return pairs.join(better, "g").join(worse, "b").select(F.zip_with("better", "worse", lambda x, y: x - y).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _loss_sums(pairs: DataFrame, weights: np.ndarray, spread: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of sum log(1 + exp(-w . x)), x in units of `spread`, summed in tasks and then over them."""
    d = len(weights)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, gradient, curvature = 0.0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)) / spread
                margin = x @ weights
                miss = np.exp(-np.logaddexp(0.0, margin))  # 1 / (1 + e^margin)
                loss += float(np.logaddexp(0.0, -margin).sum())
                gradient -= x.T @ miss
                curvature += (x * (miss * (1 - miss))[:, None]).T @ x
        yield sums_batch(np.concatenate([[loss], gradient, curvature[upper]]))

    flat = summed(pairs.mapInArrow(run, "s array<double>"), pairs.rdd.getNumPartitions(), (1 + d + len(upper[0]),))
    curvature = np.zeros((d, d))
    curvature[upper] = flat[1 + d :]
    return float(flat[0]), flat[1 : 1 + d], curvature + np.triu(curvature, 1).T


def _standards(rows: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """How many, how many of them good, and each feature's mean and spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * N_FEATURES)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)).astype(float)
                total += np.concatenate([[len(x), sum(batch.column(1).to_pylist())], x.sum(0), (x * x).sum(0)])
        yield sums_batch(total)

    flat = summed(rows.select("f", "good").mapInArrow(run, "s array<double>"), rows.rdd.getNumPartitions(), (2 + 2 * N_FEATURES,))
    n = max(1.0, flat[0])
    mean = flat[2 : 2 + N_FEATURES] / n
    spread = np.sqrt(np.maximum(flat[2 + N_FEATURES :] / n - mean**2, 0.0))
    return int(flat[0]), int(flat[1]), mean, np.maximum(spread, 0.01)  # a kind that is hardly ever there says little


def _newton(pairs: DataFrame, spread: np.ndarray, n_pairs: int, settings: Settings) -> np.ndarray:
    """The minimum of the mean loss plus a ridge; a step that doesn't lower it is halved."""
    ridge = settings.ridge
    weights = np.zeros(len(spread))
    value, step = math.inf, np.zeros(len(spread))
    for _ in range(settings.max_steps):
        loss, gradient, curvature = _loss_sums(pairs, weights + step, spread)
        at = weights + step
        new = loss / n_pairs + ridge / 2 * float(at @ at)
        if new > value:
            step = step / 2
            continue
        done = value - new < settings.tolerance * max(1.0, new)
        weights, value = at, new
        if done:
            break
        step = -np.linalg.solve(curvature / n_pairs + ridge * np.eye(len(at)), gradient / n_pairs + ridge * at)
    return weights


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings()) -> Model:
    """Learn from the labelled documents; labels above 0 are good.

    With documents of one label only there is no pair: all weights are 0, and every text gets the smoothed share of
    good labels as its score (0.5 without labels).
    """
    rows = written(labelled_features(docs, labels, id_col, text_col, label_col), "quality-features")
    n, n_good, mean, spread = _standards(rows)
    if not 0 < n_good < n:
        rate = (n_good + 0.5) / (n + 1)
        return Model(tuple(mean.tolist()), tuple(spread.tolist()), (0.0,) * N_FEATURES, -math.log(rate / (1 - rate)))
    pairs = written(preference_pairs(rows, settings.rivals), "quality-pairs")
    weights = _newton(pairs, spread, pairs.count(), settings)
    model = Model(tuple(mean.tolist()), tuple(spread.tolist()), tuple(weights.tolist()), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_standardised(_matrix(batch.column(0)), model) @ weights)], ["score"])

    scores = written(rows.select("f").mapInArrow(run, "score double"), "quality-learned-scores")
    # the quantile at the share of bad labels: as many labelled documents lie below as are bad
    return Model(model.mean, model.spread, model.weights, sum(_neighbours(scores, n, n - n_good)) / 2)


def _neighbours(scores: DataFrame, n: int, k: int, margin: float = 2e-4) -> tuple[float, float]:
    """The k-th and the k+1-th smallest of n scores, exactly.

    A sketch tells bounds around them; only the different scores between these, a few in 10,000, come to the driver.
    """
    while True:
        ends = [max(0.0, k / n - margin), min(1.0, (k + 1) / n + margin)]
        low, high = scores.agg(F.percentile_approx("score", ends, 20_000).alias("e")).first()["e"] if margin < 1 else (-math.inf, math.inf)
        upto = scores.where(F.col("score") < F.lit(low)).count()
        found: list[float] = []
        if upto < k:
            for r in scores.where(F.col("score").between(F.lit(low), F.lit(high))).groupBy("score").agg(F.count("*").alias("c")).orderBy("score").collect():
                found += [r["score"]] * max(0, min(upto + r["c"], k + 1) - max(upto, k - 1))  # places k - 1 and k
                upto += r["c"]
        if len(found) == 2:
            return found[0], found[1]
        margin *= 10  # the sketch missed


# -- use ---------------------------------------------------------------------------------------------------


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted (score >= 0.5), strength (the Bradley-Terry score less the threshold); a row per input row.

    Null and empty texts are scored by their features, which are zeros. No shuffle; ids are cast to long.
    """
    score = (1 / (1 + F.exp(-F.col("strength")))).alias("score")
    rows = with_strength(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), model, "text", "strength")
    return rows.select("id", score, (F.col("strength") >= 0).cast("int").alias("predicted"), "strength")


def with_strength(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """All rows and columns of `docs`, and the score less the threshold as the column `name`."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            found = pa.array(raw_scores(texts, model) - model.threshold, pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def keep_best(docs: DataFrame, model: Model, quantile: float, text_col: str = "text", rank_error: float = 1e-4) -> DataFrame:
    """The rows of `docs` whose score is at or above the quantile of all scores (0.9 keeps the best tenth), all columns.

    The quantile is a mergeable sketch over all rows (rank error at most `rank_error`), so no task holds the scores.
    Rows that tie with it stay. An empty table stays empty.
    """
    scored = written(with_strength(docs, model, text_col, "__strength"), "quality-scores")
    cut = scored.agg(F.percentile_approx("__strength", float(quantile), round(1 / rank_error)).alias("cut")).first()["cut"]
    return scored.where(F.col("__strength") >= F.lit(cut).cast("double")).drop("__strength")
