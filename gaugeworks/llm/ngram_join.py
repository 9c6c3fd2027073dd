"""N-gram Jaccard join with filters under several global orders of the shingles.

Two sets x and y with Jaccard of at least t differ by at most m(x) = (1-t)|x| of x's shingles, so under any one
order of all shingles the first m + 1 of x and of y have one in common. Three orders are used:

1. by hash. A document keeps its first e(n) = n/4 + 5 shingles (for t = 0.8). Two similar documents share at least
   min(e - m) of them, and the first m + 1 under this order.
2. by (document frequency, hash), within those e(n). If x's e shingles end at or before y's, at most m(x) of
   x's aren't y's, and at most max(1/4, 3/4) (1-t)/t n(y) + 1 <= m(y) + 1 of y's aren't x's; so the first
   m + 2 have one in common. Shingles of one document only come first and match nothing: a document with
   m + 2 of them is out at once, which takes most documents out before anything else is read.
3. by (document frequency, hash reversed), as order 2.

Documents that share an order-2 prefix shingle meet in a family: that of the heaviest document which holds the
shingle. Within a family, pairs must share a prefix shingle under each of the three orders before their whole
sets are compared. Families are cut into blocks, and each two blocks are one group of a bounded number of rows;
only a spanning forest of the links leaves a group, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import documents, written
from gaugeworks.llm.components import connected_components

# Constants of the 64-bit polynomial hash: random but fixed.
_RANDOM = np.random.default_rng(20_240_607)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {"n": 0, "up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}


@dataclass(frozen=True)
class Settings:
    """`percent` is the least Jaccard similarity in hundredths; the bound of order 2 holds from 55 on.

    `block` is how many documents of a family one task holds on each side.
    """

    words: int = 5
    percent: int = 80
    block: int = 1024

    def __post_init__(self) -> None:
        if not 55 <= self.percent <= 100 or self.words < 1:
            raise ValueError("percent must be 55 to 100, words at least 1")

    def slack(self, n: int) -> int:
        """m(n): how many shingles of a set of n a similar set may lack."""
        return n * (100 - self.percent) // 100

    def kept(self, n: int) -> int:
        """e(n): how many shingles a set of n keeps for the candidates."""
        return min(n, n * (105 - self.percent) // 100 + 5)

    def slack_column(self, n: Column) -> Column:
        return F.floor(n * (100 - self.percent) / 100).cast("int")

    def kept_column(self, n: Column) -> Column:
        return F.least(n, F.floor(n * (105 - self.percent) / 100) + 5).cast("int")


# -- shingles ----------------------------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ h >> np.uint64(33)


def _grown(n: int) -> None:
    if _powers["n"] < n:
        n = max(2 * n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
        _powers["n"] = n


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's k-word shingles; A-Z lower-cased, words [^\\x20\\x09-\\x0D]+.

    With fewer words the whole sequence is the one shingle; without words there is none. A shingle's hash is that
    of its words joined by single spaces, read off the prefix sums of a polynomial over the bytes.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers["up"][: len(data)], out=sums[1:])
    gaps = np.flatnonzero(data == 32)
    k = min(k, len(words))
    begin = np.concatenate([[0], gaps + 1])[: len(words) - k + 1]
    end = np.concatenate([gaps, [len(data)]])[k - 1 :]
    return np.unique(_mixed((sums[end] - sums[begin]) * _powers["down"][begin]))


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set."""
    a, b = int(_mixed(hashes).sum(dtype=np.uint64)), int(_mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
    return a - 2**63, b - 2**63


def _kept_shingles(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n, d1, d2, kept. Of copies in one batch only the first has `kept`: so copies are combined before any shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen, rows = set(), []
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = shingles(text, settings.words)
                digest = _digest(found)
                first = len(found) and not pd.isna(key) and digest not in seen
                seen |= {digest} if first else set()
                rows.append((key, len(found), *digest, found[: settings.kept(len(found))].view(np.int64) if first else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "d1", "d2", "kept"]).astype({"doc_id": "Int64"})

    return docs.mapInPandas(run, "doc_id long, n long, d1 long, d2 long, kept array<long>")


def _whole_sets(docs: DataFrame, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(text, settings.words) for text in batch["text"]]
            yield pd.DataFrame([(*_digest(s), s.tobytes()) for s in sets], columns=["d1", "d2", "shingles"])

    return docs.mapInPandas(run, "d1 long, d2 long, shingles binary")


# -- families and links ------------------------------------------------------------------------------------


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets have in common, by products of incidence matrices over blocks of the shared elements."""
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    if not left or not right:
        return counts
    values, rows = [np.concatenate(side) for side in (left, right)], [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    shared = np.intersect1d(*(np.unique(v) for v in values), assume_unique=True)
    places = [np.searchsorted(shared, v) for v in values]
    found = [(p < len(shared)) & (shared[np.minimum(p, len(shared) - 1)] == v) if len(shared) else np.zeros(len(v), bool) for p, v in zip(places, values, strict=True)]
    for at in range(0, len(shared), 4096):
        inside = [f & (p >= at) & (p < at + 4096) for f, p in zip(found, places, strict=True)]
        hits = [np.zeros((len(side), min(4096, len(shared) - at)), dtype=np.float32) for side in (left, right)]
        for hit, row, place, here in zip(hits, rows, places, inside, strict=True):
            hit[row[here], place[here] - at] = 1
        counts += hits[0] @ hits[1].T
    return counts


def _similar(left: pd.DataFrame, right: pd.DataFrame, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the similar pairs: sizes, then the filters of the three orders, then the whole sets."""
    x, y = ([np.frombuffer(s, dtype=np.uint64) for s in side["shingles"]] for side in (left, right))
    n, k = (np.array([len(s) for s in side]) for side in (x, y))
    ok = 100 * np.minimum(n[:, None], k) >= settings.percent * np.maximum(n[:, None], k)
    firsts = [[s[: settings.slack(len(s)) + 1] for s in side] for side in (x, y)]
    for a, b in (firsts, *((left[c].map(np.asarray).to_list(), right[c].map(np.asarray).to_list()) for c in ("second", "third"))):
        if not ok.any():
            break
        ok &= _overlaps(a, b) > 0
    rows, columns = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
    both = np.zeros(ok.shape)
    both[np.ix_(rows, columns)] = _overlaps([x[i] for i in rows], [y[i] for i in columns])
    return np.nonzero(ok & (100 * both >= settings.percent * (n[:, None] + k - both)))


def _forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """For links between positions i and j: an edge from each linked node to the first node of its part."""
    label = np.arange(len(nodes))
    while True:
        low, before = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    linked = label != np.arange(len(nodes))
    return pd.DataFrame({"a": nodes[linked], "b": nodes[label[linked]]})


def _compared(key: tuple, rows: pd.DataFrame, settings: Settings) -> pd.DataFrame:
    """The links between two blocks of a family, or within one."""
    first, second = key[1], key[2]
    if first == second:
        i, j = _similar(rows, rows, settings)
        return _forest(rows["node"].to_numpy(), i[i < j], j[i < j])
    rows = rows.sort_values("block", kind="stable", ignore_index=True)
    cut = int((rows["block"] == first).sum())
    i, j = _similar(rows[:cut], rows[cut:], settings)
    return _forest(rows["node"].to_numpy(), i, j + cut)


def _tiles(family: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links within families, given as pivot, node, block, tiles (an array of the (i, j) that the node goes to)."""
    rows = family.select("pivot", "node", "block", F.explode("tiles").alias("t")).select("pivot", "node", "block", F.col("t.i").alias("i"), F.col("t.j").alias("j"))
    return rows.join(sets, "node").groupBy("pivot", "i", "j").applyInPandas(lambda key, pdf: _compared(key, pdf, settings), "a long, b long")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included): a row per input row.

    Two documents link if 100 |x & y| >= percent |x | y|. Null and empty texts and texts without words have no
    shingle and link with nothing. Rows with one id are one document. A row without an id has n_shingles and a
    null component_id, and links with nothing.

    Sets are hashed with 64 bits a shingle, compared within pairs only. Equal sets are found by 128-bit digests
    and stand for each other from then on, so copies are never expanded into pairs.
    """
    base = documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    kept = written(_kept_shingles(base, settings).withColumn("node", F.monotonically_increasing_id()), "ngram-kept")
    linkable = kept.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(linkable.groupBy("d1", "d2").agg(F.min("node").alias("rep")), "ngram-classes")
    members = linkable.select("d1", "d2", "node", "doc_id").join(classes, ["d1", "d2"]).select("node", "rep", "doc_id", "d1", "d2")
    members = written(members, "ngram-members")

    survivors = written(_survivors(linkable, members, settings), "ngram-survivors")
    texts = base.join(survivors.select("doc_id").distinct(), "doc_id", "left_semi")
    reps = survivors.select("d1", "d2", "node", "second", "third")
    sets = written(_whole_sets(texts, settings).dropDuplicates(["d1", "d2"]).join(reps, ["d1", "d2"]).select("node", "shingles", "second", "third"), "ngram-sets")
    links = _all_links(survivors.select("node", "weight", F.explode("second").alias("h")), sets, settings)
    # copies, and rows that share an id, are linked too
    copies = members.where("node > rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    same_id = members.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("top > b").drop("top")
    repeats = members.join(same_id, "doc_id").where("node > b").select(F.col("node").alias("a"), "b")
    found = connected_components(links.unionByName(copies).unionByName(repeats), "a", "b")
    named = members.select("node", "doc_id").join(found, "node")
    smallest = written(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "ngram-names")
    named = named.join(smallest, "component").select("node", "component_id")
    return kept.select("node", "doc_id", F.col("n").alias("n_shingles")).join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _survivors(linkable: DataFrame, members: DataFrame, settings: Settings) -> DataFrame:
    """One row per distinct set that may have a partner, with its prefixes under orders 2 and 3.

    node, doc_id, d1, d2, second and third (arrays of hashes), weight (how common its shingles are: the source of
    many copies weighs most).
    """
    rows = linkable.where(F.col("kept").isNotNull()).select("node", F.explode("kept").alias("h"))
    common = written(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "ngram-common")
    by_node = rows.join(common, "h").groupBy("node").agg(F.collect_list(F.struct("df", "h")).alias("shared"))  # at most e(n) each
    sizes = linkable.select("node", "n").join(members.where("node = rep").select("node", "doc_id", "d1", "d2"), "node")
    alone = settings.kept_column(F.col("n")) - F.size("shared")  # shingles of this document only
    need = settings.slack_column(F.col("n")) + 2 - alone
    flipped = F.array_sort(F.transform("shared", lambda s: F.struct(s["df"].alias("df"), F.bitwise_not(s["h"]).alias("h"))))
    return (
        by_node.join(sizes, "node")
        .withColumn("need", need)
        .where("need > 0")
        .select(
            "node", "doc_id", "d1", "d2",
            F.transform(F.slice(F.array_sort("shared"), F.lit(1), F.col("need")), lambda s: s["h"]).alias("second"),
            F.transform(F.slice(flipped, F.lit(1), F.col("need")), lambda s: F.bitwise_not(s["h"])).alias("third"),
            F.aggregate("shared", F.lit(0).cast("long"), lambda acc, s: acc + s["df"]).alias("weight"),
        )
    )


def _all_links(index: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) with the components of all links; index: node, weight, h (each prefix shingle).

    A family of more than a block is compared with its pivot first. Those that link to it need no
    comparison among themselves: so a very large group of near copies costs as many comparisons as it has
    members, and only the others of its family are compared with all.
    """
    block = settings.block
    pivots = index.groupBy("h").agg(F.count("*").alias("c"), F.max_by("node", F.struct("weight", -F.col("node"))).alias("pivot")).where("c > 1")
    family = written(index.select("h", "node").join(written(pivots.select("h", "pivot"), "ngram-pivots"), "h").select("pivot", "node").distinct(), "ngram-families")
    sizes = family.groupBy("pivot").agg(F.count("*").alias("c"))
    large = written(sizes.where(F.col("c") > block), "ngram-large")
    one = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    small = family.join(large, "pivot", "left_anti").select("pivot", "node", F.lit(0).cast("long").alias("block"), one.alias("tiles"))
    links = written(_tiles(small, sets, settings), "ngram-links")
    if large.isEmpty():
        return links
    # the pivot is block 0 alone; chunk k of the others is compared with it in tile (0, k)
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / block)) + 1
    others = family.join(large, "pivot").where("node != pivot").withColumn("block", chunk)
    with_pivot = others.select("pivot", "node", "block", F.array(F.struct(F.lit(0).cast("long").alias("i"), F.col("block").alias("j"))).alias("tiles"))
    every = F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("c") / block)), lambda k: F.struct(F.lit(0).cast("long").alias("i"), k.alias("j")))
    alone = large.select("pivot", F.col("pivot").alias("node"), F.lit(0).cast("long").alias("block"), every.alias("tiles"))
    star = written(_tiles(with_pivot.unionByName(alone), sets, settings), "ngram-star")
    labels = connected_components(links.unionByName(star), "a", "b")
    label = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    known = others.join(label("node"), "node", "left").join(label("pivot"), "pivot", "left")
    known = written(known.select("pivot", "node", "c", F.coalesce(F.col("node_part") == F.col("pivot_part"), F.lit(False)).alias("near")), "ngram-known")
    # blocks of the far ones are even, of the near ones odd; two near blocks have nothing to find
    counts = known.groupBy("pivot").agg(F.count_if("near").alias("n1"), F.count_if(~F.col("near")).alias("n0"))
    rest = known.join(written(counts.where("n0 > 0"), "ngram-rest"), "pivot")
    blocks = lambda n: F.ceil(F.col(n) / block)
    own = F.when(F.col("near"), F.pmod(F.xxhash64("node"), F.greatest(blocks("n1"), F.lit(1))) * 2 + 1).otherwise(F.pmod(F.xxhash64("node"), blocks("n0")) * 2)
    rest = rest.withColumn("block", own)
    numbers = lambda n, odd: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), blocks(n)), lambda k: k < blocks(n)), lambda k: k * 2 + odd)
    partners = F.when(F.col("near"), numbers("n0", 0)).otherwise(F.concat(numbers("n0", 0), numbers("n1", 1)))
    tiles = F.transform(partners, lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    return links.unionByName(star).unionByName(written(_tiles(rest.withColumn("tiles", tiles), sets, settings), "ngram-links"))
