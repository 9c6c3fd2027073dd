"""Alignment of two tokenisers' tokens, and how often their ids go together over the corpus.

Both tokenise the whole text. Byte offsets at which tokens of both end cut a document into groups; within a group each
token of the one is linked with each of the other. Anchors are shared ends before a token that begins with a space, in
both; they cut a document into windows (mostly words), so the alignment of a window depends on its ids alone and is
remembered by them. The count of an id pair is the number of documents that hold it linked.

A task works off its documents in chunks of bounded length. A chunk leaves its documents with their distinct pairs,
and, once, the chunk's distinct pairs with the number of documents that hold each: counts come from the latter, and the
counts that a chunk's documents need are sent to the chunk once, not once a document.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import written

#: Characters that are aligned at once, and those whose documents share a chunk; bounds on memory only.
AT_ONCE, CHUNK = 1 << 21, 1 << 22
#: Bytes of ids, links and text of the windows that a task remembers, about; then all are forgotten.
REMEMBERED = 112 << 20
#: What Python needs for an entry besides.
ENTRY = 300
#: Links of a group from which on equal ids are counted first.
MANY = 1 << 16


#: White space besides the space and the line feed.
RARE_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
MARK = "\u2581"


@dataclass(frozen=True)
class Vocabulary:
    """A tokeniser of a space and a text. `encode` gives the ids of strings that begin with that space, `tokens` the bytes
    of each id, space marks as spaces. `apart` says that a lone space before a word always begins a token: what stands between
    such spaces can be tokenised each for itself."""

    encode: Callable[[list[str]], list[list[int]]]
    tokens: list[bytes]
    apart: bool
    #: Whether tokens spell any text, as those of a byte-level vocabulary do; else each string is compared with them.
    lossless: bool = False


def lone_spaces_only(text: str) -> bool:
    """Whether each space of the text stands alone between characters that aren't white space, and no other space but line feeds is there."""
    odd = text.startswith((" ", "\n")) or text.endswith(" ") or "  " in text or " \n" in text or "\n " in text or MARK in text
    return not odd and not any(c in text for c in RARE_SPACES)


def byte_level(ranks_path: str, pattern: str) -> Vocabulary:
    """A byte-level BPE vocabulary, given as ranks; reads a space and the text. No special tokens: their strings are plain text.

    Pre-tokens begin at lone spaces and merges never cross them, so what stands between is a unit.
    """
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    ordinary = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Vocabulary(lambda spelt: list(map(ordinary, spelt)), tokens, apart=True, lossless=all(bytes([i]) in ranks for i in range(256)))  # its pattern begins a pre-token at each lone space


def pieces(model_path: str) -> Vocabulary:
    """A SentencePiece model; it puts the space before the text itself. Words are apart if no piece goes on past a space mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace(MARK, " ").encode() for i, name in enumerate(names)]
    apart = not any(MARK in name.lstrip(MARK) for name in names)
    return Vocabulary(lambda spelt: model.encode([s[1:] for s in spelt], num_threads=1), tokens, apart)


class _Ids:
    """What is looked up by id: lengths, whether the token begins with a space, digits."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.size = vocabulary, len(vocabulary.tokens)
        self.lengths = np.array([len(t) for t in vocabulary.tokens], dtype=np.int64)
        self.marked = np.array([t.startswith(b" ") for t in vocabulary.tokens])
        self.digits = [str(i) for i in range(self.size)]

    def encode(self, spelt: list[str], exact: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all strings in a row, their number in each, and whether they spell it."""
        ids = self.vocabulary.encode(spelt)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
        if self.vocabulary.lossless:
            return flat, n, np.ones(len(ids), bool)
        name = self.vocabulary.tokens.__getitem__
        return flat, n, np.fromiter((b"".join(map(name, x)) == e for x, e in zip(ids, exact)), bool, len(ids))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indexes of the ranges that begin at `starts`, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)


def _before(sizes: np.ndarray) -> np.ndarray:
    """Where each of some adjoining ranges begins."""
    return np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


class Aligner:
    """Aligns documents, some at a time, and remembers windows."""

    def __init__(self, first: Vocabulary, second: Vocabulary):
        self._a, self._b = _Ids(first), _Ids(second)
        self.stride = self._b.size
        # one value beyond all ids parts the two tuples of a window
        self._kind = np.uint16 if max(self._a.size, self._b.size) < 0xFFFF else np.uint32
        self._part = int(np.iinfo(self._kind).max)
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._texts: list[str] = []
        self._begin, self._size, self._links = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._pairs, self._times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._held = 0

    def align(self, texts: list[str | None]) -> list[tuple]:
        """n_a, n_b, n_groups, n_links, groups (as text), and distinct pairs (a x stride + b) with their numbers of links; a tuple per text.

        A text that is null or empty, or that either's tokens don't spell with a space before it, has no tokens.
        """
        nothing = np.zeros(0, np.int64)
        unit, n_units, (ids_a, per_a), (ids_b, per_b) = self._encoded([t or "" for t in texts])
        if not len(unit):
            return [(0, 0, 0, 0, "", nothing, nothing)] * len(texts)
        whose = np.repeat(np.arange(len(texts)), n_units)
        n_a, n_b = (np.bincount(whose, per[unit], len(texts)).astype(np.int64) for per in (per_a, per_b))
        a, b = (ids[_ranges(_before(per)[unit], per[unit])] for ids, per in ((ids_a, per_a), (ids_b, per_b)))
        # documents one after another: both spell the same bytes, so a document's end is shared
        ends_a, ends_b = np.cumsum(self._a.lengths[a]), np.cumsum(self._b.lengths[b])
        seen = np.zeros(int(ends_a[-1]) + 1, np.uint8)
        seen[ends_a] = 1
        seen[ends_b] |= 2
        last_a, last_b = np.flatnonzero(seen[ends_a] == 3), np.flatnonzero(seen[ends_b] == 3)  # the last tokens of each group
        closes = np.zeros(len(a), bool)
        closes[np.cumsum(n_a)[n_a > 0] - 1] = True
        spaced = np.append(self._a.marked[a], True)[last_a + 1] & np.append(self._b.marked[b], True)[last_b + 1]
        anchor = np.flatnonzero(spaced | closes[last_a])
        stop_a, stop_b, stop_g = last_a[anchor] + 1, last_b[anchor] + 1, anchor + 1
        begin_a, begin_b, begin_g = (np.concatenate([[0], s[:-1]]) for s in (stop_a, stop_b, stop_g))
        # windows that are one unit each are looked up once a unit, as the same unit has the same ids
        unit_a, unit_b = np.cumsum(per_a[unit]), np.cumsum(per_b[unit])
        at = np.searchsorted(unit_a, stop_a)
        one = (unit_a[at] == stop_a) & (unit_b[at] == stop_b) & (unit_a[at] - per_a[unit[at]] == begin_a) & (unit_b[at] - per_b[unit[at]] == begin_b)
        first = np.full(len(per_a), -1)
        singles = np.flatnonzero(one)[::-1]
        first[unit[at[singles]]] = singles
        asked = np.arange(len(stop_a))
        asked[singles] = first[unit[at[singles]]]
        wanted = np.unique(asked)
        found = self._windows(a, b, begin_a, stop_a, begin_b, stop_b, begin_g, stop_g, last_a + 1, last_b + 1, wanted)
        ids = found[np.searchsorted(wanted, asked)]
        # documents' windows
        stops = np.concatenate([[0], np.cumsum(n_a)])
        cut = np.searchsorted(begin_a, stops)
        doc = np.repeat(np.arange(len(texts)), np.diff(cut))
        groups = np.diff(np.concatenate([[0], np.cumsum(stop_g - begin_g)])[cut])
        links = np.diff(np.concatenate([[0], np.cumsum(self._links[ids])])[cut])
        key, n = np.unique(doc * len(self._texts) + ids, return_counts=True)
        d, w = np.divmod(key, len(self._texts))
        sizes = self._size[w]
        at = _ranges(self._begin[w], sizes)
        order = np.repeat(d, sizes) * (self._a.size * self.stride) + self._pairs[at]
        rank = np.argsort(order, kind="stable")
        order, times = order[rank], (self._times[at] * np.repeat(n, sizes))[rank]
        new = np.flatnonzero(np.diff(order, prepend=-1))
        pair_doc, pair = np.divmod(order[new], self._a.size * self.stride)
        total = np.add.reduceat(times, new) if len(new) else nothing
        bounds = np.searchsorted(pair_doc, np.arange(len(texts) + 1))
        names, cuts, ids = self._texts, cut.tolist(), ids.tolist()
        out = []
        for i, (x, y, g, k) in enumerate(zip(n_a.tolist(), n_b.tolist(), groups.tolist(), links.tolist(), strict=True)):
            part = slice(bounds[i], bounds[i + 1])
            out.append((x, y, g, k, ";".join(map(names.__getitem__, ids[cuts[i] : cuts[i + 1]])), pair[part], total[part]))
        if self._held > REMEMBERED:
            self._forget()
        return out

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The texts as units: unit numbers in a row, how many each text has, and both tokenisers' ids of the units with
        their number in each. A unit is what stands between lone spaces, or a whole text where that can't be
        tokenised apart; each different one is tokenised once. Texts that aren't spelt have no units."""
        number: dict[str | tuple[str], int] = defaultdict(count().__next__)
        apart = self._a.vocabulary.apart and self._b.vocabulary.apart
        parts = [[] if not t else t.split(" ") if apart and lone_spaces_only(t) else [(t,)] for t in texts]
        n_units = np.fromiter(map(len, parts), np.int64, len(parts))
        unit = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64, int(n_units.sum()))
        spelt = [" " + (u if isinstance(u, str) else u[0]) for u in number]
        exact = [x.encode("utf-8", "surrogatepass") for x in spelt]
        (ids_a, per_a, right_a), (ids_b, per_b, right_b) = self._a.encode(spelt, exact), self._b.encode(spelt, exact)
        wrong = np.bincount(np.repeat(np.arange(len(texts)), n_units), ~(right_a & right_b)[unit], len(texts)) > 0
        return unit[np.repeat(~wrong, n_units)], np.where(wrong, 0, n_units), (ids_a, per_a), (ids_b, per_b)

    def _windows(self, a, b, begin_a, stop_a, begin_b, stop_b, begin_g, stop_g, group_a, group_b, wanted) -> np.ndarray:  # noqa: ANN001
        """The number in the memory of each wanted window; windows that aren't there are aligned and go in."""
        size_a, size_b = (stop_a - begin_a)[wanted], (stop_b - begin_b)[wanted]
        from_a, from_b = _before(size_a), _before(size_b)
        n = np.arange(len(wanted))
        ids = np.empty(int(size_a.sum() + size_b.sum()) + len(n), self._kind)
        ids[np.arange(size_a.sum()) + np.repeat(from_b + n, size_a)] = a[_ranges(begin_a[wanted], size_a)]
        ids[from_a + size_a + from_b + n] = self._part
        ids[np.arange(size_b.sum()) + np.repeat(from_a + size_a + n + 1, size_b)] = b[_ranges(begin_b[wanted], size_b)]
        width = ids.itemsize
        data = ids.tobytes()
        starts = (from_a + from_b + n) * width
        known = self._known
        keys = [data[s:e] for s, e in zip(starts.tolist(), (starts + (size_a + size_b + 1) * width).tolist())]
        found = list(map(known.get, keys))
        fresh: dict[bytes, int] = {}
        for i, at in zip(wanted.tolist(), range(len(found))):
            if found[at] is None:
                fresh.setdefault(keys[at], i)
        if fresh:
            self._remember(list(fresh), np.fromiter(fresh.values(), np.int64, len(fresh)), a, b, begin_g, stop_g, group_a, group_b)
            found = list(map(known.__getitem__, keys))
        return np.array(found, dtype=np.int64)

    def _remember(self, keys, at, a, b, begin_g, stop_g, group_a, group_b) -> None:  # noqa: ANN001
        """Align the windows numbered `at` from their groups."""
        n_groups = stop_g[at] - begin_g[at]
        g = _ranges(begin_g[at], n_groups)
        from_a, from_b = np.concatenate([[0], group_a[:-1]])[g], np.concatenate([[0], group_b[:-1]])[g]
        size_a, size_b = group_a[g] - from_a, group_b[g] - from_b
        window = np.repeat(np.arange(len(at)), n_groups)
        many = size_a * size_b >= MANY
        few = ~many
        per = (size_a * size_b)[few]
        k = _ranges(np.zeros(len(per), np.int64), per)
        left = a[np.repeat(from_a[few], per) + k // np.repeat(size_b[few], per)]
        right = b[np.repeat(from_b[few], per) + k % np.repeat(size_b[few], per)]
        whose, pair, times = [np.repeat(window[few], per)], [left * self.stride + right], [np.ones(len(left), np.int64)]
        for i in np.flatnonzero(many):  # of a group as large as that, distinct ids with their numbers
            (x, m), (y, n) = (np.unique(ids[s : s + size], return_counts=True) for ids, s, size in ((a, from_a[i], size_a[i]), (b, from_b[i], size_b[i])))
            whose.append(np.full(len(x) * len(y), window[i]))
            pair.append((x[:, None] * self.stride + y).ravel())
            times.append((m[:, None] * n).ravel())
        whose, pair, times = (np.concatenate(x) for x in (whose, pair, times))
        rank = np.argsort(whose, kind="stable")
        sizes = np.bincount(whose, minlength=len(at))
        links = np.zeros(len(at), np.int64)
        np.add.at(links, window, size_a * size_b)
        begin = len(self._pairs) + _before(sizes)
        base = len(self._texts)
        self._begin, self._size, self._links = np.append(self._begin, begin), np.append(self._size, sizes), np.append(self._links, links)
        self._pairs, self._times = np.append(self._pairs, pair[rank]), np.append(self._times, times[rank])
        digits_a, digits_b = self._a.digits, self._b.digits
        names_a, names_b = list(map(digits_a.__getitem__, a[_ranges(from_a, size_a)].tolist())), list(map(digits_b.__getitem__, b[_ranges(from_b, size_b)].tolist()))
        texts, i, j = [], 0, 0
        for m, n in zip(size_a.tolist(), size_b.tolist()):
            texts.append(f"{names_a[i] if m == 1 else ','.join(names_a[i : i + m])}|{names_b[j] if n == 1 else ','.join(names_b[j : j + n])}")
            i, j = i + m, j + n
        i = 0
        for n in n_groups.tolist():
            self._texts.append(texts[i] if n == 1 else ";".join(texts[i : i + n]))
            i += n
        self._known.update(zip(keys, range(base, base + len(keys))))
        self._held += sum(map(len, keys)) + sum(map(len, self._texts[base:])) + 16 * len(pair) + ENTRY * len(keys)


# -- over the corpus ---------------------------------------------------------------------------------------


def align_documents(docs: DataFrame, first: Callable[[], Vocabulary], second: Callable[[], Vocabulary], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: chunk, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links; and a row per chunk
    with `held` and `n_docs`, the chunk's distinct pairs and how many of its documents hold each. No shuffle.

    `first` and `second` are called in the tasks. The result must be written before it is used twice: chunks are
    numbered by task.
    """
    names = ("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links", "held", "n_docs")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    schema = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>, held array<long>, n_docs array<long>"

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(first(), second())
        chunk, read, held = TaskContext.get().partitionId() << 32, 0, []

        def close() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return table([(chunk, None, None, None, None, None, None, None, None, pair, n)])

        for batch in batches:
            ids, texts = (batch.column(i).to_pylist() for i in range(2))
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and size < AT_ONCE:
                    size += len(texts[end] or "") + 1
                    end += 1
                rows = []
                for doc, (n_a, n_b, n_groups, n_links, groups, pairs, links) in zip(ids[begin:end], aligner.align(texts[begin:end])):
                    digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                    rows.append((chunk, doc, n_a, n_b, n_groups, n_links, digest, pairs, links, None, None))
                    held.append(pairs)
                yield table(rows)
                begin, read = end, read + size
                if read >= CHUNK:
                    yield close()
                    chunk, read, held = chunk + 1, 0, []
        if held:
            yield close()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, stride: int) -> DataFrame:
    """pair (first id x stride + second), n (documents that hold it), best: whether no other pair of the first id has a greater n."""
    held = aligned.where("held IS NOT NULL").select(F.inline(F.arrays_zip("held", "n_docs")))
    counted = held.groupBy(F.col("held").alias("pair")).agg(F.sum("n_docs").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.expr(f"pair DIV {stride}")))  # an id has at most `stride` pairs
    return counted.select("pair", "n", (F.col("n") == most).alias("best"))


def link_scores(docs: DataFrame, first: Callable[[], Vocabulary], second: Callable[[], Vocabulary], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per input row.

    n_best counts links whose pair is the best of its first id over the
    corpus, count_sum adds up the counts of all links. Each row counts as a document, repeated ones too. Texts that are
    null or empty, or that a tokeniser doesn't spell as they are, have zeros and an empty digest.
    """
    aligned = written(align_documents(docs, first, second, id_col, text_col), "alignment")
    counts = written(pair_counts(aligned, len(second().tokens)), "alignment-counts")
    wanted = aligned.where("held IS NOT NULL").select(F.col("chunk").alias("part"), F.explode("held").alias("pair"))
    told = wanted.join(counts, "pair").select("part", "pair", "n", "best")
    rows = aligned.where("held IS NULL").drop("held", "n_docs")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def add_up(found: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("pair")
        known, n, best = (told[c].to_numpy() for c in ("pair", "n", "best"))
        sizes = found["pairs"].map(len).to_numpy()
        pairs, links = (np.concatenate([np.zeros(0, np.int64), *found[c]]) for c in ("pairs", "links"))
        at = np.searchsorted(known, pairs)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        total = lambda values: np.diff(np.concatenate([[0], np.cumsum(links * values[at])])[upto]) if len(pairs) else 0
        return found[["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].assign(n_best=total(best.astype(np.int64)), count_sum=total(n))[[c.split()[0] for c in schema.split(", ")]]

    # a chunk has a bounded number of characters, and each of its pairs comes once
    return rows.groupBy("chunk").cogroup(told.groupBy("part")).applyInPandas(add_up, schema)
