"""SentencePiece BPE encoding with seeded merge-dropout, and its lossless decoding.

Merges are taken from an agenda, best score first and leftmost first, as the model does. When a candidate comes
up, it is skipped if a keyed hash of the seed, the document and the candidate's place in it (where its left part
begins, where the right one begins, where that ends) says so; a skipped candidate is gone. So each candidate of each
occurrence draws for itself, the same on every machine and in every retry, and nothing is remembered.

A text is cut where no piece of the vocabulary has the two neighbouring characters side by side: no merge can cross
such a place. The agendas of all runs between cuts are worked off at once, in columns of arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

MARK = "▁"
#: Runs of at most so many characters share arrays; a longer one has a heap as its agenda. Results are the same.
LONGEST = 62
#: The upper ends of the lengths of runs that share arrays.
LENGTHS = (3, 4, 5, 6, 8, 10, 12, 16, 24, 40, LONGEST)
#: Runs in one set of arrays, and characters worked on at once (or one document); bounds on memory only.
COLUMNS, CHARACTERS = 1 << 14, 1 << 19
NONE = np.int32(2**31 - 1)
PLACE_BITS = 7


@dataclass(frozen=True)
class Settings:
    """`dropout` is the chance that a candidate merge is skipped; 0 gives the model's own segmentation."""

    dropout: float = 0.1
    seed: int = 0


# -- the keyed hash ----------------------------------------------------------------------------------------

_A, _B, _C, _D, _E = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9))


def document_key(doc_id: int | None, seed: int) -> int:
    """A document's part of the key; a null id counts as 0."""
    return xxhash.xxh64_intdigest(b"%d" % (doc_id or 0), seed)


def draws(key: np.ndarray, start: np.ndarray, split: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32 bits for each candidate; it is skipped if they are below dropout times 2**32."""
    x = (key ^ (start.astype(np.uint64) * _A + split.astype(np.uint64) * _B + end.astype(np.uint64) * _C)) * _D
    return ((x ^ x >> np.uint64(29)) * _E) >> np.uint64(32)


# -- the vocabulary ----------------------------------------------------------------------------------------


class Pairs:
    """From two ids to the id of their merge: hash tables, each for what found its slot taken in those before."""

    def __init__(self, pairs: dict[tuple[int, int], int], none: int):
        self._none = none
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        values = np.array(list(pairs.values()), dtype=np.int32)
        self._bits = max(8, len(keys).bit_length() + 1)
        self._levels: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        while len(keys):
            factor = _A ^ np.uint64(2 * len(self._levels))
            slots = self._slots(keys, factor)
            held, made = np.full(1 << self._bits, -1, dtype=np.int64), np.full(1 << self._bits, none, dtype=np.int32)
            held[slots], made[slots] = keys, values
            self._levels.append((factor, held, made))
            left = held[slots] != keys
            keys, values = keys[left], values[left]

    def _slots(self, keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (keys.view(np.uint64) * factor >> np.uint64(64 - self._bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merges' ids; `none` where the two don't merge."""
        keys = left.astype(np.int64) << 32 | right
        out = np.full(keys.shape, self._none, dtype=np.int32)
        for factor, held, made in self._levels:
            slots = self._slots(keys, factor)
            np.copyto(out, made[slots], where=held[slots] == keys)
        return out


class Codec:
    """Encoding and decoding under one model."""

    def __init__(self, model_path: str, settings: Settings):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self._size = n = model.get_piece_size()
        self._bytes = np.zeros(256, dtype=np.int32)
        ids: dict[str, int] = {}
        texts = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self._bytes[int(piece[3:5], 16)] = i
                texts[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                ids[piece] = i
                texts[i] = piece.replace(MARK, " ").encode()
        self._texts = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self._lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self._begins = np.cumsum(self._lengths) - self._lengths
        long = [p for p in ids if len(p) > 1]
        # ids from the model's size on are characters without a piece of their own; the last one stands for all that never merge
        numbers = ids | {c: n + k for k, c in enumerate(sorted({c for p in long for c in p} - ids.keys()))}
        self._other = n + sum(i >= n for i in numbers.values())
        self._char_ids = np.full(0x110000, self._other, dtype=np.int32)
        for c, i in numbers.items():
            if len(c) == 1:
                self._char_ids[ord(c)] = i
        self._mark_id = int(self._char_ids[ord(MARK)])
        # equal scores merge from the left, so they share a rank
        scores = {ids[p]: -model.get_score(ids[p]) for p in long}
        rank = {s: k for k, s in enumerate(sorted(set(scores.values())))}
        self._agenda_keys = np.full(self._other + 1, NONE, dtype=np.int32)
        for i, s in scores.items():
            self._agenda_keys[i] = rank[s] << PLACE_BITS
        self._ranks = {i: rank[s] for i, s in scores.items()}
        self._made = {(numbers[p[:k]], numbers[p[k:]]): ids[p] for p in long for k in range(1, len(p)) if p[:k] in numbers and p[k:] in numbers}
        self._pairs = Pairs(self._made, self._other)
        # which characters stand side by side in a piece
        classes = {c: k + 1 for k, c in enumerate(sorted({c for p in long for c in p}))}
        self._classes = np.zeros(0x110000, dtype=np.int16)
        for c, k in classes.items():
            self._classes[ord(c)] = k
        self._mark_class = classes.get(MARK, 0)
        self._joined = np.zeros((len(classes) + 1, len(classes) + 1), dtype=bool)
        for p in long:
            for a, b in zip(p, p[1:]):
                self._joined[classes[a], classes[b]] = True
        self._limit = np.uint64(int(settings.dropout * 2**32))
        self._settings = settings

    # -- encoding

    def encode(self, text: str, doc_id: int | None = 0) -> np.ndarray:
        """The ids of one text."""
        return self.encode_all([text], [doc_id])[0]

    def encode_all(self, texts: list[str], doc_ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each text has.

        As the model does, a space mark is put in front of a text that isn't empty. A mark that is in the text
        itself becomes bytes, so that it isn't decoded as a space.
        """
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        whole = "".join([f" {t}" for t in texts if t])
        points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        if not len(points):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        spaces, marks = points == 32, points == ord(MARK)
        ids, classes = self._char_ids[points], self._classes[points]
        ids[marks], classes[marks] = self._other, 0
        ids[spaces], classes[spaces] = self._mark_id, self._mark_class
        cut = np.ones(len(points), dtype=bool)
        cut[1:] = ~self._joined[classes[:-1], classes[1:]]
        first = (np.cumsum(sizes) - sizes)[sizes > 0]  # of each document
        cut[first] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=len(points))
        several = lengths > 1
        starts, lengths = starts[several], lengths[several]
        owner = np.searchsorted(first, starts, side="right") - 1
        keys = np.array([document_key(i, self._settings.seed) for i, n in zip(doc_ids, sizes, strict=True) if n], dtype=np.uint64)
        below = 1
        for length in LENGTHS:
            here = np.flatnonzero((lengths > below) & (lengths <= length))
            for at in range(0, len(here), COLUMNS):
                some = here[at : at + COLUMNS]
                self._merge(ids, starts[some], lengths[some], keys[owner[some]], starts[some] - first[owner[some]])
            below = length
        for k in np.flatnonzero(lengths > below).tolist():
            self._merge_long(ids, int(starts[k]), int(lengths[k]), keys[owner[k]], int(starts[k] - first[owner[k]]))
        return self._collected(ids, points, sizes)

    def _merge(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray, offsets: np.ndarray) -> None:
        """Merges in place: each run's agenda is a column; a part's id stands where it begins, -1 in what it swallowed.

        Rows 0 and longest + 1 (and all after a run's end) hold the id that never merges, so borders need no care.
        """
        longest = int(lengths.max())
        m = len(starts)
        row = np.arange(longest + 2, dtype=np.int32)[:, None]
        place = starts[None, :] + (row - 1)
        inside = (row >= 1) & (row <= lengths[None, :])
        part = np.where(inside, ids[np.minimum(place, len(ids) - 1)], self._other).astype(np.int32)
        after, before = np.repeat(row + 1, m, axis=1), np.repeat(row - 1, m, axis=1)
        made = np.full_like(part, self._other)
        made[:-1] = self._pairs.get(part[:-1], part[1:])
        agenda = self._agenda_keys[made] | row  # NONE stays NONE
        while True:
            best = agenda.min(axis=0)
            live = np.flatnonzero(best != NONE)
            if 2 * len(live) <= m:  # set down what is done and go on with the rest
                done = np.flatnonzero(best == NONE)
                self._set_down(ids, part, starts, lengths, done)
                if not len(live):
                    return
                part, after, before, made, agenda = (np.ascontiguousarray(x[:, live]) for x in (part, after, before, made, agenda))
                starts, lengths, keys, offsets, best, m = starts[live], lengths[live], keys[live], offsets[live], best[live], len(live)
                live = np.arange(m)
            at = best[live] & ((1 << PLACE_BITS) - 1)
            left = at * m + live
            split = after.ravel()[left]
            right = split * m + live
            end = after.ravel()[right]
            base = offsets[live] - 1
            kept = draws(keys[live], base + at, base + split, base + end) >= self._limit
            agenda.ravel()[left[~kept]] = NONE
            at, left, right, end, live = at[kept], left[kept], right[kept], end[kept], live[kept]
            whole = made.ravel()[left]
            part.ravel()[left], part.ravel()[right] = whole, -1
            agenda.ravel()[right] = NONE
            after.ravel()[left] = end
            follower = end * m + live
            before.ravel()[follower] = at
            made.ravel()[left] = new = self._pairs.get(whole, part.ravel()[follower])
            agenda.ravel()[left] = self._agenda_keys[new] | at
            prior = before.ravel()[left]
            leader = prior * m + live
            made.ravel()[leader] = new = self._pairs.get(part.ravel()[leader], whole)
            agenda.ravel()[leader] = self._agenda_keys[new] | prior

    @staticmethod
    def _set_down(ids: np.ndarray, part: np.ndarray, starts: np.ndarray, lengths: np.ndarray, columns: np.ndarray) -> None:
        rows = np.arange(part.shape[0] - 2)[:, None]
        inside = rows < lengths[columns][None, :]
        ids[(starts[columns][None, :] + rows)[inside]] = part[1:-1][:, columns][inside]

    def _merge_long(self, ids: np.ndarray, start: int, length: int, key: np.uint64, offset: int) -> None:
        """The same for a run of any length, in n log n: candidates that have gone stale are passed over."""
        part = ids[start : start + length].tolist()
        after, before, ends = list(range(1, length + 1)), list(range(-1, length - 1)), list(range(1, length + 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def come_up(i: int, j: int) -> None:
            if (made := self._made.get((part[i], part[j]))) is not None:
                agenda.append((self._ranks[made], i, j, ends[j], made))

        def skipped(i: int, j: int, end: int) -> bool:
            return bool(draws(np.array([key]), *(np.array([offset + x]) for x in (i, j, end)))[0] < self._limit)

        for i in range(length - 1):
            come_up(i, i + 1)
        heapify(agenda)
        while agenda:
            _, i, j, end, made = heappop(agenda)
            if part[i] < 0 or part[j] < 0 or after[i] != j or ends[j] != end or skipped(i, j, end):
                continue
            part[i], part[j], ends[i] = made, -1, end
            k = after[i] = after[j]
            found: list[tuple[int, int]] = []
            if k < length:
                before[k] = i
                found.append((i, k))
            if before[i] >= 0:
                found.append((before[i], i))
            for a, b in found:
                if (new := self._made.get((part[a], part[b]))) is not None:
                    heappush(agenda, (self._ranks[new], a, b, ends[b], new))
        ids[start : start + length] = part

    def _collected(self, ids: np.ndarray, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids in turn, and how many each document has; a character without a piece becomes its bytes."""
        counts = (ids >= 0).astype(np.int64)
        loose = np.flatnonzero(ids >= self._size)
        p = points[loose].astype(np.int64)
        counts[loose] = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), dtype=np.int32)
        pieces = np.flatnonzero((ids >= 0) & (ids < self._size))
        out[ends[pieces] - 1] = ids[pieces]
        for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            here = counts[loose] == n
            q, at = p[here], ends[loose[here]] - n
            for k in range(n):
                bits = q >> 6 * (n - 1 - k)
                out[at + k] = self._bytes[bits | lead if k == 0 else bits & 0x3F | 0x80]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return out, np.diff(upto)

    # -- decoding

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts in one array, and how many each has: the pieces' bytes in turn, without the mark put in front."""
        sizes = self._lengths[ids]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        data = self._texts[np.repeat(self._begins[ids] - upto[:-1], sizes) + np.arange(upto[-1])]
        ends = upto[np.cumsum(counts)]
        begins = np.concatenate([[0], ends[:-1]])
        marked = begins[ends > begins]
        marked = marked[data[marked] == 32]
        lost = np.zeros(len(data) + 1, dtype=np.int64)
        lost[marked] = 1
        kept = data[lost[:-1] == 0]
        return kept, ends - begins - np.isin(begins, marked) * (ends > begins)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of one document."""
        return self.decode_all(np.asarray(ids, dtype=np.int64), np.array([len(ids)]))[0].tobytes().decode(errors="replace")

    def lossless(self, texts: list[str], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each text whether its ids decode to it, every byte of it."""
        data, sizes = self.decode_all(ids, counts)
        wanted = [t.encode() for t in texts]
        ends = np.cumsum(sizes)
        same_size = sizes == np.array([len(w) for w in wanted], dtype=np.int64)
        if not same_size.all():
            return np.array([data[e - n : e].tobytes() == w for e, n, w in zip(ends, sizes, wanted, strict=True)], dtype=bool)
        wrong = np.concatenate([[0], np.cumsum(data != np.frombuffer(b"".join(wanted), dtype=np.uint8))])
        return wrong[ends] == wrong[ends - sizes]


@lru_cache(maxsize=2)
def codec(model_path: str, settings: Settings) -> Codec:
    """One per Python worker."""
    return Codec(model_path, settings)


def _chunks(texts: list[str]) -> Iterator[slice]:
    """Slices of about CHARACTERS characters, or of one text."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHARACTERS:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("lossless", pa.bool_())])


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, ids, n_ids, lossless (whether the ids decode to the text): a row per input row.

    A null or empty text has no ids. A null id counts as 0 in the keyed hash. Rows with one id and one text get
    the same ids. Whole texts are encoded; ids must be numbers or cast to such. There is no shuffle, and a task holds
    one Arrow batch and the arrays of about CHARACTERS characters or of its longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = codec(model_path, settings)
        for batch in batches:
            for part in _chunks([t or "" for t in batch.column(1).to_pylist()]):
                rows = batch.slice(part.start, part.stop - part.start)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                ids, counts = mine.encode_all(texts, rows.column(0).to_pylist())
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
                yield pa.RecordBatch.from_arrays([rows.column(0), lists, pa.array(counts), pa.array(mine.lossless(texts, ids, counts))], schema=ENCODED)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_ids long, lossless boolean")


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text. Null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = codec(model_path, Settings())
        for batch in batches:
            texts = [None if i is None else mine.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
