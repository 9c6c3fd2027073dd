"""Hierarchical multi-length packing of tokenised documents.

Full windows of the longest context size are cut off each document. What remains is routed to the tier (a
context size) that it just fits, each tier is packed, gaps of long windows are filled from shorter tiers,
and each tier's windows are dealt to step groups of as many tokens and nearly the same attention cost.

A task packs its Arrow batches one by one and hands on what doesn't fill a window, in the end less than one window;
the remainders of all tasks are packed again, many tasks' at a time. Windows are numbered over the whole corpus,
tier by tier, so that step groups are full wherever a batch or a task ends.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import written

TIERS = (128, 256, 512, 1024)
#: Tokens of a step group.
STEP_TOKENS = 8 * 1024
#: Bytes of units and ids that each of a task's two memories holds, and the longest unit in them; bounds on memory only.
REMEMBERED, LONGEST = 48 << 20, 64
#: What Python needs for an entry besides its characters and ids.
ENTRY = 200
#: Tasks whose remainders are packed together: each has less than a window.
TOGETHER = 256

#: White space besides the space and the line feed.
RARE_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")

PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@dataclass(frozen=True)
class Piece:
    """Ids start to start + length of the `doc`-th of the texts (or parts of texts) that are packed."""

    length: int
    doc: int
    start: int


# -- tokens ------------------------------------------------------------------------------------------------


class UnitIds(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of `lead` and a unit. When REMEMBERED is reached, all are forgotten."""

    def __init__(self, encode: Callable[[str], list[int]], lead: str):
        super().__init__()
        self._encode, self._lead, self._held = encode, lead, 0

    def __missing__(self, unit: str) -> bytes:
        found = array("I", self._encode(self._lead + unit))
        ids = found.tobytes() if sys.byteorder == "little" else np.array(found, dtype="<u4").tobytes()
        if len(unit) <= LONGEST:
            self._held += 4 * len(unit) + len(ids) + ENTRY
            if self._held > REMEMBERED:
                self.clear()
                self._held = 0
            self[unit] = ids
        return ids


def units(text: str) -> list[str]:
    """The text cut at each single space that has no white space beside it; the space is left out.

    The pattern of byte-level BPE begins a pre-token at each such space and merges never cross pre-tokens,
    so the ids of a text are those of its first unit and of each other unit with a space before it.
    """
    if "  " in text or " \n" in text or "\n " in text or any(c in text for c in RARE_SPACES):
        return LONE_SPACE.split(text)
    return text.split(" ")


def tokeniser(json_path: str, ranks_path: str, pattern: str) -> Callable[[str], bytes]:
    """The ids of `json_path` (tokenizers), computed with the same vocabulary as ranks (tiktoken), which is faster.

    Texts repeat their units, so most are looked up. A text that holds a special token's string goes to the
    tokenizers library as a whole.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    ordinary = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    first, rest = UnitIds(ordinary, ""), UnitIds(ordinary, " ")
    exact = Tokenizer.from_file(json_path)
    special = [t.content for t in exact.get_added_tokens_decoder().values()]

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        head, *tail = units(text)
        return first[head] + b"".join(map(rest.__getitem__, tail))

    return encode


# -- packing -----------------------------------------------------------------------------------------------


class Shelf:
    """Pieces by length, the shortest first."""

    def __init__(self, pieces: list[Piece]):
        self._held = sorted(pieces, key=self._key)

    @staticmethod
    def _key(p: Piece) -> tuple[int, int, int]:
        return p.length, p.doc, p.start

    def __len__(self) -> int:
        return len(self._held)

    def add(self, piece: Piece) -> None:
        insort(self._held, piece, key=self._key)

    def longest(self) -> Piece:
        return self._held.pop()

    def best_fit(self, room: int) -> Piece | None:
        """The longest piece of at most `room` tokens, or none."""
        i = bisect_right(self._held, room, key=lambda p: p.length)
        return self._held.pop(i - 1) if i else None

    def shortest_over(self, room: int) -> Piece | None:
        i = bisect_left(self._held, room + 1, key=lambda p: p.length)
        return self._held.pop(i) if i < len(self._held) else None


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[list[Piece]], list[Piece]]:
    """Windows of pieces, and the pieces that are left over; they hold each token of each text once.

    Each window is exactly as long as a tier; the pieces left over are shorter than one together. Whole remainders
    are preferred as filling; the last gap of a window is filled by cutting the shortest piece that is too long
    for it. `tiers` are ascending powers of two.
    """
    top = tiers[-1]
    windows: list[list[Piece]] = []
    remainders: list[Piece] = []
    for doc, n in enumerate(lengths):
        full = n - n % top
        windows += [[Piece(top, doc, start)] for start in range(0, full, top)]
        if n % top:
            remainders.append(Piece(n % top, doc, full))
    shelf = Shelf(remainders)
    while len(shelf):
        window = [shelf.longest()]
        size = next(t for t in tiers if t >= window[0].length)
        room = size - window[0].length
        while room and len(shelf):
            piece = shelf.best_fit(room)
            if piece is None:
                piece = shelf.shortest_over(room)
                shelf.add(Piece(piece.length - room, piece.doc, piece.start + room))
                piece = Piece(room, piece.doc, piece.start)
            window.append(piece)
            room -= piece.length
        if room:
            return windows, window
        windows.append(window)
    return windows, []


def powers_of_two(window: list[Piece]) -> list[list[Piece]]:
    """The very last pieces, which nothing is left to fill: cut into windows of the powers of two of their length."""
    total = sum(p.length for p in window)
    out: list[list[Piece]] = []
    queue = window[::-1]
    for size in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
        part: list[Piece] = []
        while size:
            p = queue.pop()
            take = min(size, p.length)
            part.append(Piece(take, p.doc, p.start))
            if take < p.length:
                queue.append(Piece(p.length - take, p.doc, p.start + take))
            size -= take
        out.append(part)
    return out


def in_step_order(windows: list[list[Piece]], step_tokens: int = STEP_TOKENS) -> list[list[Piece]]:
    """The windows of each size so that those of about `step_tokens` in a row have nearly the same attention cost.

    They are dealt there and back in order of cost (the sum of squared piece lengths), and then laid out deal by deal.
    """
    by_size: dict[int, list[list[Piece]]] = {}
    for w in windows:
        by_size.setdefault(sum(p.length for p in w), []).append(w)
    out = []
    for size in sorted(by_size, reverse=True):
        ranked = sorted(by_size[size], key=lambda w: -sum(p.length**2 for p in w))
        n = -(-len(ranked) // max(1, step_tokens // size))
        for k in range(n):
            for lap in range(0, len(ranked), n):
                i = lap + (k if lap // n % 2 == 0 else n - 1 - k)
                out += ranked[i : i + 1] if i < len(ranked) else []
    return out


#: Rows of the first and the second pass: `window` counts a part's windows of one size, from 0; null for what is left over.
PACKED = "doc_id long, start long, length long, ids binary, doc_tokens long, offset long, tier int, part long, window long"
NAMES = [c.split()[0] for c in PACKED.split(", ")]
#: doc_id, start, ids and doc_tokens of what is packed: a text or a part of one.
Source = tuple[int | None, int, bytes, int]


class Packer:
    """Packs the sources of one part, and numbers its windows."""

    def __init__(self, part: int, tiers: tuple[int, ...], step_tokens: int):
        self._part, self._tiers, self._step_tokens = part, tiers, step_tokens
        self._counts: dict[int, int] = {}

    def rows(self, sources: list[Source], last: bool = False) -> tuple[list[tuple], list[Source]]:
        """Rows, and the sources that are left over; if they are the last, these are packed too, by powers of two."""
        windows, left = pack([len(ids) // 4 for _, _, ids, _ in sources], self._tiers)
        if last:
            windows, left = windows + powers_of_two(left), []
        rows = []
        for window in in_step_order(windows, self._step_tokens):
            offset, size = 0, sum(p.length for p in window)
            number = self._counts[size] = self._counts.get(size, -1) + 1
            for p in window:
                doc_id, start, ids, total = sources[p.doc]
                rows.append((doc_id, start + p.start, p.length, ids[4 * p.start : 4 * (p.start + p.length)], total, offset, size, self._part, number))
                offset += p.length
        return rows, [(doc_id, start + p.start, ids[4 * p.start : 4 * (p.start + p.length)], total) for p in left for doc_id, start, ids, total in [sources[p.doc]]]


def pack_documents(
    docs: DataFrame, json_path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS
) -> DataFrame:
    """Tokenise and pack whole documents: a row per piece, see PIECE_SCHEMA; `ids` holds little-endian unsigned 32-bit ids.

    A null or empty text is `end_id` alone. Null ids and repeated rows are packed as they are; an empty table gives
    no rows. Ids must be numbers or cast to such. No window has padding. A task holds an Arrow batch, its tokens and
    less than a window of earlier ones. Pieces are written once; what comes after is narrow: the remainders of
    TOGETHER tasks at a time, and the counts of windows by task and size, which give each window its number in the
    corpus. Step groups are runs of these numbers, so that at most the last group of a size is not full.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
        raise ValueError("tiers must be ascending powers of two")
    tail = int(end_id).to_bytes(4, "little")
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokeniser(json_path, ranks_path, pattern)
        part = TaskContext.get().partitionId()
        packer = Packer(part, tiers, step_tokens)
        left: list[Source] = []
        for batch in batches:
            tokens = [(encode(text) if text else b"") + tail for text in batch.column(1).to_pylist()]
            rows, left = packer.rows(left + [(i, 0, ids, len(ids) // 4) for i, ids in zip(batch.column(0).to_pylist(), tokens, strict=True)])
            for at in range(0, len(rows), 4096):
                yield batch_of(rows[at : at + 4096])
        if left:
            yield batch_of([(i, start, len(ids) // 4, ids, total, None, None, part, None) for i, start, ids, total in left])

    def again(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "doc_id", "start"])
        ids = [None if pd.isna(i) else int(i) for i in rows["doc_id"]]
        done, _ = Packer(-1 - int(key[0]), tiers, step_tokens).rows([*zip(ids, rows["start"], rows["ids"], rows["doc_tokens"])], last=True)
        return pd.DataFrame(done, columns=NAMES).astype({"doc_id": "Int64"})

    packed = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, PACKED)
    packed = written(packed, "packing-pieces")
    rest = packed.where("window IS NULL").groupBy(F.floor(F.col("part") / TOGETHER)).applyInPandas(again, PACKED)
    pieces = packed.where("window IS NOT NULL").unionByName(written(rest, "packing-rest"))
    counts = pieces.groupBy(F.col("part").alias("p"), F.col("tier").alias("t")).agg((F.max("window") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("t").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(counts.select("p", "t", F.coalesce(before, F.lit(0)).alias("before")), "packing-counts")  # a row per task and size
    number = F.col("before") + F.col("window")
    size = F.log2("tier").cast("long")  # the low bits of the ids that are given
    return pieces.join(counts, (F.col("part") == F.col("p")) & (F.col("tier") == F.col("t"))).select(
        "doc_id", "start", "length", "ids", "doc_tokens",
        (number * 64 + size).alias("sequence_id"), "offset", "tier",
        (F.floor(number / F.greatest(F.lit(1), F.floor(F.lit(step_tokens) / F.col("tier")))) * 64 + size).alias("step_group"),
    )
