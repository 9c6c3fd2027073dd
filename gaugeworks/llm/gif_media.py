"""GIF media columns: decode LZW code streams, apply palettes, disposal and transparency, store timed frames.

`decode_gifs` turns a binary column into a row per frame with its time, its pixels and a colour histogram.
`store_gifs` is a lossless way in: bytes become the 8-bit samples of grey frames of a real GIF file, and
`file_digests` reads what was stored off the decoded frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the format.
CLEAR, END, FIRST_FREE, TABLE_SIZE, MAX_BITS = 256, 257, 258, 4096, 12
WIDTH, MAX_ROWS = 64, 1024
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)


@dataclass
class Frame:
    """A frame after compositing: RGB of the whole canvas; `indexes` are the frame's own palette indexes."""

    delay_ms: int
    disposal: int
    transparent: int | None
    left: int
    top: int
    indexes: np.ndarray
    canvas: np.ndarray


# -- LZW ---------------------------------------------------------------------------------------------------


def _widths(n: int) -> np.ndarray:
    """Bits of the 1st to n-th code after a clear code, for 8-bit data.

    The decoder adds an entry with every code but the first, so before code k its table holds
    256 + k entries (258 before the first two) and the width is what this number needs.
    """
    held = np.maximum(np.arange(1, n + 1) + FIRST_FREE - 2, FIRST_FREE)
    return np.minimum(np.floor(np.log2(held)).astype(np.int64) + 1, MAX_BITS)


def lzw_encode(data: bytes) -> bytes:
    """8-bit LZW. The table is cleared whenever it is full."""
    codes: list[int] = []
    runs: list[int] = []  # how many codes follow each clear code, the next clear or end code included
    emit = codes.append
    # a run's code is held times 256, so that it and the next byte make a key
    table: dict[int, int] = {}
    known = table.get
    free, begun = FIRST_FREE << 8, 0
    prefix = data[0] << 8 if data else -1
    for byte in data[1:]:
        key = prefix | byte
        longer = known(key)
        if longer is not None:
            prefix = longer
            continue
        emit(prefix >> 8)
        prefix = byte << 8
        table[key] = free
        free += 256
        if free == TABLE_SIZE << 8:
            emit(CLEAR)
            runs.append(len(codes) - begun)
            begun = len(codes)
            table.clear()
            free = FIRST_FREE << 8
    if prefix >= 0:
        emit(prefix >> 8)
    emit(END)
    runs.append(len(codes) - begun)
    widths = np.concatenate([[9], *[_widths(n) for n in runs]])  # the stream begins with a clear code
    values = np.array([CLEAR, *codes], dtype=np.uint16)
    place = np.arange(MAX_BITS, dtype=np.uint16)
    bits = (values[:, None] >> place & 1).astype(np.uint8)
    return np.packbits(bits[place < widths[:, None]], bitorder="little").tobytes()


def _segments(stream: bytes, min_bits: int) -> Iterator[np.ndarray]:
    """The codes between clear codes; widths within a segment depend on the number of codes only."""
    bits = np.unpackbits(np.frombuffer(stream, dtype=np.uint8), bitorder="little")
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    at, segment = 0, []
    held, width = clear + 2, min_bits + 1

    def restart() -> np.ndarray:
        nonlocal segment, held, width
        done = np.concatenate(segment) if segment else np.zeros(0, dtype=np.int64)
        segment, held, width = [], clear + 2, min_bits + 1
        return done

    while True:
        # up to where the width grows: the first code of a segment adds no entry
        here = (1 << width) - held + (not segment) if width < MAX_BITS or held < TABLE_SIZE else TABLE_SIZE
        here = min(here, (len(bits) - at) // width)
        if here <= 0:
            break
        codes = bits[at : at + here * width].reshape(here, width) @ (1 << np.arange(width))
        stop = np.flatnonzero((codes == clear) | (codes == end))
        if len(stop):
            segment.append(codes[: stop[0]])
            at += (int(stop[0]) + 1) * width
            ended = codes[stop[0]] == end
            yield restart()
            if ended:
                return
            continue
        held = min(held + here - (not segment), TABLE_SIZE)
        segment.append(codes)
        at += here * width
        if held == 1 << width and width < MAX_BITS:
            width += 1
    yield restart()  # a stream without an end code


def lzw_decode(stream: bytes, min_bits: int, most: int | None = None) -> bytes:
    """The first `most` indexes of a code stream. Raises ValueError at a code that the table can't hold yet.

    The entry that the n-th code of a segment adds is that code's run and the byte after it. Both stand in the
    output, where the n-th run begins: so every run but a literal is a copy of earlier output, each byte's source is
    known from the lengths of the runs, and following sources to the literals gives all bytes at once.
    """
    segments = list(_segments(stream, min_bits))
    codes = np.concatenate(segments)
    n, literals = len(codes), 1 << min_bits
    begins = np.repeat(np.cumsum([0, *map(len, segments[:-1])]), [len(s) for s in segments])
    here = np.arange(n)
    copied = codes >= literals
    source = np.where(copied, begins + codes - literals - 2, here)  # the run that each code's run begins with
    if (source[copied] >= here[copied]).any():
        raise ValueError("LZW: a code beyond the table")
    lengths, at = copied.astype(np.int64), source
    while copied[at].any():  # a run is longer by one than its source: count the steps to a literal
        lengths = lengths + lengths[at]
        at = at[at]
    lengths += 1
    places = np.cumsum(lengths) - lengths
    if most is not None:
        used = int(np.searchsorted(places, most))
        codes, copied, source, lengths, places = codes[:used], copied[:used], source[:used], lengths[:used], places[:used]
    if not len(codes):
        return b""
    origin = np.repeat(places[source] - places, lengths) + np.arange(int(lengths.sum()))
    values = np.zeros(len(origin), dtype=np.uint8)
    values[places[~copied]] = codes[~copied]
    while True:
        further = origin[origin]
        if (further == origin).all():
            return values[origin].tobytes()
        origin = further


# -- files -------------------------------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_grey_gif(payload: bytes, delay_cs: int = 10) -> bytes:
    """The payload, a positive multiple of 64 bytes, as grey rows of 64 samples, 1,024 rows a frame."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, MAX_ROWS), 0xF7, 0, 0), GREY.tobytes()]
    for row in range(0, rows, MAX_ROWS):
        part = payload[row * WIDTH : (row + MAX_ROWS) * WIDTH]
        # sample 0 is transparent, and each frame is cleared to black (disposal 2): so 0 shows as black all the same
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 2 << 2 | 1, delay_cs, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out.append(_blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 3 * (2 << (flags & 7))
    return np.frombuffer(data[at : at + n], dtype=np.uint8).reshape(-1, 3), at + n


def _deinterlaced(rows: np.ndarray) -> np.ndarray:
    height = len(rows)
    order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, height, step)]
    out = np.empty_like(rows)
    out[order] = rows
    return out


#: Pixels of the largest canvas or frame that is decoded; a bound on memory, as a few bytes can claim 65,535 x 65,535.
MAX_PIXELS = 1 << 24


def _fits(width: int, height: int, max_pixels: int) -> None:
    if width * height > max_pixels:
        raise ValueError(f"GIF: {width} x {height} is more than {max_pixels} pixels")


def decode_gif(data: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[Frame]:
    """The composited frames of a GIF. Raises ValueError or IndexError if the file is broken or too large.

    Disposal is applied before the next frame: 2 clears the frame's box to black, 3 puts back what was
    there before it, all else leaves it. Transparent pixels leave the canvas as it is. Indexes beyond a
    palette count as its last colour; missing pixels of a short stream are index 0.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    _fits(width, height, max_pixels)
    common, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width, 3), dtype=np.uint8)
    delay = disposal = 0
    transparent: int | None = None
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            if data[at + 1] == 0xF9:
                packed, delay, index = struct.unpack("<BHB", data[at + 3 : at + 7])
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            _, at = _read_blocks(data, at + 2)
            continue
        if kind != 0x2C:
            raise ValueError("GIF: an unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        _fits(w, h, max_pixels)
        own, at = _palette(data, at + 10, flags)
        stream, after = _read_blocks(data, at + 1)
        flat = np.frombuffer(lzw_decode(stream, data[at], w * h).ljust(w * h, b"\0")[: w * h], dtype=np.uint8)
        at = after
        indexes = flat.reshape(h, w)
        if flags & 0x40:
            indexes = _deinterlaced(indexes)
        palette = own if own is not None else common if common is not None else GREY
        before = canvas.copy() if disposal == 3 else None
        box = canvas[top : top + h, left : left + w]
        shown = indexes[: box.shape[0], : box.shape[1]]
        colours = palette[np.minimum(shown, len(palette) - 1)]
        if transparent is None:
            box[:] = colours
        else:
            box[:] = np.where((shown == transparent)[..., None], box, colours)
        yield Frame(delay * 10, disposal, transparent, left, top, indexes, canvas.copy())
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif before is not None:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def colour_histogram(rgb: np.ndarray) -> np.ndarray:
    """Pixels in each of 64 bins: two high bits of red, green and blue."""
    top = rgb.reshape(-1, 3) >> 6
    return np.bincount(top[:, 0] << 4 | top[:, 1] << 2 | top[:, 2], minlength=64)


# -- DataFrames --------------------------------------------------------------------------------------------

FRAME_FIELDS = [
    ("id", "long", pa.int64()), ("frame", "int", pa.int32()), ("start_ms", "long", pa.int64()), ("delay_ms", "int", pa.int32()), ("disposal", "int", pa.int32()), ("transparent", "int", pa.int32()),
    ("width", "int", pa.int32()), ("height", "int", pa.int32()), ("histogram", "array<long>", pa.list_(pa.int64())), ("rgb", "binary", pa.binary()), ("samples", "binary", pa.binary()), ("error", "string", pa.string()),
]
#: Bytes of pixels that are handed on at once.
AT_ONCE = 4 << 20


def decode_gifs(files: DataFrame, id_col: str, gif_col: str, keep: tuple[str, ...] = (), rgb: bool = True, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """A row per frame: the columns in `keep`, id, frame, start_ms, delay_ms, disposal, transparent, width, height, histogram, rgb, samples, error.

    `rgb` is the whole canvas as it then shows (null if not wanted), `samples` the frame's own palette indexes. A null
    file gives no row. A broken file, or one beyond `max_pixels`, gives its frames up to the fault, then a row with
    null columns and the error. A file is decoded frame by frame in one task, and its rows stand together in order;
    nothing is gathered across files.
    """
    kept = files.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            schema = pa.schema([*[batch.schema.field(i) for i in range(len(keep))], *[(n, t) for n, _, t in FRAME_FIELDS]])
            flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)  # noqa: B023, E731
            for *extra, key, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if data is None:
                    continue
                n, clock = 0, 0
                try:
                    for f in decode_gif(data, max_pixels):
                        h, w, _ = f.canvas.shape
                        pixels = f.canvas.tobytes() if rgb else None
                        rows.append((*extra, key, n, clock, f.delay_ms, f.disposal, f.transparent, w, h, colour_histogram(f.canvas), pixels, f.indexes.tobytes(), None))
                        n, clock = n + 1, clock + f.delay_ms
                        held += len(pixels or b"") + f.indexes.size
                        if held >= AT_ONCE or len(rows) >= 1024:
                            yield flush()
                            rows, held = [], 0
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((*extra, key, n, clock, *[None] * 8, str(e) or "GIF: cut short"))
            if rows:
                yield flush()
                rows, held = [], 0

    columns = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"{n} {t}" for n, t, _ in FRAME_FIELDS]])
    return files.select(*keep, files[id_col].cast("long").alias("__id"), files[gif_col].alias("__gif")).mapInArrow(run, columns)


def padded(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 bytes, with zero bytes up to a positive multiple of 64; and their number before that."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0")


def store_gifs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, gif: every whole text as a GIF file; a row per input row.

    A null or empty text is 64 zero bytes. Ids must be numbers or cast to such; null ids and repeated rows stay. An
    empty table gives an empty one. No shuffle. A repeated text within a batch is encoded once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # so that the files of a whole batch are never held together
                part = batch.slice(at, 512)
                done: dict[str | None, tuple[int, bytes]] = {}
                for text in part.column(1).to_pylist():
                    if text not in done:
                        n, payload = padded(text)
                        done[text] = n, encode_grey_gif(payload)
                rows = [done[text] for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([g for _, g in rows], pa.binary())], names=["doc_id", "n_bytes", "gif"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_bytes long, gif binary")


DIGEST_FIELDS = [
    ("id", "long", pa.int64()), ("payload_bytes", "long", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "long", pa.int64()),
    ("n_frames", "int", pa.int32()), ("duration_ms", "long", pa.int64()), ("histogram", "array<long>", pa.list_(pa.int64())),
]


def file_digests(frames: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per file of what decode_gifs returned, see DIGEST_FIELDS; `keep`: columns that all rows of a file share.

    Payload, hash and crc32 (of the last 64 bytes) are those of the samples of all frames in turn; the histogram is
    the sum over all frames' canvases. The rows of a file stand together, as decode_gifs puts
    them: so no shuffle is needed, and a task holds one batch of frames. Raises at a file with an error.
    """
    kept = frames.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file: list = []  # of the file being read: extra columns, id, size, sha, tail, frames, duration, histogram
        for batch in batches:
            schema = pa.schema([*[batch.schema.field(i) for i in range(len(keep))], *[(n, t) for n, _, t in DIGEST_FIELDS]])
            rows: list[tuple] = []
            for *extra, key, number, delay, histogram, samples, error in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if error is not None:
                    raise ValueError(f"file {key}: {error}")
                if number == 0:
                    rows += [_digest(file)] if file else []
                    file = [extra, key, 0, hashlib.sha256(), b"", 0, 0, np.zeros(64, dtype=np.int64)]
                file[2] += len(samples)
                file[3].update(samples)
                file[4] = (file[4] + samples)[-WIDTH:]
                file[5] += 1
                file[6] += delay
                file[7] += np.array(histogram, dtype=np.int64)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if file:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(_digest(file)), schema)], schema=schema)

    columns = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], *[f"{n} {t}" for n, t, _ in DIGEST_FIELDS]])
    return frames.select(*keep, "id", "frame", "delay_ms", "histogram", "samples", "error").mapInArrow(run, columns)


def _digest(file: list) -> tuple:
    extra, key, size, sha, tail, n_frames, duration, histogram = file
    return (*extra, key, size, sha.hexdigest(), zlib.crc32(tail), n_frames, duration, histogram)
