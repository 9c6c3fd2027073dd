from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from gaugeworks.llm import gif_media as g
from tests.llm import odd


@pytest.mark.parametrize("n", [0, 1, 2, 254, 255, 256, 257, 3837, 3838, 3839, 30_000])
@pytest.mark.parametrize("letters", [1, 3, 256])
def test_lzw_round_trip(n, letters):
    data = bytes(random.Random(n).randrange(letters) for _ in range(n))
    assert g.lzw_decode(g.lzw_encode(data), 8) == data


def test_lzw_sample():
    # fixed values: the 10 x 10 sample picture of a public description of the format
    stream = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
    top, middle = "1111122222", ("1110000222", "2220000111")
    picture = [top] * 3 + [middle[0]] * 2 + [middle[1]] * 2 + ["2222211111"] * 3
    assert g.lzw_decode(stream, 2) == bytes(int(c) for row in picture for c in row)


def test_lzw_widths_grow_as_the_table_does():
    # clear, 1, 1, 2, the first new entry (1 1), end: two entries are added by the 2, and fill three bits
    bits = "".join(format(c, f"0{w}b")[::-1] for c, w in ((4, 3), (1, 3), (1, 3), (2, 3), (6, 4), (5, 4)))
    packed = bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
    assert g.lzw_decode(packed, 2) == bytes([1, 1, 2, 1, 1])


def plain_lzw(stream, min_bits):
    """The textbook decoder: bit by bit, one code and one table entry at a time."""
    bits = "".join(format(b, "08b")[::-1] for b in stream)
    clear, at, width, out, table, last = 1 << min_bits, 0, min_bits + 1, b"", [], None
    while at + width <= len(bits):
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], min_bits + 1, None
        elif code == clear + 1:
            return out
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
            last = entry
    return out


@pytest.mark.parametrize("seed", range(6))
def test_against_the_textbook_decoder(seed):
    rng = random.Random(seed)
    data = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9000))) + bytes(rng.randint(0, 5000)) + bytes(rng.randrange(256) for _ in range(6000))
    stream = g.lzw_encode(data)
    assert plain_lzw(stream, 8) == data == g.lzw_decode(stream, 8)
    assert g.lzw_decode(stream, 8, 500)[:500] == data[:500]


def test_broken_streams():
    with pytest.raises(ValueError, match="beyond"):
        g.lzw_decode(bytes([0b11_001_100, 0b1]), 2)  # clear, 1, and an entry that is two ahead


def gif(frames, size=(2, 2), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    """frames: disposal, transparent index, delay, left, top, rows of indexes."""
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), bytes(v for c in palette for v in c)]
    for disposal, transparent, delay, left, top, rows in frames:
        flags = disposal << 2 | (transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", flags, delay, transparent or 0, 0))
        data = g.lzw_encode(bytes(v for r in rows for v in r))
        out.append(b"\x2c" + struct.pack("<HHHHB", left, top, len(rows[0]), len(rows), 0) + b"\x08" + g._blocks(data))
    return b"".join([*out, b"\x3b"])


def colours(frame):
    names = {(0, 0, 0): "k", (255, 0, 0): "r", (0, 255, 0): "g", (0, 0, 255): "b"}
    return ["".join(names[tuple(map(int, p))] for p in row) for row in frame.canvas]


def test_disposal_and_transparency():
    full = [(1, 1), (1, 1)]
    one = lambda disposal: gif([(1, None, 5, 0, 0, full), (disposal, None, 7, 1, 1, [(2,)]), (1, 0, 9, 0, 0, [(0, 3), (0, 0)])])
    assert [colours(f) for f in g.decode_gif(one(1))] == [["rr", "rr"], ["rr", "rg"], ["rb", "rg"]]
    assert [colours(f) for f in g.decode_gif(one(2))][2] == ["rb", "rk"]
    assert [colours(f) for f in g.decode_gif(one(3))][2] == ["rb", "rr"]
    assert [f.delay_ms for f in g.decode_gif(one(1))] == [50, 70, 90]


def test_interlaced_rows():
    rows = np.arange(10).reshape(10, 1)
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    assert g._deinterlaced(rows[order]).tolist() == rows.tolist()


def test_frames_of_files(spark):
    good = gif([(1, None, 5, 0, 0, [(1, 1), (1, 1)]), (1, None, 7, 0, 0, [(2, 2), (3, 3)])])
    files = spark.createDataFrame([(1, bytearray(good), 1), (2, None, 2), (3, bytearray(b"no gif"), 3), (4, bytearray(good[:-20]), 4), (5, bytearray(b""), 5)], "doc_id long, file binary, frame int")
    rows = sorted(g.decode_gifs(files, "doc_id", "file", keep=("doc_id",)).collect(), key=lambda r: (r["id"], r["frame"]))
    assert [(r["id"], r["frame"], r["start_ms"], r["error"] is None) for r in rows] == [(1, 0, 0, True), (1, 1, 50, True), (3, 0, 0, False), (4, 0, 0, True), (4, 1, 50, False), (5, 0, 0, False)]
    assert sum(rows[0]["histogram"]) == 4 and rows[0]["histogram"][0b110000] == 4
    assert bytes(rows[0]["rgb"]) == bytes([255, 0, 0] * 4) and bytes(rows[1]["samples"]) == bytes([2, 2, 3, 3]) and rows[0]["doc_id"] == 1
    assert g.decode_gifs(files.limit(0), "doc_id", "file").count() == 0


def test_files_that_claim_too_much(spark):
    """A header, or a frame, of 65,535 x 65,535 pixels; and a stream of far more indexes than its frame has."""
    header = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00\x3b"
    frame = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x02\x4c\x01\x00\x3b"
    long = gif([(1, None, 0, 0, 0, [(1,) * 60_000])], size=(3, 1)).replace(struct.pack("<HHHHB", 0, 0, 60_000, 1, 0), struct.pack("<HHHHB", 0, 0, 3, 1, 0))
    files = spark.createDataFrame([(1, bytearray(header)), (2, bytearray(frame)), (3, bytearray(long))], "doc_id long, file binary")
    rows = {r["id"]: r for r in g.decode_gifs(files, "doc_id", "file").collect()}
    assert "pixels" in rows[1]["error"] and "pixels" in rows[2]["error"]
    assert rows[3]["error"] is None and bytes(rows[3]["samples"]) == bytes([1, 1, 1])


def plain_gif(data):
    """Samples, delays and shown colours of our own files, read without the module: blocks in turn, the textbook LZW."""
    at, frames, delay, clear = 13 + 768, [], 0, None
    grey = data[13 : 13 + 768]
    while data[at] != 0x3B:
        if data[at] == 0x21:
            flags, delay, clear = struct.unpack("<BHB", data[at + 3 : at + 7])
            assert flags >> 2 & 7 == 2 and flags & 1
            at += 8
            continue
        w, h = struct.unpack("<HH", data[at + 5 : at + 9])
        bits, at, stream = data[at + 10], at + 11, b""
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        samples = plain_lzw(stream, bits)
        assert len(samples) == w * h
        frames.append((samples, delay * 10, [(0, 0, 0) if s == clear else tuple(grey[3 * s : 3 * s + 3]) for s in samples]))
    return frames


def test_query(spark, tmp_path):
    """Every column of op7 over odd rows, the stored files read by other code."""
    from gaugeworks.llm.entries import op7_gif_media

    odd.documents(spark).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    files: dict = {}
    for r in g.store_gifs(odd.documents(spark)).collect():
        files.setdefault(r["doc_id"], []).append(bytes(r["gif"]))
    expected = []
    for i, text in odd.TEXTS:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        data = next(f for f in files[i] if b"".join(s for s, _, _ in plain_gif(f)) == payload)
        frames = plain_gif(data)
        histogram = [0] * 64
        for k, (_, _, shown) in enumerate(frames):
            size = min(len(payload), 65536)
            for red, green, blue in shown + [(0, 0, 0)] * (size - len(shown)):
                histogram[(red >> 6) * 16 + (green >> 6) * 4 + (blue >> 6)] += 1
        feature = f"{len(frames)} frames, {sum(d for _, d, _ in frames)} ms, colours {' '.join(map(str, histogram))}"
        expected.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = [tuple(r[n] for n in names) for r in op7_gif_media(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert g.file_digests(g.decode_gifs(g.store_gifs(odd.empty(spark)), "doc_id", "gif")).count() == 0
