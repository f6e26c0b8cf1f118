"""AVI motion-JPEG columns: write and parse RIFF files, decode intra frames, detect shots.

A payload (a multiple of 64 bytes) is stored losslessly in the format's own unit, the quantised DCT coefficient:
64 bytes are one 8x8 block, in zigzag order. Byte b becomes the coefficient b where b >= 128, else b - 255; these are
exactly the values of JPEG's size category 8, whose eight magnitude bits are b itself. Files are baseline grey JPEG
frames (a restart marker after every block, so blocks decode independently) in an AVI with hdrl, movi and idx1.
The decoder reads any baseline grey frame: tables come from the frame's own segments, and all restart intervals of a
frame are decoded in step, so that long files need no loop over samples in Python.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import plain

#: Fixed values of the format: coefficient order of a block.
ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
COLUMNS, ROWS, FPS = 8, 4, 25
BLOCKS = COLUMNS * ROWS
#: Huffman codes: bits by symbol. Size 8 has eight bits; zero and end-of-block, which padding blocks are made of, too.
SYMBOLS = (0x08, 0x00)

_k = np.arange(8)
_c = np.where(_k == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)
#: The inverse DCT in whole numbers (times 2^11): sums stay below 2^24 and so are exact in float32, in any order.
IDCT = np.rint(np.einsum("ux,vy->uvxy", _c, _c).reshape(64, 64) * 2048).astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(columns: int, rows: int) -> bytes:
    counts = bytes([0] * 7 + [len(SYMBOLS)] + [0] * 8)
    return b"\xff\xd8" + b"".join((
        _segment(0xDB, bytes([0]) + bytes([1] * 64)),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, bytes([0x00]) + counts + bytes(SYMBOLS)),
        _segment(0xC4, bytes([0x10]) + counts + bytes(SYMBOLS)),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ))


def encode_frames(payload: bytes, columns: int = COLUMNS, rows: int = ROWS) -> list[bytes]:
    """JPEG frames of columns x rows blocks; the last one is filled up with blocks of zeros."""
    blocks = columns * rows
    data = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    head, frames = _head(columns, rows), []
    code = {s: i for i, s in enumerate(SYMBOLS)}
    for at in range(0, len(data), blocks):
        part = data[at : at + blocks]
        body = np.empty((len(part), 64, 2), np.uint8)
        body[:, :, 0] = code[0x08]
        body[:, :, 1] = part
        body = body.reshape(len(part), 128)
        rst = [bytes([0xFF, 0xD0 + i % 8]) for i in range(8)]
        empty = bytes([code[0x00], code[0x00]])
        out = [b.tobytes().replace(b"\xff", b"\xff\x00") for b in body] if (part == 255).any() else [b.tobytes() for b in body]
        out += [empty] * (blocks - len(part))
        frames.append(head + b"".join(x for i, b in enumerate(out) for x in ((rst[(i - 1) % 8], b) if i else (b,))) + b"\xff\xd9")
    return frames


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], columns: int = COLUMNS, rows: int = ROWS, fps: int = FPS) -> bytes:
    width, height, largest = columns * 8, rows * 8, max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    index, at, movi = [], 4, [b"movi"]
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Avi:
    width: int
    height: int
    frame_us: int
    frames: list[bytes]


def parse_avi(data: bytes) -> Avi:
    """Frames by the index (idx1); by walking movi where there is none. Raises ValueError for other files."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    avi, movi, index = Avi(0, 0, 40_000, []), None, None
    at, end = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])
    while at + 8 <= end:
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl" and (h := data.find(b"avih", at, at + 8 + n)) >= 0:
            avi.frame_us = struct.unpack_from("<I", data, h + 8)[0]
            avi.width, avi.height = struct.unpack_from("<II", data, h + 40)
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = (at + 8, at + 8 + n)
        elif name == b"idx1":
            index = (at + 8, n)
        at += 8 + n + n % 2
    if movi is None:
        raise ValueError("no movi list")
    if index:
        for k in range(index[0], index[0] + index[1], 16):
            if data[k + 2 : k + 4] == b"dc":
                offset, n = struct.unpack_from("<II", data, k + 8)
                start = movi[0] + offset + 8 if data[movi[0] + offset : movi[0] + offset + 4] == data[k : k + 4] else offset + 8
                avi.frames.append(data[start : start + n])
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            n = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2 : at + 4] == b"dc":
                avi.frames.append(data[at + 8 : at + 8 + n])
            at += 8 + n + n % 2
    return avi


def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol for each 16-bit window; length 0 where no code fits."""
    length, symbol = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    code = k = 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - bits)
            length[first : first + (1 << (16 - bits))] = bits
            symbol[first : first + (1 << (16 - bits))] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


_TABLES: dict[bytes, tuple] = {}


def _header(frame: bytes) -> tuple[int, tuple]:
    """Where the entropy-coded data begin, and (quantisers, width, height, DC table, AC table, restart interval)."""
    at, quant, size, tables, restart = 2, {}, None, {}, 0
    while True:
        if frame[at] != 0xFF:
            raise ValueError("no marker")
        marker, n = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            size = (struct.unpack_from(">HH", body, 1), body[5], body[8])
        elif marker == 0xC4:
            while body:
                k = sum(body[1:17])
                tables[body[0]] = _lookup(body[1:17], body[17 : 17 + k])
                body = body[17 + k :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if size is None or size[1] != 1:
                raise ValueError("not a baseline grey frame")
            (height, width), dc, ac = size[0], body[2] >> 4, body[2] & 15
            return at, (quant[size[2]], width, height, tables[dc], tables[0x10 | ac], restart)


def decode_frames(frames: list[bytes]) -> list[tuple[np.ndarray, tuple[int, int]]]:
    """For each frame its quantised coefficients (blocks, 64), in zigzag order, and (width, height)."""
    out: list = [None] * len(frames)
    groups: dict[bytes, list[int]] = {}
    heads = {}
    for i, f in enumerate(frames):
        start = f.index(b"\xff\xda")
        start += 2 + struct.unpack_from(">H", f, start + 2)[0]
        groups.setdefault(f[:start], []).append(i)
        heads[i] = start
    for head, members in groups.items():
        if head not in _TABLES:
            if len(_TABLES) > 64:
                _TABLES.clear()
            _TABLES[head] = _header(head)
        _, (quant, width, height, dc, ac, restart) = _TABLES[head]
        blocks = -(-width // 8) * -(-height // 8)
        coefficients = _scan([frames[i][heads[i] :] for i in members], blocks, restart or blocks, dc, ac)
        for i, c in zip(members, coefficients, strict=True):
            out[i] = (c * quant if (quant != 1).any() else c, (width, height))
    return out


def _scan(scans: list[bytes], blocks: int, restart: int, dc: tuple, ac: tuple) -> np.ndarray:
    """Decode the restart intervals of all scans in step: (scans, blocks, 64)."""
    data = np.frombuffer(b"".join(scans), np.uint8)
    n = len(scans)
    per = -(-blocks // restart)
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    markers = ff[(after >= 0xD0) & (after <= 0xD7)]
    ends_of = np.cumsum([len(s) for s in scans])
    begins = np.concatenate(([0], ends_of[:-1]))
    starts = np.sort(np.concatenate((begins, markers + 2)))
    if len(starts) != n * per:
        raise ValueError("restart markers are missing")
    stuffed = ff[after == 0] + 1
    if len(stuffed):  # without stuffing, positions move back by the stuffed bytes before them
        keep = np.ones(len(data), bool)
        keep[stuffed] = False
        starts = starts - np.searchsorted(stuffed, starts)
        data = data[keep]
    d = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint32)
    window = (d[:-3] << np.uint32(24)) | (d[1:-2] << np.uint32(16)) | (d[2:-1] << np.uint32(8)) | d[3:]
    bit = starts.astype(np.int64) * 8
    out = np.zeros((n * per, restart, 64), np.int16)
    last = np.zeros(n * per, np.int64)
    limit = (len(d) - 8) * 8

    def take(table, at, rows):
        w = (window[at >> 3].astype(np.int64) << 8) | d[(at >> 3) + 4]
        w = (w >> (24 - (at & 7))) & 0xFFFF
        bits = table[0][w]
        if not bits.all():
            raise ValueError("no such code")
        return bits, table[1][w]

    def value(at, size):
        w = (window[at >> 3].astype(np.int64) << 8) | d[(at >> 3) + 4]
        v = (w >> (40 - (at & 7) - size)) & ((1 << size) - 1)
        return np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)

    whole = np.arange(n * per)
    for b in range(restart):
        rows = whole[(whole % per) * restart + b < blocks]
        bits, size = take(dc, bit[rows], rows)
        bit[rows] += bits
        last[rows] += value(bit[rows], size)
        bit[rows] += size
        out[rows, b, 0] = last[rows]
        k = np.zeros(len(rows), np.int64)
        while len(rows):
            at = bit[rows]
            bits, symbol = take(ac, at, rows)
            size, run = symbol & 15, symbol >> 4
            at = at + bits
            v = value(at, size)
            bit[rows] = at + size
            k = k + run + 1
            if (k > 63).any() and ((k > 63) & (symbol != 0)).any():
                raise ValueError("too many coefficients")
            on = symbol != 0
            if not on.all():
                rows, k, v = rows[on], k[on], v[on]
            out[rows, b, k] = v
            left = k < 63
            if not left.all():
                rows, k = rows[left], k[left]
    if (bit > limit).any():
        raise ValueError("data end early")
    return out.reshape(n, per * restart, 64)[:, :blocks]


def payload_of(coefficients: np.ndarray) -> bytes:
    """The bytes that encode_frames stored; blocks of zeros hold none."""
    c = coefficients.reshape(-1, 64)
    c = c[c[:, 0] != 0]
    return np.where(c > 0, c, c + 255).astype(np.uint8).tobytes()


def histograms(coefficients: np.ndarray, bins: int = 16) -> np.ndarray:
    """Grey-level histograms (frames, bins) of the decoded pixels."""
    frames, blocks, _ = coefficients.shape
    natural = np.zeros((frames * blocks, 64), np.float32)
    natural[:, ZIGZAG] = coefficients.reshape(-1, 64)
    level = np.clip((natural @ IDCT).astype(np.int32) // 2048 + 128, 0, 255) * bins // 256
    level += (np.arange(frames).repeat(blocks) * bins)[:, None].astype(np.int32)
    return np.bincount(level.ravel(), minlength=frames * bins).reshape(frames, bins)


def shots(hist: np.ndarray, window: int = 8, factor: float = 3.0) -> list[tuple[int, int, int]]:
    """Shots (first frame, end, peak difference). A cut is where the difference of neighbouring histograms, in pixels,
    is over factor times the mean of up to window differences before it, and over an eighth of a frame."""
    n = len(hist)
    if not n:
        return []
    diff = np.abs(np.diff(hist, axis=0)).sum(1)
    total = np.concatenate(([0], np.cumsum(diff)))
    first = np.maximum(np.arange(len(diff)) - window, 0)
    count = np.arange(len(diff)) - first
    cut = (diff * count * 1.0 > factor * (total[np.arange(len(diff))] - total[first])) & (diff * 8 > hist[0].sum()) & (count > 0)
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
    return [(a, b, int(diff[a:b].max(initial=0))) for a, b in zip(edges, edges[1:], strict=False)]


def to_avi(text: str | None) -> tuple[bytes, bytes]:
    """The padded payload of a text and its file."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    return payload, write_avi(encode_frames(payload))


def _batch(texts: list[str | None]) -> Iterator[tuple[int, bytes, Avi, np.ndarray]]:
    """n_bytes, file, what was parsed, coefficients by frame, for each text; frames of many files decode in step."""
    held, frames = [], 0
    for t in [*texts, ...]:
        if t is not ...:
            payload, data = to_avi(t)
            avi = parse_avi(data)
            held.append((len((t or "").encode("utf-8", "surrogatepass")), data, avi))
            frames += len(avi.frames)
        if held and (t is ... or frames >= 512):
            decoded = decode_frames([f for _, _, a in held for f in a.frames])
            at = 0
            for n, data, a in held:
                yield n, data, a, np.stack([c for c, _ in decoded[at : at + len(a.frames)]])
                at += len(a.frames)
            held, frames = [], 0


def media_column(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, media): each text as an AVI file. A null text is stored as an empty one, i.e. 64 zero bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b.iloc[:, 0], "media": [to_avi(t)[1] for t in b.iloc[:, 1]]})

    d = plain(docs, key, text)
    return d.mapInPandas(run, f"{key} {d.schema[key].dataType.simpleString()}, media binary")


def clips(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """Timed clip rows (key, clip, start_s, end_s, frames, peak): one for each shot of each file. Null files have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, data in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                if data is None:
                    continue
                avi = parse_avi(data)
                decoded = decode_frames(avi.frames)
                hist = histograms(np.stack([c for c, _ in decoded])) if decoded else np.zeros((0, 16))
                rows += [(k, i, a * avi.frame_us / 1e6, e * avi.frame_us / 1e6, e - a, p) for i, (a, e, p) in enumerate(shots(hist))]
            out = pd.DataFrame(rows, columns=[key, "clip", "start_s", "end_s", "frames", "peak"])
            yield out.astype({key: b.dtypes.iloc[0]} if len(out) else {})

    d = plain(media, key, column)
    return d.mapInPandas(run, f"{key} {d.schema[key].dataType.simpleString()}, clip int, start_s double, end_s double, frames int, peak long")


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Round trip of every text and features of its frames, a row per document.

    Each file is written, parsed and decoded in one pass; nothing is shuffled. Null and empty texts are a file of
    64 zero bytes; keys may be null or repeated; equal texts have equal values.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, (n, data, avi, c) in zip(b.iloc[:, 0], _batch(b.iloc[:, 1].tolist()), strict=True):
                payload = payload_of(c)
                hist = histograms(c)
                found = shots(hist)
                mean = hist.sum(0)
                feature = f"frames={len(avi.frames)};shots=" + ",".join(f"{a}-{e}:{p}" for a, e, p in found) + ";hist=" + ",".join(map(str, mean))
                rows.append((k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            out = pd.DataFrame(rows, columns=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            yield out.astype({key: b.dtypes.iloc[0]} if len(out) else {})

    d = plain(docs, key, text)
    return d.mapInPandas(run, f"{key} {d.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
