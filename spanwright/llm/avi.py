"""AVI motion-JPEG media columns: write, read back, decode, and find shots.

A payload is cut into 24 x 24 grey frames of 8-bit samples. Each frame is a lossless
JPEG (SOF3, predictor 1), held in an AVI file with an ``idx1`` index; all frames are intra
frames, so any can be decoded alone. Frames are coded many at a time: encoding finds
the bit place of every sample by sums, and decoding goes sample by sample through all
frames of a group at once.

Shots: of each frame the grey histogram (16 bins) is taken; a shot begins where its
difference to the frame before exceeds what the last few differences make usual
(their mean and ``SPREAD`` deviations, ``FLOOR`` at least).

Defined results: a null text is empty, and an empty one gives one frame of padding; equal
texts give equal files; repeated rows each get a row; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SIDE = 24
FRAME = SIDE * SIDE
RATE = 25
#: Frames that are coded at once; a group holds so many and the rest of one document.
GROUP = 2048
BINS, RECENT, SPREAD, FLOOR = 16, 8, 2.0, FRAME // 4

# The codes of the nine difference categories of 8-bit samples, 4 bits each, and the markers around a scan.
_LENGTHS = bytes([0, 0, 0, 9] + [0] * 12)
_DHT = b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + 9, 0) + _LENGTHS + bytes(range(9))
_SOF = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
_SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
_HEAD, _TAIL = b"\xff\xd8" + _DHT + _SOF + _SOS, b"\xff\xd9"


def _differences() -> tuple[np.ndarray, np.ndarray]:
    """Code and number of bits for differences -255 to 255."""
    d = np.arange(-255, 256)
    category = np.array([int(abs(x)).bit_length() for x in d])
    extra = np.where(d > 0, d, d + (1 << category) - 1)
    return (category << category) | extra, 4 + category


_CODE, _BITS = _differences()


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """JPEG files of (n, SIDE, SIDE) 8-bit frames."""
    x = frames.astype(np.int32)
    d = x.copy()
    d[:, :, 1:] -= x[:, :, :-1]
    d[:, 1:, 0] -= x[:, :-1, 0]
    d[:, 0, 0] -= 128
    d = d.reshape(len(x), FRAME) + 255
    bits = _BITS[d]
    ends = np.cumsum(bits, axis=1)
    size = (ends[:, -1] + 7) >> 3
    base = np.concatenate([[0], np.cumsum(size)])
    at = ends - bits + base[:-1, None] * 8
    code = (_CODE[d] << (24 - (at & 7) - bits)).ravel()
    byte, n = (at >> 3).ravel(), int(base[-1]) + 2
    data = np.bincount(byte, code >> 16, n) + np.bincount(byte + 1, code >> 8 & 255, n) + np.bincount(byte + 2, code & 255, n)
    data = data[: n - 2].astype(np.uint8)
    data[base[1:] - 1] |= ((1 << (size * 8 - ends[:, -1])) - 1).astype(np.uint8)
    full = np.flatnonzero(data == 255)
    cuts = base + np.searchsorted(full, base)
    raw = np.insert(data, full + 1, 0).tobytes()
    return [_HEAD + raw[a:b] + _TAIL for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class _Scan:
    """What the markers before a scan say: the frame's size, and difference and length of a code by the next 16 bits."""

    def __init__(self, head: bytes):
        at, self.side, table = 2, None, None
        while at < len(head):
            mark, size = struct.unpack(">HH", head[at : at + 4])
            body = head[at + 4 : at + 2 + size]
            if mark == 0xFFC4:
                table = body
            elif mark == 0xFFC3:
                precision, height, width, parts = struct.unpack(">BHHB", body[:6])
                if precision != 8 or parts != 1:
                    raise ValueError("only grey frames of 8 bits are read")
                self.side = (height, width)
            elif mark == 0xFFDA and body[3] != 1:
                raise ValueError("only predictor 1 is read")
            at += 2 + size
        if table is None or self.side is None:
            raise ValueError("no table or no frame header before the scan")
        self.difference, self.length = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.uint8)
        code, k = 0, 17
        for n, count in enumerate(table[1:17], 1):
            for category in table[k : k + count]:
                total = n + category
                if total > 16:
                    raise ValueError("a code with its bits is longer than 16")
                extra = np.arange(1 << category)
                value = np.where(extra >> max(category - 1, 0) & 1 if category else extra == 1, extra, extra - (1 << category) + 1)
                first = code << (16 - n)
                span = slice(first, first + (1 << (16 - n)))
                self.difference[span] = np.repeat(value, 1 << (16 - total))
                self.length[span] = total
                code += 1
            k += count
            code <<= 1


_scans: dict[bytes, _Scan] = {}


def _scan_of(jpeg: bytes) -> tuple[_Scan, int]:
    at = jpeg.index(b"\xff\xda")
    at += 2 + struct.unpack(">H", jpeg[at + 2 : at + 4])[0]
    head = jpeg[:at]
    if head not in _scans:
        _scans[head] = _Scan(head)
    return _scans[head], at


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """The (n, height, width) frames of JPEG files that share one header."""
    scan, at = _scan_of(jpegs[0])
    if any(j[:at] != jpegs[0][:at] for j in jpegs):
        raise ValueError("frames of one group share their header")
    parts = [j[at:-2] for j in jpegs]
    base = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    stuffed = np.flatnonzero((data[:-1] == 255) & (data[1:] == 0)) + 1
    data = np.concatenate([np.delete(data, stuffed), np.zeros(4, np.uint8)]).astype(np.uint32)
    words = data[:-3] << 16 | data[1:-2] << 8 | data[2:-1]
    place = (base[:-1] - np.searchsorted(stuffed, base[:-1])) * 8
    height, width = scan.side
    out = np.empty((height * width, len(jpegs)), dtype=np.int16)
    for k in range(height * width):
        ahead = words[place >> 3] >> (8 - (place & 7)).astype(np.uint32) & 0xFFFF
        out[k] = scan.difference[ahead]
        place += scan.length[ahead]
    d = out.T.reshape(len(jpegs), height, width).astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(jpegs: list[bytes], rate: int = RATE) -> bytes:
    avih = struct.pack("<14I", 1_000_000 // rate, 0, 0, 0x10, len(jpegs), 0, 1, max(map(len, jpegs), default=0), SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(jpegs), 0, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    frames, index, at = [], [], 4
    for j in jpegs:
        frames.append(_chunk(b"00dc", j))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(j)))
        at += len(frames[-1])
    body = b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(frames)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _lists(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        yield name, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> tuple[list[bytes], float]:
    """The frames' files, by the index if there is one, and the frames in a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi = index = None
    rate = float(RATE)
    for name, a, b in _lists(data, 12, len(data)):
        if name == b"LIST" and data[a : a + 4] == b"movi":
            movi = (a, b)
        elif name == b"LIST" and data[a : a + 4] == b"hdrl":
            avih = next(p for n, p, _ in _lists(data, a + 4, b) if n == b"avih")
            rate = 1e6 / struct.unpack("<I", data[avih : avih + 4])[0]
        elif name == b"idx1":
            index = (a, b)
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        return [data[a:b] for n, a, b in _lists(data, movi[0] + 4, movi[1]) if n[2:] == b"dc"], rate
    found = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", data[index[0] : index[1]]):
        if name[2:] == b"dc":
            a = movi[0] + offset + 8
            found.append(data[a : a + size])
    return found, rate


def shots(frames: np.ndarray) -> list[tuple[int, int, int]]:
    """(first frame, last frame, mean grey) of each shot."""
    n = len(frames)
    flat = frames.reshape(n, -1)
    grey = np.bincount((np.arange(n)[:, None] * BINS + (flat >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    moved = np.abs(np.diff(grey, axis=0)).sum(axis=1).astype(np.float64)
    sums, squares = (np.concatenate([[0.0], np.cumsum(v)]) for v in (moved, moved * moved))
    t = np.arange(len(moved))
    low = np.maximum(t - RECENT, 0)
    count = np.maximum(t - low, 1)
    mean = (sums[t] - sums[low]) / count
    deviation = np.sqrt(np.maximum((squares[t] - squares[low]) / count - mean * mean, 0))
    usual = np.where(t - low >= 2, mean + SPREAD * deviation, FRAME)
    cuts = [0, *(np.flatnonzero(moved > np.maximum(usual, FLOOR)) + 1).tolist(), n]
    total = np.concatenate([[0], np.cumsum(flat.sum(axis=1, dtype=np.int64))])
    return [(a, b - 1, int(total[b] - total[a]) // ((b - a) * flat.shape[1])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def to_avi(payload: bytes) -> bytes:
    x = np.frombuffer(payload, dtype=np.uint8).reshape(-1, SIDE, SIDE)
    return write_avi([j for k in range(0, len(x), GROUP) for j in encode_frames(x[k : k + GROUP])])


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b"\xff" * (-len(data) % FRAME or (FRAME if not data else 0))


def _groups(texts):
    """Lists of (place, bytes, payload) that hold about GROUP frames."""
    group, frames = [], 0
    for k, t in enumerate(texts):
        n, payload = padded(t)
        group.append((k, n, payload))
        frames += len(payload) // FRAME
        if frames >= GROUP:
            yield group
            group, frames = [], 0
    if group:
        yield group


def _stored(payloads: list[bytes]) -> list[bytes]:
    x = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, SIDE, SIDE)
    jpegs = [j for k in range(0, len(x), GROUP) for j in encode_frames(x[k : k + GROUP])]
    files, at = [], 0
    for p in payloads:
        n = len(p) // FRAME
        files.append(write_avi(jpegs[at : at + n]))
        at += n
    return files


def _read_back(files: list[bytes]) -> list[np.ndarray]:
    each = [read_avi(f)[0] for f in files]
    every = [j for jpegs in each for j in jpegs]
    frames = np.concatenate([decode_frames(every[k : k + GROUP]) for k in range(0, len(every), GROUP)])
    return np.split(frames, np.cumsum([len(j) for j in each])[:-1])


def media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media column ``avi`` (binary) of every row."""
    small_batches(docs.sparkSession, 256)

    def run(batches):
        for b in batches:
            rows = [(n, f) for g in _groups(b.column(1).to_pylist()) for (_, n, _), f in zip(g, _stored([p for _, _, p in g]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([f for _, f in rows], pa.binary())], ["doc_id", "n_bytes", "avi"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, avi binary")


def clips(files: DataFrame, doc_id: str = "doc_id", avi: str = "avi") -> DataFrame:
    """A row for each shot of a media column: doc_id, clip, start_frame, end_frame, start_s, end_s, grey."""

    def run(batches):
        for b in batches:
            rows = []
            for i, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if f is None:
                    continue
                rate = read_avi(f)[1]
                rows += [(i, k, a, z, a / rate, (z + 1) / rate, g) for k, (a, z, g) in enumerate(shots(_read_back([f])[0]))]
            yield pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(["doc_id", "clip", "start_frame", "end_frame", "start_s", "end_s", "grey"])}, schema=pa.schema([("doc_id", b.schema.field(0).type), ("clip", pa.int32()), ("start_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("grey", pa.int32())]))

    kind = files.schema[doc_id].dataType.simpleString()
    return files.select(doc_id, avi).mapInArrow(run, f"doc_id {kind}, clip int, start_frame int, end_frame int, start_s double, end_s double, grey int")


MADE = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_clips")


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns MADE of every row: its text is stored as a file, and the rest comes from what is read back from it.

    ``feature`` lists the shots as first frame, last frame and mean grey.
    """
    small_batches(docs.sparkSession, 256)

    def run(batches):
        for b in batches:
            rows = []
            for group in _groups(b.column(1).to_pylist()):
                files = _stored([p for _, _, p in group])
                for (_, n, _), f, x in zip(group, files, _read_back(files), strict=True):
                    back, found = x.tobytes(), shots(x)
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(f), hashlib.sha256(f).hexdigest(), ";".join(f"{a}-{z}:{g}" for a, z, g in found), len(found)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], list(MADE))

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_clips bigint")
