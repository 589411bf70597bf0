import hashlib
import random
import zlib

import numpy as np
import pytest

from spanwright.llm.avi import FRAME, MADE, clips, decode_frames, encode_frames, features, media, read_avi, shots, to_avi, write_avi


def slow_decode(jpeg):
    """One frame, bit by bit: canonical codes from its own table, predictor 1."""
    at = jpeg.index(b"\xff\xc4") + 5
    lengths, values, codes, code, k = jpeg[at : at + 16], jpeg[at + 16 :], {}, 0, 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            codes[n, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    start = jpeg.index(b"\xff\xda")
    data = jpeg[start + 2 + int.from_bytes(jpeg[start + 2 : start + 4], "big") : -2].replace(b"\xff\x00", b"\xff")
    bits = "".join(f"{x:08b}" for x in data)
    out, p = [], 0
    for s in range(576):
        n = next(n for n in range(1, 17) if (n, int(bits[p : p + n], 2)) in codes)
        c = codes[n, int(bits[p : p + n], 2)]
        p += n
        v = int(bits[p : p + c], 2) if c else 0
        p += c
        d = v if not c or v >> (c - 1) else v - (1 << c) + 1
        pred = 128 if s == 0 else out[s - 24] if s % 24 == 0 else out[s - 1]
        out.append((pred + d) & 255)
    return bytes(out)


def test_frames_round_trip():
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(0, 256, (40, 24, 24)), np.full((2, 24, 24), 255), np.zeros((2, 24, 24)), r.integers(0, 2, (20, 24, 24)) * 255]).astype(np.uint8)
    jpegs = encode_frames(x)
    assert (decode_frames(jpegs) == x).all()
    assert [slow_decode(j) for j in jpegs] == [f.tobytes() for f in x]
    assert all(b"\xff" not in j[-3:-2] for j in jpegs)


def test_avi_with_and_without_index():
    payload = bytes(range(256)) * 9
    data = to_avi(payload)
    jpegs, rate = read_avi(data)
    assert rate == 25 and len(jpegs) == 4 and decode_frames(jpegs).tobytes() == payload
    plain = data[: data.index(b"idx1")]
    assert read_avi(plain)[0] == jpegs
    assert int.from_bytes(data[4:8], "little") == len(data) - 8
    assert read_avi(write_avi([]))[0] == []
    with pytest.raises(ValueError):
        read_avi(b"RIFFxxxxWAVE")


def test_shots_at_changes():
    dark, light = np.full((12, 24, 24), 20, np.uint8), np.full((9, 24, 24), 200, np.uint8)
    assert shots(np.concatenate([dark, light, dark])) == [(0, 11, 20), (12, 20, 200), (21, 32, 20)]
    assert shots(dark[:1]) == [(0, 0, 20)]


def test_features(spark):
    r = random.Random(3)
    rows = [(k, "".join(r.choice("abcdé 😀\n") for _ in range(r.randint(0, 3000))), "x") for k in range(40)]
    rows += [(50, None, "x"), (51, "", None), (51, "", None), (None, "a" * 576, "x"), (52, "b" * 577, "x"), (53, "long text " * 150000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, feature string")
    got = features(docs).collect()
    assert tuple(features(docs).columns) == MADE
    want = {}
    for _, t, _ in rows:
        data = (t or "").encode()
        full = data + b"\xff" * ((-len(data)) % 576 or 576 * (not data))
        f = to_avi(full)
        want[hashlib.sha256(full).hexdigest()] = (len(data), len(full), zlib.crc32(full[-32:]), len(f), hashlib.sha256(f).hexdigest())
    assert sorted(str(g.doc_id) for g in got) == sorted(str(i) for i, _, _ in rows)
    for g in got:
        assert want[g.payload_sha256] == (g.n_bytes, g.payload_bytes, g.tail_crc32, g.media_bytes, g.media_sha256)
        spans = [tuple(map(int, s.split(":")[0].split("-"))) for s in g.feature.split(";")]
        assert spans[0][0] == 0 and spans[-1][1] == g.payload_bytes // FRAME - 1 and len(spans) == g.n_clips
    timed = clips(media(docs)).where("doc_id = 53").orderBy("clip").collect()
    assert timed[0].start_s == 0 and abs(timed[-1].end_s - (1500000 // 576 + 1) / 25) < 1e-9
    assert all(a.end_frame + 1 == b.start_frame for a, b in zip(timed, timed[1:]))
    assert features(docs.limit(0)).count() == 0 and clips(media(docs.limit(0))).count() == 0


def slow_encode(frame):
    """One frame's JPEG, bit by bit, with its header written out."""
    bits = ""
    for s, v in enumerate(frame):
        d = v - (128 if s == 0 else frame[s - 24] if s % 24 == 0 else frame[s - 1])
        c = abs(d).bit_length()
        bits += f"{c:04b}" + (f"{d if d > 0 else d + (1 << c) - 1:0{c}b}" if c else "")
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    head = "ffd8 ffc4001c00 00000009000000000000000000000000 000102030405060708 ffc3000b0800180018010111 00 ffda0008010100010000"
    return bytes.fromhex(head.replace(" ", "")) + data + b"\xff\xd9"


def slow_shots(frames):
    grey = [[sum(v // 16 == b for v in f) for b in range(16)] for f in frames]
    moved = [sum(abs(a - b) for a, b in zip(x, y)) for x, y in zip(grey, grey[1:])]
    cuts = [0]
    for t, m in enumerate(moved):
        recent = moved[max(0, t - 8) : t]
        mean = sum(recent) / len(recent) if recent else 0
        usual = mean + 2 * (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if len(recent) >= 2 else 576
        cuts += [t + 1] * (m > max(usual, 144))
    ends = [*cuts[1:], len(frames)]
    return ";".join(f"{a}-{z - 1}:{sum(map(sum, frames[a:z])) // ((z - a) * 576)}" for a, z in zip(cuts, ends))


def test_whole_query_against_a_slow_program(spark):
    r = random.Random(9)
    rows = [(k, "".join(r.choice(["abc", "   ", "é", "~~", "\n"])[: r.randint(1, 3)] * r.randint(1, 400) for _ in range(r.randint(0, 25)))) for k in range(12)] + [(20, None), (21, "\x7f" * 1152)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got, files = {g.doc_id: g for g in features(docs).collect()}, {g.doc_id: bytes(g.avi) for g in media(docs).collect()}
    for i, t in rows:
        data = (t or "").encode()
        whole = data + b"\xff" * (-len(data) % 576 or 576 * (not data))
        frames = [whole[k : k + 576] for k in range(0, len(whole), 576)]
        avi, jpegs = files[i], [slow_encode(f) for f in frames]
        movi, index = avi.index(b"movi"), avi.index(b"idx1")
        assert avi[:4] == b"RIFF" and int.from_bytes(avi[4:8], "little") == len(avi) - 8 and int.from_bytes(avi[index + 4 : index + 8], "little") == 16 * len(frames) == len(avi) - index - 8
        for k, j in enumerate(jpegs):
            entry = avi[index + 8 + 16 * k : index + 24 + 16 * k]
            at, size = movi + int.from_bytes(entry[8:12], "little"), int.from_bytes(entry[12:], "little")
            assert entry[:4] == avi[at : at + 4] == b"00dc" and avi[at + 8 : at + 8 + size] == j and slow_decode(j) == frames[k]
        want = (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), len(avi), hashlib.sha256(avi).hexdigest(), slow_shots(frames))
        assert tuple(got[i])[1:8] == want
    assert max(g.n_clips for g in got.values()) > 1
