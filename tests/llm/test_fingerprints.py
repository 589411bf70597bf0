import hashlib
import random

import xxhash

from spanwright.llm import fingerprints as fp
from spanwright.llm.fingerprints import _GEAR, chunk_ends, compare, edited, fingerprint, held, written


def slow_ends(data):
    h, start, ends = 0, 0, []
    for k, b in enumerate(data):
        h = ((h << 1) + int(_GEAR[b])) & 0xFFFFFFFF
        n = k + 1 - start
        low = h & 0xFFFF
        if n >= fp.MOST or n >= fp.NORMAL and not low & fp.EASY or n >= fp.LEAST and not low & fp.STRICT:
            ends.append(k + 1)
            start = k + 1
    return ends + [len(data)] * (start < len(data))


def test_chunks_against_a_byte_loop(monkeypatch):
    r = random.Random(1)
    for n in (0, 1, 15, 16, 255, 256, 257, 5000, 40000):
        data = bytes(r.choice(b"etaoin shrdlu\n") for _ in range(n))
        assert chunk_ends(data) == slow_ends(data)
    for data in (b"\0" * 3000, b"a" * 3000, bytes(r.randrange(256) for _ in range(3000))):
        assert chunk_ends(data) == slow_ends(data)
    monkeypatch.setattr(fp, "SLICE", 100)
    assert chunk_ends(data) == slow_ends(data)


def test_shift_changes_little():
    r = random.Random(2)
    text = " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(3000))
    assert held(fingerprint(text), fingerprint("inserted " + text)) > 0.98
    assert held(fingerprint(text), fingerprint(text)) == 1
    assert held(fingerprint(""), fingerprint("")) == 1 and held(fingerprint(""), fingerprint("a")) == 0 == held(fingerprint("a"), fingerprint(""))


def test_compare(spark):
    r = random.Random(3)
    rows = [(k * 3, "".join(r.choice("abcdé 😀\n") for _ in range(r.randint(0, 900))), "x") for k in range(80)]
    rows += [(500, None, "x"), (501, "", None), (502, "x" * 100000, "x"), (9, "again", "x"), (9, rows[3][1], "x"), (None, "null id", "x"), (None, None, "y")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string").repartition(6)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
    want = []
    for k, (i, t, _) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = edited(t, n)
        assert len(e) == len(t) - len(t) // 2 + min(len(n), len(t) // 2)
        a, b, c = map(fingerprint, (t, e, n))
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), written(a), written(b), held(a, b), held(a, c)))
    key = lambda x: (str(x[0]), x[2], x[3])
    assert sorted(map(tuple, compare(docs).collect()), key=key) == sorted(want, key=key)
    assert compare(docs.limit(0)).count() == 0
    one = compare(docs.where("doc_id = 502")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_whole_query_against_a_slow_program(spark):
    """Chunks by the byte loop, digests, fingerprints and likenesses all made here."""

    def chunks(text):
        data, out, start = text.encode(), {}, 0
        for end in slow_ends(data):
            out.setdefault(xxhash.xxh64(data[start:end]).hexdigest()[:12], end - start)
            start = end
        return out

    def likeness(a, b):
        return sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else float(not b)

    r = random.Random(7)
    shared = "".join(r.choice("etaoin shrdlu\né") for _ in range(1500))
    rows = [(k, r.choice(["", shared, shared[300:]]) + "".join(r.choice("abcdefgh ij") for _ in range(r.randint(0, 700)))) for k in range(30)] + [(40, None), (41, "")]
    got = {g.doc_id: g for g in compare(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        own, other, after = chunks(t), chunks(changed), chunks(following)
        shown = lambda found: " ".join(f"{d}:{n}" for d, n in found.items())
        assert tuple(got[i])[1:5] == (len(t), hashlib.sha256(changed.encode()).hexdigest(), shown(own), shown(other))
        assert abs(got[i].near_edited - likeness(own, other)) < 1e-12 and abs(got[i].near_next - likeness(own, after)) < 1e-12
    assert len({g.near_next for g in got.values()}) > 5
