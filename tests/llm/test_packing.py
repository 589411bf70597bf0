import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spanwright.llm.packing import fullest, layout, pack, patterns
from spanwright.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_tokenizers(monkeypatch):
    t, own = Tokenizer.from_file(PATH), WordTokenizer(PATH)
    r = random.Random(1)
    words = ["don't", "It's", "Été", "STRASSE", "ß", "a²b", "½", "１", "ΣΑΣ", "İi", "́a", "é", "中文", "😀", "a\x1cb", "x y", "1234", "__", "_a_", "<|endoftext|>", "<|", "ŉ", "ǅ", "'ll", "''s", "\x7f", "\x00", "a​b", "naïve—word", "ªº"]
    for k in range(600):
        text = "".join(r.choice(words) + r.choice(["", " ", "  ", "\n", "\t", "\x0b"]) for _ in range(r.randint(0, 12)))
        assert own.encode(text) == np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def test_fullest_is_optimal():
    r = random.Random(4)
    for _ in range(300):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 5))}
        first = max(counts)
        got = fullest(counts, first, 32)
        assert all(got[n] <= counts[n] for n in got) and got[first] >= 1
        rest = [n for n, c in counts.items() for _ in range(c - (n == first))]
        sums = {first + sum(c) for k in range(len(rest) + 1) for c in combinations(rest, k)}
        waste = lambda s: 0 if s & (s - 1) == 0 else 32 - s
        total = sum(n * m for n, m in got.items())
        assert total <= 32 and waste(total) == min(waste(s) for s in sums if s <= 32)


def test_patterns_use_every_piece_once():
    r = random.Random(9)
    counts = {n: r.randint(0, 50) for n in range(1, 129)}
    used = Counter()
    for times, chosen in patterns(counts, 128):
        assert sum(n * m for n, m in chosen.items()) <= 128
        for n, m in chosen.items():
            used[n] += times * m
    assert used == Counter({n: c for n, c in counts.items() if c})
    assert layout([]) == {}


def test_pack(spark):
    r = random.Random(7)
    rows = [(k, " ".join(r.choice(["alpha", "beta", "Gamma's", "δ", "12"]) for _ in range(r.randint(0, 90))), "x") for k in range(150)]
    rows += [(200, None, "x"), (201, "", None), (5, rows[5][1], "x"), (None, "no id", "x"), (202, "long " * 40000, "x"), (203, " " * 50, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start string")
    got = pack(docs.repartition(5), PATH, 64).collect()
    t = Tokenizer.from_file(PATH)
    tokens = [(i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x, _ in rows]
    pieces = Counter((g.doc_id, g.start, g.length, g.ids_crc32, g.doc_tokens) for g in got)
    want = Counter()
    for i, ids in tokens:
        for a in range(0, len(ids), 64):
            p = ids[a : a + 64]
            want[i, a, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes()), len(ids)] += 1
    assert pieces == want
    by = defaultdict(list)
    for g in got:
        by[g.sequence_id].append((g.offset, g.length))
    padded = 0
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
        padded += 0 if at & (at - 1) == 0 else 64 - at
    assert padded < 0.02 * sum(len(ids) for _, ids in tokens) and set(by) == set(range(len(by)))
    assert pack(docs.limit(0), PATH, 64).count() == 0
