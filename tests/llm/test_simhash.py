import random

import pytest
import xxhash
from pyspark.sql import functions as F

from spanwright.llm.common import settle
from spanwright.llm.components import components
from spanwright.llm.simhash import fingerprint, keep_one, links, near_duplicates


def by_hand(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b c D", "x y z x y z", "É\xa0a b c", "a\x1fb c d e", "w " * 70000])
def test_fingerprint(text):
    assert fingerprint(text) == by_hand(text)


def near(values):
    return [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3]


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("hot", [4096, 1])
def test_links_connect_what_brute_force_links(spark, hot):
    r = random.Random(3)
    values = set()
    for _ in range(12):
        v = r.getrandbits(64)
        for _ in range(6):
            values.add(v)
            for _ in range(r.randint(1, 4)):
                v ^= 1 << r.randrange(64)
    values |= {0, 1, 3, 7, 15, (1 << 64) - 1, (1 << 63)}
    values = sorted(values)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links(df, hot).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    assert groups(values, got) == groups(values, near(values))


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.label) for r in components(edges).collect()} == {(k, 0) for k in range(301)}
    assert components(edges.limit(0)).count() == 0


def test_components_of_shuffled_chains_trees_and_loops(spark, monkeypatch):
    r, written = random.Random(2), []
    monkeypatch.setattr("spanwright.llm.components.settle", lambda df, name: written.append(name) or settle(df, name))
    ids = r.sample(range(-5000, 5000), 1500)
    edges = [(a, b) for a, b in zip(ids[:1000], ids[1:1000])]
    edges += [(ids[k], ids[r.randrange(1000, k)]) for k in range(1001, 1400)] + [(ids[k], ids[k + 1 if k < 1449 else 1400]) for k in range(1400, 1450)]
    edges += [(7777, 7777), *edges[:5], *((b, a) for a, b in edges[:5])]
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: min(part) for part in (ids[:1000], ids[1000:1400], ids[1400:1450]) for i in part}
    assert got == want and written.count("labels") <= 15


def test_near_duplicates_with_odd_rows(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(r.choices(words, k=120)) for _ in range(8)]
    rows = [(k, base[k % 8] + (" extra" if k % 3 else ""), "x") for k in range(24)] + [(30, None, "x"), (31, "", None), (31, "", None), (None, base[0], "x"), (None, "alone here now then", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string")
    got = near_duplicates(docs).collect()
    fps = [fingerprint(t) for _, t, _ in rows]
    root = groups(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    want = []
    for k, (i, _, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root[m] == root[k] and rows[m][0] is not None]
        want.append((i, signed(fps[k]), min(ids, default=None)))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = [x.doc_id for x in keep_one(docs).collect()]
    assert sorted((x for x in kept if x is not None)) == sorted({w[2] for w in want if w[2] is not None})
    assert kept.count(None) == 2
    assert near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "a b c d e f", "g", "x", "y") for k in (3, 3, 4)] + [(9, "other words are here now", "g", "x", "y")], "doc_id bigint, text string, _gone string, `row` string, `a.b` string")
    assert sorted(tuple(r) for r in keep_one(docs).collect()) == [(3, "a b c d e f", "g", "x", "y"), (9, "other words are here now", "g", "x", "y")]


def test_small_tables_are_written_in_few_files(spark, monkeypatch):
    files = []

    def counted(df, name):
        out = settle(df, name)
        files.append((name, len(out.inputFiles())))
        return out

    monkeypatch.setattr("spanwright.llm.components.settle", counted)
    monkeypatch.setattr("spanwright.llm.simhash.settle", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    r = random.Random(9)
    rows = [(k, " ".join(r.choices("abcdefgh", k=4))) for k in range(400)]
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert found.count() == 400 and found.rdd.getNumPartitions() == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 4 and all(n == 1 for name, n in files if name in ("labels", "distinct"))
