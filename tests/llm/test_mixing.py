import hashlib
import random
import re

from spanwright.llm.mixing import mix, mixture


def by_hand(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows if s is not None}, key=lambda s: [ord(c) for c in s]) + [None] * any(s is None for _, _, s in rows)
    own = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, target, free = sum(own.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * own[s]}
        if not over:
            target.update({s: weight[s] * level for s in free})
            break
        target.update({s: 3.0 * own[s] for s in over})
        free -= over
    taken = {}
    for s in names:
        rounds = int(target[s] // own[s]) if own[s] else 0
        budget, sums, chosen = target[s] - rounds * own[s], 0, set()
        groups = {}
        for i, t, x in rows:
            if x == s:
                h = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
                groups.setdefault(h, []).append((i, t))
        for h in sorted(groups):
            here = sum(size(t) for _, t in groups[h])
            if sums + here > budget:
                if sums + here - budget < budget - sums:
                    chosen.add(h)
                break
            sums += here
            chosen.add(h)
        for h, members in groups.items():
            for i, t in members:
                taken.setdefault((i, t, s), size(t) * (rounds + (h in chosen)))
    return own, target, taken, size


def test_mixture_against_brute_force(spark):
    r = random.Random(1)
    rows = [(k, " ".join(["w"] * r.randint(0, 40)), r.choice(["a", "a", "a", "a", "b", "c", "é", None])) for k in range(400)]
    rows += [(900, None, "a"), (901, "\t \n", "z"), (902, " x\x0by ", "tiny"), (5, "twice here", "a"), (5, "twice here", "a"), (None, "no id", "a"), (None, "no id too", None), (903, "word " * 30000, "b")]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id bigint, text string, source string, size string")
    own, target, taken, size = by_hand(rows)
    key = lambda x: (str(x[0]), x[1], x[4])
    want = sorted(((i, size(t), own[s], target[s], taken[i, t, s]) for i, t, s in rows), key=key)
    got = sorted(map(tuple, mixture(docs).collect()), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-6 and g[4] == w[4], (g, w)
    assert all(g[4] <= 3 * g[1] for g in got)
    again = mix(docs)
    assert again.columns == docs.columns
    assert again.where("text is not null").count() >= 1
    assert sum(size(x.text) for x in again.collect()) == sum(g[4] for g in got)


def test_one_source_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "c", "s")], "doc_id bigint, text string, source string")
    assert sorted(map(tuple, mixture(docs).collect())) == [(1, 2, 3, 3.0, 2), (2, 1, 3, 3.0, 1)]
    assert mixture(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0


def test_empty_documents_of_a_source_taken_whole_rounds(spark):
    docs = spark.createDataFrame([(k, "a b c" if k < 3 else "", "small") for k in range(40)] + [(100 + k, "w " * 500, "large") for k in range(5)], "doc_id bigint, text string, source string")
    target = {r.doc_id: r.target / r.source_size for r in mixture(docs).collect()}
    times = {r.doc_id: r["count"] for r in mix(docs).groupBy("doc_id").count().collect()}
    assert target[0] == 3 and max(times.values()) <= 3 and all(times[k] == 3 for k in range(3))


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "x", "y", 2)], "doc_id bigint, text string, source string, _k string, `a.b` string, rounds int")
    assert [tuple(r) for r in mix(docs).collect()] == [(1, "a b", "s", "x", "y", 2)]
