"""The corpus pipeline on a small corpus, each stage held against what a plain program makes of its input."""

import random
from collections import Counter

import corpus_pipeline as P
import public_tokenizers
from spanwright.llm.simhash import fingerprint
from spanwright.llm.tokens import WordTokenizer

WORDS = {"en": "the and that with from this have which their would about thing".split(), "de": "der und nicht dass mit auch eine über werden wird schön größe".split()}
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    r, rows = random.Random(11), []
    for k in range(80):
        lang = r.choice(list(WORDS))
        rows.append((k, " ".join(r.choice(WORDS[lang]) + r.choice("abcdefgh") for _ in range(r.randint(40, 90))), lang, r.choice(["a", "a", "a", "b", None])))
    secret = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    rows += [(100 + k, rows[k][1] + ("" if k % 2 else " "), rows[k][2], "b") for k in range(10)]
    rows += [(200, f"the and that token = {secret} with from this", "en", "a"), (201, None, "en", "a"), (202, "", None, "a"), (203, "12 34", "de", "b"), (204, rows[3][1] + " one two three more words here to differ from the first text", None, "b")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], secret


def test_stages(spark, tmp_path):
    rows, secret = corpus()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5 and names[1].startswith("SimHash")
    kept = P.STAGES[0][1](spark, docs, "")
    assert kept.columns == docs.columns
    found = {r.doc_id: r for r in kept.collect()}
    assert set(found) == {r[0] for r in rows} - {201, 202, 203} and found[204].lang in WORDS

    single = P.STAGES[1][1](spark, kept, "")
    prints = {i: fingerprint(found[i].text) for i in found}
    root = {i: i for i in prints}
    while True:
        links = [(a, b) for a in prints for b in prints if root[a] < root[b] and (prints[a] ^ prints[b]).bit_count() <= 3]
        if not links:
            break
        for a, b in links:
            low, high = sorted((root[a], root[b]))
            root.update({i: low for i in root if root[i] == high})
    assert {r.doc_id for r in single.collect()} == set(root.values()) and not {100, 101, 105} & set(root.values())

    clean = P.STAGES[2][1](spark, single, "")
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert set(texts) == set(root.values()) and secret not in texts[200] and "*" * 40 in texts[200]
    assert all(texts[i] == found[i].text for i in texts if i != 200)

    mixed = P.STAGES[3][1](spark, clean, "")
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(times.values()) <= 3 and set(times) <= set(texts)

    packed = P.STAGES[4][1](spark, mixed, "").collect()
    t = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(p.length for p in packed) == sum(n * (len(t.encode(texts[i])) // 4 + 1) for i, n in times.items())


def test_run(spark, tmp_path):
    rows, _ = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() > 50
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0


def test_stages_with_odd_rows(spark):
    long = " ".join(f"{a}{b}" for a in WORDS["en"] for b in range(9000))
    rows = [(1, long, "en", "a", len(long)), (2, None, None, None, None), (None, "the and that with from this have", "en", "a", 5), (None, "the and that with from this have", "en", "a", 5), (3, "", "de", "", 0), (4, "der und nicht dass mit auch eine", "de", "b", 5), (4, "der und nicht dass mit auch eine", "de", "b", 5), (5, "der und nicht dass mit auch eine", "de", None, 5)]
    extra = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(*r, "x", 0.5, "y") for r in rows], f"{extra}, _row string, score double, `a.b` string")
    kept = {"language ID": [None, None, 1, 4, 4, 5], "SimHash near-dedup": [None, None, 1, 4], "secret scans": [None, None, 1, 4]}
    for name, stage in P.STAGES[:-1]:
        for empty in (docs.limit(0), docs):
            out = stage(spark, empty, "")
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        if name in kept:
            assert sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i)) == kept[name], name
    packed = P.STAGES[-1][1](spark, docs, "").collect()
    assert {p.doc_id for p in packed} == {r.doc_id for r in docs.collect()} and all(0 <= p.offset <= 2048 - p.length for p in packed)
