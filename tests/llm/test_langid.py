import random
import zlib
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from spanwright.llm import langid
from spanwright.llm.langid import Labeller, features, fit, forward_backward, identify, keep_known, learn, sample

WORDS = {
    "en": "the and that with from this have which their would about thing other could people into than only".split(),
    "de": "der und nicht dass mit auch eine über werden wird schön größe zwischen durch haben weil straße noch".split(),
    "fr": "le les que pour dans une être avec très déjà où nous cette comme été leur même après".split(),
}


def text(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", ",", "."]) for _ in range(n))


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(1)
    length = np.array([4, 3, 1])
    score, moves, start = r.normal(size=(4, 3, 2)), r.normal(size=(2, 2)), r.normal(size=2)
    belief, pairs, total = forward_backward(score, length, moves, start)
    want_pairs, want_total = np.zeros((2, 2)), 0.0
    for c, n in enumerate(length):
        weights = {}
        for path in product(range(2), repeat=int(n)):
            s = start[path[0]] + sum(score[t, c, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            weights[path] = np.exp(s)
        z = sum(weights.values())
        want_total += np.log(z)
        for t in range(n):
            for y in range(2):
                assert abs(belief[t, c, y] - sum(w for p, w in weights.items() if p[t] == y) / z) < 1e-9
        for p, w in weights.items():
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w / z
    assert np.allclose(pairs, want_pairs) and abs(total - want_total) < 1e-9


def test_code_switched_text():
    r = random.Random(2)
    model = fit([(lang, text(r, lang, 120)) for lang in WORDS for _ in range(12)])
    labeller = Labeller(model)
    mixed = text(r, "en", 20) + " " + text(r, "fr", 40) + " " + text(r, "en", 20)
    lang, score, words, switches = labeller.label([mixed])[0]
    assert words == 80 and switches == 2 and lang in ("en", "fr") and 0.4 < score < 0.6
    assert (model.moves.diagonal() > model.moves.mean()).all()
    alone = labeller.label([text(r, "de", 5), "123 ...", None, text(r, "de", 5)])
    assert alone[0][0] == "de" and alone[1] == alone[2] == ("und", 0.0, 0, 0)
    assert features("12") == [] and "=ab" in features("a1b")


def test_identify(spark):
    r = random.Random(3)
    rows = [(k, text(r, lang, r.randint(3, 60)), lang) for k in range(240) for lang in [r.choice(list(WORDS))]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !!", "de"), (1003, text(r, "fr", 50000), None), (1004, "word" * 5000, "en"), (7, rows[7][1], rows[7][2]), (None, text(r, "de", 30), "fr")]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id bigint, text string, lang string, score double")
    got = identify(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score", "words", "switches"}
    truth, right = {i: lang for i, _, lang in rows[:240]}, []
    for g in got:
        assert 0 <= g.score <= 1
        assert g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 3 == 1)
        if g.held_out and g.doc_id in truth:
            right.append(g.lang_pred == truth[g.doc_id])
        if g.doc_id in (1000, 1001, 1002):
            assert (g.lang_pred, g.score) == ("und", 0.0)
        if g.doc_id is None:
            assert g.lang_pred == "de"
        if g.doc_id == 1003:
            assert g.lang_pred == "fr" and g.words == 50000
    assert np.mean(right) > 0.97
    kept = keep_known(docs)
    assert kept.columns == docs.columns
    ids = {x.doc_id: x.lang for x in kept.collect()}
    assert not {1000, 1001, 1002} & set(ids) and ids[1003] == "fr" and set(truth) <= set(ids)
    assert identify(docs.limit(0)).count() == 0
    unlabelled = identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {g.lang_pred for g in unlabelled} == {"und"}


def slowly(model, text):
    """What the labeller should say of a text, word by word in log space."""
    total, words, known, switches = np.zeros(len(model.labels)), 0, 0, 0
    for line in (text or "").lower().split("\n"):
        bare = ["".join(c for c in w if c.isalnum() and not c.isdecimal()) for w in line.split()]
        bare = [w for w in bare if w]
        for a in range(0, len(bare), langid.CHAIN):
            own, last = bare[a : a + langid.CHAIN], None
            score = [sum((model.weights[model.index[f]] for f in features(w) if f in model.index), np.zeros(len(model.labels))) for w in own]
            ahead, back = [model.start + score[0]], [np.zeros(len(model.labels))]
            for s in score[1:]:
                ahead.append(np.logaddexp.reduce(ahead[-1][:, None] + model.moves, axis=0) + s)
            for s in reversed(score[1:]):
                back.append(np.logaddexp.reduce(model.moves + s + back[-1], axis=1))
            for w, f, b in zip(own, ahead, reversed(back), strict=True):
                p = np.exp(f + b - np.logaddexp.reduce(f + b))
                if features(w):
                    total, words, known = total + p, words + 1, known + any(x in model.index for x in features(w))
                    switches += last is not None and last != p.argmax()
                    last = p.argmax()
    return (model.labels[int(total.argmax())], total.max() / words, words, switches, known) if words else ("und", 0.0, 0, 0, 0)


def test_whole_query_against_a_slow_program(spark):
    r = random.Random(6)
    rows = [(k, "\n".join(text(r, r.choice(list(WORDS)), r.randint(0, 200)) for _ in range(r.randint(1, 3))) + r.choice(["", " a1b 12 ²x ½ _ l'eau", " Ünï \u4f60\u597d x"]), r.choice([*WORDS, None])) for k in range(60)]
    rows += [(100, None, "en"), (101, "...\n\n7", "en"), (102, "\u03b1\u03b2\u03b3 \u03b4", None), (103, "x " * 3000, "de"), (104, "q" * 30000, "fr")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    model = learn(docs)
    want = {i: slowly(model, t) for i, t, _ in rows}
    got = {g.doc_id: g for g in identify(docs).collect()}
    assert got.keys() == want.keys()
    for i, (lang, score, words, switches, _) in want.items():
        assert (got[i].lang_pred, got[i].words, got[i].switches) == (lang, words, switches) and abs(got[i].score - score) < 1e-6, i
    kept = {x.doc_id for x in keep_known(docs).collect()}
    assert kept == {i for i, w in want.items() if w[4]} and not {100, 101, 102} & kept


def test_every_language_is_learned_from_a_bounded_sample(spark, monkeypatch):
    rows = [(k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}x{j}y" for j in range(900)), f"l{k % 100}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    monkeypatch.setattr(langid, "SAMPLE", 200)
    got = sample(docs)
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {lang for lang, _ in got} == learned and len(learned) > 90 and len(got) <= 200
    assert all(len(t.split()) <= langid.PIECES * langid.PIECE and max(map(len, t.split())) <= langid.LETTERS for _, t in got)
    whole = [(lang, t) for lang in WORDS for t in [text(random.Random(1), lang, 700)]]
    short = {x._1: x._2 for x in spark.createDataFrame(whole).select("_1", langid.shortened(F.col("_2")).alias("_2")).collect()}
    for lang, t in whole:
        cuts = [t.lower().split()[k : k + 16] for k in range(0, 700, 16)]
        assert short[lang].split() == [w for c in cuts[:: -(-len(cuts) // 16)] for w in c]


def test_no_row_goes_for_a_low_score_and_no_column_for_its_name(spark):
    r = random.Random(7)
    rows = [(k, text(r, lang, 40), lang, "a", 1.5, "b") for k in range(90) for lang in [r.choice(list(WORDS))]]
    rows += [(200, " ".join(text(r, lang, 1) for _ in range(20) for lang in WORDS), None, "a", 1.5, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string, score double, Words string")
    kept = keep_known(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id, x.lang_pred, x.score, x.Words) for x in kept.collect()) == sorted((x[0], *x[3:]) for x in rows)
