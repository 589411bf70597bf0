import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwright.operators import scoring as M
from spanwright.operators import tagging as T
from spanwright.operators import training as N
from spanwright.operators.anchor import moves, threshold_grid
from spanwright.schema import CATEGORY_PRIORITY, RISK_PRIORITY, TAGS

SPANS = "array<struct<start:int,end:int,label:string,risk_band:string,weight:double,critical_for_pcr:boolean>>"


def test_tags():
    assert len(TAGS) == 23 and TAGS[:3] == ("O", "B-PERSON_NAME", "I-PERSON_NAME") and TAGS[-1] == "I-TRANSACTION_ASSET"


def islands(entries):
    spans, current = [], None
    last_end = None
    for s, e, k, score in sorted(entries):
        tag = TAGS[k]
        if tag == "O":
            current = None
        elif current and tag[0] == "I" and current[2] == tag[2:] and s <= last_end:
            current[1] = max(current[1], e)
            current[3].append(score)
        else:
            current = [s, e, tag[2:], [score]]
            spans.append(current)
        last_end = e
    out = {}
    for s, e, label, scores in spans:
        if s < e:
            out.setdefault((s, e, label), sum(scores) / len(scores))
    return out


def test_decoding_against_brute_force(spark):
    r, rows = random.Random(3), []
    for k in range(120):
        at = 0
        for _ in range(r.randint(1, 15)):
            at += r.choice([0, 0, 1, 3])
            rows.append((f"s{k}", at, at + r.randint(1, 4), r.choice([0, 1, 2, 2, 3, 4]), r.randint(1, 8) / 8))
            at = rows[-1][2] - r.choice([0, 0, 0, 1])
    rows = list({(a, b, c): (a, b, c, d, e) for a, b, c, d, e in rows}.values())
    got = T.decoded(spark.createDataFrame(rows, "sample_id string, start int, end int, label_id int, score double").repartition(4)).collect()
    for k in {x[0] for x in rows}:
        want = islands([x[1:] for x in rows if x[0] == k])
        assert {(g.start, g.end, g.label): g.score for g in got if g.sample_id == k} == pytest.approx(want)
    lead = spark.createDataFrame([("a", 0, 2, 2, 0.5), ("a", 2, 4, 2, 1.0), ("a", 5, 6, 0, 1.0)], "sample_id string, start int, end int, label_id int, score double")
    assert [(x.start, x.end, x.label, x.score) for x in T.decoded(lead).collect()] == [(0, 4, "PERSON_NAME", 0.75)]


def test_alignment_against_brute_force(spark):
    r, rows = random.Random(5), []
    for k in range(200):
        spans = [(a, a + r.randint(1, 6), r.choice(["CONTACT", "AUTH_SECRET", "PERSON_NAME"]), r.choice(["LOW", "HIGH", "CRITICAL"]), 1.0, False) for a in [r.randint(0, 12) for _ in range(r.randint(0, 4))]]
        a = r.randint(0, 12)
        rows.append((f"s{k}", a, a + r.randint(0, 5), spans))
    got = {x.sample_id: x for x in T.aligned(spark.createDataFrame(rows, f"sample_id string, start int, end int, train_spans {SPANS}")).collect()}
    for i, a, b, spans in rows:
        tags, weights = N.targets([(a, b)], [dict(zip(("start", "end", "label", "risk_band"), s)) for s in spans])
        best = None
        for s in spans:
            o = min(b, s[1]) - max(a, s[0])
            key = (o, RISK_PRIORITY[s[3]], CATEGORY_PRIORITY[s[2]], s[1] - s[0])
            if o > 0 and (best is None or key > best[0]):
                best = (key, s)
        want = -100 if a == b else 0 if best is None else TAGS.index(("B-" if a == best[1][0] else "I-") + best[1][2])
        assert got[i].label_id == want == tags[0] and got[i].loss_weight == pytest.approx(weights[0])
    with pytest.raises(Exception, match="risk band"):
        T.aligned(spark.createDataFrame([("a", 0, 2, [(0, 2, "CONTACT", "?", 1.0, False)])], f"sample_id string, start int, end int, train_spans {SPANS}")).collect()


def test_loss(spark):
    df = spark.createDataFrame([(0, 0.15, 0.5), (1, 3.0, 0.25), (-100, 9.0, 0.1)], "label_id int, loss_weight double, p double")
    assert T.weighted_cross_entropy(df).first().loss == pytest.approx((0.15 * math.log(2) + 3 * math.log(4)) / 3.15)
    assert T.weighted_cross_entropy(df.limit(0)).first().loss == 0


def test_windows_and_prediction(spark):
    assert M.window_ranges(10, 4, 1) == [(0, 4), (3, 7), (6, 10)] and M.window_ranges(0, 4, 1) == [] and M.window_ranges(3, 4, 1) == [(0, 3)]
    with pytest.raises(ValueError):
        M.window_ranges(5, 4, 4)
    text = "write to ann@example.org or 10.0.0.1 today, card 1234 5678 1234 5678"
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None), ("d", "nothing here")], "sample_id string, text string")
    for size, stride in ((512, 128), (8, 6)):
        got = {x.sample_id: [(text[s.start : s.end], s.label) for s in x.pred_spans] for x in M.predict(df, max_length=size, stride=stride).collect()}
        assert got["b"] == got["c"] == got["d"] == []
        if size == 512:
            assert got["a"] == [("ann@example.org", "CONTACT"), ("10.0.0.1", "DIGITAL_ID"), ("1234 5678 1234 5678", "FINANCIAL_ACCOUNT")] or ("ann@example.org", "CONTACT") in got["a"]


def hash_scorer():
    class HashScorer:
        """Probabilities by a hash of text, token and window; tokens with empty, repeated and unordered offsets."""

        def tokens(self, text):
            r, out, at = random.Random(text), [], 0
            for _ in range(r.randint(0, 60) if text else 0):
                at += r.choice([0, 0, 1, 2])
                out.append((at, at + r.randint(0, 3)))
                out += out[-1:] * r.choice([0, 0, 0, 1, 2])
                at = out[-1][1]
            if text and text[-1] in "05":
                r.shuffle(out)
            return out

        def probabilities(self, text, tokens):
            r = random.Random(f"{text} {tokens}")
            return np.array([[r.choice([0, 1, 2, 3]) + (r.choice([0, 4]) if k < 5 else 0) for k in range(len(TAGS))] for _ in tokens]) / 8

    return HashScorer  # workers get a local class by value; they cannot import this module


def test_prediction_text_by_text_equals_the_tables(spark):
    scorer = hash_scorer()
    rows = [(f"s{k}", f"text {k}") for k in range(60)] + [("none", None), ("empty", "")]
    df = spark.createDataFrame(rows, "sample_id string, text string").repartition(3)
    for size, stride in ((8, 3), (4, 0), (7, 6), (500, 20)):
        want = T.collected(T.decoded(T.averaged(M.window_probabilities(df, scorer, size, stride))), df)
        shown = lambda rows: {r.sample_id: [(s.start, s.end, s.label, round(s.score, 9)) for s in r.pred_spans] for r in rows.collect()}
        got = M.predict(df, scorer, size, stride)
        assert shown(got) == shown(want) and sum(map(len, shown(got).values())) > 200
        assert got.select("sample_id", "pred_spans").dtypes == want.dtypes
    floors = {"PERSON_NAME": 0.8}
    kept = {r.sample_id: [s for s in r.pred_spans if s.label != "PERSON_NAME" or s.score >= 0.8] for r in got.collect()}
    assert {r.sample_id: r.pred_spans for r in M.predict(df, scorer, 500, 20, floors).collect()} == kept


def test_probabilities_leave_no_task(spark):
    """They are many times the texts: predict deals none anew, and their table comes in small batches."""
    df = spark.createDataFrame([(f"s{k}", "w " * 700) for k in range(40)], "sample_id string, text string")
    plan = M.predict(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan

    class Rows:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return [b.num_rows for b in run(iter(df.toArrow().to_batches()))]

    sizes = M.window_probabilities(Rows(), M.RuleScorer)
    assert sum(sizes) == 40 * (700 + 128) and max(sizes) < M.BATCH + 512


def test_threshold_grid(spark):
    def grid(*told, **more):
        out = {}
        for r in threshold_grid(spark, *told, **more).collect():
            out.setdefault(r.policy, {})[r.label] = r.threshold
        return [out[k] for k in sorted(out)]

    got = grid({"A": 0.5, "B": 0.94}, {"A": (0.05, 0.1, 0.0), "B": (-0.5,)}, {"A": 0.1, "B": 0.6})
    assert got == [{"A": 0.5, "B": 0.94}, {"A": 0.55, "B": 0.94}, {"A": 0.6, "B": 0.94}, {"A": 0.5, "B": 0.6}]
    assert grid({"A": 0.94}, {"A": (0.01, 0.02, 0.5)}, {"A": 0.0}) == [{"A": 0.94}, {"A": 0.95}]
    assert grid({"A": 0.4}, {}, {"A": 0.0}) == [{"A": 0.4}]
    r = random.Random(1)
    for _ in range(300):
        at, step = r.randint(0, 10000) / 10000, r.randint(-100000, 100000) / 200000
        near = round(min(0.95, max(0.1, at + step)), 4)
        assert moves(at, [step], 0.1, 0.95) == ([] if near == at else [near])


def test_training(tmp_path):
    assert sorted(sum((N.rank_order(7, 1, 0, 3, k) for k in range(3)), []))[:2] and len(N.rank_order(7, 1, 0, 3, 0)) == 3
    assert sorted(N.rank_order(5, 1, 2, 1, 0)) == list(range(5)) and N.rank_order(9, 1, 0, 2, 0) == N.rank_order(9, 1, 0, 2, 0)
    assert N.rate_at(0, 100, 1.0) == 0 and N.rate_at(6, 100, 1.0) == 1 and N.rate_at(100, 100, 1.0) == 0
    assert N.planned_updates(10, 2, {"epochs": 2, "raw_batch_size": 2}) == 6 and N.mean_loss([(2.0, 1), (4.0, 2)]) == 2
    records = [{"text": f"mail ann{k}@example.org now", "train_spans": [{"start": 5, "end": 20 + len(str(k)), "label": "CONTACT", "risk_band": "HIGH"}]} for k in range(30)]
    stages = {s: {"epochs": 6, "raw_batch_size": 5, "window_chunk_size": 2, "max_length": 16, "stride": 4, "learning_rate": 0.05} for s in N.STAGES}
    done = N.train_all(lambda s: records, tmp_path, stages=stages, workers=2)
    assert done["completed"] == list(N.STARTS_FROM)
    assert N.train_all(lambda s: records, tmp_path, stages=stages)["completed"] == [f"{s}:reused" for s in N.STARTS_FROM]
    tagger = N.LinearTagger.load(done["checkpoints"]["anchor_repair"])
    tokens = tagger.tokens("mail ann@example.org now")
    assert [TAGS[k] for k in tagger.probabilities("mail ann@example.org now", tokens).argmax(axis=1)][:2] == ["O", "B-CONTACT"]
    with pytest.raises(ValueError):
        N.train_linear([], stages["anchor_repair"], 1, None, tmp_path)
    with pytest.raises(FileNotFoundError):
        N.train_all(lambda s: records, tmp_path / "x", stages=stages, trainer=lambda *a: {})
    assert "plan" in N.train_all(lambda s: [], tmp_path, dry_run=True)
    assert np.isfinite(tagger.weights).all()


def test_ranks_exchange_their_gradients(spark, tmp_path, monkeypatch):
    records = [{"text": f"mail ann{k}@example.org now", "train_spans": [{"start": 5, "end": 20 + len(str(k)), "label": "CONTACT", "risk_band": "HIGH"}]} for k in range(12)]
    stage = {"epochs": 2, "raw_batch_size": 2, "window_chunk_size": 64, "max_length": 64, "stride": 4, "learning_rate": 0.05}
    summary = N.train_ranks(spark, 2)(records, stage, 5, None, tmp_path)
    assert (summary["ranks"], summary["updates"], summary["epochs"], summary["rows"]) == (2, 6, 2, 12)

    # The same by hand: each update takes the mean of the two ranks' slopes.
    tagger, losses = N.LinearTagger(), 0.0
    descent = N.AdamW(tagger.weights)
    for epoch in range(2):
        order = [N.rank_order(12, 5, epoch, 2, k) for k in range(2)]
        for at in range(0, 6, 2):
            both = [N.gradient(tagger, [records[k] for k in own[at : at + 2]], stage) for own in order]
            slope = (both[0][1] + both[1][1]) / 2
            losses += both[0][0] + both[1][0]
            descent.step(slope * min(1.0, N.CLIP / (np.linalg.norm(slope) + 1e-6)), N.rate_at(descent.steps, 6, 0.05))
    assert np.allclose(N.LinearTagger.load(tmp_path / "checkpoint.npz").weights, tagger.weights) and summary["loss"] == pytest.approx(losses / 12)
    monkeypatch.setenv("WORLD_SIZE", "2")
    with pytest.raises(ValueError, match="exchange"):
        N.train_linear(records, stage, 5, None, tmp_path)
