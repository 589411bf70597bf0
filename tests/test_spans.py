import random

import pytest
from pyspark.sql import functions as F

from spanwright.functions import labels as L
from spanwright.functions import spans as S
from spanwright.schema import ANCHOR_THRESHOLDS, TRIM_CHARACTERS

SPAN = "array<struct<start:int,end:int,label:string,weight:double,in_scope:boolean,critical:boolean>>"


def spans(r, n, length):
    out = []
    for _ in range(n):
        a = r.randint(0, length)
        out.append((a, a + r.randint(0, 8), r.choice("AB"), r.choice([1.0, 2.0, 2.0, None]), r.choice([True, True, False, None]), r.random() < 0.3))
    return out


def is_positive(s):
    return s[4] if s[4] is not None else s[3] is not None and s[3] > 0


def greedy(gold, told, tolerance, aware):
    taken, pairs = set(), set()
    for g in sorted(range(len(gold)), key=lambda k: -(gold[k][3] or 0)):
        ranks = []
        for p, s in enumerate(told):
            overlap = max(0, min(s[1], gold[g][1]) - max(s[0], gold[g][0]))
            gap = 0 if overlap else min(abs(s[1] - gold[g][0]), abs(gold[g][1] - s[0]))
            if p not in taken and gap <= tolerance and (not aware or s[2] == gold[g][2]):
                ranks.append((overlap, -gap, s[3] or 0, -p))
        if ranks:
            taken.add(-max(ranks)[3])
            pairs.add((g, -max(ranks)[3]))
    return pairs


@pytest.mark.parametrize("tolerance,aware", [(0, True), (2, True), (2, False)])
def test_matches_and_confusion_against_brute_force(spark, tolerance, aware):
    r = random.Random(tolerance + aware)
    rows = [(k, spans(r, r.randint(0, 7), 40), spans(r, r.randint(0, 7), 40)) for k in range(150)]
    df = spark.createDataFrame(rows, f"k int, gold {SPAN}, told {SPAN}").withColumn("gold", S.positive(F.col("gold"))).withColumn("told", S.positive(F.col("told")))
    chars = S.confusion(F.col("gold"), F.col("told"), F.lit(40))
    got = {x.k: x for x in df.select("k", S.matches(F.col("gold"), F.col("told"), tolerance, aware).alias("m"), *(chars[n].alias(n) for n in ("tp", "fp", "fn", "other"))).collect()}
    for k, gold, told in rows:
        gold, told = [list(filter(is_positive, s)) for s in (gold, told)]
        assert {(m.g, m.p) for m in got[k].m} == greedy(gold, told, tolerance, aware)
        g, p = ({c for s in side for c in range(min(s[0], 40), min(s[1], 40))} for side in (gold, told))
        assert (got[k].tp, got[k].fp, got[k].fn, got[k].other) == (len(g & p), len(p - g), len(g - p), 40 - len(g))


def test_refinement(spark):
    text = "  (Anna), 😀 !!! 『x』"
    scored = [(0, 8, "person name", 0.9), (2, 8, "PERSON_NAME", 0.6), (12, 15, "CONTACT", 0.9), (9, 17, "CONTACT", 0.1), (16, 19, "CONTACT", 0.7), (3, 5, "PERSON_NAME", 0.5)]
    df = spark.createDataFrame([(text, scored)], "text string, s array<struct<start:int,end:int,label:string,score:double>>")
    got = df.select(S.refine(F.col("text"), F.col("s"), ANCHOR_THRESHOLDS, TRIM_CHARACTERS).alias("o")).first().o
    assert [tuple(x) for x in got] == [(3, 5, "PERSON_NAME"), (3, 7, "PERSON_NAME"), (12, 15, "CONTACT"), (17, 18, "CONTACT")]
    for bad in ([(0, 1, "NOBODY", 0.0)], [(0, 99, "CONTACT", 0.9)], [(3, 3, "CONTACT", 0.9)]):
        with pytest.raises(Exception, match="threshold|outside"):
            spark.createDataFrame([(text, bad)], df.schema).select(S.refine(F.col("text"), F.col("s"), ANCHOR_THRESHOLDS, TRIM_CHARACTERS).alias("o")).collect()
    low = spark.createDataFrame([(text, [(0, 99, "CONTACT", 0.1)])], df.schema)
    assert low.select(S.refine(F.col("text"), F.col("s"), ANCHOR_THRESHOLDS, TRIM_CHARACTERS).alias("o")).first().o == []


def test_labels_and_ratios(spark):
    df = spark.createDataFrame([(" person-name ",), (None,), ("\x1cA B",)], "v string")
    assert [x[0] for x in df.select(L.normalize_label(F.col("v"))).collect()] == ["PERSON_NAME", "", "A_B"]
    one = spark.range(1)
    assert one.select(L.safe_div(F.lit(1), F.lit(0), 0.5), L.safe_div(F.lit(1), F.lit(4)), L.source_prefix(F.lit("a:b:c")), L.source_prefix(F.lit("abc"))).first() == (0.5, 0.25, "a", "abc")
    b = one.select(*L.bounds(F.lit(-3), F.lit(99), F.lit(5)), *L.bounds(F.lit(4), F.lit(2), F.lit(5))).first()
    assert tuple(b) == (0, 5, 4, 4)


def test_gold_forms(spark):
    kind = "array<struct<start:int,end:int,label:string,risk_band:string,weight:double,pcr_weight:double,pcr_in_scope:boolean,critical_for_pcr:boolean,fine_labels:array<string>>>"
    rows = [([(0, 1, "contact", "critical", None, None, None, None, None), (0, 1, "x", "LOW", None, 0.0, None, None, None), (0, 1, "y", "?", 2.0, None, False, True, None)],), (None,)]
    got = [x[0] for x in spark.createDataFrame(rows, f"a {kind}").select(S.gold_spans(F.col("a"))).collect()]
    assert [(s.label, s.weight, s.in_scope, s.critical) for s in got[0]] == [("CONTACT", 4.0, True, True), ("X", 0.0, False, False), ("Y", 2.0, False, True)]
    assert got[1] == []
