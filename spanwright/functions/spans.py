"""Operations on arrays of spans, per row and without a shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LABELS, SCORED, SPAN
from . import labels as L
from .arrays import let

NO_SPANS = f"array<{SPAN}>"


def gold_spans(annotations: Column) -> Column:
    """Annotations as evaluated: weight by band unless given, in scope by weight unless told, critical by band unless told."""

    def one(a: Column) -> Column:
        weight = F.coalesce(a["weight"], a["pcr_weight"], L.band_weight(a["risk_band"]))
        return F.struct(
            a["start"].alias("start"),
            a["end"].alias("end"),
            L.normalize_label(a["label"]).alias("label"),
            weight.alias("weight"),
            F.coalesce(a["pcr_in_scope"], weight > 0).alias("in_scope"),
            F.coalesce(a["critical_for_pcr"], L.is_critical(a["risk_band"])).alias("critical"),
        )

    return F.coalesce(F.transform(annotations, one), F.array().cast(NO_SPANS))


def source_gold_spans(annotations: Column) -> Column:
    """As :func:`gold_spans` for the nested source format: other names, and critical always by band."""

    def one(a: Column) -> Column:
        weight = F.coalesce(a["pcr_weight"], L.band_weight(a["risk_band"]))
        return F.struct(
            a["start_char"].alias("start"),
            a["end_char"].alias("end"),
            L.normalize_label(a["coarse_label"]).alias("label"),
            weight.alias("weight"),
            F.coalesce(a["pcr_in_scope"], weight > 0).alias("in_scope"),
            L.is_critical(a["risk_band"]).alias("critical"),
        )

    return F.transform(annotations, one)


def prediction_spans(spans: Column) -> Column:
    """Predicted spans as evaluated: normal labels, weight 1, in scope; null is none."""
    one = lambda s: F.struct(s["start"].alias("start"), F.coalesce(s["end"], s["start"]).alias("end"), L.normalize_label(s["label"]).alias("label"), F.lit(1.0).alias("weight"), F.lit(True).alias("in_scope"), F.lit(False).alias("critical"))
    return F.transform(F.coalesce(spans, F.array().cast(SCORED)), one)


def positive(spans: Column) -> Column:
    return F.filter(spans, lambda s: F.coalesce(s["in_scope"], s["weight"] > 0, F.lit(False)))


def total_weight(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0.0), lambda t, s: t + F.coalesce(s["weight"], F.lit(0.0)))


def matches(gold: Column, predicted: Column, tolerance: int, label_aware: bool = True) -> Column:
    """Greedy one-to-one matches as structs (g, p) of 0-based places.

    Gold spans come by falling weight, then by place. Each takes the free predicted span
    with the largest overlap, else the smallest gap up to ``tolerance``, then the largest
    weight, then the first.
    """
    order = F.array_sort(F.transform(gold, lambda s, k: F.struct((-F.coalesce(s["weight"], F.lit(0.0))).alias("w"), k.alias("g"), s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))
    told = F.transform(predicted, lambda s, k: F.struct(k.alias("k"), F.coalesce(s["weight"], F.lit(0.0)).alias("w"), s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    if not label_aware:
        return _greedy(order, told, tolerance)
    of = lambda spans, label: F.filter(spans, lambda s: s["label"] == label)
    by_label = lambda both: F.flatten(F.transform(F.array_distinct(F.transform(both["g"], lambda s: s["label"])), lambda label: _greedy(of(both["g"], label), of(both["p"], label), tolerance)))
    return let(F.struct(order.alias("g"), told.alias("p")), by_label)


def _greedy(order: Column, told: Column, tolerance: int) -> Column:
    """Pairs of one label, or of any. A span that is taken leaves the list, so each gold span looks at free ones alone."""

    def step(state: Column, g: Column) -> Column:
        def rank(s: Column) -> Column:
            overlap = F.greatest(F.lit(0), F.least(s["end"], g["end"]) - F.greatest(s["start"], g["start"]))
            gap = F.when(overlap > 0, 0).otherwise(F.least(F.abs(s["end"] - g["start"]), F.abs(g["end"] - s["start"])))
            return F.when(gap <= tolerance, F.struct(overlap.alias("o"), (-gap).alias("n"), s["w"].alias("w"), (-s["k"]).alias("k")))

        def taken(best: Column) -> Column:
            pair = F.struct(g["g"].alias("g"), (-best["k"]).alias("p"))
            return F.struct(F.when(best.isNull(), state["done"]).otherwise(F.array_append(state["done"], pair)).alias("done"), F.when(best.isNull(), state["free"]).otherwise(F.filter(state["free"], lambda s: s["k"] != -best["k"])).alias("free"))

        return let(F.array_max(F.transform(state["free"], rank)), taken)

    start = F.struct(F.array().cast("array<struct<g:int,p:int>>").alias("done"), told.alias("free"))
    return F.aggregate(order, start, step, lambda state: state["done"])


def covered(spans: Column, length: Column) -> Column:
    """Characters that the spans' union has within a text."""
    cut = F.array_sort(F.transform(spans, lambda s: F.struct(L.bounds(s["start"], s["end"], length)[0].alias("a"), L.bounds(s["start"], s["end"], length)[1].alias("b"))))
    step = lambda t, s: F.struct((t["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], t["to"]))).alias("n"), F.greatest(t["to"], s["b"]).alias("to"))
    return F.aggregate(cut, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda t: t["n"])


def confusion(gold: Column, predicted: Column, length: Column) -> dict[str, Column]:
    """Character counts, from lengths of unions alone: labels play no part."""
    g, p, both = covered(gold, length), covered(predicted, length), covered(F.concat(gold, predicted), length)
    return {"gold": g, "predicted": p, "tp": g + p - both, "fp": both - g, "fn": both - p, "other": F.greatest(F.lit(0), length - g)}


def valid(start: Column, end: Column, label: Column, length: Column | None = None) -> Column:
    """Whether a span has a known label, lies in order, and within the text if its length is known."""
    ok = label.isin(*LABELS) & (start >= 0) & (start < end)
    if length is not None:
        ok = ok & (length.isNull() | (end <= length))
    return F.coalesce(ok, F.lit(False))


def refine(text: Column, spans: Column, thresholds: Mapping[str, float], trim: str) -> Column:
    """Anchor refinement: by threshold, trimmed at both ends unless nothing would be left, distinct, in order.

    A label without threshold, or a kept span outside the text, raises an error.
    """
    scored = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), L.normalize_label(s["label"]).alias("label"), F.coalesce(s["score"], F.lit(0.0)).alias("score")))
    least = lambda s: L.lookup(s["label"], thresholds)

    def keep(s: Column) -> Column:
        known = F.when(least(s).isNull(), F.raise_error(F.concat(F.lit("no anchor threshold for label "), s["label"])).cast("boolean")).otherwise(s["score"] >= least(s))
        outside = (s["start"] < 0) | (s["start"] >= s["end"]) | (s["end"] > F.length(text))
        return known & F.when(outside, F.raise_error(F.lit("scored span outside its text")).cast("boolean")).otherwise(F.lit(True))

    def cut(s: Column) -> Column:
        inside = F.substring(text, s["start"] + 1, s["end"] - s["start"])
        left, whole = F.ltrim(inside, F.lit(trim)), F.btrim(inside, F.lit(trim))
        start = s["start"] + F.length(inside) - F.length(left)
        empty = F.length(whole) == 0
        return F.struct(F.when(empty, s["start"]).otherwise(start).alias("start"), F.when(empty, s["end"]).otherwise(start + F.length(whole)).alias("end"), s["label"].alias("label"))

    return F.array_sort(F.array_distinct(F.transform(F.filter(scored, keep), cut)))


def above_floor(spans: Column, floors: Mapping[str, float]) -> Column:
    return F.filter(spans, lambda s: s["score"] >= L.lookup(s["label"], floors, 0.0))


def bare(spans: Column) -> Column:
    """Spans without scores."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
