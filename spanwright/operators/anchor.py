"""Refinement of the anchor's scored spans, and the policies that thresholds are chosen from."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import refine
from ..schema import ANCHOR_THRESHOLDS, TRIM_CHARACTERS


def refined(scored: DataFrame, thresholds: Mapping[str, float] = ANCHOR_THRESHOLDS, trim: str = TRIM_CHARACTERS) -> DataFrame:
    """``scored`` (text, pred_spans with scores and others) with refined pred_spans."""
    return scored.withColumn("pred_spans", refine(F.coalesce("text", F.lit("")), F.col("pred_spans"), thresholds, trim))


def moves(at: float, steps: Iterable[float], floor: float, ceiling: float) -> list[float]:
    """The thresholds other than ``at`` that its steps lead to, each once; 4 digits of their exact binary value, which no SQL rounding gives."""
    places = (sorted((floor, at + step, ceiling))[1] for step in steps)
    held = dict.fromkeys(float(Decimal(x).quantize(Decimal("0.0001"), ROUND_HALF_EVEN)) for x in places)
    return [x for x in held if x != at]


def threshold_grid(spark: SparkSession, baseline: Mapping[str, float], steps: Mapping[str, Iterable[float]], floors: Mapping[str, float], ceiling: float = 0.95) -> DataFrame:
    """(policy, label, threshold): policy 0 is the baseline, each other one moves a single label.

    Two labels' moves never make the same policy, so leaving out a label's repeated moves leaves out all repeats.
    """
    moved = [(label, x) for label, at in baseline.items() for x in moves(at, steps.get(label, ()), floors[label], ceiling)]
    policies = spark.createDataFrame([(k, *m) for k, m in enumerate([(None, None), *moved])], "policy int, moved string, to double")
    whole = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(float(at)).alias("at")) for label, at in baseline.items()))
    return policies.withColumn("b", F.explode(whole)).select("policy", "b.label", F.when(F.col("moved") == F.col("b.label"), F.col("to")).otherwise(F.col("b.at")).alias("threshold"))
