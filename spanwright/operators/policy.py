"""Policy evaluation: metrics by sample, and the corpus summaries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import spans as S
from ..schema import COVERAGE, CRITICAL, FALSE_POSITIVES, TOLERANCE, WORST


def evaluated(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each gold row (sample_id, dataset, text, gold) with ``predicted``; a missing prediction is none, others are ignored.

    Both sides keep their positive spans only.
    """
    told = predictions.select("sample_id", S.prediction_spans(F.col("pred_spans")).alias("predicted"))
    rows = gold.join(told, "sample_id", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast(S.NO_SPANS)))
    return rows.withColumn("gold", S.positive(F.col("gold"))).withColumn("predicted", S.positive(F.col("predicted")))


def _weight_at(spans: Column, places: Column) -> Column:
    return F.aggregate(places, F.lit(0.0), lambda t, k: t + F.coalesce(F.get(spans, k)["weight"], F.lit(0.0)))


def sample_metrics(rows: DataFrame, coverage: float = COVERAGE, critical: float = CRITICAL, false_positives: float = FALSE_POSITIVES, tolerance: int = TOLERANCE) -> DataFrame:
    """``rows`` of :func:`evaluated` with all metrics of a sample; no shuffle."""
    gold, told = F.col("gold"), F.col("predicted")
    rows = rows.withColumn("matched", S.matches(gold, told, tolerance)).withColumn("text_len", F.length(F.coalesce("text", F.lit(""))))
    places = {"g": F.transform("matched", lambda m: m["g"]), "p": F.transform("matched", lambda m: m["p"])}
    urgent = F.filter(gold, lambda s: F.coalesce(s["critical"], F.lit(False)))
    met = F.filter(places["g"], lambda k: F.coalesce(F.get(gold, k)["critical"], F.lit(False)))
    chars = S.confusion(gold, told, F.col("text_len"))
    rows = rows.select(
        "*",
        F.size(gold).alias("gt_count"),
        F.size(told).alias("pred_count"),
        S.total_weight(gold).alias("gt_weight"),
        S.total_weight(told).alias("pred_weight"),
        _weight_at(gold, places["g"]).alias("matched_gt_weight"),
        _weight_at(told, places["p"]).alias("matched_pred_weight"),
        S.total_weight(urgent).alias("critical_gt_weight"),
        _weight_at(gold, met).alias("matched_critical_gt_weight"),
        chars["gold"].alias("gt_char_count"),
        chars["predicted"].alias("pred_char_count"),
        S.covered(F.concat(gold, told), F.col("text_len")).alias("_both"),
    )
    c = F.col
    rows = rows.withColumns({"tp_char_count": c("gt_char_count") + c("pred_char_count") - c("_both"), "fp_char_count": c("_both") - c("gt_char_count"), "fn_char_count": c("_both") - c("pred_char_count"), "non_pii_char_count": F.greatest(F.lit(0), c("text_len") - c("gt_char_count"))}).drop("_both")
    rows = rows.withColumns({"weighted_pii_coverage": L.safe_div(c("matched_gt_weight"), c("gt_weight"), 1.0), "weighted_precision": L.safe_div(c("matched_pred_weight"), c("pred_weight"), 1.0), "critical_coverage": L.safe_div(c("matched_critical_gt_weight"), c("critical_gt_weight"), 1.0), "fp_char_rate": L.safe_div(c("fp_char_count"), c("non_pii_char_count"), 0.0)})
    rows = rows.withColumns({"risk_adjusted_f2": L.f2(c("weighted_precision"), c("weighted_pii_coverage")), "non_pii_preservation": 1.0 - c("fp_char_rate"), "coverage_pass": c("weighted_pii_coverage") >= coverage, "critical_pass": c("critical_coverage") >= critical, "fp_char_pass": c("fp_char_rate") <= false_positives})
    return rows.withColumn("policy_pass", c("coverage_pass") & c("critical_pass") & c("fp_char_pass"))


def _mean(name: str, where: Column | None = None) -> Column:
    value = F.col(name).cast("double")
    return F.coalesce(F.avg(value if where is None else F.when(where, value)), F.lit(0.0))


MACRO = {"policy_compliance_rate": "policy_pass", "weighted_pii_coverage": "weighted_pii_coverage", "weighted_precision": "weighted_precision", "critical_coverage": "critical_coverage", "fp_char_rate": "fp_char_rate", "non_pii_preservation": "non_pii_preservation", "risk_adjusted_f2": "risk_adjusted_f2"}
POSITIVE = [k for k in MACRO if k != "non_pii_preservation"]
NEGATIVE = ["policy_compliance_rate", "fp_char_rate", "non_pii_preservation"]
BY_DATASET = ["policy_compliance_rate", "weighted_pii_coverage", "weighted_precision", "critical_coverage", "fp_char_rate"]


def macro(details: DataFrame) -> DataFrame:
    """One row: means over all samples, and over those with and without gold spans (pos_, neg_)."""
    has = F.col("gt_count") > 0
    return details.agg(
        F.count(F.lit(1)).alias("n_samples"),
        *(_mean(v).alias(k) for k, v in MACRO.items()),
        F.count_if(has).alias("pos_n_samples"),
        *(_mean(MACRO[k], has).alias(f"pos_{k}") for k in POSITIVE),
        F.count_if(~has).alias("neg_n_samples"),
        *(_mean(MACRO[k], ~has).alias(f"neg_{k}") for k in NEGATIVE),
    )


def _total(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def micro(details: DataFrame) -> DataFrame:
    """One row: ratios of summed weights."""
    sums = details.agg(*(_total(n).cast("double").alias(n) for n in ("gt_weight", "pred_weight", "matched_gt_weight", "matched_pred_weight")))
    p, r = L.safe_div(F.col("matched_pred_weight"), F.col("pred_weight"), 1.0), L.safe_div(F.col("matched_gt_weight"), F.col("gt_weight"), 1.0)
    return sums.select(p.alias("weighted_precision"), r.alias("weighted_recall"), L.safe_div(2 * p * r, p + r).alias("weighted_f1"))


def characters(details: DataFrame) -> DataFrame:
    """One row: character counts and their ratios."""
    tn = F.greatest(F.lit(0), F.col("non_pii_char_count") - F.col("fp_char_count"))
    sums = details.withColumn("tn", tn).agg(*(_total(v).cast("bigint").alias(k) for k, v in {"tp_chars": "tp_char_count", "fp_chars": "fp_char_count", "fn_chars": "fn_char_count", "tn_chars": "tn", "chars": "text_len"}.items()))
    tp, fp, fn, tn, n = (F.col(k) for k in ("tp_chars", "fp_chars", "fn_chars", "tn_chars", "chars"))
    p, r, f1 = L.precision_recall_f1(tp, tp + fp, tp + fn)
    return sums.select("tp_chars", "fp_chars", "fn_chars", "tn_chars", p.alias("precision"), r.alias("recall"), f1.alias("f1"), L.safe_div(tp, tp + fp + fn, 1.0).alias("iou"), L.safe_div(tp + tn, n, 1.0).alias("accuracy"))


#: Level names with tolerance (None: that of the policy) and whether labels count. "Exact" asks for touching spans, not for equal bounds.
LEVELS = {"exact_label_aware": (0, True), "overlap_label_agnostic": (None, False), "overlap_label_aware": (None, True)}


def entities(details: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """A row for each of LEVELS: tp, fp, fn, precision, recall, f1."""
    found = details.select("gold", "predicted", *(F.size(S.matches(F.col("gold"), F.col("predicted"), tolerance if t is None else t, aware)).alias(k) for k, (t, aware) in LEVELS.items()))
    sums = found.agg(*(_total(k).cast("bigint").alias(k) for k in LEVELS), F.coalesce(F.sum(F.size("gold")), F.lit(0)).alias("g"), F.coalesce(F.sum(F.size("predicted")), F.lit(0)).alias("p"))
    rows = sums.select("g", "p", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col(k).alias("tp")) for k in LEVELS))).alias("x")).select("g", "p", "x.*")
    p, r, f1 = L.precision_recall_f1(F.col("tp"), F.col("p"), F.col("g"))
    return rows.select("level", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def label_hits(details: DataFrame) -> DataFrame:
    """(label, tp) of matches at tolerance 0."""
    hits = F.transform(S.matches(F.col("gold"), F.col("predicted"), 0), lambda m: F.get("gold", m["g"])["label"])
    return details.select(F.explode(hits).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("tp"))


def by_dataset(details: DataFrame) -> DataFrame:
    return details.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_samples"), *(_mean(MACRO[k]).alias(k) for k in BY_DATASET))


def worst(details: DataFrame, k: int = WORST, tie: str = "sample_id") -> DataFrame:
    """The k worst samples: a top-k without a full sort; ``tie`` orders equals (row_idx, where there is one)."""
    return details.orderBy("policy_pass", "critical_coverage", "weighted_pii_coverage", F.col("fp_char_rate").desc(), tie).limit(k)
