"""Risk-aware token tagging: alignment, loss, window averages and BIO decoding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import lookup
from ..schema import CATEGORY_PRIORITY, CATEGORY_WEIGHTS, OUTSIDE_WEIGHT, RISK_MULTIPLIERS, RISK_PRIORITY, TAGS

IGNORED = -100


def tag_table(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TAGS)), "label_id int, tag string")


def chosen_span(start: Column, end: Column, spans: Column) -> Column:
    """The span that a token belongs to: most overlap, then risk, category and length; the first of equals. Null without overlap."""

    def rank(s: Column, k: Column) -> Column:
        overlap = F.least(end, s["end"]) - F.greatest(start, s["start"])
        risk, category = lookup(s["risk_band"], RISK_PRIORITY, 0), lookup(s["label"], CATEGORY_PRIORITY, 0)
        return F.when(overlap > 0, F.struct(overlap.alias("o"), risk.alias("r"), category.alias("c"), (s["end"] - s["start"]).alias("n"), (-k).alias("k"), s.alias("span")))

    return F.array_max(F.filter(F.transform(spans, rank), lambda x: x.isNotNull()))["span"]


def tag_number(prefix: Column, label: Column) -> Column:
    return lookup(label, {t[2:]: k for k, t in enumerate(TAGS) if t[:2] == "B-"}) + F.when(prefix == "B", 0).otherwise(1)


def aligned(tokens: DataFrame) -> DataFrame:
    """``tokens`` (sample_id, start, end, train_spans) with label_id, tag and loss_weight.

    Empty (special) tokens are ignored; a span of unknown risk raises an error.
    """
    rows = tokens.withColumn("span", chosen_span(F.col("start"), F.col("end"), F.col("train_spans"))).drop("train_spans")
    prefix = F.when(F.col("start") == F.col("span.start"), "B").otherwise("I")
    risk = F.coalesce(lookup(F.col("span.risk_band"), RISK_MULTIPLIERS), F.raise_error(F.lit("unknown risk band")).cast("double"))
    empty, none = F.col("start") == F.col("end"), F.col("span").isNull()
    label = F.when(empty, IGNORED).when(none, 0).otherwise(tag_number(prefix, F.col("span.label")))
    weight = F.when(empty, 0.0).when(none, OUTSIDE_WEIGHT).otherwise(lookup(F.col("span.label"), CATEGORY_WEIGHTS) * risk)
    return rows.withColumn("label_id", label.cast("int")).withColumn("loss_weight", weight).drop("span")


def weighted_cross_entropy(rows: DataFrame, probability: str = "p") -> DataFrame:
    """One row, loss: over tokens that count, weighted -ln p over the weights' sum, 1 at least."""
    counted = rows.where(F.col("label_id") != IGNORED)
    total = F.sum(F.col("loss_weight") * -F.ln(F.col(probability)))
    return counted.agg((F.coalesce(total, F.lit(0.0)) / F.greatest(F.coalesce(F.sum("loss_weight"), F.lit(0.0)), F.lit(1.0))).alias("loss"))


def window_chunks(windows: DataFrame, size: int) -> DataFrame:
    return windows.withColumn("chunk", F.floor(F.col("window") / size).cast("int"))


def averaged(windows: DataFrame, size: int = len(TAGS)) -> DataFrame:
    """(sample_id, start, end, label_id, score): probabilities of equal offsets averaged over windows, and the first largest.

    Each of the ``size`` entries is summed as a column, so partial sums are made before
    the shuffle. Rows are dealt by sample once; decoding needs no other shuffle.
    """
    sums = [F.sum(F.get("probs", F.lit(k)).cast("double")).alias(f"p{k}") for k in range(size)]
    dealt = windows.where("start < end").repartition("sample_id")
    rows = dealt.groupBy("sample_id", "start", "end").agg(F.count(F.lit(1)).alias("n"), *sums)
    rows = rows.select("sample_id", "start", "end", F.array(*(F.col(f"p{k}") / F.col("n") for k in range(size))).alias("mean"))
    top = F.array_max("mean")
    return rows.select("sample_id", "start", "end", (F.array_position("mean", top) - 1).cast("int").alias("label_id"), top.alias("score"))


def decoded(entries: DataFrame) -> DataFrame:
    """(sample_id, ordinal, start, end, label, score) of the spans that token tags make.

    A span begins at B, at a change of label, after O, or after a gap; an I may begin one. It
    ends at its tokens' largest end, and its score is their mean. Of equal spans the first stays.
    """
    tag = F.element_at(F.array(*map(F.lit, TAGS)), F.col("label_id") + 1)
    rows = entries.withColumn("tag", tag).withColumn("entity", F.when(F.col("label_id") > 0, F.substring("tag", 3, 100)))
    order = Window.partitionBy("sample_id").orderBy("start", "end")
    rows = rows.withColumn("last_end", F.lag("end").over(order)).withColumn("last", F.lag("entity").over(order))
    begins = F.col("entity").isNotNull() & (F.startswith("tag", F.lit("B")) | F.col("last").isNull() | (F.col("last") != F.col("entity")) | (F.col("start") > F.col("last_end")))
    rows = rows.withColumn("island", F.sum(begins.cast("int")).over(order)).where("entity is not null")
    spans = rows.groupBy("sample_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("entity").alias("label"), F.avg("score").alias("score")).where("start < end")
    return spans.groupBy("sample_id", "start", "end", "label").agg(F.min("island").cast("int").alias("ordinal"), F.min_by("score", "island").alias("score")).select("sample_id", "ordinal", "start", "end", "label", "score")


def collected(spans: DataFrame, samples: DataFrame) -> DataFrame:
    """Prediction rows (sample_id, pred_spans) of all samples, those without spans too. A sample's spans are bounded by its text."""
    one = F.struct("ordinal", F.struct("start", "end", "label", "score").alias("s"))
    by = spans.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("pred_spans"))
    return samples.select("sample_id").join(by, "sample_id", "left").withColumn("pred_spans", F.coalesce("pred_spans", F.array().cast(by.schema["pred_spans"].dataType)))


def floored(spans: DataFrame, floors: Mapping[str, float]) -> DataFrame:
    return spans.where(F.col("score") >= lookup(F.col("label"), floors, 0.0))
