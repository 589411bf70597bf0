"""Audit of experts by source and split, and the routes that follow from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spans as S
from ..functions.labels import source_prefix
from ..schema import EXPERTS
from .policy import evaluated, sample_metrics

#: The split that a file's name stands for in the audit.
SPLITS = {"development": "development", "heldout": "fresh"}


def check_complete(gold: DataFrame, predictions: Mapping[str, DataFrame]) -> None:
    """Raise KeyError if an expert lacks a gold row, ValueError if it has others. Ids are compared where they are; counts come back."""
    for expert, rows in predictions.items():
        both = gold.select("sample_id", F.lit(1).alias("g")).distinct().join(rows.select("sample_id", F.lit(1).alias("p")).distinct(), "sample_id", "full_outer")
        missing, extra = both.agg(F.count_if(F.col("p").isNull()), F.count_if(F.col("g").isNull())).first()
        if missing:
            raise KeyError(f"{expert} lacks {missing} predictions")
        if extra:
            raise ValueError(f"{expert} has {extra} extra predictions")


def details(gold: DataFrame, predictions: Mapping[str, DataFrame], **policy) -> DataFrame:
    """Metrics of every expert on every gold row: the experts' rows are stacked, so gold is joined once."""
    stacked = reduce(DataFrame.unionByName, (p.select("sample_id", "pred_spans", F.lit(e).alias("expert")) for e, p in predictions.items()))
    by = stacked.groupBy("sample_id").agg(*(F.max_by("pred_spans", F.when(F.col("expert") == e, 1)).alias(f"spans_{e}") for e in predictions))
    return details_beside(gold.join(by, "sample_id", "left"), list(predictions), **policy)


def details_beside(rows: DataFrame, experts: Sequence[str], **policy) -> DataFrame:
    """As :func:`details`, of gold rows that have each expert's spans beside them (``spans_<expert>``); no shuffle."""
    own = [c for c in rows.columns if c not in {f"spans_{e}" for e in experts}]
    each = F.array(*(F.struct(F.lit(e).alias("expert"), F.col(f"spans_{e}").alias("pred_spans")) for e in experts))
    return sample_metrics(_positive(rows.select(*own, F.explode(each).alias("x")).select(*own, "x.*")), **policy)


def _positive(rows: DataFrame) -> DataFrame:
    return rows.withColumn("gold", S.positive(F.col("gold"))).withColumn("predicted", S.positive(S.prediction_spans(F.col("pred_spans")))).drop("pred_spans")


def audit(rows: DataFrame) -> DataFrame:
    """(source, expert, split, rows, passes, pcr, coverage, critical, fp_rate) from details with a ``split``; split ``all`` holds both."""
    named = rows.withColumn("source", source_prefix(F.col("sample_id")))
    sums = named.groupingSets([["source", "expert", "split"], ["source", "expert"]], "source", "expert", "split").agg(
        F.grouping("split").alias("all"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if("policy_pass").alias("passes"),
        F.avg(F.col("policy_pass").cast("double")).alias("pcr"),
        F.avg("weighted_pii_coverage").alias("coverage"),
        F.avg("critical_coverage").alias("critical"),
        F.avg("fp_char_rate").alias("fp_rate"),
    )
    return sums.withColumn("split", F.when(F.col("all") == 1, "all").otherwise(F.col("split"))).drop("all")


def routes(audited: DataFrame, anchor: str = EXPERTS[0], order: Sequence[str] = EXPERTS[1:]) -> DataFrame:
    """(source, expert) for sources where an expert beats the anchor on development rows and is no worse on fresh ones.

    Of several, the largest gain over all rows wins, then the most passes, then the order given.
    """
    wide = audited.groupBy("source", "expert").agg(*(F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}") for s in ("development", "fresh", "all") for c in ("rows", "passes", "pcr")))
    base = wide.where(F.col("expert") == anchor).select("source", *(F.col(f"{s}_pcr").alias(f"base_{s}") for s in ("development", "fresh", "all")))
    rank = F.create_map(*(x for k, e in enumerate(order) for x in (F.lit(e), F.lit(k))))
    both = wide.where(F.col("expert").isin(*order)).join(base, "source")
    better = (F.coalesce("development_rows", F.lit(0)) > 0) & (F.col("development_pcr") > F.coalesce("base_development", F.lit(0.0)))
    steady = (F.coalesce("fresh_rows", F.lit(0)) == 0) | (F.col("fresh_pcr") >= F.coalesce("base_fresh", F.lit(0.0)))
    best = Window.partitionBy("source").orderBy((F.col("all_pcr") - F.col("base_all")).desc(), F.col("all_passes").desc(), F.element_at(rank, F.col("expert")))
    return both.where(better & steady).withColumn("nth", F.row_number().over(best)).where("nth = 1").select("source", "expert")


def single(gold: DataFrame, predictions: DataFrame, **policy) -> DataFrame:
    return sample_metrics(evaluated(gold, predictions), **policy)
