"""Selection of one expert's complete output by source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import source_prefix


def route_of(sample_id: Column, routes: Mapping[str, str], default: str = "anchor") -> Column:
    """The expert of a sample's source; the routes are a small table by source."""
    if not routes:
        return F.lit(default)
    table = F.create_map(*(F.lit(x) for pair in sorted(routes.items()) for x in pair))
    return F.coalesce(F.try_element_at(table, source_prefix(sample_id)), F.lit(default))


def check_routes(routes: Mapping[str, str], default: str, experts: list[str]) -> None:
    absent = {default, *routes.values()} - set(experts)
    if absent:
        raise KeyError(f"routes name experts that are not there: {sorted(absent)}")


def aligned(experts: Mapping[str, DataFrame]) -> DataFrame:
    """Experts' rows (row_idx, sample_id, pred_spans) side by side: sample_id and a spans_<expert> column each.

    A row that some expert lacks, or ids that differ, raise an error when the row is used.
    """
    names = list(experts)
    out = None
    for n in names:
        own = experts[n].select("row_idx", F.col("sample_id").alias(f"id_{n}"), F.col("pred_spans").alias(f"spans_{n}"), F.lit(True).alias(f"has_{n}"))
        out = own if out is None else out.join(own, "row_idx", "full_outer")
    present = F.array(*(F.coalesce(F.col(f"has_{n}"), F.lit(False)) for n in names))
    ids = F.array(*(F.col(f"id_{n}") for n in names))
    fault = F.when(F.exists(present, lambda x: ~x), F.concat(F.lit("expert row counts differ at row "), F.col("row_idx").cast("string"))).when(F.exists(ids, lambda x: x.isNull()) | (F.size(F.array_distinct(ids)) != 1), F.concat(F.lit("expert sample_id mismatch at row "), F.col("row_idx").cast("string")))
    checked = F.when(fault.isNotNull(), F.raise_error(fault).cast("string")).otherwise(F.col(f"id_{names[0]}"))
    return out.select("row_idx", checked.alias("sample_id"), *(f"spans_{n}" for n in names))


def routed(side_by_side: DataFrame, experts: list[str], routes: Mapping[str, str], default: str = "anchor") -> DataFrame:
    """sample_id, expert, pred_spans (that expert's as a whole, null as none) and changed (from the default's)."""
    check_routes(routes, default, experts)
    kind = side_by_side.schema[f"spans_{experts[0]}"].dataType
    none = F.lit("[]") if kind.simpleString() == "string" else F.array().cast(kind)
    spans = {e: F.coalesce(F.col(f"spans_{e}"), none) for e in experts}
    rows = side_by_side.withColumn("expert", route_of(F.col("sample_id"), routes, default))
    chosen = none
    for e in experts:
        chosen = F.when(F.col("expert") == e, spans[e]).otherwise(chosen)
    keep = [c for c in ("row_idx", "sample_id") if c in rows.columns]
    return rows.select(*keep, "expert", chosen.alias("pred_spans"), ((F.col("expert") != default) & (chosen != spans[default])).alias("changed"))


def stats(selected: DataFrame) -> DataFrame:
    """(expert, n, changed) by chosen expert."""
    return selected.groupBy("expert").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"))
