"""Audit of a submission: shape, ids, order, bounds and repeats, as one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import normalize_label
from ..functions.spans import valid

COUNTERS = ("row_count", "duplicate_submission_rows", "malformed_span_count", "illegal_or_invalid_span_count", "duplicate_span_count", "sample_id_mismatch_count", "missing_prediction_rows", "extra_prediction_rows")


def _integer(span: Column, key: str) -> Column:
    """What int() makes of a JSON value: numbers are cut, digits in strings read, true is 1; null if it can't."""
    path = f"$.{key}"
    value = F.variant_get(span, path, "variant")
    kind, shown = F.schema_of_variant(value), F.try_variant_get(span, path, "string")
    number = F.try_variant_get(span, path, "double")
    return (
        F.when(value.isNull(), F.lit(None).cast("bigint"))
        .when(kind == "BIGINT", F.try_variant_get(span, path, "bigint"))
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("bigint"))
        .when(kind == "BOOLEAN", F.try_variant_get(span, path, "boolean").cast("bigint"))
        .when((kind == "STRING") & shown.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"), F.replace(F.trim(shown), F.lit("_"), F.lit("")).try_cast("bigint"))
    )


def span_checks(row: DataFrame, length: Column) -> DataFrame:
    """``row`` (value: JSON text) with malformed, illegal and repeated: counts over its spans."""
    spans = F.variant_get(F.try_parse_json("value"), "$.pred_spans", "variant")
    is_list = F.coalesce(F.startswith(F.schema_of_variant(spans), F.lit("ARRAY")), F.lit(False))
    each = F.when(is_list, F.coalesce(F.try_variant_get(spans, "$", "array<variant>"), F.array().cast("array<variant>"))).otherwise(F.array().cast("array<variant>"))

    def one(s: Column) -> Column:
        is_map = F.coalesce(F.startswith(F.schema_of_variant(s), F.lit("OBJECT")), F.lit(False))
        start, end, label = _integer(s, "start"), _integer(s, "end"), F.variant_get(s, "$.label", "variant")
        name = normalize_label(F.try_variant_get(s, "$.label", "string"))
        ok = start.isNotNull() & end.isNotNull() & label.isNotNull() & valid(start, end, name, length)
        return F.struct((~is_map).alias("malformed"), (is_map & ~ok).alias("illegal"), F.when(is_map & ok, F.struct(start.alias("a"), end.alias("b"), name.alias("l"))).alias("own"))

    row = row.withColumn("_list", is_list).withColumn("_checks", F.transform(each, one))
    owned = F.filter(F.transform("_checks", lambda c: c["own"]), lambda o: o.isNotNull())
    count = lambda name: F.size(F.filter("_checks", lambda c: c[name]))
    return row.withColumns({"malformed": F.when(F.col("_list"), count("malformed")).otherwise(1), "illegal": count("illegal"), "repeated": F.size(owned) - F.size(F.array_distinct(owned))}).drop("_list", "_checks")


def counters(submission: DataFrame, test: DataFrame | None = None, expected_rows: int | None = None) -> DataFrame:
    """One row with COUNTERS, expected_row_count_mismatch and strict_pass.

    ``submission`` has (row_idx, value: JSON text), ``test`` (row_idx, sample_id, text). The two
    are paired by row number. A row may count for several faults.
    """
    own = submission.withColumn("sample_id", F.coalesce(F.get_json_object("value", "$.sample_id"), F.lit("None")))
    if test is None:
        pairs = own.withColumns({"_own": F.lit(True), "_test": F.lit(False), "test_id": F.lit(None).cast("string"), "length": F.lit(None).cast("int")})
    else:
        told = test.select("row_idx", F.coalesce("sample_id", F.lit("None")).alias("test_id"), F.length(F.coalesce("text", F.lit(""))).alias("length"), F.lit(True).alias("_test"))
        pairs = own.withColumn("_own", F.lit(True)).join(told, "row_idx", "full_outer").withColumns({"_own": F.coalesce("_own", F.lit(False)), "_test": F.coalesce("_test", F.lit(False))})
    checked = span_checks(pairs, F.col("length"))
    has, paired = F.col("_own"), F.col("_own") & F.col("_test")
    total = lambda c: F.coalesce(F.sum(F.when(has, c)), F.lit(0)).cast("bigint")
    nameless = F.col("sample_id").isin("", "None").cast("int")
    other = F.when(paired, (F.col("sample_id") != F.col("test_id")).cast("int")).otherwise(0)
    sums = checked.agg(
        F.count_if(has).alias("row_count"),
        (F.count_if(has) - F.count_distinct(F.when(has, F.col("sample_id")))).alias("duplicate_submission_rows"),
        total(F.col("malformed")).alias("malformed_span_count"),
        total(F.col("illegal")).alias("illegal_or_invalid_span_count"),
        total(F.col("repeated")).alias("duplicate_span_count"),
        total(nameless + other).alias("sample_id_mismatch_count"),
        F.count_if(~has).alias("missing_prediction_rows"),
        (F.count_if(has & ~F.col("_test")) if test is not None else F.lit(0).cast("bigint")).alias("extra_prediction_rows"),
    )
    gap = F.abs(F.col("row_count") - expected_rows) if expected_rows is not None else F.lit(0)
    sums = sums.withColumn("expected_row_count_mismatch", gap.cast("bigint"))
    faults = [F.col(c) == 0 for c in sums.columns if c != "row_count"]
    ok = faults[0]
    for f in faults[1:]:
        ok = ok & f
    return sums.withColumn("strict_pass", ok)
