"""Scalar functions on labels, ids, weights and ratios, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BAND_WEIGHTS

#: What str.strip() takes away, beyond Java's white space too.
_EDGES = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"


def normalize_label(value: Column) -> Column:
    """Trimmed, in upper case, with underscores for spaces and hyphens; null becomes empty."""
    return F.translate(F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), _EDGES, "")), " -", "__")


def source_prefix(sample_id: Column) -> Column:
    return F.substring_index(sample_id, ":", 1)


def safe_div(n: Column, d: Column, default: float = 0.0) -> Column:
    return F.when(d == 0, F.lit(float(default))).otherwise(n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)))


def lookup(key: Column, table: Mapping[str, float], default: float | None = None) -> Column:
    """A value from a small fixed table, by CASE."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def band_weight(band: Column) -> Column:
    return lookup(normalize_label(band), BAND_WEIGHTS, 0.0)


def is_critical(band: Column) -> Column:
    return normalize_label(band) == "CRITICAL"


def clamp(position: Column, length: Column) -> Column:
    return F.greatest(F.lit(0), F.least(position, length))


def bounds(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """Start and end within the text; an end before the start moves to it."""
    low = clamp(start, length)
    return low, F.greatest(low, clamp(end, length))


def stable_rank(sample_id: Column) -> Column:
    """The first 64 bits of the id's MD5 as hexadecimal text, whose order is that of the number."""
    return F.substring(F.md5(sample_id), 1, 16)


def canonical_id(sample_id: Column, dataset: Column, split: Column, source_id: Column, path: Column, line: Column) -> Column:
    """A record's own id, else dataset:split:source id, else file:line."""
    parts = F.when(source_id.isNotNull(), F.concat_ws(":", dataset, split, source_id))
    return F.coalesce(sample_id, parts, F.concat_ws(":", path, line.cast("string")))


def precision_recall_f1(tp: Column, predicted: Column, actual: Column) -> tuple[Column, Column, Column]:
    p, r = safe_div(tp, predicted, 1.0), safe_div(tp, actual, 1.0)
    return p, r, safe_div(2 * p * r, p + r, 0.0)


def f2(precision: Column, recall: Column) -> Column:
    return safe_div(5.0 * precision * recall, 4.0 * precision + recall, 0.0)
