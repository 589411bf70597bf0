"""Document fingerprints by content-defined chunking.

A gear hash runs over a text's bytes; a chunk ends where its bits under a mask are zero.
Chunk lengths are normalised: below ``NORMAL`` bytes a stricter mask counts, beyond it an
easier one, within ``LEAST`` and ``MOST`` bytes. As boundaries depend on the last 16 bytes
alone, an insertion moves the chunks after it without changing them. A fingerprint is the set
of chunk digests with the chunks' lengths; what share of a text's length another holds is
the weight of the common digests over that of its own.

Defined results: a null text is empty; an empty text has the empty fingerprint, which is
held wholly by another empty one and not at all by others; null doc_ids come first in
order, and rows with equal doc_ids are ordered by text, so that each row's next is defined;
the only row of a table is its own next; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LEAST, NORMAL, MOST = 16, 64, 256
#: Of the hash's 16 bits, the upper ones depend on most bytes.
EASY, STRICT = 0xF800, 0xFE00
#: Bytes that are hashed at once, after the 15 before them.
SLICE = 1 << 20


def _gear(seed: int = 0x9E3779B9) -> np.ndarray:
    """A 16-bit number for each byte, from XXH64 of the byte."""
    return np.array([xxhash.xxh64_intdigest(bytes([k]), seed) & 0xFFFF for k in range(256)], dtype=np.uint16)


_GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 16 bytes' numbers, each shifted by its distance: the low 16 bits of the gear hash.

    Sums over 2, 4, 8 and 16 bytes follow from each other.
    """
    h = _GEAR[data]
    for n in (1, 2, 4, 8):
        longer = h.copy()
        longer[n:] += h[:-n] << n
        h = longer
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Where each chunk ends."""
    whole, ends, start = np.frombuffer(data, dtype=np.uint8), [], 0
    for at in range(0, len(whole), SLICE):
        before = max(at - 15, 0)
        h = gear_hashes(whole[before : at + SLICE])[at - before :]
        easy = np.flatnonzero((h & EASY) == 0)
        strict = (h[easy] & STRICT) == 0
        for end, hard in zip((easy + at + 1).tolist(), strict.tolist(), strict=True):
            while end - start > MOST:
                start += MOST
                ends.append(start)
            length = end - start
            if length >= NORMAL or hard and length >= LEAST:
                ends.append(end)
                start = end
    while len(whole) - start > MOST:
        start += MOST
        ends.append(start)
    if start < len(whole):
        ends.append(len(whole))
    return ends


def fingerprint(text: str) -> dict[int, int]:
    """Chunk digests (48 bits) with the chunks' lengths in bytes, in order of appearance."""
    data, found, start, digest = text.encode(), {}, 0, xxhash.xxh64_intdigest
    for end in chunk_ends(data):
        found[digest(data[start:end]) >> 16] = end - start
        start = end
    return found


def written(found: dict[int, int]) -> str:
    return " ".join([f"{d:012x}:{n}" for d, n in found.items()])


def held(found: dict[int, int], by: dict[int, int]) -> float:
    """The share of a fingerprint's weight that another one holds."""
    if not found:
        return float(not by)
    return sum([n for d, n in found.items() if d in by]) / sum(found.values())


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, closing) such that within a partition each row's next document is the next row.

    Ids are cut into ranges at sampled bounds, one partition each. The first row of each
    range is added at the end of the one before (``closing``), that of the first at the end
    of the last. Only bounds and each range's smallest id, one of each for a
    partition, come to the driver, and texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    cuts = [k / parts for k in range(1, parts)]
    bounds = np.unique(np.array(rows.stat.approxQuantile("doc_id", cuts, 0.25 / parts) if cuts else [], dtype=np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.fillna(np.iinfo(np.int64).min).astype(np.int64)
        return pd.Series(np.searchsorted(bounds, known, side="right").astype(np.int32))

    ranged = rows.withColumn("range", place("doc_id"))
    firsts = sorted((r.range, r.nulls == 0, r.first) for r in ranged.groupBy("range").agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect())
    if not firsts:
        return rows.withColumn("closing", F.lit(False))
    of = {(f if known else None): firsts[k - 1][0] for k, (_, known, f) in enumerate(firsts)}
    ids = [i for i in of if i is not None]
    wanted = F.col("doc_id").isin(ids) if ids else F.lit(False)
    heads = rows.where(wanted | F.col("doc_id").isNull() if None in of else wanted).groupBy("doc_id").agg(F.min("text").alias("text"))
    told = spark.createDataFrame([(i, r) for i, r in of.items()], "head bigint, range int")
    heads = heads.join(F.broadcast(told), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", "range", F.lit(True).alias("closing"))
    both = ranged.withColumn("closing", F.lit(False)).unionByName(heads)
    return both.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "closing", "doc_id", "text").select("doc_id", "text", "closing")


MADE = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns MADE: fingerprints of every text and of its edited text, and how much of the text's these and the next document's hold."""
    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in MADE.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        last = None
        for b in batches:
            rows = []
            for i, t, closing in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = fingerprint(t)
                if last is not None:
                    before, text_before, print_before = last
                    changed = edited(text_before, t)
                    other = fingerprint(changed)
                    rows.append((before, len(text_before), hashlib.sha256(changed.encode()).hexdigest(), written(print_before), written(other), held(print_before, other), held(print_before, own)))
                last = None if closing else (i, t, own)
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return with_next(docs, doc_id, text).mapInArrow(run, MADE)
