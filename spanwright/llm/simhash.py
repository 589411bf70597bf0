"""SimHash near-duplicates by multi-index hashing.

Texts are lower-cased (A-Z only), cut into words and 3-word shingles; a bit of the
64-bit fingerprint is 1 if more than half of the shingles' XXH64 values have it.
Two fingerprints link if at most ``radius`` bits differ. A fingerprint has two
32-bit segments; of two fingerprints that differ in 3 bits at most, one segment
differs in one bit at most. So each fingerprint probes, for either segment, the table
of exact segment values with the small ball around its own value, and every match is
verified over all 64 bits.

Defined results: null and word-less texts have fingerprint 0 and link like any other;
rows with equal texts have equal fingerprints; repeated rows each get a row; a null
doc_id never becomes a component's id unless there is no other; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, named, packed, settle, small_batches
from .components import components

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STEP = 1 << 15
HALF = 0xFFFFFFFF


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of one text; bytes.split() cuts at just the six white-space characters."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    width = min(width, len(words))
    shingles = zip(*(words[k:] for k in range(width)), strict=False)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = [digest(join(s), seed) for s in shingles]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), _STEP):
        part = np.array(hashes[k : k + _STEP], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed bigint."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _segment(fp: Column, seg: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if seg == 0 else fp.bitwiseAND(F.lit(HALF))


def _bits(of, keep_set: bool):
    """The values that one flip of a set (or of an unset) bit of a 32-bit value gives."""
    flip = [of.bitwiseXOR(F.lit(1 << k)) for k in range(32)]
    wanted = [F.when(of.bitwiseAND(F.lit(1 << k)) != 0 if keep_set else of.bitwiseAND(F.lit(1 << k)) == 0, f) for k, f in enumerate(flip)]
    return F.array_compact(F.array(*wanted))


def _ball(of) -> Column:
    return F.array(of, *(of.bitwiseXOR(F.lit(1 << k)) for k in range(32)))


def links(fps: DataFrame, hot: int = 4096) -> DataFrame:
    """(a, b): linked pairs among the distinct fingerprints ``fps`` (fp), enough of them to connect all that link within 3 bits.

    A segment value that over ``hot`` distinct fingerprints share would make too many pairs.
    Its fingerprints are linked through shared points instead (see :func:`_hot_links`), which
    is as exact, and takes the same work for each of them, however many they are.
    """
    fp = F.col("fp")
    table = settle(fps.select("fp", F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), _segment(fp, s).alias("key")) for s in (0, 1)))).alias("k")).select("fp", "k.*"), "table")
    flips = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(s).alias("seg"), _bits(_segment(fp, s), False).alias("keys")) for s in (0, 1)))).alias("k")).select("fp", "k.seg", F.explode("k.keys").alias("key"))
    heavy = settle(table.groupBy("seg", "key").count().where(F.col("count") > hot).select("seg", "key"), "heavy")
    none = heavy.isEmpty()
    cold = table if none else table.join(heavy, ["seg", "key"], "left_anti")
    probe = table.select("seg", "key", F.col("fp").alias("a"), F.lit(True).alias("same")).unionByName(flips.select("seg", "key", F.col("fp").alias("a"), F.lit(False).alias("same")))
    pairs = probe.join(cold.select("seg", "key", F.col("fp").alias("b")), ["seg", "key"]).where("(not same or a < b) and bit_count(a ^ b) <= 3").select("a", "b")
    return pairs if none else pairs.unionByName(_hot_links(table, flips, heavy))


def _hot_links(table: DataFrame, flips: DataFrame, heavy: DataFrame) -> DataFrame:
    """Links at segment values that too many fingerprints share, without pairs.

    The other halves of two members with the same segment differ in 3 bits or fewer just
    if flipping one bit of each and ignoring one common bit makes them equal; those of a
    member and a prober, whose segments differ in one bit, in 2 or fewer just if flipping
    one bit of each does. Each such common point is a node that joins all that reach it:
    its smallest fingerprint links to the others. Points of the second kind hold the
    prober's segment as well, so that two probers that meet there link rightly too.
    """
    other = F.when(F.col("seg") == 0, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    members = table.join(heavy, ["seg", "key"]).withColumn("o", other)
    probers = flips.join(heavy, ["seg", "key"]).withColumn("o", other)
    point = members.select("fp", "seg", "key", F.explode(_ball(F.col("o"))).alias("p"))
    masked = point.select("fp", "seg", "key", F.explode(F.array(*(F.struct(F.lit(-1 - k).cast("bigint").alias("u"), F.col("p").bitwiseAND(F.lit(HALF ^ (1 << k))).alias("p")) for k in range(32)))).alias("n")).select("fp", "seg", "key", "n.u", "n.p")
    met = point.withColumn("u", F.explode(_bits(F.col("key"), True))).select("fp", "seg", "key", "u", "p")
    asked = probers.select("fp", "seg", "key", F.when(F.col("seg") == 0, _segment(F.col("fp"), 0)).otherwise(_segment(F.col("fp"), 1)).alias("u"), F.explode(_ball(F.col("o"))).alias("p"))
    reached = masked.unionByName(met).unionByName(asked)
    nodes = reached.groupBy("seg", "key", "u", "p").agg(F.min("fp").alias("b"))
    return reached.join(nodes, ["seg", "key", "u", "p"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id that links reach, itself included)."""
    each = settle(fingerprints(docs, doc_id, text), "fingerprints")
    rows = each.count()
    distinct = settle(packed(each.groupBy("fp").agg(F.min("doc_id").alias("least")), rows), "distinct")
    labels = components(links(distinct.select("fp"), hot))
    grouped = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    found = join_hot(each, grouped.join(smallest, "label").select("fp", "component_id"), "fp")
    return packed(found.select("doc_id", "fp", "component_id"), rows)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies: of each group the row of the smallest doc_id stays, one of them if it repeats.

    Rows whose doc_id is null can't be told apart by it and stay. Ids that go are joined
    away; only rows whose kept doc_id repeats are grouped.
    """
    found = settle(near_duplicates(docs, doc_id, text), "components").where("doc_id is not null")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.struct(*named(docs)).alias("row"))
    kept = rows.join(gone, "doc_id", "left_anti")
    again = found.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.isEmpty():
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select("row.*")
