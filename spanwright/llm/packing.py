"""Packing documents into windows by minimum bin slack.

A document's tokens are cut into full windows and one remainder. How many remainders
there are of each length is all that the packing needs: at most ``capacity`` numbers, however
large the corpus. With these counts, the longest remaining length opens a window, and a
bitset subset-sum over the multiset of the others finds the fill closest to capacity; going
back through the bitsets gives how many of each length it takes, and this pattern is used
as often as the counts allow. Pieces then find their place by their number among the pieces
of their length, which each partition counts for itself.

Defined results: a null text is empty and, like an empty one, has the end token alone;
repeated rows and null ids are packed like other rows; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, small_batches
from .tokens import tokenizer


def _waste(total: int, capacity: int) -> int:
    """Padding of a window that is filled so far: none at a power of two."""
    return 0 if total & (total - 1) == 0 else capacity - total


def fullest(counts: dict[int, int], first: int, capacity: int) -> Counter:
    """The multiset with ``first`` in it, out of ``counts`` (length to number), that leaves the least padding.

    Bit s of ``reach`` tells that the lengths so far can sum to s. A length of which there
    are n is added in groups of 1, 2, 4, ... and the rest, which make every number up to n.
    """
    need, reach, steps = capacity - first, 1, []
    inside = (1 << (need + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), need // length)
        group = 1
        while left > 0:
            group = min(group, left)
            steps.append((length, group, reach))
            reach |= reach << (length * group) & inside
            left -= group
            group *= 2
        if reach >> need & 1:
            break
    sums = [s for s in range(need + 1) if reach >> s & 1] if not reach >> need & 1 else [need]
    best = min(sums, key=lambda s: (_waste(first + s, capacity), -s))
    chosen = Counter({first: 1})
    for length, group, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] += group
            best -= length * group
    return chosen


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, lengths with their number) such that all pieces are used up."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        first = max(left)
        chosen = Counter({first: 1}) if first == capacity else fullest(left, first, capacity)
        times = min(left[n] // m for n, m in chosen.items())
        out.append((times, dict(chosen)))
        for n, m in chosen.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return out


def layout(found: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length, rows (first number, first sequence, offset, pieces in a sequence), by first number."""
    taken, sequence, rows = Counter(), 0, {}
    for times, chosen in found:
        at = 0
        for n in sorted(chosen, reverse=True):
            rows.setdefault(n, []).append((taken[n], sequence, at, chosen[n]))
            taken[n] += times * chosen[n]
            at += n * chosen[n]
        sequence += times
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def cut(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, and the piece's number ``nth`` among those of its length in partition ``part``."""
    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType
    ending, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def run(batches):
        encode, seen = tokenizer(tokenizer_path).encode, Counter()
        part = TaskContext.get().partitionId()
        for b in batches:
            which, rows = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                ids = encode(t or "") + ending
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    n = len(piece) // 4
                    rows.append((at // 4, n, zlib.crc32(piece), len(ids) // 4, seen[n]))
                    seen[n] += 1
                    which.append(k)
            columns = np.array(rows, dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), *(pa.array(columns[:, k]) for k in range(5)), pa.array(np.full(len(rows), part, dtype=np.int64))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", "part"])

    made = f"doc_id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, nth bigint, part bigint"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, made)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = settle(cut(docs, tokenizer_path, capacity, end_id, doc_id, text), "pieces")
    held = settle(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "held")
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # up to capacity rows
    places = spark.sparkContext.broadcast(layout(patterns(counts, capacity)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = held.select("part", "length", before.alias("before"))
    # A row for each length in each part: as many as the input has parts, so they are dealt out, not broadcast.
    numbered = pieces.join(firsts.hint("shuffle_hash"), ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("number"))

    def run(batches):
        for b in batches:
            length, number = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            sequence, offset = np.empty_like(length), np.empty_like(length)
            for n in np.unique(length):
                at, rows = length == n, places.value[int(n)]
                own = number[at]
                row = rows[np.searchsorted(rows[:, 0], own, side="right") - 1]
                turn = own - row[:, 0]
                sequence[at] = row[:, 1] + turn // row[:, 3]
                offset[at] = row[:, 2] + n * (turn % row[:, 3])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
