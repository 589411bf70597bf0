"""Mixing sources to target weights by hash-threshold histograms, with DataFrame operations only.

Each document has a hash that depends on its doc_id alone. Tokens are summed by source
and the hash's leading bits; where a source's budget ends, only that one bucket is summed
again by the bits that follow, until it holds a single hash. A document below its source's
threshold is taken once more than the whole rounds that the target allows; nothing is sorted,
and a larger budget's choice includes a smaller one's.

Defined results: a null text has size 0; null is a source of its own, ordered last; rows
that share a doc_id (repeated rows, null ids) share a hash and are taken or left together;
an empty table gives an empty result; other columns are kept by :func:`mix` and ignored by
:func:`plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, named, ranked, settle

#: Hash bits in all, and those that one histogram resolves.
BITS, STEP = 60, 12
#: Tables with a row for each source are broadcast up to so many of them (under 8 MB), and joined by shuffle beyond.
MOST_BROADCAST = 50_000


def word_count(text: Column) -> Column:
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("bigint")


def hash60(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, h, k) of each row, without its text."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), hash60(F.col(doc_id)).alias("h"), _key(F.col(source)).alias("k"))


def targets(work: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(k, source_size, target) by source: all sizes are shared by weight, up to ``most`` times a source's own size.

    What exceeds that is shared again among the others, which ends where every source gets
    its weight times one level, or its own limit if that is less. In the order of
    limit by weight, the level is that of the first source which it doesn't exceed.
    """
    by = ranked(work.groupBy("k").agg(F.sum("size").alias("source_size")).withColumn("null", F.col("k") == ""), ["null", "k"])
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    by = by.select("k", "source_size", weight.alias("w"), (most * F.col("source_size")).alias("limit"), (most * F.col("source_size") / weight).alias("ratio"))
    by = ranked(by, ["ratio", "k"], ("limit", "w"))
    total, all_weights = by.agg(F.sum("source_size"), F.sum("w")).first()
    level = (F.lit(total) - F.col("before_limit")) / (F.lit(all_weights) - F.col("before_w"))
    first = by.select("nth", "ratio", level.alias("level")).where("level <= ratio").agg(F.min_by("level", "nth")).first()[0]
    return by.select("k", "source_size", F.least(F.col("w") * F.lit(first).cast("double"), F.col("limit").cast("double")).alias("target"))


def _by_source(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(sources) if few else sources, "k")


def plan(work: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> tuple[DataFrame, bool]:
    """(k, source_size, target, rounds, threshold) by source, and whether these rows are few enough to broadcast.

    A document is taken ``rounds`` times, and once more if its hash is ``threshold`` at most.
    """
    goal = settle(targets(work, weights, most), "targets")
    few = goal.count() <= MOST_BROADCAST
    rounds = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("bigint")
    open_ = goal.select("k", (F.col("target") - rounds * F.col("source_size")).alias("budget"), F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("below"))
    done = None
    for shift in range(BITS - STEP, -1, -STEP):
        inside = _by_source(work.select("k", "h", "size"), open_, few).where(F.shiftright("h", shift + STEP) == F.col("prefix"))
        bucket = F.shiftright("h", shift)
        sums = inside.groupBy("k", bucket.alias("b")).agg(F.sum("size").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("budget").alias("budget"), F.first("below").alias("below"))
        through = F.col("below") + F.sum("s").over(Window.partitionBy("k").orderBy("b"))
        edge = sums.withColumn("through", through).where(F.col("through") > F.col("budget")).groupBy("k").agg(F.min_by(F.struct("b", "s", "lo", "hi", "budget", "through"), "b").alias("e")).select("k", "e.*")
        edge = settle(edge, "boundary")
        over, under = F.col("through") - F.col("budget"), F.col("budget") - F.col("through") + F.col("s")
        single = F.col("lo") == F.col("hi") if shift else F.lit(True)
        closed = edge.where(single).select("k", F.when(over < under, F.col("hi")).otherwise(F.col("lo") - 1).alias("threshold"))
        done = closed if done is None else done.unionByName(closed)
        open_ = edge.where(~single).select("k", "budget", F.col("b").alias("prefix"), (F.col("through") - F.col("s")).alias("below"))
        if not shift or open_.isEmpty():
            break
    full = goal.select("k", "source_size", "target", rounds.alias("rounds"))
    return settle(full.join(done, "k", "left").withColumn("threshold", F.coalesce("threshold", F.lit(-1))), "plan"), few


def times(most: int) -> Column:
    """How often a document is taken; one of size 0 in a source that is taken ``most`` times isn't taken once more."""
    return F.least(F.lit(most), F.col("rounds") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    work = settle(measured(docs, doc_id, text, source), "measured")
    sources, few = plan(work, weights, most)
    return _by_source(work, sources, few).select("doc_id", "size", "source_size", "target", (F.col("size") * times(most)).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (rows taken no time go)."""
    sources, few = plan(settle(measured(docs, doc_id, text, source), "measured"), weights, most)
    sources = sources.select(F.col("k").alias("_k"), "rounds", "threshold")
    held = docs.select(F.struct(*named(docs)).alias("_row"), _key(F.col(source)).alias("_k"), hash60(F.col(doc_id)).alias("h"))
    held = held.join(F.broadcast(sources) if few else sources, "_k")
    return held.select("_row", F.explode(F.array_repeat(F.lit(0), times(most).cast("int")))).select("_row.*")


ORACLE = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         (row_number() over (order by source is null, source) - 1) % 3 + 1 as w
  from d group by source),
r as (
  select *, 3 * source_size / w as ratio, sum(source_size) over () as total,
         row_number() over (order by 3 * source_size / w, source is null, source) as nth from s),
l as (
  select *, (total - coalesce(sum(3 * source_size) over (order by nth rows between unbounded preceding and 1 preceding), 0))
         / (sum(w) over () - coalesce(sum(w) over (order by nth rows between unbounded preceding and 1 preceding), 0)) as level from r),
t as (
  select source, source_size,
         least(w * (select arg_min(level, nth) from l where level <= ratio), (3 * source_size)::double) as target from l),
b as (
  select source, source_size, target, case when source_size = 0 then 0 else floor(target / source_size)::bigint end as rounds from t),
c as (
  select d.doc_id, d.size, d.h, b.source_size, b.target, b.rounds, b.target - b.rounds * b.source_size as budget,
         sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row) as through,
         sum(d.size) over (partition by d.source, d.h) as tied
  from d join b on d.source is not distinct from b.source)
select doc_id, size, source_size, target::double as target,
       (size * (rounds + case when through <= budget or (through - tied <= budget and through - budget < budget - (through - tied)) then 1 else 0 end))::bigint as taken
from c
"""
