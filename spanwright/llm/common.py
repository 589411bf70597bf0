"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import let, running  # noqa: F401  used by the operators
from ..sources.sinks import settle, shared_root  # noqa: F401

#: Word characters are everything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what an Arrow batch holds, so that long texts don't pile up in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def local_or_arrow_fs(uri: str):
    """(filesystem, path) of a folder URI, as the Python workers open it."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def utf8(column: str):
    """A text column as its UTF-8 bytes, null as none."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by their exact names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted``, each with so many underscores that it is none of the names ``taken``, in any case."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


#: Rows of a few numbers that are worth a task and a file of their own.
ROWS = 1 << 16


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` short rows, in no more partitions than these need; large tables keep theirs.

    Each file that an executor writes to a local file system without Hadoop's native library starts chmod processes, which
    share the executor's memory while they start and so count it twice; hundreds of files of a few rows each are slow, too.
    """
    return df.coalesce(rows // ROWS + 1)


#: Keys that more than one in HOT rows have are hot, so there are fewer than HOT of them; each is dealt to SALTS places.
HOT, SALTS = 1000, 64


def join_hot(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each key, such that no key's rows meet in one task.

    The keys are counted in ``counted`` (``rows`` themselves unless told). The hot ones, fewer than HOT, are
    broadcast as bare keys; their rows are dealt to SALTS places, and their rows of ``table`` copied there.
    """
    seen = rows if counted is None else counted
    counts = seen.groupBy(key).count()
    hot = settle(counts.where(F.col("count") > F.lit(seen.count() / HOT)).select(key, F.lit(True).alias("_hot")), "hot")
    if hot.isEmpty():
        return rows.join(table, key, how)
    salt = F.when(F.col("_hot"), F.monotonically_increasing_id() % SALTS).otherwise(F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    places = F.when(F.col("_hot"), F.array(*map(F.lit, range(SALTS)))).otherwise(F.array(F.lit(0)))
    copied = table.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(places)).drop("_hot")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


def ranked(rows: DataFrame, order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``nth``, their number from 1 by ``order``, which tells all rows apart, and for each column c of ``sums`` the sum over the rows before, ``before_c``.

    Ranges are numbered and summed side by side; what one task puts together is a row for each range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = settle(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(*order)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), *(F.sum(c).alias(f"_sum_{c}") for c in sums))
    ranges = ranges.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_rows", *(f"_sum_{c}" for c in sums))))
    own = [(F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col(f"_sum_{c}")).alias(f"before_{c}") for c in sums]
    return held.join(F.broadcast(ranges), "_part").select(*rows.columns, (F.row_number().over(inside) + F.col("_rows")).alias("nth"), *own)
