"""Writers: JSON lines in order, reports, and several outputs of one pass."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_lines(rows: DataFrame, path: str, order: str | None = "row_idx") -> None:
    """The column ``value`` as one text file at ``path``, by ``order``, atomically.

    Parts are written sorted by range in parallel; the driver joins them by name and
    renames the whole, so that a failure leaves what was there before.
    """
    spark = rows.sparkSession
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    ordered = (rows.orderBy(order) if order else rows).select("value")
    fs, target = _files(spark, path)
    _, folder = _files(spark, temporary)
    _, whole = _files(spark, temporary + ".whole")
    try:
        ordered.write.text(temporary)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes
        out = fs.create(whole, True)
        for status in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
            if status.getPath().getName().startswith("part-"):
                part = fs.open(status.getPath())
                copy(part, out, conf, False)
                part.close()
                fs.delete(status.getPath(), False)  # no line is on disk twice
        out.hsync()
        out.close()
        fs.delete(target, True)
        if not fs.rename(whole, target):
            raise OSError(f"can't rename to {path}")
    finally:
        fs.delete(folder, True)
        fs.delete(whole, True)


def write_shards(rows: DataFrame, folder: str, order: str = "row_idx") -> None:
    """The column ``value`` as a folder of text files whose names and lines follow ``order``, written by all executors.

    For outputs too large to go through one file: nothing passes the driver, and Spark's committer
    leaves no part of a failed write. The folder must not exist yet.
    """
    rows.repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(folder)


def write_jsonl(rows: DataFrame, path: str, order: str | None = "row_idx", drop: tuple[str, ...] = ("row_idx",)) -> None:
    """All columns but ``drop`` as compact JSON lines; characters beyond ASCII stay as they are."""
    kept = [c for c in rows.columns if c not in drop]
    line = F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})
    write_lines(rows.select(*({order} if order else set()), line.alias("value")), path, order)


def write_report(spark: SparkSession, path: str, report: dict, sort_keys: bool = True) -> None:
    """A small report as indented JSON, atomically."""
    fs, target = _files(spark, path)
    _, temporary = _files(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, True)
    out.write(bytearray((json.dumps(report, ensure_ascii=False, indent=2, sort_keys=sort_keys) + "\n").encode()))
    out.close()
    fs.delete(target, True)
    if not fs.rename(temporary, target):
        raise OSError(f"can't rename to {path}")


_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a local session (tests) gets a folder of its own; a cluster, whose
    executors would each write to their own disk, gets an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spanwright-"))
    return _own[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back: computed once however often it is used, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_by(rows: DataFrame, folder: str, column: str) -> None:
    """Several outputs in one pass: a folder of JSON lines for each value of ``column``."""
    rows.write.partitionBy(column).json(folder)
