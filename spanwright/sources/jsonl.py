"""JSON-lines scans with row numbers, and verified files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import labels as L
from ..functions import spans as S
from ..schema import ANNOTATION, SAMPLE


def lines(spark: SparkSession, path: str, names: Iterable[str] = (), pattern: str = "*.jsonl") -> DataFrame:
    """(file, line, value) of a file's lines, or of those files of a folder that fit ``pattern``; ``line`` counts from 0, blank lines too.

    Spark splits large files. Lines are numbered within their split as they are read, and the
    splits' line counts, a row for each, give where a split begins in its file.
    """
    read = spark.read.option("recursiveFileLookup", True)
    read = read if path.endswith(pattern.lstrip("*")) else read.option("pathGlobFilter", pattern)
    rows = read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    wanted = sorted(names)
    if wanted:
        rows = rows.where(stem(F.col("file")).isin(wanted))
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = splits.select("file", "block", "first", before.alias("before"))
    return rows.join(F.broadcast(begins), ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("line"), "value")


def stem(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]*?)(?:\.[^./]*)?$", 1)


def parse_split_names(raw: str) -> set[str]:
    return {name for name in map(str.strip, str(raw).split(",")) if name}


def strict(spark: SparkSession, path: str, schema: T.StructType, columns: Iterable[str] = (), pattern: str = "*.jsonl") -> DataFrame:
    """(row_idx, columns of ``schema``, raw) of a file in which every line must be a JSON object; others raise with their number.

    ``row_idx`` counts from 0.
    """
    rows = lines(spark, path, pattern=pattern)
    number = (F.col("line") + 1).cast("string")
    blank = F.regexp_replace("value", r"[\s\x1c-\x1f\x85]+", "") == ""
    kind = F.try_parse_json("value")
    wrong = F.when(blank, F.concat(F.lit("blank JSONL line "), number)).when(kind.isNull(), F.concat(F.lit("malformed JSONL line "), number)).when(~F.startswith(F.schema_of_variant(kind), F.lit("OBJECT")), F.concat(F.lit("JSONL row is no object at line "), number))
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("string")).otherwise(F.col("value"))
    rows = rows.select(F.col("line").alias("row_idx"), checked.alias("raw"))
    parsed = rows.withColumn("_r", F.from_json("raw", schema))
    keep = list(columns) or schema.names
    return parsed.select("row_idx", *(F.col("_r")[c].alias(c) for c in keep), "raw")


def first_rows(rows: DataFrame, n: int | None) -> DataFrame:
    """The first n rows by number, for tests: unlike limit(), the same ones each time."""
    return rows if n is None else rows.where(F.col("row_idx") < n)


def samples(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    return first_rows(strict(spark, path, SAMPLE), n)


_NESTED = T.StructType(
    [
        T.StructField("coarse_label", T.StringType()),
        T.StructField("normalized_fine_label", T.StringType()),
        T.StructField("risk_band", T.StringType()),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
        T.StructField("pcr_weight", T.DoubleType()),
        T.StructField("pcr_in_scope", T.BooleanType()),
    ]
)
GOLD = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("pii_annotations", T.ArrayType(T.StructType([*ANNOTATION.fields, T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]))),
        T.StructField("input", T.StructType([T.StructField("raw_text", T.StringType()), T.StructField("pii_annotations", T.ArrayType(_NESTED))])),
        T.StructField("meta", T.StructType([T.StructField("dataset_dir", T.StringType()), T.StructField("source_split", T.StringType()), T.StructField("source_sample_id", T.StringType())])),
    ]
)


def _has(key: str) -> Column:
    """Whether a record has a key, be its value null."""
    return F.array_contains(F.json_object_keys("value"), key)


def gold(spark: SparkSession, path: str, names: Iterable[str] = ()) -> DataFrame:
    """(sample_id, dataset, text, gold, file, line) of release or source records; blank lines are skipped but counted.

    A null ``meta`` gives dataset "unknown", a missing one the id's prefix, else the file's stem.
    A weight that is present but null hides ``pcr_weight``, so the band decides.
    """
    rows = lines(spark, path, names).where(F.trim("value") != "").withColumn("r", F.from_json("value", GOLD))
    root = path.rstrip("/")
    plain = F.regexp_replace("file", "^file:/+", "/")
    top = "/" + root.removeprefix("file://").lstrip("/")
    relative = F.when(F.startswith(plain, F.lit(top + "/")), F.substring(plain, len(top) + 2, 1 << 20)).otherwise(F.regexp_extract("file", r"[^/]*$", 0))
    meta = F.col("r.meta")
    own = L.canonical_id(F.col("r.sample_id"), F.coalesce(F.nullif(meta["dataset_dir"], F.lit("")), F.substring_index(relative, "/", 1)), F.coalesce(F.nullif(meta["source_split"], F.lit("")), stem(F.col("file"))), meta["source_sample_id"], relative, F.col("line"))
    prefix = F.when(F.contains(F.coalesce("r.sample_id", F.lit("")), F.lit(":")), L.source_prefix(F.col("r.sample_id"))).otherwise(stem(F.col("file")))
    dataset = F.coalesce("r.dataset", F.when(_has("meta"), F.coalesce(F.nullif(meta["dataset_dir"], F.lit("")), F.lit("unknown"))).otherwise(prefix))
    text = F.coalesce(F.when(_has("input"), F.col("r.input.raw_text")).otherwise(F.col("r.text")), F.lit(""))
    raw = F.from_json(F.get_json_object("value", "$.pii_annotations"), "array<map<string,string>>")

    def release(a: Column, k: Column) -> Column:
        shown = F.map_contains_key(F.get(raw, k), F.lit("weight"))
        held = F.when(shown & a["weight"].isNull(), F.lit(None).cast("double")).otherwise(a["pcr_weight"])
        return a.withField("pcr_weight", held).withField("start", F.coalesce(a["start"], a["start_char"], F.lit(0))).withField("end", F.coalesce(a["end"], a["end_char"], F.lit(0)))

    nested = S.source_gold_spans(F.coalesce("r.input.pii_annotations", F.array().cast(T.ArrayType(_NESTED))))
    flat = S.gold_spans(F.transform(F.coalesce("r.pii_annotations", F.array().cast(GOLD["pii_annotations"].dataType)), release))
    return rows.select(own.alias("sample_id"), dataset.alias("dataset"), text.alias("text"), F.when(_has("input"), nested).otherwise(flat).alias("gold"), "file", "line")


def last_wins(rows: DataFrame, order: str = "row_idx") -> DataFrame:
    """One row per sample_id, that of the largest ``order``; a struct maximum needs neither sort nor window."""
    rest = [c for c in rows.columns if c != "sample_id"]
    return rows.groupBy("sample_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("sample_id", "r.*")


_PREDICTED = "sample_id string, pred_spans array<struct<start:string,end:string,start_char:string,end_char:string,label:string,score:double>>"


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, pred_spans) of a prediction file: blank lines are skipped, and of equal ids the last row counts."""
    rows = lines(spark, path).where(F.trim("value") != "").withColumn("r", F.from_json("value", _PREDICTED))
    whole = lambda x: x.cast("double").cast("int")

    def one(s: Column) -> Column:
        start = F.coalesce(whole(s["start"]), whole(s["start_char"]), F.lit(0))
        return F.struct(start.alias("start"), F.coalesce(whole(s["end"]), whole(s["end_char"]), start).alias("end"), s["label"].alias("label"), s["score"].alias("score"))

    spans = F.transform(F.coalesce("r.pred_spans", F.array().cast("array<struct<start:string,end:string,start_char:string,end_char:string,label:string,score:double>>")), one)
    return last_wins(rows.select(F.col("r.sample_id").alias("sample_id"), spans.alias("pred_spans"), F.struct("file", "line").alias("row_idx"))).drop("row_idx")


def expert_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, sample_id, pred_spans as the JSON text it has) for routing, which must not touch spans."""
    rows = strict(spark, path, T.StructType([T.StructField("sample_id", T.StringType()), T.StructField("pred_spans", T.StringType())]))
    return rows.select("row_idx", "sample_id", "pred_spans")


def in_batches(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` such that Python operators get ``size`` of them at a time."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(int(size)))
    return rows


def load_json(spark: SparkSession, path: str) -> dict:
    """A small JSON object, read by Spark so that any store will do."""
    whole = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    found = json.loads(whole)
    if not isinstance(found, dict):
        raise ValueError(f"expected a JSON object in {path}")
    return found


#: Files up to so many bytes fit in one binary value.
WHOLE = (1 << 31) - (1 << 16)


def streamed_sha256(spark: SparkSession, path: str) -> str:
    """The SHA-256 of a file of any size, a buffer at a time."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    data = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(data)
    finally:
        data.close()


def file_table(spark: SparkSession, path: str, whole: int = WHOLE) -> DataFrame:
    """(file, size, sha256) of files, hashed where they are read; those beyond ``whole`` bytes are streamed by the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= whole).select(F.col("path").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = [(r.path, r.length, streamed_sha256(spark, r.path)) for r in files.where(F.col("length") > whole).select("path", "length").collect()]
    return small.unionByName(spark.createDataFrame(large, small.schema)) if large else small


def verify_file(spark: SparkSession, path: str, sha256: str, size: int | None = None) -> None:
    """Raise FileNotFoundError for a missing file, ValueError for another size or hash."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(path)
    row = file_table(spark, path).first()
    if size is not None and row.size != int(size):
        raise ValueError(f"{path} has {row.size} bytes, not {int(size)}")
    if row.sha256 != sha256:
        raise ValueError(f"{path} has SHA-256 {row.sha256}, not {sha256}")


def verify_files(spark: SparkSession, contracts: Iterable[Mapping]) -> None:
    for c in contracts:
        verify_file(spark, c["path"], c["sha256"], c.get("size"))
