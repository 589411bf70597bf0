"""Evaluate prediction rows as their files arrive, against a static gold table.

A sample's metrics need its own row alone, so the stream keeps no state; only the
running summary by data set does, a row for each. A sample counts once for each
prediction row that arrives; the batch evaluator is the one that lets the last row win.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import spans as S
from ..operators.policy import by_dataset, sample_metrics
from ..schema import PREDICTION


def prediction_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """(sample_id, pred_spans) of JSON-lines files that come to ``folder``; blank lines are skipped."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.jsonl").text(folder)
    return lines.where(F.trim("value") != "").select(F.from_json("value", PREDICTION).alias("r")).select("r.*")


def metrics_stream(gold: DataFrame, predictions: DataFrame, **policy) -> DataFrame:
    """Sample metrics of each arriving prediction of a gold sample (sample_id, dataset, text, gold)."""
    rows = predictions.join(gold, "sample_id").withColumn("gold", S.positive(F.col("gold"))).withColumn("predicted", S.positive(S.prediction_spans(F.col("pred_spans"))))
    return sample_metrics(rows.drop("pred_spans"), **policy)


def summary_stream(metrics: DataFrame) -> DataFrame:
    """The running means by data set, for a sink in complete or update mode."""
    return by_dataset(metrics)


def write_metrics(metrics: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append metrics as Parquet, exactly once by the checkpoint, for what has arrived by now."""
    return metrics.drop("matched").writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
