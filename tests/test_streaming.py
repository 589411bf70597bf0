import json

from pyspark.sql import functions as F

from spanwright import fixtures as X
from spanwright.functions.spans import gold_spans
from spanwright.operators.audit import single
from spanwright.streaming import evaluation as E

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    gold = X.annotated(spark, SF).select("sample_id", F.col("source").alias("dataset"), "text", gold_spans(F.col("pii_annotations")).alias("gold")).cache()
    told = X.predictions(spark, SF, "anchor").cache()
    rows = [json.loads(x) for x in told.toJSON().collect()]
    (tmp_path / "in").mkdir()
    args = str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(2):
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows[k::2]) + "\n")
        query = E.write_metrics(E.metrics_stream(gold, E.prediction_stream(spark, str(tmp_path / "in"))), *args)
        query.awaitTermination()
    key = ("sample_id", "policy_pass", "weighted_pii_coverage", "fp_char_count", "risk_adjusted_f2")
    got = sorted(map(tuple, spark.read.parquet(args[0]).select(*key).collect()))
    assert got == sorted(map(tuple, single(gold, told).select(*key).collect())) and len(got) == 200
    summary = E.summary_stream(E.metrics_stream(gold, E.prediction_stream(spark, str(tmp_path / "in")))).writeStream.format("memory").queryName("by_set").outputMode("complete").trigger(availableNow=True).start()
    summary.awaitTermination()
    assert spark.table("by_set").agg({"n_samples": "sum"}).first()[0] == 200
