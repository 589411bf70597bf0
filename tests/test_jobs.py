import hashlib
import json

import pytest
from pyspark.sql import types as T

from spanwright import file_queries
from spanwright.operators import validation as V
from spanwright.plans import commands as J
from spanwright.queries import QUERIES
from spanwright.sources import jsonl, sinks

SAMPLE_ID = T.StructType([T.StructField("sample_id", T.StringType())])


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def get(path):
    return [json.loads(x) for x in open(path, encoding="utf-8")]


def test_strict_scan(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", [{"sample_id": f"s{k}"} for k in range(50)])
    assert [(r.row_idx, r.sample_id) for r in jsonl.strict(spark, path, SAMPLE_ID).orderBy("row_idx").collect()] == [(k, f"s{k}") for k in range(50)]
    assert jsonl.first_rows(jsonl.strict(spark, path, SAMPLE_ID), 7).count() == 7
    for rows, message in ((['{"sample_id":"a"}', "  "], "blank JSONL line 2"), (["[1]"], "no object at line 1"), (["{}", "{"], "malformed JSONL line 2")):
        bad = put(tmp_path / "bad.jsonl", rows)
        spark.catalog.refreshByPath(bad)
        with pytest.raises(Exception, match=message):
            jsonl.strict(spark, bad, SAMPLE_ID).collect()


def test_lines_across_splits(spark, tmp_path):
    path = put(tmp_path / "b.jsonl", [{"sample_id": f"s{k}", "pad": "x" * (k % 50)} for k in range(3000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        rows = jsonl.lines(spark, path)
        assert rows.rdd.getNumPartitions() >= 1
        assert [json.loads(r.value)["sample_id"] for r in rows.orderBy("line").collect()] == [f"s{k}" for k in range(3000)]
        assert [r.line for r in rows.orderBy("line").collect()] == list(range(3000))
        out = str(tmp_path / "copy.jsonl")
        sinks.write_lines(jsonl.strict(spark, path, SAMPLE_ID).selectExpr("row_idx", "raw as value"), out)
        assert open(out).read() == open(path).read()
        sinks.write_shards(jsonl.strict(spark, path, SAMPLE_ID).selectExpr("row_idx", "raw as value"), str(tmp_path / "shards"))
        assert "".join(p.read_text() for p in sorted((tmp_path / "shards").glob("part-*"))) == open(path).read()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_gold_forms(spark, tmp_path):
    note = {"start": 0, "end": 2, "label": "contact", "risk_band": "high"}
    put(tmp_path / "set" / "dev.jsonl", [{"sample_id": "x:1", "text": "abc", "pii_annotations": [{**note, "weight": None, "pcr_weight": 0.0}, {**note, "pcr_weight": 0.0}]}, "", {"text": "d", "meta": None}, {"dataset": "given", "sample_id": "plain"}])
    nested = {"input": {"raw_text": "nested", "pii_annotations": [{"coarse_label": "health-medical", "risk_band": "critical", "start_char": 1, "end_char": 3}]}, "meta": {"dataset_dir": "dir", "source_split": "part", "source_sample_id": 7}}
    put(tmp_path / "set" / "deep" / "test.jsonl", [nested, {"text": "no id"}])
    got = {(r.file.rsplit("/", 1)[1], r.line): r for r in jsonl.gold(spark, str(tmp_path / "set")).collect()}
    assert {k: (r.sample_id, r.dataset, r.text) for k, r in got.items()} == {
        ("dev.jsonl", 0): ("x:1", "x", "abc"),
        ("dev.jsonl", 2): ("dev.jsonl:2", "unknown", "d"),
        ("dev.jsonl", 3): ("plain", "given", ""),
        ("test.jsonl", 0): ("dir:part:7", "dir", "nested"),
        ("test.jsonl", 1): ("deep/test.jsonl:1", "test", "no id"),
    }
    assert [s.weight for s in got["dev.jsonl", 0].gold] == [3.0, 0.0]
    assert [tuple(s) for s in got["test.jsonl", 0].gold] == [(1, 3, "HEALTH_MEDICAL", 4.0, True, True)]
    assert jsonl.gold(spark, str(tmp_path / "set"), jsonl.parse_split_names(" test, ")).count() == 2


def test_predictions_last_wins(spark, tmp_path):
    path = put(tmp_path / "p.jsonl", [{"sample_id": "a", "pred_spans": [{"start": 1, "end": 2, "label": "x"}]}, "", {"sample_id": "b"}, {"sample_id": "a", "pred_spans": [{"start_char": "3", "label": "y"}]}])
    got = {r.sample_id: r.pred_spans for r in jsonl.predictions(spark, path).collect()}
    assert [(s.start, s.end, s.label) for s in got["a"]] == [(3, 3, "y")] and got["b"] == []


def test_verified_files(spark, tmp_path):
    path = put(tmp_path / "f.json", [{"a": 1}])
    data = open(path, "rb").read()
    jsonl.verify_file(spark, path, hashlib.sha256(data).hexdigest(), len(data))
    assert [tuple(r)[1:] for r in jsonl.file_table(spark, path, whole=3).collect()] == [(len(data), hashlib.sha256(data).hexdigest())]
    assert jsonl.load_json(spark, path) == {"a": 1}
    with pytest.raises(ValueError):
        jsonl.verify_file(spark, path, "0" * 64)
    with pytest.raises(ValueError):
        jsonl.verify_file(spark, path, hashlib.sha256(data).hexdigest(), 1)
    with pytest.raises(FileNotFoundError):
        jsonl.verify_file(spark, path + "x", "0" * 64)
    with pytest.raises(ValueError):
        jsonl.load_json(spark, put(tmp_path / "l.json", ["[1]"]))


def test_validator(spark):
    ok = {"start": 0, "end": 2, "label": "contact"}
    rows = [
        {"sample_id": "a", "pred_spans": [ok, {**ok, "start": "0"}, {**ok, "end": 2.9}, {**ok, "label": "X"}, {**ok, "end": 99}, {**ok, "start": "1.5"}, {"start": 0}, 5, {**ok, "start": True}]},
        {"sample_id": "a", "pred_spans": None},
        {"pred_spans": []},
        {"sample_id": "d", "pred_spans": {}},
        {"sample_id": "e"},
    ]
    sub = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "row_idx bigint, value string")
    test = spark.createDataFrame([(0, "a", "four"), (1, "b", None), (2, "c", "x"), (3, "d", "x"), (9, "z", "x")], "row_idx bigint, sample_id string, text string")
    got = V.counters(sub, test, 7).first().asDict()
    assert got == {"row_count": 5, "duplicate_submission_rows": 1, "malformed_span_count": 4, "illegal_or_invalid_span_count": 4, "duplicate_span_count": 2, "sample_id_mismatch_count": 3, "missing_prediction_rows": 1, "extra_prediction_rows": 1, "expected_row_count_mismatch": 2, "strict_pass": False}
    clean = spark.createDataFrame([(0, json.dumps({"sample_id": "a", "pred_spans": [ok]}))], sub.schema)
    assert V.counters(clean).first().strict_pass and V.counters(clean, test.where("row_idx = 0"), 1).first().strict_pass


def test_jobs_end_to_end(spark, tmp_path, capsys):
    def row(k):
        text = f"mail ann{k}@example.org or call, number {k}"
        return {"sample_id": f"src{k % 3}:{k}", "text": text, "pii_annotations": [{"start": 5, "end": text.index(" or"), "label": "CONTACT", "risk_band": "CRITICAL", "weight": 4.0, "pcr_in_scope": True, "critical_for_pcr": True}]}

    rows = [row(k) for k in range(300)]
    train = put(tmp_path / "train.jsonl", rows)
    splits = str(tmp_path / "splits")
    summary = J.prepare_splits(spark, train, splits, development=0.2, heldout=0.2)
    assert sum(summary["rows"].values()) == 300
    held = get(f"{splits}/development.jsonl")
    assert held == [r for r in rows if r["sample_id"] in {h["sample_id"] for h in held}] and len(held) == summary["rows"]["development"]
    assert summary["files"]["heldout"]["sha256"] == hashlib.sha256(open(f"{splits}/heldout.jsonl", "rb").read()).hexdigest()

    specs = {"small": {"contact": 5, "filler": 9}}
    made = J.build_curricula(spark, train, str(tmp_path / "cur"), ["small"], [f"{splits}/{s}.jsonl" for s in ("development", "heldout")], specs)
    own = get(tmp_path / "cur" / "small.jsonl")
    assert made["curriculum_rows"] == {"small": 9} and made["accepted_rows"] == summary["rows"]["training"] and made["excluded_rows"] == 300 - made["accepted_rows"]
    ranks = [hashlib.md5(r["sample_id"].encode()).hexdigest() for r in own]
    assert ranks == sorted(ranks) and set(own[0]) == {"sample_id", "text", "train_spans"}

    def told(rows, shift, drop):
        return [{"sample_id": r["sample_id"], "pred_spans": [] if k % drop == 0 else [{"start": r["pii_annotations"][0]["start"] + shift, "end": r["pii_annotations"][0]["end"], "label": "CONTACT", "extra": "é"}]} for k, r in enumerate(rows)]

    for name in ("development", "heldout"):
        part = get(f"{splits}/{name}.jsonl")
        for e, (shift, drop) in {"anchor": (0, 2), "coverage": (0, 5), "precision": (1, 1000)}.items():
            put(tmp_path / "pred" / e / f"{name}.jsonl", told(part, shift, drop))
    report = J.evaluate_experts(spark, splits, str(tmp_path / "pred"), str(tmp_path / "audit.json"), str(tmp_path / "router.json"))
    assert set(report["selected_routes"].values()) <= {"coverage", "precision"} and report["selected_routes"]
    assert J.select_router(spark, str(tmp_path / "audit.json")) == report["selected_routes"]
    put(tmp_path / "pred" / "anchor" / "heldout.jsonl", told(part, 0, 2)[1:])
    with pytest.raises(KeyError):
        J.evaluate_experts(spark, splits, str(tmp_path / "pred"), str(tmp_path / "x.json"))

    test = put(tmp_path / "test.jsonl", [{"sample_id": r["sample_id"], "text": r["text"]} for r in rows])
    experts = {e: put(tmp_path / "final" / f"{e}.jsonl", told(rows, *v)) for e, v in {"anchor": (0, 2), "coverage": (0, 5), "precision": (1, 1000)}.items()}
    done = J.reproduce(spark, str(tmp_path / "router.json"), str(tmp_path / "sub.jsonl"), str(tmp_path / "rep.json"), experts, test=test, expected_rows=300)
    assert done["validation"]["strict_pass"] and done["route_stats"]["row_count"] == 300
    routes = report["selected_routes"]
    by = {e: get(p) for e, p in experts.items()}
    assert get(tmp_path / "sub.jsonl") == [by[routes.get(r["sample_id"].split(":")[0], "anchor")][k] for k, r in enumerate(rows)]
    with pytest.raises(ValueError):
        J.reproduce(spark, str(tmp_path / "router.json"), "x", "y", {"anchor": experts["anchor"]})
    size = lambda p: {"filename": p.rsplit("/", 1)[1], "size_bytes": len(open(p, "rb").read()), "sha256": hashlib.sha256(open(p, "rb").read()).hexdigest()}
    manifest = put(tmp_path / "manifest.json", [{"inputs": {e: size(p) for e, p in experts.items()}, "output": size(str(tmp_path / "sub.jsonl")), "row_count": 300}])
    again = J.reproduce(spark, str(tmp_path / "router.json"), str(tmp_path / "sub2.jsonl"), str(tmp_path / "rep.json"), manifest=manifest, artifacts=str(tmp_path / "final"))
    assert again["output"]["bitwise_identical"]
    short = put(tmp_path / "short.jsonl", [json.dumps(x) for x in by["anchor"][:-1]])
    with pytest.raises(Exception, match="row counts differ"):
        J.route_files(spark, {**experts, "anchor": short}, str(tmp_path / "no.jsonl"), routes)
    assert not (tmp_path / "no.jsonl").exists()
    with pytest.raises(KeyError):
        J.route_files(spark, experts, str(tmp_path / "no.jsonl"), {"src0": "other"})

    J.infer(spark, test, str(tmp_path / "anchor.jsonl"))
    found = get(tmp_path / "anchor.jsonl")
    assert [f["sample_id"] for f in found] == [r["sample_id"] for r in rows]
    assert found[3]["pred_spans"] == [{"start": 5, "end": 21, "label": "CONTACT"}]
    J.infer(spark, test, str(tmp_path / "scored.jsonl"), mode="scored")
    assert get(tmp_path / "scored.jsonl")[3]["pred_spans"][0]["score"] == pytest.approx(0.9)
    with pytest.raises(ValueError):
        J.infer(spark, test, "x", mode="other")

    result = J.evaluate(spark, train, str(tmp_path / "anchor.jsonl"), str(tmp_path / "eval"), worst_k=3)
    assert result["n_samples"] == 300 and result["sample_macro"]["policy_compliance_rate"] == 1 and len(result["worst_cases"]) == 3
    assert result["entity_level"]["exact_label_aware"]["per_label_tp"] == {"CONTACT": 300} and set(result["by_dataset"]) == {"src0", "src1", "src2"}
    assert len(get(tmp_path / "eval" / "policy_details.jsonl")) == 300
    assert json.load(open(tmp_path / "eval" / "policy_summary.json"))["n_samples"] == 300

    for s in ("shared_initialization",):
        assert J.main(["train", "--curriculum", str(tmp_path / "cur" / "small.jsonl"), "--output", str(tmp_path / "model"), "--stage", s, "--ranks", "2"], spark) == 0
    assert json.load(open(tmp_path / "model" / "training_summary.json"))["ranks"] == 2
    assert J.main(["train-all", "--curricula", "c", "--output", "o", "--dry-run"], spark) == 0
    assert J.main(["validate", "--submission", str(tmp_path / "sub.jsonl"), "--test", test], spark) == 0
    assert J.main(["validate", "--submission", str(tmp_path / "sub.jsonl"), "--expected-rows", "5"], spark) == 1
    assert '"row_count": 300' in capsys.readouterr().out


def test_inference_keeps_every_row(spark, tmp_path):
    """Rows without an id, and rows of equal ids, each have a line of their own."""
    texts = ["mail ann@example.org", "", "mail bob@example.org now", None, "10.0.0.1"]
    rows = [{"sample_id": i, "text": x} for i, x in zip(["a", "b", None, None, "a"], texts)]
    test = put(tmp_path / "odd.jsonl", [json.dumps(r) for r in rows])
    for mode in ("scored", "expert", "anchor"):
        J.infer(spark, test, str(tmp_path / f"{mode}.jsonl"), mode=mode)
        found = get(tmp_path / f"{mode}.jsonl")
        assert [f["sample_id"] for f in found] == ["a", "b", None, None, "a"]
        assert [[x["label"] for x in f["pred_spans"]] for f in found] == [["CONTACT"], [], ["CONTACT"], [], ["DIGITAL_ID"]]
        assert all(("score" in x) == (mode == "scored") for f in found for x in f["pred_spans"])


def test_inference_reads_texts_alone(spark, tmp_path, monkeypatch):
    """The query makes no annotations and no other job's files."""
    monkeypatch.setattr(file_queries.X, "found", lambda *a: pytest.fail("candidates were made"))
    monkeypatch.setattr(file_queries, "_made", {})
    rows = QUERIES["infer_job"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and [r.row_idx for r in sorted(rows)] == list(range(200))
