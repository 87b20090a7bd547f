"""End-to-end plans and the streaming detector."""

import json

from pyspark.sql import functions as F

from spanloom.functions.parsing import response_json
from spanloom.labels import ENTITY_TYPES
from spanloom.__main__ import main
from spanloom.operators import scoring, validation
from spanloom.plans import evaluation, reports
from spanloom.streaming import detector


def fixture(spark):
    rows = [(1, "Ann wrote to a@b.org", [("PERSON_NAME", 0, "Ann"), ("EMAIL", 13, "a@b.org")]), (2, "nothing here", []), (3, "Bob and Bob", [("PERSON_NAME", 0, "Bob"), ("PERSON_NAME", 8, "Bob")])]
    samples = spark.createDataFrame([(i, t) for i, t, _ in rows], "sample_id long, text string")
    gold = spark.createDataFrame([(i, k, a, a + len(v), v) for i, _, g in rows for k, a, v in g], "sample_id long, type string, start int, stop int, text string")
    return samples, gold


def test_gold_as_prediction_scores_one(spark):
    samples, gold = fixture(spark)
    said = gold.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "type", "text"))).alias("e"))
    predictions = samples.join(said, "sample_id", "left").select("sample_id", response_json(F.coalesce("e", F.array().cast("array<struct<start:int,stop:int,type:string,text:string>>"))).alias("raw_output"))
    run = evaluation.evaluate(samples, gold, predictions)
    assert run.averages.where("average = 'micro'").first()[1:] == (1.0, 1.0, 1.0)
    assert run.documents.first()[:] == (1.0, 1.0, 0.0) and run.validity.first()[:] == (1.0, 1.0, 1.0, 0) and run.errors.count() == 0


def test_missing_and_invalid_predictions(spark):
    samples, gold = fixture(spark)
    predictions = spark.createDataFrame([(1, json.dumps({"entities": [{"text": "Ann", "type": "EMAIL"}]})), (2, "```"), (9, "{}")], "sample_id long, raw_output string")
    run = evaluation.evaluate(samples, gold, predictions)
    assert scoring.coverage(samples, predictions).first().asDict() == {"shared": 2, "missing": 1, "extra": 1, "repeated": 0}
    assert {(r["sample_id"], r["kind"], r["cause"]) for r in run.errors.collect()} == {
        (1, "FN", "wrong_label"), (1, "FP", "wrong_label"), (1, "FN", "missed_entity"), (2, "SCHEMA", "invalid_schema"), (3, "SCHEMA", "invalid_schema"), (3, "FN", "invalid_schema")
    }


def test_evaluation_from_the_command_line(spark, tmp_path, capsys):
    samples, gold = fixture(spark)
    said = gold.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "type", "text"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,stop:int,type:string,text:string>>")
    rows = samples.join(said, "sample_id", "left").select(F.concat(F.lit("s"), F.col("sample_id").cast("string")).alias("sample_id"), "text", F.lit("made").alias("source"), F.lit("train").alias("split"), F.coalesce("spans", none).alias("spans"))
    data, predictions = str(tmp_path / "data"), str(tmp_path / "said")
    validation.prepared_lines(rows, "prompt").select("value").write.text(data)
    run = lambda *a: main([*a], spark)
    assert run("validate", "--source", data, "--split", "train", "--out", str(tmp_path / "v1")) == 0
    assert run("validate", "--source", data, "--split", "test", "--out", str(tmp_path / "v2")) == 2
    assert json.loads((tmp_path / "v2" / "validation.json").read_text())["faults"] == {"source_split": 3}
    assert run("detect", "--data", data, "--out", predictions) == 0
    work = str(tmp_path / "work")
    assert run("evaluate", "--data", data, "--predictions", predictions, "--out", str(tmp_path / "e"), "--work", work) == 0
    metrics = json.loads((tmp_path / "e" / "metrics.json").read_text())
    assert metrics["per_class"]["EMAIL"]["tp"] == 1 and metrics["error_groups"]["FN/PERSON_NAME/missed_entity"] == {"documents": 2, "errors": 3}
    assert metrics["validity"]["schema_valid_rate"] == 1.0
    assert run("evaluate", "--data", data, "--predictions", data, "--out", str(tmp_path / "f")) == 1
    assert run("evaluate", "--data", data, "--predictions", predictions, "--out", str(tmp_path / "e"), "--work", work) == 1  # the folder is taken
    source = str(tmp_path / "source")
    spark.createDataFrame([("a", "train", "Ann x"), ("b", "valid", "Ann x"), ("c", "test", "y")], "uid string, split string, text string").write.partitionBy("split").parquet(source)
    assert run("inspect", "--source", source, "--out", str(tmp_path / "i")) == 2
    assert json.loads((tmp_path / "i" / "summary.json").read_text())["exact_duplicates_across_splits"] == 1
    printed = "".join(capsys.readouterr()) + "".join(p.read_text() for d in ("v2", "e", "i") for p in (tmp_path / d).iterdir())
    assert "Ann" not in printed and "a@b.org" not in printed


def test_comparison_report(spark):
    columns = ["recall", "complete_document_recall", "precision", "schema_valid", "f1", "negative_false_positive_rate", "input_index"]
    runs = spark.createDataFrame([(0.5, 1.0, 1.0, 1.0, 0.6, 0.0, 0), (0.9, 1.0, 1.0, 1.0, 0.9, 0.0, 1)], columns)
    report = reports.comparison_report(runs)["comparison.md"].splitlines()
    assert report[4].startswith("| 0.9 ") and report[5].startswith("| 0.5 ")


def test_inspection(spark):
    rows = [("a", "train", "one two"), ("b", "train", "One  two"), ("c", "valid", "one two"), ("c", "test", "x")]
    found = evaluation.inspect(spark.createDataFrame(rows, "uid string, split string, text string"))
    assert found["exact_duplicates"].count() == 1 and found["normal_duplicates"].first()["refs"] == 3
    assert found["normal_duplicates"].first()["crosses"] and found["shared_ids"].first()["uid"] == "c"
    assert {r["split"]: r["p50"] for r in found["lengths"].collect()} == {"train": 2, "valid": 2, "test": 1}


def test_nested_stages(spark):
    pool = spark.createDataFrame([(f"p{i}", [ENTITY_TYPES[i % 14]]) for i in range(300)] + [(f"n{i}", []) for i in range(120)], "sample_id string, labels array<string>")
    stages = evaluation.build_stages(pool, {"main": (200, 4), "v0": (100, 2), "smoke": (60, 1)})
    ids = {n: {r["sample_id"] for r in s.collect()} for n, s in stages.items()}
    assert {n: len(x) for n, x in ids.items()} == {"main": 200, "v0": 100, "smoke": 60} and ids["smoke"] <= ids["v0"] <= ids["main"]


def test_streaming_detection_appends_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "doc_id long, text string"
    for part in ([(1, "mail a@b.org"), (2, "none")], [(2, "none"), (3, "id NAT-12345")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        detector.append_once(detector.detect_stream(spark, source, schema), out, mark, "doc_id").awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r["doc_id"], len(r["spans"])) for r in rows) == [(1, 1), (2, 0), (3, 1)]
