import json
import os

from pyspark.sql import functions as F

from evalspark.operators import outcomes
from evalspark.sources import files, metrics, registry

DOC = ("run_id string, groups array<struct<tokenizer:string, models_dir:string, flags:array<string>, "
       "models:array<struct<path:string, flags:array<string>>>>>")


def test_registry_flags_and_paths(spark):
    docs = spark.createDataFrame([("r", [
        ("/tok/a", None, ["-g"], [("m1.gguf", []), ("m2.gguf", ["-x"]), ("/abs/m3.GGUF", None)]),
        ("/tok/b", "/models", None, [("m4.gguf", None), ("m1.bin", None)]),
    ])], DOC)
    entries = registry.load_registry(docs)
    m = {r["label"]: r for r in registry.resolve_models(entries).collect()}
    assert m["m1.gguf"]["flags"] == ["-g"]            # empty list falls back to the group
    assert m["m2.gguf"]["flags"] == ["-x"]            # model flags replace group flags
    assert m["m1.gguf"]["resolved_path"] == "/tok/a/m1.gguf"
    assert m["m3.GGUF"]["resolved_path"] == "/abs/m3.GGUF"
    assert m["m4.gguf"]["resolved_path"] == "/models/m4.gguf" and m["m4.gguf"]["flags"] == []
    assert [m[k]["ordinal"] for k in ("m1.gguf", "m2.gguf", "m3.GGUF", "m4.gguf", "m1.bin")] == [1, 2, 3, 4, 5]
    assert m["m1.gguf"]["model_id"] == "m1"
    rules = {(r["model_pos"], r["rule"]) for r in registry.registry_violations(entries, True).collect()}
    assert (1, "not_gguf") in rules and ("model_count" not in {x[1] for x in rules})  # 5 models: allowed


def test_registry_duplicates_after_resolution(spark):
    docs = spark.createDataFrame([("r", [("/t", None, None, [("a.gguf", None), ("/t/a.gguf", None)])])], DOC)
    rules = [r["rule"] for r in registry.registry_violations(registry.load_registry(docs)).collect()]
    assert rules.count("duplicate_path") == 2


def test_slugify(spark):
    from evalspark.functions.text import slugify, model_stem
    df = spark.createDataFrame([("My Model (Q4).gguf",), ("...",), ("a.b.gguf",)], "p string")
    out = [r[0] for r in df.select(slugify(model_stem(F.col("p")))).collect()]
    assert out == ["My-Model-Q4", "model", "a.b"]


def test_run_option_violations(spark):
    runs = spark.createDataFrame([("a", 1.2, 0.5, "mmlu", False, "f16"), ("b", 0.5, 0.5, "nope", True, "q8")],
                                 "run_id string, weights_mmlu double, weights_ppl double, mmlu_task string, "
                                 "skip_mmlu boolean, coding_kv_fix string")
    got = {(r["run_id"], r["rule"]) for r in registry.run_option_violations(runs).collect()}
    assert got == {("a", "weights_mmlu_range"), ("b", "unknown_kv_fix")}


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_result_files_done_vs_completed(spark, tmp_path):
    root = str(tmp_path)
    run = "2024-01-02-03-04-05--m1"
    for lang in ("python", "go"):
        for ex in ("a", "b", "c"):
            if ex == "c":
                continue  # one exercise without a file
            _write(f"{root}/{run}/{lang}/exercises/practice/{ex}/results.json", "{}")
    done = outcomes.count_done(files.list_result_files(spark, root, "python")).collect()
    assert [(r["language"], r["done"]) for r in done] == [("python", 2)]
    assert sum(r["done"] for r in outcomes.count_done(files.list_result_files(spark, root)).collect()) == 4
    assert files.read_exercise_results(spark, root).count() == 0  # empty records are not completed
    _write(f"{root}/{run}/python/exercises/practice/d/results.json",
           json.dumps({"tests_outcomes": [False, 1], "prompt_tokens": 10}))
    _write(f"{root}/{run}/python/exercises/practice/e/results.json", "{broken")
    rec = files.read_exercise_results(spark, root, " python, python ").collect()
    assert len(rec) == 1 and rec[0]["tests_outcomes"] == [False, True] and rec[0]["exercise"] == "d"
    assert rec[0]["run"] == run
    rej = {r["exercise"]: r["reason"] for r in files.read_exercise_rejects(spark, root, "python").collect()}
    assert rej == {"a": "empty", "b": "empty", "e": "unreadable"}


def test_latest_run_anchored(spark):
    runs = spark.createDataFrame([("2024-01-01-00-00-00--b", 1), ("2024-01-02-00-00-00--a--b", 5),
                                  ("2024-01-03-00-00-00--b", 3)], "run string, mtime int")
    got = {r["slug"]: r["run"] for r in outcomes.latest_run(runs).collect()}
    assert got["b"] == "2024-01-03-00-00-00--b" and got["a--b"] == "2024-01-02-00-00-00--a--b"
    fallback = outcomes.latest_run(runs, "zzz").collect()
    assert [r["run"] for r in fallback] == ["2024-01-02-00-00-00--a--b"]


def test_metric_lookup_refuses_booleans(spark):
    doc = json.dumps({"results": {"mmlu": {"acc,none": True, "acc": 0.4, "sample_len": 7},
                                  "mmlu_math": {"acc,none": 0.3}}, "groups": {}})
    parsed = metrics.parse_metrics(spark.createDataFrame([("r", "m", doc)], "run_id string, model_id string, json string"))
    s = metrics.task_summary(parsed, "mmlu").first()
    assert s["score"] == 0.4 and s["n_samples"] == 7 and s["score_stderr"] is None
    subj = metrics.subject_accuracy_from_metrics(parsed).collect()
    assert [(r["subject"], r["acc"]) for r in subj] == [("math", 0.3)]


def test_registry_json_strings_and_mappings(spark):
    doc = json.dumps([
        {"tokenizer": "/tok/a", "flags": ["-g"], "models": ["m1.gguf", {"path": "m2.gguf", "flags": ["-x"]},
                                                             {"path": "m3.gguf", "color": "red"}]},
        {"tokenizer": "/tok/b", "models-dir": "/models", "extra": 1, "models": ["/abs/m4.GGUF"]},
    ])
    entries = registry.parse_registry_json(spark.createDataFrame([("r", doc)], "run_id string, json string"))
    m = {r["label"]: r for r in registry.resolve_models(entries).collect()}
    assert m["m1.gguf"]["flags"] == ["-g"] and m["m2.gguf"]["flags"] == ["-x"]
    assert m["m1.gguf"]["resolved_path"] == "/tok/a/m1.gguf" and m["m4.GGUF"]["resolved_path"] == "/abs/m4.GGUF"
    rules = sorted((r["group_pos"], r["model_pos"], r["rule"]) for r in registry.registry_violations(entries).collect())
    assert (0, 2, "unknown_model_keys") in rules and (1, 0, "unknown_group_keys") in rules
    assert not any(r[2] == "not_gguf" for r in rules)
