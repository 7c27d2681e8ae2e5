import json

from pyspark.sql import functions as F

from evalspark.functions import text as T
from evalspark.operators import accuracy, outcomes
from evalspark.sources import files
from tests.conftest import approx


def test_read_chunks_jsonl(spark, tmp_path):
    rows = [{"run_id": "r", "model_id": "m", "request_id": "q", "t_start": "2024-01-01T00:00:00",
             "ts": f"2024-01-01T00:00:0{i}", "line": line}
            for i, line in enumerate(['data: {"choices":[{"text":"a"}]}', "data: oops",
                                      'data: {"choices":[{"text":""}]}', "data: [DONE]"])]
    p = tmp_path / "chunks.jsonl"
    p.write_text("\n".join(json.dumps(r) for r in rows))
    out = files.read_chunks(spark, str(p)).orderBy("ts").collect()
    assert [(r["delta"], r["is_end"], r["malformed"]) for r in out] == [
        ("a", False, False), (None, False, True), ("", False, False), (None, True, False)]


def test_composite_label(spark):
    label = lambda *x: spark.range(1).select(T.composite_label(*map(F.lit, x)).alias("x")).first()["x"]
    assert label(0.5, 0.5, 2) == "0.50 x PPL + 0.25 x MMLU + 0.25 x aider pass@2"
    assert label(0.5, 0.0, 3) == "0.50 x MMLU + 0.50 x aider pass@3"


def test_display_cells_and_records(spark):
    from evalspark.operators import composite
    from evalspark.sinks import report
    models = spark.createDataFrame([("r", "a", "A.gguf", 0), ("r", "b", "B.gguf", 1), ("r", "c", "C.gguf", 2)], "run_id string, model_id string, label string, ordinal int")
    ppl = spark.createDataFrame([("r", "a", 53.0, 0.7, 2, 52.0, 54.0), ("r", "b", 60.0, None, 1, 60.0, 60.0)],
                                "run_id string, model_id string, ppl double, ppl_se double, n_runs long, run_min double, run_max double")
    acc = spark.createDataFrame([("r", "a", 0.53, 0.0066, 6100)], "run_id string, model_id string, acc_score double, acc_stderr double, n_samples long")
    coding = spark.createDataFrame([("r", "a", 34, 2, 4, 200.0 / 34, 400.0 / 34), ("r", "b", 0, 0, 0, None, None)],
                                   "run_id string, model_id string, completed long, pass_num_1 long, pass_num_2 long, pass_rate_1 double, pass_rate_2 double")
    lat = spark.createDataFrame([("r", "a", 20, 311.4, 25.6, None), ("r", "b", None, None, None, "ValueError: no usable requests")],
                                "run_id string, model_id string, n_requests long, ttft_ms_p50 double, tok_s_median double, error string")
    lb = composite.composite_leaderboard(models, {"weights_mmlu": 0.5, "weights_ppl": 0.5}, acc, coding, ppl, lat)
    cell = {r["model_id"]: r for r in report.leaderboard_display(lb).collect()}
    a, b, c = (cell[k] for k in "abc")
    assert (a["ppl_cell"], a["accuracy_cell"], a["ttft_cell"], a["rate_cell"], a["label_cell"]) == ("53.00±1.37", "53.0% ±1.3", "311", "26", "A.gguf")
    assert a["pass1_cell"] == "5.9% ±8.7" and (b["ppl_cell"], b["pass2_cell"]) == ("60.00", "n/a")
    assert (c["rank_cell"], c["score_cell"], c["ppl_cell"]) == ("-", "n/a", "n/a")
    rec = {r["model_id"]: r for r in report.report_records(lb).collect()}
    assert rec["a"]["perplexity"]["n_runs"] == 2 and rec["a"]["latency"]["error"] is None and rec["a"]["coding"]["ci_high"] > 11
    assert rec["b"]["latency"]["error"] == "ValueError: no usable requests" and rec["b"]["latency"]["n_requests"] is None and rec["b"]["partial"]
    assert rec["c"]["accuracy"] is None and rec["c"]["latency"] is None


def test_outcome_truthiness_by_json_type(spark):
    values = '["", "false", "0", 0, 1, 0.0, 2.5, true, false, null, [], [0], {}, {"a": 0}]'
    got = files.parse_exercise_records(spark.createDataFrame([(f'{{"tests_outcomes": {values}}}',), ("{}",), ("{bad",)], "value string")).collect()
    assert got[0]["tests_outcomes"] == [False, True, True, False, True, False, True, True, False, False, False, True, False, True]
    assert [r["reject"] for r in got] == [None, "empty", "unreadable"]


def test_empty_group_metrics_fall_back_to_results(spark):
    from evalspark.sources import metrics
    doc = '{"groups": {"mmlu": {}}, "results": {"mmlu": {"acc,none": 0.5}}}'
    r = metrics.task_summary(metrics.parse_metrics(spark.createDataFrame([("r", "m", doc)], "run_id string, model_id string, json string"))).first()
    assert r["score"] == 0.5 and r["error"] is None


def test_weighted_perplexity_keeps_a_small_spread(spark):
    from evalspark.operators import perplexity
    rows = [("m", -2.0 - 1e-7 * (i % 2), 10 ** 6) for i in range(4)]
    r = perplexity.token_perplexity(spark.createDataFrame(rows, "model_id string, logprob double, count long"), ["model_id"], weight="count").first()
    import math
    assert abs(r["ppl_se"] * math.sqrt(4e6) / r["ppl"] - 5e-8) < 1e-12


def test_pooled_stderr_equals_item_level(spark):
    # pooling subject SEs gives the within-subject pooled SE; check on two subjects
    items = spark.createDataFrame([("r", "m", s, float(v)) for s, vs in (("a", [1, 0, 1, 1]), ("b", [0, 0, 1]))
                                   for v in vs], "run_id string, model_id string, subject string, correct double")
    subj = accuracy.subject_and_model_accuracy(items).filter(~F.col("is_overall"))
    pooled = accuracy.pooled_stderr(subj).first()
    import statistics
    a, b = [1, 0, 1, 1], [0, 0, 1]
    ss = statistics.variance(a) * 3 + statistics.variance(b) * 2
    assert approx(pooled["acc_score"], 4 / 7) and approx(pooled["acc_stderr"], (ss / (7 - 2) / 7) ** 0.5)


def test_cap_exercises_is_seeded_and_bounded(spark):
    cat = spark.createDataFrame([(lang, str(i)) for lang in ("py", "go") for i in range(50)],
                                "language string, exercise string")
    a = outcomes.cap_exercises(cat, 10, seed=1).collect()
    b = outcomes.cap_exercises(cat, 10, seed=1).collect()
    c = outcomes.cap_exercises(cat, 10, seed=2).collect()
    assert len(a) == 20 and sorted(map(tuple, a)) == sorted(map(tuple, b)) and sorted(map(tuple, a)) != sorted(map(tuple, c))


def test_limit_per_subject(spark):
    docs = spark.createDataFrame([(s, i) for s in ("x", "y") for i in range(5)], "subject string, doc_no int")
    out = accuracy.limit_per_subject(docs, 2).collect()
    assert sorted((r["subject"], r["doc_no"]) for r in out) == [("x", 0), ("x", 1), ("y", 0), ("y", 1)]


def test_generation_prompt_is_cut_from_the_left(spark):
    from evalspark.functions import arrays
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "ids array<int>")
    cut = lambda length, new: df.select(arrays.truncate_prompt("ids", length, new).alias("x")).first()["x"]
    assert cut(10, 5) == [1, 2, 3, 4, 5] and cut(5, 2) == [3, 4, 5] and cut(5, 5) == [] and cut(3, 9) == []


def test_run_totals_count_folders(spark):
    dirs = spark.createDataFrame([("a", "py", "x"), ("a", "py", "x"), ("a", "go", "x"), ("b", "py", "y")], "run string, language string, exercise string")
    assert {r["run"]: r["total"] for r in outcomes.run_totals(dirs).collect()} == {"a": 2, "b": 1}
    assert {r["run"]: r["total"] for r in outcomes.run_totals(dirs, ["go"]).collect()} == {"a": 1}


def test_context_windows_give_perplexity_per_window(spark):
    from evalspark.operators import perplexity
    rows = spark.createDataFrame([("m", i, -1.0 if i < 4 else -2.0) for i in range(8)], "model_id string, position int, logprob double")
    got = perplexity.token_perplexity(perplexity.context_windows(rows, 4), ["model_id", "chunk_no"]).collect()
    assert {r["chunk_no"]: round(r["ppl"], 6) for r in got} == {0: 2.718282, 1: 7.389056}


def test_reader_of_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\nFinal estimate: PPL = 5.5 +/- 0.1\n")
    from evalspark.operators import perplexity
    logs = files.read_ppl_logs(spark, str(tmp_path / "*.log")).withColumn("run_id", F.lit("r")).withColumn("model_id", F.lit("m")).withColumn("run_no", F.lit(1))
    assert perplexity.parse_ppl_logs(logs).first()["ppl"] == 5.5


def test_registry_paths_are_normalised(spark):
    from evalspark.sources import registry
    df = spark.createDataFrame([("/a/./b",), ("/a//c/../b",), ("./x/../y",), ("../z",), ("/../q",)], "p string")
    assert [r["x"] for r in df.select(registry.normal_path(df["p"]).alias("x")).collect()] == ["/a/b", "/a/b", "y", "../z", "/q"]
