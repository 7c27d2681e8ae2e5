from pyspark.sql import functions as F

from evalspark.functions import arrays
from evalspark.operators import latency, outcomes, perplexity
from tests.conftest import approx

REC = "run_id string, model_id string, language string, exercise string, tests_outcomes array<boolean>"


def test_pass_summary_hand_values(spark):
    rows = [("r", "m", "py", "a", [True]), ("r", "m", "py", "b", [False, True]),
            ("r", "m", "py", "c", [False, False]), ("r", "m", "py", "d", [])]
    flags = outcomes.flags_from_records(spark.createDataFrame(rows, REC))
    s = outcomes.pass_summary(flags).first()
    assert (s["completed"], s["pass_num_1"], s["pass_num_2"]) == (4, 1, 2)
    assert s["pass_rate_1"] == 25.0 and s["pass_rate_2"] == 50.0
    assert s["pass_num_2"] >= s["pass_num_1"]


def test_no_passes_and_null_outcomes(spark):
    rows = [("r", "m", "py", "a", [False, None]), ("r", "m", "py", "b", None)]
    s = outcomes.pass_summary(outcomes.flags_from_records(spark.createDataFrame(rows, REC))).first()
    assert (s["completed"], s["pass_num_1"], s["pass_num_2"]) == (2, 0, 0)


def test_exercise_cell(spark):
    df = spark.createDataFrame([([False, False, True],), ([True],), ([False],)], "o array<boolean>")
    p1, pa = arrays.pass_flags(F.col("o"))
    cells = [r[0] for r in df.select(arrays.exercise_cell(p1, pa)).collect()]
    assert cells == ["2", "1", "·"]
    assert spark.range(1).select(arrays.exercise_cell(F.lit(None).cast("boolean"),
                                                      F.lit(None).cast("boolean"))).first()[0] == "–"


def test_truncate_context(spark):
    df = spark.createDataFrame([(list(range(13)), [100, 101, 102])], "c array<int>, k array<int>")
    r = df.select(arrays.truncate_context(F.col("c"), F.col("k"), 8).alias("x")).first()["x"]
    assert r == [8, 9, 10, 11, 12]
    r = df.select(arrays.truncate_context(F.col("c"), F.col("k"), 3).alias("x")).first()["x"]
    assert r == []
    r = df.select(arrays.truncate_context(F.col("c"), F.col("k"), 100).alias("x")).first()["x"]
    assert r == list(range(13))


def parse(spark, log):
    return spark.createDataFrame([(log,)], "log string").select(perplexity.parse_ppl(F.col("log")).alias("p")).first()["p"]


def test_parse_ppl(spark):
    p = parse(spark, "blah\nFinal estimate: PPL = 67.9739 +/- 8.71330\n")
    assert (p["ppl"], p["ppl_se"]) == (67.9739, 8.7133)
    p = parse(spark, "Final estimate: PPL = 12.5")
    assert (p["ppl"], p["ppl_se"]) == (12.5, None)
    p = parse(spark, "overall_ppl = 53.6409 (tokens = 1234)")
    assert (p["ppl"], p["ppl_se"]) == (53.6409, None)
    p = parse(spark, "[1]4.0\rFinal estimate: PPL = 9.99 +/- 1.0")
    assert (p["ppl"], p["ppl_se"]) == (9.99, 1.0)
    assert parse(spark, "no number here")["ppl"] is None
    p = parse(spark, "overall_ppl = 1.0\nfinal ESTIMATE: ppl = 2.0")
    assert p["ppl"] == 2.0


def test_log_tail(spark):
    log = "\n".join(f"l{i}" for i in range(20))
    r = spark.createDataFrame([(log,), ("a\nb",)], "log string").select(perplexity.log_tail(F.col("log"))).collect()
    assert r[0][0].split("\n") == [f"l{i}" for i in range(8, 20)]
    assert r[1][0] == "a\nb"


def test_ppl_summary_ignores_missing_se(spark):
    df = spark.createDataFrame([("r", "m", 10.0, 1.0), ("r", "m", 12.0, None), ("r", "m", None, None)],
                               "run_id string, model_id string, ppl double, ppl_se double")
    s = perplexity.ppl_summary(df).first()
    assert (s["ppl"], s["ppl_se"], s["n_runs"], s["run_min"], s["run_max"]) == (11.0, 1.0, 2, 10.0, 12.0)


def test_request_latency_end_marker(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    s = lambda x: t0 + dt.timedelta(seconds=x)
    rows = [("r", "m", "q", t0, s(1), "", False), ("r", "m", "q", t0, s(2), "a", False),
            ("r", "m", "q", t0, s(3), "b", False), ("r", "m", "q", t0, s(4), None, True),
            ("r", "m", "q", t0, s(5), "c", False), ("r", "m", "z", t0, s(1), "", False)]
    df = spark.createDataFrame(rows, "run_id string, model_id string, request_id string, t_start timestamp_ntz, "
                                     "ts timestamp_ntz, delta string, is_end boolean")
    out = latency.request_latency(df).collect()
    assert len(out) == 1  # request without tokens dropped
    r = out[0]
    assert r["n_tokens"] == 2 and approx(r["ttft_ms"], 2000.0) and approx(r["tok_s"], 1.0)


def test_parse_stream_lines(spark):
    lines = ['data: {"choices":[{"text":"hi"}]}', "data: not json", ": comment", 'data: {"choices":[]}',
             "data: [DONE]"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    out = latency.parse_stream_lines(df).collect()
    assert [(r["delta"], r["is_end"], r["malformed"]) for r in out] == [
        ("hi", False, False), (None, False, True), (None, False, True), (None, True, False)]


def test_stage_errors_kept_apart(spark):
    from evalspark.operators import composite
    models = spark.createDataFrame([("r", "m0", 0)], "run_id string, model_id string, ordinal int")
    acc = spark.createDataFrame([("r", "m0", None, None, 0, "RuntimeError: no results")],
                                "run_id string, model_id string, acc_score double, acc_stderr double, "
                                "n_samples bigint, error string")
    ppl = spark.createDataFrame([("r", "m0", 10.0, None, 1, 10.0, 10.0, None)],
                                "run_id string, model_id string, ppl double, ppl_se double, n_runs bigint, "
                                "run_min double, run_max double, error string")
    r = composite.composite_leaderboard(models, {"weights_mmlu": 0.5, "weights_ppl": 0.5}, acc, None, ppl).first()
    assert r["accuracy_error"] == "RuntimeError: no results" and r["ppl_error"] is None
    assert r["score"] == 100.0 and r["rank"] == 1


def test_latency_stage_missing_model(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    per = spark.createDataFrame([("r", "a", "q", 3, 10.0, 2.0)],
                                "run_id string, model_id string, request_id string, n_tokens bigint, "
                                "ttft_ms double, tok_s double")
    s = latency.latency_summary(per)
    models = spark.createDataFrame([("r", "a"), ("r", "b")], "run_id string, model_id string")
    out = {r["model_id"]: r for r in latency.latency_stage(models, s).collect()}
    assert out["a"]["error"] is None and out["a"]["ttft_ms_p50"] == 10.0
    assert out["b"]["n_requests"] is None and out["b"]["error"].startswith("ValueError")
    a = latency.latency_summary(per, approx_accuracy=1000).first()
    assert a["ttft_ms_p50"] == 10.0
