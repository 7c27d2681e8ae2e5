"""Report texts, run lists, legends and wide matrices by hand values."""
import pytest

from evalspark.operators import composite, matrices, perplexity
from evalspark.sinks import report


@pytest.fixture(scope="module")
def board(spark):
    models = spark.createDataFrame([("r", "a", "A.gguf", 0), ("r", "b", "B.gguf", 1), ("r", "c", "C.gguf", 2)], "run_id string, model_id string, label string, ordinal int")
    runs = spark.createDataFrame([("r", "a", 2, 54.0, 0.7), ("r", "a", 1, 52.125, 0.7), ("r", "b", 1, 60.0, None), ("r", "b", 2, None, None)],
                                 "run_id string, model_id string, run_no int, ppl double, ppl_se double")
    ppl = perplexity.ppl_summary(runs, run_no="run_no")
    acc = spark.createDataFrame([("r", "a", 0.53, 0.0066, 6100), ("r", "b", 0.528, 0.0066, 6100)], "run_id string, model_id string, acc_score double, acc_stderr double, n_samples long")
    coding = spark.createDataFrame([("r", "a", 34, 2, 4, 200.0 / 34, 400.0 / 34, 40), ("r", "b", 0, 0, 0, None, None, 40)],
                                   "run_id string, model_id string, completed long, pass_num_1 long, pass_num_2 long, pass_rate_1 double, pass_rate_2 double, total long")
    lat = spark.createDataFrame([("r", "a", 20, 312.5, 401.4, 25.25, None), ("r", "b", None, None, None, None, "ValueError: no usable requests")],
                                "run_id string, model_id string, n_requests long, ttft_ms_p50 double, ttft_ms_p95 double, tok_s_median double, error string")
    return composite.composite_leaderboard(models, {"weights_mmlu": 0.5, "weights_ppl": 0.5}, acc, coding, ppl, lat).cache()


def test_details_list_every_run_and_both_percentiles(board):
    d = {r["model_id"]: r for r in report.model_details(board).collect()}
    assert "PPL 53.06 ±1.37 (2 runs: 52.12, 54.00), fidelity 100.0/100" in d["a"]["facts"]
    assert "first token p50 312 ms (p95 401 ms), 25.2 tok/s over 20 requests" in d["a"]["facts"]
    assert "accuracy 53.00% ± 1.29 pts (n=6100)" in d["a"]["facts"] and "(34/40 tests)" in d["a"]["facts"]
    assert "PPL 60.00 (1 runs: 60.00), fidelity 88.4/100" in d["b"]["facts"]
    assert "no completed tests (0/40)" in d["b"]["facts"] and "latency error: ValueError: no usable requests" in d["b"]["facts"]
    assert d["b"]["missing"] == "Coding" and d["c"]["facts"] == "" and d["c"]["breakdown"] == ""
    assert d["a"]["breakdown"].startswith("0.50×PPL(100.0) + 0.25×MMLU(53.0) + 0.25×Coding(11.8)")


def test_records_carry_runs_in_order_with_their_fidelity(board):
    rec = {r["model_id"]: r for r in report.report_records(board).collect()}
    runs = rec["a"]["perplexity"]["runs"]
    assert [r["run_no"] for r in runs] == [1, 2] and [r["ppl"] for r in runs] == [52.125, 54.0]
    # one run alone may be above the best mean
    assert runs[0]["fidelity"] > 100 > runs[1]["fidelity"]
    assert [r["run_no"] for r in rec["b"]["perplexity"]["runs"]] == [1] and rec["c"]["perplexity"] is None


def test_cells_round_by_binary_value_and_follow_the_ranks(board):
    rows = report.leaderboard_display(board).collect()
    assert [(r["line_no"], r["rank_cell"]) for r in rows] == [(1, "1"), (2, "2"), (3, "-")]
    by = {r["model_id"]: r for r in rows}
    # 312.5 and 25.25 are ties: to even, not up
    assert (by["a"]["ttft_cell"], by["a"]["rate_cell"], by["a"]["ppl_cell"]) == ("312", "25", "53.06±1.37")
    assert by["b"]["score_cell"].endswith("†")


def test_legends_name_the_marks_shown(board):
    assert {r["mark"] for r in report.legends(board).collect()} == {"†"}


def _leaderboard(spark, ranks):
    return spark.createDataFrame([("r", m, k, i) for i, (m, k) in enumerate(ranks.items())], "run_id string, model_id string, rank long, ordinal int")


def test_subject_matrix_is_sorted_by_spread_in_rank_order(spark):
    rows = [("r", "a", "s1", 0.5), ("r", "b", "s1", 0.53), ("r", "a", "s2", 0.25), ("r", "c", "s2", 0.5), ("r", "b", "alone", 0.9), ("r", "c", "s0", 0.4), ("r", "b", "s0", 0.37),
            ("r", "a", "mmlu", 0.1), ("r", "b", "mmlu", 0.9), ("q", "z", "s1", 0.1)]
    subjects = spark.createDataFrame([(*x, False) for x in rows], "run_id string, model_id string, subject string, acc double, is_overall boolean")
    wide, models = matrices.subject_matrix_wide(subjects, _leaderboard(spark, {"a": 3, "b": 1, "c": 2, "x": 4}), "r")
    assert models == ["b", "c", "a"] and wide.columns == ["line_no", "subject", "spread", "b", "c", "a"]
    assert [tuple(r) for r in wide.orderBy("line_no").collect()] == [
        (1, "s2", "25.0 †", "–", "50.0", "25.0"), (2, "s0", "3.0", "37.0", "40.0", "–"), (3, "s1", "3.0", "53.0", "–", "50.0")]


def test_exercise_matrix_is_sorted_by_name(spark):
    flags = spark.createDataFrame([("r", "a", "python", "ex2", True, True), ("r", "b", "python", "ex2", False, True), ("r", "b", "python", "ex10", False, False),
                                   ("r", "a", "go", "Ex3", True, True), ("q", "z", "go", "ex1", True, True)],
                                  "run_id string, model_id string, language string, exercise string, pass_1 boolean, pass_any boolean")
    wide, models = matrices.exercise_matrix_wide(flags, _leaderboard(spark, {"a": None, "b": 1, "c": 2}), "r")
    assert models == ["b", "a"]
    assert [tuple(r) for r in wide.orderBy("line_no").collect()] == [
        (1, "go", "Ex3", "–", "1"), (2, "python", "ex10", "·", "–"), (3, "python", "ex2", "2", "1")]
