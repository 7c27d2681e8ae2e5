from evalspark.operators import composite
from tests.conftest import approx

MODELS = "run_id string, model_id string, ordinal int"
ACC = "run_id string, model_id string, acc_score double, acc_stderr double, n_samples bigint"
COD = "run_id string, model_id string, completed bigint, pass_num_1 bigint, pass_num_2 bigint, pass_rate_1 double, pass_rate_2 double"
PPL = "run_id string, model_id string, ppl double, ppl_se double, n_runs bigint, run_min double, run_max double"


def models(spark, n=2):
    return spark.createDataFrame([("r", f"m{i}", i) for i in range(n)], MODELS)


def coding(spark, ks, n=34):
    return spark.createDataFrame([("r", f"m{i}", n, 0, k, 0.0, 100.0 * k / n) for i, k in enumerate(ks)], COD)


def acc(spark, scores, se=None):
    return spark.createDataFrame([("r", f"m{i}", s, se, 100) for i, s in enumerate(scores)], ACC)


def ppl(spark, vals, se=None):
    return spark.createDataFrame([("r", f"m{i}", v, se, 1, v, v) for i, v in enumerate(vals) if v is not None], PPL)


def run(lb):
    return {r["model_id"]: r for r in lb.collect()}


def test_ppl_normalisation_and_rank(spark):
    lb = run(composite.composite_leaderboard(models(spark), {"weights_mmlu": 0.5, "weights_ppl": 1.0},
                                             ppl=ppl(spark, [50.0, 60.0])))
    assert approx(lb["m0"]["ppl_score"], 100.0) and approx(lb["m1"]["ppl_score"], 83.333333)
    assert lb["m0"]["rank"] == 1 and lb["m1"]["rank"] == 2


def test_composite_values(spark):
    lb = run(composite.composite_leaderboard(models(spark), {"weights_mmlu": 0.5, "weights_ppl": 0.5},
                                             acc(spark, [0.30, 0.30]), coding(spark, [0, 0]),
                                             ppl(spark, [40.0, 50.0])))
    assert approx(lb["m0"]["score"], 57.5) and approx(lb["m1"]["score"], 47.5)


def test_zero_ppl_weight(spark):
    lb = run(composite.composite_leaderboard(models(spark), {"weights_mmlu": 0.5, "weights_ppl": 0.0},
                                             acc(spark, [0.258, 0.261]), coding(spark, [1, 0])))
    assert approx(lb["m0"]["score"], 14.370588) and approx(lb["m1"]["score"], 13.05)


def test_renormalisation_single_component(spark):
    lb = run(composite.composite_leaderboard(models(spark, 1), {"weights_mmlu": 0.5, "weights_ppl": 0.5},
                                             acc(spark, [0.30])))
    assert approx(lb["m0"]["score"], 30.0)
    assert [c["weight"] for c in lb["m0"]["components"]] == [1.0]


def test_significance_not_marked(spark):
    lb = run(composite.composite_leaderboard(models(spark), {"weights_mmlu": 0.5, "weights_ppl": 0.5},
                                             acc(spark, [0.258, 0.261], 0.0037), coding(spark, [1, 0]),
                                             ppl(spark, [53.0, 68.0], 0.7)))
    assert approx(lb["m0"]["score"], 57.185294) and approx(lb["m1"]["score"], 45.495588)
    assert approx(lb["m0"]["score_ci_half"], 2.223928) and approx(lb["m1"]["score_ci_half"], 1.503800)
    assert not lb["m0"]["nonsignificant"] and not lb["m1"]["nonsignificant"]


def test_significance_marked_with_wide_se(spark):
    lb = run(composite.composite_leaderboard(models(spark), {"weights_mmlu": 0.5, "weights_ppl": 0.5},
                                             acc(spark, [0.258, 0.261], 0.0037), coding(spark, [1, 0]),
                                             ppl(spark, [53.0, 68.0], 30.0)))
    assert approx(lb["m0"]["score_ci_half"], 55.501170) and approx(lb["m1"]["score_ci_half"], 33.722469)
    assert lb["m0"]["nonsignificant"] and lb["m1"]["nonsignificant"]


def test_marks_without_ppl(spark):
    lb = run(composite.composite_leaderboard(models(spark), {"weights_mmlu": 0.5, "weights_ppl": 0.0},
                                             acc(spark, [0.30, 0.29], 0.01), coding(spark, [2, 1])))
    assert approx(lb["m0"]["score"], 17.941176) and approx(lb["m1"]["score"], 15.970588)
    assert approx(lb["m0"]["score_ci_half"], 4.475051) and approx(lb["m1"]["score_ci_half"], 3.729757)
    assert lb["m0"]["nonsignificant"] and lb["m1"]["nonsignificant"]
    lb = run(composite.composite_leaderboard(models(spark), {"weights_mmlu": 0.5, "weights_ppl": 0.0},
                                             acc(spark, [0.50, 0.30], 0.005), coding(spark, [20, 5])))
    assert approx(lb["m0"]["score"], 54.411765) and approx(lb["m1"]["score"], 22.352941)
    assert not lb["m0"]["nonsignificant"] and not lb["m1"]["nonsignificant"]


def test_missing_components(spark):
    lb = run(composite.composite_leaderboard(models(spark), {"weights_mmlu": 0.5, "weights_ppl": 0.5},
                                             acc(spark, [0.3, 0.3]), ppl=ppl(spark, [None, 50.0])))
    assert lb["m0"]["missing_components"] == ["ppl"] and lb["m1"]["missing_components"] == []
    lb = run(composite.composite_leaderboard(models(spark), {"weights_mmlu": 0.5, "weights_ppl": 0.0},
                                             acc(spark, [0.3, 0.3]), ppl=ppl(spark, [None, 50.0])))
    assert lb["m0"]["missing_components"] == [] and lb["m1"]["missing_components"] == []


def test_ties_keep_input_order_and_weights_sum_to_one(spark):
    lb = composite.composite_leaderboard(models(spark, 3), {"weights_mmlu": 0.5, "weights_ppl": 0.0},
                                         acc(spark, [0.3, 0.3, 0.3]))
    rows = sorted(lb.collect(), key=lambda r: r["ordinal"])
    assert [r["rank"] for r in rows] == [1, 2, 3]
    for r in rows:
        assert abs(sum(c["weight"] for c in r["components"]) - 1.0) < 1e-12


def test_ppl_unavailable_drops_weight(spark):
    lb = run(composite.composite_leaderboard(models(spark), {"weights_mmlu": 0.5, "weights_ppl": 0.5,
                                                             "ppl_available": False},
                                             acc(spark, [0.3, 0.3]), ppl=ppl(spark, [40.0, 50.0])))
    assert approx(lb["m0"]["score"], 30.0) and lb["m0"]["missing_components"] == []


def test_several_runs_are_independent(spark):
    models2 = spark.createDataFrame([("r1", "a", 0), ("r1", "b", 1), ("r2", "a", 0), ("r2", "c", 1)], MODELS)
    runs = spark.createDataFrame([("r1", 0.5, 0.5, True), ("r2", 1.0, 0.0, True)],
                                 "run_id string, weights_mmlu double, weights_ppl double, ppl_available boolean")
    accs = spark.createDataFrame([("r1", "a", 0.3, 0.01, 10), ("r1", "b", 0.4, 0.01, 10),
                                  ("r2", "a", 0.9, 0.01, 10), ("r2", "c", 0.2, 0.01, 10)], ACC)
    ppls = spark.createDataFrame([("r1", "a", 10.0, None, 1, 10.0, 10.0), ("r2", "c", 5.0, None, 1, 5.0, 5.0)], PPL)
    lb = {(r["run_id"], r["model_id"]): r for r in
          composite.composite_leaderboard(models2, runs, accs, None, ppls).collect()}
    # run r1: ppl weight .5 -> a has ppl (fidelity 100), b misses it
    assert approx(lb[("r1", "a")]["score"], 0.5 / 0.75 * 100 + 0.25 / 0.75 * 30)
    assert lb[("r1", "b")]["missing_components"] == ["ppl"] and approx(lb[("r1", "b")]["score"], 40.0)
    # run r2: ppl weight 0 -> accuracy only; its own minimum PPL, its own ranks
    assert approx(lb[("r2", "a")]["score"], 90.0) and lb[("r2", "a")]["rank"] == 1
    assert lb[("r2", "c")]["rank"] == 2 and lb[("r2", "c")]["missing_components"] == []
    assert approx(lb[("r2", "c")]["ppl_score"], 100.0)
