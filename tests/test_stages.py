"""Stage graph: a failing stage leaves its text, only dependents are skipped, the rest goes on."""
import pytest
from pyspark.sql import functions as F

from evalspark.operators import composite, stages
from evalspark.operators.stages import Stage, run_stages


def rows(spark, n=3):
    return lambda _: spark.range(n)


def boom(text):
    def make(_):
        raise RuntimeError(text)
    return make


def test_server_failure_skips_only_what_needs_it(spark):
    called = []

    def coding(tables):
        called.append("coding")
        return spark.range(1)

    out = run_stages([Stage("server", boom("boom")), Stage("accuracy", rows(spark), needs=["server"]), Stage("latency", rows(spark), needs=["server"]),
                      Stage("coding", coding, needs=["accuracy"]), Stage("ppl", rows(spark))])
    assert out.status == {"server": "failed", "accuracy": "skipped", "latency": "skipped", "coding": "skipped", "ppl": "ok"}
    assert out.errors == {"server": "RuntimeError: boom"} and called == [] and out.tables["ppl"].count() == 3


def test_stage_failure_does_not_stop_its_neighbours(spark):
    out = run_stages([Stage("server", lambda _: None), Stage("accuracy", boom("accuracy broke"), needs=["server"]), Stage("latency", rows(spark), needs=["server"]),
                      Stage("coding", rows(spark), enabled=False)])
    assert out.status == {"server": "ok", "accuracy": "failed", "latency": "ok", "coding": "off"}
    assert out.errors["accuracy"] == "RuntimeError: accuracy broke"
    assert [tuple(r) for r in out.table(spark).collect()][1] == ("accuracy", "failed", "RuntimeError: accuracy broke")


def test_a_failing_job_fails_its_own_stage(spark):
    def job(raised):
        return lambda _: spark.range(100).repartition(4).withColumn("x", F.when(F.col("id") == 57, raised).otherwise(F.lit(1)))

    def python_job(_):
        def run(batches):
            for b in batches:
                raise KeyError("a row without a key")
                yield b
        return spark.range(10).mapInArrow(run, "id long")

    out = run_stages([Stage("raised", job(F.raise_error(F.lit("no result in the log\nlast line")).cast("int"))), Stage("divided", job((F.lit(1) / (F.col("id") - 57)).cast("int"))),
                      Stage("python", python_job), Stage("after", rows(spark), needs=["divided"]), Stage("free", lambda t: spark.range(2))])
    assert out.errors["raised"] == "USER_RAISED_EXCEPTION: no result in the log\nlast line"
    assert out.errors["divided"].startswith("DIVIDE_BY_ZERO: ") and "SQLSTATE" not in out.errors["divided"]
    assert "python" in out.errors and "\n" not in out.errors["python"]
    assert out.status["after"] == "skipped" and out.tables["free"].count() == 2


def test_tables_are_handed_on_and_written_once(spark):
    seen = []

    def second(tables):
        seen.append(sorted(tables))
        return tables["first"].withColumn("y", F.col("id") + 1)

    out = run_stages([Stage("first", rows(spark)), Stage("second", second, needs=["first"])])
    assert seen == [["first"]] and out.tables["second"].agg(F.sum("y")).first()[0] == 6
    assert "Range" not in out.tables["second"]._jdf.queryExecution().toString()


def test_order_and_names_are_checked(spark):
    with pytest.raises(ValueError, match="before what it needs"):
        run_stages([Stage("b", rows(spark), needs=["a"]), Stage("a", rows(spark))])
    with pytest.raises(ValueError, match="two stages"):
        run_stages([Stage("a", rows(spark)), Stage("a", rows(spark))])


def test_errors_stand_beside_the_scores(spark):
    graph = [Stage("coding", boom("no server")), Stage("accuracy", lambda _: spark.createDataFrame([("r", "m", 0.5, 0.01)], "run_id string, model_id string, acc_score double, acc_stderr double"))]
    out = run_stages(graph)
    models = stages.with_stage_errors(spark.createDataFrame([("r", "m", 0)], "run_id string, model_id string, ordinal int"), out, graph)
    lb = composite.composite_leaderboard(models, {"weights_mmlu": 0.5, "weights_ppl": 0.0}, out.tables.get("accuracy"), out.tables.get("coding")).first()
    assert lb["coding_error"] == "RuntimeError: no server" and lb["score"] == 50.0
