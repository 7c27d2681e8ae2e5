"""Scorer and generator hooks: lazy prefixes, truncation, order, one building per worker, answered requests."""
import math
import os

import pytest
from pyspark.sql import functions as F

from evalspark.operators import hooks

REQ = "run_id string, model_id string, request_id string, request_no long, context_ids array<bigint>, continuation_ids array<bigint>"


def requests(spark, rows):
    return spark.createDataFrame([("r", "m", name, i, c, t) for i, (name, c, t) in enumerate(rows)], REQ)


def seen_by(df, **kw):
    """What a scorer was asked, told by a number per prefix: digits of its length, first and last id, and the target."""
    def factory():
        def score(prefixes):
            for p in prefixes:
                ids = p.ids.tolist()
                yield float(p.target + 100 * len(ids) + 10_000 * (ids[0] if ids else 0) + 1_000_000 * (ids[-1] if ids else 0)), len(ids) % 2 == 0
        return score
    return {r["request_id"]: (r["loglik"], r["is_greedy"], r["n_tokens"]) for r in hooks.score_with(df, factory, **kw).collect()}


def test_each_token_sees_its_whole_prefix(spark):
    df = requests(spark, [("a", [1, 2], [3, 4, 5]), ("b", [], []), ("c", [7], [8]), ("d", None, [9]), ("e", [1], None)])
    got = seen_by(df)
    assert got["a"] == ((3 + 200 + 10_000 + 2_000_000) + (4 + 300 + 10_000 + 3_000_000) + (5 + 400 + 10_000 + 4_000_000), False, 3)
    assert got["b"] == got["e"] == (0.0, True, 0)
    assert got["c"] == (8 + 100 + 70_000 + 7_000_000, False, 1) and got["d"] == (9.0, True, 1)


def test_context_is_cut_to_the_window(spark):
    df = requests(spark, [("a", [1, 2, 3, 4], [5]), ("b", [1, 2], [3, 4, 5, 6]), ("c", [1], [2])])
    got = seen_by(df, max_length=3)
    # two context ids are left; none; nothing is cut
    assert got["a"][0] == 5 + 200 + 30_000 + 4_000_000 and got["c"][0] == 2 + 100 + 10_000 + 1_000_000
    assert got["b"] == (3 + (4 + 100 + 30_000 + 3_000_000) + (5 + 200 + 30_000 + 4_000_000) + (6 + 300 + 30_000 + 5_000_000), False, 4)


def test_adaptive_scorer_by_hand(spark):
    df = requests(spark, [("a", [1], [1, 2, 1]), ("b", [], [5])])
    got = {r["request_id"]: r for r in hooks.score_with(df, lambda: hooks.AdaptiveScorer(10)).collect()}
    assert math.isclose(got["a"]["loglik"], math.log(2 / 11) + math.log(1 / 12) + math.log(3 / 13)) and not got["a"]["is_greedy"]
    assert math.isclose(got["b"]["loglik"], math.log(1 / 10)) and not got["b"]["is_greedy"]


def test_a_batching_scorer_and_a_wrong_one(spark):
    df = requests(spark, [("a", [1], [2, 3, 4]), ("b", [1], [2, 3])])

    def batching():
        from itertools import islice

        def score(prefixes):
            it = iter(prefixes)
            while batch := list(islice(it, 4)):
                yield from ((-float(p.target), True) for p in batch)
        return score

    assert {r["request_id"]: r["loglik"] for r in hooks.score_with(df, batching).collect()} == {"a": -9.0, "b": -5.0}
    with pytest.raises(Exception, match="unanswered"):
        hooks.score_with(df, lambda: lambda prefixes: [(0.0, True) for p in list(prefixes)[1:]]).collect()


def test_built_once_per_worker(spark, tmp_path):
    log = str(tmp_path)

    def factory():
        import uuid
        open(os.path.join(log, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return hooks.AdaptiveScorer()

    df = spark.range(400).repartition(12).selectExpr("'r' run_id", "'m' model_id", "cast(id as string) request_id", "id request_no", "array(1L) context_ids", "array(id, 1L) continuation_ids")
    assert hooks.score_with(df, factory).count() == 400
    pids = [f.split("-")[0] for f in os.listdir(log)]
    assert len(pids) == len(set(pids)) <= 12


def test_generator_window_placeholder_and_order(spark):
    rows = [("r", "m", f"q{i}", 9 - i, list(p)) for i, p in enumerate([[1, 2, 3, 1], [4, 5, 6], [], [8, 1, 7, 7, 9, 1, 2, 7]])]
    df = spark.createDataFrame(rows, "run_id string, model_id string, request_id string, request_no long, prompt_ids array<bigint>")
    out = hooks.generate_with(df, "prompt-lookup", max_length=6, max_new_tokens=2)
    got = [(r["request_id"], r["generated"]) for r in hooks.in_request_order(out).collect()]
    # the last prompt is cut to its last four ids (9, 1, 2, 7), in which 7 occurs once
    assert got == [("q3", None), ("q2", None), ("q1", None), ("q0", [2, 3])]
    text = hooks.placeholder_texts(out.withColumn("generated", F.array_join("generated", " "))).where("request_id in ('q0', 'q1')").orderBy("request_id").collect()
    assert [(r["generated"], r["is_placeholder"]) for r in text] == [("2 3", False), ("[no response]", True)]


def test_answered_requests_are_not_sent_again(spark):
    schema = "n int, prompt string, stop array<string>"
    df = spark.createDataFrame([(1, "a", ["x"]), (2, "a", []), (3, None, ["x"]), (4, "b", ["x"]), (5, "b", ["x"])], schema)
    answered = spark.createDataFrame([(9, "a", ["x"]), (9, None, ["x"]), (9, "bx", [])], schema)
    assert sorted(r["n"] for r in hooks.unanswered(df, answered, ["prompt", "stop"]).collect()) == [2, 4, 5]


def test_unknown_name(spark):
    with pytest.raises(KeyError, match="adaptive"):
        hooks.score_with(requests(spark, []), "no such scorer")
