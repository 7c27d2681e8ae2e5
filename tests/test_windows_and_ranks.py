"""Windowed perplexity over several texts, and percentiles of one group that spans several tasks."""
import math
import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from evalspark.operators import perplexity
from evalspark.operators.quantiles import exact_percentiles


def test_windows_run_across_texts(spark):
    r = random.Random(3)
    texts = [(m, d, [-r.random() * 5 for _ in range(r.randrange(0, 9))]) for m in ("a", "b") for d in range(60)]
    df = spark.createDataFrame(texts, "model_id string, doc int, lp array<double>").repartition(5)
    offsets = perplexity.text_offsets(df, F.size("lp"), ["doc"], ["model_id"])
    tokens = df.join(offsets, ["model_id", "doc"]).select("model_id", "offset", F.posexplode("lp").alias("at", "logprob")).withColumn("position", F.col("offset") + F.col("at"))
    got = {(x["model_id"], x["chunk_no"]): x for x in perplexity.windowed_perplexity(tokens, 16, ["model_id"]).collect()}
    for m in ("a", "b"):
        flat = [v for mm, _, lp in texts if mm == m for v in lp]
        for k in range(0, len(flat), 16):
            part = flat[k:k + 16]
            g = got.pop((m, k // 16))
            assert g["n_tokens"] == len(part) and math.isclose(g["ppl"], math.exp(-statistics.fmean(part)))
            if len(part) > 1:
                assert math.isclose(g["ppl_se"], math.exp(-statistics.fmean(part)) * statistics.stdev(part) / math.sqrt(len(part)))
    assert not got


def test_one_group_is_ranked_over_several_tasks(spark):
    r = random.Random(8)
    values = [r.gauss(0, 1) for _ in range(20_000)] + [0.5] * 5_000
    df = spark.createDataFrame([("g", v) for v in values], "k string, v double").repartition(6)
    # a coarse sketch leaves a wide band
    out = exact_percentiles(df, ["k"], "v", [0.05, 0.5, 0.95], accuracy=20)
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan
    row = out.first()
    for name, q in (("p5", 5), ("p50", 50), ("p95", 95)):
        assert math.isclose(row[name], float(np.percentile(values, q)), rel_tol=1e-12)


def test_windows_counted_by_word_equal_windows_of_tokens(spark):
    r = random.Random(9)
    rows = [(m, p, r.choice("aaaabbcd")) for m in ("x", "y") for p in range(301)]
    lp = {"a": -1.0, "b": -2.5, "c": -7.0, "d": -11.25}
    tokens = spark.createDataFrame(rows, "model_id string, position long, word string")
    vocab = spark.createDataFrame(list(lp.items()), "word string, logprob double")
    one = perplexity.windowed_perplexity(tokens.join(vocab, "word"), 100, ["model_id"])
    two = perplexity.windowed_perplexity_of_words(tokens, vocab, 100, ["model_id"])
    key = lambda x: (x["model_id"], x["chunk_no"])
    for a, b in zip(sorted(one.collect(), key=key), sorted(two.collect(), key=key), strict=True):
        assert key(a) == key(b) and a["n_tokens"] == b["n_tokens"] and math.isclose(a["ppl"], b["ppl"])
        # the last window has one token and no spread
        assert (a["ppl_se"] is None) == (b["ppl_se"] is None) == (a["chunk_no"] == 3) and (a["ppl_se"] is None or math.isclose(a["ppl_se"], b["ppl_se"], rel_tol=1e-9))


def test_texts_move_to_their_offsets_before_they_are_words(spark, tmp_path):
    from evalspark.plans import fixtures as fx
    rows = [(2, "src0", "c  d"), (1, "src0", "A b"), (3, "src1", "e"), (4, "src1", None)]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens, _ = fx.positioned_words(spark, str(tmp_path))
    plan = tokens._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("split(lower(text") < plan.find("Join Inner")
    assert sorted(tuple(r) for r in tokens.collect()) == [("src0", 0, "a"), ("src0", 1, "b"), ("src0", 2, "c"), ("src0", 3, "d"), ("src1", 0, "e")]
