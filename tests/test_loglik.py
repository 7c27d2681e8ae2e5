import random

import pytest
from pyspark.sql import functions as F

from evalspark.operators import accuracy, loglik
from evalspark.plans import catalog
from evalspark.plans import fixtures as fx

TOK = ("request_id string, pos int, target_id bigint, target_text string, "
       "response struct<id:bigint, token:string, logprob:double, "
       "top_logprobs:array<struct<id:bigint, token:string, logprob:double>>>")


def lookup(spark, target_id, target_text, response):
    df = spark.createDataFrame([("q", 0, target_id, target_text, response)], TOK)
    r = loglik.lookup_nested(df).first()
    return r["logprob"], r["is_greedy"]


def resp(gid, gtok, glp, top):
    return (gid, gtok, glp, top)


TOP = [(7, "B", -1.0), (8, " C", -2.0)]


def test_lookup_branches(spark):
    assert lookup(spark, 5, "A", resp(5, "A", -0.25, TOP)) == (-0.25, True)
    assert lookup(spark, 7, "B", resp(5, "A", -0.25, TOP)) == (-1.0, False)
    assert lookup(spark, None, "A", resp(None, " A", -0.5, [(None, "x", -3.0)])) == (-0.5, True)
    assert lookup(spark, None, "C", resp(None, "A", -0.5, [(None, "x", -3.0), (None, " C", -2.0)])) == (-2.0, False)
    assert lookup(spark, 99, "Z", resp(5, "A", -0.25, TOP)) == (-100.0, False)
    assert lookup(spark, 99, "Z", None) == (-100.0, False)


def test_long_form_matches_nested(spark):
    cands = spark.createDataFrame(
        [("m", 1, 0, 5, "A", -0.25), ("m", 1, 1, 5, "A", -0.25), ("m", 1, 2, 7, "B", -1.0),
         ("m", 1, 3, 8, " C", -2.0)],
        "model_id string, prefix_id bigint, cand_pos int, cand_id bigint, cand_token string, cand_logprob double")
    toks = spark.createDataFrame(
        [("r", "m", "q", 0, 1, 5, "A"), ("r", "m", "q", 1, 1, 7, "B"), ("r", "m", "q", 2, 1, 100, "C"),
         ("r", "m", "q", 3, 1, 101, "Z"), ("r", "m", "q", 4, 2, 5, "A")],
        "run_id string, model_id string, request_id string, pos int, prefix_id bigint, target_id bigint, "
        "target_text string")
    out = {r["pos"]: (r["logprob"], r["is_greedy"]) for r in loglik.lookup_long(toks, cands).collect()}
    assert out == {0: (-0.25, True), 1: (-1.0, False), 2: (-2.0, False), 3: (-100.0, False), 4: (-100.0, False)}


def test_score_requests(spark):
    req = spark.createDataFrame([("r", "m", "a", ["x"], ["y", "z"]), ("r", "m", "b", ["x"], [])],
                                "run_id string, model_id string, request_id string, context array<string>, "
                                "continuation array<string>")
    tok = spark.createDataFrame([("r", "m", "a", 0, -0.5, True), ("r", "m", "a", 1, -1.5, True)],
                                "run_id string, model_id string, request_id string, pos int, logprob double, "
                                "is_greedy boolean")
    out = {r["request_id"]: (r["loglik"], r["is_greedy"]) for r in loglik.score_requests(tok, req).collect()}
    assert out == {"a": (-2.0, True), "b": (0.0, True)}


def test_floor_is_per_token(spark):
    req = spark.createDataFrame([("r", "m", "a", [], ["u", "v"])],
                                "run_id string, model_id string, request_id string, context array<string>, "
                                "continuation array<string>")
    toks = loglik.request_tokens(req, lambda c: F.when(c.isNotNull(), F.xxhash64(c)))
    cands = spark.createDataFrame([], "model_id string, prefix_id bigint, cand_pos int, cand_id bigint, "
                                      "cand_token string, cand_logprob double")
    s = loglik.score_requests(loglik.lookup_long(toks, cands), req).first()
    assert s["loglik"] == -200.0 and s["n_tokens"] == 2


def test_choice_accuracy_ties_pick_first(spark):
    ll = spark.createDataFrame([("r", "m", 1, 0, -1.0), ("r", "m", 1, 1, -1.0), ("r", "m", 2, 0, -3.0),
                                ("r", "m", 2, 1, -2.0)],
                               "run_id string, model_id string, doc_id bigint, choice_no int, loglik double")
    gold = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, gold int")
    out = {r["doc_id"]: r["correct"] for r in accuracy.choice_accuracy(ll, gold).collect()}
    assert out == {1: 1.0, 2: 0.0}


def test_norm_token_col_matches_python(spark):
    import unicodedata
    from evalspark.functions.text import norm_token_col
    samples = [" A", "\tb\r\n", "\x1cc\x1f", "ﬁne", " é ", "Ｆull", "", None, "x y", "\x0bz\x0c"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r[0] for r in df.select(norm_token_col(F.col("t"))).collect()]
    want = ["" if s is None else unicodedata.normalize("NFKC", s).strip() for s in samples]
    assert got == want


def test_tokens_and_pairs_move_once_each(spark):
    from evalspark.operators import ngram
    tid = lambda c: F.when(c.isNotNull(), F.xxhash64(c))
    words = ["a", "b", "a", "c", "a", "b", "", "é"]
    pairs = spark.createDataFrame([("m", p, n) for p, n in zip(words, words[1:])] + [(None, "a", "b"), ("m", None, "b")], "model_id string, prev string, next string")
    req = spark.createDataFrame([("r", "m", "q", ["a"], ["b", "a", "c", "x"]), ("r", None, "n", ["a"], ["b"])],
                                "run_id string, model_id string, request_id string, context array<string>, continuation array<string>")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = loglik.lookup_long(loglik.request_tokens(req, tid), ngram.top_k_candidates(pairs, tid))
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        got = {(r["request_id"], r["pos"]): (round(r["logprob"], 6), r["outcome"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert got == {("q", 0): (-0.405465, "greedy"), ("q", 1): (-0.693147, "candidate"), ("q", 2): (-1.098612, "candidate"), ("q", 3): (-100.0, "floor"), ("n", 0): (-100.0, "floor")}


def random_documents(spark, path, rows, words):
    """A documents table of invented words, with an empty text, one word, null texts and a null source."""
    r = random.Random(7)
    data = [(i, " ".join(f"w{int(r.expovariate(0.02))}" for _ in range(words)), f"src{i % 3}") for i in range(rows)]
    data += [(rows, "", "src0"), (rows + 1, "alone", "src1"), (rows + 2, None, "src2"), (rows + 3, "w1 w2 w1 w2", None), (0, "w1 w2 \ufb01x w2", "src1")]
    spark.createDataFrame(data, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    every = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in every if f.getName().startswith("shuffle_")}


@pytest.mark.parametrize("name", ["token_logprob_lookup", "token_logprob_lookup_nested", "request_loglik"])
def test_lookups_leave_no_shuffles_of_tokens(spark, tmp_path, name):
    sf = random_documents(spark, tmp_path, 300, 400)
    before = shuffle_files(spark)
    assert len(catalog.QUERIES[name](spark, sf).collect()) > 0
    # 120,000 tokens and as many pairs are several MB
    assert sum(size for file, size in shuffle_files(spark).items() if file not in before) < 300_000


def test_parts_of_a_lookup_are_the_whole_lookup(spark, tmp_path):
    sf = random_documents(spark, tmp_path, 40, 50)
    req = fx.document_requests(spark, sf)
    # a request without a context has a token without a previous one
    bare = req.where("doc_id = 5").withColumn("context", F.expr("cast(array() as array<string>)")).withColumn("request_id", F.lit(-1).cast("long"))
    req = req.unionByName(bare)
    tokens = fx.blank_some_ids(loglik.request_tokens(req, fx.token_id))
    whole = loglik.lookup_long(tokens, fx.ngram_candidates(spark, sf))
    parts = loglik.by_prefix_parts(spark, lambda among: loglik.lookup_long(tokens.filter(among(F.col("prefix_id"))), fx.ngram_candidates(spark, sf, among=among)), 3)
    rows = lambda df: sorted(map(repr, df.select(*sorted(whole.columns)).collect()))
    assert rows(parts) == rows(whole) and whole.where("prefix_id is null").count() == 1
    sums = loglik.by_prefix_parts(spark, lambda among: loglik.request_sums(whole.filter(among(F.col("prefix_id")))), 3)
    short = lambda df: sorted(map(repr, df.select("model_id", "request_id", F.round("loglik", 9), "is_greedy", "n_tokens").collect()))
    assert short(loglik.score_request_sums(sums, req)) == short(loglik.score_requests(whole, req))
